"""PASS / MANUAL verdicts with reason codes, judge requests and replies, review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.config import DEFAULT, PROTECTED_REASONS, Config
from proofmill.functions import compare as C
from proofmill.functions import responses as R
from proofmill.functions import text as T

# Every reason that a verdict can have, with its status.
REASONS = (
    ("image_read_error", "MANUAL"), ("missing_bbox", "MANUAL"), ("crop_required", "MANUAL"), ("missing_en_reference_text", "MANUAL"),
    ("missing_en_ocr_text", "MANUAL"), ("no_reference_section", "MANUAL"), ("no_sections", "MANUAL"), ("ocr_too_short", "MANUAL"),
    ("all_placeholders", "MANUAL"), ("ambiguous_delta", "MANUAL"), ("strict_equal", "PASS"), ("soft_equal_only", "MANUAL"), ("no_match", "MANUAL"),
    ("translator_outlier", "MANUAL"), ("engines_disagree", "MANUAL"), ("llm_adjudicated", "PASS"), ("llm_rejected", "MANUAL"),
    ("localized_mismatch", "MANUAL"), ("no_engines_configured", "MANUAL"), ("all_engines_failed", "MANUAL"), ("no_consensus", "MANUAL"),
    ("no_text_match", "MANUAL"), ("logo_template_missing", "MANUAL"), ("logo_decode_failed", "MANUAL"), ("logo_template_larger_than_zone", "MANUAL"),
    ("logo_mismatch", "MANUAL"), ("no_image", "MANUAL"), ("processing_error", "MANUAL"),
)


def session_verdict(rows: DataFrame) -> DataFrame:
    """rows with status and reason for a session's zones; the first condition that holds decides.

    rows has image_ok, bbox, crop_ok, en_reference, en_reading, section_found
    and the selection's sel_status and sel_reason.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    early = (
        F.when(~F.col("image_ok"), "image_read_error").when(F.col("bbox").isNull(), "missing_bbox").when(~F.col("crop_ok"), "crop_required")
        .when(blank("en_reference"), "missing_en_reference_text").when(blank("en_reading"), "missing_en_ocr_text").when(~F.col("section_found"), "no_reference_section")
    )
    return rows.withColumn("reason", F.coalesce(early, "sel_reason")).withColumn("status", F.when(early.isNull(), F.col("sel_status")).otherwise("MANUAL"))


def run_verdict(votes: DataFrame) -> DataFrame:
    """votes (status, reason, type, applied, match_pass, n_engines) of a template run: an agreed text that doesn't match its expected text goes to a person, but for logos; zones without engines have their own reason."""
    none = F.col("n_engines") == 0
    miss = (F.col("status") == "OK") & F.coalesce(F.col("applied") & ~F.col("match_pass"), F.lit(False)) & (F.col("type") != "logo")
    reason = F.when(none, "no_engines_configured").when(miss, "no_text_match").otherwise(F.col("reason"))
    return votes.withColumn("reason", reason).withColumn("status", F.when(none | miss, "MANUAL").otherwise(F.col("status")))


def image_verdict(images: DataFrame) -> DataFrame:
    """images (text, ref_text, lang, reason, status, disagree, outlier, judge) with the image's status and reason.

    Images without text or reference keep what they have, as do those with a
    protected reason. judge is pass, fail or null (not called, or an error).
    """
    equal = T.normalize("text", "strict", F.col("lang")) == T.normalize("ref_text", "strict", F.col("lang"))
    reason = (
        F.when(F.col("outlier"), "translator_outlier").when(F.col("disagree"), "engines_disagree").when(equal, "strict_equal")
        .when(F.col("judge") == "pass", "llm_adjudicated").when(F.col("judge") == "fail", "llm_rejected").otherwise("localized_mismatch")
    )
    judged = (F.coalesce("text", F.lit("")) != "") & (F.coalesce("ref_text", F.lit("")) != "") & ~F.coalesce(F.col("reason").isin(*PROTECTED_REASONS), F.lit(False))
    rows = images.withColumn("reason", F.when(judged, reason).otherwise(F.col("reason")))
    return rows.withColumn("status", F.when(judged, F.when(F.col("reason").isin("strict_equal", "llm_adjudicated"), "PASS").otherwise("MANUAL")).otherwise(F.col("status")))


def content_key(lang: Column, reading: Column, reference: Column) -> Column:
    """The key under which equal requests share a reply."""
    zero = F.lit("\0")
    return F.sha1(F.concat(F.coalesce(lang, F.lit("")), zero, F.lower(reading), zero, F.lower(reference)).cast("binary"))


def judge_requests(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Distinct (key, lang, ocr, ref) of rows (text, ref_text, lang, match_pass, similarity) in the grey zone."""
    grey = rows.where(C.in_grey_zone(F.col("match_pass"), F.col("similarity"), config))
    clean = grey.select("lang", T.judge_form("text", F.col("lang")).alias("ocr"), T.judge_form("ref_text", F.col("lang")).alias("ref"))
    return clean.withColumn("key", content_key(F.col("lang"), F.col("ocr"), F.col("ref"))).dropDuplicates(["key"])


def cache_misses(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests that no stored reply has the key of."""
    return requests.join(replies.select("key").distinct(), "key", "left_anti")


def apply_replies(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """rows (key, match_pass, match_mode) with judge verdicts: a pass turns a failed match; the first reply of a key counts."""
    first = replies.groupBy("key").agg(F.min_by("verdict", "reply_id").alias("verdict"))
    both = rows.join(first, "key", "left")
    flip = F.coalesce((F.col("verdict") == "pass") & ~F.col("match_pass"), F.lit(False))
    return both.withColumn("match_mode", F.when(flip, "llm_adjudicated").otherwise(F.col("match_mode"))).withColumn("match_pass", F.col("match_pass") | flip)


def review_decisions(decisions: DataFrame, results: DataFrame) -> DataFrame:
    """(result_id, decision): the last ok or error for each known result; of two at the same time, `ok` stands, and one without a time comes before all others."""
    valid = decisions.where(F.col("decision").isin("ok", "error")).join(results.select("result_id"), "result_id", "left_semi")
    return valid.groupBy("result_id").agg(F.max(F.struct("ts", "decision")).alias("last")).select("result_id", "last.decision")


def updated_verdicts(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """results (result_id, status, reason) with new verdicts where there are any; protected reasons stay."""
    new = verdicts.select("result_id", F.col("status").alias("n_status"), F.col("reason").alias("n_reason"))
    keep = F.coalesce(F.col("reason").isin(*PROTECTED_REASONS), F.lit(False)) | F.col("n_status").isNull()
    rows = results.join(new, "result_id", "left").withColumn("keep", keep)
    rows = rows.withColumn("status", F.when(F.col("keep"), F.col("status")).otherwise(F.col("n_status")))
    return rows.withColumn("reason", F.when(F.col("keep"), F.col("reason")).otherwise(F.col("n_reason"))).drop("n_status", "n_reason", "keep")


def reason_text(reason: Column, lang: Column, missing: Column, extra: Column, diffs: Column) -> Column:
    """What a person reads beside a MANUAL row; null where the reason says it all."""
    listed = lambda label, a, tail: F.when(F.size(a) > 0, F.concat(F.lit(label), F.array_join(a, ", "), F.lit(tail)))
    outlier = F.concat(F.lit("Numbers differ ("), lang, F.lit("): "), F.concat_ws("; ", listed("missing ", missing, ""), listed("extra ", extra, "")))
    return (
        F.when(reason == "translator_outlier", outlier).when(reason == "engines_disagree", "No two engines read the same text.")
        .when((reason == "llm_rejected") & (F.size(diffs) > 0), F.concat(F.lit("Judge: "), R.first_differences(diffs)))
        .when(reason == "localized_mismatch", "The text differs from its reference and the judge had no verdict.")
    )
