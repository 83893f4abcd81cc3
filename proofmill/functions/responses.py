"""Raw engine and judge responses (JSON texts) as Column functions. What can't be parsed is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.functions import text as T

BLOCKS = "readResult struct<blocks array<struct<lines array<struct<text string, words array<struct<confidence double>>>>>>>"
FLAT = "IsErroredOnProcessing boolean, OCRExitCode int, ParsedResults array<struct<ParsedText string>>"
ANNOTATION = (
    "textAnnotations array<struct<description string>>, fullTextAnnotation struct<text string, pages array<struct<blocks array<struct<confidence double>>>>>, "
    "error struct<message string>"
)
DIFF = "struct<ocr string, ref string, kind string>"
REPLY = f"real_differences array<{DIFF}>, ocr_noise array<{DIFF}>, reason string"
USAGE = "$.usage.cost"
#: Texts of any length; by itself Spark makes a response null that holds one of more than 20,000,000 characters.
WHOLE = {"maxStringLen": str(2**31 - 1)}


def mean(values: Column) -> Column:
    """The mean of the values that aren't null, or null."""
    kept = F.array_compact(values)
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x) / F.size(kept))


def from_blocks(body: Column) -> Column:
    """struct(text, confidence) of a response with blocks, lines and words; null without a line."""
    blocks = F.from_json(body, BLOCKS, WHOLE)["readResult"]["blocks"]
    lines = F.flatten(F.transform(blocks, lambda b: F.coalesce(b["lines"], F.array().cast("array<struct<text string, words array<struct<confidence double>>>>"))))
    confidences = F.flatten(F.transform(lines, lambda x: F.coalesce(F.transform(x["words"], lambda w: w["confidence"]), F.array().cast("array<double>"))))
    text = T.strip_heading_marks(F.btrim(F.array_join(F.transform(lines, lambda x: F.coalesce(x["text"], F.lit(""))), "\n"), F.lit(" \t\n\r")))
    return F.when(F.size(lines) > 0, F.struct(text.alias("text"), mean(confidences).alias("confidence")))


def from_flat(body: Column) -> Column:
    """struct(text, confidence) of a flat response: no error, exit code 1 or 2, a text with a letter or digit."""
    r = F.from_json(body, FLAT, WHOLE)
    raw = F.btrim(F.coalesce(F.get(r["ParsedResults"], F.lit(0))["ParsedText"], F.lit("")), F.lit(" \t\n\r"))
    text = T.strip_heading_marks(raw)
    ok = ~F.coalesce(r["IsErroredOnProcessing"], F.lit(False)) & F.coalesce(r["OCRExitCode"], F.lit(0)).isin(1, 2) & T.has_letter_or_digit(text)
    return F.when(ok, F.struct(text.alias("text"), F.lit(None).cast("double").alias("confidence")))


def from_annotation(body: Column, mode: Column) -> Column:
    """struct(text, confidence) of an annotation response: the full text in document mode, else the first description; zero confidences don't count."""
    r = F.from_json(body, ANNOTATION, WHOLE)
    full = r["fullTextAnnotation"]
    blocks = F.flatten(F.transform(full["pages"], lambda p: F.coalesce(p["blocks"], F.array().cast("array<struct<confidence double>>"))))
    confidence = mean(F.transform(blocks, lambda b: F.when(b["confidence"] != 0, b["confidence"])))
    document = F.lower(F.trim(F.coalesce(mode, F.lit("text")))).isin("document", "document_text_detection")
    raw = F.when(document, full["text"]).otherwise(F.get(r["textAnnotations"], F.lit(0))["description"])
    text = F.btrim(F.coalesce(raw, F.lit("")), F.lit(" \t\n\r"))
    return F.when((text != "") & r["error"]["message"].isNull(), F.struct(text.alias("text"), confidence.alias("confidence")))


def partial(text: Column, confidence: Column, config) -> Column:
    """Whether a reading has few words or a low confidence."""
    few = F.size(T.words(T.collapse(text))) <= config.partial_words
    return few | F.coalesce(confidence < config.partial_confidence, F.lit(False))


def zone_notes(notes: Column) -> Column:
    """struct(target_id, zone_name) of a zone's notes, null if they name no target."""
    n = F.from_json(notes, "phase2_target_id string, phase2_zone_name string")
    return F.when(F.trim(F.coalesce(n["phase2_target_id"], F.lit(""))) != "", F.struct(n["phase2_target_id"].alias("target_id"), n["phase2_zone_name"].alias("zone_name")))


def judge_reply(content: Column) -> Column:
    """struct(verdict, reason, real_differences, ocr_noise) of a judge's reply: the whole text, the text without fences, or its first {...}, whichever parses first. Any real difference fails."""
    unfenced = F.trim(F.regexp_replace(content, r"(?im)^```(?:json)?\s*|\s*```$", ""))
    braces = F.regexp_extract(content, r"(?s)\{.*\}", 0)
    whole = lambda s: F.when(F.trim(s).rlike(r"(?s)^\{.*\}$") & F.get_json_object(s, "$").isNotNull(), s)
    found = F.coalesce(whole(content), whole(unfenced), whole(braces))
    r = F.from_json(found, REPLY)

    def diffs(value: Column) -> Column:
        kept = F.coalesce(value, F.array().cast(f"array<{DIFF}>"))
        cut = lambda x, n: F.substring(F.coalesce(x, F.lit("")), 1, n)
        return F.transform(
            F.filter(kept, lambda d: d.isNotNull()),
            lambda d: F.struct(cut(d["ocr"], 120).alias("ocr"), cut(d["ref"], 120).alias("ref"), cut(d["kind"], 30).alias("kind")),
        )

    real = diffs(r["real_differences"])
    return F.when(
        found.isNotNull(),
        F.struct(
            F.when(F.size(real) > 0, "fail").otherwise("pass").alias("verdict"), F.substring(F.coalesce(r["reason"], F.lit("")), 1, 300).alias("reason"),
            real.alias("real_differences"), diffs(r["ocr_noise"]).alias("ocr_noise"),
        ),
    )


def judge_cost(body: Column) -> Column:
    """The cost a reply reports, null if it isn't a number from 0 on."""
    cost = F.get_json_object(body, USAGE).try_cast("double")
    return F.when(cost >= 0, cost)


def first_differences(diffs: Column, n: int = 3) -> Column:
    """The first differences as a text, with the number of those left out."""
    named = lambda x, other: F.when(F.coalesce(x, F.lit("")) == "", other).otherwise(x)
    one = lambda d: F.concat(named(d["kind"], "diff"), F.lit(": OCR '"), named(d["ocr"], "(empty)"), F.lit("' vs reference '"), named(d["ref"], "(empty)"), F.lit("'"))
    rest = F.when(F.size(diffs) > n, F.concat(F.lit(" (+"), (F.size(diffs) - n).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(F.array_join(F.transform(F.slice(diffs, 1, n), one), "; "), rest)
