"""Roll-ups of verdicts to images, targets, sessions and jobs; pages and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmill.config import ENGINES
from proofmill.operators.ranks import with_ranks


def joined_text(rows: DataFrame, keys: list[str], text: str = "text", order: str = "ord") -> DataFrame:
    """(keys, text): texts that aren't empty, one a line, in order."""
    items = F.array_sort(F.collect_list(F.when(F.coalesce(text, F.lit("")) != "", F.struct(order, text))))
    return rows.groupBy(*keys).agg(items.alias("items")).select(*keys, F.array_join(F.col(f"items.{text}"), "\n").alias("text"))


def image_rollup(rows: DataFrame) -> DataFrame:
    """A row for each image of zone rows (session_id, image_name, id, status, reason, decision, ref_text, confidence).

    MANUAL if any zone isn't PASS; ok if all decisions are, else error if any
    is; the reason is that of the first zone that isn't PASS, reference and
    confidence are the first zone's.
    """
    open_ = F.coalesce(F.col("status") != "PASS", F.lit(True))
    all_ok = F.min(F.coalesce(F.col("decision") == "ok", F.lit(False)))
    any_error = F.max(F.coalesce(F.col("decision") == "error", F.lit(False)))
    first = F.min_by(F.struct("reason"), F.struct((~open_).alias("o"), "id"))
    return rows.groupBy("session_id", "image_name").agg(
        F.when(F.max(open_), "MANUAL").otherwise("PASS").alias("status"), F.when(all_ok, "ok").when(any_error, "error").alias("decision"),
        first["reason"].alias("reason"), F.min_by("ref_text", "id").alias("ref_text"), F.min_by("confidence", "id").alias("confidence"),
        F.array_sort(F.collect_list("id")).alias("ids"),
    )


def target_rollup(rows: DataFrame) -> DataFrame:
    """(job_id, target_id, status): error if any zone is, else MANUAL if any is, else OK."""
    any_ = lambda s: F.max(F.col("status") == s)
    return rows.groupBy("job_id", "target_id").agg(F.when(any_("error"), "error").when(any_("MANUAL"), "MANUAL").otherwise("OK").alias("status"))


def job_totals(targets: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return targets.groupBy("job_id").agg(count("OK").alias("ok"), count("MANUAL").alias("manual"), count("error").alias("error"), F.count("*").alias("total"))


def session_totals(rows: DataFrame) -> DataFrame:
    """(session_id, total, passed, manual, unresolved, resolved, disagreeing, mean_confidence)."""
    passed = F.count_if(F.col("status") == "PASS")
    unresolved = F.count_if((F.col("status") != "PASS") & F.col("decision").isNull())
    return rows.groupBy("session_id").agg(
        F.count("*").alias("total"), passed.alias("passed"), (F.count("*") - passed).alias("manual"), unresolved.alias("unresolved"), (unresolved == 0).alias("resolved"),
        F.count_if("disagree").alias("disagreeing"), F.round(F.coalesce(F.avg(F.coalesce("confidence", F.lit(0.0))), F.lit(0.0)), 4).alias("mean_confidence"),
    )


def reason_counts(rows: DataFrame) -> DataFrame:
    """(session_id, reasons): a map from reason to its number of rows."""
    counts = rows.where("reason is not null").groupBy("session_id", "reason").agg(F.count("*").alias("n"))
    return counts.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))


def session_meta(rows: DataFrame, calls: DataFrame, locked: DataFrame, details: DataFrame) -> DataFrame:
    """(session_id, meta): counters, judge totals, the locked section and reason texts as one JSON document.

    locked has (session_id, section_no, section_name), details (session_id,
    reason, detail). A reason has one text, its first in order: texts of each
    image stay in a table, so that no session's document grows with its rows.
    """
    texts = details.groupBy("session_id", "reason").agg(F.min("detail").alias("detail")).where("detail is not null")
    texts = texts.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "detail")))).alias("reason_texts"))
    both = session_totals(rows).join(judge_totals(calls), "session_id", "left").join(reason_counts(rows), "session_id", "left")
    both = both.join(locked, "session_id", "left").join(texts, "session_id", "left")
    both = both.na.fill(0, ["calls", "flips"]).na.fill(0.0, ["cost"])
    doc = F.struct("total", "passed", "manual", "unresolved", "disagreeing", "section_no", "section_name", "calls", "flips", "cost", "reasons", "reason_texts")
    return both.select("session_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("meta"))


def judge_totals(calls: DataFrame) -> DataFrame:
    """(session_id, calls, cost, flips) of judge calls (called, from_cache, cost, verdict)."""
    fresh = F.col("called") & ~F.col("from_cache")
    return calls.groupBy("session_id").agg(
        F.count_if(fresh).alias("calls"), F.round(F.sum(F.when(fresh, F.coalesce("cost", F.lit(0.0))).otherwise(0.0)), 6).alias("cost"),
        F.count_if(F.col("called") & (F.col("verdict") == "pass")).alias("flips"),
    )


def page(rows: DataFrame, number: int, size: int = 20, order: str = "id") -> DataFrame:
    """One page in order, with the number of rows and pages. It counts and sorts the rows each time: page_after goes through many pages."""
    total = rows.count()
    pages = max(1, -(-total // size))
    counts = [F.lit(total).cast("long").alias("total_rows"), F.lit(pages).cast("long").alias("total_pages")]
    return rows.orderBy(order).offset((number - 1) * size).limit(size).select("*", *counts)


def page_after(rows: DataFrame, last=None, size: int = 20, order: str = "id") -> DataFrame:
    """The page that follows the key `last` (the first one if it is None), in order. Keys are distinct; the filter reaches the scan, and a task keeps its first `size` rows."""
    return (rows if last is None else rows.where(F.col(order) > F.lit(last))).orderBy(order).limit(size)


def english_first(lang: Column) -> Column:
    """Sort key: English rows before the others."""
    return F.when(F.lower(F.replace(F.coalesce(lang, F.lit("")), F.lit("_"), F.lit("-"))).startswith("en"), 0).otherwise(1)


def first_languages(rows: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """(keys, lang): the first languages in alphabetical order."""
    by = W.partitionBy(*keys).orderBy("lang")
    return rows.select(*keys, "lang").where("lang is not null").distinct().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n).drop("rank")


def result_documents(rows: DataFrame) -> DataFrame:
    """(id, document): each result as nested JSON with its reference scores."""
    doc = F.struct(
        "id", "image_name", "status", "reason",
        F.struct(F.col("confidence"), F.col("score_top1"), F.col("score_top2"), F.col("margin")).alias("reference"),
    )
    return rows.select("id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def engine_maps(readings: DataFrame) -> DataFrame:
    """(zone_id, engines): JSON map from engine to its text and confidence (4 places)."""
    entry = F.struct("engine", F.struct(F.col("text"), F.round("confidence", 4).alias("confidence")).alias("v"))
    by = readings.groupBy("zone_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    return by.select("zone_id", F.to_json("m", {"ignoreNullFields": "false"}).alias("engines"))


def engine_texts(readings: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """keys and a column for each engine: its texts that aren't empty, one a line."""
    texts = joined_text(readings, [*keys, "engine"], order=order)
    return texts.groupBy(*keys).pivot("engine", list(ENGINES)).agg(F.first("text")).na.fill("", list(ENGINES))


def rejected_paths(rows: DataFrame) -> DataFrame:
    """(image_name) of rejected results, in order."""
    return rows.where("decision = 'error' and image_name <> ''").select("image_name").orderBy("image_name")


def rejected_payloads(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    return rows.where("decision = 'error'").select("session_id", "image_name").distinct().join(payloads, ["session_id", "image_name"])


def progress(events: DataFrame) -> DataFrame:
    """(session_id, idx, done, percent) for (session_id, idx, total), in order of idx. A session that holds most rows is counted in many tasks."""
    ranked = with_ranks(events.select("session_id", "idx", "total"), ("session_id",), [F.col("idx")], "done")
    done = F.least(F.col("done") + 1, F.col("total"))
    percent = F.when(F.col("total") > 0, F.round(100 * done / F.col("total"))).otherwise(0)
    return ranked.select("session_id", "idx", done.alias("done"), percent.cast("long").alias("percent"))


def places(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place, from 1 within a session, English rows first and then in order."""
    ranked = with_ranks(rows, ("session_id",), [english_first(F.col("lang")), *order], "place")
    return ranked.withColumn("place", F.col("place") + 1)


def latest(rows: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The last row of each key: what an upsert leaves. Rows are combined before they are shuffled; of rows at the same time, a hash of the row settles which stays."""
    hashed = F.xxhash64(*[F.col(f.name) for f in rows.schema if "map<" not in f.dataType.simpleString()])
    last = F.max_by(F.struct(*rows.columns), F.struct(F.col(ts), hashed))
    return rows.groupBy(*keys).agg(last.alias("last_row")).select("last_row.*")
