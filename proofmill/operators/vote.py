"""Majority voting between several readings of a zone.

One shuffle on the zone: readings are first grouped by (zone, normalised
text), then the groups of a zone are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.functions import text as T


def majority_vote(readings: DataFrame, keys: tuple[str, ...] = ("zone_id",), drop_empty: bool = False) -> DataFrame:
    """(keys, engine, text, rule, status, reason, n_readings, n_valid) for (keys, engine, text, error).

    Readings with an error don't vote. The largest group of at least two equal
    normalised texts wins, ties by the smaller text; its smallest engine name
    speaks. Without such a group the longest reading is taken, for a person to
    look at. drop_empty leaves empty readings out altogether.
    """
    keys_ = list(keys)
    rows = readings.select(*keys_, "engine", F.coalesce("text", F.lit("")).alias("text"), "error")
    if drop_empty:
        rows = rows.where(F.trim("text") != "")
    rows = rows.withColumn("norm", F.when(F.col("error").isNull(), T.normalize("text", "consensus"))).repartition(*keys_)
    speaker = F.min(F.when(F.col("error").isNull(), F.struct("engine", "text")))
    longest = F.min(F.when(F.col("error").isNull(), F.struct((-F.length("norm")).alias("n"), "text", "engine")))
    groups = rows.groupBy(*keys_, "norm").agg(F.count("*").alias("n"), speaker.alias("speaker"), longest.alias("longest"))
    valid = F.col("norm").isNotNull()
    zones = groups.groupBy(*keys_).agg(
        F.sum("n").alias("n_readings"),
        F.sum(F.when(valid, F.col("n")).otherwise(0)).alias("n_valid"),
        F.min(F.when(valid, F.struct((-F.col("n")).alias("size"), "norm", "speaker"))).alias("best"),
        F.min("longest").alias("longest"),
    )
    agreed = F.col("best.size") <= -2
    some = F.col("n_valid") > 0
    return zones.select(
        *keys_,
        F.when(agreed, F.col("best.speaker.engine")).otherwise(F.col("longest.engine")).alias("engine"),
        F.when(agreed, F.col("best.speaker.text")).otherwise(F.col("longest.text")).alias("text"),
        F.when(agreed, F.when(F.col("n_readings") >= 3, "majority_2_of_3").otherwise("match_2")).when(some, "no_confidence_fallback").alias("rule"),
        F.when(agreed, "OK").otherwise("MANUAL").alias("status"),
        F.when(~some, "all_engines_failed").when(~F.coalesce(agreed, F.lit(False)), "no_consensus").alias("reason"),
        "n_readings",
        "n_valid",
    )


def zone_votes(zones: DataFrame, readings: DataFrame) -> DataFrame:
    """The vote of every zone of (zone_id, engines): zones without engines, and without readings, have their own reasons. Readings of engines that a zone doesn't name don't count."""
    asked = zones.select("zone_id", F.explode_outer("engines").alias("engine"))
    heard = asked.where("engine is not null").join(readings.select("zone_id", "engine", "text", "error"), ["zone_id", "engine"], "left")
    heard = reading_status(heard)
    votes = majority_vote(heard)
    none = zones.where(F.coalesce(F.size("engines"), F.lit(0)) <= 0).select("zone_id").distinct()
    missing = none.select("zone_id", *[F.lit(None).cast("string").alias(c) for c in ("engine", "text", "rule")], F.lit("MANUAL").alias("status"), F.lit("no_engines_configured").alias("reason"), F.lit(0).cast("long").alias("n_readings"), F.lit(0).cast("long").alias("n_valid"))
    return votes.unionByName(missing)


def reading_status(rows: DataFrame) -> DataFrame:
    """Readings that never came, or came without text or error, get an error."""
    error = F.coalesce("error", F.when(F.col("text").isNull(), "engine_no_result"))
    return rows.withColumn("error", error).withColumn("text", F.coalesce("text", F.lit("")))


def disagreement(votes: DataFrame) -> DataFrame:
    """votes with engines_disagree: at least two readings, and no two alike."""
    flag = (F.col("rule") == "no_confidence_fallback") & (F.col("n_valid") >= 2)
    return votes.withColumn("engines_disagree", F.coalesce(flag, F.lit(False)))


def best_by_confidence(readings: DataFrame) -> DataFrame:
    """(zone_id, engine, confidence): the reading with the highest confidence, none counting as -1; ties by the smaller engine."""
    c = F.coalesce(F.col("confidence"), F.lit(-1.0))
    best = F.min(F.struct((-c).alias("c"), "engine", "confidence")).alias("b")
    return readings.groupBy("zone_id").agg(best).select("zone_id", "b.engine", "b.confidence")
