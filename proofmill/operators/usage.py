"""Monthly counters of engine calls and of the judge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.config import ENGINES
from proofmill.functions import geometry as G


def engine_usage(events: DataFrame, delta: str = "delta") -> DataFrame:
    """(month, google, azure, ocrspace) for (ts, engine, delta): unknown engines and deltas from 0 down don't count; a month without an engine's calls has 0."""
    known = events.where(F.col("engine").isin(*ENGINES) & (F.col(delta) > 0))
    counts = known.groupBy(G.month_id(F.col("ts")).alias("month")).pivot("engine", list(ENGINES)).agg(F.sum(delta))
    return counts.na.fill(0, list(ENGINES))


def month_usage(usage: DataFrame, months: DataFrame) -> DataFrame:
    """usage of the months asked for (month, first_day), zeros where there is none, with a label."""
    both = months.join(usage, "month", "left").na.fill(0, list(ENGINES))
    return both.select("month", G.month_label(F.col("first_day")).alias("label"), *ENGINES)


def judge_usage(events: DataFrame) -> DataFrame:
    """(month, calls, cost) for (ts, delta, cost): a null or negative cost counts as 0."""
    cost = F.greatest(F.coalesce("cost", F.lit(0.0)), F.lit(0.0))
    return events.where("delta > 0").groupBy(G.month_id(F.col("ts")).alias("month")).agg(F.sum("delta").alias("calls"), F.round(F.sum(cost), 6).alias("cost"))
