"""Ranks within keys of which one may hold most rows: no task holds a key.

Rows are dealt out by ranges of (keys, order) and sorted there, which splits a
hot key over as many ranges as it needs. A row's rank is its place in its range
plus what its key has in earlier ranges; only keys that reach over a range's
end have such, two for each range at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmill.sources.shared import written


def with_ranks(rows: DataFrame, keys: tuple[str, ...], order: list[Column], name: str = "rank") -> DataFrame:
    """rows with `name`, the place of each from 0 among the rows of its keys in order; null keys are keys.

    Rows alike in all of order may come in either order, once: the ranges are
    written before they are counted, so that a lost task doesn't change ranks.
    """
    columns = rows.columns
    flat = rows.select(*(F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)), *(o.alias(f"o_{i}") for i, o in enumerate(order)), F.struct("*").alias("row"))
    key = [f"k_{i}" for i in range(len(keys))]
    by = [*key, *(f"o_{i}" for i in range(len(order)))]
    # The number of a row's partition is in the upper bits of this id, its place in the lower ones.
    placed = flat.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("nth", F.monotonically_increasing_id())
    placed = written(placed.select(*key, "row", "nth"), "ranks").withColumn("range", F.shiftright("nth", 33).cast("int"))
    counts = placed.groupBy(*key, "range").agg(F.count("*").alias("n"))
    earlier = W.partitionBy(*key).orderBy("range")
    before = counts.withColumn("before", F.sum("n").over(earlier.rowsBetween(W.unboundedPreceding, -1))).where("before is not null")
    before = before.select(*(F.col(k).alias(f"b_{k}") for k in key), F.col("range").alias("b_range"), "before")
    inside = placed.withColumn("at", F.row_number().over(W.partitionBy(*key, "range").orderBy("nth")) - 1)
    # One row at most for each range: only its first key can have begun in an earlier one.
    on = [F.col("range") == F.col("b_range"), *(F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in key)]
    both = inside.join(F.broadcast(before), on, "left")
    return both.select(*(F.col(f"row.`{c}`").alias(c) for c in columns), (F.col("at") + F.coalesce("before", F.lit(0))).cast("long").alias(name))
