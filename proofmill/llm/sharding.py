"""Sharding by proportional stratified interleaving, in DataFrame functions.

Rows are ranked in a seeded random order within their source; a row's
fractional rank is (rank + the source's offset) / rows of the source, with a
seeded offset between 0 and 1. Sorted by fractional rank, every stretch of the table holds the sources in the mixture's
proportions, so that cutting it into equal counts gives shards that match it.

A rank within a hot source, and the place in the whole order, are both found
in two steps (counts of buckets, then ranks within a bucket), so that no task
holds a source or the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmill.llm.common import written

SEED = 17
#: Rows that a bucket of an order should hold: one task ranks a bucket.
BUCKET_ROWS = 50_000


def _buckets(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """rows with `name`, the rank from 0 within group by (bucket, order); `bucket` cuts the order into ranges. Buckets are counted first, so that prefix sums go over numbers of buckets."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("b_n"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*group, bucket, F.coalesce(F.sum("b_n").over(before), F.lit(0)).alias("b_before"))
    within = W.partitionBy(*group, bucket).orderBy(*order)
    on = rows.alias("l").join(offsets.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, bucket]])
    on = on.select("l.*", "r.b_before")
    return on.withColumn(name, F.row_number().over(within) - 1 + F.col("b_before")).drop("b_before")


def interleave(docs: DataFrame, shards: int = 16, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, source, rank) and the columns `carry`, a row for each row of docs.

    Counts of shards are at most one apart; slots of a shard run from 0 without
    gaps. A null source is a source of its own; a null text has the bytes of an
    empty one. Rows that are alike in all columns that the order reads may
    change places, which changes no result. An empty table gives no rows.

    The numbers of buckets follow from the number of rows. Within a source
    they are ranges of the seeded hash, in the whole order ranges of the
    fractional rank. Rows that repeat id, source and text share a bucket.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = written(
        docs.select(
            F.col("doc_id").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            (F.length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(F.lit(seed), F.col("doc_id"), raw).alias("h"),
            *carry,
        ),
        "shard-rows",
    )
    total = rows.count()
    rows = rows.withColumn("h_bucket", (F.shiftrightunsigned("h", 32) * _buckets(total) / F.lit(1 << 32)).cast("int"))
    # Unsigned, as the buckets are.
    order = [F.shiftrightunsigned("h", 1), F.col("h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = _ranked(rows, ["source"], "h_bucket", order, "rank")
    totals = rows.groupBy("source").agg(F.count("*").alias("n"))
    placed = ranked.alias("l").join(totals.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", "r.n")
    # Each source has an offset of its own, so that sources of few rows, whose ranks are alike, spread over the order.
    offset = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "source"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    fraction = (F.col("rank") + offset) / F.col("n")
    placed = placed.withColumn("fraction", fraction).withColumn("place_bucket", F.floor(fraction * _buckets(total)).cast("int"))
    placed = written(placed.select("doc_id", "source", "size", "text_crc32", "h", "rank", "fraction", "place_bucket", *carry), "shard-ranks")
    order = [F.col("fraction"), F.col("source"), F.col("h"), F.col("doc_id"), F.col("text_crc32")]
    at = _ranked(placed, [], "place_bucket", order, "place")
    # Shard s holds places ceil(s * N / shards) to the next such bound.
    at = at.withColumn("shard", F.expr(f"cast((place * {shards}) div {max(total, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return at.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - first).cast("long").alias("slot"), "source", F.col("rank").cast("long").alias("rank"), *carry)


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """The rows of docs with shard and slot; columns of docs that have these names, in any case, are replaced."""
    kept = [f"row.`{c}`" for c in docs.columns if c.lower() not in ("shard", "slot")]
    base = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), "shard-input")
    keyed = base.select("rid", "row.doc_id", "row.source", "row.text")
    places = interleave(keyed, shards, seed, ("rid",)).select("rid", "shard", "slot")
    return base.join(places, "rid").select(*kept, "shard", "slot")
