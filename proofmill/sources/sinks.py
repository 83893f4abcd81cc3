"""Sinks: appended verdicts, merges by key, event rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmill.functions import geometry as G
from proofmill.operators.reports import latest

#: Partitions of a store of `merge`, and the beginning of their column's name.
BUCKETS = 16
_BUCKET = "bucket_of_"


def append_verdicts(rows: DataFrame, path: str) -> None:
    """Appends result rows, a folder for each session, so that a session's scan prunes to its own."""
    rows.write.mode("append").partitionBy("session_id").parquet(path)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _any_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any(f.isDirectory() for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at))


def merge(new: DataFrame, path: str, keys: list[str], ts: str = "ts", batch: int | None = None, buckets: int = BUCKETS) -> bool:
    """Merges rows into the store at `path`: the last row of each key by ts stays. Whether it did anything.

    Keys are hashed to `buckets` partitions; only those that hold a key of new
    are read and written again, by dynamic partition overwrite, so that the
    bytes written follow what a batch touches. A batch number is recorded once
    its rows are stored: a batch that is delivered again is skipped, and one
    that failed half-way is merged again, which gives the same rows. Equal times
    are settled by a hash of the row. One writer at a time. A store keeps the
    number of buckets that it began with: choose it so that a partition of the
    full store is a few hundred MB.
    """
    spark = new.sparkSession
    log = f"{path}.batches"
    if batch is not None and _exists(spark, log) and not spark.read.parquet(log).where(F.col("batch") == batch).isEmpty():
        return False
    if not _exists(spark, f"{path}.schema"):
        new.limit(0).write.mode("overwrite").parquet(f"{path}.schema")
    name = f"{_BUCKET}{buckets}"
    rows = latest(new, keys, ts).withColumn(name, _bucket(keys, buckets)).persist()
    touched = [r[0] for r in rows.select(name).distinct().collect()]
    if touched:
        both = rows
        if _exists(spark, path):
            stored = spark.read.parquet(path)
            if name not in stored.columns:
                raise ValueError(f"{path} has another number of buckets than {buckets}")
            both = stored.where(F.col(name).isin(touched)).unionByName(rows)
        # A bucket is written by one task; the rows of a key are in one bucket.
        merged_rows = latest(both, keys, ts).repartition(min(buckets, len(touched)), name)
        merged_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    rows.unpersist()
    if batch is not None:
        spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(log)
    return bool(touched)


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store of `merge`."""
    none = spark.read.parquet(f"{path}.schema")
    return spark.read.schema(none.schema).parquet(path).select(none.columns) if _exists(spark, path) else none


def write_pages(rows: DataFrame, path: str, order: str = "id") -> None:
    """Writes rows in order, for `read_page`: a folder for each range of the order, and an index of how many rows come before each range."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("page_at", F.monotonically_increasing_id())
    at = F.col("page_at")
    placed = placed.withColumn("page_range", F.shiftright(at, 33).cast("int")).withColumn("page_at", at.bitwiseAND((1 << 33) - 1))
    placed.write.partitionBy("page_range").parquet(f"{path}/rows")
    rows.limit(0).write.parquet(f"{path}/schema")
    if _any_folder(spark, f"{path}/rows"):
        counts = spark.read.parquet(f"{path}/rows").groupBy("page_range").agg(F.count("*").alias("n"))
    else:
        counts = spark.createDataFrame([], "page_range int, n long")
    # One row for each range: as many as the table was written by tasks.
    before = F.sum("n").over(W.orderBy("page_range").rowsBetween(W.unboundedPreceding, -1))
    counts.select("page_range", "n", F.coalesce(before, F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{path}/index")


def read_page(spark: SparkSession, path: str, number: int, size: int = 20) -> DataFrame:
    """Page `number`, from 1, of what write_pages wrote, with total_rows and total_pages: it reads the ranges that the page lies in and, by row groups, those rows only."""
    schema = spark.read.parquet(f"{path}/schema")
    index = spark.read.parquet(f"{path}/index")
    total = index.agg(F.max(F.col("before") + F.col("n"))).first()[0] or 0
    first, last = (number - 1) * size, number * size
    ranges = index.where((F.col("before") < last) & (F.col("before") + F.col("n") > first)).collect()
    counts = [F.lit(total).cast("long").alias("total_rows"), F.lit(max(1, -(-total // size))).cast("long").alias("total_pages")]
    if not ranges:
        return schema.select("*", *counts)
    stored = spark.read.parquet(f"{path}/rows")
    parts = [stored.where((F.col("page_range") == r.page_range) & F.col("page_at").between(first - r.before, last - 1 - r.before)) for r in ranges]
    return functools.reduce(DataFrame.unionByName, parts).orderBy("page_range", "page_at").select(*schema.columns, *counts)


def save_bucketed(rows: DataFrame, table: str, keys: tuple[str, ...] = ("session_id",), buckets: int = BUCKETS) -> DataFrame:
    """rows as a table of the catalogue whose rows of a key are in one bucket: scans of a key prune to it, roll-ups and joins by the keys need no exchange.

    Joins by more columns need none either where
    spark.sql.requireAllClusterKeysForCoPartition is false. A key that holds most
    rows is one bucket: such a table is better left to `merge` or folders.
    """
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return rows.sparkSession.table(table)


def event_rows(rows: DataFrame, event: str, ts: str, *fields: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, line): rows as JSON events with a UTC time."""
    return rows.select(*keys, F.to_json(F.struct(F.lit(event).alias("event"), G.iso_z(F.col(ts)).alias("ts_utc"), *fields)).alias("line"))


def session_results(results: DataFrame, session_id: str | None = None, hide_pass: bool = False) -> DataFrame:
    """One session's results, or those of all; the session is a partition of the table."""
    rows = results if session_id is None else results.where(F.col("session_id") == session_id)
    return rows.where("status <> 'PASS'") if hide_pass else rows


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)
