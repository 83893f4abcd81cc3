"""Helpers that the operators of this subpackage share.

Every operator works on a narrow projection of the columns it needs, so extra
columns of an input table, whatever they are called, never meet its own names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.sources.shared import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Space and U+0009 to U+000D, as characters and as a regular expression.
SPACES = " \t\n\x0b\f\r"
SPACES_RE = r"[\x20\x09-\x0D]+"


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, *, codec: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage ends there.

    A lost executor costs only its running tasks; what is written is read again,
    never computed a second time. Results read such tables when they are asked
    for, so they stay until `forget` or `clear`.
    """
    spark = df.sparkSession
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(table: DataFrame) -> None:
    """Deletes a table of `written` that nothing reads any more."""
    _delete(table.sparkSession, table._written_to)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written: for sessions that live on, once their results are stored."""
    _delete(spark, _home(spark))


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of driver values as JVM expressions, without a Python RDD."""
    names = [part.split()[0] for part in schema.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    one = spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{schema_of(schema)}>>")).alias("r"))
    return one.select("r.*")


def schema_of(schema: str) -> str:
    return ",".join("{}:{}".format(*part.split()) for part in schema.split(","))


def parts_of(batch: pa.RecordBatch, name: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes in column `name`, so that a task holds what it makes of one part; a longer text is a part of its own."""
    sizes = np.array([len(x) if (x := raw.as_buffer()) is not None else 0 for raw in batch.column(name)], dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. ASCII texts take the built-in lower, which is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns that tell the documents apart: the id and a hash of the text.

    Rows that repeat an id with another text are documents of their own.
    """
    return [doc_id.alias("k_id"), F.xxhash64(text).alias("k_text")]
