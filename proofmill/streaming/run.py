"""Running streams over tables of files, with exactly one result for each micro-batch."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from proofmill.sources import sinks
from proofmill.sources.shared import shared_dir


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files of a table as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # A stream reads folders: this one's other files are filtered out.
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def new_home(spark: SparkSession, name: str) -> str:
    """A folder for a stream's checkpoint and output. A stream that is started again with the folder it had goes on where it stopped."""
    return f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def _stateful(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB on the executors, with its changes in the checkpoint, and not in their heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def appended(stream: DataFrame, name: str, home: str | None = None) -> DataFrame:
    """What an append-mode stream has written once it has read all there is."""
    spark = stream.sparkSession
    _stateful(spark)
    home = home or new_home(spark, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/state").option("path", f"{home}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def updated(stream: DataFrame, keys: list[str], name: str, transform=None, mode: str = "update", home: str | None = None) -> DataFrame:
    """The last state of each key of an update-mode stream; transform is applied to each micro-batch.

    Micro-batches are merged into a store by key, each once: one that is run
    again after a failure changes nothing, and only partitions that a batch
    touches are rewritten. Without keys each micro-batch has a folder of its own.
    """
    spark = stream.sparkSession
    _stateful(spark)
    home = home or new_home(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch) if transform else batch
        if keys:
            sinks.merge(rows.withColumn("batch", F.lit(number).cast("long")), f"{home}/out", keys, "batch", number)
        else:
            rows.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return sinks.merged(spark, f"{home}/out") if keys else spark.read.option("basePath", f"{home}/out").parquet(f"{home}/out/batch=*")


class BatchCounts(StreamingQueryListener):
    """What happened to the rows of each micro-batch: kept here as streams report it, one entry for each."""

    def __init__(self) -> None:
        self.batches: list[tuple] = []
        self._open = 0
        self._ended = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self._ended:
            self._open += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get("input")
        operators = p.stateOperators
        late = sum(op.numRowsDroppedByWatermark for op in operators)
        out = sum(int(op.customMetrics.get("numExpiredTimers", 0)) for op in operators)
        self.batches.append((str(p.id), p.batchId, p.eventTime.get("watermark"), seen["rows"] if seen else 0, seen["untimed"] if seen else 0, late, out))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._ended:
            self._open -= 1
            self._ended.notify_all()

    def table(self, spark: SparkSession, wait: float = 60.0) -> DataFrame:
        """(query, batch, watermark, rows, untimed, late, timed_out): a row for each micro-batch of the streams that have ended."""
        with self._ended:
            self._ended.wait_for(lambda: self._open <= 0, wait)
        return spark.createDataFrame(self.batches, "query string, batch long, watermark string, rows long, untimed long, late long, timed_out long")


def counted(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """A stream whose rows, and those without a time, are counted in each micro-batch; to be put before its watermark."""
    return stream.observe("input", F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ts).isNull()).alias("untimed"))


@contextmanager
def counting(spark: SparkSession) -> Iterator[BatchCounts]:
    """Listens to the streams that are started within: rows that came, came late and were dropped, and keys whose time ran out."""
    listener = BatchCounts()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)
