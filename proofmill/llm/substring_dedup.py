"""Substring dedup with a count-min prefilter.

A window is WINDOW consecutive words. A word goes if a window that covers it
has a word sequence that also starts in a document with a smaller id.

Pass 1 counts. Every window holds GRAMS grams of GRAM words; the least gram
hash stands for the window, so that equal windows have equal representatives
and a window's count is at most its representative's. Each partition sketches
its representatives, once for each document, in DEPTH rows of counters; Spark
sums the partitions' counters. A count-min estimate is never too low: windows
whose representative is estimated below 2 can't repeat, and no other is lost.
Counters grow with the text, eight for each representative. While a bitmap of
those at 2 or more is small it is broadcast; beyond that the representatives'
counters are joined with the repeated ones, both dealt out by counter.

Pass 2 looks exactly at the windows that are left. Windows in a row with one
representative are a segment. Equal segments (128-bit hashes) are grouped
first: where one also stands in a document with a smaller id, all its windows
go. What is left are the first copies of each segment. Only where a
representative has different segments can a window still repeat; there windows
are grouped one by one, by representative and window hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from proofmill.llm.common import row_key, written

WINDOW = 50
GRAM = 25
DEPTH = 2
MIN_BITS = 16
#: Up to 2**BROADCAST_BITS counters a sketch row, their bitmaps are broadcast: DEPTH / 8 bytes for each, 64 MB at most. Where that is less than two for each representative (above some 10 GB of text), larger sketches stay on the executors.
BROADCAST_BITS = 28
BLOCK_BITS = 20
#: Windows of a segment at most; longer ones are cut.
SEGMENT = 1024
#: Bytes of text for each representative, roughly.
_BYTES_PER_ANCHOR = 80
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


@cache
def _powers(factor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2**64."""
    up, down = np.full(size, factor, np.uint64), np.full(size, pow(factor, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(words: np.ndarray, n: int, factor: int) -> np.ndarray:
    """A hash of each n consecutive word hashes: a polynomial modulo 2**64, mixed."""
    size = 1 << max(10, len(words) - 1).bit_length()
    up, down = _powers(factor, size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return _mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def representatives(hashes: np.ndarray) -> np.ndarray:
    """The least gram hash of each window."""
    low = rolling(hashes, GRAM, _FACTORS[2])
    have, grams = 1, WINDOW - GRAM + 1
    while have < grams:
        step = min(have, grams - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def cells(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each value in each sketch row."""
    return [(_mix(values + np.uint64(row)) >> np.uint64(64 - bits)).astype(np.int64) for row in range(DEPTH)]


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, list[bytes]]]:
    for k, value in enumerate(batch.column(name)):
        raw = value.as_py()
        words = raw.split() if raw else []
        if len(words) >= WINDOW:
            yield k, words


def sketch(raw: DataFrame, bits: int) -> DataFrame:
    """(cell, n): the summed counters at 1 or more, sketch rows one after another; n stops at 2 in a partition's part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            seen = np.concatenate(held)
            for row, cell in enumerate(cells(seen, bits)):
                at, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at + (row << bits)), pa.array(np.minimum(n, 2).astype(np.int32))], ["cell", "n"])

        for batch in batches:
            for _, words in _texts(batch, "raw"):
                held.append(np.unique(representatives(word_hashes(words))))
                size += len(held[-1])
            if size > 1 << 21:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return raw.select("raw").mapInArrow(count, "cell long, n int").groupBy("cell").agg(F.sum("n").alias("n"))


def repeated_bitmap(raw: DataFrame, bits: int) -> np.ndarray:
    """A bit for each counter: whether it is at 2 or more. Built block by block on the executors; its size is fixed by bits."""
    block = min(bits, BLOCK_BITS)
    high = sketch(raw, bits).where("n >= 2").select(F.shiftright("cell", block).alias("block"), F.col("cell").bitwiseAND((1 << block) - 1).cast("int").alias("at"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << block, dtype=np.uint8)
        held[pdf["at"].to_numpy()] = 1
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bitmap": [np.packbits(held, bitorder="little").tobytes()]})

    packed = high.groupBy("block").applyInPandas(pack, "block long, bitmap binary").toArrow()
    bitmap = np.zeros((DEPTH << bits) // 8, dtype=np.uint8)
    width = (1 << block) // 8
    for k, part in zip(packed["block"].to_pylist(), packed["bitmap"], strict=True):
        bitmap[k * width : (k + 1) * width] = np.frombuffer(part.as_buffer(), dtype=np.uint8)
    return bitmap


def segment_hashes(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, factor: int) -> np.ndarray:
    """A hash of each stretch of word hashes, and of its length."""
    size = 1 << max(10, len(words) - 1).bit_length()
    up, down = _powers(factor, size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return _mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(_FACTORS[0]))


def repeated_cells(raw: DataFrame, bits: int) -> DataFrame:
    """(k_id, k_text, maybe): of each document, the first counters of its representatives whose counters are all at 2 or more.

    Representatives travel without text, by one counter after another; only those that pass one go on to the next.
    """
    names = [f"c{row}" for row in range(DEPTH)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, words in _texts(batch, "raw"):
                at = cells(np.unique(representatives(word_hashes(words))), bits)
                ids = [batch.column(c).take(pa.array(np.full(len(at[0]), k, np.int32))) for c in ("k_id", "k_text")]
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, at)], ["k_id", "k_text", *names])

    high = written(sketch(raw, bits).where("n >= 2").select("cell"), "repeat-cells")
    asked = raw.mapInArrow(ask, f"{_id_field(raw)}, k_text long, {', '.join(f'{c} long' for c in names)}")
    for row, name in enumerate(names):
        full = high.where(F.shiftright("cell", bits) == row).select((F.col("cell") - (row << bits)).alias(name))
        asked = asked.join(full.hint("merge"), name, "left_semi")
    return written(asked.groupBy("k_id", "k_text").agg(F.collect_set(names[0]).alias("maybe")), "repeat-maybe")


def _id_field(raw: DataFrame) -> str:
    fields = StructType([StructField("k_id", raw.schema["k_id"].dataType)]).simpleString()
    return fields[len("struct<") : -1].replace(":", " ", 1)


def candidate_segments(docs: DataFrame, bits: int, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """(k_id, k_text, start, n, anchor, s1, s2, windows): segments of n windows from word start that the sketch can't rule out."""
    raw = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.col("text").cast("binary").alias("raw")).where("k_id is not null")
    fields = _id_field(raw)
    shared = None
    if bits <= broadcast_bits:
        shared = docs.sparkSession.sparkContext.broadcast(repeated_bitmap(raw, bits))
    else:
        raw = raw.join(repeated_cells(raw, bits).hint("merge"), ["k_id", "k_text"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value if shared else None
        for batch in batches:
            for k, words in _texts(batch, "raw"):
                hashes = word_hashes(words)
                lows = representatives(hashes)
                edge = np.r_[True, lows[1:] != lows[:-1]]
                first = np.flatnonzero(edge)
                # Cuts of long segments count from the segment's start.
                length = np.diff(np.r_[first, len(lows)])
                if length.max() > SEGMENT:
                    offset = np.arange(len(lows)) - np.repeat(first, length)
                    first = np.flatnonzero(offset % SEGMENT == 0)
                    length = np.diff(np.r_[first, len(lows)])
                anchors = lows[first]
                if bitmap is None:
                    maybe = np.isin(cells(anchors, bits)[0], batch.column("maybe")[k].values.to_numpy())
                else:
                    maybe = np.ones(len(first), dtype=bool)
                    for row, cell in enumerate(cells(anchors, bits)):
                        at = cell + (row << bits)
                        maybe &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                first, length, anchors = first[maybe], length[maybe], anchors[maybe]
                if not len(first):
                    continue
                both = [pa.array(segment_hashes(hashes, first, first + length + WINDOW - 1, f).view(np.int64)) for f in _FACTORS[:2]]
                windows = rolling(hashes, WINDOW, _FACTORS[0])[_places(first, length)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(windows.view(np.int64)))
                ids = [batch.column(c).take(pa.array(np.full(len(first), k, np.int32))) for c in ("k_id", "k_text")]
                parts = [pa.array(first.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(anchors.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*ids, *parts, *both, lists], ["k_id", "k_text", "start", "n", "anchor", "s1", "s2", "windows"])

    return raw.mapInArrow(find, f"{fields}, k_text long, start int, n int, anchor long, s1 long, s2 long, windows array<long>")


def _places(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places from each first on, length of them."""
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first, length)


def repeated_windows(segments: DataFrame) -> DataFrame:
    """(k_id, k_text, start, n): stretches of windows that also start in a document with a smaller id."""
    # Groups are written before they are joined, so that a join deals out its own exchange and a hot
    # passage can be split; the joins are sort-merge joins at every size.
    groups = written(segments.groupBy("s1", "s2").agg(F.min("k_id").alias("least"), F.first("anchor").alias("anchor")), "repeat-groups")
    known = segments.join(groups.select("s1", "s2", "least").hint("merge"), ["s1", "s2"])
    whole = known.where("k_id > least").select("k_id", "k_text", "start", "n")
    mixed = written(groups.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeat-anchors")
    firsts = known.where("k_id = least").join(mixed.hint("merge"), "anchor", "left_semi")
    single = written(firsts.select("k_id", "k_text", "anchor", "start", F.posexplode("windows").alias("at", "window")), "repeat-windows")
    least = single.groupBy("anchor", "window").agg(F.min("k_id").alias("least"), F.max("k_id").alias("most")).where("least < most")
    least = written(least.drop("most"), "repeat-least")
    one = single.join(least.hint("merge"), ["anchor", "window"]).where("k_id > least").select("k_id", "k_text", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n"))
    return whole.unionByName(one)


def remove_repeats(docs: DataFrame, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, text), a row for each row of docs.

    text holds the words that stay, joined by one space. A null text has no
    words. Rows with the same id don't take words from each other; rows with a
    null id neither take nor lose any. Windows are judged on the input.
    """
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(MIN_BITS, math.ceil(math.log2(8 * volume / _BYTES_PER_ANCHOR + 1)))
    # Two counters for each representative still rule out four in five of the windows that don't repeat: that costs less than the joins.
    if bits <= broadcast_bits + 2:
        bits = min(bits, broadcast_bits)
    gone = repeated_windows(written(candidate_segments(docs, bits, broadcast_bits), "repeat-segments"))
    gone = gone.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    base = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.col("text").cast("binary").alias("raw"))
    both = base.alias("d").join(gone.alias("x"), F.col("d.k_id").eqNullSafe(F.col("x.k_id")) & (F.col("d.k_text") == F.col("x.k_text")), "left")
    cut = both.select(F.col("d.k_id").alias("doc_id"), _cut(F.col("d.raw"), F.col("x.gone")).alias("c"))
    return cut.select("doc_id", "c.n_words", "c.n_removed", "c.text")


@F.arrow_udf(StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("text", StringType())]))
def _cut(raws: pa.Array, gone: pa.Array) -> pa.Array:
    n_words, n_removed, texts = [], [], []
    for raw, at in zip(raws, gone, strict=True):
        words = raw.as_py().split() if raw.is_valid else []
        n = len(words)
        if at.is_valid:
            edges = np.zeros(n + WINDOW + 1, dtype=np.int32)
            first, length = (at.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            np.add.at(edges, first, 1)
            np.add.at(edges, first + length + WINDOW - 1, -1)
            keep = np.cumsum(edges[:n]) == 0
            words = [w for w, stays in zip(words, keep.tolist(), strict=True) if stays]
        n_words.append(n)
        n_removed.append(n - len(words))
        texts.append(b" ".join(words).decode())
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], ["n_words", "n_removed", "text"])
