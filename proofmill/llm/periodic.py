"""Runs of repeated words, found through string synchronising sets.

A run is a longest stretch of words with smallest period q that holds q three
times at least, and MIN_WORDS words. Documents of a batch are laid end to end,
with a word of its own behind each, so that no run crosses.

Periods from SMALL on come from dyadic scales. At scale m, with t = m / 2, a
place is selected if, of all t-word contexts that start within the next t
places, the one with the least hash is its own or the last one. Contexts in
highly periodic regions (a period of t / 3 at most) are left out of this: there
hashes of neighbours tie, and places would be many. Selection depends on 2t
words only, so equal contexts are selected alike, and within any t places one is
selected unless they lie in such a region. In a run of period q, with m <= q <
2m, follow these: a selected place comes early enough that it and the place q
words behind have the run's words as context, 3t of them for q <= 3t and 4t
above; both are selected; and no place between has that context, since 3t (4t)
words of period q have no smaller period. So the pair of each selected place and
the next one with an equal context proposes q. Proposed periods are grown word by
word to their longest stretch.

Periods under SMALL are found directly, by comparing each word with the one q
places on. They and the runs of earlier scales are the highly periodic regions
that later scales leave out, and supply the periods that these omit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from proofmill.llm.common import parts_of

#: Words and periods that a run has at least.
MIN_WORDS = 24
MIN_PERIODS = 3
#: Periods below it are found by comparing neighbours; the first scale.
SMALL = 8
#: Words that are laid end to end at once; a longer text is one lay.
_LAY = 1 << 16
_STEP = 64

RUN = "struct<start:long,length:long,period:long>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order. Mixed at every doubling, it has no periodic weakness, unlike a polynomial modulo 2**64."""
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + _mix(b + np.uint64(0xD6E8FEB86659FD93)))


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row, from minima of blocks seen from either end."""
    full = np.full(-(-len(values) // n) * n, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    blocks = full.reshape(-1, n)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - n + 1], ahead[n - 1 : len(values)])


def _agreeing(words: np.ndarray, at: int, gap: int, step: int) -> int:
    """How many places on from `at`, in direction step, hold the same word as the place gap words on."""
    done, reach = 0, _STEP
    while True:
        if step > 0:
            far = min(at + done + reach, len(words) - gap)
            near = at + done
            same = words[near:far] == words[near + gap : far + gap]
        else:
            far = max(at - done - reach + 1, 0)
            near = at - done + 1
            same = (words[far:near] == words[far + gap : near + gap])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done += len(same)
        if len(same) < reach:
            return done
        reach *= 2


def _has_smaller(words: np.ndarray, start: int, period: int) -> bool:
    """Whether the first `period` words repeat a shorter word sequence; a stretch of period q, three long, then has that period."""
    root = words[start : start + period]
    left, prime = period, 2
    while left > 1:
        if left % prime == 0:
            q = period // prime
            if (root[q:] == root[:-q]).all():
                return True
            while left % prime == 0:
                left //= prime
        prime = prime + 1 if prime * prime <= left else max(left, prime + 1)
    return False


def _selected(hashes: np.ndarray, t: int, regions: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the synchronising set of scale t, from the hashes of all t-word contexts."""
    none = np.iinfo(np.uint64).max
    ids = np.where(hashes == none, none - np.uint64(1), hashes)
    for start, length, period in regions:
        if 3 * period <= t <= length:
            ids[start : start + length - t + 1] = none
    if len(ids) <= t:
        return np.zeros(0, dtype=np.int64)
    low = _least(ids, t + 1)
    n = len(low)
    return np.flatnonzero((low != none) & ((low == ids[:n]) | (low == ids[t : t + n])))


def _proposals(hashes: np.ndarray, at: np.ndarray, t: int) -> Iterator[tuple[int, int]]:
    """(place, period) of each selected place and the next one with an equal context: of 3t words for periods from 2t to 3t, of 4t up to 4t."""
    for parts, low, high in ((3, 2 * t, 3 * t), (4, 3 * t + 1, 4 * t - 1)):
        places = at[at + parts * t <= len(hashes) + t - 1]
        context = hashes[places]
        for k in range(1, parts):
            context = _pair(context, hashes[places + k * t])
        order = np.argsort(context, kind="stable")
        gaps = np.diff(places[order])
        found = np.flatnonzero((np.diff(context[order]) == 0) & (gaps >= low) & (gaps <= high))
        yield from sorted(zip(places[order][found].tolist(), gaps[found].tolist()), key=lambda x: (x[1], x[0]))


def find_runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in numbered words, in order of start and period; no text in them has more than `longest` words.

    Equal numbers are equal words. Between texts stand numbers that occur once.
    """
    regions: list[tuple[int, int, int]] = []
    for q in range(1, min(SMALL - 1, longest // MIN_PERIODS) + 1):
        same = np.flatnonzero(np.diff(np.r_[False, words[q:] == words[:-q], False].astype(np.int8)))
        starts, sizes = same[::2], same[1::2] - same[::2] + q
        for k in np.flatnonzero(sizes >= MIN_PERIODS * q).tolist():
            if not _has_smaller(words, int(starts[k]), q):
                regions.append((int(starts[k]), int(sizes[k]), q))
    m = SMALL
    hashes = _mix(words.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    t = 1
    while MIN_PERIODS * m <= longest:
        while 2 * t < m:
            hashes = _pair(hashes[:-t], hashes[t:])
            t *= 2
        found, ends = [], {}
        for place, period in _proposals(hashes, _selected(hashes, t, regions), t):
            if place < ends.get(period, 0):
                continue
            start = place - _agreeing(words, place - 1, period, -1)
            end = place + _agreeing(words, place, period, 1) + period
            ends[period] = end - period
            if end - start >= max(MIN_WORDS, MIN_PERIODS * period) and not _has_smaller(words, start, period):
                found.append((start, end - start, period))
        regions += found
        m *= 2
    return sorted({r for r in regions if r[1] >= MIN_WORDS}, key=lambda r: (r[0], r[2]))


def _lays(texts: list[list[bytes]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(text numbers, numbered words end to end, first place of each): texts of alike length together, so that a long one doesn't bring its scales to short ones."""
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    at = 0
    while at < len(order):
        size, stop = 0, at
        while stop < len(order) and (stop == at or size + len(texts[order[stop]]) <= _LAY):
            size += len(texts[order[stop]]) + 1
            stop += 1
        numbers: dict[bytes, int] = {}
        numbered = np.empty(size, dtype=np.int64)
        firsts, put = [], 0
        for nth, k in enumerate(order[at:stop]):
            firsts.append(put)
            n = len(texts[k])
            numbered[put : put + n] = [numbers.setdefault(w, len(numbers)) for w in texts[k]]
            numbered[put + n] = -1 - nth
            put += n + 1
        yield order[at:stop], numbered, np.array(firsts)
        at = stop


def _runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, from its first word."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for members, words, firsts in _lays(texts):
        longest = len(texts[members[-1]])
        if longest < MIN_WORDS:
            continue
        for start, length, period in find_runs(words, longest):
            k = int(np.searchsorted(firsts, start, "right")) - 1
            runs[members[k]].append((start - int(firsts[k]), length, period))
    return runs


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if runs:
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        keep = np.cumsum(edges[:-1]) == 0
        words = [w for w, stays in zip(words, keep.tolist(), strict=True) if stays]
    return b" ".join(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, text), a row for each row of docs (doc_id, text).

    runs is an array of (start, length, period) in words from 0, by start, then
    period; text is what is left when each run keeps its first period only, the
    words joined by one space. Words are what white space (space, U+0009 to
    U+000D) separates; their bytes count, so texts needn't be valid UTF-8. A
    null or blank text has no words, no runs and an empty text. Repeated rows
    and null ids are rows like others. A text is looked at as a whole, in time
    n log n, whatever its length.
    """
    key = StructType([StructField("doc_id", docs.schema["doc_id"].dataType)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts_of(whole, "raw"):
                texts = [raw.as_py().split() if raw.is_valid else [] for raw in batch.column("raw")]
                runs = _runs_of(texts)
                flat = [np.array([r[k] for of in runs for r in of], dtype=np.int64) for k in range(3)]
                ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(x) for x in flat], ["start", "length", "period"])
                left = pa.array([_collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary())
                counts = pa.array([len(w) for w in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.ListArray.from_arrays(pa.array(ends), spans), left], ["doc_id", "n_words", "runs", "raw"])

    fields = key.simpleString()[len("struct<") : -1].replace(":", " ", 1)
    found = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("binary").alias("raw")).mapInArrow(find, f"{fields}, n_words long, runs array<{RUN}>, raw binary")
    return found.select("doc_id", "n_words", "runs", F.col("raw").cast("string").alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first by start, then period. Null without runs."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast(RUN), better)
