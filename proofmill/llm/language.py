"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters other than letters count as spaces, letters are lower-cased. Around
each letter stand a unigram, a bigram with what follows and a trigram with both
neighbours; each is hashed to a bucket, unigrams to buckets of their own.
Counts per language are summed by Spark. A bucket's probability in a language is
its share of the language's n-grams, mixed with a floor that is the same for all
languages: the matrix holds log-probabilities relative to that floor, so that an
n-gram no language was seen with is 0 everywhere and speaks for none of them.
The matrix is broadcast in blocks of BLOCK languages, and batches of whole texts
are scored in numpy by gathering the rows of their n-grams, one block after
another: driver and workers hold one block at a time, however many languages
there are.

The score is no posterior of the whole text, which is 1 for all but the shortest
texts: it is the posterior that EVIDENCE letters of the text's average evidence
give, times the share of letters that some language was seen with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import written

#: Buckets of unigrams, and of bigrams and trigrams.
LETTER_BUCKETS = 1 << 14
PAIR_BUCKETS = 1 << 16
BUCKETS = LETTER_BUCKETS + PAIR_BUCKETS
#: The part of a language's probability that is spread over all buckets alike.
FLOOR = 0.01
#: Languages of a block of the matrix, 42 MB.
BLOCK = 128
#: Letters whose evidence the score weighs.
EVIDENCE = 4
#: Expected number of documents that a language is learned from; all of them if it has fewer.
TRAIN_DOCS = 5_000
#: Below this score a text's language counts as unknown. Unseen letters score near 0; clean texts that mix learned languages don't.
MIN_SCORE = 0.1
UNKNOWN = "und"
_SLICE = 1 << 18
#: Log-probabilities that are gathered at once.
_CELLS = 1 << 22
#: Texts that are scored at once.
_TEXTS = 10_000


@cache
def _letters() -> np.ndarray:
    """Code point -> lower-cased letter, or a space."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for code in range(0x110000):
        ch = chr(code)
        if ch.isalpha():
            low = ch.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, text number of each) in slices with a space, or the neighbour, on either side."""
    codes, owners, held = [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        whole = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        for at in range(0, len(whole), _SLICE):
            piece = whole[max(0, at - 1) : at + _SLICE + 1]
            # The outer characters of a slice are neighbours only: their owner is -1.
            own = np.full(len(piece), k, dtype=np.int32)
            if at:
                own[0] = -1
            if at + _SLICE < len(whole):
                own[-1] = -1
            codes += [piece, _SPACE]
            owners += [own, _NOBODY]
            held += len(piece)
            if held >= _SLICE:
                yield np.concatenate([_SPACE, *codes]), np.concatenate([_NOBODY, *owners])
                codes, owners, held = [], [], 0
    if codes:
        yield np.concatenate([_SPACE, *codes]), np.concatenate([_NOBODY, *owners])


_SPACE = np.array([32], dtype=np.uint32)
_NOBODY = np.array([-1], dtype=np.int32)


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets of shape (3, letters), text number of each letter), slice by slice."""
    for codes, owner in _slices(texts):
        at = np.flatnonzero((codes != 32) & (owner >= 0))
        if len(at):
            mid = codes[at]
            two = mid * np.uint32(0x9E3779B1) + codes[at + 1] * np.uint32(0x85EBCA6B)
            three = two + codes[at - 1] * np.uint32(0xC2B2AE35)
            mixed = np.stack([mid * np.uint32(0x27D4EB2F) + np.uint32(1), two + np.uint32(2), three + np.uint32(3)])
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            mixed[0] >>= np.uint32(18)
            mixed[1:] >>= np.uint32(16)
            mixed[1:] += np.uint32(LETTER_BUCKETS)
            yield mixed, owner[at]


@dataclass(frozen=True)
class Model:
    """Languages in code-point order, their log priors, whether some language was seen with the letters of a bucket, and broadcast blocks of (buckets, languages) log-probabilities relative to the floor."""

    languages: tuple[str, ...]
    priors: np.ndarray
    seen: np.ndarray
    blocks: tuple[Broadcast, ...]

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score) of each text; number -1 without a letter or a language."""
        letters, known = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, owner in grams(texts):
            first, ids = _stretches(owner)
            letters[ids] += np.diff(np.r_[first, len(owner)])
            known[ids] += np.add.reduceat(self.seen[buckets[0]], first, dtype=np.int64)
        if not self.blocks:
            return np.full(len(texts), -1), np.zeros(len(texts))
        weight = np.minimum(1.0, EVIDENCE / np.maximum(letters, 1.0))
        best, top, tempered_top = np.full(len(texts), -1), np.full(len(texts), -np.inf), np.zeros(len(texts))
        # The tempered evidence of all languages, as exp(high) * mass.
        high, mass = np.full(len(texts), -np.inf), np.zeros(len(texts))
        start = 0
        for block in self.blocks:
            matrix = block.value
            total = evidence(matrix, texts)
            if len(self.blocks) > 1:
                # A worker keeps one block; the others are read again from the executor's disk.
                vars(block).pop("_value", None)
            priors = self.priors[start : start + matrix.shape[1]]
            whole, tempered = total + priors, total * weight[:, None] + priors
            at = whole.argmax(axis=1)
            rows = np.arange(len(texts))
            better = whole[rows, at] > top
            best, tempered_top = np.where(better, at + start, best), np.where(better, tempered[rows, at], tempered_top)
            top = np.where(better, whole[rows, at], top)
            peak = np.maximum(high, tempered.max(axis=1))
            mass = mass * np.exp(high - peak) + np.exp(tempered - peak[:, None]).sum(axis=1)
            high = peak
            start += matrix.shape[1]
        posterior = np.exp(np.maximum(tempered_top - high, -700.0)) / mass
        return np.where(letters > 0, best, -1), posterior * known / np.maximum(letters, 1.0)


def _stretches(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first letter, text number) of each stretch of letters of one text."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return first, owner[first]


def evidence(matrix: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """The summed log-probabilities of each text in each language of a block; letters are gathered in parts whose size follows from the languages."""
    total = np.zeros((len(texts), matrix.shape[1]))
    step = max(256, _CELLS // max(matrix.shape[1], 1))
    for buckets, owner in grams(texts):
        for at in range(0, len(owner), step):
            first, ids = _stretches(owner[at : at + step])
            for order in buckets[:, at : at + step]:
                total[ids] += np.add.reduceat(matrix[order], first, axis=0, dtype=np.float64)
    return total


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities relative to the floor from one language's counts of buckets, of which one at least isn't 0."""
    return np.log1p(counts / counts.sum() * ((1 - FLOOR) * BUCKETS / FLOOR)).astype(np.float32)


def train(labelled: DataFrame, max_docs: int = TRAIN_DOCS, block: int = BLOCK) -> Model:
    """A model from (lang, key, text).

    Languages with more than max_docs rows learn from a sample that holds about
    max_docs of them, seeded by key. All languages are learned but those whose
    sample has no letter. Priors are the languages' shares of the rows that have
    a text. A language's counts become its column of the matrix on an executor;
    the driver puts `block` columns together at a time.
    """
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "key", "text")
    totals = written(rows.groupBy("lang").agg(F.count("*").alias("total")), "language-totals")
    share = totals.select("lang", F.least(F.lit(1.0), F.lit(float(max_docs)) / F.col("total")).alias("share"))
    sample = rows.join(share, "lang").where(F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, held in sums.items():
                at = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])], ["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                held = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for buckets, _ in grams(texts):
                    held += np.bincount(buckets.ravel(), minlength=BUCKETS)
                if len(sums) > block:
                    yield from flush()
        yield from flush()

    def column(counts: pa.Table) -> pa.Table:
        held = np.zeros(BUCKETS)
        held[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
        return pa.table({"lang": counts["lang"][:1], "total": counts["total"][:1], "ratios": pa.array([log_ratios(held).tobytes()], pa.binary())})

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # A language's group has a row for each bucket, BUCKETS at most.
    columns = written(counts.join(totals, "lang").groupBy("lang").applyInArrow(column, "lang string, total long, ratios binary"), "language-columns")
    known = sorted((r["lang"], r["total"]) for r in columns.select("lang", "total").collect())
    seen, blocks = np.zeros(LETTER_BUCKETS, dtype=bool), []
    for at in range(0, len(known), block):
        names = [lang for lang, _ in known[at : at + block]]
        part = columns.where(F.col("lang").between(names[0], names[-1])).select("lang", "ratios").toArrow()
        place = {lang: k for k, lang in enumerate(names)}
        matrix = np.empty((BUCKETS, len(names)), dtype=np.float32)
        for lang, ratios in zip(part["lang"].to_pylist(), part["ratios"], strict=True):
            matrix[:, place[lang]] = np.frombuffer(ratios.as_buffer(), dtype=np.float32)
        seen |= matrix[:LETTER_BUCKETS].any(axis=1)
        blocks.append(spark.sparkContext.broadcast(matrix))
        # The driver's own copy isn't needed any more.
        vars(blocks[-1]).pop("_value", None)
    sizes = np.array([n for _, n in known], dtype=float)
    return Model(tuple(lang for lang, _ in known), np.log(sizes / sizes.sum()) if known else sizes, seen, tuple(blocks))


def predict(spark, model: Model, text: Column) -> Column:
    """struct(lang_pred, score) of a text; `und` and 0 for null texts and those without a letter."""

    @F.arrow_udf("lang_pred string, score double")
    def scored(texts: pa.Array) -> pa.Array:
        names = (*model.languages, UNKNOWN)
        found, scores = [], []
        for at in range(0, len(texts), _TEXTS):
            best, score = model.score(texts[at : at + _TEXTS].to_pylist())
            found += [names[k] for k in best.tolist()]
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["lang_pred", "score"])

    return scored(text)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def trained(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> Model:
    """The model of the documents that are not held out."""
    return train(docs.where(~held_out(F.col("doc_id"))).select("lang", F.col("doc_id").alias("key"), "text"), max_docs)


def identify(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs.

    Learns from the languages of the documents that are not held out. Without
    any, every text is `und`. Very long texts are scored whole, in slices. A
    text in letters that no language was seen with gets the most frequent
    language, at a score near 0.
    """
    model = trained(docs, max_docs)
    found = docs.select(F.col("doc_id").alias("doc_id"), predict(docs.sparkSession, model, F.col("text")).alias("p"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs, all columns, whose language is known: not `und`, and at min_score or more."""
    model = trained(docs, max_docs)
    found = docs.select(F.struct("*").alias("row"), predict(docs.sparkSession, model, F.col("text")).alias("p"))
    return found.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= min_score)).select("row.*")
