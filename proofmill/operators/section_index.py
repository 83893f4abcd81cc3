"""The two best sections of a reading, by an index of the words of its pack's sections.

A scope is a pack, or what a hint leaves of one. Its sections are dealt out to
blocks, its readings to parts, by the length of their texts, and each pair of
block and part is one task's group: a hot pack is a grid of tasks. A group's
index lists the sections of each word. A reading's words give the number of
words that it has in common with each section, and with the digests of texts and
lines all scores; the two best of each block go on.

Texts and lines are compared by their digests, words as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the sections, and of the readings, of a group, roughly.
GROUP_CHARS = 1 << 22
#: Different hints of packs, some 100 bytes each, that are broadcast.
BROADCAST_HINTS = 100_000
#: What makes a scope.
SCOPE = ("scope", "pack_id", "by_number", "hint_number", "by_name", "hint_name")
_KINDS = ("strict", "strict_lines", "soft", "soft_lines")


def hint_key() -> Column:
    """A number for a pack and the hints given in it."""
    return F.xxhash64("pack_id", F.coalesce("hint_number", F.lit(0)), F.col("hint_number").isNull(), F.coalesce("hint_name", F.lit("")))


def with_scopes(readings: DataFrame, sections: DataFrame, hint_flags: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """readings with their scope, and the scopes: packs, or what a hint leaves of one. Hints are tried once, however many readings give them."""
    rows = readings.withColumn("hint", hint_key())
    hints = rows.where("hint_number is not null or hint_name <> ''").select(F.col("hint").alias("zone_id"), "pack_id", "hint_number", "hint_name").distinct()
    flags = hint_flags(hints.join(sections.select("pack_id", "section_no", "name"), "pack_id")).withColumnRenamed("zone_id", "hint")
    rows = rows.join(flags, "hint", "left")
    for flag, column in (("by_number", "hint_number"), ("by_name", "hint_name")):
        rows = rows.withColumn(flag, F.coalesce(flag, F.lit(False))).withColumn(column, F.when(F.col(flag), F.col(column)))
    scope = F.xxhash64("pack_id", "by_number", F.coalesce("hint_number", F.lit(0)), "by_name", F.coalesce("hint_name", F.lit("")))
    rows = rows.withColumn("scope", scope)
    return rows, rows.select(*SCOPE).distinct()


def members(scopes: DataFrame, sections: DataFrame, picked: Column, bases: tuple[Column, Column], *more: str) -> DataFrame:
    """The sections of each scope, with their bases in languages with spaces and without."""
    rows = scopes.join(sections, "pack_id").where(picked)
    return rows.select("scope", "ord", "has_placeholder", "s_strict", "s_soft", "s_strict_lines", "s_soft_lines", "s_words", bases[0].alias("spaced_base"), bases[1].alias("plain_base"), *more)


def grid(readings: DataFrame, sections: DataFrame) -> DataFrame:
    """(scope, blocks, parts) for rows (scope, weight) of both sides."""
    groups = lambda rows, name: rows.groupBy("scope").agg(F.greatest(F.lit(1), F.ceil(F.sum("weight") / GROUP_CHARS)).cast("int").alias(name))
    return groups(sections, "blocks").join(groups(readings, "parts"), "scope")


def _codes(left: pa.Table, right: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the digests of a reading and a section are; nulls equal nothing."""
    both = pa.chunked_array([*left[f"r_{kind}"].chunks, *right[f"s_{kind}"].chunks], pa.string()).combine_chunks().dictionary_encode().indices
    known = both.fill_null(-1).to_numpy(zero_copy_only=False)
    return known[: len(left)], np.where(known[len(left) :] < 0, -2, known[len(left) :])


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each begins and ends."""
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(whole.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)


def _scored(left: pa.Table, right: pa.Table):
    """For each reading its scores with all sections, and which are equal, strictly or softly."""
    equal = {kind: _codes(left, right, kind) for kind in _KINDS}
    words, ends = _lists(right["s_words"])
    sizes = np.diff(ends)
    terms, term = np.unique(words, return_inverse=True)
    # The sections of each word, one word after another.
    listed = np.repeat(np.arange(len(right)), sizes)[np.argsort(term, kind="stable")]
    at = np.r_[0, np.cumsum(np.bincount(term, minlength=len(terms)))].tolist()
    asked, asked_ends = _lists(left["r_words"])
    place = np.searchsorted(terms, asked)
    known = np.flatnonzero(np.append(terms, 0)[place] == asked) if len(terms) else np.zeros(0, np.int64)
    known = known[place[known] < len(terms)]
    hits, cuts = place[known].tolist(), np.searchsorted(known, asked_ends).tolist()
    bases = [right[c].to_numpy() for c in ("plain_base", "spaced_base")]
    for k, spaced in enumerate(left["spaced"].to_pylist()):
        found = [listed[at[t] : at[t + 1]] for t in hits[cuts[k] : cuts[k + 1]]]
        common = np.bincount(np.concatenate(found), minlength=len(right)) if found else np.zeros(len(right), np.int64)
        union = asked_ends[k + 1] - asked_ends[k] + sizes - common
        strict, soft = ((equal[a][1] == equal[a][0][k]) | (equal[b][1] == equal[b][0][k]) for a, b in (_KINDS[:2], _KINDS[2:]))
        match = np.where(strict, 5.0, np.where(soft, 3.0, 2.0 * (common / np.maximum(union, 1))))
        yield bases[bool(spaced)] + match, strict, soft


def best_two(readings: DataFrame, members: DataFrame, *more: str) -> DataFrame:
    """Of the sections of each scope and block the two best of each reading, the first in order if scores are equal, with score, strict_equal and soft_equal.

    readings (zone_id, scope, spaced, forms r_) and members have blocks and parts,
    as of grid; `more` are columns of readings. only says whether all sections of the block are
    placeholders, sections on a reading's first row of a block how many there are.
    """
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ("scope", "block", "part")
    # A name of its own: both tables may come from one.
    scope = F.col("scope").alias("scope")
    r = readings.select(scope, every("blocks").alias("block"), own("zone_id", "parts").alias("part"), "zone_id", "spaced", *(f"r_{c}" for c in (*_KINDS, "words")), *more)
    kept = [c for c in ("ord", "section_no", "name", "has_placeholder", "usable") if c in members.columns]
    s = members.select(scope, own("ord", "blocks").alias("block"), every("parts").alias("part"), *kept, "spaced_base", "plain_base", *(f"s_{c}" for c in (*_KINDS, "words")))
    kinds = [f"{c} {t[c].dataType.simpleString()}" for t, names in ((r.schema, ("zone_id", "scope", *more)), (s.schema, kept)) for c in names]
    schema = ", ".join([*kinds, "score double, strict_equal boolean, soft_equal boolean, only boolean, sections long"])

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("ord")
        only = bool(len(right)) and all(right["has_placeholder"].to_pylist())
        rows: list[tuple] = []
        for k, (score, strict, soft) in enumerate(_scored(left, right) if len(right) else ()):
            score = score.copy()
            for place in range(min(2, len(right))):
                best = int(score.argmax())
                rows.append((k, best, float(score[best]), bool(strict[best]), bool(soft[best]), only, 0 if place else len(right)))
                score[best] = -np.inf
        a, b, *facts = zip(*rows, strict=True) if rows else [()] * 7
        picked = [t.take(pa.array(x, pa.int64())).select(names) for t, x, names in ((left, a, ["zone_id", "scope", *more]), (right, b, kept))]
        types = (pa.float64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64())
        columns = {c: t[c] for t in picked for c in t.column_names} | {c: pa.array(x, t) for c, x, t in zip(("score", "strict_equal", "soft_equal", "only", "sections"), facts, types, strict=True)}
        return pa.table(columns)

    return r.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInArrow(match, schema)


def candidates(readings: DataFrame, sections: DataFrame) -> DataFrame:
    """(zone_id, scope, ord, ..): sections among which are the two best of each reading of a scope, by best_two. Weights are taken from the words."""
    weighed = lambda rows, words: rows.select("scope", (F.size(words) * 8).alias("weight"))
    of_scope = grid(weighed(readings, "r_words"), weighed(sections, "s_words"))
    return best_two(readings.join(of_scope, "scope"), sections.join(of_scope, "scope"))
