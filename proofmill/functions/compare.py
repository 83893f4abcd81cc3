"""Comparison of texts as Column functions, and distances over tables."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from proofmill.config import DEFAULT, ENGINES, Config
from proofmill.functions import text as T
from proofmill.sources.shared import written


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once for a row: later filters and uses read it instead of repeating a costly expression."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def edit_similarity(a: Column, b: Column, config: Config = DEFAULT, least: float = 0.0) -> Column:
    """1 - edit distance / longer length, over the first config.similarity_chars characters; null below least. Equal texts skip the distance."""
    return whole_similarity(F.substring(a, 1, config.similarity_chars), F.substring(b, 1, config.similarity_chars), least)


def compare_lines(reading: Column, reference: Column, level: str = "soft", similarity: bool = True) -> Column:
    """struct(pass, mode, similarity, lines_ocr, lines_ref): equal as a whole, or as multisets of lines, or not.

    similarity=False leaves it null, where only the decision is asked for.
    """
    a, b = T.normalize(reading, level), T.normalize(reference, level)
    la, lb = T.normalized_lines(reading, level), T.normalized_lines(reference, level)
    mode = F.when(a == b, "exact").when((F.size(la) > 0) & (F.array_sort(la) == F.array_sort(lb)), "line_multiset").otherwise("none")
    sim = edit_similarity(a, b) if similarity else F.lit(None).cast("double")
    return F.struct((mode != "none").alias("pass"), mode.alias("mode"), sim.alias("similarity"), F.size(la).alias("lines_ocr"), F.size(lb).alias("lines_ref"))


def compared(rows: DataFrame, name: str, reading: Column, reference: Column, level: str = "soft", asked: Column | None = None) -> DataFrame:
    """rows with `name`, what compare_lines gives, null where `asked` doesn't hold. Forms are made once, before the distance."""
    forms = F.struct(T.normalize(reading, level).alias("a"), T.normalize(reference, level).alias("b"), T.normalized_lines(reading, level).alias("la"), T.normalized_lines(reference, level).alias("lb"))
    rows, f = once(rows, "c_f", forms if asked is None else F.when(asked, forms)), F.col("c_f")
    alike = (F.size(f["la"]) > 0) & (F.size(f["la"]) == F.size(f["lb"])) & (F.array_sort(f["la"]) == F.array_sort(f["lb"]))
    mode = F.when(f["a"] == f["b"], "exact").when(alike, "line_multiset").otherwise("none")
    short = F.struct(mode.alias("mode"), F.size(f["la"]).alias("la"), F.size(f["lb"]).alias("lb"), F.substring(f["a"], 1, DEFAULT.similarity_chars).alias("a"), F.substring(f["b"], 1, DEFAULT.similarity_chars).alias("b"))
    rows, s = once(rows, "c_s", F.when(f.isNotNull(), short)).drop("c_f"), F.col("c_s")
    block = F.struct((s["mode"] != "none").alias("pass"), s["mode"].alias("mode"), edit_similarity(s["a"], s["b"]).alias("similarity"), s["la"].alias("lines_ocr"), s["lb"].alias("lines_ref"))
    return rows.withColumn(name, F.when(s.isNotNull(), block)).drop("c_s")


def word_set(text: Column) -> Column:
    """The distinct words of a normalised text, as 64-bit hashes: sets of numbers intersect several times faster than sets of strings."""
    return F.array_distinct(F.transform(T.words(text), lambda w: F.xxhash64(w)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words in two word sets; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def in_grey_zone(passed: Column, similarity: Column, config: Config = DEFAULT) -> Column:
    """Neither equal nor far: what a judge should see."""
    return ~passed & similarity.isNotNull() & similarity.between(config.grey_low, config.grey_high)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many characters two texts begin with alike, looked at in growing parts."""
    at, part, n = 0, 32, min(len(x), len(y))
    while at < n:
        differ = x[at : min(at + part, n)] != y[at : min(at + part, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, part = at + len(differ), part * 4
    return n


#: Up to so many edits are looked for by their number, before the table of distances is filled.
_FEW = 32
#: After so many edits a path to a near text has come an eighth of the way.
_SOON = 12


def _few_edits(x: np.ndarray, y: np.ndarray, most: int, changes: bool = True) -> int | None:
    """The edit distance of two texts if it is found to be at most `most`: how far each diagonal gets with 0, 1, 2.. edits; without changes insertions and deletions only. None settles nothing."""
    n, m = len(x), len(y)
    a, b = x.tolist(), y.tolist()
    far = {0: _common(x, y)}
    if n == m == far[0]:
        return 0
    for edits in range(1, most + 1):
        reached = {}
        for k in range(max(-edits, -m), min(edits, n) + 1):
            i = min(max(far.get(k, -2) + 1 if changes else -1, far.get(k - 1, -2) + 1, far.get(k + 1, -1)), n, m + k)
            if i < 0 or i < k:
                continue
            if i < n and i - k < m and a[i] == b[i - k]:
                i += _common(x[i:], y[i - k :])
            reached[k] = i
        far = reached
        if far.get(n - m, -1) >= n:
            return edits
        if edits == _SOON and max(far.values()) < n // 8:
            return None
    return None


def within_distance(a: str, b: str, most: int) -> int | None:
    """The edit distance of two texts, or None if it is over most. Few edits are found by their number. For more, columns of the table of distances are the bits of two Python integers, so a text of 100,000 characters takes seconds."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    x, y = _codes(a), _codes(b)
    head = _common(x, y)
    tail = _common(x[head:][::-1], y[head:][::-1])
    codes, y, b = x[head : len(x) - tail], y[head : len(y) - tail], b[head : len(b) - tail]
    if not b:
        return len(codes)
    if (few := _few_edits(codes, y, min(most, _FEW))) is not None:
        return few
    distance, left = len(codes), len(b)
    masks = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.intersect1d(codes, y).tolist()}
    full, last = (1 << len(codes)) - 1, len(codes) - 1
    # A row is one greater than the row above where `more` has a bit, one less where `less` has one.
    more, less = full, 0
    for ch in b:
        same = masks.get(ch, 0)
        either = same | less
        level = (((same & more) + more) ^ more) | same
        right, drop = less | (full & ~(level | more)), more & level
        distance, left = distance + (right >> last) - (drop >> last), left - 1
        if distance - left > most:
            return None
        right, drop = (right << 1 | 1) & full, (drop << 1) & full
        more, less = drop | (full & ~(either | right)), right & either
    return distance if distance <= most else None


@F.pandas_udf(IntegerType())
def _within(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([within_distance(x, y, m) for x, y, m in zip(a, b, most, strict=True)], dtype="Int32")


def whole_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """1 - edit distance / longer length over whole texts, as edit_similarity has it for their beginnings. Null if a text is, or below least: the distance stops there."""
    longer = F.greatest(F.length(a), F.length(b))
    asked = (a != b) & (a != "") & (b != "")
    # Rows that need no distance go to Python as empty texts.
    sent = lambda t: F.when(asked, t).otherwise("")
    distance = _within(sent(a), sent(b), F.coalesce(F.floor(F.round((1 - least) * longer, 6)).cast("int"), F.lit(0)))
    some = F.when(a == b, 1.0).when(asked, 1.0 - distance / longer).when(a.isNotNull() & b.isNotNull(), 0.0)
    return F.when(some >= least, some)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, on the bits of a Python integer."""
    return (len(a) + len(b) - insertions_and_deletions(a, b)) // 2


def insertions_and_deletions(a: str, b: str) -> int:
    """The fewest insertions and deletions between two texts. Equal ends cost nothing, few are found by their number."""
    x, y = _codes(a), _codes(b)
    head = _common(x, y)
    tail = _common(x[head:][::-1], y[head:][::-1])
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if not len(x) or not len(y):
        return len(x) + len(y)
    if (few := _few_edits(x, y, _FEW, changes=False)) is not None:
        return few
    masks = {c: int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.intersect1d(x, y).tolist()}
    row = full = (1 << len(x)) - 1
    for c in y.tolist():
        if hit := row & masks.get(c, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(x) + len(y) - 2 * (len(x) - row.bit_count())


@F.pandas_udf(IntegerType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([insertions_and_deletions(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def indel_distance(a: Column, b: Column) -> Column:
    """Insertions and deletions between two texts that aren't null."""
    return _indel(a, b)


def closest_engine(readings: DataFrame, references: DataFrame) -> DataFrame:
    """(zone_id, engine, distance): the reading nearest to the zone's reference; ties go to the earlier engine, empty readings don't count."""
    seen = T.table_view("text")
    rows = readings.select("zone_id", "engine", F.lower(seen).alias("text")).where("text <> ''")
    rows = rows.join(references.select("zone_id", F.lower(T.table_view("text")).alias("ref")), "zone_id").where("ref <> ''")
    order = F.array_position(F.array(*map(F.lit, ENGINES)), F.col("engine"))
    rows = rows.withColumn("distance", indel_distance(F.col("text"), F.col("ref")))
    best = F.min(F.struct("distance", order.alias("o"), "engine")).alias("b")
    return rows.groupBy("zone_id").agg(best).select("zone_id", "b.engine", "b.distance")


def tokenised(pairs: DataFrame) -> DataFrame:
    """(zone_id, t) with t the tokens of a pair's text (a) and ref (b); each step is made once."""
    rows = once(pairs.select("zone_id", "text", "ref"), "v", F.struct(T.table_view("text").alias("a"), T.table_view("ref").alias("b")))
    tokens = lambda name: T.words(F.lower(T.collapse(F.col(name))))
    return once(rows.select("zone_id", "v"), "t", F.struct(tokens("v.a").alias("a"), tokens("v.b").alias("b"))).select("zone_id", "t")


_COUNTS = ArrayType(StructType([StructField("token", StringType()), StructField("text", LongType()), StructField("ref", LongType())]))


@F.arrow_udf(_COUNTS)
def _unlike(a: pa.Array, b: pa.Array) -> pa.Array:
    """The tokens that come more often on one side of a pair, with their numbers on both."""
    rows = []
    for x, y in zip(a, b, strict=True):  # row by row, so that a batch's tokens aren't all held
        left, right = Counter(x.as_py()), Counter(y.as_py())
        rows.append([{"token": k, "text": left[k], "ref": right[k]} for k in left.keys() | right.keys() if left[k] != right[k]])
    return pa.array(rows, pa.list_(pa.struct([("token", pa.string()), ("text", pa.int64()), ("ref", pa.int64())])))


def token_differences(pairs: DataFrame) -> DataFrame:
    """(zone_id, token, n, op) for (zone_id, text, ref): tokens only in the reading (del) or only in the reference (add), the n-th of their kind.

    A zone with one row is compared where it is read. The tokens of zones with
    several rows are counted together, over all of their rows.
    """
    repeated = written(pairs.groupBy("zone_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("zone_id").alias("repeated")), "repeated-zones")
    again = None if repeated.isEmpty() else F.col("zone_id").eqNullSafe(F.col("repeated"))
    alone = tokenised(pairs if again is None else pairs.join(repeated, again, "left_anti")).where(F.sort_array("t.a") != F.sort_array("t.b"))
    both = alone.select("zone_id", F.explode(_unlike(F.col("t.a"), F.col("t.b"))).alias("u")).select("zone_id", "u.*")
    if again is not None:
        marked = lambda words, op: F.transform(words, lambda w: F.struct(w.alias("token"), F.lit(op).alias("op")))
        rows = tokenised(pairs.join(repeated, again, "left_semi"))
        rows = rows.select("zone_id", F.explode(F.concat(marked(F.col("t.a"), "del"), marked(F.col("t.b"), "add"))).alias("t"))
        n = lambda op: F.count_if(F.col("t.op") == op)
        both = both.unionByName(rows.groupBy("zone_id", F.col("t.token").alias("token")).agg(n("del").alias("text"), n("add").alias("ref")).where("text <> ref"))
    return both.select(
        "zone_id", "token", F.explode(F.sequence(F.least("text", "ref") + 1, F.greatest("text", "ref"))).alias("n"), F.when(F.col("text") > F.col("ref"), "del").otherwise("add").alias("op")
    )


def _prefix_lcs(a: list[int], b: list[int]) -> np.ndarray:
    """The LCS length of b and each prefix of a: zeros of the bit row that b leaves."""
    masks: dict[int, int] = {}
    for k, token in enumerate(a):
        masks[token] = masks.get(token, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for token in b:
        if hit := row & masks.get(token, 0):
            row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, in order.

    The shorter halves are found by Hirschberg's division, on bit rows: time is
    the product of the lengths over the width of a machine word, memory linear.
    """
    found = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i == j or k == m:
            continue
        if m - k == 1:
            if b[k] in a[i:j]:
                found.append((a.index(b[k], i, j), k))
            continue
        half = (k + m) // 2
        ahead = _prefix_lcs(a[i:j], b[k:half])
        behind = _prefix_lcs(a[i:j][::-1], b[half:m][::-1])[::-1]
        cut = i + int((ahead + behind).argmax())
        stack += [(i, cut, k, half), (cut, j, half, m)]
    return sorted(found)


_OPS = ArrayType(StructType([StructField("op", StringType()), StructField("position", IntegerType())]))


@F.arrow_udf(_OPS)
def _ops(a: pa.Array, b: pa.Array) -> pa.Array:
    rows = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if x is None or y is None:
            rows.append(None)
            continue
        kept = aligned(x, y)
        in_a, in_b = {i for i, _ in kept}, {k for _, k in kept}
        gone = [{"op": "del", "position": i} for i in range(len(x)) if i not in in_a]
        rows.append(gone + [{"op": "add", "position": k} for k in range(len(y)) if k not in in_b])
    return pa.array(rows, pa.list_(pa.struct([("op", pa.string()), ("position", pa.int32())])))


def ordered_differences(pairs: DataFrame) -> DataFrame:
    """(zone_id, tokens, ops) for (zone_id, text, ref) whose tokens differ: the reading's tokens and the fewest steps to the reference's, in order.

    A step is (op, position, token): `del` takes the token at a place of the
    reading out, `add` puts one at a place of the reference. Text that was moved
    is taken out in one place and put in at another. Texts are compared whole, on
    hashes of their tokens; only differing ones reach Python. Null texts are empty.
    """
    rows = tokenised(pairs).where(~F.col("t.a").eqNullSafe(F.col("t.b")))
    hashes = lambda x: F.transform(x, lambda w: F.xxhash64(w))
    rows = rows.select("zone_id", F.col("t.a").alias("tokens"), F.col("t.b").alias("b"), _ops(hashes(F.col("t.a")), hashes(F.col("t.b"))).alias("steps"))
    token = lambda x: F.when(x["op"] == "del", F.get("tokens", x["position"])).otherwise(F.get("b", x["position"]))
    step = lambda x: F.struct(x["op"].alias("op"), x["position"].alias("position"), token(x).alias("token"))
    return rows.select("zone_id", "tokens", F.transform("steps", step).alias("ops"))


def patched(tokens: Column, ops: Column) -> Column:
    """The reference's tokens, from the reading's and the steps between them."""
    gone = F.transform(F.filter(ops, lambda x: x["op"] == "del"), lambda x: x["position"])
    put = F.transform(F.filter(ops, lambda x: x["op"] == "add"), lambda x: F.struct(x["position"].alias("at"), x["token"].alias("token")))
    kept = _without(tokens, gone)
    free = _without(F.sequence(F.lit(1), F.size(kept) + F.size(put)), F.transform(put, lambda x: x["at"]))
    stay = F.zip_with(free, kept, lambda at, token: F.struct((at - 1).alias("at"), token.alias("token")))
    return F.when(F.size(kept) + F.size(put) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(F.concat(stay, put)), lambda x: x["token"]))


def _without(values: Column, positions: Column) -> Column:
    """values but those at the sorted positions from 0: the stretches between them. Both are made once, in the one element of an outer array."""
    ends = F.concat(F.array(F.lit(-1)), positions, F.array(F.size(values)))

    def stretches(x: Column) -> Column:
        stretch = lambda k: F.slice(x["v"], F.get(x["e"], k) + 2, F.get(x["e"], k + 1) - F.get(x["e"], k) - 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["e"]) - 2), stretch))

    return F.flatten(F.transform(F.array(F.struct(values.alias("v"), ends.alias("e"))), stretches))


def numbers(text: Column | str) -> Column:
    """Numbers in order of appearance, separators off."""
    found = F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(r"(\p{Nd}+(?:[.,]\p{Nd}+)*)"), 1)
    return F.transform(found, lambda x: F.translate(x, ".,", ""))


def number_facts(english: Column, local: Column) -> Column:
    """struct(en, local, missing, extra) of sorted distinct numbers; null unless a number of the English text is missing."""
    en, lo = F.array_distinct(numbers(english)), F.array_distinct(numbers(local))
    missing = F.array_except(en, lo)
    facts = F.struct(
        F.array_sort(en).alias("en_numbers"), F.array_sort(lo).alias("lang_numbers"), F.array_sort(missing).alias("missing"), F.array_sort(F.array_except(lo, en)).alias("extra")
    )
    return F.when(F.size(missing) > 0, facts)


def validation(rows: DataFrame, reading: str = "text", expected: str = "expected_text", lang: str = "lang", config: Config = DEFAULT) -> DataFrame:
    """rows with `validation`, a struct(applied, skip_reason, similarity, match_pass, match_mode, lines_ocr, lines_ref, below): the block for a zone, or why there is none."""
    skip = F.when(F.coalesce(lang, F.lit("")) == "", "lang_missing").when(F.col(expected).isNull(), "expected_text_missing")
    rows = compared(rows.withColumn("v_skip", skip), "v_c", F.col(reading), F.col(expected), "soft", F.col("v_skip").isNull())
    c = F.col("v_c")
    block = F.struct(
        c.isNotNull().alias("applied"), F.col("v_skip").alias("skip_reason"), F.round(c["similarity"], 4).alias("similarity"), c["pass"].alias("match_pass"),
        c["mode"].alias("match_mode"), c["lines_ocr"].alias("lines_ocr"), c["lines_ref"].alias("lines_ref"), (c["similarity"] < config.similarity_shown).alias("below"),
    )
    return rows.withColumn("validation", block).drop("v_skip", "v_c")


def as_percent(similarity: Column, places: int = 2) -> Column:
    """A share as it is shown: 0.8312 is 83.12%."""
    return F.format_string(f"%.{places}f%%", similarity * 100)


def grey_zone(pairs: DataFrame, config: Config = DEFAULT, whole: bool = False) -> DataFrame:
    """pairs (text, ref) that differ but are similar enough to be judged, with their similarity: of their beginnings, or of whole texts. Forms are made once; the distance gives up on far pairs."""
    a, b = T.normalize("text", "soft"), T.normalize("ref", "soft")
    rows = once(pairs, "g_f", F.struct(a.alias("a"), b.alias("b"), compare_lines(F.col("text"), F.col("ref"), similarity=False)["pass"].alias("ok")))
    rows, f = rows.where(~F.col("g_f.ok")), F.col("g_f")
    near = whole_similarity(f["a"], f["b"], config.grey_low) if whole else edit_similarity(f["a"], f["b"], config, config.grey_low)
    rows = rows.withColumn("similarity", near)
    return rows.where(in_grey_zone(f["ok"], F.col("similarity"), config)).drop("g_f")
