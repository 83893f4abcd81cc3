"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions.

A paragraph (a line) is hashed to a vector of LANES small numbers, the digits of
two SHA-256 digests, centred to -15, -13, ... 15. Three lanes are packed in a
number, 20 bits apart. A text's fingerprint is the sum of its paragraphs' packed
vectors modulo 2**BITS. So it doesn't depend on the paragraphs' order, and an
edit costs what it touches: the vectors of paragraphs that go are subtracted,
those of new ones added (`replaced`), without the rest of the text.

Since the lanes hold small numbers, their sums can be unpacked: a lane stays
within its 20 bits up to some 35,000 repetitions of one paragraph, or 200 million
paragraphs that differ. The product of two fingerprints' lanes estimates what
their texts share (`likeness`): 2 * common / (all of one + all of the other),
where a paragraph counts by the square of how often it stands there. The standard
error is 1 / sqrt(LANES) at most, 0.09; equal fingerprints have 1 exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmill.llm.common import written

#: Lanes: DIGITS digits of each of the PARTS parts of a paragraph's two digests.
DIGITS, PARTS = 15, 8
LANES = DIGITS * PARTS
#: Bits of a lane, of three; the latter is the modulus.
LANE = 20
BITS = 3 * LANE
_ONES = 1 << 2 * LANE | 1 << LANE | 1
_MASK = (1 << BITS) - 1
#: Rows whose successors one task finds.
BLOCK_ROWS = 50_000
#: Repetitions of one row that one task writes out.
COPIES = 10_000


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _numbers(paragraph: Column) -> Column:
    """The parts of a paragraph's digests as longs, doubled."""
    digest = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), paragraph).cast("binary"), 256)
    both = F.transform(F.array(digest(0), digest(1)), lambda x: F.array(*(2 * F.conv(F.substring(x, DIGITS * k + 1, DIGITS), 16, 10).cast("long") for k in range(PARTS // 2))))
    return F.flatten(both)


def fingerprint(parts: Column) -> Column:
    """The fingerprint of an array of paragraphs: LANES / 3 packed numbers. A digit d counts as 2 * d - 15."""
    fives = [(part, 4 * k) for part in range(PARTS) for k in range(DIGITS // 3)]
    centre = F.lit(_MASK + 1 - 15 * _ONES)
    digits = lambda x, part, shift: F.shiftright(F.get(x, F.lit(part)), shift).bitwiseAND(30 * _ONES) + centre
    add = lambda acc, x: F.array(*((F.get(acc, F.lit(k)) + digits(x, *of)).bitwiseAND(_MASK) for k, of in enumerate(fives)))
    return F.aggregate(F.transform(parts, _numbers), F.array_repeat(F.lit(0).cast("long"), len(fives)), add)


def added(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(_MASK))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of a without those of b."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(_MASK))


def replaced(whole: Column, old: Column, new: Column) -> Column:
    """The fingerprint `whole` once paragraphs `old` have gone and `new` have come; arrays of paragraphs."""
    return added(removed(whole, fingerprint(old)), fingerprint(new))


def _lanes(vector: Column) -> Column:
    """LANES signed numbers."""
    half = 1 << LANE - 1
    low = lambda x: (x + half).bitwiseAND((1 << LANE) - 1) - half
    # What is left of a number without its signed lowest lane.
    up = lambda x: F.shiftright(x + half, LANE)
    return F.flatten(F.transform(vector, lambda x: F.array(low(up(up(x))), low(up(x)), low(x))))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the estimated share of paragraphs that two fingerprints have in common."""
    zero = F.lit(0.0)
    products = lambda x, y: F.struct((x * y).alias("p"), (x * x + y * y).alias("q"))
    start = F.struct(zero.alias("p"), zero.alias("q"))
    add = lambda acc, x: F.struct((acc["p"] + x["p"]).alias("p"), (acc["q"] + x["q"]).alias("q"))
    share = lambda acc: F.coalesce(F.least(F.greatest(2 * acc["p"] / F.nullif(acc["q"], zero), zero), F.lit(1.0)), zero)
    return F.when(a == b, 1.0).otherwise(F.aggregate(F.zip_with(_lanes(a), _lanes(b), products), start, add, share))


def as_string(vector: Column) -> Column:
    """Lowercase hex digits, BITS / 4 for each packed number."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, vector, fingerprint), a row for each row of docs (doc_id, text); a null text is an empty one, which is one empty paragraph."""
    found = docs.select(F.col("doc_id").alias("doc_id"), fingerprint(paragraphs(F.coalesce(F.col("text"), F.lit("")))).alias("vector"))
    return found.select("doc_id", "vector", as_string(F.col("vector")).alias("fingerprint"))


def _keys(docs: DataFrame) -> list[Column]:
    """Columns without nulls that tell documents apart: whether the id is null, the id, a hash of the text."""
    zero = F.lit(0).cast(docs.schema["doc_id"].dataType)
    return [F.col("doc_id").isNotNull().alias("k_known"), F.coalesce("doc_id", zero).alias("k_id"), F.xxhash64("text").alias("k_text")]


_KEY = ["k_known", "k_id", "k_text"]


def _successors(docs: DataFrame) -> DataFrame:
    """(keys, copies, chars, s_ keys of the next document): the documents in ascending order of their keys, the first one behind the last.

    Keys are dealt out by ranges and sorted there; successors are found within
    blocks, then between the blocks, of which there is one for BLOCK_ROWS rows.
    """
    counted = docs.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.first("chars").alias("chars"))
    ranged = counted.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    numbered = written(ranged.withColumn("nth", F.monotonically_increasing_id()), "fingerprint-order").withColumn("block", F.floor(F.col("nth") / BLOCK_ROWS))
    key = F.struct(*_KEY)
    blocks = numbered.groupBy("block").agg(F.min_by(key, "nth").alias("first"))
    whole = W.orderBy("block")
    ahead = F.coalesce(F.lead("first").over(whole), F.first("first").over(whole))
    blocks = written(blocks.select("block", ahead.alias("ahead")), "fingerprint-blocks")
    inside = numbered.withColumn("s", F.lead(key).over(W.partitionBy("block").orderBy("nth")))
    both = inside.join(blocks, "block").withColumn("s", F.coalesce("s", "ahead"))
    return both.select(*_KEY, "copies", "chars", *(F.col(f"s.{c}").alias(f"s_{c}") for c in _KEY))


def edited_by_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, vector, edited_vector, next_vector), a row for each row of docs (doc_id, text).

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many, or all, of the next document. Documents go by ascending id,
    null ids first, rows with one id by a hash of their text; the first follows
    the last. Each of a row's repetitions but one has its like as the next.
    A null text is an empty one. Ids are numbers or strings. The edited text's
    fingerprint is made from the document's: only paragraphs from the edit on
    are hashed.

    Texts are shuffled once, by their keys; what the documents take from their
    successors, half of a text at most, is shuffled to them.
    """
    base = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).select(*_keys(docs), "text")
    succ = _successors(base.select(*_KEY, F.length("text").cast("long").alias("chars")))
    # Both joins read the same exchange: rows that repeat are one, whose fingerprint is made once.
    once = base.withColumn("vector", fingerprint(paragraphs(F.col("text")))).groupBy(*_KEY).agg(F.first("text").alias("text"), F.first("vector").alias("vector"))
    asked = succ.alias("s").join(once.alias("t").hint("merge"), [F.col(f"s.s_{c}") == F.col(f"t.{c}") for c in _KEY])
    asked = asked.select(
        *(F.col(f"s.{c}").alias(c) for c in _KEY), F.col("s.copies").alias("copies"), F.expr("left(t.text, cast(s.chars div 2 as int))").alias("piece"), F.col("t.vector").alias("next_vector")
    )
    both = once.hint("merge").join(asked.hint("merge"), _KEY)
    own = F.when(F.col("k_known"), F.col("k_id")).alias("doc_id")
    last = both.select(own, "text", "piece", "vector", "next_vector")
    # A repeated row is followed by itself, but for its last repetition: parts of COPIES, dealt out before they are written out.
    parts = succ.where("copies > 1").withColumn("part", F.explode(F.expr(f"sequence(0L, (copies - 2) div {COPIES})")))
    parts = parts.select(*_KEY, "part", F.least(F.lit(COPIES).cast("long"), F.col("copies") - 1 - F.col("part") * COPIES).alias("n"))
    again = once.hint("merge").join(parts.hint("merge"), _KEY).repartition(*_KEY, "part").select(
        own, "text", F.expr("left(text, cast(length(text) div 2 as int))").alias("piece"), "vector", F.col("vector").alias("next_vector"), F.explode(F.expr("sequence(1L, n)")).alias("copy")
    )
    rows = last.unionByName(again.drop("copy"))
    n = F.length("text")
    rows = rows.withColumn("head", F.expr("left(text, cast(length(text) - length(text) div 2 as int))"))
    # The line that the edit stands in, from its beginning.
    line = F.substring_index("head", "\n", -1)
    at = F.length("head") - F.length(line)
    old, new = F.substr(F.col("text"), at + 1), F.concat(line, F.col("piece"))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.concat("head", "piece").alias("edited"), "vector",
        replaced(F.col("vector"), paragraphs(old), paragraphs(new)).alias("edited_vector"), "next_vector",
    )
