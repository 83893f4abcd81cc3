"""Benchmark decontamination by winnowing, in DataFrame functions.

Words are hashed in grams of GRAM; of each SPAN consecutive gram hashes the
least is kept as a fingerprint. GRAM + SPAN - 1 = WINDOW, so that every shared
run of WINDOW words has a fingerprint in common, at the same place of the run.
Fingerprints of documents and benchmark items are joined, the words around a
hit are compared, and runs of WINDOW or more words count. Items of fewer words
are one window of their own; all grams of just their lengths are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import lower_ascii, row_key, written

WINDOW = 10
GRAM = 5
SPAN = WINDOW - GRAM + 1
PLACE_BITS = 30
#: Benchmark fingerprints that are broadcast at most; with more, both sides are shuffled.
BROADCAST_ROWS = 100_000
#: The complement of [0-9a-z] and the characters above U+007F.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _run(array: Column, first: Column, n: int) -> list[Column]:
    """The n elements from index `first` (from 0) on, null outside the array. One look-up each: slices in lambdas copy the whole array for each place."""
    return [F.get(array, first + k) for k in range(n)]


def _let(value: Column, body) -> Column:
    """body(value), an array, with value made once."""
    return F.flatten(F.transform(F.array(value), body))


def _gram(hashes: Column, first: Column, n: int) -> Column:
    return F.xxhash64(*_run(hashes, first, n))


def _winnowed(hashes: Column) -> Column:
    """The places (from 1) of the first least gram of each SPAN grams in a row, from the hashes of the words.

    A gram is a number of its hash's high bits and its place, so that the least
    number of a stretch gives the least hash and where it stands first. A
    string holds fewer words than places have room for.
    """
    place = (1 << PLACE_BITS) - 1
    upto = lambda n: F.sequence(F.lit(0), F.size(hashes) - n)
    grams = F.transform(upto(GRAM), lambda i: _gram(hashes, i, GRAM).bitwiseAND(F.lit(~place)).bitwiseOR((i + 1).cast("long")))
    least = lambda a: F.array_distinct(F.transform(upto(WINDOW), lambda s: F.least(*_run(a, s, SPAN)).bitwiseAND(F.lit(place)).cast("int")))
    return F.when(F.size(hashes) >= WINDOW, _let(grams, least)).otherwise(F.array().cast("array<int>"))


def _entry(hashes: Column, place: Column, kind: int, n: int) -> Column:
    return F.struct(place.alias("place"), F.lit(kind).alias("kind"), _gram(hashes, place - 1, n).alias("hash"))


def _entries(hashes: Column, lengths: list[int]) -> Column:
    """(place, kind, hash): kind 0 for winnowed grams, and all grams of the lengths, which are their kinds."""

    def every(n: int) -> Column:
        of_length = F.transform(F.sequence(F.lit(1), F.size(hashes) - n + 1), lambda p: _entry(hashes, p, n, n))
        return F.when(F.size(hashes) >= n, of_length).otherwise(F.array().cast("array<struct<place:int,kind:int,hash:bigint>>"))

    return F.concat(F.transform(_winnowed(hashes), lambda p: _entry(hashes, p, 0, GRAM)), *map(every, lengths))


def _fingerprints(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows (with words) and `place`, `kind`, `hash`: kind 0 for winnowed grams, else the gram's length. A text without any has a row of nulls, which joins nothing."""
    # Made before they are exploded: explode then runs in generated code, which copies no words for each fingerprint.
    # The outer form, for Spark pushes a filter on the size of what a plain explode reads down to the text, and makes the words anew for each place.
    made = rows.withColumn("entries", _let(F.transform("words", lambda w: F.xxhash64(w)), lambda h: _entries(h, lengths)))
    return made.select(*rows.columns, F.explode_outer("entries").alias("e")).select(*rows.columns, "e.place", "e.kind", "e.hash")


def _context(words: Column, place: Column) -> tuple[list[Column], list[Column], list[Column]]:
    """The words before a gram, the nearest first, those of the gram and those after it."""
    around = WINDOW - GRAM
    return _run(words, place - 1 - around, around)[::-1], _run(words, place - 1, GRAM), _run(words, place - 1 + GRAM, around)


def item_fingerprints(items: DataFrame) -> DataFrame:
    """(hash, kind, item_id, before, gram, after): the fingerprints of benchmark items with the words around them, the nearest first, null outside the item."""
    rows = items.select("item_id", words_of(F.col("text")).alias("words"))
    before, gram, after = _context(F.col("words"), F.col("place"))
    long = _fingerprints(rows.where(F.size("words") >= WINDOW), []).select(
        "hash", "kind", "item_id", F.array(*before).alias("before"), F.array(*gram).alias("gram"), F.array(*after).alias("after")
    )
    none = F.array().cast("array<string>")
    short = rows.where(F.size("words").between(1, WINDOW - 1))
    # A short item is one gram: that of its own length.
    short = _fingerprints(short, list(range(1, WINDOW))).where(F.col("kind") == F.size("words"))
    short = short.select("hash", "kind", "item_id", none.alias("before"), F.col("words").alias("gram"), none.alias("after"))
    return long.unionByName(short).distinct()


def _agreeing(a: list[Column], b: Column) -> Column:
    """How many first words of a equal those of the array b; null equals nothing."""
    found = F.lit(len(a))
    for k in reversed(range(len(a))):
        found = F.when(F.coalesce(a[k] == F.get(b, F.lit(k)), F.lit(False)), found).otherwise(k)
    return found


def _extended(hits: DataFrame) -> DataFrame:
    """(k_id, k_text, item_id, start, stop) of the hits whose words agree over a whole window; places from 1, stop excluded."""
    words, place, size = F.col("words"), F.col("place"), F.size("gram")
    before, _, after = _context(words, place)
    left = F.when(F.col("kind") == 0, _agreeing(before, F.col("before"))).otherwise(0)
    right = F.when(F.col("kind") == 0, _agreeing(after, F.col("after"))).otherwise(0)
    # A gram holds GRAM words, or those of a short item.
    same = _agreeing(_run(words, place - 1, WINDOW - 1), F.col("gram")) >= size
    kept = hits.where(same).select("k_id", "k_text", "item_id", "kind", "place", size.alias("size"), left.alias("left"), right.alias("right"))
    kept = kept.where((F.col("kind") > 0) | (F.col("left") + F.col("right") + GRAM >= WINDOW))
    return kept.select("k_id", "k_text", "item_id", (place - F.col("left")).alias("start"), (place + F.col("size") + F.col("right")).alias("stop"))


def contaminated_runs(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(k_id, k_text, item_id, start, stop), repeated where anchors of a run agree: the document words that are in windows of an item."""
    prints = written(item_fingerprints(items), "item-prints")
    lengths = [r[0] for r in prints.where("kind > 0").select("kind").distinct().collect()]
    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), words_of(F.col("text")).alias("words"))
    anchors = _fingerprints(rows, sorted(lengths))
    if prints.count() <= broadcast_rows:
        return _extended(anchors.join(F.broadcast(prints), ["hash", "kind"]))
    # Too many to broadcast: anchors travel without words, and hits fetch the words of their documents.
    hits = anchors.drop("words").join(prints, ["hash", "kind"]).alias("h")
    once = rows.dropDuplicates(["k_id", "k_text"])
    both = hits.join(once.alias("o"), _same_row("h", "o"))
    return _extended(both.select("h.*", "o.words"))


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.k_id").eqNullSafe(F.col(f"{b}.k_id")) & F.col(f"{a}.k_text").eqNullSafe(F.col(f"{b}.k_text"))


def contamination(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, k_text, n_words, n_hit, item_ids), a row for each row of docs.

    n_hit counts the words inside windows of items, each once; item_ids has the
    ids (as strings, sorted) of the items with such windows. A null text has no
    words; items without words have no window; an item with a null id hits
    words but isn't listed. Rows that repeat id and text have the same result.
    Without documents there are no rows, without items no hits.
    """
    runs = contaminated_runs(docs, items, broadcast_rows).groupBy("k_id", "k_text").agg(
        F.collect_set(F.col("item_id").cast("string")).alias("item_ids"), F.collect_set(F.struct("start", "stop")).alias("runs")
    )
    union = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["stop"]).alias("end")
        ),
    )
    runs = written(runs.select("k_id", "k_text", F.array_sort("item_ids").alias("item_ids"), union["n"].cast("long").alias("n_hit")), "contaminated")
    base = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    both = base.alias("d").join(runs.alias("x"), _same_row("d", "x"), "left")
    return both.select(
        F.col("d.k_id").alias("doc_id"), "d.k_text", "d.n_words",
        F.coalesce("x.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("x.item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no window of an item."""
    dirty = written(contaminated_runs(docs, items).select("k_id", "k_text").distinct(), "contaminated-keys")
    full = docs.select(F.struct("*").alias("row"), *row_key(F.col("doc_id"), F.col("text"))).alias("d")
    return full.join(dirty.alias("x"), _same_row("d", "x"), "left_anti").select("row.*")
