"""Line dedup in DataFrame functions: lines that many documents share go.

Lines are exploded with their positions; the key of a line (outer white space
off, A-Z lower-cased) is hashed to 128 bits; a hash is counted once for each
document; the dropped positions go back to the documents, which put the other
lines together in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import SPACES, lower_ascii, row_key, written

MIN_CHARS = 1
MIN_DOCS = 10


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _line_hashes(text: Column, min_chars: int) -> Column:
    """A 128-bit hash for each line, null where the key is too short to count."""
    keys = F.split(lower_ascii(text), "\n")

    def one(line: Column) -> Column:
        key = F.btrim(line, F.lit(SPACES))
        return F.when(F.length(key) >= min_chars, _hashes(key))

    return F.transform(keys, one)


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text), a row for each row of docs.

    A null or empty text is one empty line. Keys shorter than min_chars code
    points never count. A document holds a key once, however often the line
    stands in it. Rows with the same id are one document in this count; each
    row with a null id is one of its own. A document that loses all its lines
    has an empty text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = written(
        docs.select(*row_key(F.col("doc_id"), F.col("text")), F.monotonically_increasing_id().alias("row"), text.alias("text")).select(
            "k_id", "k_text", "row", _line_hashes(F.col("text"), min_chars).alias("hashes")
        ),
        "line-hashes",
    )
    # Pairs of document and line first, then the lines: a hot line, or a hot id, spreads over the tasks.
    own = F.when(F.col("k_id").isNull(), F.col("row")).alias("own")
    held = lines.select("k_id", own, F.explode(F.array_distinct(F.array_compact("hashes"))).alias("h")).dropDuplicates(["k_id", "own", "h"])
    # Written, so that the join below deals out its own exchange and a hot line can be split.
    common = written(held.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h"), "line-common")
    # The positions of a repeated row are those of its first: each (id, text) asks once.
    once = lines.groupBy("k_id", "k_text").agg(F.min("row").alias("row"))
    asks = lines.join(once.select("row"), "row", "left_semi").select("k_id", "k_text", F.posexplode("hashes").alias("pos", "h")).where("h is not null")
    dropped = asks.join(common, "h").groupBy("k_id", "k_text").agg(F.collect_list("pos").alias("positions"))
    base = docs.select(*row_key(F.col("doc_id"), F.col("text")), text.alias("text"))
    both = base.alias("d").join(
        dropped.alias("x"), F.col("d.k_id").eqNullSafe(F.col("x.k_id")) & (F.col("d.k_text") == F.col("x.k_text")), "left"
    )
    both = both.select(F.col("d.k_id").alias("doc_id"), F.split("d.text", "\n").alias("lines"), F.col("x.positions").alias("positions"))
    gone = F.col("positions")
    # One pass over the lines: a map from position to nothing answers membership.
    kept = F.when(gone.isNull(), F.col("lines")).otherwise(
        F.transform(
            F.filter(F.arrays_zip(F.col("lines").alias("line"), _marks(gone, F.size("lines")).alias("out")), lambda x: ~x["out"]),
            lambda x: x["line"],
        )
    )
    return both.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("text"),
    )


def _marks(positions: Column, n: Column) -> Column:
    """n booleans, true at the positions, from the gaps between sorted positions: linear in n."""
    ends = F.concat(F.array(F.lit(-1)), F.array_sort(positions))
    runs = F.transform(
        F.sequence(F.lit(1), F.size(ends) - 1),
        lambda i: F.concat(
            F.array_repeat(F.lit(False), F.element_at(ends, i + 1) - F.element_at(ends, i) - 1), F.array(F.lit(True))
        ),
    )
    tail = F.array_repeat(F.lit(False), n - F.element_at(ends, -1) - 1)
    return F.concat(F.flatten(runs), tail)
