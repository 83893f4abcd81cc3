"""Exact dedup by distributed MSD radix partitioning.

A document is the byte string (length of the text, text). The first digit is
that length with the first bytes; further digits are the successive bytes, in
slices that grow eightfold. In each round the rows of a group are split by
their next digit; groups of one row and groups whose texts have ended leave.
Equal texts are equal byte by byte: no digest decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import lower_ascii, written

FIRST_BYTES = 64
GROWTH = 8


def level_bounds(longest: int) -> list[tuple[int, int]]:
    """(offset, width) of the digits that cover `longest` bytes."""
    bounds, offset, width = [], 0, FIRST_BYTES
    while offset < longest or not bounds:
        bounds.append((offset, width))
        offset, width = offset + width, width * GROWTH
    return bounds


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs.

    Texts are compared after lower-casing A-Z; a null text counts as empty. Of
    equal texts the row with the largest doc_id stays (a null id is the
    smallest). Rows that repeat both id and text are all members; exactly one
    of them stays. An empty table gives an empty result.
    """
    norm = lower_ascii(F.coalesce(F.col("text"), F.lit(""))).cast("binary")
    base = written(
        docs.select(F.col("doc_id").alias("doc_id"), norm.alias("bytes")).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "bytes", F.length("bytes").alias("size"), F.sha2("bytes", 256).alias("text_sha256")
        ),
        "radix-rows",
    )
    digit = F.substring("bytes", 1, FIRST_BYTES)
    first = base.select("row", "doc_id", "size", digit.alias("digit"))
    # One row for each (length, first bytes): its number of rows and its name, the smallest row.
    heads = first.groupBy("size", "digit").agg(F.count("*").alias("n"), F.min("row").alias("group"), F.max("doc_id").alias("keep_id"))
    # Written, so that the join deals out its own exchange and a hot group can be split.
    heads = written(heads.where("n > 1"), "radix-heads-0")
    members = written(first.join(heads, ["size", "digit"]).select("row", "doc_id", "group", "size"), "radix-level-0")
    done = members.where(F.col("size") <= FIRST_BYTES)
    active = members.where(F.col("size") > FIRST_BYTES)
    finished = [done]
    longest = active.agg(F.max("size")).first()[0]
    if longest:
        digits = _digits(base, active, longest)
        for level, (offset, width) in enumerate(level_bounds(longest)[1:], 1):
            step = active.select("row", "doc_id", "group", "size").join(digits.where(F.col("level") == level).select("row", "digit").hint("merge"), "row")
            split = step.groupBy("group", "digit").agg(F.count("*").alias("n"), F.min("row").alias("next")).where("n > 1")
            split = written(split, f"radix-heads-{level}")
            joined = step.join(split.hint("merge"), ["group", "digit"]).select("row", "doc_id", F.col("next").alias("group"), "size")
            members = written(joined, f"radix-level-{level}")
            finished.append(members.where(F.col("size") <= offset + width))
            active = members.where(F.col("size") > offset + width)
            if active.isEmpty():
                break
    groups = finished[0]
    for part in finished[1:]:
        groups = groups.unionByName(part)
    sizes = groups.groupBy("group").agg(
        F.count("*").alias("group_size"), F.max(F.struct(F.col("doc_id"), F.col("row"))).alias("last")
    )
    sizes = written(sizes, "radix-sizes")
    member = groups.join(sizes, "group").select("row", "group_size", "last")
    return (
        base.select("row", "doc_id", "text_sha256")
        .join(member, "row", "left")
        .select(
            "doc_id",
            F.when(F.col("last").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("last").isNull() | (F.col("last.row") == F.col("row"))).alias("kept"),
            "text_sha256",
        )
    )


def _digits(base: DataFrame, active: DataFrame, longest: int) -> DataFrame:
    """(row, level, digit) of the rows that are still in a group, a folder for each level, so that a round reads its own digits only."""
    bounds = level_bounds(longest)[1:]
    slices = [
        F.when(F.col("size") > offset, F.struct(F.lit(level).alias("level"), F.substring("bytes", offset + 1, width).alias("digit")))
        for level, (offset, width) in enumerate(bounds, 1)
    ]
    rest = base.join(active.select("row"), "row", "left_semi").select("row", F.explode(F.array_compact(F.array(*slices))).alias("d"))
    return written(rest.select("row", "d.level", "d.digit"), "radix-digits", partition_by="level")


def keep_one(docs: DataFrame) -> DataFrame:
    """The ids and digests of the documents that stay."""
    return duplicate_groups(docs).where("kept")
