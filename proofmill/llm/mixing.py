"""Mixing sources to target weights with a hypergeometric splitting tree.

Each source gets a target in words (weights, a cap on repeats, the excess
shared again). Its documents are cut into blocks in a seeded random order; whole
passes over the source and the blocks that a last, partial pass takes documents
of give its exact quota of blocks. The last pass takes documents in order while
they fit, then goes on with the smaller ones that still do; where these don't
reach, a longer one is exchanged for short ones. A binary tree over the output shards then splits the
vector of quotas: each node draws from the multivariate hypergeometric
distribution how many blocks of each source go left. A shard's quota is served
by the next blocks of the source's permutation, so that shards hold disjoint
blocks; rows are shuffled within their shard.

Documents and blocks stay in DataFrames. The driver holds a number per stratum
and shard. The MAX_STRATA largest sources are strata of the tree; smaller ones
share SHARED strata, by a hash: their blocks are dealt out together. Targets and
takes are those of each source in any case.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proofmill.llm.common import SPACES_RE, inline, written

SEED = 29
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Documents of a source are dealt into so many blocks, whatever its size.
BLOCKS = 512
#: Sources with quotas of their own in the tree, and strata that all others share.
MAX_STRATA = 100_000
SHARED = 1024
#: A miss of a last pass up to this share of it is near enough; above it, documents are exchanged.
NEAR = 0.001
#: Rounds over smaller documents go on while more than this share of a last pass is missing.
FILLED = 0.0001


def word_count(text: Column) -> Column:
    """The number of runs of characters other than white space; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES_RE))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, weigh `weights`, over and over.
    All targets together are all sizes; none exceeds max_repeats times its
    source's size. Sources are sorted by cap per weight: the capped ones are a
    prefix, the rest share what is left by weight.
    """
    last = F.col("source").isNull()
    place = F.row_number().over(W.orderBy(last, "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int") + 1).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    order = W.orderBy(F.col("cap") / F.col("weight"), last, "source")
    everything = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("level", left / rest).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # The level of the first source below its cap holds for all that follow.
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return rows.select("source", "source_size", target.alias("target"))


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Quotas of each shard. Every level of the tree halves the shards; a node's blocks are dealt to both sides in proportion to their shards."""
    rng = np.random.default_rng(seed)

    def descend(node: np.ndarray, width: int) -> list[np.ndarray]:
        if width == 1:
            return [node]
        half = width // 2
        total = int(node.sum())
        left = rng.multivariate_hypergeometric(node, total * half // width, method="marginals")
        return descend(left, half) + descend(node - left, width - half)

    return [[int(x) for x in part] for part in descend(np.asarray(quotas, dtype=np.int64), shards)]


def mix(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """(row, pass, shard, place): a row for each copy of a document that the mix takes; `row` packs the whole row of docs.

    Partitions hold parts of shards, in the order of `place`: the shuffle of
    a shard. A null text has no words; a null source is a source of its own.
    Documents without words are taken in the whole passes, at a size of 0.
    Rows that repeat an id are documents of their own. Reruns draw the same
    mix. No rows give none.
    """
    takes = plan(docs, shards, seed).where("pass is not null").select("k_id", "k_hash", "pass", "shard", "place").alias("t")
    full = docs.select(F.struct("*").alias("row"), *_keys(seed)).alias("d")
    both = full.join(takes, F.col("d.k_id").eqNullSafe(F.col("t.k_id")) & (F.col("d.k_hash") == F.col("t.k_hash")))
    both = both.select("d.row", "t.pass", "t.shard", "t.place")
    return both.repartition("shard", F.pmod("place", F.lit(BLOCKS))).sortWithinPartitions("shard", "place")


def _keys(seed: int) -> list[Column]:
    """Id and seeded hash of a row: its place in every permutation."""
    return [F.col("doc_id").alias("k_id"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text")).alias("k_hash")]


def plan(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """(k_id, k_hash, copies, source, size, source_size, target, pass, shard, place): the mix without the rows themselves, one row for each different row of docs and pass. `copies` rows of docs are alike in id, source and text; they are taken together."""
    spark = docs.sparkSession
    rows = docs.select(*_keys(seed), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = rows.groupBy("k_id", "k_hash", "source", "size").agg(F.count("*").alias("copies"))
    rows = written(rows.withColumn("block", F.pmod(F.shiftrightunsigned("k_hash", 20), F.lit(BLOCKS)).cast("int")), "mix-rows")
    blocks = rows.groupBy("source", "block").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    blocks = written(blocks, "mix-blocks")
    targets = source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    targets = targets.withColumn("passes", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).cast("int"))
    largest = F.row_number().over(W.orderBy(F.desc("source_size"), F.col("source").asc_nulls_last()))
    name = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("source "), F.col("source")))
    shared = F.concat(F.lit("shared "), F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(SHARED)).cast("string"))
    targets = targets.withColumn("stratum", F.when(largest <= MAX_STRATA, name).otherwise(shared))
    targets = targets.withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    targets = written(targets, "mix-targets")

    docs_of = _with_source(rows, targets.select("source", "passes", "rest")).withColumn("weight", F.col("size") * F.col("copies"))
    marked = _last_pass(docs_of)
    # Slots: a row for each pass and block that the quota holds.
    whole = _with_source(blocks, targets.select("source", "passes")).where("passes > 0")
    whole = whole.select("source", "block", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    slots = whole.unionByName(marked.where("last").select("source", "block", F.col("passes").alias("pass")).distinct())
    permuted = W.partitionBy("stratum").orderBy("pass", F.xxhash64(F.lit(seed), "source", "pass", "block"), "source", "block")
    slots = _with_source(slots, targets.select("source", "stratum"))
    slots = written(slots.withColumn("nth", F.row_number().over(permuted) - 1).select("source", "stratum", "block", "pass", "nth"), "mix-slots")

    quotas = sorted((r["stratum"], r["n"]) for r in slots.groupBy("stratum").agg(F.count("*").alias("n")).collect())
    spans = []
    start = [0] * len(quotas)
    for shard, part in enumerate(split_quotas([n for _, n in quotas], shards, seed) if quotas else []):
        for k, n in enumerate(part):
            if n:
                spans.append((quotas[k][0], shard, start[k], start[k] + n))
                start[k] += n
    table = inline(spark, spans, "stratum string, shard int, first bigint, stop bigint")
    # A slot's shard is the span that its place in the permutation falls into.
    dealt = slots.alias("l").join(table.alias("r"), (F.col("l.stratum") == F.col("r.stratum")) & F.col("l.nth").between(F.col("r.first"), F.col("r.stop") - 1))
    dealt = dealt.select("l.source", "l.block", "l.pass", "r.shard")

    keys = [F.col("l.source").eqNullSafe(F.col("r.source")), F.col("l.block") == F.col("r.block")]
    every = marked.alias("l").join(dealt.alias("r"), keys, "left").select("l.*", "r.pass", "r.shard")
    takes = (F.col("pass") < F.col("passes")) | F.col("last")
    # A document that no pass takes keeps a row without a pass.
    every = every.where("pass is null or pass = 0 or pass < passes or last").withColumn("pass", F.when(takes, F.col("pass"))).withColumn("shard", F.when(F.col("pass").isNotNull(), F.col("shard")))
    every = every.drop("block", "passes", "rest", "weight", "last")
    every = every.withColumn("place", F.when(F.col("pass").isNotNull(), F.xxhash64(F.lit(seed + 1), "k_hash", "pass")))
    return _with_source(every, targets.select("source", "source_size", "target"))


def _picked(docs: DataFrame) -> DataFrame:
    """docs with `last`: whether a document of at most `gap` words is among the first of its source, by (block, k_hash, k_id), that `gap` holds together. Prefix sums are taken within blocks, then over blocks."""
    fits = F.when(F.col("weight") <= F.col("gap"), F.col("weight")).otherwise(0)
    inside = W.partitionBy("source", "block").orderBy("k_hash", "k_id").rowsBetween(W.unboundedPreceding, 0)
    over = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = docs.groupBy("source", "block").agg(F.sum(fits).alias("words"))
    sums = sums.select("source", "block", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("before"))
    local = docs.withColumn("running", F.sum(fits).over(inside))
    both = local.alias("l").join(sums.alias("r"), [F.col("l.source").eqNullSafe(F.col("r.source")), F.col("l.block") == F.col("r.block")])
    last = (F.col("l.weight") <= F.col("l.gap")) & (F.col("r.before") + F.col("l.running") <= F.col("l.gap"))
    return both.select("l.*", last.alias("last")).drop("running")


def _toggled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with `last` turned over for the documents of found."""
    keys = [F.col("l.k_id").eqNullSafe(F.col("r.k_id")), F.col("l.k_hash") == F.col("r.k_hash")]
    both = rows.alias("l").join(found.select("k_id", "k_hash", F.lit(True).alias("found")).alias("r"), keys, "left")
    return both.select(*[f"l.{c}" for c in rows.columns if c != "last"], (F.col("l.last") != F.col("r.found").isNotNull()).alias("last"))


def _filled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (with the `gap` of their source) with `last`, whether they fill it, and (source, gap), what is missing then.

    Documents above the gap are set aside; the others are taken in order as
    long as the gap holds them. What is still missing is less than the next
    document: rounds follow over the documents that are left and below the
    power of two under the gap. Each either takes all of them or leaves a gap
    below that power, so there are at most log2(1 / FILLED) rounds; a source
    whose gap is a FILLED part of its first one takes no part in them, so that
    large sources need none.
    """
    names = ["k_id", "k_hash", "source", "block", "weight"]
    picked = written(_picked(docs), "mix-picked")
    missing = F.first("gap") - F.sum(F.when(F.col("last"), F.col("weight")).otherwise(0))
    gaps = written(picked.groupBy("source").agg(missing.alias("gap"), (F.first("gap") * FILLED).alias("near")), "mix-gaps")
    first, more = picked.drop("gap"), []
    while True:
        open_gaps = gaps.where("gap >= 1 and gap > near").drop("near")
        if open_gaps.isEmpty():
            break
        below = F.pow(F.lit(2.0), F.length(F.bin(F.floor("gap").cast("long"))) - 1)
        left = _with_source(picked.where("not last and weight > 0").select(*names), open_gaps).where(F.col("weight") < below)
        picked = written(_picked(left), "mix-round")
        if picked.isEmpty():
            break
        more.append(picked.where("last").select(*names))
        taken = picked.where("last").groupBy("source").agg(F.sum("weight").alias("taken"))
        both = gaps.alias("l").join(taken.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")), "left")
        gaps = written(both.select("l.source", (F.col("l.gap") - F.coalesce("r.taken", F.lit(0))).alias("gap"), "l.near"), "mix-gaps")
    gaps = gaps.drop("near")
    return written(_toggled(first, reduce(DataFrame.unionByName, more)), "mix-marked") if more else first, gaps


def _last_pass(docs: DataFrame) -> DataFrame:
    """docs (k_id, k_hash, source, block, weight, rest and more) with `last`: whether the last, partial pass takes them.

    Where all short documents don't reach the rest, the shortest of the long
    ones comes in and short ones of the same length in all go out. The
    document whose size is nearest to what is missing then closes the gap.
    """
    marked, gaps = _filled(docs.withColumn("gap", F.col("rest")))
    keys = ["k_id", "k_hash", "source", "block", "weight"]
    near = _with_source(marked.where("not last").select(*keys, "rest"), gaps).withColumn("off", F.abs(F.col("gap") - F.col("weight")))
    longer = F.when(F.col("weight") > F.col("gap"), F.col("weight"))
    swaps = near.groupBy("source").agg(
        F.least(F.first("gap"), F.min("off")).alias("miss"), (F.min(longer) - F.first("gap")).alias("over"), F.first("rest").alias("rest"),
        F.min_by(F.struct("k_id", "k_hash"), F.when(F.col("weight") > F.col("gap"), F.struct("weight", "k_hash", "k_id"))).alias("b"),
    )
    swaps = written(swaps.where((F.col("miss") > F.col("rest") * NEAR) & F.col("over").isNotNull()).select("source", "miss", "over", "b.*"), "mix-swaps")
    if not swaps.isEmpty():
        held = _with_source(marked.where("last and weight > 0").select(*keys), swaps.select("source", F.col("over").alias("gap")))
        out, over = _filled(held)
        same = F.col("l.source").eqNullSafe(F.col("r.source"))
        good = swaps.alias("l").join(over.alias("r"), same).where("r.gap < l.miss").select("l.source", "l.k_id", "l.k_hash", (-F.col("r.gap")).alias("gap"))
        good = written(good, "mix-swapped")
        gone = out.where("last").alias("l").join(good.alias("r"), same, "left_semi").select("k_id", "k_hash")
        marked = written(_toggled(marked, gone.unionByName(good.select("k_id", "k_hash"))), "mix-marked")
        both = gaps.alias("l").join(good.alias("r"), same, "left")
        gaps = written(both.select("l.source", F.coalesce("r.gap", "l.gap").alias("gap")), "mix-gaps")
    near = _with_source(marked.where("not last").select(*keys), gaps).withColumn("off", F.abs(F.col("gap") - F.col("weight"))).where("off < gap")
    return _toggled(marked, written(near.groupBy("source").agg(F.min_by(F.struct("k_id", "k_hash"), F.struct("off", "k_hash", "k_id")).alias("b")).select("b.*"), "mix-closing"))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    both = rows.alias("l").join(sources.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")))
    return both.select("l.*", *[f"r.{c}" for c in sources.columns if c != "source"])


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards), a row for each row of docs; shards has the shard of each time that it is taken, comma-joined."""
    shards = F.array_join(F.transform(F.array_sort(F.collect_list("shard")), lambda s: s.cast("string")), ",")
    each = plan(docs).groupBy("k_id", "k_hash", "copies", "size", "source_size", "target").agg((F.count("pass") * F.first("size")).alias("taken"), shards.alias("shards"))
    rows = each.select(F.explode(F.sequence(F.lit(1), F.col("copies"))), F.col("k_id").alias("doc_id"), "size", "source_size", "target", "taken", "shards")
    return rows.drop("col")
