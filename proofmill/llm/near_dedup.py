"""SimHash near-dedup: exact Hamming pairs through vantage-point trees.

Fingerprints that differ in at most `bits` bits are linked, and the connected
components of all links are the classes. 64-bit fingerprints are cut into four
slices of 16 bits; two fingerprints within 4 bits are within 1 bit in two slices
at least. For each slice but the last a vantage-point tree is grown on a bounded
sample: a node sends what lies within its radius of its vantage point to one
side, the rest to the other. A fingerprint has one home leaf in a tree; by the
triangle inequality it must visit another branch only if it is within the
tolerance of that branch's bound, so leaves hold homes and the visitors of the
overlapping boundaries. In a leaf all 64 bits are compared.

A leaf with too many homes is split again: trees over the slices behind its own
are grown on a sample of that leaf, and its rows go down those. No pair is lost:
the first slice that agrees has another one behind it. So leaves stay small when
the corpus grows beyond what one sample can split.

Equal fingerprints are one node from the start, leaves emit a forest instead of
pairs, and leaves above LEAF_ROWS are compared as a grid of parts, so that no
task holds a hot group.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from proofmill.llm.common import forget, row_key, written

SHINGLE = 4
BITS = 4
SEED = 42
PROJECTIONS = 4
WIDTH = 16
#: Fingerprints that the first trees, and those of a large leaf, are grown on.
SAMPLE = 40_000
LEAF_SAMPLE = 4_000
#: Homes that a leaf should have, and those above which it is split again.
LEAF_HOMES = 2_000
LARGE_HOMES = 8_000
#: Rows of one side of a comparison in one task.
LEAF_ROWS = 16_000
_SLICE = 1 << 15


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8. No words: 0."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: 1 - shingle].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts)
        )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
    return pa.array(found.view(np.int64))


def fingerprints(text: Column) -> Column:
    """The fingerprint as a signed 64-bit number; a null or blank text has 0."""
    return _fingerprints(text.cast("binary"))


# --- vantage-point trees -------------------------------------------------


def projection(values: np.ndarray, k: int) -> np.ndarray:
    return ((values.view(np.uint64) >> np.uint64(WIDTH * k)) & np.uint64((1 << WIDTH) - 1)).astype(np.uint16)


def grow(sample: np.ndarray, leaf: float, tolerance: int, seed: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inside, outside); a child below 0 is leaf -child - 1."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def split(points: np.ndarray) -> int:
        nonlocal leaves
        best = None
        if len(points) > leaf:
            for v in rng.choice(points, min(12, len(points))):
                d = np.bitwise_count(points ^ v)
                r = int(np.median(d))
                for radius in (r - 1, r):
                    inside = np.count_nonzero(d <= radius) / len(points)
                    edge = np.count_nonzero((d > radius - tolerance) & (d <= radius + tolerance)) / len(points)
                    if 0 < inside < 1 and (best is None or abs(inside - 0.5) + edge < best[0]):
                        best = (abs(inside - 0.5) + edge, int(v), radius)
        if best is None:
            leaves += 1
            return -leaves
        _, vantage, radius = best
        at = len(nodes)
        nodes.append((vantage, radius, 0, 0))
        near = np.bitwise_count(points ^ np.uint16(vantage)) <= radius
        inside, outside = split(points[near]), split(points[~near])
        nodes[at] = (vantage, radius, inside, outside)
        return at

    split(sample)
    return nodes


def route(nodes: list[tuple[int, int, int, int]], points: np.ndarray, tolerance: int, home: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indices of points, whether at home) for every leaf that points reach; those that aren't at home from the start visit only."""
    todo = [(0 if nodes else -1, np.arange(len(points)), np.ones(len(points), dtype=bool) if home is None else home)]
    while todo:
        at, rows, home = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -at - 1, rows, home
            continue
        vantage, radius, inside, outside = nodes[at]
        d = np.bitwise_count(points[rows] ^ np.uint16(vantage)).astype(np.int16)
        # Pairs over the boundary meet inside: homes there stay, those outside visit.
        go_in = d <= radius + tolerance
        go_out = np.where(home, d > radius, d > radius - tolerance)
        todo.append((inside, rows[go_in], home[go_in] & (d[go_in] <= radius)))
        todo.append((outside, rows[go_out], home[go_out]))


def forest(homes: np.ndarray, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the links between homes and queries; nodes that stand alone are left out."""
    nodes = np.unique(np.concatenate([homes, queries]))
    label = np.arange(len(nodes))
    at_home, at_query = np.searchsorted(nodes, homes), np.searchsorted(nodes, queries)
    rows = max(1, (1 << 21) // max(1, len(homes)))
    for start in range(0, len(queries), rows):
        part = queries[start : start + rows, None] ^ homes[None, :]
        q, h = np.nonzero(np.bitwise_count(part.view(np.uint64)) <= bits)
        u, v = at_query[start + q], at_home[h]
        u, v = u[u != v], v[u != v]
        while len(u):
            a, b = label[u], label[v]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
            open_ = label[u] != label[v]
            u, v = u[open_], v[open_]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _grown(sample: np.ndarray, homes: int, slices: range, tolerance: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """A tree over each slice, with leaves of about LEAF_HOMES of the homes that sample stands for."""
    leaf = max(8.0, LEAF_HOMES * len(sample) / max(homes, 1))
    return {k: grow(projection(sample, k), leaf, tolerance, k) for k in slices}


def _placed(nodes: DataFrame, n: int, tolerance: int) -> DataFrame:
    """(leaf, sub, home, fp): the leaves that the fingerprints reach; a leaf is a slice and its number there, sub is 0."""
    share = min(1.0, SAMPLE / max(n, 1))
    picked = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow()
    sample = np.sort(picked["fp"].to_numpy().astype(np.int64))
    shared = nodes.sparkSession.sparkContext.broadcast(_grown(sample, n, range(PROJECTIONS - 1), tolerance))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, tree in shared.value.items():
                for at, rows, home in route(tree, projection(values, k), tolerance):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), (k << _LEAF_BITS) + at)), pa.array(np.zeros(len(rows), np.int64)), pa.array(home), pa.array(values[rows])],
                        ["leaf", "sub", "home", "fp"],
                    )

    return written(nodes.select("fp").mapInArrow(place, _PLACED), "vp-leaves")


def _split(placed: DataFrame, tolerance: int) -> DataFrame:
    """placed, with the rows of large leaves sent down trees of the slices behind the leaf's own, grown on samples of the leaf. `sub` is a slice and the number of the smaller leaf, from 1."""
    sizes = placed.groupBy("leaf").agg(F.count_if("home").alias("homes"), F.count("*").alias("rows")).where(F.col("homes") > LARGE_HOMES)
    sizes = written(sizes.withColumn("parts", F.ceil(F.col("rows") / LEAF_ROWS).cast("int")), "vp-large")
    if sizes.isEmpty():
        return placed
    large = placed.join(sizes, "leaf")
    share = F.lit(LEAF_SAMPLE) / F.col("homes") * (1 << 30)
    sample = large.where(F.col("home") & (F.pmod(F.xxhash64(F.lit(5), "fp"), F.lit(1 << 30)) < share)).select("leaf", "homes", "fp")

    def behind(leaf: int) -> range:
        return range((leaf >> _LEAF_BITS) + 1, PROJECTIONS)

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = int(pdf["leaf"].iloc[0])
        trees = _grown(np.sort(pdf["fp"].to_numpy()), int(pdf["homes"].iloc[0]), behind(leaf), tolerance)
        return pd.DataFrame({"leaf": [leaf], "trees": [json.dumps(trees)]})

    trees = written(sample.groupBy("leaf").applyInPandas(plant, "leaf long, trees string"), "vp-trees")
    parts = sizes.join(trees, "leaf", "left").select("leaf", F.coalesce("trees", F.lit("")).alias("trees"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def send(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        values, home = rows["fp"].to_numpy(), rows["home"].to_numpy()
        leaf, found = int(rows["leaf"].iloc[0]), []
        # A leaf whose sample is empty, by chance, has trees of one leaf.
        trees = json.loads(tree["trees"].iloc[0] or "{}")
        for k in behind(leaf):
            for at, reached, stays in route(trees.get(str(k), []), projection(values, k), tolerance, home):
                found.append(pd.DataFrame({"leaf": leaf, "sub": (k << _LEAF_BITS) + at + 1, "home": stays, "fp": values[reached]}))
        return pd.concat(found)

    rows = large.select("leaf", F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("parts")).cast("int").alias("part"), "home", "fp")
    sent = rows.groupBy("leaf", "part").cogroup(parts.groupBy("leaf", "part")).applyInPandas(send, _PLACED)
    return written(placed.join(sizes.select("leaf"), "leaf", "left_anti").unionByName(sent), "vp-leaves")


_LEAF_BITS = 24
_PLACED = "leaf long, sub long, home boolean, fp long"


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b), a > b: edges whose components are those of all pairs of `fp` of nodes (distinct 64-bit numbers) within `bits` bits."""
    # Of the slices of a pair the second best differs in no more bits than this.
    tolerance = bits // (PROJECTIONS - 1)
    placed = _split(_placed(nodes, nodes.count(), tolerance), tolerance)
    # A leaf is a grid of parts of homes against parts of all its rows.
    sizes = placed.groupBy("leaf", "sub").agg(F.count_if("home").alias("homes"), F.count("*").alias("rows")).where("homes > 0 and rows > 1")
    grid = sizes.select("leaf", "sub", F.ceil(F.col("homes") / LEAF_ROWS).cast("int").alias("h"), F.ceil(F.col("rows") / LEAF_ROWS).cast("int").alias("q"))
    # Written, so that the join deals out its own exchange, and a hot leaf can be split.
    cells = placed.join(written(grid, "vp-grid"), ["leaf", "sub"])
    part = lambda n: F.pmod(F.xxhash64(F.lit(7), F.col("fp")), n).cast("int")
    as_home = cells.where("home").select("leaf", "sub", part(F.col("h")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), F.lit(True).alias("home"), "fp")
    as_query = cells.select("leaf", "sub", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("i"), part(F.col("q")).alias("j"), F.lit(False).alias("home"), "fp")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf["home"].to_numpy()
        fps = pdf["fp"].to_numpy()
        a, b = forest(fps[home], fps[~home], bits)
        return pd.DataFrame({"a": a, "b": b})

    return as_home.unionByName(as_query).groupBy("leaf", "sub", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for all nodes of edges (a, b) but the roots.

    Alternating large-star and small-star rounds, each cut off by a written
    table. The least neighbours are written before they are joined: both sides
    then have exchanges of their own, and a hub's rows can be split.
    """
    edges = written(edges.select("a", "b"), "cc-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "cc-low")
        large = written(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        joined = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(least.select("a", F.col("m").alias("b")).unionByName(joined).distinct(), "cc-edges")
        for old in (edges, low, large, least):
            forget(old)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(now)


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, k_text, fp, root, component_id), a row for each row of docs.

    fp is the signed fingerprint, root the class (its smallest fp),
    component_id the smallest doc_id of the documents that links reach. Texts
    without words share fingerprint 0 and are linked like others. Null ids are
    never the smallest; a component of null ids only has a null id. An empty
    table gives no rows.
    """
    id_, text = row_key(F.col("doc_id"), F.col("text"))
    rows = written(docs.select(id_.alias("doc_id"), text, fingerprints(F.col("text")).alias("fp")), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), bits))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written, so that the joins deal out their own exchanges, and a hot class or fingerprint can be split.
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = written(named.select("fp", "root").join(least, "root"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "k_text", "fp", "root", "component_id")


def keep_one(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of docs, with all columns, of each class: that with the smallest doc_id (null ids last). Of rows that repeat its id and text any one stays."""
    classes = written(near_duplicates(docs, bits).select("doc_id", "k_text", "root"), "simhash-classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("k_id"), "k_text")).alias("w")
    winners = written(classes.groupBy("root").agg(first).select(*_named("w.k_id", "w.k_text")), "simhash-winners")
    names = ["k_none", "k_name", "k_text"]
    full = docs.select(F.struct("*").alias("row"), *row_key(F.col("doc_id"), F.col("text"))).select("row", *_named("k_id", "k_text"))
    # Grouped by the keys of the join, whose order and partitions it takes over.
    return full.join(winners, names, "left_semi").groupBy(*names).agg(F.first("row").alias("row")).select("row.*")


def _named(k_id: str, k_text: str) -> list[Column]:
    """Keys of a row that are never null."""
    return [F.col(k_id).isNull().alias("k_none"), F.coalesce(F.col(k_id).cast("string"), F.lit("")).alias("k_name"), F.col(k_text).alias("k_text")]
