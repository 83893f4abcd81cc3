"""Where a template vector lies in a longer crop: normalised cross-correlation over all offsets and scales.

Crops and templates of one label meet in groups of bounded size: a label's
templates are dealt out to blocks, its crops to parts, by the number of values
they hold, and each pair of block and part is one task's group. So a hot label
is a grid of tasks. In a group, windows of one length, and templates, are
matrices of rows of length 1 without their mean: a multiplication of two gives
their scores.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.config import DEFAULT, Config

#: Values that the crops, and the templates, of a group hold, roughly.
GROUP_VALUES = 1 << 17
#: Values of a matrix of windows or scores, and templates in one: small enough for a core's cache.
_CELLS = 1 << 19
_WIDE = 512
#: More than single precision is wrong by.
_ROOM = 2e-5
#: Energy of a window, as a part of that of its values, below which it counts as flat.
_FLAT = 1e-12
_FOUND = "vec_id {}, score double, template_id {}, scale double, at int"


def resized(values: np.ndarray, size: int) -> np.ndarray:
    """A vector in `size` cells of equal width, each the mean of what it covers."""
    if size == len(values):
        return values
    sums = np.r_[0.0, np.cumsum(values), values.sum()]
    edge = np.arange(size + 1) * len(values) / size
    whole = np.floor(edge).astype(int)
    up_to = sums[whole] + (edge - whole) * np.r_[values, 0.0][whole]
    return np.diff(up_to) * size / len(values)


def normed(rows: np.ndarray) -> np.ndarray:
    """Rows less their mean, of length 1; flat ones are 0."""
    centred = rows - rows.mean(axis=1, keepdims=True)
    power = np.einsum("ij,ij->i", centred, centred)
    flat = power <= _FLAT * np.einsum("ij,ij->i", rows, rows)
    return centred * np.where(flat, 0.0, 1.0 / np.sqrt(np.where(flat, 1.0, power)))[:, None]


def _by_length(vectors: list[np.ndarray]) -> dict[int, list[int]]:
    of: dict[int, list[int]] = defaultdict(list)
    for k, v in enumerate(vectors):
        of[len(v)].append(k)
    return of


def best_in_group(crops: list[np.ndarray], templates: list[np.ndarray], scales: tuple[float, ...], least: int) -> list[tuple[float, int, float, int] | None]:
    """(score, template, scale, offset) of the best match of each crop; None if nothing fits. Of equal scores the first scale, template and offset counts.

    All scores are made in single precision, those that may be a crop's best again in double.
    """
    best: list[tuple[float, int, float, int] | None] = [None] * len(crops)
    top = np.full(len(crops), -2.0)
    of_crops = _by_length(crops)
    for scale in scales:
        sizes = [max(1, int(np.rint(len(t) * scale))) for t in templates]
        of_templates: dict[int, list[int]] = defaultdict(list)
        for k, m in enumerate(sizes):
            if m >= least:
                of_templates[m].append(k)
        for m, cols in of_templates.items():
            shapes = normed(np.stack([resized(templates[k], m) for k in cols]))
            rough = shapes.astype(np.float32).T.copy()
            for n, rows in of_crops.items():
                if m > n:
                    continue
                at = n - m + 1
                held = max(1, _CELLS // (at * max(m, min(len(cols), _WIDE))))
                for i in range(0, len(rows), held):
                    some = np.array(rows[i : i + held])
                    windows = normed(sliding_window_view(np.stack([crops[k] for k in some]), m, axis=1).reshape(-1, m))
                    near = windows.astype(np.float32)
                    for j in range(0, len(cols), _WIDE):
                        most = (near @ rough[:, j : j + _WIDE]).max(axis=1).reshape(len(some), at)
                        asked = most >= np.maximum(top[some], most.max(axis=1) - _ROOM)[:, None] - _ROOM
                        places = np.flatnonzero(asked)
                        for part in np.array_split(places, -(-len(places) * _WIDE // _CELLS)) if len(places) else ():
                            scores = windows[part] @ shapes[j : j + _WIDE].T
                            for p, col, score in zip(part.tolist(), scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist(), strict=True):
                                k, found = int(some[p // at]), (score, cols[j + col], scale, p % at)
                                if best[k] is None or score > best[k][0] or (score == best[k][0] and scale == best[k][2] and found[1::2] < best[k][1::2]):
                                    best[k], top[k] = found, score
    return best


def _usable(name: str) -> Column:
    """Vectors with a value, and none that is null or no number."""
    return F.col(name).isNotNull() & (F.size(name) > 0) & ~F.exists(name, lambda x: x.isNull() | F.isnan(x))


def matches(crops: DataFrame, templates: DataFrame, scales: tuple[float, ...] = (1.0,), config: Config = DEFAULT) -> DataFrame:
    """(vec_id, score, template_id, scale, at): the best place of a template of its label in each crop that one fits.

    crops and templates are (vec_id, label, embedding). A template is tried at
    every offset of the crop, at each scale; one of fewer than config.vector_least
    values, once scaled, isn't, nor one longer than the crop. The score is the correlation of
    template and window, from -1 to 1; flat ones have 0. Null or empty vectors,
    those with a null or NaN in them, and null labels match nothing. Rows that repeat a vec_id
    give one match.
    """
    t = templates.where(_usable("embedding") & F.col("label").isNotNull()).select("label", F.col("vec_id").alias("template_id"), F.col("embedding").cast("array<double>").alias("values"))
    c = crops.where(_usable("embedding") & F.col("label").isNotNull()).select("label", "vec_id", F.col("embedding").cast("array<double>").alias("values"))
    groups = lambda rows, name: rows.groupBy("label").agg(F.ceil(F.sum(F.size("values")) / GROUP_VALUES).cast("int").alias(name))
    grid = groups(t, "blocks").join(groups(c, "parts"), "label")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Names of their own: both tables may come from one.
    label = F.col("label").alias("label")
    t = t.join(grid, "label").select(label, own("template_id", "blocks").alias("block"), every("parts").alias("part"), "template_id", "values")
    c = c.join(grid, "label").select(label, every("blocks").alias("block"), own("vec_id", "parts").alias("part"), "vec_id", "values")
    schema = _FOUND.format(crops.schema["vec_id"].dataType.simpleString(), templates.schema["vec_id"].dataType.simpleString())

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["template_id"]
        vectors = [[np.asarray(v.values) for v in side["values"].combine_chunks()] for side in (left, right)]
        # Templates in the order of their ids, so that ties don't depend on the order of rows.
        order = np.argsort(ids.to_numpy(), kind="stable") if len(ids) else []
        found = best_in_group(vectors[0], [vectors[1][k] for k in order], scales, config.vector_least)
        rows = [k for k, x in enumerate(found) if x is not None]
        kept = [found[k] for k in rows]
        return pa.table(
            {
                "vec_id": left["vec_id"].take(pa.array(rows, pa.int64())), "score": pa.array([x[0] for x in kept], pa.float64()), "template_id": ids.take(pa.array([int(order[x[1]]) for x in kept], pa.int64())),
                "scale": pa.array([x[2] for x in kept], pa.float64()), "at": pa.array([x[3] for x in kept], pa.int32()),
            }
        )

    keys = ("label", "block", "part")
    found = c.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInArrow(match, schema)
    best = F.max_by(F.struct("score", "template_id", "scale", "at"), F.struct(F.col("score"), -F.xxhash64("template_id", "scale", "at").cast("decimal(20)")))
    return found.groupBy("vec_id").agg(best.alias("b")).select("vec_id", "b.*")


def match_scores(crops: DataFrame, templates: DataFrame, scales: tuple[float, ...] = (1.0,), config: Config = DEFAULT, threshold: str | None = None) -> DataFrame:
    """(vec_id, score, status): the score of each crop's best match, to 4 places, and what it means.

    No template for the label, none that fits, below the threshold: each has its
    reason. threshold names a column of crops that overrides the configured one
    where it isn't null.
    """
    limit = F.coalesce(F.col(threshold), F.lit(config.vector_threshold)) if threshold else F.lit(config.vector_threshold)
    known = templates.where(_usable("embedding") & F.col("label").isNotNull()).select("label").distinct().withColumn("known", F.lit(True))
    rows = crops.groupBy("vec_id").agg(F.max(F.struct(limit.alias("limit"), F.col("label"))).alias("c")).select("vec_id", "c.*").join(known, "label", "left")
    rows = rows.join(matches(crops, templates, scales, config).select("vec_id", "score"), "vec_id", "left")
    status = (
        F.when(F.col("known").isNull(), "logo_template_missing").when(F.col("score").isNull(), "logo_template_larger_than_zone")
        .when(F.col("score") >= F.col("limit"), "OK").otherwise("logo_mismatch")
    )
    return rows.select("vec_id", F.round("score", 4).alias("score"), status.alias("status"))
