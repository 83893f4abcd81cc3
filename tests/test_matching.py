import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.config import DEFAULT
from proofmill.operators import matching

SMALL = dataclasses.replace(DEFAULT, vector_least=1)
ROW = "vec_id long, label int, embedding array<double>"


def plain(crops, templates, scales, least):
    """{vec_id: score} from every window of every crop."""
    best = {}
    for vec_id, label, v in crops:
        for _, other, t in templates:
            if v is None or t is None or label is None or label != other or None in v or None in t:
                continue
            for scale in scales:
                m = max(1, round(len(t) * scale))
                if m < least or m > len(v):
                    continue
                # Mean of each cell, from steps so fine that cells and values both are whole numbers of them.
                r = np.repeat(np.array(t), m).reshape(m, len(t)).mean(axis=1)
                for at in range(len(v) - m + 1):
                    w = np.array(v[at : at + m])
                    a, b = w - w.mean(), r - r.mean()
                    power = np.sqrt((a @ a) * (b @ b))
                    score = a @ b / power if power > 1e-9 else 0.0
                    best[vec_id] = max(best.get(vec_id, -2.0), score)
    return best


def test_a_short_template_is_found(spark):
    crops = spark.createDataFrame([(1, 1, [0.0, 1.0, 5.0, 2.0]), (2, 1, [7.0] * 5), (3, 1, [1.0]), (4, 2, [1.0, 2.0]), (5, None, [1.0, 2.0]), (6, 1, None), (7, 1, []), (8, 1, [1.0, None, 2.0, 3.0]), (9, 1, [1.0, float("nan"), 3.0])], ROW)
    templates = spark.createDataFrame([(10, 1, [1.0, 5.0, 2.0]), (11, None, [1.0]), (12, 1, None), (13, 2, [1.0, 2.0, 3.0]), (14, 3, [None, 1.0])], ROW)
    got = {r.vec_id: (r.score, r.status) for r in matching.match_scores(crops, templates, config=SMALL).collect()}
    larger, missing = (None, "logo_template_larger_than_zone"), (None, "logo_template_missing")
    assert got == {1: (1.0, "OK"), 2: (0.0, "logo_mismatch"), 3: larger, 4: larger, 5: missing, 6: larger, 7: larger, 8: larger, 9: larger}
    (found,) = matching.matches(crops.where("vec_id = 1"), templates, config=SMALL).collect()
    assert (found.template_id, found.scale, found["at"]) == (10, 1.0, 1)


@pytest.mark.parametrize("group", [1 << 20, 60])
def test_all_windows_and_scales(spark, monkeypatch, group):
    """Scores are those of all windows; a hot label is split into a grid of groups and gives the same."""
    monkeypatch.setattr(matching, "GROUP_VALUES", group)
    monkeypatch.setattr(matching, "_CELLS", 200)
    rng = np.random.default_rng(4)
    vector = lambda n: np.round(rng.normal(size=n), 3).tolist()
    crops = [(k, 1 if k % 3 else k % 5, vector(int(rng.integers(1, 40)))) for k in range(60)] + [(60, 1, [1.0] * 20), (61, 1, None)]
    templates = [(k, 1 if k % 3 else k % 5, vector(int(rng.integers(1, 30)))) for k in range(40)] + [(40, 1, [2.0] * 9), (41, 1, [None, 1.0])]
    scales = (0.6, 0.9, 1.0, 1.4)
    config = dataclasses.replace(DEFAULT, vector_least=4)
    got = {r.vec_id: r.score for r in matching.matches(spark.createDataFrame(crops, ROW), spark.createDataFrame(templates, ROW), scales, config).collect()}
    assert got == pytest.approx(plain(crops, templates, scales, 4))


def test_the_place_is_found(spark):
    rng = np.random.default_rng(5)
    crop = rng.normal(size=500)
    templates = [(7, 1, crop[123:160].tolist()), (3, 1, crop[123:160].tolist()), (8, 1, rng.normal(size=30).tolist())]
    (got,) = matching.matches(spark.createDataFrame([(1, 1, (3 * crop + 9).tolist())], ROW), spark.createDataFrame(templates, ROW), DEFAULT.vector_scales).collect()
    assert (got.template_id in (3, 7), got.scale, got["at"]) == (True, 1.0, 123)
    assert got.score == pytest.approx(1.0)


def test_resizing_keeps_the_mean():
    for n, m in ((10, 6), (10, 14), (7, 7), (9, 1)):
        v = np.random.default_rng(n).normal(size=n)
        assert matching.resized(v, m).mean() == pytest.approx(v.mean())
    assert matching.resized(np.array([1.0, 3.0]), 4).tolist() == [1.0, 1.0, 3.0, 3.0]


def test_thresholds_and_empty_tables(spark):
    crops = spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0, 1.0], 0.999), (2, 1, [1.0, 2.0, 3.0, 1.0], None)], ROW + ", least double")
    templates = spark.createDataFrame([(1, 1, [1.0, 2.0, 2.9, 1.2])], ROW)
    got = {r.vec_id: r.status for r in matching.match_scores(crops, templates, config=SMALL, threshold="least").collect()}
    assert got == {1: "logo_mismatch", 2: "OK"}
    assert matching.match_scores(crops.limit(0), templates).count() == 0
    assert {r.status for r in matching.match_scores(crops, templates.limit(0)).collect()} == {"logo_template_missing"}
    assert matching.match_scores(crops.withColumn("score", F.lit(1)), templates.withColumn("values", F.lit(1)), config=SMALL).count() == 2
