"""Ranks within hot keys, ordered differences, and placeholders that pair from the left."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofmill.config import PLACEHOLDERS
from proofmill.functions import compare as C
from proofmill.functions import text as T
from proofmill.operators import manifest as M
from proofmill.operators import reports as O
from proofmill.operators.ranks import with_ranks


def test_ranks_of_a_hot_key(spark):
    """A key that holds nearly all rows reaches over all ranges; each range's rows are ranked apart."""
    rng = random.Random(2)
    rows = [(1 if rng.random() < 0.9 else rng.randint(2, 30), rng.randint(0, 10**6), "x") for _ in range(5000)] + [(None, k, "x") for k in range(300)] + [(7, None, "x")]
    table = spark.createDataFrame(rows, "k int, v int, nth string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_ranks(table, ("k",), [F.col("v")])
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.columns == ["k", "v", "nth", "rank"]
    expected = {}
    for k, v, _ in rows:
        expected.setdefault(k, []).append(v)
    for k, values in expected.items():
        mine = sorted(((r.rank, r.v) for r in got if r.k == k))
        assert [at for at, _ in mine] == list(range(len(values)))
        assert [v for _, v in mine] == sorted(values, key=lambda v: (v is not None, v))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_number" in line]
    assert windows and all("range#" in line.split("windowspecdefinition")[1] for line in windows)


def test_ranked_operators_on_odd_rows(spark):
    rows = spark.createDataFrame([(None, 3), (1, 5), (1, None), (1, 4)], "session_id long, idx long")
    assert sorted((str(r.session_id), str(r.idx), r.chunk) for r in M.batches(rows, ("session_id",), F.col("idx")).collect()) == [("1", "4", 0), ("1", "5", 0), ("1", "None", 0), ("None", "3", 0)]
    done = O.progress(rows.withColumn("total", F.lit(2).cast("long"))).collect()
    assert sorted((str(r.session_id), str(r.idx), r.done, r.percent) for r in done) == [("1", "4", 2, 100), ("1", "5", 2, 100), ("1", "None", 1, 50), ("None", "3", 1, 50)]
    assert M.batches(rows.limit(0), ("session_id",), F.col("idx")).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40))
def test_alignments_are_longest(a, b):
    kept = C.aligned(a, b)
    assert all(a[i] == b[k] for i, k in kept)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(kept, kept[1:]))
    assert len(kept) == lcs(a, b)


def test_ordered_differences(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30))) for _ in range(80)]
    long = [f"w{rng.randint(0, 4000)}" for _ in range(6000)]
    moved = long[3000:] + long[:3000]
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(texts[::2], texts[1::2]))] + [(900, None, "a b"), (901, "a b", None), (902, None, ""), (903, "same", "SAME"), (904, " ".join(long), " ".join(moved))]
    out = C.ordered_differences(spark.createDataFrame(rows, "zone_id long, text string, ref string"))
    got = {r.zone_id: (r.tokens, r.ops, r.p) for r in out.withColumn("p", C.patched(F.col("tokens"), F.col("ops"))).collect()}
    for k, a, b in rows:
        x, y = (a or "").lower().split(), (b or "").lower().split()
        if x == y:
            assert k not in got
            continue
        tokens, ops, patched = got[k]
        assert tokens == x
        assert patched == y
        gone = {o.position for o in ops if o.op == "del"}
        assert all(o.token == (x if o.op == "del" else y)[o.position] for o in ops)
        kept = [t for i, t in enumerate(x) if i not in gone]
        added = {o.position for o in ops if o.op == "add"}
        assert kept == [t for i, t in enumerate(y) if i not in added]
        if k < 900:
            assert len(ops) == len(x) + len(y) - 2 * lcs(x, y)
    assert len(got[904][1]) <= 6000


def paired(text):
    for pattern in (r"%([^%]+)%", r"\[([^\]]+)\]", r"<([^>]+)>"):
        text = re.sub(pattern, lambda m: " " if m[1].strip().lower() in PLACEHOLDERS else m[0], text)
    return text


def test_placeholders_pair_from_the_left(spark):
    rng = random.Random(6)
    parts = ["%", "%", "[", "]", "<", ">", " ", "skin", "Date", "x", "50", "\n", "%skin%", "[ first_name ]", "%%"]
    texts = ["50% x %skin%", "%skin%", None, "", "no marks", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.p for r in rows.select("t", T.remove_paired_placeholders("t").alias("p")).collect()}
    assert got == {t: paired(t or "") for t in texts}
    assert got["50% x %skin%"] == "50% x %skin%"


def test_brands_are_plain_texts(spark):
    rows = spark.createDataFrame([("by A+B now",), ("xA+B",)], "t string")
    assert [r[0] for r in rows.select(T.remove_brand(F.col("t"), "A+B")).collect()] == ["by  now", "xA+B"]
    assert rows.select(T.remove_brand(F.col("t"), "(")).count() == 2
