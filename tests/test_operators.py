"""Decision tables, invariants, streams against batches, and plans."""

import itertools
import time

import pytest
from pyspark.sql import functions as F

from proofmill.functions import geometry as G
from proofmill.functions import paths as P
from proofmill.functions import responses as R
from proofmill.operators import manifest as M
from proofmill.operators import reports as O
from proofmill.operators import sections as S
from proofmill.operators import verdicts as V
from proofmill.operators import vote
from proofmill.plans.views import view
from proofmill.sources import catalog, sinks
from proofmill.sources.shared import shared_dir
from proofmill.streaming import jobs
from proofmill.streaming.run import appended, file_stream, updated

SF = "/root/testdata/sf0.001"
READING = "zone_id long, engine string, text string, error string"


def votes(spark, rows, **more):
    out = vote.majority_vote(spark.createDataFrame(rows, READING), **more)
    return {r.zone_id: (r.engine, r.text, r.rule, r.status, r.reason) for r in out.collect()}


def test_vote_table(spark):
    rows = [
        (1, "google", "Sale!", None), (1, "azure", "sale", None), (1, "ocrspace", "other", None),
        (2, "google", "a", None), (2, "azure", "bbb", None), (2, "ocrspace", "cc", None),
        (3, "google", "x", "engine_exception"), (3, "azure", "x", "engine_exception"),
        (4, "google", "", None), (4, "azure", "", None),
        (5, "google", "y", None), (5, "azure", "y", "engine_exception"), (5, "ocrspace", "y", None),
        (6, "google", "alone", None),
    ]
    assert votes(spark, rows) == {
        1: ("azure", "sale", "majority_2_of_3", "OK", None), 2: ("azure", "bbb", "no_confidence_fallback", "MANUAL", "no_consensus"), 3: (None, None, None, "MANUAL", "all_engines_failed"),
        4: ("azure", "", "match_2", "OK", None), 5: ("google", "y", "majority_2_of_3", "OK", None), 6: ("google", "alone", "no_confidence_fallback", "MANUAL", "no_consensus"),
    }
    assert set(votes(spark, rows, drop_empty=True)) == {1, 2, 3, 5, 6}
    assert votes(spark, []) == {}


def test_vote_ignores_row_order(spark):
    base = [("google", "b a", None), ("azure", "B, a", None), ("ocrspace", "zzz", None)]
    rows = [(k, *r) for k, order in enumerate(itertools.permutations(base)) for r in order]
    assert len(set(votes(spark, rows).values())) == 1


def test_streaming_vote(spark, tmp_path):
    """Zones with all readings equal the batch; one that misses a reading comes by its timeout; the newest waits on."""
    rows = [(z, e, "same" if z % 2 else f"{e}{z}", None, 1000 + 60 * z) for z in range(6) for e in ("google", "azure", "ocrspace") if not (z in (2, 5) and e == "azure")]
    late = [(100, "google", "end", None, 100_000)]
    for k, part in enumerate((rows, late)):
        spark.createDataFrame(part, READING + ", s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = appended(jobs.streaming_vote(file_stream(spark, str(tmp_path / "in"), 1)), "test")
    got = {r.zone_id: (r.engine, r.text, r.rule, r.status, r.reason) for r in out.collect()}
    batch = votes(spark, [r[:4] for r in rows])
    assert {z: got[z] for z in (0, 1, 3, 4)} == {z: batch[z] for z in (0, 1, 3, 4)}
    assert got[2] == batch[2]
    assert 100 not in got


def _batches(spark, tmp_path, parts, schema):
    """A stream of one micro-batch for each part."""
    for part in parts:
        spark.createDataFrame(part, schema + ", s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    return file_stream(spark, str(tmp_path / "in"), 1)


def test_streaming_vote_redelivery(spark, tmp_path):
    """An engine counts once; a decided zone isn't decided again."""
    first = [(1, "google", "a", None, 1000), (1, "google", "a", None, 1000), (1, "azure", "b", "failed", 1000)]
    then = [(1, "azure", "a", None, 1010), (1, "azure", "a", None, 1010), (1, "ocrspace", "b", None, 1010)]
    again = [(1, "ocrspace", "b", None, 1010), (1, "google", "a", None, 1000), (1, "azure", "a", None, 1010)]
    out = appended(jobs.streaming_vote(_batches(spark, tmp_path, (first, then, again), READING)), "redelivery").collect()
    assert [(r.zone_id, r.text, r.rule, r.n_readings, r.n_valid) for r in out] == [(1, "a", "majority_2_of_3", 3, 3)]


def test_streaming_progress_expires(spark, tmp_path):
    """A session that was idle for longer than the expiry starts anew."""
    day = 86_400
    parts = [[(1, 1, "PASS", day), (1, 2, "MANUAL", day + 5), (2, 3, "pending", day)], [(2, 4, "PASS", 20 * day)], [(2, 5, "PASS", 20 * day + 1)], [(1, 6, "PASS", 20 * day + 2), (2, 7, "MANUAL", 20 * day + 2)]]
    got = updated(jobs.progress(_batches(spark, tmp_path, parts, "session_id long, seq long, status string")), ["session_id"], "expiry").collect()
    assert {(r.session_id, r.done, r.passed, r.manual, r.last_status) for r in got} == {(1, 1, 1, 0, "PASS"), (2, 4, 2, 1, "MANUAL")}


def test_shared_dir_is_set_on_a_cluster(spark):
    class Conf:
        def get(self, name, default=None):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_page_after(spark):
    rows = spark.range(45)
    assert [r.id for r in O.page_after(rows, size=20).collect()] == list(range(20))
    assert [r.id for r in O.page_after(rows, 39, 20).collect()] == list(range(40, 45))


def test_latest_settles_ties(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "c"), (2, None, "d")], "k long, ts long, rank string").repartition(3)
    first = O.latest(rows, ["k"])
    assert first.columns == rows.columns
    assert {tuple(r) for r in first.collect()} == {tuple(r) for r in O.latest(rows.coalesce(1), ["k"]).collect()}
    assert {r["rank"] for r in first.where("k = 2").collect()} == {"d"}


@pytest.mark.parametrize(
    ("path", "lang"),
    [
        ("a/en.png", "en"), ("KR.png", "ko"), ("xx.png", "xx"), ("banner_de_700x420.png", "de"), ("Campaign (zh-hans).docx", "zh-hans"), ("wl_rs_300x250.jpg", "sr-latn"), ("logo.gif", None),
        ("image.jpg", None), ("pack_pt-pt_2.png", "pt-pt"), ("fr_de.png", "de"), ("noext", None),
    ],
)
def test_language_of_path(spark, path, lang):
    assert spark.createDataFrame([(path,)], "p string").select(P.language(F.col("p"))).first()[0] == lang


def test_paths(spark):
    rows = spark.createDataFrame([("a.zip!/300x250/b/en.png",), ("en.png",), ("d/",)], "p string")
    out = rows.select(P.target_id(F.col("p")).alias("t"), P.area(F.col("p")).alias("a"), P.file_kind(F.col("p")).alias("k")).collect()
    assert [tuple(r) for r in out] == [("300x250/b", 75000, "image"), ("default", 0, "image"), ("default", 0, None)]


def pack(spark, lines):
    return spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "pack_id long, line_no long, line string")


def test_segments(spark):
    out = S.segment_lines(pack(spark, ["1. NEWS", "hello", "", "", "5 PIC", "world", "", "", "tail"])).orderBy("ord").collect()
    assert [(r.section_no, r.name, r.content) for r in out] == [(1, "NEWS", "hello"), (5, "PIC", "world"), (None, "UNKNOWN", "tail")]
    one = S.segment_lines(pack(spark, ["10 JETON", "text", "", "", "more"])).collect()
    assert [(r.section_no, r.name, r.content) for r in one] == [(None, "UNKNOWN", "10 JETON\ntext\n\n\nmore")]
    assert S.segment_lines(pack(spark, ["", " "])).count() == 0


def test_selection(spark):
    sections = spark.createDataFrame([(1, 0, 3, "NEWS", "alpha beta"), (1, 1, 5, "PIC", "gamma delta"), (2, 0, 1, "PIC", "x %skin%")], "pack_id long, ord long, section_no int, name string, content string")
    rows = [(1, 1, "en", "Gamma DELTA", None, None), (2, 1, "en", "alpha", 5, None), (3, 1, "en", "ab", None, None), (4, 9, "en", "alpha beta", None, None), (5, 2, "en", "x y", None, None), (6, 2, "en", "x", 1, None), (7, 2, "en", "x yz", 1, None)]
    readings = spark.createDataFrame(rows, "zone_id long, pack_id long, lang string, reading string, hint_number int, hint_name string")
    got = {r.zone_id: (r.section_no, r.status, r.reason, r.manual_required) for r in S.select_sections(readings, sections).collect()}
    assert got[1] == (5, "PASS", "strict_equal", False)
    assert got[2] == (5, "MANUAL", "no_match", False)
    assert got[3][1:] == ("MANUAL", "ocr_too_short", True)
    assert got[4][1:] == ("MANUAL", "no_sections", True)
    assert got[5][1:] == ("MANUAL", "all_placeholders", True)
    assert got[6][2] == "ocr_too_short"
    assert got[7][2] == "no_match"


def test_verdicts_are_total(spark):
    rows = view(spark, SF, "v_refs").select(
        F.col("zone_id").alias("id"), "lang", "text", F.col("ref").alias("ref_text"), F.lit("no_match").alias("reason"), F.lit("MANUAL").alias("status"),
        (F.col("zone_id") % 2 == 0).alias("disagree"), (F.col("zone_id") % 3 == 0).alias("outlier"), F.lit(None).cast("string").alias("judge"),
    )
    out = V.image_verdict(rows).select("reason", "status").distinct().collect()
    known = dict(V.REASONS)
    assert all(known[r.reason] == r.status for r in out)
    assert all(r.reason is not None for r in out)


def test_expand_zones(spark):
    images = spark.createDataFrame([("a", p, "en", t) for p, t in (("1", "x"), ("2", "y"), ("3", "z"), ("4", "w"))], "archive string, path string, lang string, target_id string")
    zones = spark.createDataFrame([("x", 1, "n", [0, 0, 5, 5]), ("x", 0, "m", [5, 0, 1, 5]), ("y", 0, "k", [1, 2])], "target_id string, ord long, zone_name string, bbox array<int>")
    fallback = spark.createDataFrame([("z", [1, 1, 2, 2])], "target_id string, bbox array<int>")
    out = sorted((r.path, r.zone_name, r.bbox) for r in M.expand_zones(images, zones, fallback).collect())
    assert out == [("1", "n", [0, 0, 5, 5]), ("3", None, [1, 1, 2, 2]), ("4", None, None)]


def test_boxes(spark):
    rows = spark.createDataFrame([(["1", "2.0", "3", "4"],), (["1", "2.5", "3", "4"],), (["1", "true", "3", "4"],), (["1", "2"],)], "v array<string>")
    assert [r[0] for r in rows.select(G.parsed_bbox(F.col("v"))).collect()] == [[1, 2, 3, 4], None, None, None]


def test_judge_reply(spark):
    bodies = ['{"real_differences": [], "verdict": "fail"}', '```json\n{"real_differences": [{"ocr": "a"}]}\n```', "well {\"reason\": 1} ok", "nothing", None]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string")
    assert [r[0] and r[0]["verdict"] for r in rows.select(R.judge_reply(F.col("b"))).collect()] == ["pass", "fail", "pass", None, None]


def test_append(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 1, "PASS"), ("s2", 2, "MANUAL")], "session_id string, id long, status string")
    for _ in range(2):
        sinks.append_verdicts(rows, str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    scan = sinks.session_results(stored, "s2", hide_pass=True)
    assert scan.count() == 2
    assert "PartitionFilters: [isnotnull(session_id" in scan._jdf.queryExecution().executedPlan().toString()


def test_template_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"template_name": "t", "schema_version": 1,\n "source_size": [10, 10], "zones": []}')
    (tmp_path / "b.json").write_text("{broken")
    assert [r.template_name for r in catalog.scan_templates(spark, str(tmp_path)).collect()] == ["t"]


def test_event_rows(spark):
    rows = spark.sql("select timestamp '2024-05-06 07:08:09' as ts, 'z' as zone")
    assert sinks.event_rows(rows, "run", "ts", "zone").first()[0] == '{"event":"run","ts_utc":"2024-05-06T07:08:09Z","zone":"z"}'


def test_empty_rollups(spark):
    rows = view(spark, SF, "v_results").limit(0)
    assert O.image_rollup(rows).count() == O.session_totals(rows).count() == 0


def test_plans(spark):
    """No cartesian product and no Python in the vote; one exchange for both steps; the scan is pruned."""
    plan = vote.majority_vote(view(spark, SF, "v_readings"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan
    assert "Python" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
