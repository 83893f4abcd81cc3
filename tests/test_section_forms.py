import pytest
from pyspark.sql import functions as F

from proofmill.functions import text as T
from proofmill.operators import section_index as index
from proofmill.operators import sections as S

TEXTS = [None, "", "  \r\n\n ", "One  two\n\nThree;\r four\n", "a\n%skin% b\n", "[ Username\n] x", "“Quoted” ★\n– x y « ok »", "Été x\nΑΣ\nBΣ Σ", "b\na", " \n.\n, x"]


def test_lines_in_one_pass(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    whole = F.array_join(T.strict_lines("t"), " ")
    for r in rows.select("t", T.strict_lines("t").alias("a"), T.normalized_lines("t", "strict").alias("b"), whole.alias("c"), T.normalize("t", "strict").alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d), r.t


def test_what_travels(spark):
    """A row of forms holds no text: what a pack's rows take in a shuffle doesn't follow the texts' lengths."""
    rows = S.with_forms(spark.createDataFrame([(1, "word " * 5000 + "%skin%\nline")], "k long, t string"), "t", "r").drop("t")
    assert len(str(rows.first())) < 500


@pytest.mark.parametrize("hints", [0, 100])
def test_blocks_and_parts(spark, monkeypatch, hints):
    monkeypatch.setattr(index, "GROUP_CHARS", 40)
    monkeypatch.setattr(index, "BROADCAST_HINTS", hints)
    sections = spark.createDataFrame([(1, k, k % 3, "PIC" if k % 2 else "NEWS", f"w{k} w{k + 1} w{k % 5} {'%skin%' if k % 7 == 0 else ''}") for k in range(40)], "pack_id long, ord long, section_no int, name string, content string")
    hints = [(None, None), (None, ""), (1, None), (99, "pic"), (2, "pic"), (0, "x")]
    readings = spark.createDataFrame([(z, 1, "en", f"w{z} w{z + 1} w{z % 5}" if z % 4 else "none of them", *hints[z % 6]) for z in range(60)], "zone_id long, pack_id long, lang string, reading string, hint_number int, hint_name string")
    by_index, by_pairs = (sorted(map(tuple, S.select_sections(readings, sections, indexed=i).collect()), key=str) for i in (True, False))
    assert by_index == by_pairs
    assert len(by_index) == 60
