"""Golden cases of normalisation and comparison."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofmill.functions import compare as C
from proofmill.functions import text as T


def value(spark, column, **given_):
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in given_.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("level", "lang", "text", "expected"),
    [
        ("strict", None, None, ""), ("strict", None, "", ""), ("strict", None, "Hello,  WORLD!", "hello, world!"), ("strict", None, "[ BUY NOW ]", "buy now"),
        ("strict", None, "a–b “c”", 'a b "c"'), ("strict", None, "x  y​z", "x yz"), ("strict", None, "wait…", "wait..."),
        ("soft", None, "Hi %skin% and [ Username ]!", "hi and !"), ("strict", None, "Hi %skin%", "hi %skin%"), ("soft", None, "<play now>", "play now"),
        ("strict", "fr", "Bonjour : «monde» !", "bonjour : «monde» !"), ("strict", "de", "Hallo : «Welt» !", 'hallo "welt" !'),
        ("consensus", None, "## Big  Sale!", "big sale"), ("consensus", None, "50% <off> [x] $5+", "50% <off> [x] $5+"), ("strict", None, "\U0001f600 ok ★", "ok"),
    ],
)
def test_normalize(spark, level, lang, text, expected):
    assert value(spark, T.normalize("t", level, F.col("lang")), t=text, lang=lang) == expected


def test_unknown_level():
    with pytest.raises(ValueError, match="unknown level"):
        T.normalize("t", "loose")


def test_composed(spark):
    rows = spark.createDataFrame([("é",), ("plain",), (None,)], "t string")
    assert [r.t for r in T.composed(rows, "t").collect()] == ["é", "plain", None]


@pytest.mark.parametrize(
    ("a", "b", "passed", "mode"),
    [("A b", "a  B", True, "exact"), ("", None, True, "exact"), ("one\ntwo", "two\none", True, "line_multiset"), ("one", "two", False, "none"), ("a\na", "a", False, "none")],
)
def test_compare_lines(spark, a, b, passed, mode):
    c = value(spark, C.compare_lines(F.col("a"), F.col("b")), a=a, b=b)
    assert (c["pass"], c["mode"]) == (passed, mode)


def test_similarity(spark):
    one = lambda a, b: value(spark, C.edit_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert one("", "") == 1.0
    assert one("a", "") == 0.0
    assert one("kitten", "sitting") == pytest.approx(1 - 3 / 7)


def test_numbers(spark):
    assert value(spark, C.numbers("t"), t="Win 5,000 or 1.234,56; 13 left") == ["5000", "123456", "13"]
    facts = value(spark, C.number_facts(F.col("a"), F.col("b")), a="5,000 and 13", b="5000 and 7")
    assert (facts["missing"], facts["extra"]) == (["13"], ["7"])
    assert value(spark, C.number_facts(F.col("a"), F.col("b")), a="7", b="7 and 8") is None


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
    return new


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=40), st.text("abcd", max_size=40))
def test_lcs(a, b):
    assert C.lcs_length(a, b) == subsequence(a, b)


def test_closest_engine(spark):
    readings = spark.createDataFrame([(1, "google", "abcx"), (1, "azure", "abcd"), (1, "ocrspace", ""), (2, "ocrspace", "q"), (2, "azure", "q")], "zone_id long, engine string, text string")
    references = spark.createDataFrame([(1, "ABCD"), (2, "r")], "zone_id long, text string")
    assert sorted(map(tuple, C.closest_engine(readings, references).collect())) == [(1, "azure", 0), (2, "azure", 2)]


def test_empty_and_null_rows(spark):
    rows = spark.createDataFrame([(1, None, None)], "zone_id long, text string, ref string")
    assert C.token_differences(rows).count() == 0
    assert C.grey_zone(rows.limit(0)).count() == 0
    out = C.validation(rows.select("zone_id", "text", F.col("ref").alias("expected_text"), F.lit(None).cast("string").alias("lang"))).first()
    assert out["validation"]["skip_reason"] == "lang_missing"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abé😀", max_size=90), st.text("abé😀", max_size=90), st.integers(0, 90))
def test_whole_distance(a, b, most):
    d = edits(a, b)
    assert C.within_distance(a, b, most) == (d if d <= most else None)


def test_whole_similarity_reads_whole_texts(spark):
    long = "ab cd " * 5_000
    rows = [("x" + long, long + "y"), (long + "q" * 40_000, long + "r" * 40_000), (long, long), ("", ""), ("", "a"), (None, "a"), (None, None), ("abcd", "abce"), ("ab", "cd")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, a string, b string")
    a, b = F.col("a"), F.col("b")
    got = [(r.all, r.near) for r in df.select("id", C.whole_similarity(a, b).alias("all"), C.whole_similarity(a, b, 0.75).alias("near")).orderBy("id").collect()]
    assert got[0][0] == got[0][1] == pytest.approx(1 - 2 / 30_001)
    assert got[1][0] == pytest.approx(1 - 40 / 70) and got[1][1] is None
    assert got[2:] == [(1.0, 1.0), (1.0, 1.0), (0.0, None), (None, None), (None, None), (0.75, 0.75), (0.0, None)]
    assert df.limit(0).select(C.whole_similarity(a, b).alias("s")).count() == 0
