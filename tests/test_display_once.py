import re

from pyspark.sql import functions as F

from proofmill.functions import text as T

TEXTS = [None, "", " \n", "a\t b\x1f\x0bc    d\x85e", "% a %skin% 5% x%", "< Username > [b]\r\n\r\n x", "★ « a »… –‑“q’­", "A  B\n \n  É 　 ", "50% x\x1c\x1d  "]


def plain(text, lang):
    t = re.sub("[★­]", "", text or "")
    t = re.sub("[ 　 ]", " ", t).replace("…", "...")
    t = re.sub("[–‑]", "-", t)
    t = re.sub("[“]" if lang == "fr" else "[“«»]", '"', t).replace("’", "'")
    t = re.sub(r"(?i)%\s*skin\s*%|<\s*username\s*>", " ", t)
    lines = [" ".join(x.split()) for x in re.sub("%[^%]+%", " ", t).splitlines()]
    return "\n".join(x for x in lines if x)


def test_display_is_made_in_passes(spark):
    """Whole texts are cleaned, without a function applied to each line, and cleaning doesn't stand twice in the plan."""
    rows = spark.createDataFrame([(t, lang) for t in TEXTS for lang in ("fr", "de")], "t string, lang string")
    out = rows.select("t", "lang", T.clean_for_display("t", F.col("lang")).alias("d"), T.judge_form("t", F.col("lang")).alias("j"))
    for r in out.collect():
        assert r.d == plain(r.t, r.lang), r.t
        assert r.j == re.sub(r"[\[\]<>()]", " ", r.d).lower()
    plan = rows.select(T.judge_form("t", F.col("lang")).alias("j"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
