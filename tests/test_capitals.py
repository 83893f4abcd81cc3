import duckdb
from pyspark.sql import functions as F

from proofmill.plans.views import MANY_CAPITALS, sql_of


def test_capitals_are_single_letters_as_in_the_oracle(spark):
    texts = ["straße", "ß", "aﬁbßc\U0001f600é", "", None, "plain", *MANY_CAPITALS]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    found = dict(rows.select("k", F.expr(sql_of("@upper(text)", "spark")).alias("up")).collect())
    con = duckdb.connect()
    assert found == {k: con.execute("select upper(?::varchar)", [t]).fetchone()[0] for k, t in enumerate(texts)}
    assert found[0] == "STRAẞE"


def test_readings_in_capitals_have_equal_views(spark):
    docs = spark.createDataFrame([(2, "en", "Groß und ﬁn")], "doc_id long, lang string, text string")
    docs.createOrReplaceTempView("capital_docs")
    view = spark.sql(sql_of("select text from @v_readings where engine = 'azure'", "spark", {"documents": "capital_docs"}))
    assert view.collect()[0][0] == "GROẞ UND ﬁN"
