import duckdb
from pyspark.sql import functions as F

from proofmill.functions import responses as R
from proofmill.functions import text as T
from proofmill.plans.registry import ORACLES
from proofmill.plans.sessions import jsn_flat_response

ENDS = "\r", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\u2029", "\n\r", "\n\u2028", "\n", "\r\n"


def same_as_sql(spark, folder, con):
    con.execute(f"copy documents to '{folder}/documents.parquet'")
    found = {r.doc_id: r.digest for r in jsn_flat_response(spark, str(folder)).collect()}
    assert found == dict(con.execute(ORACLES["jsn_flat_response"]).fetchall())
    return found


def test_marks_are_at_line_starts_only(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(5 * k, f"## a{e}# b") for k, e in enumerate(ENDS)])
    assert None not in same_as_sql(spark, tmp_path, con).values()
    rows = spark.createDataFrame([(f"# a{e}# b",) for e in ENDS], "text string").select("text", T.strip_heading_marks("text").alias("found")).collect()
    assert [r.found for r in rows] == [f"a{e}b" if e.endswith("\n") else f"a{e}# b" for e in ENDS]


def test_ids_below_zero_and_none(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table documents as select unnest(list_append(range(-12, 13), null)) as doc_id, 'Abc' as text")
    found = same_as_sql(spark, tmp_path, con)
    assert sorted(k for k, digest in found.items() if digest) == [-10, -5, 0, 1, 5, 6, 10, 11]


def test_texts_beyond_20_million_characters(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table documents as select cast(1 as bigint) as doc_id, repeat('abcd', 5000000) || '!' as text")
    assert same_as_sql(spark, tmp_path, con)[1]
    text = F.concat(F.repeat(F.lit("abcd"), F.lit(5_000_000)), F.lit("!"))
    blocks = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(text.alias("text"))).alias("lines"))).alias("blocks")).alias("readResult")))
    annotation = F.to_json(F.struct(F.struct(text.alias("text")).alias("fullTextAnnotation")))
    row = spark.range(1).select(F.length(R.from_blocks(blocks)["text"]).alias("blocks"), F.length(R.from_annotation(annotation, F.lit("document"))["text"]).alias("annotation")).first()
    assert tuple(row) == (20_000_001, 20_000_001)


def test_a_text_without_letter_or_digit_is_no_reading(spark):
    texts = "", " \n", "...", "# \n## \n### ", "\U0001f600", "_", "# 1", "½"
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    body = F.to_json(F.struct(F.lit(1).alias("OCRExitCode"), F.array(F.struct(F.col("t").alias("ParsedText"))).alias("ParsedResults")))
    assert [r[0] for r in rows.select("k", R.from_flat(body)["text"].alias("text")).orderBy("k").select("text").collect()] == [None] * 6 + ["1", "½"]
