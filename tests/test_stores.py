"""Tables that are written once for many reads: pages, buckets."""

from pyspark.sql import functions as F

from proofmill.operators import reports as O
from proofmill.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages(spark, tmp_path):
    rows = spark.range(1003).select((F.col("id") * 7919 % 1003).alias("id"), F.lit("x").alias("page_at")).repartition(5)
    path = str(tmp_path / "pages")
    sinks.write_pages(rows.drop("page_at").withColumn("v", F.lit("x")), path)
    seen = []
    for number in (1, 2, 26, 51):
        page = sinks.read_page(spark, path, number)
        got = page.collect()
        assert {(r.total_rows, r.total_pages) for r in got} == {(1003, 51)}
        assert [r.id for r in got] == list(range(20 * number - 20, min(20 * number, 1003)))
        seen.append(page)
    assert page.columns == ["id", "v", "total_rows", "total_pages"]
    assert sinks.read_page(spark, path, 52).count() == 0
    one = plan(sinks.read_page(spark, path, 1, 5))
    assert "PartitionFilters: [isnotnull(page_range" in one
    assert "PushedFilters: [IsNotNull(page_at)" in one


def test_pages_of_nothing(spark, tmp_path):
    sinks.write_pages(spark.createDataFrame([], "id long, v string"), str(tmp_path / "none"))
    page = sinks.read_page(spark, str(tmp_path / "none"), 1)
    assert (page.columns, page.count()) == (["id", "v", "total_rows", "total_pages"], 0)
    sinks.write_pages(spark.createDataFrame([(None,), (3,), (3,)], "id long"), str(tmp_path / "few"))
    assert [r.id for r in sinks.read_page(spark, str(tmp_path / "few"), 1, 2).collect()] == [None, 3]


def test_buckets_need_no_exchange(spark):
    rows = spark.range(2000).select((F.col("id") % 23).alias("session_id"), F.concat(F.lit("i"), F.col("id") % 300).alias("image_name"), F.when(F.col("id") % 5 == 0, "error").alias("decision"), F.lit("PASS").alias("status"))
    results = sinks.save_bucketed(rows, "bucketed_results")
    payloads = sinks.save_bucketed(rows.select("session_id", "image_name").distinct().withColumn("payload", F.lit("p")), "bucketed_payloads")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = O.rejected_payloads(results, payloads)
        assert "Exchange" not in plan(joined)
        assert joined.count() == rows.where("decision = 'error'").select("session_id", "image_name").distinct().count()
        assert "Exchange" not in plan(results.groupBy("session_id").count())
        assert "SelectedBucketsCount: 1 out of" in plan(results.where("session_id = 7"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sql("drop table bucketed_results")
        spark.sql("drop table bucketed_payloads")
