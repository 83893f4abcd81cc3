from proofmill.plans import texts


def test_lines_are_counted_once(spark):
    plan = texts.set_equal_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(concat") == 1 and "Union" not in plan


def test_lines_of_ids_that_repeat_are_counted_together(spark, tmp_path):
    docs = [(1, "B one\ntwo", "en"), (1, "C one\ntwo", "en"), (2, "first second", "en"), (4, "same", "en"), (5, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.zone_id for r in texts.set_equal_lines(spark, str(tmp_path)).collect()) == [1, 1, 4, 5]
