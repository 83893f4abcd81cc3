from proofmill.functions import compare as C


def test_differences_of_zones_with_several_rows(spark):
    """Tokens of a zone's rows are numbered together, those of rows that are alike too; a zone of one row is not shuffled."""
    rows = spark.createDataFrame([(1, "y y", "y y"), (1, "a", "a y"), (2, "b c", "c b"), (3, "a a a", "a d"), (None, "x", "x"), (None, "x", "x x")], "zone_id long, text string, ref string")
    got = sorted(map(tuple, C.token_differences(rows).collect()), key=str)
    assert got == sorted([(1, "y", 3, "add"), (3, "a", 2, "del"), (3, "a", 3, "del"), (3, "d", 1, "add"), (None, "x", 3, "add")], key=str)
    assert "Exchange" not in C.token_differences(rows.where("zone_id > 1"))._jdf.queryExecution().executedPlan().toString()
