from proofmill.plans import texts


def test_differences_are_made_once(spark):
    plan = texts.cmp_ordered_diff(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
