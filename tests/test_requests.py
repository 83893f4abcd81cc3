from proofmill.plans import sessions


def test_requests_are_made_once(spark):
    plan = sessions.join_cache_misses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "judge-requests" in "".join(sessions.join_cache_misses(spark, "/root/testdata/sf0.001").inputFiles())
    assert "ArrowEvalPython" not in plan
