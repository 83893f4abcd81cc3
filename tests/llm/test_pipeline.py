import brute
import corpus_pipeline
from oracle import connect, duck_rows, spark_rows

from proofmill.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    """Each stage against what its input asks of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.written(stage(spark, kept[-1], SF), "test-stage"))
    assert all(d.columns == columns for d in kept[:-1])
    known, single, clean, mixed, sharded = ([tuple(r) for r in d.collect()] for d in kept[1:])
    every = [tuple(r) for r in docs.collect()]
    scores = brute.languages([r[:3] for r in every])
    assert sorted(known) == sorted(r for r, (lang, score) in zip(every, scores, strict=True) if lang != "und" and score >= language.MIN_SCORE)
    roots = brute.components({r[0]: brute.fingerprint(r[1]) for r in known})
    assert {r[0] for r in single} == set(roots.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r[0] for r in clean} == {d for d, _, hit, _ in brute.contamination([r[:2] for r in single], items) if not hit}
    assert {r[0] for r in mixed} <= {r[0] for r in clean}
    assert sorted(r[:5] for r in sharded) == sorted(mixed)


def test_oracles(spark):
    con = connect(SF)
    for name, sql in queries.oracle_sql().items():
        assert spark_rows(queries.queries()[name](spark, SF)) == duck_rows(con, sql)


def test_pipeline_survives_odd_rows(spark, make, odd_rows):
    docs = make(odd_rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-odd")
    assert docs.count() > 0
