import corpus_pipeline
from turnweave.llm import edit_match


def test_stages_act_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids))
    bench = [edit_match.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(b in edit_match.normal(r.text) for r in docs.collect() for b in bench)
    assert docs.where(r"text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+'").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in mixed} <= set(ids) and all(r.taken == r["size"] * r.copies for r in mixed)


def test_run_equals_its_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
