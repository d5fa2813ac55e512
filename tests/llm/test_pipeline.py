"""The pipeline: each stage on its own input, and the whole."""

from collections import Counter

import corpus_pipeline
from evenload.llm import mixing, near_text, registry, toxicity
from evenload.scratch import materialize

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, DIR))
        seen[name] = (before, docs)
        if name != "pieces":
            assert docs.columns == columns and docs.dtypes == before.dtypes
    assert list(seen) == ["toxicity", "line dedup", "near-dedup", "mixing", "pieces"]

    def ids(df):
        return Counter(r.doc_id for r in df.select("doc_id").collect())

    before, after = seen["toxicity"]
    scored = toxicity.graded(before, spark.read.parquet(f"{DIR}/labels.parquet"))
    assert ids(after) == ids(scored.where("not toxic"))
    before, after = seen["line dedup"]
    from tests.llm.test_line_dedup import brute

    want = {i: text for i, _, _, text in brute([(r.doc_id, r.text) for r in before.collect()])}
    assert {r.doc_id: r.text for r in after.collect()} == want
    before, after = seen["near-dedup"]
    assert ids(after) == Counter(r._id for r in near_text.classes(before).where("_id = class_id").collect())
    before, after = seen["mixing"]
    assert ids(after) == Counter({r._id: len(r.draws) for r in mixing.mix(before).collect() if r.draws})
    before, after = seen["pieces"]
    assert ids(after) == ids(before)
    whole = corpus_pipeline.run(spark, DIR)
    assert ids(whole) == ids(after)
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in registry.QUERIES


def test_odd_tables_pass_all_stages(spark, odd, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 1), (5, 0, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        read = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES:
            after = materialize(stage(spark, read, f"{tmp_path}/{name}"))
            if stage_name != "pieces":
                assert after.columns == read.columns and after.dtypes == read.dtypes
            if stage_name in ("toxicity", "line dedup"):
                assert after.count() == read.count()
            read = after
        assert (read.count() > 0) == (name == "odd")
        assert set(read.columns) == {"doc_id", "source", "n_tokens", "ids", "begins", "ends"}
