"""Plans without Python where none is wanted, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from sitegrain.llm import winnowing
from sitegrain.llm.queries import QUERIES


@pytest.mark.parametrize("name", ["op2_surrogates", "op4_quality", "op7_line_dedup"])
def test_native_plans(spark, sf_dir, plan, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(out.columns) == {*docs.columns, "size", "target", "taken"}
    assert out.doc_id.is_unique and set(out.doc_id) <= set(docs.doc_id)
    quality = {r["doc_id"]: r["kept"] for r in QUERIES["op4_quality"](spark, sf_dir).collect()}
    assert all(quality[i] for i in out.doc_id)
    assert (out.taken > 0).all() and (out.taken <= 3 * out["size"]).all()


def test_decontamination_keeps_clean_documents(spark, sf_dir, stage):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = {r["doc_id"] for r in winnowing.contamination_report(docs, items, stage).collect() if r["contaminated"]}
    kept = {r["doc_id"] for r in winnowing.drop_contaminated(docs, items, stage).collect()}
    assert bad and kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - bad
