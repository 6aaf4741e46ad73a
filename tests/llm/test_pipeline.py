import pytest

import corpus_pipeline
from memloom.llm import decontam, pii, quality, simhash


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = docs
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, seen, sf_dir).cache()
        before = {r["doc_id"]: r for r in seen.collect()}
        now = {r["doc_id"]: r for r in after.collect()}
        assert set(now) <= set(before) and now
        if k < 4:
            assert after.columns == docs.columns
        if k == 0:
            kept = {r["doc_id"] for r in quality.quality_rules(seen).where("kept").collect()}
            assert set(now) == kept
        if k == 1:
            assert set(now) == {r["component_id"] for r in simhash.simhash_components(spark, seen).collect()}
            assert simhash.simhash_components(spark, after).where("doc_id != component_id").count() == 0
        if k == 2:
            gone = {r["doc_id"] for r in decontam.contamination(spark, seen, spark.createDataFrame(bench, "item_id long, text string")).where("contaminated").collect()}
            assert set(now) == set(before) - gone
            assert decontam.contamination(spark, after, spark.createDataFrame(bench, "item_id long, text string")).where("n_hit > 0").count() == 0
        if k == 3:
            assert set(now) == set(before)
            assert pii.personal_data(after).where("spans != ''").count() == 0
        if k == 4:
            assert after.columns == [*docs.columns, "size", "source_size", "target", "taken"]
            assert all(0 < r["taken"] <= 3 * r["size"] for r in now.values())
        seen = after


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, "x")], [(1, "a", "en", None, 1, "x")] * 2])
def test_odd_tables(spark, tmp_path, rows):
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0  # too short for the rules, or nothing there
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.count() == min(len(rows), 1) or stage is not corpus_pipeline.near_duplicate_stage
