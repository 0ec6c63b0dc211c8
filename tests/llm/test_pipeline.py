import corpus_pipeline


def test_stages(docs, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "source_mix", "token_ids"]
    columns, current = docs.columns, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, current, str(tmp_path)).write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        assert current.columns == columns
        assert current.count() > 0
    kept = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "near_duplicates")).collect()}
    assert {100, 20, 400} <= kept and {101, 102, 200, 201, 203, 300}.isdisjoint(kept)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where("not exact").count() == 0 and out.count() == current.count()


def test_empty(empty, spark, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
