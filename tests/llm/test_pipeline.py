from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = corpus_pipeline.quality(spark, docs, SF)
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert kept.columns == columns and len(ids) < n and all(i in ids for i, q in labels.items() if q == 1)
    clean = corpus_pipeline.personal_data(spark, kept, SF)
    assert clean.columns == columns and clean.where("text like '%@mail%.example.com%'").count() == 0
    mixed = corpus_pipeline.mixing(spark, clean, SF)
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3


def test_stages_without_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.packing(spark, docs, str(tmp_path)).count() == 0


def test_stages_with_nulls_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    junk = lambda k: "### ".join("abcd") * 9 if k % 4 == 0 else f"plain words number {k} in a row " * 3
    rows = [(k, junk(k), "en", f"s{k % 3}", 90) for k in range(60)] + [(None, None, None, None, None), (None, "kept without an id", None, None, 3), (61, "", "en", "s1", 0), (61, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'mine' as keep", "1 as row", "2 as hash", "'x' as pattern", "3 as component_id", "4 as copies")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[5:] == ["keep", "row", "hash", "pattern", "component_id", "copies"], name
        assert all(r["keep"] == "mine" and r["row"] == 1 for r in docs.collect()), name
    packed = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    assert sum(r["piece"] == 0 for r in packed) == docs.count() and all(len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= 2048 for r in packed)


def test_stages_with_a_very_long_text(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    junk = lambda k: "### ".join("abcd") * 9 if k % 4 == 0 else f"plain words number {k} in a row " * 3
    long = " ".join(f"plain words number {k} in a row" for k in range(60_000)) + " mail me at a@b.co"
    rows = [(k, junk(k), "en", "s", 90) for k in range(60)] + [(100, long, "en", "s", len(long)), (101, long, "en", "s", len(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert 100 in kept and 101 not in kept and kept[100]["text"].endswith("[EMAIL]") and kept[100]["n_chars"] == len(kept[100]["text"])
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    whole = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    assert mixed.columns == docs.columns and sum(r["length"] for r in whole if r["doc_id"] == 100) > 300_000
