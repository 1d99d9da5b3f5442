import corpus_pipeline
from crateline.llm import decontamination, exact_dedup, jaccard_join, packing, tokens
from crateline.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_takes_effect(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    rows = docs.limit(30).collect() * 2  # repeated rows
    docs = docs.union(spark.createDataFrame(rows, docs.schema)).union(spark.createDataFrame([(10**6, "12 34 !", "en", None, 7), (10**6 + 1, None, None, None, None), (None, "a text of a few words", "en", "s", 5)], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, made = docs, stage(spark, docs, FOLDER)
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before.columns and docs.exceptAll(before).count() == 0, name
        ids = {r.doc_id for r in before.select("doc_id").collect()} - {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language":
            assert ids == {10**6, 10**6 + 1}
        if name == "exact":
            again = exact_dedup.exact_dedup(docs)
            assert docs.count() == before.select(exact_dedup.normalised(before["text"])).distinct().count() == again.filter("group_size = 1").count()
        if name == "near":
            told = jaccard_join.jaccard_join(before).collect()
            assert ids == {r.doc_id for r in told if r.doc_id != r.class_id}
        if name == "decontamination":
            assert ids and decontamination.contaminated(docs, table(spark, FOLDER, "benchmark")).count() == 0
    last = corpus_pipeline.packed(spark, docs, FOLDER)
    assert last.select("doc_id").distinct().count() == docs.count()
    assert last.count() == packing.pieces(docs.select("doc_id", "text"), tokens.vocabulary()).count()


def test_an_empty_table_passes(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
