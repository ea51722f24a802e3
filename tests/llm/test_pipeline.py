from pyspark.sql import functions as F

import corpus_pipeline as P
from pairlight.llm.common import materialise, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    clean = {r.doc_id for r in table(spark, sf, "labels").where("toxic = 0").collect()}
    sizes = {}
    for name, stage in P.STAGES:
        before = docs
        docs = materialise(stage(spark, before, sf), "test")
        sizes[name] = docs.count()
        if name != P.STAGES[-1][0]:
            assert docs.columns == before.columns
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "toxicity":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            assert len(gone & clean) <= 4
    assert all(sizes.values())
    assert docs.groupBy("bin").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] <= 2048


def test_run_on_empty_and_null_documents(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    docs.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, 0), (2, "", "", "", 0)], docs.schema)
    nulls.write.parquet(f"{tmp_path}/n/documents.parquet")
    for d in ("e", "n"):
        table(spark, sf, "labels").write.parquet(f"{tmp_path}/{d}/labels.parquet")
        assert P.run(spark, f"{tmp_path}/{d}").count() == 0


def test_toxic_rows_go(spark, sf):
    docs = table(spark, sf, "documents")
    known = table(spark, sf, "labels").join(docs.where("text IS NOT NULL"), "doc_id")
    toxic = {r.doc_id for r in known.where("toxic = 1").collect()}
    clean = {r.doc_id for r in known.where("toxic = 0").collect()} - toxic
    left = {r.doc_id for r in P.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    assert len(toxic - left) >= len(toxic) / 2
    assert len(clean & left) >= 0.98 * len(clean)


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id < 60").selectExpr("*", "1 AS `odd.name`", "2 AS _row", "3 AS _gone", "4 AS predicted")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
