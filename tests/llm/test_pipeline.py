import corpus_pipeline
from pyspark.sql import functions as F

from ordinate.llm import decontaminate, line_dedup, ngram_join, toxicity

SF = "/root/testdata/sf0.001"


def test_each_stage_by_its_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram join", "decontamination", "byte-level BPE"]
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 7, None).otherwise(F.col("text"))).unionByName(docs.filter("doc_id < 4")).unionByName(docs.filter("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long"))).persist()

    kept = stages["toxicity"](spark, docs, SF)
    model = toxicity.fit(docs, toxicity.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    assert kept.columns == columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if model.score(r.text) < 0.7)

    lines = stages["line dedup"](spark, docs, SF)
    assert lines.columns == columns and lines.count() == docs.count()
    assert lines.filter("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    assert line_dedup.drop_repeated_lines(docs).select("doc_id", "text").exceptAll(lines.select("doc_id", "text")).count() == 0

    once = stages["n-gram join"](spark, docs, SF)
    groups = ngram_join.similar(docs).filter("doc_id IS NOT NULL").select("component_id").distinct().count()
    assert once.columns == columns and once.filter("doc_id IS NOT NULL").count() == groups == once.select("doc_id").distinct().count() - 1

    clean = stages["decontamination"](spark, docs, SF)
    held = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert held and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - held


def test_columns_named_like_the_stages_own(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"n_lines": F.col("doc_id") + 1, "n_dropped": F.lit(7), "label": F.lit("x")})
    kept = dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.filter("n_lines <> doc_id + 1 OR n_dropped <> 7 OR label <> 'x'").count() == 0 and kept.count() == docs.count()


def test_whole_pipeline_and_empty_table(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.n_tokens >= 0 for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
