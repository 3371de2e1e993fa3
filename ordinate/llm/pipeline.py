"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns
what it keeps of ``docs``, with the columns of ``docs``; the last returns ids.

Rows with a null id pass the n-gram stage: they can't be named as the one of
their group that stays. Rows that repeat an id are one document there, of which
the row with the least text stays. Null texts pass all stages and are encoded as
the empty text. Tables without rows give results without rows. Very long texts
are treated whole by each stage; equal rows have equal fates. Extra columns pass
whatever their names, but names that begin with two underscores are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, decontaminate, line_dedup, ngram_join, toxicity
from .common import modest, screened, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    modest(spark)
    model = toxicity.fit(docs, toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.scored(docs, model, score_col="__score").filter(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many hold; ``n_chars`` follows the text."""
    modest(spark)
    kept = line_dedup.drop_repeated_lines(docs, lines_col="__lines", dropped_col="__dropped")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the smallest id."""
    modest(spark)
    found = ngram_join.similar(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows"), F.max(F.col("component_id") == F.col("doc_id")).alias("__stays"))
    # only ids that go, or repeat, are looked at one by one; other rows pass where they lie
    odd = written(found.filter("__rows > 1 OR NOT __stays"), "odd-ids")
    seen = screened(docs, odd.select("doc_id"), "doc_id")
    first = Window.partitionBy("doc_id").orderBy("text")
    rest = seen.filter("__maybe AND doc_id IS NOT NULL").join(odd, "doc_id", "left").filter("coalesce(__stays, true)").withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    return seen.filter("NOT __maybe OR doc_id IS NULL").select(*docs.columns).unionByName(rest.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    modest(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.flagged(docs, benchmark).filter(~F.col("__held")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, counted and digested, and the digest of their bytes."""
    modest(spark)
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]
#: SQL can express neither the toxicity scores nor the edit matching.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
