"""A training corpus from ``documents`` in five stages; every stage works on all that the one before kept.

language_id    documents whose text is rejected as any learned language go
line_dedup     lines repeated in five or more documents stay only in the last of them
ngram_join     one row of each group of near duplicates stays, the one with the least doc_id (null last); rows of one doc_id
               with different texts are judged apart
decontaminate  documents that hold a benchmark item go
mix            sources are taken up to their target weights

A stage gets (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import cut, meet, spare, table
from lexmill.llm.decontaminate import decontaminate
from lexmill.llm.langid import filter_languages
from lexmill.llm.linededup import dedup_lines
from lexmill.llm.mixing import take_mix
from lexmill.llm.ngramjoin import jaccard_rows, row_key


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = spare(docs, "key")
    rows = cut(jaccard_rows(docs).select("key", "cluster", "doc_id"), "named")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"]
    first = rows.groupBy("cluster").agg(least.alias("_first"), F.count("*").alias("n")).filter("n > 1")
    gone = meet(rows, cut(first, "firsts"), ["cluster"], "n").filter("key <> _first").select(F.col("key").alias(own))
    gone = cut(gone.distinct(), "gone-rows")
    kept = docs.withColumn(own, row_key()).join(gone, own, "left_anti")
    # Repeated rows are copies too; they are few and looked up by key, so other texts do not move for them.
    twice = cut(rows.groupBy(F.col("key").alias(own)).agg(F.count("*").alias("n")).filter("n > 1").select(own), "repeated-rows")
    once = kept.join(twice, own, "left_anti")
    return once.unionByName(kept.join(twice, own, "left_semi").dropDuplicates([own])).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontaminate", decontaminated), ("mix", mix)]

#: Language identification is a trained model, which SQL cannot express; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: the columns of ``documents`` and size, source_size, target and taken."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
