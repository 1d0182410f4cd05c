"""Incremental ingestion: pages to elements, chunks, vectors and postings, each a keyed table that takes a layer a batch.

A batch writes only what its pages give, and names its pages as replaced, so a page that changes loses its old elements,
chunks, vectors and postings everywhere.  Every table keeps the number of the last batch of a stream: a batch that failed
between two tables runs again and skips those that have it.  Readers see each table's last version; the search statistics
are those of the pages as they are, deleted and replaced ones left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators import corpus, postings
from lexmill.sources.store import KeyedTable
from lexmill.streaming.jobs import publish

TABLES = ("elements", "chunks", "vectors", "postings")


def corpus_tables(spark: SparkSession, root: str, buckets: int = 64) -> dict[str, KeyedTable]:
    return {name: KeyedTable(spark, f"{root}/{name}", "page_id", buckets) for name in TABLES}


def page_chunks(elements: DataFrame) -> DataFrame:
    """(page_id, parent_id, chunk_id, content, n_tokens): each element with content is the parent of its windows of words."""
    held = elements.filter(F.trim(F.coalesce("content", F.lit(""))) != "").select(F.col("page_id").alias("document_id"), F.col("element_id").alias("parent_id"), "content")
    out = corpus.children(held).withColumnRenamed("document_id", "page_id")
    return out.withColumn("n_tokens", F.size(corpus.tokens(F.col("content"))))


def page_parts(pages: DataFrame) -> dict[str, DataFrame]:
    """The rows of every table for (page_id, html), one row a page; a page without html has none."""
    elements = corpus.page_elements(pages.filter("html is not null"))
    chunks = page_chunks(elements)
    vectors = corpus.embed_rows(chunks.withColumn("id", F.struct("page_id", "chunk_id")), "id", "content").select("id.page_id", "id.chunk_id", "embedding")
    held = chunks.select("page_id", F.struct("chunk_id", corpus.tokens(F.col("content")).alias("ts")).alias("c")).groupBy("page_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    kind = dict(pages.dtypes)["page_id"]
    blocks = held.select("page_id", F.col("c.chunk_id").alias("chunks"), F.col("c.ts").alias("ts")).mapInArrow(postings.page_postings, f"page_id {kind}, {postings.PAGE_POSTINGS}")
    return {"elements": elements, "chunks": chunks, "vectors": vectors, "postings": blocks}


def apply_batch(root: str, batch: DataFrame, name: str | None = None, number: int = 0, buckets: int = 64) -> list[str]:
    """Replace the pages of ``batch`` (page_id, html) in all tables; a null html deletes its page.  Returns the tables written.

    Of several rows of a page the greatest html counts.  With the ``name`` and ``number`` of a batch it is applied once.
    """
    pages = batch.groupBy("page_id").agg(F.max("html").alias("html")).persist()
    tables, parts = corpus_tables(batch.sparkSession, root, buckets), page_parts(pages)
    held = [pages, *(parts[t].persist() for t in ("elements", "chunks"))]  # each is read by the tables after it
    try:
        return [t for t in TABLES if tables[t].write(parts[t], pages.select("page_id"), None if name is None else (name, number))]
    finally:
        for df in held:
            df.unpersist()


def ingest_corpus(pages: DataFrame, root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Apply every micro-batch of a stream of (page_id, html) to the tables under ``root``; its checkpoint names the stream."""
    return publish(pages, lambda batch, number: apply_batch(root, batch, checkpoint, number, buckets), checkpoint)


def ingested_index(spark: SparkSession, root: str) -> postings.Index:
    """The ingested pages as an index to search, packed from their stored postings; no page is tokenised again."""
    return postings.index_of_pages(corpus_tables(spark, root)["postings"].read())
