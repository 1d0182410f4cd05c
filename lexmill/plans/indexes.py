"""Queries of the stored indexes, incremental ingestion and the landing folder, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import scalars
from lexmill.operators import access, corpus, postings, retrieval, sketches, structure, vectors
from lexmill.plans import relational, retrieval as searches
from lexmill.sources import landing, store, views
from lexmill.sources.views import raw, with_views
from lexmill.streaming import ingestion

TOP = 10


def _index(spark: SparkSession, sf: str) -> postings.Index:
    return postings.build_index(corpus.children(corpus.parents(raw(spark, sf, "documents"))))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def bm25_indexed(spark, sf):
    """BM25 from the stored index, ranges that cannot reach the k-th score left out."""
    return postings.search_index(_index(spark, sf), _asked(spark, sf), TOP)[0]


def bm25_scoped(spark, sf):
    """The same within the departments that the asking user may see."""
    group = raw(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.substring("source", 4, 9).cast("long").alias("group"))
    chunks = corpus.children(corpus.parents(raw(spark, sf, "documents"))).join(group, "document_id")
    return postings.search_index(postings.build_index(chunks), _asked(spark, sf), TOP, searches.scope(spark, sf))[0]


def bm25_visits(spark, sf):
    """Per query: ranges that hold one of its tokens and ranges scored."""
    return postings.search_index(_index(spark, sf), _asked(spark, sf), TOP)[1]


def dense_pruned(spark, sf):
    """Exact neighbours from blocks in order of their distance bounds."""
    v = _vectors(spark, sf)
    return vectors.exact_search(v.filter("id % 20 = 0"), v, TOP)[0]


def dense_visits(spark, sf):
    v = _vectors(spark, sf)
    return vectors.exact_search(v.filter("id % 20 = 0"), v, TOP)[1]


def _vector_index(spark: SparkSession, sf: str) -> vectors.VectorIndex:
    return vectors.VectorIndex.build(_vectors(spark, sf), store.scratch_path(spark, "vector-index"), TOP)


def ann_figures(spark, sf):
    """Recall of the stored index over all stated queries and the share of vectors whose codes it compared."""
    asked = _vectors(spark, sf).filter("id % 20 = 0")
    found, visits = _vector_index(spark, sf).search(asked, TOP)
    true = dense_pruned(spark, sf).select("query_id", "chunk_id")
    hits = true.join(found.select("query_id", "chunk_id").withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left").agg(F.count("*").alias("neighbours"), F.sum("hit").alias("hits"))
    seen = visits.agg(F.count("*").alias("queries"), F.avg(F.col("visited") / F.col("vectors")).alias("visited_share"))
    return hits.join(F.broadcast(seen)).select("queries", "neighbours", F.round(F.col("hits") / F.col("neighbours"), 4).alias("recall"), F.round("visited_share", 4).alias("visited_share"))


def _ingested(spark: SparkSession, sf: str) -> str:
    """The pages, ingested in three batches: all with a third as they were before, that third as it is, and a page too many that goes."""
    root, pages = store.scratch_path(spark, "ingested"), raw(spark, sf, "pages").select("page_id", "html")
    before = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<h1>Before</h1><p>An older page</p>"), "html")).otherwise(F.col("html"))
    extra = pages.agg(F.max("page_id").alias("m")).select((F.col("m") + 1).alias("page_id"), F.lit("<h1>Gone</h1><p>soon</p>").alias("html"))  # one row
    ingestion.apply_batch(root, pages.withColumn("html", before).unionByName(extra), "pages", 0)
    ingestion.apply_batch(root, pages.filter("page_id % 3 = 0"), "pages", 1)
    ingestion.apply_batch(root, extra.withColumn("html", F.lit(None).cast("string")), "pages", 2)
    return root


def ingested_elements(spark, sf):
    return ingestion.corpus_tables(spark, _ingested(spark, sf))["elements"].read()


def ingested_bm25(spark, sf):
    """BM25 over the ingested pages' chunks, with the statistics of the pages as they are."""
    return postings.search_index(ingestion.ingested_index(spark, _ingested(spark, sf)), _asked(spark, sf), TOP)[0]


def ingested_dense(spark, sf):
    """The ingested chunks nearest to each passage."""
    held = ingestion.corpus_tables(spark, _ingested(spark, sf))["vectors"].read().select(F.col("chunk_id").alias("id"), "embedding")
    asked = corpus.embed_rows(_asked(spark, sf).withColumn("id", F.concat(F.lit("q"), "query_id")), "id", "text")
    found = retrieval.dense_search(asked, held, TOP, "string")
    return found.withColumn("query_id", F.expr("cast(substring(query_id, 2) as bigint)"))


def replaced_elements(spark, sf):
    """Elements of failed documents replaced in a table by key, the batch sent twice, then compacted."""
    kept = store.KeyedTable(spark, store.scratch_path(spark, "elements"), "document_id")
    kept.write(views.elements(spark, sf).select("document_id", "page", "modality"), batch=("load", 0))
    fresh = views.docs(spark, sf).filter("status = 'FAILED_INDEXING'").select(F.col("id").alias("document_id"), F.lit(1).cast(kept.read().schema["page"].dataType).alias("page"), F.lit("text").alias("modality"))
    for _ in range(2):
        kept.write(fresh, batch=("replace", 0))
    kept.compact()
    return kept.read().groupBy("document_id", "page", "modality").agg(F.count("*").alias("n"))


def landing_scan(spark, sf):
    """Pages land as files, a file a page, and are judged by name and size; 3,000 bytes are the limit here."""
    path = store.scratch_path(spark, "landing")
    ending = F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".pdf").otherwise(".html")
    rows = raw(spark, sf, "pages").select(F.regexp_replace("html", r"[\r\n]", " ").alias("value"), F.concat(F.lit("page-"), "page_id", ending).alias("name"))
    # The folder's name stands for the file's, which Spark chooses.
    rows.write.partitionBy("name").option("lineSep", "\n").text(path)
    files = landing.scan_landing(spark, path, 3000).withColumn("name", F.regexp_extract("path", "name=([^/]+)/", 1))
    return files.select("name", "size_bytes", landing.rejection(F.col("name"), F.col("size_bytes"), 3000).alias("reason"))


def page_structure(spark, sf):
    """Elements of pages in document order, under their headings."""
    return structure.structured_elements(raw(spark, sf, "pages"))


def chunk_table_function(spark, sf):
    """The chunks of ``chunk_documents`` by a Python chunker as a table function."""
    return corpus.chunk_with(corpus.parents(raw(spark, sf, "documents")), corpus.windows)


def content_ids(spark, sf):
    """Repeatable ids of chunks, from where they stand and what they say."""
    chunks = corpus.children(corpus.parents(raw(spark, sf, "documents")))
    return chunks.select("chunk_id", scalars.content_id(F.col("document_id"), F.col("chunk_id"), F.col("content")).alias("content_id"))


def element_metadata(spark, sf):
    """A field of event properties read as variants, every seventh text malformed."""
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return raw(spark, sf, "events").select("event_id", scalars.metadata_field(text, "$.k", "int").alias("k"), scalars.metadata_field(text, "$.page", "int", 1).alias("page"))


def record_access(spark, sf):
    """Whether each clicking user may read the query record asked for."""
    asked = raw(spark, sf, "events").filter("event_type = 'click'").select(F.col("event_id").alias("request_id"), "user_id", (F.col("event_id") * 7 % 997).alias("query_id"))
    return access.record_outcome(asked, relational.records(spark, sf), views.users(spark, sf))


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return store.written(sketches.daily_sketches(raw(spark, sf, "events"), F.to_date("ts"), ["event_type"], "user_id", "value"), "daily")


def sketched_users(spark, sf):
    """Users of each day's last seven days from the days' sketches, and whether the count is within five percent."""
    events = raw(spark, sf, "events").select(F.to_date("ts").alias("day"), "user_id").distinct()
    spans = events.withColumn("day", F.explode(F.sequence("day", F.date_add("day", 6)))).join(events.select("day").distinct(), "day", "left_semi")
    true = spans.groupBy("day").agg(F.count_distinct("user_id").alias("users"))
    found = sketches.merged(sketches.trailing(_daily(spark, sf), 7, []), ["day"], {})
    return true.join(found, "day").select("day", "rows", "users", (F.abs(F.col("distinct") - F.col("users")) <= 0.05 * F.col("users")).alias("within"))


def sketched_latency(spark, sf):
    """Median and 95th percentile of values by event type from the days' sketches: shares of the rows at or below them."""
    marks = {"p50": 0.5, "p95": 0.95}
    found = sketches.merged(_daily(spark, sf), ["event_type"], marks)
    rows = raw(spark, sf, "events").filter("value is not null").join(found, "event_type")
    near = [(F.abs(F.avg(F.when(F.col("value") <= F.col(k), 1.0).otherwise(0.0)) - q) <= 0.03).alias(f"{k}_within") for k, q in marks.items()]
    return rows.groupBy("event_type").agg(F.count("*").alias("rows"), *near)


QUERIES = {f.__name__: f for f in (
    bm25_indexed, bm25_scoped, bm25_visits, dense_pruned, dense_visits, ann_figures, ingested_elements, ingested_bm25, ingested_dense, replaced_elements, landing_scan,
    page_structure, chunk_table_function, content_ids, element_metadata, record_access, sketched_users, sketched_latency,
)}

_ELEMENTS = relational.ORACLES["extract_elements"]
_PAGE_CHUNKS = f"""el AS ({_ELEMENTS}), children AS (SELECT page_id AS document_id, parent_id, parent_id || '-' || ((pos - 1) // 48) AS chunk_id, array_to_string(ws[pos:pos+63], ' ') AS content
  FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 16) + 1, 48)) AS pos FROM
    (SELECT page_id, element_id AS parent_id, list_filter(string_split(content, ' '), lambda x: x <> '') AS ws FROM el WHERE trim(coalesce(content, '')) <> '') WHERE len(ws) > 0))"""
ORACLES = {
    "bm25_indexed": searches.ORACLES["bm25_topk"],
    "bm25_scoped": f"""WITH {searches.SCOPE}, {searches.CHILDREN}, {searches.QUERY}, {searches._bm25('children')},
        s2 AS (SELECT query_id, chunk_id, score FROM s JOIN children USING (chunk_id) JOIN dep USING (document_id) JOIN sc USING (query_id, department_id)) {searches._top('s2', 'score', 'lexical_rank', TOP)}""",
    "dense_pruned": searches.ORACLES["dense_topk"],
    "ingested_elements": _ELEMENTS,
    "ingested_bm25": f"WITH {_PAGE_CHUNKS}, {searches.QUERY}, {searches._bm25('children')} {searches._top('s', 'score', 'lexical_rank', TOP)}",
    "ingested_dense": f"""WITH {_PAGE_CHUNKS}, {searches.QUERY}, {searches._embed('ce', 'children', 'chunk_id', 'content')}, {searches._embed('qe', 'q', 'query_id', 'text')},
        d AS (SELECT k.query_id, k.chunk_id, coalesce(round(sum(qe.value * ce.value), 6), 0) AS sim FROM (SELECT query_id, chunk_id FROM q, children) k LEFT JOIN qe ON qe.id = k.query_id
              LEFT JOIN ce ON ce.id = k.chunk_id AND ce.dim = qe.dim GROUP BY ALL) {searches._top('d', 'sim', 'dense_rank', TOP)}""",
    "chunk_table_function": searches.ORACLES["chunk_documents"],
    "content_ids": f"WITH {searches.CHILDREN} SELECT chunk_id, sha256(document_id || chr(31) || chunk_id || chr(31) || content) AS content_id FROM children",
    "element_metadata": """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k, 1 AS page FROM events""",
    "record_access": with_views("users", f""", {relational.RECORDS}, a AS (SELECT event_id AS request_id, user_id, event_id * 7 % 997 AS query_id FROM events WHERE event_type = 'click')
        SELECT request_id, CASE WHEN r.query_id IS NULL THEN 'DOCUMENT_NOT_FOUND' WHEN r.user_id = a.user_id OR role IN ('SUPER_ADMIN', 'ADMIN') THEN 'OK' ELSE 'NOT_AUTHORIZED' END AS outcome
        FROM a LEFT JOIN records r USING (query_id) LEFT JOIN users u ON u.id = a.user_id"""),
    "sketched_users": """WITH e AS (SELECT ts::DATE AS day, user_id FROM events), d AS (SELECT DISTINCT day FROM e)
        SELECT d.day, count(*) AS rows, count(DISTINCT user_id) AS users, true AS within FROM d JOIN e ON e.day BETWEEN d.day - 6 AND d.day GROUP BY d.day""",
    "sketched_latency": "SELECT event_type, count(*) AS rows, true AS p50_within, true AS p95_within FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "replaced_elements": relational.ORACLES["replace_elements"],
    "landing_scan": r"""WITH f AS (SELECT 'page-' || page_id || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' ELSE '.html' END AS name,
        strlen(regexp_replace(html, '[\r\n]', ' ', 'g')) + 1 AS size_bytes FROM pages)
        SELECT name, size_bytes, CASE WHEN name NOT ILIKE '%.pdf' THEN 'INVALID_FILE_TYPE' WHEN size_bytes > 3000 THEN 'FILE_TOO_LARGE' ELSE 'ACCEPTED' END AS reason FROM f""",
}
