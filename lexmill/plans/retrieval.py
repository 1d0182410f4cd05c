"""Queries of the retrieval operators over documents, benchmark and embeddings, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import corpus, retrieval, vectors
from lexmill.sources import store, views
from lexmill.sources.views import raw

PARENTS = """parents AS (SELECT doc_id AS document_id, doc_id || '-' || (i - 1) AS parent_id, ls[i] AS content
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(ls[i]) <> '')"""
CHILDREN = PARENTS + """, children AS (SELECT document_id, parent_id, parent_id || '-' || ((pos - 1) // 48) AS chunk_id, array_to_string(ws[pos:pos+63], ' ') AS content
  FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 16) + 1, 48)) AS pos FROM (SELECT document_id, parent_id, list_filter(string_split(content, ' '), lambda x: x <> '') AS ws FROM parents) WHERE len(ws) > 0))"""
QUERY = "q AS (SELECT item_id AS query_id, text FROM benchmark)"


def _tok(src: str, key: str, text: str) -> str:
    return rf"SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS token FROM {src}"


def _bm25(chunks: str) -> str:
    """Common table expressions up to s(query_id, chunk_id, score)."""
    return f"""tk AS MATERIALIZED ({_tok(chunks, 'chunk_id', 'content')}), po AS MATERIALIZED (SELECT chunk_id, token, count(*) AS tf FROM tk GROUP BY ALL),
 le AS (SELECT chunk_id, len(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS len FROM {chunks}), st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM le),
 tr AS (SELECT token, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM (SELECT token, count(*) AS df FROM po GROUP BY token), st),
 te AS MATERIALIZED (SELECT *, CASE WHEN raw_idf < 0 THEN 0.25 * avg(raw_idf) OVER () ELSE raw_idf END AS idf FROM tr),
 qt AS (SELECT query_id, token, count(*) AS qf FROM ({_tok('q', 'query_id', 'text')}) GROUP BY ALL),
 s AS (SELECT query_id, chunk_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))), 6) AS score
       FROM po JOIN qt USING (token) JOIN te USING (token) JOIN le USING (chunk_id) GROUP BY ALL HAVING score <> 0)"""


def _embed(name: str, src: str, key: str, text: str) -> str:
    return f"""{name}_n AS (SELECT id, (('0x' || substr(md5(token), 1, 8))::BIGINT % 64)::INT AS dim, count(*) AS n FROM ({_tok(src, key + ' AS id', text)}) GROUP BY ALL),
 {name} AS (SELECT id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS value FROM {name}_n)"""


def _top(src: str, score: str, rank: str, k: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, chunk_id) AS {rank} FROM {src} QUALIFY {rank} <= {k}"


def _hybrid(dense_k: int, sparse_k: int, final_k: int, scoped: bool) -> str:
    """Common table expressions up to h, the final hits; with scope from sc(query_id, document_id) pairs of departments."""
    allow = "JOIN children USING (chunk_id) JOIN dep USING (document_id) JOIN sc USING (query_id, department_id)" if scoped else ""
    return f"""{CHILDREN}, {QUERY}, {_bm25('children')}, {_embed('ce', 'children', 'chunk_id', 'content')}, {_embed('qe', 'q', 'query_id', 'text')},
 s2 AS (SELECT query_id, chunk_id, score FROM s {allow}),
 d0 AS (SELECT qe.id AS query_id, ce.id AS chunk_id, round(sum(qe.value * ce.value), 6) AS sim FROM qe JOIN ce USING (dim) GROUP BY ALL), d2 AS (SELECT query_id, chunk_id, sim FROM d0 {allow}),
 sp AS ({_top('s2', 'score', 'lexical_rank', sparse_k)}), de AS ({_top('d2', 'sim', 'dense_rank', dense_k)}),
 fu AS (SELECT query_id, chunk_id, dense_rank, lexical_rank, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 9) AS fusion_score
        FROM de FULL JOIN sp USING (query_id, chunk_id)),
 pd AS (SELECT fu.*, parent_id, document_id FROM fu JOIN children USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY fusion_score DESC, chunk_id) = 1),
 h AS ({_top('pd', 'fusion_score', 'rank', final_k)})"""


SCOPE = f"""u AS ({views.SQL['users']}), a AS ({views.SQL['assignments']}), dp AS ({views.SQL['departments']}), dep AS (SELECT doc_id AS document_id, substr(source, 4)::INT AS department_id FROM documents),
 sc AS (SELECT item_id AS query_id, department_id FROM benchmark JOIN a ON a.user_id = item_id UNION SELECT item_id, dp.id FROM benchmark JOIN u ON u.id = item_id AND role = 'SUPER_ADMIN', dp)"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.children(corpus.parents(raw(spark, sf, "documents")))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def scope(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, group): the departments that the asking user may see; query i is asked by user i."""
    asked = _asked(spark, sf).select("query_id")
    own = asked.join(views.assignments(spark, sf), F.col("query_id") == F.col("user_id")).select("query_id", F.col("department_id").alias("group"))
    supers = asked.join(views.users(spark, sf).filter("role = 'SUPER_ADMIN'"), F.col("query_id") == F.col("id")).select("query_id")
    every = views.departments(spark, sf).agg(F.collect_list("id").alias("all"))  # one row
    return own.unionByName(supers.join(F.broadcast(every)).select("query_id", F.explode("all").alias("group"))).distinct()


def _search(spark: SparkSession, sf: str, dense_k: int, sparse_k: int, final_k: int, scoped: bool) -> DataFrame:
    chunks, asked = _chunks(spark, sf), _asked(spark, sf)
    asking = corpus.embed_rows(asked.withColumn("qid", F.concat(F.lit("q"), "query_id")), "qid", "text")
    limits = scope(spark, sf) if scoped else None
    if scoped:
        group = raw(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.substring("source", 4, 9).cast("int").alias("group"))
        chunks = chunks.join(group, "document_id")
        asking = asking.join(limits.select(F.concat(F.lit("q"), "query_id").alias("id"), "group"), "id")
    # Tokenised once: embedded and searched, and looked up.
    chunks = store.written(chunks.withColumn("ts", corpus.tokens(F.col("content"))).drop("content"), "chunks")
    if scoped:
        vectors = corpus.embed_rows(chunks.withColumn("id", F.struct("chunk_id", "group")), "id", "ts").select("id.chunk_id", "id.group", "embedding").withColumnRenamed("chunk_id", "id")
    else:
        vectors = corpus.embed_rows(chunks, "chunk_id", "ts")
    dense = retrieval.dense_search(asking, vectors, dense_k, "string").withColumn("query_id", F.expr("cast(substring(query_id, 2) as bigint)"))
    sparse = retrieval.bm25_search(asked, chunks, sparse_k, limits)
    return retrieval.hybrid_search(dense, sparse, chunks, final_k)


def chunk_documents(spark, sf):
    return _chunks(spark, sf)


def hash_embed(spark, sf):
    e = corpus.hash_embed(raw(spark, sf, "documents"), "doc_id", "text")
    return e.select(F.col("id").alias("doc_id"), "dim", F.round("value", 6).alias("value"))


def scan_corpus(spark, sf):
    vectors = raw(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"))
    found, _ = corpus.load_corpus(vectors, corpus.parents(raw(spark, sf, "documents")))
    _, lines = corpus.load_corpus(vectors, corpus.parents(raw(spark, sf, "documents")))
    return lines.select("document_id", "parent_id", F.length("content").alias("n_chars")).unionByName(found.select("document_id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("n_chars")))


def bm25_stats(spark, sf):
    return retrieval.bm25_terms(_chunks(spark, sf)).select("token", "df", "n", F.round("avgdl", 6).alias("avgdl"), F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf):
    return retrieval.bm25_search(_asked(spark, sf), _chunks(spark, sf), 10)


def dense_topk(spark, sf):
    v = raw(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.dense_search(v.filter("id % 20 = 0"), v, 10)


def ann_topk(spark, sf):
    v = raw(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = vectors.VectorIndex.build(v, store.scratch_path(spark, "vector-index"), 10)
    return index.search(v.filter("id % 20 = 0"), 10)[0]


def ann_recall(spark, sf):
    """Recall of the approximate search against the exact one over all stated queries."""
    found, true = (store.written(d.select("query_id", "chunk_id"), "neighbours") for d in (ann_topk(spark, sf), dense_topk(spark, sf)))
    share = true.join(found, ["query_id", "chunk_id"], "left_semi").agg(F.count("*").alias("hits")).join(F.broadcast(true.agg(F.count("*").alias("neighbours"), F.count_distinct("query_id").alias("queries"))))
    return share.select("queries", "neighbours", (F.col("hits") >= 0.9 * F.col("neighbours")).alias("reaches_nine_tenths"))


def rrf_fusion(spark, sf):
    docs = raw(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    v = raw(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = _asked(spark, sf)
    dense = retrieval.dense_search(v.join(asked, F.col("id") == F.col("query_id"), "left_semi"), v, 10)
    return retrieval.rrf_fuse(dense, retrieval.bm25_search(asked, docs, 10)).select("query_id", "chunk_id", "dense_rank", "lexical_rank", "fusion_score")


_HITS = ["query_id", "chunk_id", "parent_id", "document_id", "dense_rank", "lexical_rank", "fusion_score", "rank"]


def hybrid_search(spark, sf):
    return _search(spark, sf, 10, 10, 8, False).select(*_HITS)


def parent_dedupe(spark, sf):
    hits = retrieval.bm25_search(_asked(spark, sf), _chunks(spark, sf), 100).withColumnRenamed("score", "fusion_score")
    hits = hits.join(_chunks(spark, sf).select("chunk_id", "parent_id"), "chunk_id")
    return retrieval.best_per_parent(hits, 25).select("query_id", "parent_id", "chunk_id", "fusion_score", "rank")


def retrieval_search(spark, sf):
    hits = _search(spark, sf, 10, 10, 8, True)
    return hits.select("query_id", "rank", "document_id", "chunk_id", "fusion_score", F.array_join(retrieval.retrieval_sources("dense_rank", "lexical_rank"), ",").alias("sources"))


def _with_text(spark, sf, hits):
    """Hits with the chunk's content and its parent's page and modality; a page is a document's line here."""
    chunks = _chunks(spark, sf).select("chunk_id", "content", corpus.line_page(F.col("parent_id")).alias("page"), corpus.line_modality(F.col("content")).alias("modality"))
    return hits.join(chunks, "chunk_id")


def hit_sources(spark, sf):
    hits = _with_text(spark, sf, _search(spark, sf, 10, 10, 8, False))
    return hits.select("query_id", "rank", *retrieval.hit_source())


def context_assembly(spark, sf):
    hits = _with_text(spark, sf, _search(spark, sf, 10, 10, 8, False))
    out = _asked(spark, sf).join(retrieval.assemble_context(hits), "query_id", "left")
    return out.select("query_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_tables", F.lit(0)).alias("n_tables"), F.coalesce("prompt", F.lit("NO_EVIDENCE")).alias("prompt"))


def search_by_document(spark, sf):
    """Every query over each document of its scope alone."""
    chunks, asked = _chunks(spark, sf), _asked(spark, sf)
    group = raw(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.substring("source", 4, 9).cast("int").alias("group"))
    wanted = scope(spark, sf).join(group, "group").select("query_id", "document_id")
    vectors = corpus.embed_rows(chunks, "chunk_id", "content").withColumnRenamed("id", "chunk_id")
    asking = corpus.embed_rows(asked, "query_id", "text").withColumnRenamed("id", "query_id")
    return retrieval.search_by_document(wanted, asked, asking, chunks, vectors, 25, 7).select("query_id", "document_id", "parent_id", "chunk_id", "fusion_score", "rank")


def bm25_by_document(spark, sf):
    """Scores above zero only, as far as the statistics of one document give any."""
    group = raw(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.substring("source", 4, 9).cast("int").alias("group"))
    wanted = scope(spark, sf).join(group, "group").select("query_id", "document_id")
    scored = retrieval.bm25_by_document(wanted, _asked(spark, sf), _chunks(spark, sf), include_zero=False)
    return scored.groupBy("query_id").agg(F.count("*").alias("chunks"), F.round(F.sum("score"), 3).alias("total"))


def rag_evidence(spark, sf):
    hits = _with_text(spark, sf, _search(spark, sf, 25, 25, 7, True))
    element = F.coalesce(F.nullif("modality", F.lit("")), F.lit("text")).alias("element_type")
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "document_id", "page", "chunk_id", element))).alias("e"))
    seen = scope(spark, sf).select("query_id").distinct().withColumn("in_scope", F.lit(True))
    out = _asked(spark, sf).join(listed, "query_id", "left").join(seen, "query_id", "left")
    outcome = F.when(F.col("in_scope").isNull(), "DOCUMENT_NOT_FOUND").when(F.col("e").isNull(), "INGESTION_FAILED").otherwise("OK")
    return out.select("query_id", outcome.alias("outcome"), F.coalesce(F.size("e"), F.lit(0)).alias("retrieved_chunks"), F.coalesce(F.to_json("e"), F.lit("[]")).alias("sources_json"))


def rerank(spark, sf):
    hits = _search(spark, sf, 25, 25, 25, False)
    out = retrieval.rerank(hits, _asked(spark, sf), _chunks(spark, sf), 7)
    return out.select("query_id", "chunk_id", "coverage", "fusion_score", "rerank")


def hit_rate(spark, sf):
    hits = retrieval_search(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"))
    all_ = _asked(spark, sf).join(hits, "query_id", "left")
    return all_.agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)), 6).alias("hit_rate"))


def source_contribution(spark, sf):
    return retrieval_search(spark, sf).groupBy("sources").agg(F.count("*").alias("hits"))


def scope_violations(spark, sf):
    found = retrieval_search(spark, sf).select("query_id", "document_id")
    group = raw(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.substring("source", 4, 9).cast("int").alias("group"))
    outside = found.join(group, "document_id").join(scope(spark, sf), ["query_id", "group"], "left_anti")
    return outside.agg(F.count("*").alias("violations"))


def _gold(spark, sf):
    """Documents that share a run of eight tokens with the item, or hold the whole of a shorter one."""
    tokenised = lambda d, key: d.select(key, corpus.tokens(F.col("text")).alias("ts")).filter(F.size("ts") > 0)
    run = lambda n: lambda i: F.array_join(F.slice("ts", i, n), " ")
    items = tokenised(_asked(spark, sf), "query_id").withColumn("n", F.least(F.size("ts"), F.lit(8)))
    lengths = [r["n"] for r in items.select("n").distinct().collect()]  # eight at most
    runs = lambda n: F.when(F.size("ts") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("ts") - (n - 1), F.lit(1))), run(n)))
    want = items.select("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("ts") - F.col("n") + 1), lambda i: F.array_join(F.slice("ts", i, F.col("n")), " "))).alias("w")).distinct()
    held = tokenised(raw(spark, sf, "documents"), "doc_id")
    held = held.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*map(runs, lengths)))))).alias("w")) if lengths else held.select("doc_id", F.lit("").alias("w"))
    return held.join(want, "w").select("query_id", F.col("doc_id").alias("document_id")).distinct()


def retrieval_eval(spark, sf):
    run = _search(spark, sf, 25, 25, 10, False).select("query_id", "document_id", "rank")
    return retrieval.evaluate(run, _gold(spark, sf), 10)


QUERIES = {f.__name__: f for f in (
    chunk_documents, hash_embed, scan_corpus, bm25_stats, bm25_topk, dense_topk, ann_topk, ann_recall, rrf_fusion, hybrid_search, parent_dedupe, retrieval_search,
    context_assembly, hit_sources, search_by_document, bm25_by_document, rag_evidence, rerank, hit_rate, source_contribution, scope_violations, retrieval_eval,
)}

_PAGE = "(split_part(children.parent_id, '-', 2)::INT + 1)"
_MODALITY = "CASE WHEN content LIKE '%|%|%' THEN 'table' WHEN content LIKE '%[image]%' THEN 'image' ELSE '' END"
_BY_DOCUMENT = f"""w AS (SELECT DISTINCT query_id, document_id FROM sc JOIN dep USING (department_id)),
 tk AS MATERIALIZED (SELECT document_id, chunk_id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS token FROM children WHERE document_id IN (SELECT document_id FROM w)),
 po AS MATERIALIZED (SELECT document_id, chunk_id, token, count(*) AS tf FROM tk GROUP BY ALL),
 le AS MATERIALIZED (SELECT document_id, chunk_id, len(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS len FROM children WHERE document_id IN (SELECT document_id FROM w)),
 st AS (SELECT document_id, count(*) AS n, avg(len) AS avgdl FROM le GROUP BY 1),
 tr AS (SELECT document_id, token, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM (SELECT document_id, token, count(*) AS df FROM po GROUP BY ALL) JOIN st USING (document_id)),
 te AS MATERIALIZED (SELECT *, CASE WHEN raw_idf < 0 THEN 0.25 * avg(raw_idf) OVER (PARTITION BY document_id) ELSE raw_idf END AS idf FROM tr),
 qt AS (SELECT query_id, token, count(*) AS qf FROM ({_tok('q', 'query_id', 'text')}) GROUP BY ALL),
 sd AS MATERIALIZED (SELECT query_id, document_id, chunk_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))), 6) AS score
   FROM w JOIN qt USING (query_id) JOIN te USING (document_id, token) JOIN po USING (document_id, token) JOIN le USING (document_id, chunk_id) GROUP BY ALL)"""

_SEARCH = f"WITH {SCOPE}, {_hybrid(10, 10, 8, True)}"
_SOURCES = "concat_ws(',', CASE WHEN dense_rank IS NOT NULL THEN 'dense' END, CASE WHEN lexical_rank IS NOT NULL THEN 'sparse' END)"
ORACLES = {
    "chunk_documents": f"WITH {CHILDREN} SELECT document_id, parent_id, chunk_id, content FROM children",
    "hash_embed": f"WITH {_embed('e', 'documents', 'doc_id', 'text')} SELECT id AS doc_id, dim, round(value, 6) AS value FROM e",
    "scan_corpus": f"""WITH {PARENTS} SELECT document_id, parent_id, length(content) AS n_chars FROM parents WHERE document_id IN (SELECT vec_id FROM embeddings)
        UNION ALL SELECT vec_id, NULL, 0 FROM embeddings WHERE vec_id IN (SELECT document_id FROM parents)""",
    "bm25_stats": f"WITH {CHILDREN}, {QUERY}, {_bm25('children')} SELECT token, df, n, round(avgdl, 6) AS avgdl, round(idf, 6) AS idf FROM te",
    "bm25_topk": f"WITH {CHILDREN}, {QUERY}, {_bm25('children')} {_top('s', 'score', 'lexical_rank', 10)}",
    "dense_topk": f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
        FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) {_top('p', 'sim', 'dense_rank', 10)}""",
    "ann_recall": """WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT count(*) AS queries, sum(least(10, n - 1))::BIGINT AS neighbours, true AS reaches_nine_tenths FROM embeddings, n WHERE vec_id % 20 = 0""",
    "rrf_fusion": f"""WITH {QUERY}, dc AS (SELECT doc_id AS chunk_id, text AS content FROM documents), {_bm25('dc')}, sp AS ({_top('s', 'score', 'lexical_rank', 10)}),
        p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
        FROM embeddings a JOIN q ON q.query_id = a.vec_id, embeddings b WHERE a.vec_id <> b.vec_id), de AS ({_top('p', 'sim', 'dense_rank', 10)})
        SELECT query_id, chunk_id, dense_rank, lexical_rank, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 9) AS fusion_score
        FROM de FULL JOIN sp USING (query_id, chunk_id)""",
    "hybrid_search": f"WITH {_hybrid(10, 10, 8, False)} SELECT {', '.join(_HITS)} FROM h",
    "parent_dedupe": f"""WITH {CHILDREN}, {QUERY}, {_bm25('children')}, t AS ({_top('s', 'score', 'lexical_rank', 100)}),
        p AS (SELECT query_id, parent_id, chunk_id, score AS fusion_score FROM t JOIN children USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, chunk_id) = 1)
        {_top('p', 'fusion_score', 'rank', 25)}""",
    "retrieval_search": f"{_SEARCH} SELECT query_id, rank, document_id, chunk_id, fusion_score, {_SOURCES} AS sources FROM h",
    "context_assembly": f"""WITH {_hybrid(10, 10, 8, False)}, x AS (SELECT query_id, rank, chunk_id, h.parent_id, content, {_PAGE} AS page, {_MODALITY} AS modality FROM h JOIN children USING (chunk_id)),
        e AS (SELECT query_id, count(*) AS n, count(*) FILTER (modality = 'table') AS t, string_agg('[' || rank || '] ' || CASE modality WHEN 'table' THEN 'table of ' || parent_id || ' ' WHEN 'image' THEN 'image ' || chunk_id || ' ' ELSE '' END || '(p. ' || page || ') ' || content, chr(10) ORDER BY rank) AS p FROM x GROUP BY query_id)
        SELECT query_id, coalesce(n, 0) AS n_items, coalesce(t, 0) AS n_tables, coalesce(p, 'NO_EVIDENCE') AS prompt FROM q LEFT JOIN e USING (query_id)""",
    "hit_sources": f"WITH {_hybrid(10, 10, 8, False)} SELECT query_id, rank, h.document_id, {_PAGE} AS page, chunk_id, coalesce(nullif({_MODALITY}, ''), 'text') AS element_type FROM h JOIN children USING (chunk_id)",
    "search_by_document": f"""WITH {SCOPE}, {CHILDREN}, {QUERY}, {_embed('ce', 'children', 'chunk_id', 'content')}, {_embed('qe', 'q', 'query_id', 'text')}, {_BY_DOCUMENT},
        d0 AS (SELECT w.query_id, w.document_id, chunk_id, round(sum(qe.value * ce.value), 6) AS sim FROM w JOIN le USING (document_id) JOIN ce ON ce.id = chunk_id JOIN qe ON qe.id = w.query_id AND qe.dim = ce.dim GROUP BY ALL),
        b AS (SELECT query_id, document_id, chunk_id, coalesce(score, 0) AS score, coalesce(sim, 0) AS sim FROM w JOIN le USING (document_id) LEFT JOIN sd USING (query_id, document_id, chunk_id) LEFT JOIN d0 USING (query_id, document_id, chunk_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) AS l, row_number() OVER (PARTITION BY query_id, document_id ORDER BY sim DESC, chunk_id) AS d FROM b),
        f AS (SELECT query_id, document_id, chunk_id, round(CASE WHEN d <= 25 THEN 1.0::DOUBLE / (60 + d) ELSE 0 END + CASE WHEN l <= 25 THEN 1.0::DOUBLE / (60 + l) ELSE 0 END, 9) AS fusion_score FROM r WHERE least(l, d) <= 25),
        p AS (SELECT f.query_id, f.document_id, parent_id, chunk_id, fusion_score FROM f JOIN children USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY fusion_score DESC, chunk_id) = 1),
        k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY fusion_score DESC, chunk_id) <= 7) {_top('k', 'fusion_score', 'rank', 7)}""",
    "bm25_by_document": f"WITH {SCOPE}, {CHILDREN}, {QUERY}, {_BY_DOCUMENT} SELECT query_id, count(*) AS chunks, round(sum(score), 3) AS total FROM sd WHERE score <> 0 GROUP BY query_id",
    "rag_evidence": f"""WITH {SCOPE}, {_hybrid(25, 25, 7, True)}, x AS (SELECT query_id, rank, h.document_id, chunk_id, {_PAGE} AS page, coalesce(nullif({_MODALITY}, ''), 'text') AS element_type FROM h JOIN children USING (chunk_id)),
        e AS (SELECT query_id, count(*) AS n, '[' || string_agg('{{"rank":' || rank || ',"document_id":' || document_id || ',"page":' || page || ',"chunk_id":"' || chunk_id || '","element_type":"' || element_type || '"}}', ',' ORDER BY rank) || ']' AS j FROM x GROUP BY query_id)
        SELECT query_id, CASE WHEN query_id NOT IN (SELECT query_id FROM sc) THEN 'DOCUMENT_NOT_FOUND' WHEN n IS NULL THEN 'INGESTION_FAILED' ELSE 'OK' END AS outcome, coalesce(n, 0) AS retrieved_chunks, coalesce(j, '[]') AS sources_json
        FROM q LEFT JOIN e USING (query_id)""",
    "rerank": rf"""WITH {_hybrid(25, 25, 25, False)}, r AS (SELECT query_id, chunk_id, fusion_score, round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[\p{{L}}\p{{N}}]+')), list_distinct(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')))) / greatest(1, len(list_distinct(regexp_extract_all(lower(q.text), '[\p{{L}}\p{{N}}]+')))), 6) AS coverage
        FROM h JOIN q USING (query_id) JOIN children USING (chunk_id)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, fusion_score DESC, chunk_id) AS rerank FROM r QUALIFY rerank <= 7""",
    "hit_rate": f"{_SEARCH} SELECT count(*) AS queries, round(avg(CASE WHEN query_id IN (SELECT query_id FROM h) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM q",
    "source_contribution": f"{_SEARCH} SELECT {_SOURCES} AS sources, count(*) AS hits FROM h GROUP BY 1",
    "scope_violations": f"{_SEARCH} SELECT count(*) AS violations FROM h JOIN dep USING (document_id) WHERE (query_id, department_id) NOT IN (SELECT (query_id, department_id) FROM sc)",
    "retrieval_eval": rf"""WITH {_hybrid(25, 25, 10, False)},
        dt AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ts FROM documents), qq AS (SELECT query_id, ts, least(len(ts), 8) AS n FROM (SELECT query_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ts FROM q) WHERE len(ts) > 0),
        dw AS (SELECT DISTINCT doc_id, array_to_string(ts[i:i+n-1], ' ') AS w FROM (SELECT doc_id, ts, n, unnest(range(1, len(ts) - n + 2)) AS i FROM dt, (SELECT DISTINCT n FROM qq) WHERE len(ts) >= n)),
        qw AS (SELECT DISTINCT query_id, array_to_string(ts[i:i+n-1], ' ') AS w FROM (SELECT query_id, ts, n, unnest(range(1, len(ts) - n + 2)) AS i FROM qq)),
        gold AS (SELECT DISTINCT query_id, doc_id AS document_id FROM dw JOIN qw USING (w)), n AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
        f AS (SELECT query_id, document_id, min(rank) AS rank FROM h GROUP BY ALL), x AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM f JOIN gold USING (query_id, document_id) GROUP BY 1)
        SELECT query_id, n_gold, coalesce(found, 0) AS found, round(coalesce(found, 0) / n_gold, 6) AS recall, round(coalesce(1 / first, 0), 6) AS reciprocal_rank,
        round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg FROM n LEFT JOIN x USING (query_id)""",
}
