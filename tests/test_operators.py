"""Operators on hand-made frames: empty corpora, ties, nulls, scope and maintenance rules."""

import math
import re

from pyspark.sql import functions as F

from lexmill.operators import access, corpus, maintenance, models, retrieval


def _bm25(chunks, query):
    toks = {k: re.findall(r"\w+", t.lower()) for k, t in chunks.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    score = lambda t: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in re.findall(r"\w+", query.lower()) if w in t)
    return {k: round(score(t), 6) for k, t in toks.items() if round(score(t), 6) != 0}


def test_bm25_with_frequent_and_repeated_terms(spark):
    chunks = {"a": "the cat sat", "b": "the dog sat sat", "c": "the bird", "d": "", "e": "the the cat"}
    c = spark.createDataFrame(list(chunks.items()), "chunk_id string, content string")
    q = spark.createDataFrame([(1, "the cat cat"), (2, "zebra"), (3, "")], "query_id long, text string")
    got = {r.chunk_id: r.score for r in retrieval.bm25_search(q, c, 10).collect() if r.query_id == 1}
    assert got == _bm25(chunks, "the cat cat")
    assert {r.query_id for r in retrieval.bm25_search(q, c, 10).collect()} == {1}
    assert retrieval.bm25_search(q, c.limit(0), 10).count() == 0


def test_fusion_and_parents(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, chunk_id string, dense_rank int")
    s = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id long, chunk_id string, lexical_rank int")
    fused = {r.chunk_id: r for r in retrieval.rrf_fuse(d, s).collect()}
    assert fused["b"].fusion_score == round(1 / 62 + 1 / 61, 9) and fused["a"].lexical_rank is None
    parents = spark.createDataFrame([("a", "p", 1), ("b", "p", 1), ("c", None, 2)], "chunk_id string, parent_id string, document_id long")
    best = retrieval.hybrid_search(d, s, parents, 5).collect()
    assert [(r.chunk_id, r.rank) for r in best] == [("b", 1)]


def test_dense_ties_and_groups(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 2)], i % 3) for i in range(9)], "id long, embedding array<float>, group long")
    q = v.filter("id = 0").drop("group")
    got = [r.chunk_id for r in retrieval.dense_search(q, v.drop("group"), 3).orderBy("dense_rank").collect()]
    assert got == [2, 4, 6]
    only = retrieval.dense_search(v.filter("id = 0").select("id", "embedding", "group"), v, 9).collect()
    assert {r.chunk_id for r in only} == {3, 6}


def test_chunking_windows(spark):
    text = " ".join(map(str, range(130))) + "\n\nshort  one"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kids = corpus.children(corpus.parents(d)).orderBy("chunk_id").collect()
    assert [k.chunk_id for k in kids] == ["1-0-0", "1-0-1", "1-0-2", "1-2-0"]
    assert kids[1].content.split()[0] == "48" and kids[2].content.split()[-1] == "129" and kids[3].content == "short one"


def test_element_rules(spark):
    rows = spark.createDataFrame([("a", None, "picture"), ("", "d", "graph"), ("a", "d", "x"), (None, None, None)], "c string, d string, m string")
    got = rows.select(corpus.element_content(rows.c, rows.d).alias("c"), corpus.element_type(rows.m).alias("m")).collect()
    assert [(r.c, r.m) for r in got] == [("a", "image"), ("d", "graph"), ("a\n\nd", "other"), (None, "other")]


def test_requested_documents(spark):
    users = spark.createDataFrame([(1, "USER"), (2, "SUPER_ADMIN"), (3, "USER")], "id long, role string")
    assigned = spark.createDataFrame([(1, 10), (1, 11)], "user_id long, department_id int")
    docs = spark.createDataFrame([(100, 10), (101, 12)], "id long, department_id int")
    asked = spark.createDataFrame([(1, 1, [100, 100]), (2, 1, [100, 101]), (3, 2, [100, 101]), (4, 3, [100]), (5, 1, []), (6, 1, None), (7, 2, [999])], "query_id long, user_id long, document_ids array<long>")
    got = {r.query_id: r.outcome for r in access.requested_documents(asked, users, assigned, docs).collect()}
    denied = "DOCUMENT_ACCESS_DENIED"
    assert got == {1: "OK", 2: denied, 3: "OK", 4: denied, 5: "ALL_IN_SCOPE", 6: "ALL_IN_SCOPE", 7: denied}


def test_maintenance_rules(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d")], "k long, v string")
    once = maintenance.replace_by_key(old, new, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (2, "d")]
    assert sorted(map(tuple, maintenance.replace_by_key(once, new, "k").collect())) == sorted(map(tuple, once.collect()))
    users = spark.createDataFrame([(1, "A@x", "a", "ADMIN", "INACTIVE", False), (2, "b@x", "b", "USER", "ACTIVE", False), (3, "s@x", "s", "SUPER_ADMIN", "ACTIVE", True)], "id long, email string, name string, role string, status string, is_seed boolean")
    req = spark.createDataFrame([(" a@X ", "a2", "ADMIN"), ("b@x", "b2", "ADMIN"), ("N@x", "n", "USER")], "email string, name string, role string")
    got = {r.email: (r.action, r.name, r.status) for r in maintenance.user_upsert(users, req).collect()}
    assert got == {"a@x": ("update", "a2", "ACTIVE"), "b@x": ("conflict", "b", "ACTIVE"), "n@x": ("insert", "n", "ACTIVE"), "s@x": ("keep", "s", "ACTIVE")}
    assigned = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 10)], "user_id long, department_id int")
    gone = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (2, 99)], "user_id long, department_id int")
    left = {r.id: (r.status, r.remaining) for r in maintenance.remove_memberships(users, assigned, gone).collect()}
    assert left == {1: ("INACTIVE", 1), 2: ("INACTIVE", 0), 3: ("ACTIVE", 1)}


def test_evaluation(spark):
    run = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 9, 1)], "query_id long, document_id long, rank int")
    gold = spark.createDataFrame([(1, 6), (2, 8)], "query_id long, document_id long")
    got = {r.query_id: (r.recall, r.reciprocal_rank, r.ndcg) for r in retrieval.evaluate(run, gold, 10).collect()}
    assert got == {1: (1.0, 0.5, round(1 / math.log2(3), 6)), 2: (0.0, 0.0, 0.0)}


def test_model_step_and_batches(spark):
    seen = []

    def factory():
        def model(texts):
            seen.append(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return model

    d = spark.createDataFrame([(i, "x" * i) for i in range(70)] + [(99, None)], "doc_id long, text string")
    got = {r.id: r.embedding for r in models.model_step(d, "doc_id", "text", factory, 2).collect()}
    assert got[5] == [5.0, 1.0] and got[99] == [0.0, 1.0] and len(got) == 71


def test_chunk_write_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "a b c\nd e"), (2, "f")], "doc_id long, text string")
    kids = corpus.children(corpus.parents(d))
    kids.write.json(str(tmp_path / "children"))
    back = spark.read.schema(kids.schema).json(str(tmp_path / "children"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, kids.collect()))


def test_words_are_hashed_once_a_batch(spark):
    """Vectors from texts or tokens are those of hash_embed, a null text is a zero vector, as is one without tokens."""
    d = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "é B, a-c")], "id long, text string")
    got = {r.id: r.embedding for r in corpus.embed_rows(d, "id", "text").collect()}
    want = {(r.id, r.dim): r.value for r in corpus.hash_embed(d, "id", "text").collect()}
    assert {(i, j): v for i, e in got.items() for j, v in enumerate(e) if v} == want and {len(e) for e in got.values()} == {corpus.EMBED_DIM} and set(got) == {1, 2, 3, 4}
    assert got == {r.id: r.embedding for r in corpus.embed_rows(d.select("id", corpus.tokens(F.col("text")).alias("ts")), "id", "ts").collect()}


def test_documents_are_scored_where_their_texts_are(spark):
    """Statistics of each document alone, for the pairs asked for; words are not shuffled."""
    texts = {(1, "1-a"): "w1 w1 w2", (1, "1-b"): "w3", (1, "1-c"): None, (2, "2-a"): "w1 w4", (2, "2-b"): "w4 w5", (2, "2-c"): "w5 w6", (3, "3-a"): "w1"}
    chunks = spark.createDataFrame([(d, c, t) for (d, c), t in texts.items()], "document_id long, chunk_id string, content string")
    q = spark.createDataFrame([(1, "w1 w1 w3"), (2, ""), (3, "w6 unknown")], "query_id long, text string")
    asked = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 2), (3, 9)], "query_id long, document_id long")
    want = {}
    for k, d in ((1, 1), (1, 2), (3, 2)):
        own = {c: t or "" for (e, c), t in texts.items() if e == d}
        want |= {(k, d, c): s for c, s in _bm25(own, {1: "w1 w1 w3", 3: "w6 unknown"}[k]).items() if s}
    found = retrieval.bm25_by_document(asked, q, chunks, include_zero=False)
    assert {(r.query_id, r.document_id, r.chunk_id): round(r.score, 6) for r in found.collect()} == {k: round(v, 6) for k, v in want.items()} and want
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4  # the plan as run and as it was at first
    every = retrieval.bm25_by_document(asked, q, chunks).collect()
    assert len(every) == 3 + 3 + 3 + 3 and {(r.query_id, r.document_id, r.chunk_id) for r in every if r.score} == set(want)
