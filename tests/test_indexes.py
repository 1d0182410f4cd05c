"""Stored indexes, keyed tables, incremental ingestion, the landing folder, structure, sketches and model steps."""

import json
import math
import pathlib
import re
import time
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.functions import scalars
from lexmill.operators import access, corpus, models, postings, quantiles, retrieval, sketches, structure, vectors
from lexmill.sources import landing, store
from lexmill.sources.store import KeyedTable
from lexmill.streaming import ingestion, jobs


def _rows(df):
    return sorted(map(str, map(tuple, df.collect())))


# -- keyed tables


def test_keyed_table_versions(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k", buckets=8)
    with pytest.raises(ValueError):
        t.read()
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    t.write(frame([(i, f"a{i}") for i in range(40)] + [(1, "again")]))
    t.write(frame([(1, "b"), (50, "new")]), frame([(1, ""), (2, ""), (50, "")]).select("k"))
    want = {(i, f"a{i}") for i in range(40)} - {(1, "a1"), (2, "a2")} | {(1, "b"), (50, "new")}
    assert set(map(tuple, t.read().collect())) == want and t.read().count() == len(want)
    assert t.read(0).count() == 41 and (2, "a2") in set(map(tuple, t.read(0).collect()))
    t.compact()
    assert set(map(tuple, t.read().collect())) == want and t.read().count() == len(want)
    assert len(t.manifest()["layers"]) == 0 and t.read(1).count() == len(want)
    # one key more: only its bucket is rewritten, the others stay in the folder of before
    before = {p["folder"] for p in t.manifest()["base"]}
    t.write(frame([(7, "c")]))
    t.compact()
    parts = t.manifest()["base"]
    assert before <= {p["folder"] for p in parts} and sum(len(p["buckets"]) for p in parts if p["folder"] not in before) == 1
    t.vacuum(keep=1)
    assert t.versions() == t.versions()[-1:] and set(map(tuple, t.read().collect())) == want - {(7, "a7")} | {(7, "c")}
    assert {p.name for p in (tmp_path / "t" / "rows").iterdir()} == {p["folder"] for p in parts}


def test_keyed_table_failed_and_repeated_batches(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k", buckets=4)
    one, two = (spark.createDataFrame([(k, v)], "k long, v string") for k, v in ((1, "a"), (2, "b")))
    assert t.write(one, batch=("s", 0)) and not t.write(one, batch=("s", 0)) and not t.write(two, batch=("s", 0))
    bad = two.select("k", F.raise_error(F.lit("broken")).cast("string").alias("v"))
    with pytest.raises(Exception, match="broken"):
        t.write(bad, batch=("s", 1))
    assert t.manifest()["version"] == 0 and _rows(t.read()) == _rows(one)
    assert t.write(two, batch=("s", 1)) and t.write(one, batch=("other", 0))
    assert _rows(t.read()) == _rows(one.unionByName(two))
    # a version that is there is not replaced: the second of two writers goes on after it
    assert not t._commit(t.manifest()) and t.manifest()["batches"] == {"s": 1, "other": 0}
    for i in range(12):
        t.write(spark.createDataFrame([(i, f"n{i}")], "k long, v string"))
    assert len(t.manifest()["layers"]) < KeyedTable.MOST_LAYERS and t.read().count() == 12
    t.write(t.read().limit(0), spark.range(20).select(F.col("id").alias("k")))
    assert t.read().count() == 0
    t.compact()
    assert t.read().count() == 0


# -- postings


def _okapi(chunks, query):
    toks = {k: re.findall(r"\w+", t.lower()) for k, t in chunks.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    score = lambda t: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in re.findall(r"\w+", query.lower()) if w in t)
    return {k: round(score(t), 6) for k, t in toks.items() if round(score(t), 6) != 0}


@pytest.fixture(scope="module")
def library(spark):
    """Chunks in topics, a word in all of them, and one document far longer than a range."""
    rng = np.random.default_rng(3)
    rows = []
    for d in range(120):
        words = [f"t{d % 12}w{k}" for k in range(30)] + ["the"]
        for c in range(600 if d == 0 else 12):
            rows.append((d, f"{d}-{c}", " ".join(rng.choice(words, int(rng.integers(0, 25)))) + (" the" if c % 3 else "")))
    chunks = store.written(spark.createDataFrame(rows, "document_id long, chunk_id string, content string"), "library")
    return {c: t for _, c, t in rows}, chunks, postings.build_index(chunks)


def test_index_equals_okapi(spark, library, monkeypatch):
    texts, chunks, index = library
    asked = {1: "t3w1 t3w2 t3w2", 2: "the", 3: "t1w1 the t7w9", 4: "unknown", 5: ""}
    q = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    for cells in (postings.CELLS, 100):
        monkeypatch.setattr(postings, "CELLS", cells)
        hits, visits = postings.search_index(index, q, 10)
        got = {}
        for r in hits.collect():
            got.setdefault(r.query_id, []).append((r.lexical_rank, r.chunk_id, r.score))
        for k, text in asked.items():
            want = sorted(((-s, c) for c, s in _okapi(texts, text).items()))[:10]
            assert [(c, s) for _, c, s in sorted(got.get(k, []))] == [(c, -s) for s, c in want], text
    assert postings.build_index(chunks.limit(0)).postings.count() == 0
    assert postings.search_index(postings.build_index(chunks.limit(0)), q, 3)[0].count() == 0


def test_fewer_blocks_for_fewer_hits(spark, library):
    """A search with a small k scores fewer ranges, and a word that every range holds is spread over them."""
    texts, _, _ = library
    rng = np.random.default_rng(4)
    rows = [(d, f"{d}-{c}", " ".join(rng.choice([f"w{k}" for k in range(50)], 20)) + (" rare" * (1 + d % 9) if d < 9 and c == 0 else " common")) for d in range(3000) for c in range(3)]
    index = postings.build_index(spark.createDataFrame(rows, "document_id long, chunk_id string, content string"))
    q = spark.createDataFrame([(1, "rare rare common"), (2, "common w1")], "query_id long, text string")
    seen = {k: {r.query_id: (r.visited, r.blocks) for r in postings.search_index(index, q, k)[1].collect()} for k in (1, 200)}
    assert seen[1][1][0] < seen[200][1][0] <= seen[200][1][1] and seen[1][1][0] <= 8
    common = index.postings.filter("token = 'common'")
    assert common.select("range").distinct().count() >= 30 and common.agg(F.max(F.size("chunks"))).first()[0] <= 4 * postings.RANGE_CHUNKS


def test_index_within_scope(spark, library):
    texts, chunks, _ = library
    index = postings.build_index(chunks.withColumn("group", F.col("document_id") % 3))
    q = spark.createDataFrame([(1, "t3w1 the"), (2, "t3w1 the"), (3, "the")], "query_id long, text string")
    scope = spark.createDataFrame([(1, 0), (1, 2), (2, 1)], "query_id long, group long")
    got = {(r.query_id, r.chunk_id) for r in postings.search_index(index, q, 10, scope)[0].collect()}
    for query, groups in ((1, (0, 2)), (2, (1,)), (3, ())):
        want = sorted((-s, c) for c, s in _okapi(texts, "t3w1 the").items() if int(c.split("-")[0]) % 3 in groups)[:10]
        assert {c for k, c in got if k == query} == {c for _, c in want}


def test_groups_share_few_ranges(spark):
    """Chunks of many groups, of which a document has one, still fill ranges of their group."""
    rows = [(d, f"{d}", f"the w{d % 9}", d % 25) for d in range(3000)]
    index = postings.build_index(spark.createDataFrame(rows, "document_id long, chunk_id string, content string, group long"))
    scope = spark.range(25).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("group"))
    visits = postings.search_index(index, spark.createDataFrame([(1, "the w3")], "query_id long, text string"), 10, scope)[1].collect()
    assert [(r.query_id, r.blocks <= 200) for r in visits] == [(1, True)]


def test_many_queries_of_one_term(spark, library):
    """Queries that all ask for one common word are dealt to several tasks of a range and scored in bounded parts."""
    _, _, index = library
    n = 3 * postings.QUERIES
    q = spark.range(n).select(F.col("id").alias("query_id"), F.lit("the").alias("text"))
    out = postings.search_index(index, q, 2)[0].groupBy("chunk_id", "lexical_rank").count().collect()
    assert len(out) == 2 and {r["count"] for r in out} == {n}


def _odd_chunks(spark):
    """Chunks of groups and without, null and empty ones, long ones and words far more frequent than others."""
    rng = np.random.default_rng(8)
    texts = [None, "", "w1 " * 300, "w2 " * 70000, "W1 w2, w3!", *[" ".join(rng.choice([f"w{k}" for k in range(40)], int(rng.integers(1, 60)))) for _ in range(1500)]]
    rows = [(i // 7, f"c{i}", t, None if i % 11 == 0 else i % 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "document_id long, chunk_id string, content string, group long")


def test_index_equals_search_of_plain_chunks(spark, monkeypatch):
    chunks = _odd_chunks(spark)
    q = spark.createDataFrame([(1, "w1 w1 w7"), (2, "w2"), (3, "unknown"), (4, "w5 w6 w39")], "query_id long, text string")
    scope = spark.createDataFrame([(1, 0), (1, 3), (2, 2), (4, 1), (9, 1)], "query_id long, group long")
    columns = ["query_id", "chunk_id", "score", "lexical_rank"]
    want = _rows(retrieval.bm25_search(q, chunks.fillna("", "content"), 6, scope).select(columns))
    for terms in (postings.QUERY_TERMS, 3):
        monkeypatch.setattr(postings, "QUERY_TERMS", terms)
        assert _rows(postings.search_index(postings.build_index(chunks), q, 6, scope)[0].select(columns)) == want and len(want) == 18


def test_index_is_small(spark, monkeypatch):
    """All that is written for an index takes less than three bytes a posting, also where a range holds few chunks of a token."""
    rng, paths, path = np.random.default_rng(5), [], store.scratch_path
    monkeypatch.setattr(store, "scratch_path", lambda *args: paths.append(path(*args)) or paths[-1])
    words = [f"word{k}" for k in range(4000)]
    rows = [(d, f"{d}-{c}", " ".join(rng.choice(words, 50))) for d in range(700) for c in range(10)]
    index = postings.build_index(spark.createDataFrame(rows, "document_id long, chunk_id string, content string"))
    size = sum(p.stat().st_size for root in paths for p in pathlib.Path(root).rglob("*.parquet"))
    n = index.postings.agg(F.sum("df")).first()[0]
    assert n > 340_000 and size < 3 * n, (n, size)


# -- vectors


def _clustered(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, 32)) * 3
    x = centers[rng.integers(0, 20, n)] + rng.normal(size=(n, 32)) * 0.4
    x[::50] = x[0]  # repeated vectors
    x[7] = 0.0
    return store.written(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, embedding array<double>"), "clustered"), x


def test_exact_search_skips_blocks(spark):
    v, x = _clustered(spark, 3000)
    q = v.filter("id % 20 = 0 or id = 7")
    hits, visits = vectors.exact_search(q, v, 5)
    want = retrieval.dense_search(q, v, 5)
    assert _rows(hits.select("query_id", "chunk_id", "sim", "dense_rank")) == _rows(want.select("query_id", "chunk_id", "sim", "dense_rank"))
    share = [r.visited / r.blocks for r in visits.filter("query_id <> 7").collect()]
    assert np.mean(share) < 0.6
    assert vectors.exact_search(q, v.limit(0), 5)[0].count() == 0


def test_vector_index_recall_inserts_and_deletes(spark, tmp_path):
    v, x = _clustered(spark, 4000, 1)
    index = vectors.VectorIndex.build(v.filter("id < 3500"), str(tmp_path / "i"), 10)
    index = vectors.VectorIndex.open(spark, str(tmp_path / "i"))
    q = v.filter("id % 20 = 0")

    def recall(rows):
        pairs = lambda d: {(r.query_id, r.chunk_id) for r in d.collect()}
        found, visits = index.search(q, 10)
        true = pairs(vectors.exact_search(q, rows, 10)[0])
        assert np.mean([r.visited / r.vectors for r in visits.collect()]) < 0.7
        return len(pairs(found) & true) / len(true)

    assert recall(v.filter("id < 3500")) >= 0.9
    index.insert(v.filter("id >= 3500"))
    assert recall(v) >= 0.9
    index.delete(v.filter("id % 3 = 1"))
    rest = v.filter("id % 3 <> 1")
    assert recall(rest) >= 0.9 and index.search(q, 10)[0].filter("chunk_id % 3 = 1").count() == 0
    every = index.search(q, 10, probes=len(index.model.cells))[0]
    hit = every.join(vectors.exact_search(q, rest, 10)[0], ["query_id", "chunk_id"], "left_semi").count()
    assert hit >= 0.97 * every.count()


def test_vector_search_moves_few_rows(spark, tmp_path):
    """Queries are not repeated for their cells: what a search writes and passes on does not grow with cells times queries."""
    v, _ = _clustered(spark, 4000, 2)
    index = vectors.VectorIndex.build(v, str(tmp_path / "i"), 10, probes=60)
    paths, path = [], store.scratch_path
    store.scratch_path = lambda *args: paths.append(path(*args)) or paths[-1]
    try:
        found, visits = index.search(v, 5)
        assert found.count() == 5 * 4000 and found.filter("query_id = chunk_id").count() == 0 and visits.count() == 4000
    finally:
        store.scratch_path = path
    assert sum(p.stat().st_size for root in paths for p in pathlib.Path(root).rglob("*.parquet")) < 1_000_000


# -- ingestion


def _page(i, html):
    return json.dumps({"page_id": i, "html": html})


def test_ingested_pages_by_stream(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.json").write_text("\n".join([_page(1, "<h1>old</h1><p>x</p>"), _page(2, "<h1>two</h1>"), _page(3, "<h1>three</h1>"), *[_page(i, f"<p>page {i} words</p>") for i in range(10, 60)]]))
    stream = lambda: spark.readStream.schema("page_id long, html string").json(str(source))
    run = lambda c: ingestion.ingest_corpus(stream(), root, str(tmp_path / c), buckets=8).awaitTermination(300)
    tables = ingestion.corpus_tables(spark, root, 8)
    headings = lambda: {(r.page_id, r.content) for r in tables["elements"].read().filter("element_type = 'heading'").collect()}
    assert run("c") and headings() == {(1, "old"), (2, "two"), (3, "three")}
    size = sum(p.stat().st_size for p in (tmp_path / "out").rglob("*.parquet"))
    time.sleep(1)
    (source / "2.json").write_text(_page(1, "<h1>new</h1>") + "\n" + _page(3, None))
    assert run("c") and headings() == {(1, "new"), (2, "two")}
    grown = sum(p.stat().st_size for p in (tmp_path / "out").rglob("*.parquet")) - size
    assert 0 < grown < size / 2
    for name in ("chunks", "vectors", "postings"):
        assert {r.page_id for r in tables[name].read().select("page_id").distinct().collect()} == {1, 2, *range(10, 60)}
    # the batch runs again, as after a failure between tables: nothing changes; a new stream goes on after the last version
    again = spark.createDataFrame([(1, "<h1>never</h1>")], "page_id long, html string")
    assert ingestion.apply_batch(root, again, str(tmp_path / "c"), 1, 8) == [] and headings() == {(1, "new"), (2, "two")}
    assert ingestion.apply_batch(root, again, "other", 0, 8) == list(ingestion.TABLES) and (1, "never") in headings()


def test_ingestion_goes_on_after_a_failure_between_tables(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    first = spark.createDataFrame([(i, f"<p>some words of page {i}</p>") for i in range(9)], "page_id long, html string")
    ingestion.apply_batch(root, first, "s", 0, 4)
    change = spark.createDataFrame([(3, "<p>other text</p>"), (4, None)], "page_id long, html string")
    write = KeyedTable.write

    def failing(self, *args, **kwargs):
        if self.path.endswith("vectors"):
            raise RuntimeError("lost")
        return write(self, *args, **kwargs)

    monkeypatch.setattr(KeyedTable, "write", failing)
    with pytest.raises(RuntimeError):
        ingestion.apply_batch(root, change, "s", 1, 4)
    monkeypatch.setattr(KeyedTable, "write", write)
    assert ingestion.apply_batch(root, change, "s", 1, 4) == ["vectors", "postings"]
    held = {name: t.read() for name, t in ingestion.corpus_tables(spark, root, 4).items()}
    ids = {name: {r.page_id for r in t.select("page_id").distinct().collect()} for name, t in held.items()}
    assert all(v == set(range(9)) - {4} for v in ids.values())
    # the index of the ingested pages is that of the pages as they are
    pages = spark.createDataFrame([(i, f"<p>some words of page {i}</p>" if i != 3 else "<p>other text</p>") for i in range(9) if i != 4], "page_id long, html string")
    chunks = ingestion.page_chunks(corpus.page_elements(pages)).withColumnRenamed("page_id", "document_id")
    q = spark.createDataFrame([(1, "words page 5"), (2, "other text")], "query_id long, text string")
    found = postings.search_index(ingestion.ingested_index(spark, root), q, 5)[0]
    assert _rows(found) == _rows(postings.search_index(postings.build_index(chunks), q, 5)[0]) and found.count() > 5


# -- landing


def test_landing_folder(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for name, n in (("a.pdf", 10), ("b.PDF", 100), ("c.docx", 10), ("sub/d e+f.pdf", 20), ("pdf", 1)):
        (folder / name).write_bytes(b"x" * n)
    got = {r.filename: r.reason for r in landing.scan_landing(spark, str(folder), 50).collect()}
    assert got == {"a.pdf": "ACCEPTED", "b.PDF": "FILE_TOO_LARGE", "c.docx": "INVALID_FILE_TYPE", "d e+f.pdf": "ACCEPTED", "pdf": "INVALID_FILE_TYPE"}
    plan = landing.scan_landing(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert {r.filename: len(r.content) for r in landing.read_accepted(spark, str(folder), 50).collect()} == {"a.pdf": 10, "d e+f.pdf": 20}
    run = lambda: landing.record_uploads(spark, str(folder), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination(120)
    assert run()
    (folder / "late.pdf").write_bytes(b"y")
    assert run()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 6 and log.filter("reason = 'INVALID_FILE_TYPE'").count() == 2


# -- structure, sketches, steps and the rest


def test_structure_of_pages():
    html = """<title>The &amp; page</title><style>p{}</style><h1>One</h1>lead <b>text</b><p>first<p>second
      <h2>Two</h2><ul><li>a<ul><li>b</ul>c<li><p>d</p></ul><h3>Three</h3><img src=x alt="pic"><img>
      <table><caption>Cap</caption><tr><th>k<th>v<tr><td>1<td><table><tr><td>in</table> side</table>
      <h2>Four</h2><blockquote>said <p>so</p></blockquote><pre>x  y
z</pre><script>no()</script>"""
    got = structure.page_rows(html)
    assert got == [
        ("title", None, None, "The & page"), ("heading", 1, None, "One"), ("text", None, 1, "lead text"), ("text", None, 1, "first"), ("text", None, 1, "second"), ("heading", 2, 1, "Two"),
        ("list_item", None, 5, "a"), ("list_item", None, 5, "b"), ("list_item", None, 5, "c"), ("list_item", None, 5, "d"), ("heading", 3, 5, "Three"), ("image", None, 10, "pic"), ("image", None, 10, ""),
        ("table", None, 10, "Cap\nk | v\n1 | in side"), ("heading", 2, 1, "Four"), ("quote", None, 14, "said"), ("quote", None, 14, "so"), ("code", None, 14, "x y\nz"),
    ]
    assert structure.page_rows(None) == [] and structure.page_rows("<table><tr><td>open") == [("table", None, None, "open")]
    began = time.time()
    assert len(structure.page_rows("<div>" * 50_000 + "deep")) == 1 and time.time() - began < 10


def test_structure_by_brute_force(spark):
    """Random sequences of blocks: order, levels and parents against a plain walk."""
    rng, pages, want = np.random.default_rng(2), [], []
    for page in range(30):
        html, stack = "", []
        for position in range(int(rng.integers(1, 15))):
            kind = int(rng.integers(0, 9))
            text = f"text {page} {position}"
            if kind < 5:
                level = kind + 1
                stack = [s for s in stack if s[0] < level]
                want.append((page, position, f"{page}-e-{stack[-1][1]}" if stack else str(page), "heading", level, text))
                stack.append((level, position))
                html += f"<h{level}>{text}</h{level}>"
            else:
                tag, name = [("p", "text"), ("li", "list_item"), ("pre", "code"), ("blockquote", "quote")][kind - 5]
                want.append((page, position, f"{page}-e-{stack[-1][1]}" if stack else str(page), name, None, text))
                html += f"<{tag}><b>{text}</b></{tag}>"
        pages.append((page, html))
    got = structure.structured_elements(spark.createDataFrame(pages + [(99, None)], "page_id long, html string"))
    assert sorted(map(str, want)) == _rows(got.select("page_id", "position", "parent_id", "element_type", "level", "content"))


def test_sketches_merge(spark):
    rng = np.random.default_rng(1)
    rows = [(date(2024, 1, 1 + int(d)), int(u), float(x) if u % 9 else None) for d, u, x in zip(rng.integers(0, 10, 30000), rng.integers(0, 9000, 30000), rng.lognormal(0, 4, 30000))]
    df = spark.createDataFrame(rows, "day date, user long, value double")
    daily = store.written(sketches.daily_sketches(df, F.col("day"), [], "user", "value"), "daily-test")
    assert daily.count() == 10
    whole = sketches.merged(daily, [], {"p50": 0.5, "p99": 0.99}).collect()[0]
    values = np.sort([v for _, _, v in rows if v is not None])
    assert whole.rows == 30000 and abs(whole.distinct - len({u for _, u, _ in rows})) < 0.05 * 9000
    for name, q in (("p50", 0.5), ("p99", 0.99)):
        assert abs(np.searchsorted(values, whole[name]) / len(values) - q) < 0.03
    spans = {r.day: r.distinct for r in sketches.merged(sketches.trailing(daily, 3, []), ["day"], {}).collect()}
    last = len({u for d, u, _ in rows if d >= date(2024, 1, 8)})
    assert len(spans) == 10 and abs(spans[date(2024, 1, 10)] - last) < 0.05 * last


@pytest.mark.parametrize("split", [3, 1 << 20])
def test_quantiles_with_outliers(spark, split):
    rng = np.random.default_rng(6)
    groups = {"a": [*rng.normal(size=500), 1e300, -1e300], "b": [*rng.integers(0, 3, 300).astype(float), 1e9], "c": [5.0], "d": [1e-300, 1e-299, 7.0, 7.0, 7.0, 7.0]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("e", None)], "g string, v double")
    got = {r.g: (r.p0, r.p50, r.p95, r.p100) for r in quantiles.exact_quantiles(df, "g", "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, split).collect()}
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, [0, 0.5, 0.95, 1]), rtol=1e-9), g
    assert set(got) == set(groups)


def test_text_step(spark, tmp_path):
    log = str(tmp_path / "sent")

    def factory():
        def model(texts):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts if len(texts) > 1 or t != "bad")
            if "bad" in texts:
                raise ValueError("cannot read this")
            return [None if t == "silent" else t.upper() for t in texts]

        return model

    rows = [(i, t, t == "skipped") for i, t in enumerate(["one", "one", "two", "bad", "silent", None, "skipped", "", "one"])]
    out = {r.id: r for r in models.text_step(spark.createDataFrame(rows, "id long, text string, done boolean"), "text", factory, F.col("done"), 2).collect()}
    assert [out[i].answer for i in (0, 1, 2, 7, 8)] == ["ONE", "ONE", "TWO", "", "ONE"] and not any(out[i].error for i in (0, 1, 2, 7, 8))
    assert "cannot read this" in out[3].error and "no text" in out[4].error and out[3].answer is None
    assert [out[i].skipped for i in range(9)] == [False] * 5 + [True, True, False, False]
    assert "skipped" not in open(log).read() and len(out) == 9


def test_duplicate_starts_over_arrow_batches(spark):
    class Held:
        def __init__(self):
            self.on = None

        def exists(self):
            return self.on is not None

        def get(self):
            return self.on

        def update(self, value):
            self.on = value

    starts = jobs._Starts()
    starts.running = Held()
    late = pd.DataFrame({"status": ["COMPLETED", "QUEUED"], "ts": pd.to_datetime(["2024-01-01 02:00", "2024-01-01 03:00"])})
    early = pd.DataFrame({"status": ["QUEUED", "QUEUED"], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 01:00"])})
    got = pd.concat(list(starts.handleInputRows(("j",), iter([late, early]), None)))
    assert got["verdict"].tolist() == ["accepted", "duplicate", "step", "accepted"] and starts.running.on == (True,)


def test_chunk_table_function(spark):
    d = spark.createDataFrame([(1, "a b c\nd e"), (2, " ".join(map(str, range(200)))), (3, "")], "doc_id long, text string")
    lines = corpus.parents(d)
    assert _rows(corpus.chunk_with(lines, corpus.windows)) == _rows(corpus.children(lines))
    own = corpus.chunk_with(lines, lambda text: [text[:3], text[3:]]).filter("document_id = 1").orderBy("chunk_id").collect()
    assert [r.content for r in own] == ["a b", " c", "d e", ""]


def test_metadata_and_ids(spark):
    df = spark.createDataFrame([(1, '{"page": 3, "tags": ["x"]}'), (2, '{"page": "four"}'), (3, "{oops"), (4, None), (5, '{"other": 1}')], "id long, meta string")
    got = {r.id: (r.page, r.tag) for r in df.select("id", scalars.metadata_field(F.col("meta"), "$.page", "int", 1).alias("page"), scalars.metadata_field(F.col("meta"), "$.tags[0]", "string").alias("tag")).collect()}
    assert got == {1: (3, "x"), 2: (1, None), 3: (1, None), 4: (1, None), 5: (1, None)}
    ids = [r[0] for r in spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc")], "x string, y string").select(scalars.content_id(F.col("x"), F.col("y"))).collect()]
    assert len(set(ids)) == 3 and all(len(i) == 64 for i in ids)


def test_record_gate(spark):
    users = spark.createDataFrame([(1, "USER"), (2, "ADMIN"), (3, "SUPER_ADMIN"), (4, "USER")], "id long, role string")
    records = spark.createDataFrame([(10, 1)], "query_id long, user_id long")
    asked = spark.createDataFrame([(1, 1, 10), (2, 2, 10), (3, 3, 10), (4, 4, 10), (5, 9, 10), (6, 1, 99)], "request_id long, user_id long, query_id long")
    got = {r.request_id: r.outcome for r in access.record_outcome(asked, records, users).collect()}
    assert got == {1: "OK", 2: "OK", 3: "OK", 4: "NOT_AUTHORIZED", 5: "NOT_AUTHORIZED", 6: "DOCUMENT_NOT_FOUND"}


def test_search_by_document_in_waves(spark):
    """Few documents first, or all at once: the same hits; with few, most documents are never searched."""
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(12)]
    rows = [(d, f"{d:03d}-{c}", f"{d:03d}-p{c % 3}", " ".join(rng.choice(words, 8))) for d in range(90) for c in range(5)]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_id string, parent_id string, content string")
    q = spark.createDataFrame([(1, "w1 w2"), (2, "nothing known"), (3, "w5 w5 w7")], "query_id long, text string")
    asked = q.select("query_id").join(chunks.select("document_id").distinct(), F.lit(True)).filter("query_id <> 3 or document_id % 2 = 0")
    vector = lambda d, key, text: store.written(corpus.embed_rows(d, key, text).withColumnRenamed("id", key), "test-vectors")
    args = (asked, q, vector(q, "query_id", "text"), chunks, vector(chunks, "chunk_id", "content"), 25, 7)
    few, every = (retrieval.search_by_document(*args, first=n) for n in (4, 1000))
    assert _rows(few.select("query_id", "chunk_id", "fusion_score", "rank")) == _rows(every.select("query_id", "chunk_id", "fusion_score", "rank")) and few.count() == 21
