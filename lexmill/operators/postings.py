"""A stored inverted index in packed blocks, and BM25 top-k that skips ranges of chunks.

Chunks are dealt where they are tokenised: a segment holds up to SEGMENT_CHUNKS chunks that lie together, and a range up to
RANGE_CHUNKS of one group among them.  A posting block holds the chunks of one token in one range: places within the range
and frequencies.  The table has a row for each segment and token bucket, which packs its tokens and their blocks into arrays
of small numbers, and a row for each segment with the ids and lengths of its chunks.  It lies in folders by token bucket, so
a search reads the buckets of its tokens.

A search takes the blocks of its tokens out of those rows, brings them together by segment, and sums the most that each token
can add by range.  It scores the few best ranges of each query, and then only ranges whose bound reaches the k-th score.
Nothing is tokenised again, and what moves are packed rows, so no token is a hot key however common it is.

What a token adds to a chunk follows from frequency and length when a search is made, so it holds whatever the collection's
statistics are: the same rows serve an index that grows (see lexmill.streaming.ingestion).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexmill.operators.corpus import tokens
from lexmill.operators.pruning import in_waves
from lexmill.operators.retrieval import B, EPSILON, K1, QUERY_TERMS, ranked
from lexmill.sources.store import written

RANGE_CHUNKS = 64
#: Chunks of a segment; its ranges are numbered within so many bits.
SEGMENT_BITS = 13
SEGMENT_CHUNKS = 1 << SEGMENT_BITS
#: Token buckets, tasks that write a bucket, and queries that meet a segment in one row.
BUCKETS = 64
BUCKET_TASKS = 8
QUERIES = 2048
#: Cells of queries times chunks that are scored at a time.
CELLS = 1 << 22
_BYTES = ("sizes", "ranges", "ns", "places", "tfs", "lens", "counts", "groups")


@dataclass
class Index:
    """``packed``: rows of segments, see ``packed_schema``; ``terms``: (token, df, idf); ``stats``: one row (n, avgdl)."""

    packed: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(token, range, df, max_tf, chunks, tfs), a row a block; chunks are places within the range."""
        return self.packed.filter("bucket >= 0").mapInArrow(_unpacked, "token string, range long, df int, max_tf int, chunks array<int>, tfs array<int>")


def packed_schema(kind: str) -> str:
    """Bucket -1 has the chunks of a segment: their number and total length, ids and lengths in the order of ranges, chunks and
    group of every range.  The others have tokens, blocks of each token, range and chunks of each block, places and frequencies."""
    return f"segment long, bucket int, n int, total long, chunks array<{kind}>, tokens array<string>, " + ", ".join(f"{c} binary" for c in _BYTES)


def token_bucket(token: Column) -> Column:
    return F.pmod(F.crc32(F.encode(token, "UTF-8")), F.lit(BUCKETS)).cast("int")


def _small(a: np.ndarray) -> bytes:
    """Numbers in as few bytes each as they need, which the first byte tells; negative ones in eight."""
    least, most = (a.min(), a.max()) if len(a) else (0, 0)
    kind = "i8" if least < 0 else "u1" if most < 1 << 8 else "u2" if most < 1 << 16 else "u4" if most < 1 << 32 else "i8"
    return kind.encode() + a.astype(f"<{kind}").tobytes()


def _read(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=f"<{b[:2].decode()}", offset=2).astype(np.int64)


def _expand(begin: np.ndarray, times: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, so many times."""
    return np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(times.sum())


def _segment_rows(segment: int, ids: pa.Array, group: np.ndarray, lens: np.ndarray, names: pa.Array, code: np.ndarray, chunk: np.ndarray, tf: np.ndarray) -> list[dict]:
    """The packed rows of one segment; code, chunk and tf are counted words of its chunks, of which equal pairs are summed."""
    order = np.argsort(group, kind="stable")
    _, first, many = np.unique(group[order], return_index=True, return_counts=True)
    parts = -(-many // RANGE_CHUNKS)
    at = np.arange(len(group)) - np.repeat(first, many)  # place within the group
    where, place = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    where[order] = np.repeat(np.cumsum(parts) - parts, many) + at // RANGE_CHUNKS
    place[order] = at % RANGE_CHUNKS
    counts = np.bincount(where)
    empty = dict.fromkeys(_BYTES)
    rows = [empty | {"segment": segment, "bucket": -1, "n": len(lens), "total": int(lens.sum()), "chunks": ids.take(pa.array(order)).to_pylist(), "tokens": None, "lens": _small(lens[order]), "counts": _small(counts), "groups": _small(group[order][np.cumsum(counts) - counts])}]
    used, code = np.unique(code, return_inverse=True)
    words = names.take(pa.array(used)).to_pylist()
    bucket = np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), dtype=np.int64, count=len(words))
    by_bucket = np.argsort(bucket, kind="stable")
    turned = np.empty_like(by_bucket)
    turned[by_bucket] = np.arange(len(words))
    key, at = np.unique((turned[code] * len(counts) + where[chunk]) * RANGE_CHUNKS + place[chunk], return_inverse=True)
    tf = np.bincount(at, tf, minlength=len(key)).astype(np.int64)
    block, begin, ns = np.unique(key // RANGE_CHUNKS, return_index=True, return_counts=True)
    token, ranges = np.divmod(block, len(counts))
    edges = np.searchsorted(bucket[by_bucket], np.arange(BUCKETS + 1))  # tokens of each bucket
    blocks = np.searchsorted(token, edges)
    begin = np.append(begin, len(key))
    sizes = np.bincount(token, minlength=len(words))
    for b in np.flatnonzero(edges[1:] > edges[:-1]):
        own, of = slice(blocks[b], blocks[b + 1]), slice(begin[blocks[b]], begin[blocks[b + 1]])
        packed = {"sizes": sizes[edges[b] : edges[b + 1]], "ranges": ranges[own], "ns": ns[own], "places": key[of] % RANGE_CHUNKS, "tfs": tf[of]}
        rows.append(empty | {"segment": segment, "bucket": int(b), "n": None, "total": None, "chunks": None, "tokens": [words[i] for i in by_bucket[edges[b] : edges[b + 1]]]} | {c: _small(v) for c, v in packed.items()})
    return rows


def packed_segments(read: Callable[[pa.RecordBatch], tuple], schema: pa.Schema):
    """A step of mapInArrow from batches to packed rows.  ``read`` gives of a batch: ids, groups and lengths of its chunks, names
    of tokens, and code, chunk and frequency of words, in the order of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, group, lens, names, code, chunk, tf = read(batch)
            for low in range(0, len(lens), SEGMENT_CHUNKS):
                upto = low + SEGMENT_CHUNKS
                own = slice(*np.searchsorted(chunk, (low, upto)))
                rows = _segment_rows(made, ids[low:upto], group[low:upto], lens[low:upto], names, code[own], chunk[own] - low, tf[own])
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                made += 1

    return run


def _encoded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and the place of each word among them."""
    held = words.dictionary_encode()
    return held.dictionary, held.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _of_chunks(batch: pa.RecordBatch) -> tuple:
    lens = batch["ts"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    names, code = _encoded(batch["ts"].flatten())
    group = batch["group"].fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    return batch["chunk_id"], group, lens, names, code, np.repeat(np.arange(len(lens)), lens), np.ones(len(code))


#: What is stored of a page: ids and lengths of its chunks, its tokens, chunks of each token, their places and frequencies.
PAGE_POSTINGS = "chunks array<string>, lens array<int>, tokens array<string>, sizes array<int>, places array<int>, tfs array<int>"


def page_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PAGE_POSTINGS of (page_id, chunks, ts), a page's chunks and the tokens of each."""
    for batch in batches:
        pages, ts = len(batch), batch["ts"].flatten()
        lens = ts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        many = batch["chunks"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        page = np.repeat(np.arange(pages), many)
        place = np.arange(len(page)) - np.repeat(np.cumsum(many) - many, many)
        names, code = _encoded(ts.flatten())
        chunk = np.repeat(np.arange(len(lens)), lens)
        width = max(int(many.max(initial=0)), 1)
        key, tfs = np.unique((page[chunk] * len(names) + code) * width + place[chunk], return_counts=True)
        both, sizes = np.unique(key // width, return_counts=True)
        own, token = np.divmod(both, max(len(names), 1))
        lists = lambda values, of: pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(pages + 1)), pa.int32()), values)
        whole = lambda a: pa.array(a, pa.int32())
        of_posting = np.repeat(own, sizes)
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], lists(batch["chunks"].flatten(), page), lists(whole(lens), page), lists(names.take(pa.array(token)), own), lists(whole(sizes), own), lists(whole(key % width), of_posting), lists(whole(tfs), of_posting)],
            names=["page_id", "chunks", "lens", "tokens", "sizes", "places", "tfs"],
        )


def _of_pages(batch: pa.RecordBatch) -> tuple:
    flat = lambda c: batch[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    many, words = (batch[c].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("chunks", "tokens"))
    names, code = _encoded(batch["tokens"].flatten())
    sizes, lens = flat("sizes"), flat("lens")
    chunk = np.repeat(np.repeat(np.cumsum(many) - many, words), sizes) + flat("places")
    order = np.argsort(chunk, kind="stable")
    return batch["chunks"].flatten(), np.zeros(len(lens), np.int64), lens, names, np.repeat(code, sizes)[order], chunk[order], flat("tfs")[order]


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("token", pa.string()), ("range", pa.int64()), ("df", pa.int32()), ("max_tf", pa.int32()), ("chunks", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
    for batch in batches:
        for row in batch.to_pylist():
            sizes, ranges, ns, places, tfs = (_read(row[c]) for c in ("sizes", "ranges", "ns", "places", "tfs"))
            cut = np.cumsum(ns)[:-1]
            held = [x.tolist() for x in np.split(tfs, cut)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array(row["tokens"], dtype=object), sizes), pa.string()), pa.array((row["segment"] << SEGMENT_BITS) + ranges), pa.array(ns, pa.int32()),
                pa.array([max(x) for x in held], pa.int32()), pa.array([x.tolist() for x in np.split(places, cut)], kinds.field("chunks").type), pa.array(held, kinds.field("tfs").type),
            ], schema=kinds)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, sizes, ns in zip(batch["tokens"], batch["sizes"], batch["ns"]):
            sizes = _read(sizes.as_py())
            df = np.add.reduceat(_read(ns.as_py()), np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([words.values, pa.array(df, pa.int64())], names=["token", "df"])


def term_weights(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(token, df, idf) of (token, df) and one row (n, avgdl)."""
    terms = df.join(F.broadcast(stats)).withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = terms.agg(F.avg("raw").alias("mean"))  # one row
    return terms.join(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def index_of(packed: DataFrame) -> Index:
    """The index of packed rows that are written."""
    total = packed.filter("bucket = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("words"))
    stats = written(total.select("n", F.try_divide("words", "n").alias("avgdl")), "index-stats")
    df = written(packed.filter("bucket >= 0").select("tokens", "sizes", "ns").mapInArrow(_document_counts, "token string, df long").groupBy("token").agg(F.sum("df").alias("df")), "term-counts")
    return Index(packed, written(term_weights(df, stats), "terms"), stats)


def build_index(chunks: DataFrame) -> Index:
    """Index (document_id, chunk_id, content) and, where it is there, group; chunks are tokenised once and never moved."""
    group = (F.col("group") if "group" in chunks.columns else F.lit(0)).cast("long").alias("group")
    held = chunks.select("chunk_id", group, tokens(F.coalesce("content", F.lit(""))).alias("ts"))
    ddl = packed_schema(dict(chunks.dtypes)["chunk_id"])
    return _dealt(held.mapInArrow(packed_segments(_of_chunks, arrow_schema(ddl)), ddl))


def index_of_pages(pages: DataFrame) -> Index:
    """Index of stored rows of PAGE_POSTINGS; pages that lie together share segments."""
    ddl = packed_schema("string")
    return _dealt(pages.select("chunks", "lens", "tokens", "sizes", "places", "tfs").mapInArrow(packed_segments(_of_pages, arrow_schema(ddl)), ddl))


def _dealt(rows: DataFrame) -> Index:
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("segment"), F.lit(BUCKET_TASKS))).sortWithinPartitions("bucket", "segment")
    return index_of(written(rows, "postings", partitionBy="bucket"))


def saturated(tf, length, avgdl):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


class _Terms:
    """The terms of a block of queries, and the groups that each query may see."""

    def __init__(self, asked: pa.Table, allowed: pa.Table | None):
        column = lambda t, c: t[c].combine_chunks()
        self.queries, self.names = pc.unique(column(asked, "query_id")), pc.unique(column(asked, "token"))
        self.query = pc.index_in(column(asked, "query_id"), self.queries).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(self.query, kind="stable")
        self.query = self.query[order]
        self.code = pc.index_in(column(asked, "token"), self.names).to_numpy(zero_copy_only=False)[order].astype(np.int64)
        self.weight = asked["weight"].to_numpy()[order].astype(float)
        self.groups = None
        if allowed is not None:
            at = pc.index_in(column(allowed, "query_id"), self.queries).to_numpy(zero_copy_only=False)
            self.groups: dict[int, np.ndarray] = {}
            for q, g in zip(at, allowed["group"].to_pylist()):
                if q == q and g is not None:
                    self.groups.setdefault(g, np.zeros(len(self.queries), dtype=bool))[int(q)] = True

    def seen(self, groups: np.ndarray, low: int, upto: int) -> np.ndarray:
        """Whether each query of a part may see each range."""
        if self.groups is None:
            return np.ones((upto - low, len(groups)), dtype=bool)
        none = np.zeros(len(self.queries), dtype=bool)
        return np.stack([self.groups.get(g, none)[low:upto] for g in groups.tolist()], axis=1)

    def parts(self, times: np.ndarray, width: int) -> Iterator[tuple[int, int, slice]]:
        """Queries in parts, with their terms, of about CELLS cells of ``width`` a query and of ``times`` a term."""
        cost = np.maximum(np.bincount(self.query, times[self.code], minlength=len(self.queries)), width)
        edges = np.flatnonzero(np.diff((np.cumsum(cost) - cost) // CELLS, prepend=-1, append=-1))
        for low, upto in zip(edges, edges[1:]):
            yield low, upto, slice(*np.searchsorted(self.query, (low, upto)))


class _Segment:
    """The blocks of a segment that hold asked tokens, those of a token one after the other."""

    def __init__(self, rows: list[dict], terms: _Terms, avgdl: float):
        head = next(r for r in rows if r["bucket"] == -1)
        rows = [r for r in rows if r["bucket"] >= 0]
        join = lambda c: np.concatenate([np.zeros(0, np.int64), *(_read(r[c]) for r in rows)])
        self.chunks, lens, counts, self.groups = head["chunks"], _read(head["lens"]), _read(head["counts"]), _read(head["groups"])
        codes, sizes, self.ranges, self.ns = join("codes"), join("sizes"), join("ranges"), join("ns")
        self.chunk = np.repeat((np.cumsum(counts) - counts)[self.ranges], self.ns) + join("places")
        self.part = saturated(join("tfs").astype(float), lens[self.chunk], avgdl)
        self.begin = np.cumsum(self.ns) - self.ns
        self.most = np.maximum.reduceat(self.part, self.begin) if len(self.ns) else np.zeros(0)
        self.first, self.blocks, self.n = (np.zeros(len(terms.names), np.int64) for _ in range(3))
        self.first[codes], self.blocks[codes] = np.cumsum(sizes) - sizes, sizes
        self.n[codes] = np.add.reduceat(self.ns, np.cumsum(sizes) - sizes) if len(codes) else 0

    def bounds(self, terms: _Terms) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, range, bound) of ranges that hold a token of the query."""
        width = len(self.groups)
        for low, upto, own in terms.parts(self.blocks, width):
            times = self.blocks[terms.code[own]]
            block = _expand(self.first[terms.code[own]], times)
            cell = np.repeat(terms.query[own] - low, times) * width + self.ranges[block]
            bound = np.bincount(cell, np.maximum(np.repeat(terms.weight[own], times) * self.most[block], 0.0), minlength=(upto - low) * width)
            held = np.zeros(len(bound), dtype=bool)
            held[cell] = True
            held &= terms.seen(self.groups, low, upto).ravel()
            query, where = np.divmod(np.flatnonzero(held), width)
            yield query + low, where, bound[held]

    def best(self, terms: _Terms, query: np.ndarray, where: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, chunk, score) of the k best of each query in the given ranges, with all that tie with the k-th."""
        width = len(self.chunks)
        here = np.zeros(len(terms.queries), dtype=bool)
        here[query] = True
        for low, upto, own in terms.parts(self.n, width):
            if not here[low:upto].any():
                continue
            wanted = np.zeros((upto - low, len(self.groups)), dtype=bool)
            of = (query >= low) & (query < upto)
            wanted[query[of] - low, where[of]] = True
            times = self.blocks[terms.code[own]]
            block, asked, weight = _expand(self.first[terms.code[own]], times), np.repeat(terms.query[own] - low, times), np.repeat(terms.weight[own], times)
            kept = wanted[asked, self.ranges[block]]
            block, asked, weight = block[kept], asked[kept], weight[kept]
            n = self.ns[block]
            at = _expand(self.begin[block], n)
            score = np.bincount(np.repeat(asked, n) * width + self.chunk[at], np.repeat(weight, n) * self.part[at], minlength=(upto - low) * width)
            score = np.round(score.reshape(-1, width), 6)
            if width > k:
                # a score of 0 is no hit, so the k-th is that of the others
                filled = np.where(score != 0, score, -np.inf)
                least = np.partition(filled, -k, axis=1)[:, -k, None]
                q, c = np.nonzero((filled >= least) & (score != 0))
            else:
                q, c = np.nonzero(score)
            yield q + low, c, score[q, c]


_MATCHED = ("codes", "sizes", "ranges", "ns", "places", "tfs", "lens", "counts", "groups")


def _matched(held, schema: pa.Schema):
    """Of packed rows the blocks of asked tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(len(batch)):
                row = {c: batch[c][at].as_py() for c in schema.names if c != "codes"} | {"codes": None}
                if row["bucket"] >= 0:
                    found = pc.index_in(batch["tokens"][at].values, held.value.names).to_numpy(zero_copy_only=False)
                    kept = found == found if found.dtype.kind == "f" else np.ones(len(found), dtype=bool)
                    if not kept.any():
                        continue
                    sizes, ns = _read(row["sizes"]), _read(row["ns"])
                    blocks = np.repeat(kept, sizes)
                    chunks = np.repeat(blocks, ns)
                    row |= {"codes": _small(found[kept].astype(np.int64)), "sizes": _small(sizes[kept])}
                    row |= {c: _small(_read(row[c])[m]) for c, m in (("ranges", blocks), ("ns", blocks), ("places", chunks), ("tfs", chunks))}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _together(held, avgdl: float, schema: pa.Schema):
    """Rows sorted by segment to a row a segment with all of them, and rows of its bounds."""

    def made(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return  # no token of the segment is asked for
        segment, bare = rows[0]["segment"], {c: None for c in schema.names}
        packed = [bare | {"segment": segment, "rows": [{c: r[c] for c in ("bucket", "chunks", *_MATCHED)} for r in rows]}]
        yield pa.RecordBatch.from_pylist(packed, schema=schema)
        for query, where, bound in _Segment(rows, held.value, avgdl).bounds(held.value):
            if len(query):
                row = bare | {"segment": segment, "query": held.value.queries.take(pa.array(query)), "range": where + (segment << SEGMENT_BITS), "bound": bound}
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[0]["segment"] != row["segment"]:
                    yield from made(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from made(rows)

    return run


def _best(held, avgdl: float, k: int, schema: pa.Schema):
    """Hits of (rows, pairs): the blocks of a segment and the ranges of it that some queries ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = held.value
        for batch in batches:
            for at in range(len(batch)):
                rows, pairs = batch["rows"][at].as_py(), batch["pairs"][at].values
                segment = _Segment(rows, terms, avgdl)
                query = pc.index_in(pairs.field("query_id"), terms.queries).to_numpy(zero_copy_only=False).astype(np.int64)
                where = pairs.field("range").to_numpy(zero_copy_only=False) & (SEGMENT_CHUNKS - 1)
                ids = pa.array(segment.chunks, schema.field("chunk_id").type)
                for q, c, score in segment.best(terms, query, where, k):
                    yield pa.RecordBatch.from_arrays([terms.queries.take(pa.array(q)), ids.take(pa.array(c)), pa.array(score)], schema=schema)

    return run


def search_index(index: Index, queries: DataFrame, top_k: int, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((query_id, chunk_id, score, lexical_rank), (query_id, blocks, visited)) of (query_id, text); zero scores are left out.

    With ``scope`` (query_id, group) only ranges of the query's groups are looked at.  Queries come in blocks of about QUERY_TERMS
    terms, which the tasks hold.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qf"))
    asked = written(asked.join(index.terms, "token").select("query_id", "token", (F.col("qf") * F.col("idf")).alias("weight"), token_bucket(F.col("token")).alias("bucket")), "asked")
    if scope is not None:
        scope = written(scope.select("query_id", F.col("group").cast("long").alias("group")), "asked-groups")
    blocks = -(-(asked.count() + (scope.count() if scope is not None else 0)) // QUERY_TERMS) or 1
    hits, visits = None, None
    for k in range(blocks):
        own = lambda d: d if d is None else d.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)  # noqa: B023, E731
        found = _search_block(index, own(asked), top_k, own(scope))
        hits, visits = found if hits is None else (hits.unionByName(found[0]), visits.unionByName(found[1]))
    return ranked(hits, "score", "lexical_rank", top_k), visits


def _search_block(index: Index, asked: DataFrame, top_k: int, scope: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    spark, avgdl = asked.sparkSession, float(index.stats.first()["avgdl"] or 1.0)
    terms = _Terms(asked.select("query_id", "token", "weight").toArrow(), None if scope is None else scope.toArrow())  # about QUERY_TERMS rows
    held = spark.sparkContext.broadcast(terms)
    query, chunk = dict(asked.dtypes)["query_id"], dict(index.packed.dtypes)["chunks"]
    parts = {"bucket": "int", "chunks": chunk} | dict.fromkeys(_MATCHED, "binary")
    ddl = "segment long, " + ", ".join(f"{c} {t}" for c, t in parts.items())
    there = index.packed.filter(F.col("bucket").isin([-1, *(r["bucket"] for r in asked.select("bucket").distinct().collect())]))  # a number a bucket
    rows = there.select("segment", "bucket", "chunks", "tokens", *_BYTES).mapInArrow(_matched(held, arrow_schema(ddl)), ddl)
    ddl = f"segment long, rows array<struct<{', '.join(f'{c}: {t}' for c, t in parts.items())}>>, query array<{query}>, range array<long>, bound array<double>"
    held_rows = written(rows.repartition("segment").sortWithinPartitions("segment", "bucket").mapInArrow(_together(held, avgdl, arrow_schema(ddl)), ddl), "asked-blocks")
    bounds = held_rows.filter("rows is null").select(F.explode(F.arrays_zip("query", "range", "bound")).alias("b")).select(F.col("b.query").alias("query_id"), "b.range", "b.bound")
    salts = -(-len(terms.queries) // QUERIES) or 1

    def search(pairs: DataFrame) -> DataFrame:
        salt = F.pmod(F.xxhash64("query_id"), F.lit(salts)).alias("salt")
        by_segment = pairs.groupBy(F.shiftright("range", SEGMENT_BITS).alias("segment"), salt).agg(F.collect_list(F.struct("query_id", "range")).alias("pairs"))
        ddl = f"query_id {query}, chunk_id {chunk[6:-1]}, score double"
        there = held_rows.filter("rows is not null").select("segment", "rows").join(by_segment.select("segment", "pairs"), "segment")
        return there.select("rows", "pairs").mapInArrow(_best(held, avgdl, top_k, arrow_schema(ddl)), ddl)

    return in_waves(bounds, ["range"], search, "score", top_k)
