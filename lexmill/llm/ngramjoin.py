"""N-gram Jaccard join: T-occurrence search over inverted lists with DivideSkip, whole and distributed.

Two documents link when 100 * |A & B| >= 75 * |A | B| over their sets of five-word shingles.

1. Documents with equal sets are folded: one representative stands for all.
2. Shingles are ordered from rare to frequent.  Packed counts of all shingles are dealt out by hash; the most frequent
   ones (a bounded number, which only serves the order and so speed) come last, in order of frequency.  Linked sets share
   a shingle among the first n - ceil(3n/4) + 1 of each, so only these prefixes enter the inverted lists.  They are dealt
   out packed, and lists with one member vanish there.  The prefixes are longer than that by n // 8, so a linked pair
   shares more than (3n // 32) of them; documents that stand in fewer lists have no link and drop out.
3. Every list's members are searched with the list's least member as query.  A search takes a query and a block of
   candidate sets: short inverted lists are heap-merged, long ones probed by bisection, and candidates that reach the
   required overlap remain.  A dense group of copies thus costs a search per member, not per pair.
4. A linked pair in different components shares more than (3n // 32) lists that hold several components.  Linked sets are
   of like size, so lists are cut into windows of sizes, and documents in too few lists of a window drop out of it; what is
   left falls into clusters of documents joined by lists of one window.  In each, the documents outside the cluster's
   largest component are searched against all others, in blocks of bounded size, each query by the same T-occurrence
   search; a query reports one link to each other component.
5. Components come from large-star and small-star rounds.

Defined results: null, empty or blank texts have no shingle, and their component is their own doc_id; repeated rows are
folded like other copies; a null doc_id is never a component's name unless all its members have none; an empty table
gives an empty result; doc_id may have any type that has an order; a text of any length is read whole; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut, in_small_batches, meet, table
from lexmill.llm.hasharray import most_frequent
from lexmill.llm.tokens import shingle_sets

NUMERATOR, DENOMINATOR = 3, 4
#: Shingles of at least so many documents may be put last; at most TOP of them, the most frequent.
FREQUENT = 24
TOP = 1 << 20
#: Leading bits of a shingle hash that are counted, and that stand in a list.  Equal short hashes only add a search.
COUNT_BITS, LIST_BITS = 36, 44
FLUSH = 1 << 22
SHARD = 1 << 21
CHARS_PER_SHINGLE = 5
#: Weight of probing against merging in the choice of long lists.
MU = 0.01
#: Shingles of one block of queries or candidates, and rounds of dropping documents in too few lists.
BLOCK_SHINGLES = 1_000_000
PRUNE = 2


def least_overlap(n: int, m: int) -> int:
    """The smallest overlap of sets of n and m shingles that makes a link."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def prefix_size(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1 + n // 8


def _shard_bits(chars: int) -> int:
    """Shards of about SHARD shingles in texts of so many characters, whatever the number of the shuffle's partitions."""
    return min(20, max(5, (chars // CHARS_PER_SHINGLE // SHARD).bit_length()))


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits)


def _pack(values: np.ndarray) -> bytes:
    """Sorted values of up to 40 bits as differences, byte plane after byte plane, so that the high zeros compress."""
    return np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(5, -1)
    full = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    full[:, :5] = planes.T
    return np.cumsum(full.view(np.uint64).ravel(), dtype=np.uint64)


def _by_shard(h: np.ndarray, shard_bits: int, bits: int) -> Iterator[tuple[int, slice, np.ndarray]]:
    """(shard, its slice of the sorted hashes, what is left of them)."""
    kept = bits - shard_bits
    edges = np.searchsorted(h, np.arange((1 << shard_bits) + 1, dtype=np.uint64) << np.uint64(kept))
    for s in np.flatnonzero(np.diff(edges)):
        at = slice(int(edges[s]), int(edges[s + 1]))
        yield int(s), at, h[at] & np.uint64((1 << kept) - 1)


def _name(shingles: np.ndarray) -> int:
    """64 bits that name a set; copies share them."""
    return int(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes())[:8], dtype=np.int64)[0])


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(i, len(s), _name(s)) for i, s in shingle_sets(batch["text"])]
        order = [r[0] for r in rows]
        yield pd.DataFrame({"key": batch["key"].iloc[order].array, "doc_id": batch["doc_id"].iloc[order].astype(object).array, "n": [r[1] for r in rows], "fp": [r[2] for r in rows]})


def _count_packed(shard_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush():
            h = np.sort(np.concatenate(held))
            return pd.DataFrame([(s, _pack(low)) for s, _, low in _by_shard(h, shard_bits, COUNT_BITS)], columns=["shard", "blob"])

        for batch in batches:
            for _, s in shingle_sets(batch["text"]):
                held.append(_short(s, COUNT_BITS))
                size += len(s)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _frequent(shard_bits: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h, n = np.unique(np.concatenate([_unpack(b) for b in rows["blob"]]), return_counts=True)
        often = n >= FREQUENT
        return pd.DataFrame({"h": (h[often] | np.uint64(key[0] << (COUNT_BITS - shard_bits))).astype(np.int64), "n": n[often].astype(np.int64)})

    return run


def _prefixes(frequent, shard_bits: int):
    """Packed prefix hashes of each shard, the number of their set in the blob, and the sets' names and sizes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, times = frequent.value
        sigs, fps, sizes, total = [], [], [], 0
        own: set[int] = set()

        def flush():
            h, owner = np.concatenate(sigs), np.repeat(np.arange(len(sigs), dtype=np.uint32), [len(s) for s in sigs])
            by = np.argsort(h, kind="stable")
            h, owner = h[by], owner[by]
            out, ids, ns = [], np.array(fps), np.array(sizes, dtype=np.int32)
            for s, at, low in _by_shard(h, shard_bits, LIST_BITS):
                used, local = np.unique(owner[at], return_inverse=True)
                small = np.uint16 if len(used) < 1 << 16 else np.uint32
                out.append((s, _pack(low), local.astype(small).tobytes(), ids[used].tobytes(), ns[used].tobytes()))
            return pd.DataFrame(out, columns=["shard", "blob", "owner", "fps", "sizes"])

        for batch in batches:
            for _, s in shingle_sets(batch["text"]):
                if not len(s):
                    continue
                fp = _name(s)
                if fp in own:  # a copy within this flush
                    continue
                own.add(fp)
                need = prefix_size(len(s))
                if len(order):
                    short = _short(s, COUNT_BITS)
                    at = np.minimum(np.searchsorted(order, short), len(order) - 1)
                    often = order[at] == short
                    first = s[~often]
                    if len(first) < need:
                        last = s[often]
                        first = np.concatenate((first, last[np.lexsort((last, times[at[often]]))]))
                else:
                    first = s
                sigs.append(_short(first[:need], LIST_BITS))
                fps.append(fp)
                sizes.append(len(s))
                total += need
                if total >= FLUSH:
                    yield flush()
                    sigs, fps, sizes, total, own = [], [], [], 0, set()
        if sigs:
            yield flush()

    return run


def _lists(shard_bits: int):
    """(sig, fp, n) of all inverted lists of a shard with at least two members."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = []
        for blob, owner, fps, sizes in rows[["blob", "owner", "fps", "sizes"]].itertuples(index=False, name=None):
            low = _unpack(blob)
            o = np.frombuffer(owner, dtype=np.uint16 if len(owner) == 2 * len(low) else np.uint32)
            held.append((low, np.frombuffer(fps, dtype=np.int64)[o], np.frombuffer(sizes, dtype=np.int32)[o]))
        h, fp, n = (np.concatenate(x) for x in zip(*held))
        by = np.lexsort((fp, h))
        h, fp, n = h[by], fp[by], n[by]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])
        h, fp, n = h[new], fp[new], n[new]
        same = h[1:] == h[:-1]
        more = np.concatenate((same, [False])) | np.concatenate(([False], same))
        return pd.DataFrame({"sig": (h[more] | np.uint64(key[0] << (LIST_BITS - shard_bits))).astype(np.int64), "fp": fp[more], "n": n[more].astype(np.int64)})

    return run


class InvertedIndex:
    """The inverted lists of a block of sorted distinct shingle sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        values = np.concatenate(sets)
        by = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[by]
        values = values[by]
        self.first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        self.keys, self.end = values[self.first], np.append(self.first[1:], len(values))

    def search(self, query: np.ndarray) -> np.ndarray:
        """Members that reach the required overlap with ``query``, by DivideSkip."""
        needs = least_overlap(len(query), self.sizes)
        least = int(needs.min())
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        if len(at) < least:
            return np.zeros(0, dtype=np.int64)
        at = at[np.argsort(self.end[at] - self.first[at], kind="stable")]
        lists = [self.owner[a:b] for a, b in zip(self.first[at], self.end[at])]
        n_long = min(int(least / (MU * np.log2(len(lists[-1]) + 1) + 1)), least - 1)
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        members, counts = _merge(short)
        for k, entries in enumerate(long):
            live = counts + (n_long - k) >= needs[members]
            members, counts = members[live], counts[live]
            if not len(members):
                break
            place = np.minimum(np.searchsorted(entries, members), len(entries) - 1)
            counts = counts + (entries[place] == members)
        return members[counts >= needs[members]]


def _merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(member, number of lists) over sorted lists: a heap merge, or for many entries a sort that merges sorted runs."""
    if sum(map(len, lists)) <= 512:
        runs = [(m, sum(1 for _ in g)) for m, g in groupby(heapq.merge(*(x.tolist() for x in lists)))]
        return np.array([m for m, _ in runs], dtype=np.int64), np.array([n for _, n in runs], dtype=np.int64)
    return np.unique(np.concatenate(lists), return_counts=True)


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links among rows (a, b, set_a, set_b); rows with one query b that arrive together form a block."""
    for batch in batches:
        links = []
        for b, rows in batch.groupby("b", sort=False):
            names = rows["a"].tolist()
            index = InvertedIndex([np.frombuffer(x, dtype=np.uint64) for x in rows["set_a"]])
            links += [(names[i], b) for i in index.search(np.frombuffer(rows["set_b"].iloc[0], dtype=np.uint64))]
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    with_a = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = with_a.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInPandas(_search, "a long, b long")


def _search_blocks(queries: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """One link from every query to each other component that it reaches in this block."""
    links = []
    if len(queries) and len(others):
        index = InvertedIndex([np.frombuffer(x, dtype=np.uint64) for x in others["shingles"]])
        names, components_ = others["fp"].to_numpy(), others["component"].to_numpy()
        for fp, own, raw in zip(queries["fp"], queries["component"], queries["shingles"]):
            found = index.search(np.frombuffer(raw, dtype=np.uint64))
            _, one = np.unique(components_[found], return_index=True)
            links += [(names[i], fp) for i in found[one] if components_[i] != own]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _in_enough(lists: DataFrame, *by: str) -> DataFrame:
    """Rows of documents that stand in enough lists for a link.  A group is one document's, no longer than its prefix."""
    held = F.count("*").over(Window.partitionBy(*by))
    return lists.withColumn("held", held).filter(F.col("held") > F.floor(F.col("n") * 3 / 32)).drop("held")


def _windows(lists: DataFrame) -> DataFrame:
    """Rows (sig, fp, n, component) in each window of sizes that they fall into.

    Sets of n and m shingles, n < m, link only if n >= 3m / 4.  Sizes fall into bands of this ratio, and a window is a band
    with the one above it: linked sets stand together in the window of the smaller one's band.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DENOMINATOR / NUMERATOR))).cast("int")
    return lists.withColumn("band", band).withColumn("window", F.explode(F.array(F.col("band") - 1, F.col("band"))))


def _impure(lists: DataFrame) -> DataFrame:
    """Rows of the windows whose lists hold several components, without documents that stand in too few of such lists.

    A list without a set of the window's lower band counts in the next window only.
    """
    rows = cut(_windows(lists), "jaccard-windows")
    for step in range(PRUNE):
        several = rows.groupBy("sig", "window").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("band").alias("low"))
        several = several.filter((F.col("lo") != F.col("hi")) & (F.col("low") == F.col("window"))).select("sig", "window")
        rows = cut(rows.join(cut(several, "jaccard-several"), ["sig", "window"], "left_semi"), f"jaccard-impure-{step}")
        rows = cut(_in_enough(rows, "fp", "window"), f"jaccard-still-{step}")
    return rows.withColumn("node", F.xxhash64("component", "window"))


def _cross_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components of (sig, fp, n, component)."""
    rows = _impure(lists)
    heads = cut(rows.groupBy("sig", "window").agg(F.min("node").alias("head")), "jaccard-heads")
    edges = rows.join(heads, ["sig", "window"]).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    clusters = components(edges)
    named = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct())
    named = cut(named.select("node", F.col("component").alias("cluster")), "jaccard-clusters")
    members = cut(rows.select("fp", "n", "component", "node").distinct().join(named, "node").drop("node"), "jaccard-members")
    sizes = members.groupBy("cluster", "component").agg(F.sum("n").alias("size"), F.count("*").alias("docs"))
    per = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.sum("size").alias("all"), F.max("size").alias("most"), F.sum("docs").alias("docs"))
    pieces = lambda c: F.ceil(c / BLOCK_SHINGLES).cast("int")
    plan = per.filter("all > most").select("cluster", "largest", "docs", pieces(F.col("all")).alias("n_i"), pieces(F.col("all") - F.col("most")).alias("n_q"))
    held = meet(members, cut(plan, "jaccard-plan"), ["cluster"], "docs").join(sets, "fp")
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A query meets every candidate of its cluster in one block.
    queries = held.filter("component <> largest").select("cluster", part("n_q").alias("qb"), each("n_i").alias("ib"), "fp", "component", "shingles")
    others = held.select("cluster", each("n_q").alias("qb"), part("n_i").alias("ib"), "fp", "component", "shingles")
    keys = ["cluster", "qb", "ib"]
    queries, others = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (queries, others))  # columns of their own
    return queries.groupBy(keys).cogroup(others.groupBy(keys)).applyInPandas(_search_blocks, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph with edges (a, b): alternate large-star and small-star to a fixed point."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "star-large")
        lows = cut(large.groupBy("u").agg(F.min("v").alias("m")), "star-low")
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v")))
        after = cut(small.filter("u <> v").distinct(), "star")
        digest = [d.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first() for d in (edges, after)]
        edges = after
        if digest[0] == digest[1]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _wanted_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shingle sets of the texts whose set has the wanted name."""
    for batch in batches:
        want = batch["want"].tolist()
        rows = [(name, s.tobytes()) for i, s in shingle_sets(batch["text"]) if (name := _name(s)) == want[i]]
        yield pd.DataFrame(rows, columns=["fp", "shingles"])


def row_key() -> Column:
    """A key of a row's doc_id and text; rows that share it are copies of one row."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.col("doc_id").isNull())


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the component is the least doc_id that links lead to."""
    return jaccard_rows(docs).select("doc_id", "n_shingles", "component_id")


@in_small_batches
def jaccard_rows(docs: DataFrame) -> DataFrame:
    """jaccard_join with each row's key and cluster: unlike a doc_id, a cluster is never that of unlinked texts."""
    spark = docs.sparkSession
    texts = docs.select(row_key().alias("key"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    bits = _shard_bits(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    counted = texts.select("text").mapInPandas(_count_packed(bits), "shard int, blob binary")
    top = cut(counted.groupBy("shard").applyInPandas(_frequent(bits), "h long, n long"), "jaccard-frequent")
    top = most_frequent(top, "n", TOP).toArrow().to_pandas().sort_values("h")  # at most TOP rows
    frequent = spark.sparkContext.broadcast((top["h"].to_numpy().astype(np.uint64), top["n"].to_numpy()))

    packed = texts.select("text").mapInPandas(_prefixes(frequent, bits), "shard int, blob binary, owner binary, fps binary, sizes binary")
    lists = cut(packed.groupBy("shard").applyInPandas(_lists(bits), "sig long, fp long, n long"), "jaccard-all-lists")
    # Members of too few lists drop out; lists that are left with one member do too.
    lists = cut(_in_enough(lists, "fp"), "jaccard-enough")
    shared = cut(lists.groupBy("sig").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("sig"), "jaccard-shared")
    lists = cut(lists.join(shared, "sig", "left_semi"), "jaccard-lists")
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = cut(texts.mapInPandas(_describe, f"key long, doc_id {kind}, n long, fp long"), "jaccard-docs")
    first = cut(described.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "jaccard-first")

    # Whole shingle sets of the representatives that stand in some list.
    needed = cut(first.join(lists.select("fp").distinct(), "fp", "left_semi").select(F.col("doc_id").alias("id"), F.col("fp").alias("want")), "jaccard-needed")
    sets = texts.join(needed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id"))).select("want", "text")
    sets = cut(sets.mapInPandas(_wanted_sets, "fp long, shingles binary").dropDuplicates(["fp"]), "jaccard-sets")

    least = cut(lists.groupBy("sig").agg(F.min(F.struct("fp", "n")).alias("least")).select("sig", F.col("least.fp").alias("b"), F.col("least.n").alias("m")), "jaccard-least")
    like = DENOMINATOR * F.least("n", "m") >= NUMERATOR * F.greatest("n", "m")  # other sizes never link
    star = lists.join(least, "sig").filter((F.col("fp") != F.col("b")) & like).select(F.col("fp").alias("a"), "b").distinct()
    star = cut(star, "jaccard-star")
    links = cut(_links(star, sets), "jaccard-links")

    # Links between components of the stars' links.
    named = components(links)
    lists = lists.join(named.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    links = cut(links.unionByName(_cross_links(cut(lists, "jaccard-named"), sets)), "jaccard-all-links")

    named = components(links)
    named = cut(first.join(named.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "doc_id"), "jaccard-components")
    heads = first.join(named.select("component").distinct(), F.col("fp") == F.col("component"), "left_semi").select(F.col("fp").alias("component"), "doc_id")
    lows = named.select("component", "doc_id").unionByName(heads).groupBy("component").agg(F.min("doc_id").alias("low"))
    by_fp = named.select("fp", "component").unionByName(heads.select(F.col("component").alias("fp"), "component")).join(lows, "component").select("fp", "low", "component")
    by_fp = first.join(by_fp, "fp", "left").select("fp", F.coalesce("low", "doc_id").alias("low"), F.coalesce("component", "fp").alias("component"))
    by_fp = cut(by_fp, "jaccard-names")
    cluster = F.when(F.col("n") > 0, F.coalesce("component", "fp")).otherwise(F.col("key")).alias("cluster")
    return described.join(by_fp, "fp", "left").select("key", cluster, "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("low", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op4_ngram_join": op4_ngram_join}
ORACLES: dict[str, str] = {}
