"""Source divergence audit: how far each source of a language departs from its other sources, and in which terms.

A language keeps the terms of at least MIN_DOCS of its documents.  A group (a source within a language, or the language)
with N occurrences of the V kept terms gives a term with ``count`` occurrences the share
p = 1 + floor(1e9 * (count + 1) / (N + V)); the divergence of p from q is f = floor((p - q)^2 / q).

Terms are ranked by count cells: in a group, terms of equal counts in the group and in the language form one cell, so f is
evaluated once a cell.  Cells of equal value merge, and the running sum of their multiplicities tells which values reach the
asked ranks; only the terms of these cells are then expanded, in UTF-8 order within a value.  The number of cells follows the
different counts, not the terms.

Sources are compared by cells too.  With g the share of a term that a source lacks, the sum of f(p, q) over all kept terms is
that over the terms of the first source against g of the second, that over the terms of the second against g of the first,
f(g, g) for the rest, and a correction for each term that both have.  The first sums run over the cells of equal counts; the
corrections are summed where the terms are, without a row a pair of sources and term.

Everything is in whole numbers.  A total fits 64 bits, so partial sums may wrap around and are added modulo 2^64.

Defined results: null text, lang and source count as empty text; a row is a document, repeated rows count each time; a group
whose documents have no terms has count 0 for all; a language without kept terms gives its pairs value 0 and no terms; lang
and source may have any type with a text form; other columns are neither read nor returned; equal values take the smaller
item first; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut, table
from lexmill.llm.tokens import LOWER, hash_runs

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: The most that SCALE may multiply in 64 bits.
LONGEST = (1 << 63) // SCALE - 1
#: Pairs of sources of a term compared at a time.
PAIRS = 1 << 20
#: Bytes of text counted at a time, rows of counts that a task gathers before it sends them, and rows of a batch.
CHUNK = 1 << 21
FLUSH = 1 << 20
BATCH = 1 << 16

#: The bytes of TERM in UTF-8: letters of ASCII and all of other characters.
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a count among n occurrences of v terms; where SCALE times the count passes 64 bits, by decimals."""
    count, of = count.cast("long") + F.lit(1), F.greatest((n + v).cast("long"), F.lit(1))
    wide = F.lit(SCALE).cast("decimal(10,0)") * count.cast("decimal(19,0)")
    return F.when(count <= LONGEST, F.call_function("div", F.lit(SCALE) * count, of)).otherwise(F.call_function("div", wide, of.cast("decimal(19,0)"))) + F.lit(1)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _terms(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, length) of the terms of lower-cased bytes."""
    inside = _IN_TERM[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    first, length = edges[::2], edges[1::2] - edges[::2]
    return hash_runs(raw[inside], length), first, length


class _Tally:
    """Occurrences and documents of terms by group, a row a term and group: parallel arrays, and the terms' bytes in one."""

    def __init__(self, group: np.ndarray, key: np.ndarray, count: np.ndarray, docs: np.ndarray, length: np.ndarray, data: np.ndarray):
        self.group, self.key, self.count, self.docs, self.length, self.data = group, key, count, docs, length, data

    def __len__(self) -> int:
        return len(self.key)

    @staticmethod
    def of(parts: list[bytes], owners: list[int], groups: list[int]) -> _Tally:
        """Of parts of texts: ``owners`` numbers the document of each, ``groups`` its group."""
        raw = LOWER[np.frombuffer(b" ".join(parts), dtype=np.uint8)]
        key, first, length = _terms(raw)
        part = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), first, side="right")
        group, owner = np.asarray(groups)[part], np.asarray(owners)[part]
        order = np.lexsort((owner, key, group))
        group, key, owner, first, length = (x[order] for x in (group, key, owner, first, length))
        new = _changes(group, key, length)
        start = np.flatnonzero(new)
        docs = np.add.reduceat((new | _changes(owner)).astype(np.int64), start) if len(start) else start
        first, length = first[start], length[start]
        return _Tally(group[start], key[start], np.diff(np.append(start, len(key))), docs, length, raw[_spread(first, length)])

    @staticmethod
    def merged(parts: list[_Tally], one_document: bool = False) -> _Tally:
        if len(parts) == 1:
            return parts[0]
        group, key, count, docs, length, data = (np.concatenate([getattr(p, c) for p in parts]) for c in ("group", "key", "count", "docs", "length", "data"))
        order = np.lexsort((key, group))
        first = (np.cumsum(length) - length)[order]
        group, key, count, docs, length = (x[order] for x in (group, key, count, docs, length))
        start = np.flatnonzero(_changes(group, key, length))
        if not len(start):
            return parts[0]
        count, docs = np.add.reduceat(count, start), np.add.reduceat(docs, start)
        return _Tally(group[start], key[start], count, np.minimum(docs, 1) if one_document else docs, length[start], data[_spread(first[start], length[start])])

    def batch(self, names: list[tuple[str, str]]) -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum(self.length))).astype(np.int32)
        term = pa.StringArray.from_buffers(len(self), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data)))
        index = pa.array(self.group)
        columns = [pa.array([n[k] for n in names], type=pa.string()).take(index) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, term, pa.array(self.count), pa.array(self.docs)], names=["lang", "source", "term", "count", "docs"])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before.  Equal hashes of terms of unequal length differ; equal rows that stand apart do no harm."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of runs, one run after the other."""
    offset = np.cumsum(length) - length
    return np.arange(length.sum()) - np.repeat(offset - first, length)


def _cut(text: bytes) -> Iterator[bytes]:
    """Parts of about CHUNK bytes that end where no term goes on; a longer term stays whole."""
    at = 0
    while at < len(text):
        to = at + CHUNK
        while to < len(text) and _IN_TERM[text[to]]:
            to += 1
        yield text[at:to]
        at = to


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[tuple[str, str], int] = {}
    tallies: list[_Tally] = []
    size, fresh = 0, 0

    def tallied(parts, owners, groups):
        nonlocal size
        tallies.append(_Tally.of(parts, owners, groups))
        size += len(tallies[-1])

    for batch in batches:
        parts, owners, groups, bulk = [], [], [], 0
        for i, (lang, source, text) in enumerate(zip(*(batch.column(k) for k in range(3)))):
            group = names.setdefault((lang.as_py(), source.as_py()), len(names))
            raw = text.as_py().encode()
            if len(raw) > CHUNK:
                # Parts of one document count it once.
                tallies.append(_Tally.merged([_Tally.of([p], [0], [group]) for p in _cut(raw)], one_document=True))
                size += len(tallies[-1])
                continue
            parts.append(raw)
            owners.append(i)
            groups.append(group)
            bulk += len(raw)
            if bulk >= CHUNK:
                tallied(parts, owners, groups)
                parts, owners, groups, bulk = [], [], [], 0
            if size - fresh >= FLUSH:
                tallies[:] = [_Tally.merged(tallies)]
                size = fresh = len(tallies[0])
                if size >= FLUSH // 2:
                    yield from _split(tallies.pop(), list(names))
                    size = fresh = 0
        if parts:
            tallied(parts, owners, groups)
    if tallies:
        yield from _split(_Tally.merged(tallies), list(names))


def _split(tally: _Tally, names: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    batch = tally.batch(names)
    for at in range(0, len(tally), BATCH):
        yield batch.slice(at, BATCH)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences of each term in each group, and documents that hold it.

    Tasks count before anything moves.  What moves is dealt out by language and term, which serves both groupings.
    """
    rows = docs.select(_text("lang").alias("lang"), _text("source").alias("source"), _text("text").alias("text"))
    parts = rows.mapInArrow(_count_terms, "lang string, source string, term string, count long, docs long")
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, lang_count, held): a row a kept term, held an array of (source, count) with a struct a source at most."""
    by = term_counts(docs).groupBy("lang", "term")
    out = by.agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("held"))
    return out.filter(F.col("docs") >= min_docs).drop("docs")


def groups(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, v, lang_n) of every language and (lang, source, n, v, lang_n) of every group that occurs."""
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"))
    counts = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", "h.source").agg(F.sum("h.count").alias("n"))
    there = docs.select(_text("lang").alias("lang"), _text("source").alias("source")).distinct()
    out = there.join(counts, ["lang", "source"], "left").join(langs, "lang", "left")
    return langs, out.fillna(0, ["n", "v", "lang_n"])


def top_terms(kept: DataFrame, per: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group holds more often than its language, to rank ``top``."""
    rows = kept.select("lang", "term", "lang_count", F.explode("held").alias("h")).select("lang", "h.source", "term", "h.count", "lang_count")
    cells = rows.groupBy("lang", "source", "count", "lang_count").agg(F.count("*").alias("terms"))
    cells = cells.join(per, ["lang", "source"])
    p, q = share(F.col("count"), F.col("n"), F.col("v")), share(F.col("lang_count"), F.col("lang_n"), F.col("v"))
    cells = cells.withColumn("p", p).withColumn("q", q).filter("p > q").withColumn("value", divergence(F.col("p"), F.col("q")))
    group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    # A cell has a term at least, so cells from rank ``top`` on cannot reach it; ties stay together.
    cells = cells.select("lang", "source", "count", "lang_count", "value", "terms", F.rank().over(group).alias("at")).filter(F.col("at") <= top)
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    before = F.coalesce(F.sum("terms").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).filter(F.col("before") < top).select("lang", "source", "value", "before")
    chosen = cells.join(values, ["lang", "source", "value"]).select("lang", "source", "count", "lang_count", "value", "before")
    within = Window.partitionBy("lang", "source", "value").orderBy("term")
    out = rows.join(cut(chosen, "audit-cells"), ["lang", "source", "count", "lang_count"]).withColumn("at", F.row_number().over(within)).filter(F.col("at") <= top)
    return out.withColumn("rank", (F.col("before") + F.col("at")).cast("int")).filter(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def _wrapped(total: Column) -> Column:
    """A sum of 64-bit numbers, as decimal, modulo 2^64 and back in the signed range."""
    span = F.lit(str(1 << 64)).cast("decimal(20,0)")
    rest = F.pmod(total, span)
    return F.when(rest >= F.lit(str(1 << 63)).cast("decimal(20,0)"), rest - span).otherwise(rest).cast("long")


def _corrections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of f(p,q) - f(p,q0) - f(p0,q) + f(p0,q0) over terms that both sources hold; p0 and q0 are shares of none."""
    f = lambda p, q: (p - q) * (p - q) // q
    for batch in batches:
        for lang, own in batch.groupby("lang"):
            n = own["source"].map(len).to_numpy()
            names, code = np.unique(np.concatenate(own["source"].to_list()).astype(str), return_inverse=True)
            p, p0 = (np.concatenate(own[c].to_list()).astype(np.int64) for c in ("p", "p0"))
            first = np.repeat(np.cumsum(n) - n, n)
            partners = np.repeat(n, n)
            ends = np.cumsum(partners)
            sums: dict[int, int] = {}
            at = 0
            while at < len(p):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
                k = partners[at:to]
                a = np.repeat(np.arange(at, to), k)
                b = np.repeat(first[at:to], k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
                g = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
                key = code[a] * len(names) + code[b]
                order = np.argsort(key, kind="stable")
                keys, start = np.unique(key[order], return_index=True)
                for x, y in zip(keys.tolist(), np.add.reduceat(g[order], start).tolist()):
                    sums[x] = sums.get(x, 0) + y
                at = to
            keys = np.fromiter(sums, dtype=np.int64, count=len(sums))
            values = [(y + (1 << 63)) % (1 << 64) - (1 << 63) for y in sums.values()]
            yield pd.DataFrame({"lang": lang, "source": names[keys // len(names)], "item": names[keys % len(names)], "part": values})


def source_pairs(kept: DataFrame, per: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language, farthest first."""
    none = share(F.lit(0), F.col("n"), F.col("v"))
    sources = per.select("lang", "source", "n", "v", none.alias("p0"))
    rows = kept.select("lang", "term", F.explode("held").alias("h")).select("lang", "term", "h.source", "h.count")
    # Cells of a source: its different counts.  An empty cell lets a source without terms take part.
    cells = rows.groupBy("lang", "source", "count").agg(F.count("*").alias("terms"))
    cells = cells.join(sources, ["lang", "source"]).select("lang", "source", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), "p0", "terms", "v")
    cells = cells.unionByName(sources.select("lang", "source", F.col("p0").alias("p"), "p0", F.lit(0).cast("long").alias("terms"), "v"))
    other = sources.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    met = cells.join(other, "lang").filter("source <> item")
    wide = lambda c: c.cast("decimal(38,0)")
    own = F.sum(wide(divergence(F.col("p"), F.col("q0"))) * F.col("terms"))
    as_item = F.sum(wide(divergence(F.col("q0"), F.col("p"))) * F.col("terms"))
    lacking = F.sum("terms")
    sums = cut(met.groupBy("lang", "source", "item", "p0", "q0", "v").agg(own.alias("own"), as_item.alias("against"), lacking.alias("held")), "audit-pairs")
    # The sum over the terms of the second source is its own row seen from the other side.
    mirrored = sums.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("against").alias("theirs"), F.col("held").alias("their_held"))
    both = sums.join(mirrored, ["lang", "source", "item"])
    shared = rows.join(sources, ["lang", "source"]).select("lang", "term", "source", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), "p0")
    shared = shared.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held")).filter(F.size("held") > 1)
    shared = shared.select("lang", *[F.col(f"held.{c}").alias(c) for c in ("source", "p", "p0")])
    more = shared.mapInPandas(_corrections, "lang string, source string, item string, part long").groupBy("lang", "source", "item").agg(F.sum(wide(F.col("part"))).alias("more"))
    rest = wide(divergence(F.col("p0"), F.col("q0"))) * (F.col("v") - F.col("held") - F.col("their_held"))
    total = F.col("own") + F.col("theirs") + rest + F.coalesce("more", F.lit(0).cast("decimal(38,0)"))
    out = both.join(more, ["lang", "source", "item"], "left").withColumn("value", F.when(F.col("v") > 0, _wrapped(total)).otherwise(F.lit(0).cast("long")))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return out.withColumn("rank", F.row_number().over(order)).select("lang", "source", "item", "value", "rank")


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts, ``pair`` and ``term``."""
    kept = cut(kept_terms(docs, min_docs), "audit-terms")
    per = cut(groups(docs, kept)[1], "audit-groups")
    parts = [source_pairs(kept, per).withColumn("part", F.lit("pair")), top_terms(kept, per, top).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def audit_sql(documents: str = "documents", min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    """The same from a row for every group and kept term, counts of none included."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang::VARCHAR, '') AS lang, coalesce(source::VARCHAR, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ts FROM {documents}),
 t AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
 kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= {min_docs}),
 l AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
 n AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
 p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + ({SCALE} * (coalesce(c.c, 0) + 1)) // (n.n + l.v) AS p, 1 + ({SCALE} * (k.c + 1)) // (l.n + l.v) AS q
       FROM n JOIN l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
 pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
           LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
             ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
 terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms
QUALIFY rank <= {top}"""


QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLES = {"op11_source_divergence": audit_sql()}
