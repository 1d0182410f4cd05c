"""Line deduplication with two Bloom filters.

1. One pass over the texts sets, for every distinct long line of a document, the bits of its key's hashes.  A bit set by
   one line goes into the once-seen filter, one set by two lines of different documents into the twice-seen filter.
   Tasks send the set bits of each segment of the filters as gaps, so what moves is a few bytes a line and no line.
2. Segments are merged by a tree of bounded groups: set in either part is set, set once in two parts is set twice.
   The twice-seen filter comes to all tasks; its size follows the length of all texts up to a stated bound.
3. A second pass tests every line.  Only those that the twice-seen filter holds, the suspected repeats, shuffle by their
   128-bit digest for exact confirmation: distinct documents, and the largest doc_id, which keeps the line.
4. Documents with lines to drop are rewritten.

A filter at its bound that fills up only sends more lines to the exact step.  Confirmed lines of very many documents, a
bounded number, are looked up where the suspects are, so that no task meets all of them.

Defined results: a null or empty text is one empty line and is returned as an empty text; lines shorter than the minimum
never count; a document with a null id is not counted as holding a line; repeated rows with one doc_id are one document
and all keep or lose the same lines; doc_id may have any type that has an order; a text of any length is read whole; an
empty table gives an empty result; other columns pass through, and columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import cut, in_small_batches, meet, spare, table
from lexmill.llm.packing import squeeze, steps, unsqueeze, unstep

MIN_CHARS = 40
MIN_DOCS = 5
#: Bits a possible line, hashes a line, least and most bits of a filter (the most take 128 MB in every task's memory).
BITS_PER_LINE = 4
PROBES = 2
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
#: Bits of a segment, set bits gathered before they are sent, and parts merged at a time.
SEGMENT = 1 << 20
FLUSH = 1 << 21
MERGE = 64
_WS = " \t\n\x0b\x0c\r"


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """The digest of each line's key, or None where the key is shorter than ``min_chars`` code points."""
    out: list[bytes | None] = []
    for line in text.split("\n"):
        key = line.strip(_WS)
        out.append(xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None)  # bytes.lower() is A-Z only
    return out


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """The bits of each key, one column a hash."""
    return np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)[:, :PROBES] & np.uint64(bits - 1)


def _segments(once: np.ndarray, twice: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Sorted set bits by segment."""
    edges = [np.unique(x // SEGMENT) for x in (once, twice)]
    for s in np.unique(np.concatenate(edges)).tolist():
        parts = [x[np.searchsorted(x, s * SEGMENT) : np.searchsorted(x, (s + 1) * SEGMENT)] - np.uint64(s * SEGMENT) for x in (once, twice)]
        yield s, squeeze(*map(steps, parts))


def _set_bits(min_chars: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame(_segments(at, at[n > 1]), columns=["segment", "blob"])

        for batch in batches:
            for text in batch["text"]:
                if own := set(line_keys(text, min_chars)) - {None}:
                    held.append(np.unique(_probes(list(own), bits)))
                    size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    once, twice = np.zeros(SEGMENT, dtype=bool), np.zeros(SEGMENT, dtype=bool)
    for blob in rows["blob"]:
        one, two = (unstep(x) for x in unsqueeze(blob))
        twice[one[once[one]]] = True
        twice[two] = True
        once[one] = True
    return pd.DataFrame({"segment": [key[0]], "part": [key[1]], "blob": [squeeze(*(steps(np.flatnonzero(x).astype(np.uint64)) for x in (once, twice)))]})


def twice_seen(texts: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The twice-seen filter of (text), eight bits a byte."""
    parts = texts.mapInPandas(_set_bits(min_chars, bits), "segment int, blob binary").withColumn("part", F.spark_partition_id())
    for _ in range(3):
        parts = parts.groupBy("segment", F.floor(F.col("part") / MERGE).alias("part")).applyInPandas(_merge, "segment int, part long, blob binary")
    merged = parts.withColumn("part", F.lit(0).cast("long")).groupBy("segment", "part").applyInPandas(_merge, "segment int, part long, blob binary")
    packed = np.zeros(bits // 8, dtype=np.uint8)
    for r in merged.toLocalIterator():  # a row a segment, MOST_BITS / SEGMENT at most
        out = np.zeros(SEGMENT, dtype=bool)
        out[unstep(unsqueeze(r["blob"])[1]).astype(np.int64)] = True
        packed[r["segment"] * SEGMENT // 8 : (r["segment"] + 1) * SEGMENT // 8] = np.packbits(out, bitorder="little")
    return packed


def _suspects(twice, min_chars: int, bits: int):
    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def keys(text: pd.Series) -> pd.Series:
        def of(t: str) -> list[bytes]:
            own = list(set(line_keys(t, min_chars)) - {None})
            if not own:
                return []
            at = _probes(own, bits)
            hit = (twice.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)
            return [k for k, h in zip(own, hit) if h]

        return text.map(of)

    return keys


def _text(column: Column | str = "text") -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def filter_bits(chars: int, min_chars: int) -> int:
    """Bits for texts of so many characters: a power of two for BITS_PER_LINE of the lines that they can hold."""
    lines = BITS_PER_LINE * chars // (min_chars + 1)
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(lines - 1, 1).bit_length()))


@in_small_batches
def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, bits: int | None = None) -> DataFrame:
    """(doc_id, key) of every line to drop: its key is in ``min_docs`` documents and doc_id is not the largest of them."""
    if not bits:
        bits = filter_bits(docs.agg(F.sum(F.length("text"))).first()[0] or 0, min_chars)
    texts = docs.select("doc_id", _text().alias("text"))
    twice = docs.sparkSession.sparkContext.broadcast(twice_seen(texts.select("text"), min_chars, bits))
    held = texts.select("doc_id", F.explode(_suspects(twice, min_chars, bits)("text")).alias("key"))
    held = cut(held, "line-suspects")
    confirmed = held.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"), F.count("*").alias("rows")).filter(F.col("n") >= min_docs)
    confirmed = cut(confirmed.select("key", "keeper", "rows"), "line-confirmed")
    return meet(held, confirmed, ["key"], "rows").filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "key")


_REWRITTEN = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


@F.pandas_udf(_REWRITTEN)
def _rewrite(text: pd.Series, drops: pd.Series, min_chars: pd.Series) -> pd.DataFrame:
    rows = []
    for t, d, m in zip(text, drops, min_chars):
        lines = t.split("\n")
        if d is None or len(d) == 0:
            rows.append((t, len(lines), 0))
            continue
        gone = {bytes(k) for k in d}
        kept = [x for x, k in zip(lines, line_keys(t, m)) if k not in gone]
        rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, bits: int | None = None) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, and the counts n_lines and n_dropped."""
    own, keys, new = (spare(docs, x) for x in ("id", "keys", "new"))
    drops = repeated_lines(docs.select("doc_id", "text"), min_docs, min_chars, bits).groupBy("doc_id").agg(F.collect_set("key").alias(keys))
    drops = cut(drops.select(F.col("doc_id").alias(own), keys), "line-drops")
    # Always by shuffle, so that disk and time follow the input in one way at every size.
    out = docs.join(drops.hint("merge"), F.col("doc_id").eqNullSafe(F.col(own)), "left").drop(own)
    out = out.withColumn(new, _rewrite(_text(), keys, F.lit(min_chars)))
    for name in ("text", "n_lines", "n_dropped"):
        out = out.withColumn(name, F.col(f"{new}.{name}"))
    return out.drop(new, keys)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def dedup_sql(documents: str = "documents") -> str:
    """(doc_id, n_lines, n_dropped, text) by plain grouping of the line keys."""
    return rf"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, len(ls) AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
             FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}))),
 k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
 f AS (SELECT k.*, (r.keeper IS NULL OR r.keeper = doc_id) AS stays FROM k LEFT JOIN r USING (key))
SELECT doc_id, any_value(n)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS text
FROM f GROUP BY doc_id"""


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES = {"op5_line_dedup": f"SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ({dedup_sql()})"}
