"""Repeated byte windows by depth-limited radix passes over suffixes.

A suffix matters here only through its first ``WINDOW`` bytes: equal groups at that depth are exactly the repeated
windows.  Sorting every suffix by every digit would move far more bytes than the texts have, so the suffixes are
taken in runs, and the passes read digits of decreasing length:

* In every window the least of the hashed ``GRAM``-byte strings is its anchor, the leftmost among equals.  Equal windows
  have equal anchors at equal offsets, so windows are grouped by anchor and offset.  Neighbouring windows mostly share an
  anchor; a run of them is one row.
* A pass looks at cells of neighbouring offsets of an anchor.  The bytes common to all windows of a cell are one digit,
  the bytes that the windows cover together are another.  If the common bytes occur once, no window of the cell is
  repeated.  If the covered bytes occur twice, all are.  Only the remaining cells go to the next pass, which splits them.
* The last pass has cells of one window, where both digits are the window itself.

A pass is one most-significant-digit step: cells in one bucket agree in the bytes read so far, buckets of one cell are
done, and only the others are dealt on by more bytes (64, then 352, 394 and 400).  Each pass groups 64-bit digests with
map-side counts, so a passage in a third of all documents costs a row per task, and its bucket is met where its cells are.

Defined results: a null or empty text has no bytes and loses none; a text shorter than a window loses none; repeated rows
are separate occurrences, also with equal doc_id; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import cut, meet, spare, table

WINDOW = 400
GRAM = 64
#: Offsets of a window from its anchor: 337, split by seven in each pass.
REACH = WINDOW - GRAM
WIDTHS = (49, 7, 1)
#: Window starts handled at a time, so that a very long text needs bounded memory.
SEGMENT = 1 << 22

_BYTES = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = [(1 << k, np.uint64(m)) for k, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))]
_POS_BITS = np.uint64(28)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling."""
    h = _BYTES[data]
    for step, factor in _STEPS:
        h = h[:-step] * factor + h[step:]
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def anchor_runs(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first window, last window, gram hash) of every run of windows with one anchor."""
    width, open_ = REACH + 1, None
    for base in range(0, len(data) - WINDOW + 1, SEGMENT):
        h = gram_hashes(data[base : base + SEGMENT + WINDOW - 1])
        n = len(h) - width + 1
        packed = (h >> _POS_BITS << _POS_BITS) | np.arange(len(h), dtype=np.uint64)
        blocks = np.full(-(-len(h) // width) * width, np.uint64(2**64 - 1))
        blocks[: len(h)] = packed
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
        at = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:] - 1, [n - 1]))
        found = [at[first] + base, first + base, last + base, h[at[first]].view(np.int64)]
        # A run that goes on over the segment's end is one run: its first part is held back.
        if open_ is not None:
            if open_[0][0] == found[0][0]:
                found[1][0] = open_[1][0]
            else:
                found = [np.concatenate(x) for x in zip(open_, found)]
        open_ = [x[-1:].copy() for x in found]
        yield tuple(x[:-1] for x in found)
    if open_ is not None:
        yield tuple(open_)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        parts = []
        for tid, text in zip(batch["tid"], batch["text"]):
            raw = text.encode()
            if len(raw) < WINDOW:
                continue
            for at, first, last, core in anchor_runs(np.frombuffer(raw, dtype=np.uint8)):
                covers = [digest(raw[a - REACH : a + WINDOW]) if a >= REACH and a + WINDOW <= len(raw) else -1 for a in at.tolist()]
                parts.append((np.full(len(at), tid), at, at - last, at - first, core, covers))
        if parts:
            cols = [np.concatenate([p[k] for p in parts]) for k in range(5)]
            covers = [c for p in parts for c in p[5]]
            yield pd.DataFrame(dict(zip(("tid", "at", "lo", "hi", "core"), cols)) | {"cover": pd.array([None if c < 0 else _signed(c) for c in covers], dtype="Int64")})


_CONTEXT = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("left", T.LongType()), T.StructField("bytes", T.BinaryType())]))


@F.pandas_udf(_CONTEXT)
def _contexts(text: pd.Series, runs: pd.Series) -> pd.Series:
    def of(t: str, rs) -> list[dict]:
        raw = t.encode()
        return [{"at": r["at"], "lo": r["lo"], "hi": r["hi"], "left": min(REACH, r["at"]), "bytes": raw[max(0, r["at"] - REACH) : r["at"] + WINDOW]} for r in rs]

    return pd.Series([of(t, rs) for t, rs in zip(text, runs)])


def _cells(width: int, wider: int):
    """Digests of the cells of ``width`` offsets inside each pending cell of ``wider`` offsets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for tid, at, lo, hi, left, raw, start in batch[["tid", "at", "lo", "hi", "left", "bytes", "start"]].itertuples(index=False, name=None):
                for d1 in range(start, min(start + wider, REACH + 1), width):
                    d2 = min(d1 + width - 1, REACH)
                    if d2 < lo or d1 > hi:
                        continue
                    core = digest(raw[left - d1 : left - d2 + WINDOW])
                    full = left >= d2 and len(raw) - left >= WINDOW - d1
                    cover = _signed(digest(raw[left - d2 : left - d1 + WINDOW], seed=1)) if full else None
                    out.append((tid, at, lo, hi, d1, _signed(core), cover))
            yield pd.DataFrame(out, columns=["tid", "at", "lo", "hi", "start", "core", "cover"]).astype({"cover": "Int64"})

    return run


_KEYS = "tid long, at long, lo long, hi long, start long, core long, cover long"


def _split(cells: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(repeated, open) cells: those whose covered bytes repeat, and the others whose common bytes repeat.

    An open cell may hold a window of a repeated one, so one cell of each repeated group stays open beside it.
    """
    common = cut(cells.groupBy("start", "core").agg(F.count("*").alias("n")).filter("n > 1"), "radix-common")
    cells = cut(meet(cells, common, ["start", "core"], "n", "left_semi"), "radix-cells")
    covered = cells.filter("cover is not null").groupBy("start", "core", "cover").agg(F.count("*").alias("n"), F.min(F.struct("tid", "at", "lo", "hi")).alias("one"))
    covered = cut(covered.filter("n > 1").select("start", "core", "cover", "one", "n"), "radix-covered")
    keys, columns = ["start", "core", "cover"], ["tid", "at", "lo", "hi", "start"]
    again = cut(meet(cells, covered.drop("one"), keys, "n", "left_semi").select(columns), "radix-again")
    if width == 1:
        return again, again.filter("false")
    open_ = cut(meet(cells, covered.drop("one"), keys, "n", "left_anti").select(*columns, "core"), "radix-open-cells")
    beside = covered.join(open_.select("start", "core").distinct(), ["start", "core"], "left_semi").select("start", "one.*")
    return again, open_.select(columns).unionByName(beside.select(columns))


def _spans(repeated: DataFrame, width: int) -> DataFrame:
    """The bytes covered by the windows of repeated cells: [from, upto) in the text."""
    d1, d2 = F.greatest("start", "lo"), F.least(F.col("start") + (width - 1), F.col("hi"))
    return repeated.select("tid", (F.col("at") - d2).alias("from"), (F.col("at") - d1 + WINDOW).alias("upto"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(tid, from, upto): byte spans covered by repeated windows, of ``texts`` (tid, text)."""
    cells = cut(texts.mapInPandas(_anchors, "tid long, at long, lo long, hi long, core long, cover long").select("*", F.lit(0).cast("long").alias("start")), "radix-anchors")
    again, open_ = _split(cells, REACH + 1)
    spans = _spans(again, REACH + 1)
    runs = open_.groupBy("tid").agg(F.collect_set(F.struct("at", "lo", "hi")).alias("runs"))
    runs = cut(runs, "radix-open")
    contexts = texts.join(runs, "tid").select("tid", F.explode(_contexts("text", "runs")).alias("c")).select("tid", "c.*")
    contexts = cut(contexts, "radix-contexts")
    pending = contexts.withColumn("start", F.lit(0).cast("long"))
    wider = REACH + 1
    for width in WIDTHS:
        cells = cut(pending.select("tid", "at", "lo", "hi", "left", "bytes", "start").mapInPandas(_cells(width, wider), _KEYS), "radix-digits")
        again, open_ = _split(cells, width)
        spans = spans.unionByName(_spans(again, width))
        pending = contexts.join(open_.select("tid", "at", "lo", "start").distinct(), ["tid", "at", "lo"])
        wider = width
    return spans


_KEPT = T.StructType([T.StructField("kept", T.BinaryType())] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")])


@F.pandas_udf(_KEPT)
def _remove(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    def of(t: str, found) -> tuple:
        raw = t.encode()
        if found is None or len(found) == 0:
            return raw, len(raw), 0, 0
        kept, at, removed, runs, end = [], 0, 0, 0, -1
        for x in sorted((s["from"], s["upto"]) for s in found):
            if x[0] > end:
                runs += 1
                kept.append(raw[at : x[0]])
                removed += x[1] - x[0]
            elif x[1] > end:
                removed += x[1] - end
            end = at = max(end, x[1])
        return b"".join(kept) + raw[at:], len(raw), removed, runs

    return pd.DataFrame([of(t, s) for t, s in zip(text, spans)], columns=["kept", "n_bytes", "n_removed", "n_spans"])


def dedup_windows(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns kept (bytes), n_bytes, n_removed and n_spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    own, found, new = (spare(docs, x) for x in ("tid", "spans", "new"))
    docs = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("string"), text))
    spans = repeated_spans(docs.select(F.col(own).alias("tid"), text.alias("text")))
    held = spans.groupBy(F.col("tid").alias(own)).agg(F.collect_set(F.struct("from", "upto")).alias(found))
    held = cut(held, "radix-spans")
    out = docs.join(held, own, "left").withColumn(new, _remove(text, found))
    return out.select(*[c for c in out.columns if c not in (own, found, new)], f"{new}.*")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLES: dict[str, str] = {}
