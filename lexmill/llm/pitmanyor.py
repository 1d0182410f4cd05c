"""Hierarchical Pitman-Yor language model with seating sampled by Gibbs.

Every word has a restaurant of the words that follow it, and so has the start of a text.  Their new tables order from
one restaurant of words, whose new tables order from a byte model of word spelling, in which the restaurants of contexts
of up to ``CONTEXT`` bytes share the parent restaurant of the context without its earliest byte.  In any of them

    p(dish) = (c - d t + (theta + d T) * parent(dish)) / (theta + N)

with c customers and t tables of the dish, N and T in all.  Tables are latent.  A Gibbs sweep reseats, level by level, all
customers of every dish from the stored seating (``restaurants``), each level against the last state of the others: the
tables of the contexts are the customers of the word restaurant, its tables are the customers of the spelling.  After the
first sweep the seatings are samples, over which customers and tables, and so the predictive probabilities, are averaged.
A word outside the training texts is spelled, so its probability follows its letters.

1. One pass counts words, one counts pairs.  Pairs are packed and dealt to shards by their first word; a word that starts
   very many pairs is split by the second one.  The number of shards follows the number of tokens, so a shard is bounded.
2. Sweeps run over packed rows of the pairs seen more than once; all others have one table in every sample.  The word and
   spelling levels are small tables: words seen once have one table too and are spelled in one sum.
3. Texts are scored against the most frequent words and pairs in bounded arrays.  All other pairs are dealt to the same
   shards and meet their seats there, and what ends in a word outside the array is joined with the word table.

Defined results: a null or empty text has only its end token; without training documents every word is spelled by the
uniform byte model; repeated rows are scored row by row and each counts in training; an empty table gives an empty
result; doc_id may have any type; extra columns are ignored; a text of any length is read in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import cut, in_small_batches, release, table
from lexmill.llm.hasharray import HashArray, distinct, mix, most_frequent, order_of
from lexmill.llm.langid import held_out
from lexmill.llm.packing import squeeze, steps, unsqueeze, unstep
from lexmill.llm.restaurants import carry, reseat
from lexmill.llm.tokens import word_chunks

#: Bytes of context in spelling: at most 256 ** 3 spelling rows.
CONTEXT = 2
SPELLING_PARTS = 8
#: Words spelled at a time.
SPELLED = 1 << 14
SAMPLES = 2
STRENGTH = 5.0
#: The most frequent words and pairs that tasks hold in memory; what they do not hold is joined.
HEAD = 1 << 21
PAIRS = 1 << 20
#: Tokens packed at a time, tokens of a shard, the most shards, and about how many characters a token has.
FLUSH = 1 << 19
SHARD = 3 << 19
MOST_SHARDS = 1 << 16
#: Rows whose sums are added in one task, as the bits of a row's number that a block of rows leaves out.
BLOCK_BITS = 13
CHARS_PER_TOKEN = 5
#: The end of a word in spelling, and the hash that stands for the start and the end of a text.
STOP = 0x20
END = 0


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2.0 * twos, 1.0), 0.1, 0.95))


# Spelling


def gram_codes(raw: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds): for every byte and the stop of each word, its CONTEXT bytes before it and itself, low byte last."""
    sizes = length + 1
    offset = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(offset, sizes)
    last = place == np.repeat(length, sizes)
    sym = raw[np.where(last, 0, np.repeat(first, sizes) + place)].astype(np.uint64) if len(raw) else np.zeros(len(place), np.uint64)
    sym[last] = STOP
    code = sym.copy()
    for back in range(1, CONTEXT + 1):
        before = np.zeros(len(sym), dtype=np.uint64)
        before[back:] = sym[:-back]
        before[place < back] = 0
        code |= before << np.uint64(8 * back)
    return code, offset


def _tail(code: np.ndarray, level: int) -> np.ndarray:
    return code & np.uint64((1 << (8 * (level + 1))) - 1)


class Spelling:
    """Averaged predictive probabilities of the byte restaurants: their rows, and in a task all of them as one array."""

    def __init__(self, root: np.ndarray, rows: pd.DataFrame):
        self.root, self.rows, self._log = root, rows, None

    def __getstate__(self):
        return self.__dict__ | {"_log": None}

    def log(self) -> np.ndarray:
        """Logarithms of the probability of each byte after each context, 64 MB."""
        if self._log is None:
            p = self.root.astype(np.float32)
            for level in range(1, CONTEXT + 1):
                key, value = ({kind: g for kind, g in self.rows[self.rows["level"] == level].groupby("kind")}.get(k) for k in (1, 0))
                weight = np.ones(256**level, dtype=np.float32)
                if key is not None:
                    weight[key["key"].to_numpy()] = key["value"].to_numpy()
                # A context's parent leaves out its earliest byte, which stands highest.
                p = (weight.reshape(256, -1, 1) * p.reshape(1, -1, 256)).ravel()
                if value is not None:
                    p[value["key"].to_numpy()] = value["value"].to_numpy()
            np.maximum(p, np.float32(1e-30), out=p)
            self._log = np.log(p, out=p)
        return self._log

    def words(self, words: pd.Series) -> np.ndarray:
        """The probability of each word's bytes and stop, not less than about the least double."""
        return self.spans(*_as_arrays(words))

    def spans(self, raw: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The same of words that are spans of ``raw``."""
        out = np.zeros(len(first))
        for at in range(0, len(first), SPELLED):
            some = slice(at, at + SPELLED)
            code, offset = gram_codes(raw, first[some], length[some])
            out[some] = np.add.reduceat(self.log()[code.astype(np.int64)], offset, dtype=np.float64)
        return np.exp(np.maximum(out, -700.0))


def _as_arrays(words: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(w) for w in words], dtype=np.int64)
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(length) - length, length


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[dict[str, pa.Array]]:
    """The columns of about so many rows at a time, never of none: a sweep over many rows takes as many steps as over few."""
    held, size = [], 0

    def done() -> dict[str, pa.Array]:
        joined = pa.Table.from_batches(held)
        return {name: pa.concat_arrays(joined[name].chunks) for name in joined.column_names}

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= rows:
            yield done()
            held, size = [], 0
    if size:
        yield done()


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte, length) of a column of binary values; null has none."""
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), edges[:-1], np.diff(edges)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spelling grams with the tables of the words that they occur in."""
    for rows in _gathered(batches, SPELLED):
        raw, first, length = _spans(rows["word"])
        code, _ = gram_codes(raw, first, length)
        kinds, _, at = distinct(code)
        n = np.bincount(at, np.repeat(rows["t"].to_numpy().astype(float), length + 1))
        yield _batch(code=kinds.view(np.int64), n=n.astype(np.int64))


def spelling_grams(words: DataFrame) -> DataFrame:
    return words.select("word", "t").mapInArrow(_spell, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def sample_restaurants(code: np.ndarray, customers: np.ndarray, root: np.ndarray, seed: int) -> pd.DataFrame:
    """Gibbs sweeps over the context restaurants of some last context bytes; averaged predictive rows."""
    rng = np.random.default_rng([seed, int(code.min()) >> 8 & 0xFF])
    order = np.argsort(code)
    keys, c = {CONTEXT: code[order]}, {CONTEXT: customers[order].astype(np.int64)}
    parent, at, seats = {}, {}, {}
    for k in range(CONTEXT, 0, -1):
        up, parent[k] = np.unique(_tail(keys[k], k - 1), return_inverse=True)
        _, at[k] = np.unique(keys[k] >> np.uint64(8), return_inverse=True)
        seats[k] = np.zeros(len(keys[k]), dtype=np.int64), np.zeros(0)
        if k > 1:
            keys[k - 1], c[k - 1] = up, np.bincount(parent[k]).astype(np.int64)
    d = {k: _discount((c[k] == 1).sum(), (c[k] == 2).sum()) for k in c}
    base = root[_tail(keys[1], 0).astype(np.int64)]
    sums: dict[tuple[int, int], np.ndarray] = {}
    for sample in range(SAMPLES + 1):
        p, below = {}, base
        for k in range(1, CONTEXT + 1):
            t = seats[k][0] + 1
            tables, total = np.bincount(at[k], t), np.bincount(at[k], c[k])
            weight = (STRENGTH + d[k] * tables) / (STRENGTH + total)
            up = below if k == 1 else below[parent[k]]
            p[k] = (c[k] - d[k] * t) / (STRENGTH + total)[at[k]] + weight[at[k]] * up
            if sample:
                sums[k, 0] = sums.get((k, 0), 0.0) + p[k] / SAMPLES
                sums[k, 1] = sums.get((k, 1), 0.0) + weight / SAMPLES
            below = p[k]
        for k in range(CONTEXT, 0, -1):
            up = base if k == 1 else p[k - 1][parent[k]]
            t = seats[k][0] + 1
            others = np.bincount(at[k], t)[at[k]] - t
            seats[k] = reseat(c[k], (STRENGTH + d[k] * others) * up, d[k] * up, d[k], *seats[k], rng)
            if k > 1:
                c[k - 1] = np.bincount(parent[k], seats[k][0] + 1).astype(np.int64)
                seats[k - 1] = carry(c[k - 1], *seats[k - 1])
    parts = []
    for k in range(1, CONTEXT + 1):
        contexts = np.unique(keys[k] >> np.uint64(8))
        for kind, key in ((0, keys[k]), (1, contexts)):
            parts.append(pd.DataFrame({"level": k, "kind": kind, "key": key.astype(np.int64), "value": sums[k, kind]}))
    return pd.concat(parts)


def train_spelling(grams: DataFrame, seed: int) -> Spelling:
    """Fit the byte restaurants to (code, n)."""
    grams = cut(grams.select("code", "n", F.shiftright("code", 8).bitwiseAND(0xFF).alias("last")), "spelling-grams")
    # The root serves each byte as often as it follows another byte; at most 256 rows.
    kinds = grams.select("last", F.col("code").bitwiseAND(0xFF).alias("sym")).distinct().groupBy("sym").agg(F.count("*").alias("n")).collect()
    root = np.full(256, 0.5)
    for r in kinds:
        root[r["sym"]] += r["n"]
    root /= root.sum()

    def restaurants(rows: pd.DataFrame) -> pd.DataFrame:
        return sample_restaurants(rows["code"].to_numpy().astype(np.uint64), rows["n"].to_numpy(), root, seed)

    # A group has SPELLING_PARTS-th of the last bytes, so at most 2,097,152 rows.
    rows = grams.groupBy(F.pmod("last", F.lit(SPELLING_PARTS))).applyInPandas(restaurants, "level int, kind int, key long, value double").toArrow().to_pandas()  # bounded by CONTEXT
    release(grams)
    return Spelling(root, rows)


# Counts


def _merge_words(parts: list[tuple]) -> tuple:
    """(names, words, tokens in training, tokens) of distinct words."""
    h, words, c, n = (np.concatenate(x) for x in zip(*parts))
    kinds, at, inverse = distinct(h)
    return kinds, words[at], *(np.bincount(inverse, x).astype(np.int64) for x in (c, n))


def _word_array(data: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    words = np.empty(len(first), dtype=object)
    words[:] = [data[a:b] for a, b in zip(first.tolist(), end.tolist())]
    return words


def _count_words(shards: int):
    """Packed words with their tokens in training and in all texts, shard by shard."""

    def flush(parts: list[tuple]) -> pd.DataFrame:
        h, words, c, n = _merge_words(parts)
        shard = h % np.uint64(shards)
        order = order_of(shard)
        words, sizes, rows = words[order], np.fromiter(map(len, words), np.int64, len(words))[order], []
        ends = np.concatenate(([0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            at = order[a:b]
            rows.append((int(shard[at[0]]), squeeze(steps(h[at]), sizes[a:b], c[at], n[at], np.frombuffer(b"".join(words[a:b].tolist()), dtype=np.uint8))))
        return pd.DataFrame(rows, columns=["shard", "blob"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = np.zeros(0, np.uint64), np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64)
        (names, words, cs, ns), ends = nothing, np.zeros(2, dtype=np.int64)
        for batch in batches:
            train = batch["train"].to_numpy(dtype=bool)
            ends += (train.sum(), len(batch))
            for picked, h, bounds, raw, first, length in word_chunks(batch["text"]):
                if not len(h):
                    continue
                order = order_of(h)
                ranked = h[order]
                new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
                kinds, at, n = ranked[new], order[new], np.diff(np.append(new, len(h)))
                c = np.add.reduceat(np.repeat(train[np.array(picked, dtype=np.int64)], np.diff(bounds))[order], new, dtype=np.int64)
                # Words that are held already are only counted.
                place = np.searchsorted(names, kinds)
                there = np.append(names, np.uint64(0))[place] == kinds
                there &= place < len(names)
                cs[place[there]] += c[there]
                ns[place[there]] += n[there]
                if not there.all():
                    place, at = place[~there], at[~there]
                    found = _word_array(raw.tobytes(), first[at], (first + length)[at])
                    names, words, cs, ns = (np.insert(a, place, b) for a, b in ((names, kinds[~there]), (words, found), (cs, c[~there]), (ns, n[~there])))
                if len(names) > FLUSH // 2:
                    yield flush([(names, words, cs, ns)])
                    names, words, cs, ns = nothing
        if ends[1]:
            yield flush([(names, words, cs, ns), (np.array([END], dtype=np.uint64), np.array([b""], dtype=object), ends[:1], ends[1:])])

    return run


def _list_words(rows: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for blob in rows["blob"]:
        h, size, c, n, data = unsqueeze(blob)
        end = np.cumsum(size, dtype=np.int64)
        parts.append((unstep(h), _word_array(data.tobytes(), end - size, end), c.astype(np.int64), n.astype(np.int64)))
    h, words, c, n = _merge_words(parts)
    return pd.DataFrame({"h": h.view(np.int64), "word": words, "c": c, "n": n})


@dataclass
class Plan:
    """Where pairs go: ``shards``, and the words whose pairs are split, in how many parts, with their training tokens."""

    shards: int
    heavy: np.ndarray
    parts: np.ndarray
    tokens: np.ndarray

    def find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row in ``heavy``, whether it is the word's)."""
        at = np.minimum(np.searchsorted(self.heavy, u), max(len(self.heavy) - 1, 0))
        return at, self.heavy[at] == u if len(self.heavy) else np.zeros(len(u), dtype=bool)

    def shard(self, names: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The shard of each pair of places in ``names``."""
        to = lambda h: (mix(h) >> np.uint64(7)) % np.uint64(self.shards)
        at, heavy = self.find(names)
        out = to(names)[u]
        if heavy.any():
            split = np.flatnonzero(heavy[u])
            part = mix(names[w[split]]) % self.parts[at[u[split]]].astype(np.uint64)
            out[split] = to(names[u[split]] + part * np.uint64(0x9E3779B97F4A7C15))
        return out


def make_plan(words: DataFrame, tokens: int) -> Plan:
    shards = int(np.clip(-(-tokens // SHARD), 1, MOST_SHARDS))
    part = max(tokens // shards // 4, 1)
    rows = []
    if shards > 1:  # at most four words a shard start so many pairs
        rows = words.filter(F.col("n") > part).select("h", "n", "c").collect()
    h = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    n, c = (np.array([r[k] for r in rows], dtype=np.int64)[order] for k in ("n", "c"))
    return Plan(shards, h[order], -(-n // part), c)


def pairs_of(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The tokens of some texts with each text's end: every token's context is the one before it."""
    return np.insert(h, bounds[1:], np.uint64(END))


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * np.uint64(0xC2B2AE3D27D4EB4F) + w)


def _by_shard(names: np.ndarray, u: np.ndarray, w: np.ndarray, plan: Plan) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows in order) of pairs of places in ``names``."""
    shard = plan.shard(names, u, w)
    order = np.argsort(shard.astype(np.uint16) if plan.shards < 1 << 16 else shard, kind="stable")
    ends = np.flatnonzero(np.diff(shard[order])) + 1
    for rows in np.split(order, ends):
        if len(rows):
            yield int(shard[rows[0]]), rows


class _Names:
    """Names of a flush in the order of packing: words of the array by row, then the others by hash."""

    def __init__(self, names: np.ndarray, busy: HashArray):
        row = busy.find(names)
        held, other = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        self.order = np.concatenate((held[order_of(row[held].astype(np.uint64))], other))
        self.names, self.rows, self.held = names[self.order], row[self.order].astype(np.int64), len(held)
        self.place = np.empty(len(names), dtype=np.int64)
        self.place[self.order] = np.arange(len(names))

    def pack(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows and hashes of the distinct names, both as differences; place of each)."""
        used, _, place = distinct(at.astype(np.uint64))
        used = used.astype(np.int64)
        held = np.searchsorted(used, self.held)
        return steps(self.rows[used[:held]]), steps(self.names[used[held:]]), place


def _unpack_names(rows: np.ndarray, hashes: np.ndarray, busy: HashArray) -> np.ndarray:
    return np.concatenate((busy.keys[unstep(rows).astype(np.int64)], unstep(hashes)))


def _list_pairs(plan, busy):
    """Packed counts of the pairs of training texts, shard by shard."""

    def flush(tokens: list[np.ndarray], plan: Plan, busy: HashArray) -> Iterator[tuple[int, bytes]]:
        names, _, at = distinct(np.concatenate(tokens))
        names = _Names(names, busy)
        at = names.place[at].astype(np.uint64)
        u = np.concatenate((at[-1:], at[:-1]))  # a text starts after END, which ends the text before it
        both, n = np.unique(u << np.uint64(32) | at, return_counts=True)
        u, w = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(2**32 - 1)).astype(np.int64)
        for shard, rows in _by_shard(names.names, u, w, plan):
            (*un, ui), (*wn, wi) = names.pack(u[rows]), names.pack(w[rows])
            yield shard, squeeze(*un, np.diff(ui, prepend=0), *wn, wi, n[rows])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for _, h, bounds, *_ in word_chunks(batch["text"]):
                held.append(pairs_of(h, bounds))
                size += len(held[-1])
                if size > FLUSH:
                    yield pd.DataFrame(flush(held, plan.value, busy.value), columns=["shard", "blob"])
                    held, size = [], 0
        if held:
            yield pd.DataFrame(flush(held, plan.value, busy.value), columns=["shard", "blob"])

    return run


def _unpack_pairs(parts: list[list[np.ndarray]], busy: HashArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
    """(names of contexts, of words, both places of each packed pair in one number, the bits of a word's place)."""
    un, wn = ([_unpack_names(p[k], p[k + 1], busy) for p in parts] for k in (0, 3))
    (us, _, iu), (ws, _, iw) = (distinct(np.concatenate(x)) for x in (un, wn))
    bits = np.uint64(max(len(ws) - 1, 1).bit_length())
    code, fu, fw = [], 0, 0
    for a, b, p in zip(un, wn, parts):
        code.append(iu[fu + np.cumsum(p[2], dtype=np.int64)].astype(np.uint64) << bits | iw[fw + p[5].astype(np.int64)].astype(np.uint64))
        fu, fw = fu + len(a), fw + len(b)
    return us, ws, np.concatenate(code), bits


def _both(code: np.ndarray, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return (code >> bits).astype(np.int64), (code & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _merge_pairs(blobs: list[bytes], busy: HashArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names of contexts, of words, context and word of each distinct pair, its count)."""
    parts = [unsqueeze(b) for b in blobs]
    us, ws, code, bits = _unpack_pairs(parts, busy)
    both, _, at = distinct(code)
    c = np.bincount(at, np.concatenate([p[6] for p in parts])).astype(np.int64)
    return us, ws, *_both(both, bits), c


def _used(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct names as differences, place of each)."""
    used, _, place = distinct(at.astype(np.uint64))
    return steps(names[used.astype(np.int64)]), place


#: A shard: contexts (their names, tokens and single pairs), pairs seen more than once (context, word names and word, count,
#: openers and their ranks, tables summed over samples), and words (names, single pairs, tables of other pairs).
_STATE = "shard int, contexts binary, pairs binary, seats binary, words binary"


def _open_shard(busy, whole: bool):
    """``busy`` holds words; if it is ``whole``, words outside it were seen once and are not reported."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        us, ws, u, w, c = _merge_pairs(list(rows["blob"]), busy.value)
        single = c == 1
        once, more = np.bincount(w[single], minlength=len(ws)), np.bincount(w[~single], minlength=len(ws))
        told = busy.value.find(ws) >= 0 if whole else np.ones(len(ws), dtype=bool)
        contexts = squeeze(steps(us), np.bincount(u, c).astype(np.int64), np.bincount(u[single], minlength=len(us)))
        wn, wi = _used(ws, w[~single])
        n = int((~single).sum())
        pairs, seats = squeeze(u[~single], wn, wi, c[~single]), squeeze(np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64))
        return pd.DataFrame([(key[0], contexts, pairs, seats, squeeze(steps(ws[told]), once[told], more[told]))], columns=[x.split()[0] for x in _STATE.split(", ")])

    return run


def _word_values(busy: HashArray, held: np.ndarray, names: np.ndarray, tail, values) -> np.ndarray:
    """A value of each word: that beside the array, or that of the joined rows."""
    row = busy.find(names)
    out = np.append(held[:, 0], np.float32(0))[row].astype(float)
    if tail is not None and len(tail):
        h, p = np.asarray(tail, dtype=np.int64).view(np.uint64), np.asarray(values)
        order = np.argsort(h)
        at = np.minimum(np.searchsorted(h[order], names), len(h) - 1)
        hit = (h[order][at] == names) & (row < 0)
        out[hit] = p[order][at[hit]]
    return out


def _context_tables(plan: Plan, names: np.ndarray, here: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Tables of each context: those of this shard, or of all shards where the context is split."""
    at, split = plan.find(names)
    here = here.astype(float)
    here[split] = heavy[at[split]]
    return here


def _reseat_shard(busy, model, d: float, sweep: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, held, heavy = model.value
        for batch in batches:
            for shard, contexts, pairs, seats, tail, values in zip(*(batch[k] for k in ("shard", "contexts", "pairs", "seats", "tail", "values"))):
                names, _, single = unsqueeze(contexts)
                u, wn, wi, c = (x.astype(np.int64) if k != 1 else unstep(x) for k, x in enumerate(unsqueeze(pairs)))
                opened, ranks, summed = (x.astype(np.int64) for x in unsqueeze(seats))
                tables = _context_tables(plan, unstep(names), single + np.bincount(u, opened + 1, minlength=len(names)), heavy)
                p = _word_values(busy.value, held, wn, tail, values)[wi]
                others = tables[u] - (opened + 1)
                opened, ranks = reseat(c, (STRENGTH + d * others) * p, d * p, d, opened, ranks.astype(float), np.random.default_rng([sweep, shard]))
                summed = summed + (opened + 1 if sweep else 0)
                t = np.bincount(wi, opened + 1, minlength=len(wn)).astype(np.int64)
                row = (shard, contexts, pairs, squeeze(opened, ranks.astype(np.int64), summed), squeeze(steps(wn), np.zeros(len(wn), np.int64), t))
                yield pd.DataFrame([row], columns=[x.split()[0] for x in _STATE.split(", ")])

    return run


def _heavy_tables(plan: Plan, state: DataFrame, column: str) -> np.ndarray:
    """Tables of the split contexts over all shards; at most four a shard."""
    if not len(plan.heavy):
        return np.zeros(0)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for contexts, pairs, seats in zip(batch["contexts"], batch["pairs"], batch["seats"]):
                names, _, single = unsqueeze(contexts)
                u = unsqueeze(pairs)[0].astype(np.int64)
                opened, _, summed = (x.astype(np.int64) for x in unsqueeze(seats))
                t = single + np.bincount(u, opened + 1 if column == "last" else summed / SAMPLES, minlength=len(single))
                at, heavy = plan.find(unstep(names))
                yield pd.DataFrame({"at": at[heavy], "t": t[heavy]})

    out = np.zeros(len(plan.heavy))
    for r in state.select("contexts", "pairs", "seats").mapInPandas(tables, "at long, t double").groupBy("at").agg(F.sum("t").alias("t")).collect():
        out[r["at"]] = r["t"]
    return out


def _seat_words(spelling, d: float, tables: float, sweep: int):
    """Reseat the words seen more than once; sum their customers and tables over the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in enumerate(_gathered(batches, FLUSH // 4)):
            p = spelling.value.spans(*_spans(rows["word"]))
            c = np.maximum(rows["served"].to_numpy().astype(float), 1)
            stored, first, length = _spans(rows["ranks"])
            ranks = stored[first[0] : first[-1] + length[-1]].view(np.int64).astype(float)
            opened, ranks = carry(c, length // 8, ranks)
            rng = np.random.default_rng([sweep, k, int(rows["h"][0].as_py()) & 0xFFFFFFFF])
            opened, ranks = reseat(c, (STRENGTH + d * (tables - opened - 1)) * p, d * p, d, opened, ranks, rng)
            edges = np.concatenate(([0], 8 * np.cumsum(opened))).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(edges), pa.py_buffer(ranks.astype(np.int64))])
            more = 1 if sweep else 0
            summed = {x: rows[x].to_numpy() + more * y for x, y in (("sum_c", c), ("sum_t", opened + 1))}
            yield _batch(**(rows | {"p0": p, "ranks": kept, "t": opened + 1} | summed))

    return run


_WORDS = "h long, word binary, c long, served long, ranks binary, t long, sum_c double, sum_t double, p0 double"


def _spelled(spelling, names: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, SPELLED):
            rows["p0"] = spelling.value.spans(*_spans(rows["word"]))
            yield _batch(**{name: rows[name] for name in names.split()})

    return run


# Scores

_SUMS = "n_tokens long, n_known long, score double, base double"


def _score_texts(words, model, often):
    """Sums per row: all of the pairs in the array, counts and base scores of the others, which are packed by shard."""

    def flush(parts: list[tuple], part: int) -> Iterator[pd.DataFrame]:
        (plan, held, _), busy = model.value, words.value
        rid, u, w = (np.concatenate(x) for x in zip(*parts))
        docs, _, doc = distinct(rid)
        names, _, at = distinct(np.concatenate((u, w)))
        names = _Names(names, busy)
        at = names.place[at].astype(np.uint64)
        bits, more = (np.uint64(max(n - 1, 1).bit_length()) for n in (len(docs), len(names.names)))
        code = (at[: len(u)] << more | at[len(u) :]) << bits | doc.astype(np.uint64)
        code, n = np.unique(code, return_counts=True)
        doc, both = (code & np.uint64((1 << int(bits)) - 1)).astype(np.int64), code >> bits
        u, w = (both >> more).astype(np.int64), (both & np.uint64((1 << int(more)) - 1)).astype(np.int64)
        blobs = []
        for shard, rows in _by_shard(names.names, u, w, plan):
            (*un, ui), (*wn, wi), (dn, di) = names.pack(u[rows]), names.pack(w[rows]), _used(docs, doc[rows])
            blobs.append((shard, squeeze(*un, np.diff(ui, prepend=0), *wn, wi, n[rows], dn, di)))
        yield pd.DataFrame(blobs, columns=["shard", "blob"])
        # Counts and base scores of words in the array are known here.
        row = names.rows[w]
        known = np.flatnonzero(row >= 0)
        base = np.bincount(doc[known], n[known] * held[row[known], 1].astype(float), minlength=len(docs))
        tokens, own = np.bincount(doc, n, minlength=len(docs)), np.bincount(doc[known], n[known], minlength=len(docs))
        yield pd.DataFrame({"shard": -1 - part, "rid": (docs >> np.uint64(1)).view(np.int64), "n_tokens": tokens, "n_known": own, "score": 0.0, "base": base})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, (held, size) = often.value, ([], 0)
        known = np.append(pairs.values, np.zeros((1, 2), np.float32), axis=0)  # the last row is that of no pair
        for batch in batches:
            if not len(batch):
                continue
            part = int(batch["part"].iloc[0])
            rids = batch["rid"].to_numpy().view(np.uint64) << np.uint64(1) | batch["train"].to_numpy(dtype=bool).astype(np.uint64)
            sums = np.zeros((len(batch), 4))
            for picked, h, bounds, *_ in word_chunks(batch["text"]):
                picked = np.array(picked, dtype=np.int64)
                w = pairs_of(h, bounds)
                u = np.concatenate((w[-1:], w[:-1]))
                row = pairs.find(pair_key(u, w))
                hit, values = row >= 0, known[row]
                start = bounds[:-1] + np.arange(len(picked))
                for k, x in enumerate((hit, hit, values[:, 0], values[:, 1])):
                    sums[picked, k] = np.add.reduceat(x.astype(float), start)
                if not hit.all():
                    miss = ~hit
                    held.append((np.repeat(rids[picked], np.diff(bounds) + 1)[miss], u[miss], w[miss]))
                    size += len(held[-1][0])
                    if size > FLUSH:
                        yield from flush(held, part)
                        held, size = [], 0
            yield pd.DataFrame({"shard": -1 - part, "rid": batch["rid"], "doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_tokens": sums[:, 0], "n_known": sums[:, 1], "score": sums[:, 2], "base": sums[:, 3]})
        if held:
            yield from flush(held, part)

    columns = ["shard", "blob", "rid", "doc_id", "held_out", "n_tokens", "n_known", "score", "base"]
    whole = {"shard": "Int32", "rid": "Int64", "doc_id": object, "held_out": "boolean", "n_tokens": "Int64", "n_known": "Int64"}
    return lambda batches: (part.reindex(columns=columns).astype(whole) for part in run(batches))


def _score_shard(words, model, d: float):
    """Sums per row over a shard's pairs, and the pairs that end in a word outside the array."""

    def run(entries: pd.DataFrame, seats: pd.DataFrame) -> pd.DataFrame:
        (plan, held, heavy), busy = model.value, words.value
        if not len(entries) or entries["blob"].iloc[0] is None:
            return entries.assign(blob=None).reindex(columns=_PARTS).astype({"doc_id": object, "blob": object})
        parts = [unsqueeze(b) for b in entries["blob"]]
        us, ws, code, bits = _unpack_pairs(parts, busy)
        n = np.concatenate([p[6] for p in parts]).astype(np.int64)
        rid = np.concatenate([unstep(p[7])[p[8].astype(np.int64)] for p in parts])
        train, rid = (rid & np.uint64(1)).astype(bool), (rid >> np.uint64(1)).astype(np.int64)
        kinds, _, at = distinct(code)
        c = np.bincount(at, n * train).astype(float)
        t = np.minimum(c, 1.0)
        back = np.ones(len(us))
        total = np.zeros(len(us))
        # A split context may have no training pair in this shard.
        place, split = plan.find(us)
        total[split] = plan.tokens[place[split]]
        back[split] = (STRENGTH + d * heavy[place[split]]) / (STRENGTH + total[split])
        for contexts, pairs, seated in seats[["contexts", "pairs", "seats"]].itertuples(index=False, name=None):
            names, tokens, single = unsqueeze(contexts)
            names = unstep(names)
            pu, wn, wi, _ = unsqueeze(pairs)
            mean = unsqueeze(seated)[2] / SAMPLES
            tables = single + np.bincount(pu.astype(np.int64), mean, minlength=len(names))
            tokens = tokens.astype(float)
            k = np.minimum(np.searchsorted(names, us), len(names) - 1)
            own = (names[k] == us) & ~split
            back[own] = ((STRENGTH + d * tables) / (STRENGTH + tokens))[k[own]]
            total[own] = tokens[k[own]]
            # A pair's tables: its place among this shard's pairs of more than one customer.
            if len(pu):
                wn, pu, wi = unstep(wn), pu.astype(np.int64), wi.astype(np.int64)
                iu, iw = (np.minimum(np.searchsorted(a, b), len(a) - 1) for a, b in ((us, names), (ws, wn)))
                there = (us[iu] == names)[pu] & (ws[iw] == wn)[wi]
                want = iu[pu].astype(np.uint64) << bits | iw[wi].astype(np.uint64)
                j = np.minimum(np.searchsorted(kinds, want), len(kinds) - 1)
                there &= kinds[j] == want
                t[j[there]] = mean[there]
        ku, kw = _both(kinds, bits)
        own = np.maximum(c - d * t, 0.0) / (STRENGTH + total[ku])
        row = busy.find(ws)
        p = np.append(held[:, 0], np.float32(0))[row].astype(float)
        score = np.log10(np.maximum(own + back[ku] * p[kw], 1e-300))
        known = (row >= 0)[kw][at]
        # Sums of rows are packed by block, so that a shard sends no row for each of them.
        rids, _, doc = distinct(rid[known].astype(np.uint64))
        sums = np.bincount(doc, n[known] * score[at[known]], minlength=len(rids))
        ends = np.flatnonzero(np.diff(rids >> np.uint64(BLOCK_BITS))) + 1
        blobs = [(int(a[0] >> np.uint64(BLOCK_BITS)), squeeze(steps(a), b)) for a, b in zip(np.split(rids, ends), np.split(sums, ends)) if len(a)]
        rest, m = at[~known], len(blobs)
        numbers = lambda values: pd.arrays.IntegerArray(np.concatenate((np.zeros(m, np.int64), values)), np.arange(m + len(rest)) < m)
        floats = lambda values: np.concatenate((np.full(m, np.nan), values))
        out = pd.DataFrame({"rid": numbers(rid[~known]), "h": numbers(ws[kw[rest]].view(np.int64)), "n": numbers(n[~known]), "own": floats(own[rest]), "back": floats(back[ku[rest]])})
        out["block"] = pd.arrays.IntegerArray(np.concatenate((np.array([b for b, _ in blobs], np.int64), np.zeros(len(rest), np.int64))), np.arange(len(out)) >= m)
        out["blob"] = np.array([b for _, b in blobs] + [None] * len(rest), dtype=object)
        nothing = pd.arrays.IntegerArray(np.zeros(len(out), np.int64), np.ones(len(out), dtype=bool))
        out["doc_id"], out["held_out"], out["n_tokens"], out["n_known"], out["score"], out["base"] = None, pd.array([None], dtype="boolean").repeat(len(out)), nothing, nothing, np.nan, np.nan
        return out[_PARTS]

    return run


def _add_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """The scores of a block's rows, summed over shards; at most 1 << BLOCK_BITS rows."""
    parts = [unsqueeze(b) for b in rows["blob"]]
    rid, score = np.concatenate([unstep(p[0]) for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts])
    least = int(rid.min())
    found = np.flatnonzero(np.bincount(rid - least))
    return pd.DataFrame({"rid": found + least, "score": np.bincount(rid - least, score)[found]})


_PARTS = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "score", "base", "h", "n", "own", "back", "block", "blob"]


def _array(rows: DataFrame, key: str, values: list[str]) -> HashArray:
    """Rows of a bounded table as an array."""
    top = rows.select(key, *values).toArrow().to_pandas()
    return HashArray(top[key].to_numpy().astype(np.int64).view(np.uint64), top[values].to_numpy(dtype=float).reshape(len(top), len(values)))


def _beside(busy: HashArray, rows: DataFrame, key: str, values: list[str]) -> np.ndarray:
    """Values of the words of the array, row by row."""
    found = rows.select(key, *values).toArrow().to_pandas()
    at = busy.find(found[key].to_numpy().astype(np.int64).view(np.uint64))
    out = np.zeros((len(busy.keys), len(values)), dtype=np.float32)
    out[at[at >= 0]] = found[values].to_numpy(dtype=float).reshape(len(found), len(values))[at >= 0]
    return out


def _pair_rows(busy, model, d: float, least: int):
    """(b, score, base) of a shard's pairs of at least ``least`` customers that end in a word of the array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, held, heavy = model.value
        for batch in batches:
            for contexts, pairs, seats in zip(batch["contexts"], batch["pairs"], batch["seats"]):
                names, tokens, single = unsqueeze(contexts)
                names = unstep(names)
                u, wn, wi, c = (x.astype(np.int64) if k != 1 else unstep(x) for k, x in enumerate(unsqueeze(pairs)))
                mean = unsqueeze(seats)[2] / SAMPLES
                tables = _context_tables(plan, names, single + np.bincount(u, mean, minlength=len(names)), heavy)
                at, split = plan.find(names)
                tokens = tokens.astype(float)
                tokens[split] = plan.tokens[at[split]]
                row = busy.value.find(wn)
                keep = (c >= least) & (row[wi] >= 0)
                u, wi, c, mean = u[keep], wi[keep], c[keep], mean[keep]
                values = np.append(held, np.zeros((1, 2), np.float32), axis=0)[row][wi]
                p = (c - d * mean + (STRENGTH + d * tables[u]) * values[:, 0]) / (STRENGTH + tokens[u])
                yield pd.DataFrame({"b": pair_key(names[u], wn[wi]).view(np.int64), "score": np.log10(p), "base": values[:, 1].astype(float)})

    return run


def _levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Histogram of the pairs' counts for the choice of the array: sixteen steps an octave."""
    for batch in batches:
        for pairs in batch["pairs"]:
            kinds, n = np.unique(unsqueeze(pairs)[3], return_counts=True)
            yield pd.DataFrame({"c": kinds.astype(np.int64), "step": np.floor(np.log2(np.maximum(kinds, 1)) * 16).astype(np.int64), "n": n})


def _cutoff(state: DataFrame, most: int) -> int:
    """The least count that at most ``most`` pairs reach."""
    levels = state.select("pairs").mapInPandas(_levels, "c long, step long, n long").groupBy("step").agg(F.sum("n").alias("n"), F.min("c").alias("least"))
    total, cutoff = 0, np.iinfo(np.int64).max
    for r in levels.orderBy(F.desc("step")).collect():  # a few hundred rows
        total += r["n"]
        if total > most:
            break
        cutoff = r["least"]
    return int(cutoff)


@in_small_batches
def score_texts(docs: DataFrame, training: str = "not is_held_out") -> DataFrame:
    """Score ``docs`` (doc_id, text, is_held_out) with a model of those of its rows for which ``training`` holds."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.expr(training), F.lit(False)).alias("train"), "doc_id", F.col("is_held_out").alias("held_out"))

    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = int(np.clip(chars // CHARS_PER_TOKEN // SHARD, 1, MOST_SHARDS))
    counted = texts.select("text", "train").mapInPandas(_count_words(shards), "shard int, blob binary").groupBy("shard")
    words = cut(counted.applyInPandas(_list_words, "h long, word binary, c long, n long"), "lm-words")
    of = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("n"), F.count_if(F.col("c") > 1), F.count_if(F.col("c") == 1)).first()
    total, kinds, tokens, several, rare = (x or 0 for x in of)
    plan = make_plan(words, tokens)
    top = most_frequent(words.filter("c > 1").select("h", "c"), "c", HEAD)
    busy = share(_array(top, "h", []))
    whole = len(busy.value.values) == several

    # Counts and first seating: every pair has one table.
    dealt = texts.filter("train").select("text").mapInPandas(_list_pairs(share(plan), busy), "shard int, blob binary")
    state = cut(dealt.groupBy("shard").applyInPandas(_open_shard(busy, whole), _STATE), "lm-seats")
    by_word = lambda d: d.select("shard", "words").mapInPandas(_by_word, "shard int, h long, once long, tables long")
    first = by_word(state).groupBy("h").agg(F.sum("once").alias("once"), F.sum("tables").alias("tables"))
    seated = words.filter("c > 1").select("h", "word", "c").join(first, "h", "left").na.fill(0, ["once", "tables"])
    served = F.col("once") + F.col("tables")
    fresh = [F.lit(None).cast("binary").alias("ranks"), F.lit(1).cast("long").alias("t"), F.lit(0.0).alias("sum_c"), F.lit(0.0).alias("sum_t")]
    seated = cut(seated.select("h", "word", "c", "once", served.alias("served"), *fresh), "lm-busy")
    once_by_word = seated.select("h", "once")
    of = seated.agg(F.sum("served"), F.count_if(F.col("served") == 1), F.count_if(F.col("served") == 2)).first()
    d1 = _discount((of[1] or 0) + rare, of[2] or 0)
    counts = state.select("contexts", "pairs").mapInPandas(_ones_and_twos, "ones long, twos long").agg(F.sum("ones"), F.sum("twos")).first()
    d2 = _discount(counts[0] or 0, counts[1] or 0)
    rare_grams = cut(spelling_grams(words.filter("c = 1").select("word", F.lit(1).alias("t"))), "lm-rare-grams")

    tables = float(several + rare)
    spelling = None
    for sweep in range(SAMPLES + 1):
        grams = rare_grams.unionByName(spelling_grams(seated)).groupBy("code").agg(F.sum("n").alias("n"))
        spelling = share(train_spelling(grams, sweep))
        columns = _WORDS.replace(", p0 double", "").split(", ")
        old, run = seated, _seat_words(spelling, d1, tables, sweep)
        seated = cut(seated.select(*[x.split()[0] for x in columns], F.lit(0.0).alias("p0")).mapInArrow(run, _WORDS), "lm-busy")
        of = seated.agg(F.sum("served"), F.sum("t")).first()
        customers, tables = float((of[0] or 0) + rare), float((of[1] or 0) + rare)
        p1 = (F.col("served") - d1 * F.col("t") + (STRENGTH + d1 * tables) * F.col("p0")) / (STRENGTH + customers)
        ranked = seated.select("h", "c", p1.alias("p"))
        if whole:
            held, tails = _beside(busy.value, ranked, "h", ["p"]), state.withColumn("tail", F.lit(None).cast("array<long>")).withColumn("values", F.lit(None).cast("array<double>"))
        else:  # words outside the array come by join, for the shards that ask for them
            held = _beside(busy.value, most_frequent(ranked, "c", HEAD), "h", ["p"])
            asked = by_word(state).select("shard", "h").join(ranked.join(most_frequent(ranked, "c", HEAD).select("h"), "h", "left_anti"), "h")
            tails = state.join(asked.groupBy("shard").agg(F.collect_list("h").alias("tail"), F.collect_list("p").alias("values")), "shard", "left")
        model = share((plan, held, _heavy_tables(plan, state, "last")))
        before = state
        state = cut(tails.select("shard", "contexts", "pairs", "seats", "tail", "values").mapInPandas(_reseat_shard(busy, model, d2, sweep), _STATE), "lm-seats")
        release(before)
        model.destroy()
        now = by_word(state).groupBy("h").agg(F.sum("tables").alias("tables"))
        if sweep < SAMPLES:
            now = seated.drop("served", "p0").join(once_by_word, "h").join(now, "h", "left").na.fill(0, ["tables"])
            seated = cut(now.select("h", "word", "c", served.alias("served"), "ranks", "t", "sum_c", "sum_t"), "lm-busy")
            if sweep:
                release(old)

    # Averaged predictive probabilities of words: seen more often, once, and only in texts that did not train.
    of = seated.agg(F.sum("sum_c"), F.sum("sum_t")).first()
    customers, tables = (of[0] or 0.0) / SAMPLES + rare, (of[1] or 0.0) / SAMPLES + rare
    others = words.filter("c <= 1").select("h", "c", "word").mapInArrow(_spelled(spelling, "h c p0"), "h long, c long, p0 double")
    known = seated.select("h", "c", "p0", (F.col("sum_c") / SAMPLES).alias("served"), (F.col("sum_t") / SAMPLES).alias("t"))
    once = F.col("c").cast("double")
    known = known.unionByName(others.select("h", "c", "p0", once.alias("served"), once.alias("t")))
    p1 = (F.col("served") - d1 * F.col("t") + (STRENGTH + d1 * tables) * F.col("p0")) / (STRENGTH + customers)
    base = F.log10((F.col("c") + 1) / F.lit(float(total + kinds + 1)))
    known = cut(known.select("h", "c", F.greatest(p1, F.lit(1e-300)).alias("p"), base.alias("base")), "lm-model")
    held = _beside(busy.value, most_frequent(known.filter("c > 1"), "c", HEAD), "h", ["p", "base"])
    model = share((plan, held, _heavy_tables(plan, state, "mean")))
    often = _array(state.select("contexts", "pairs", "seats").mapInPandas(_pair_rows(busy, model, d2, _cutoff(state, PAIRS)), "b long, score double, base double"), "b", ["score", "base"])

    # A row of each text goes through the same shuffle, under a shard of its input partition, and meets no seats.
    rows = texts.withColumn("rid", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    kind = docs.schema["doc_id"].dataType.simpleString()
    entries = rows.mapInPandas(_score_texts(busy, model, share(often)), f"shard int, blob binary, rid long, doc_id {kind}, held_out boolean, {_SUMS}").groupBy("shard")
    seats = state.select("shard", "contexts", "pairs", "seats").groupBy("shard")
    schema = f"rid long, doc_id {kind}, held_out boolean, {_SUMS}, h long, n long, own double, back double, block long, blob binary"
    found = cut(entries.cogroup(seats).applyInPandas(_score_shard(busy, model, d2), schema), "lm-found")
    tail = found.filter("h is not null").select("rid", "h", "n", "own", "back").join(known, "h", "left")
    tail = tail.select("rid", F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * F.log10(F.col("own") + F.col("back") * F.col("p"))).alias("score"), (F.col("n") * F.col("base")).alias("base"))
    sums = [x.split()[0] for x in _SUMS.split(", ")]
    added = found.filter("blob is not null").select("block", "blob").groupBy("block").applyInPandas(_add_sums, "rid long, score double")
    pieces = found.filter("h is null and blob is null").select("rid", "doc_id", "held_out", *sums)
    for more in (added, tail):
        pieces = pieces.unionByName(more, allowMissingColumns=True)
    out = pieces.groupBy("rid").agg(F.first("doc_id", True).alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(x).alias(x) for x in sums])
    per = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", per.alias("perplexity"))


def _by_word(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for shard, blob in zip(batch["shard"], batch["words"]):
            h, once, tables = unsqueeze(blob)
            yield pd.DataFrame({"shard": shard, "h": unstep(h).view(np.int64), "once": once.astype(np.int64), "tables": tables.astype(np.int64)})


def _ones_and_twos(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for contexts, pairs in zip(batch["contexts"], batch["pairs"]):
            yield pd.DataFrame({"ones": [int(unsqueeze(contexts)[2].sum(dtype=np.int64))], "twos": [int((unsqueeze(pairs)[3] == 2).sum())]})


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("is_held_out")))


QUERIES = {"op3_lm_score": op3_lm_score}
ORACLES: dict[str, str] = {}
