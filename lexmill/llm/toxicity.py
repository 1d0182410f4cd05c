"""Toxicity by multiple-instance learning: documents are bags of sentences, and only documents are labelled.

A sentence's score is the logistic function of a bias and the weights of its signs, which are byte grams of two lengths over
lower-cased letters; a sentence without signs scores 0.  A document's score is the noisy-or 1 - (1 - leak) * prod(1 - score)
over its sentences, with a leak for documents without any sign.  Bias, weights and leak are fitted to document labels by
gradient ascent on the likelihood of the noisy-or, so the gradient itself decides which sentences of a toxic document carry
its label.  The sentences whose own score reaches the limit are the offending ones, located by code points.

Fitting takes a hash sample of about SAMPLE_DOCS labelled documents a class (texts up to SAMPLE_CHARS characters), which is its
documented bound.  Spark counts the sample's grams by class and picks the MOST_SIGNS grams that tell toxic documents most
surely; only these grams of the sample come to the driver.  Every text is scored whole, in pieces of bounded size.

Defined results: a null or empty text scores the leak; without toxic and clean labelled rows every score is 0; a document
with several labels counts as toxic if one says so; a labelled id with several texts is learned from the least text in order;
null labels are no labels; repeated rows get equal scores; columns of the input pass through, except that columns named like
the results are replaced; an empty table gives an empty result.  Sentences end at line ends and at ``. ! ?``.  A part of
a text without such an end in PIECE bytes is cut at white space, and each side counts as a sentence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import cut, spare, table
from lexmill.llm.packing import squeeze, unsqueeze

SAMPLE_DOCS = 3000
SAMPLE_CHARS = 1_000_000
MOST_SIGNS = 8192
#: A sign stands in so many sampled toxic documents at least, and its share of them is so many times that of clean ones.
LEAST_DOCS = 3
LEAST_LIFT = 2.0
#: Bytes of a gram, bytes of text read at a time, and scores from which a document is toxic and a sentence offends.
GRAMS = (5, 8)
PIECE = 1 << 20
TOXIC_FROM = 0.7
OFFENDING_FROM = 0.5
#: Steps of the fit, their size, and the weights' decay.
STEPS, RATE, DECAY = 400, 0.1, 1e-4
_FILTER_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def held_out(doc_id: Column, modulus: int = 3, remainder: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def grams(raw: np.ndarray, sentence: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sentence, code) of every byte gram, one length at a time; ``sentence`` numbers the bytes and never falls.

    What is no letter is a space, of which only the first in a row stays; a gram lies within one sentence.  A gram's code is
    its bytes, so grams of up to eight bytes never share one; grams of eight have no zero byte and so none of a shorter code.
    """
    folded = _FOLD[raw]
    blank = folded == 0x20
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (sentence[1:] == sentence[:-1]))
    folded, sentence = folded[keep].astype(np.uint64), sentence[keep]
    code, length = folded, 1
    for n in GRAMS:
        while length < n:
            code = (code[:-1] << np.uint64(8)) | folded[length:]
            length += 1
        inside = sentence[: len(code)] == sentence[n - 1 :] if len(code) else np.zeros(0, dtype=bool)
        yield sentence[: len(code)][inside], code[inside]


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """(bytes, sentence number of each byte, first byte of each text's part, texts) for about PIECE bytes at a time.

    Every part opens a new sentence with a space of its own; a long text is cut after its last sentence end within PIECE
    bytes, else after white space, else between code points.
    """
    parts, owners, size = [], [], 0

    def done():
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
        starts = np.cumsum([0] + [len(p) for p in parts])
        new = np.zeros(len(raw), dtype=bool)
        new[1:] = _ENDS[raw[:-1]]
        new[starts[:-1]] = True
        return raw, np.cumsum(new) - 1, starts[:-1], list(owners)

    for i, text in enumerate(texts):
        rest = memoryview((text or "").encode())
        while len(rest):
            to = len(rest) if len(rest) <= PIECE else _cut(rest)
            if parts and size + to > PIECE:
                yield done()
                parts, owners, size = [], [], 0
            parts.append(b" " + bytes(rest[:to]))
            owners.append(i)
            size += to
            rest = rest[to:]
    if parts:
        yield done()


def _cut(rest: memoryview) -> int:
    head = np.frombuffer(rest[:PIECE], dtype=np.uint8)
    for stops in (_ENDS, _BLANK):
        at = np.flatnonzero(stops[head])
        if len(at):
            return int(at[-1]) + 1
    to = PIECE
    while to > PIECE - 3 and (rest[to] & 0xC0) == 0x80:
        to -= 1
    return to


def _document_grams(text: str) -> np.ndarray:
    """The different grams of a text."""
    found = [np.unique(code) for raw, sentence, _, _ in pieces([text]) for _, code in grams(raw, sentence)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for toxic, own in batch.groupby("toxic"):
            codes = [_document_grams(t) for t in own["text"]]
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pd.DataFrame({"code": code.view(np.int64), "toxic_docs": n * int(toxic), "clean_docs": n * (1 - int(toxic))})


@dataclass
class Model:
    """Signs as sorted codes with their weights, the bias of a sentence that has some, and the leak."""

    signs: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float

    def __post_init__(self):
        self.seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.seen[self._slot(self.signs)] = True

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return (code * _MIX) >> np.uint64(64 - _FILTER_BITS)

    def hits(self, raw: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, sign) of the different signs in each sentence."""
        found = []
        for at, code in grams(raw, sentence):
            may = np.flatnonzero(self.seen[self._slot(code)])
            sign = np.minimum(np.searchsorted(self.signs, code[may]), len(self.signs) - 1)
            sure = self.signs[sign] == code[may]
            found.append(at[may][sure].astype(np.int64) * len(self.signs) + sign[sure])
        both = np.unique(np.concatenate(found))
        return both // len(self.signs), both % len(self.signs)

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first code point, length, score) of every sentence with a sign."""
        out, before = [], [0] * len(texts)
        for raw, sentence, starts, owners in pieces(texts):
            where, sign = self.hits(raw, sentence)
            chars = np.cumsum((raw & 0xC0) != 0x80)
            # Code points of each text before its part; the space that each part begins with is none of them.
            ahead = []
            for owner, n in zip(owners, (np.append(chars[starts[1:] - 1], chars[-1]) - chars[starts]).tolist()):
                ahead.append(before[owner])
                before[owner] += n
            own, first = np.unique(where, return_index=True)
            if not len(own):
                continue
            begins = np.flatnonzero(np.diff(sentence, prepend=-1))
            ends = np.append(begins[1:], len(raw))
            part = np.searchsorted(starts, begins[own], side="right") - 1
            begin = np.maximum(chars[begins[own]] - 1 - chars[starts[part]], 0)
            end = chars[ends[own] - 1] - chars[starts[part]]
            out.append((np.asarray(owners)[part], np.asarray(ahead)[part] + begin, end - begin, np.add.reduceat(self.weights[sign], first)))
        if not out:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        text, begin, length, total = (np.concatenate(x) for x in zip(*out))
        return text, begin, length, 1.0 / (1.0 + np.exp(-(self.bias + total)))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, tuple]:
        text, begin, length, own = found = self.sentences(texts)
        log_none = np.bincount(text, weights=np.log1p(-np.minimum(own, 1 - 1e-12)), minlength=len(texts))
        return 1.0 - (1.0 - self.leak) * np.exp(log_none), found


def fit_bags(bags: list[np.ndarray], signs: list[np.ndarray], toxic: np.ndarray, n_signs: int) -> tuple[np.ndarray, float, float]:
    """(weights, bias, leak) by Adam on the noisy-or likelihood; a bag numbers the sentence of each of its signs."""
    sentences = np.array([len(np.unique(b)) for b in bags])
    offset = np.cumsum(sentences) - sentences
    row = np.concatenate([np.unique(b, return_inverse=True)[1] + o for b, o in zip(bags, offset)]).astype(np.int64)
    sign = np.concatenate(signs).astype(np.int64)
    doc = np.repeat(np.arange(len(bags)), sentences)
    n = int(sentences.sum())
    x = np.concatenate((np.zeros(n_signs), [-2.0, np.log(0.02)]))  # weights, bias, logit of the leak
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        z = x[n_signs] + np.bincount(row, weights=x[sign], minlength=n)
        s = 1.0 / (1.0 + np.exp(-z))
        leak = 1.0 / (1.0 + np.exp(-x[-1]))
        none = np.bincount(doc, weights=np.log1p(-np.minimum(s, 1 - 1e-12)), minlength=len(bags)) + np.log1p(-leak)
        # d log-likelihood / d z is s * (1 - p) / p in toxic documents and -s in others.
        pull = np.where(toxic, np.exp(none) / np.maximum(-np.expm1(none), 1e-12), -1.0)
        each = s * pull[doc]
        up = np.concatenate((np.bincount(sign, weights=each[row], minlength=n_signs), [each.sum(), leak * pull.sum()])) / len(bags)
        up[:n_signs] -= DECAY * x[:n_signs]
        mean = 0.9 * mean + 0.1 * up
        square = 0.999 * square + 0.001 * up**2
        x = x + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return x[:n_signs], float(x[n_signs]), float(1.0 / (1.0 + np.exp(-x[-1])))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int, sample_chars: int) -> DataFrame:
    """(doc, text, toxic): about ``sample_docs`` labelled documents a class, one row an id."""
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("string").alias("doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.filter(F.col("doc").isNotNull() & F.col("toxic").isin(0, 1))
    texts = docs.select(F.col("doc_id").cast("string").alias("doc"), F.col("text").cast("string").alias("text")).filter(F.length("text").between(1, sample_chars))
    there = texts.select("doc").join(marks, "doc").distinct()
    sizes = {r["toxic"]: r["n"] for r in there.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    draw = F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) / 1e6
    share = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(min(1.0, sample_docs / n))) for k, n in sizes.items()], F.lit(0.0))
    picked = marks.filter(draw < share)
    # About SAMPLE_DOCS ids a class, so the labels come to the texts.
    return texts.join(F.broadcast(picked), "doc").groupBy("doc", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, most_signs: int = MOST_SIGNS) -> Model | None:
    """Fit on the labelled rows of ``docs`` (doc_id, text); None without toxic and clean ones or without any sign."""
    sample = cut(labelled_sample(docs, labels, sample_docs, sample_chars), "toxic-sample")
    counted = sample.select("toxic", "text").mapInPandas(_count, "code long, toxic_docs long, clean_docs long")
    by_gram = counted.groupBy("code").agg(F.sum("toxic_docs").alias("t"), F.sum("clean_docs").alias("c"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    rate = (F.col("t") / sizes[1]) / (F.col("t") / sizes[1] + F.col("c") / sizes[0])
    lift = (F.col("t") + 0.5) / sizes[1] / ((F.col("c") + 0.5) / sizes[0])
    best = by_gram.filter((F.col("t") >= LEAST_DOCS) & (lift >= LEAST_LIFT)).orderBy((F.col("t") * F.log(lift) * rate).desc(), "code").limit(most_signs)
    signs = np.sort(best.select("code").toArrow()["code"].to_numpy().view(np.uint64))  # MOST_SIGNS rows
    if not len(signs):
        return None
    held = docs.sparkSession.sparkContext.broadcast(Model(signs, np.zeros(len(signs)), 0.0, 0.0))

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blobs = []
            for text in batch["text"]:
                found, first = [], 0
                for raw, sentence, _, _ in pieces([text]):
                    found.append([x + y for x, y in zip(held.value.hits(raw, sentence), (first, 0))])
                    first += int(sentence[-1]) + 1
                blobs.append(squeeze(*(np.concatenate(x).astype(np.uint64) for x in zip(*found))))
            yield pd.DataFrame({"toxic": batch["toxic"], "blob": blobs})

    # The sample's signs alone come to the driver: about two bytes a sign.
    rows = sample.select("toxic", "text").mapInPandas(bags, "toxic int, blob binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["toxic"], r["blob"]))
    found = [unsqueeze(r["blob"]) for r in rows]
    weights, bias, leak = fit_bags([f[0] for f in found], [f[1] for f in found], np.array([r["toxic"] == 1 for r in rows]), len(signs))
    return Model(signs, weights, bias, leak)


_SENTENCE = T.StructType([T.StructField("begin", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.DoubleType())])
_ANSWER = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(_SENTENCE))])


def score_toxicity(docs: DataFrame, model: Model | None, limit: float = TOXIC_FROM) -> DataFrame:
    """``docs`` with score, predicted and offending: the sentences (first code point from 0, code points, score) in text order."""
    docs = docs.drop("score", "predicted", "offending")
    if model is None:
        none = F.array().cast(T.ArrayType(_SENTENCE))
        return docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), none.alias("offending"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_ANSWER)
    def answer(texts: pd.Series) -> pd.DataFrame:
        score, (owner, begin, length, own) = held.value.score(list(texts))
        offending: list[list[tuple]] = [[] for _ in score]
        for k in np.flatnonzero(own >= OFFENDING_FROM).tolist():
            offending[owner[k]].append((int(begin[k]), int(length[k]), float(own[k])))
        return pd.DataFrame({"score": score, "offending": offending})

    new = spare(docs, "toxicity")
    out = docs.withColumn(new, answer(F.col("text").cast("string")))
    return out.select(*docs.columns, F.col(f"{new}.score").alias("score"), (F.col(f"{new}.score") >= limit).cast("int").alias("predicted"), F.col(f"{new}.offending").alias("offending"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"), "offending")


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
