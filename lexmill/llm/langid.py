"""Language identification with interpolated Kneser-Ney character models.

Training counts character 4-grams per language in Spark, on a hash sample of the labelled documents (about
``SAMPLE_DOCS`` a language, a documented bound); a fifth of the sample and about ``CALIBRATION_DOCS`` other documents a
language calibrate rejection.  A language with fewer than ``LEAST_ASIDE`` documents keeps them all for counting and takes the
widest limit of the others.  If no text set aside tells a limit, as when all languages are that small, each fifth of the sample
is judged by a model of the other four; where that tells none either, as with one document, nothing but texts without letters
is rejected.  The model keeps, for each order, the 64-bit hashes of all grams in one sorted array with a log probability per
language beside each, so one lookup serves every language.  A gram that no language saw falls back to the next order by the weight of
its context.  A document gets the language of lowest cross-entropy per character; it is rejected if that lies above the
limit calibrated for the language and the text's length.

Letters are lower-cased; everything between letters counts as one space, combining marks included, so scripts that write
vowels as marks are told by their consonants.

Defined results: a null text or one without letters is ``und`` with score 0 and is rejected; without any labelled row
nothing can be learned and every document is ``und``; repeated rows get equal answers; an empty table gives an empty
result.  Texts are read whole, in pieces of a million characters that repeat the context before them.  Letters above U+FFFF
count as one letter.  The score is the language's share of exp(-n * cross-entropy), with n the events but 50 at most, so
that long texts do not all get 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import spare, table
from lexmill.llm.hasharray import HashArray

ORDER = 4
SAMPLE_DOCS = 600
PIECE = 1 << 20
#: Rejection: a quantile of the cross-entropy of rightly predicted calibration texts of one length band plus a slack in
#: nats.  Fewer than ``ENOUGH`` texts do not tell the quantile: a band takes that of its language and more for short texts,
#: a language its highest and the wide slack.
CALIBRATION_DOCS = 2400
LEAST_ASIDE = 20
FOLDS = 5
QUANTILE = 0.995
ENOUGH = 200
BANDS = (64, 256, 1024)
SLACK = 0.05
WIDE_SLACK = 0.6
SHORT_SLACK = 6.0
SPACE_CODE = 32


@cache
def _letters() -> np.ndarray:
    """Every code point to its lower-case letter in 16 bits, and to a space if it is no letter."""
    codes = np.full(0x110000, SPACE_CODE, dtype=np.uint64)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            codes[cp] = low if low < 0x10000 else 0xFFFF
    return codes


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram code at each kept character, first index of each text, number of letters of each text)."""
    lengths = np.array([len(t) for t in texts])
    raw = _letters()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    owner = np.repeat(np.arange(len(texts)), lengths)
    blank = raw == SPACE_CODE
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    letters = np.bincount(owner[~blank], minlength=len(texts))
    chars, owner = raw[keep], owner[keep]
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    at = np.arange(len(chars)) - starts[owner]
    code = chars.copy()
    for back in range(1, ORDER):
        before = np.full(len(chars), np.uint64(SPACE_CODE))
        before[back:] = chars[:-back]
        before[at < back] = SPACE_CODE
        code |= before << np.uint64(16 * back)
    return code, starts, letters


def _context_start(text: str, at: int) -> int:
    """Where the kept characters begin that give the gram at ``at`` its context."""
    back = 2 * ORDER
    while at > back and len(gram_codes([text[at - back : at]])[0]) < ORDER:
        back *= 2
    return max(0, at - back)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str], list[str]]]:
    """Groups of about PIECE characters: the text that each part belongs to, and the context before it, which the part repeats."""
    owners, parts, before, size = [], [], [], 0
    for i, t in enumerate(texts):
        for k in range(0, len(t or ""), PIECE):
            part = t[k : k + PIECE]
            if size + len(part) > PIECE and parts:
                yield owners, parts, before
                owners, parts, before, size = [], [], [], 0
            context = t[_context_start(t, k) : k]
            owners.append(i)
            parts.append(context + part)
            before.append(context)
            size += len(part)
    if parts:
        yield owners, parts, before


def _grams(parts: list[str], before: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first of each part, letters, whether a code is the part's own) of parts with repeated context."""
    code, starts, letters = gram_codes(parts)
    own = np.ones(len(code), dtype=bool)
    for k in np.flatnonzero([len(x) > 0 for x in before]).tolist():
        repeated, _, more = gram_codes([before[k]])
        own[starts[k] : starts[k] + len(repeated)] = False
        letters[k] -= more[0]
    return code, starts, letters, own


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, group in batch.groupby("lang"):
            for _, parts, before in _pieces(list(group["text"])):
                code, _, _, own = _grams(parts, before)
                code, n = np.unique(code[own].view(np.int64), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": code, "n": n.astype(np.int64)})


class _Counts:
    """Kneser-Ney counts of one order in one language: grams and contexts as sorted codes."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.code, self.n = code, n.astype(float)
        ctx, first = np.unique(code >> np.uint64(16), return_index=True)
        self.ctx, self.total = ctx, np.add.reduceat(self.n, first)
        kinds = np.diff(np.append(first, len(code)))
        ones, twos = max((n == 1).sum(), 1), (n == 2).sum()
        self.discount = ones / (ones + 2.0 * twos)
        self.gamma = self.discount * kinds / self.total

    @staticmethod
    def find(keys: np.ndarray, values: np.ndarray, want: np.ndarray, default: float) -> np.ndarray:
        i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[i] == want, values[i], default)


def _suffix(code: np.ndarray, order: int) -> np.ndarray:
    return code & np.uint64((1 << (16 * order)) - 1)


def _orders(code: np.ndarray, n: np.ndarray) -> dict[int, _Counts]:
    """Counts at the highest order, numbers of different left neighbours below it."""
    order = np.argsort(code)
    out = {ORDER: _Counts(code[order], n[order])}
    for k in range(ORDER - 1, 0, -1):
        kinds, left = np.unique(_suffix(out[k + 1].code, k), return_counts=True)
        out[k] = _Counts(kinds, left)
    return out


def _probability(counts: dict[int, _Counts], code: np.ndarray, order: int, base: float) -> np.ndarray:
    if order == 0:
        return np.full(len(code), base)
    c = counts[order]
    ctx = code >> np.uint64(16)
    total = c.find(c.ctx, c.total, ctx, 0.0)
    own = np.maximum(c.find(c.code, c.n, code, 0.0) - c.discount, 0.0) / np.maximum(total, 1.0)
    lower = _probability(counts, _suffix(code, order - 1), order - 1, base)
    return own + np.where(total > 0, c.find(c.ctx, c.gamma, ctx, 1.0), 1.0) * lower


class LanguageModel:
    """Per-language log probabilities of character grams; see the module's description."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        counts = {lang: _orders(*grams[lang]) for lang in langs}
        base = 1.0 / (len(np.unique(np.concatenate([c[1].code for c in counts.values()]))) + 1)
        self.base = float(np.log(base))
        self.grams, self.weights = {}, {}
        for k in range(ORDER, 0, -1):
            seen = np.unique(np.concatenate([c[k].code for c in counts.values()]))
            self.grams[k] = HashArray(seen, np.log(np.stack([_probability(counts[x], seen, k, base) for x in langs], axis=1)))
            ctx = np.unique(np.concatenate([c[k].ctx for c in counts.values()]))
            self.weights[k] = HashArray(ctx, np.log(np.stack([c[k].find(c[k].ctx, c[k].gamma, ctx, 1.0) for c in (counts[x] for x in langs)], axis=1)))
        self.limits = np.full((len(langs), len(BANDS) + 1), np.inf)
        self.short = np.ones((len(langs), len(BANDS) + 1)) * SHORT_SLACK

    def _log_probabilities(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full((len(code), len(self.langs)), self.base, dtype=np.float32)
        table = self.grams[order]
        row = table.find(code)
        out = table.values[row]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            ctx = self.weights[order].find(code[miss] >> np.uint64(16))
            weight = np.where((ctx >= 0)[:, None], self.weights[order].values[ctx], np.float32(0))
            out[miss] = weight + self._log_probabilities(_suffix(code[miss], order - 1), order - 1)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per language, events, letters) of each text."""
        total = np.zeros((len(texts), len(self.langs)))
        events, letters = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for owners, parts, before in _pieces(texts):
            code, starts, letters_, own = _grams(parts, before)
            sums = np.add.reduceat(self._log_probabilities(code).astype(np.float64) * own[:, None], starts[:-1], axis=0)
            np.add.at(total, owners, sums)
            np.add.at(events, owners, np.add.reduceat(own.astype(np.int64), starts[:-1]))
            np.add.at(letters, owners, letters_)
        return -total / np.maximum(events, 1)[:, None], events, letters

    def calibrate(self, best: np.ndarray, events: np.ndarray, least: np.ndarray) -> None:
        """Set the limits from texts that were rightly predicted as ``best``."""
        band = np.searchsorted(BANDS, events, side="right")
        for k in range(len(self.langs)):
            own = least[best == k]
            if not len(own):
                continue
            self.limits[k] = np.quantile(own, QUANTILE) + SLACK if len(own) >= ENOUGH else own.max() + WIDE_SLACK
            for j in range(len(BANDS) + 1):
                own = least[(best == k) & (band == j)]
                if len(own) >= ENOUGH:
                    self.limits[k, j], self.short[k, j] = np.quantile(own, QUANTILE) + SLACK, 0.0
        self.limits[np.isinf(self.limits)] = np.max(self.limits[np.isfinite(self.limits)], initial=0.0) or np.inf

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        h, events, letters = self.entropies(texts)
        best = h.argmin(axis=1)
        least = h[np.arange(len(h)), best]
        score = 1.0 / np.exp(-np.minimum(events, 50.0)[:, None] * (h - least[:, None])).sum(axis=1)
        known = letters > 0
        band = np.searchsorted(BANDS, events, side="right")
        limit = self.limits[best, band] + self.short[best, band] / np.sqrt(np.maximum(events, 1))
        names = np.array(self.langs, dtype=object)[best]
        return pd.DataFrame({
            "lang_pred": np.where(known, names, "und"),
            "score": np.where(known, score, 0.0),
            "cross_entropy": np.where(known, least, 0.0),
            "accepted": known & (least <= limit),
        })


_ANSWER = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def _learn(rows: DataFrame) -> LanguageModel | None:
    """The model of the texts of ``rows`` (lang, text), without limits yet."""
    counted = rows.select("lang", "text").mapInPandas(_count, "lang string, code long, n long")
    found = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    grams = {k: (g["code"].to_numpy().view(np.uint64), g["n"].to_numpy()) for k, g in found.groupby("lang")}
    return LanguageModel(sorted(grams), grams) if grams else None


def _rightly(model: LanguageModel, rows: DataFrame) -> pd.DataFrame:
    """(lang, events, least cross-entropy) of the texts of ``rows`` (lang, text) whose language ``model`` tells."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h, events, _ = held.value.entropies(list(batch["text"]))
            best = h.argmin(axis=1)
            right = np.array(held.value.langs, dtype=object)[best] == batch["lang"].to_numpy()
            yield pd.DataFrame({"lang": batch["lang"].to_numpy(), "events": events, "least": h[np.arange(len(h)), best]})[right]

    return rows.select("lang", "text").mapInPandas(score, "lang string, events double, least double").toArrow().to_pandas()


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModel | None:
    """Fit on a hash sample of (doc_id, text, lang); about ``sample_docs`` documents a language, a fifth for calibration beside others."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_docs / n))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    sample = rows.filter(draw < share).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(FOLDS)))
    sample = sample.withColumn("aside", (F.col("fold") == 0) & F.col("lang").isin([k for k, n in sizes.items() if n >= LEAST_ASIDE]))
    model = _learn(sample.filter(~F.col("aside")))
    if model is None:
        return None

    # About CALIBRATION_DOCS rows of a name and two numbers a language come to the driver.
    other = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (sample_docs + CALIBRATION_DOCS) / n))])[F.col("lang")]
    aside = rows.filter((draw >= share) & (draw < other)).select("lang", "text").unionByName(sample.filter("aside").select("lang", "text"))
    found = _rightly(model, aside)
    if not len(found):
        rests = ((k, _learn(sample.filter(F.col("fold") != k))) for k in range(FOLDS))
        found = pd.concat([found, *(_rightly(rest, sample.filter(F.col("fold") == k)) for k, rest in rests if rest is not None)])
    best = np.searchsorted(model.langs, found["lang"].to_numpy(dtype=object))
    model.calibrate(best, found["events"].to_numpy(), found["least"].to_numpy())
    return model


def _answers(docs: DataFrame, model: LanguageModel | None) -> Column:
    """The struct of lang_pred, score, cross_entropy and accepted of each text."""
    if model is None:
        none = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(0.0), "accepted": F.lit(False)}
        return F.struct(*[v.alias(k) for k, v in none.items()])
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_ANSWER)
    def answer(text: pd.Series) -> pd.DataFrame:
        return held.value.predict([None if t is None else t for t in text])

    return answer(F.col("text").cast("string"))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with the columns lang_pred, score, cross_entropy and accepted, which replace columns of these names."""
    docs = docs.drop(*[f.name for f in _ANSWER])
    own = spare(docs, "answer")
    return docs.withColumn(own, _answers(docs, model)).select(*docs.columns, f"{own}.*")


def filter_languages(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The accepted documents, with the columns they came with."""
    labelled = docs if labelled is None else labelled
    model = train(labelled.filter(~held_out(F.col("doc_id"))))
    own = spare(docs, "answer")
    return docs.withColumn(own, _answers(docs, model)).filter(F.col(f"{own}.accepted")).select(*docs.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs.filter(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
