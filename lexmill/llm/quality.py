"""Quality rules: one table of thresholds compiled into a single Spark projection.

Every measure is a native expression over the text, so the whole operator is one narrow projection: no shuffle, no
Python, no state beyond one row.  A document is kept when the base test passes and every rule holds.

Defined results: a null or empty text has no words, fails the base test and is not kept; repeated rows are judged row by
row; columns of the input other than the id, the text and a named language are ignored; an empty table gives an empty
result.  A text of any length is one row's work in one task: time follows its length, with a sort of its windows where
some repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import SPACE, let, table, words

#: Frequent function words by language (fixed values).
STOP_WORDS_BY_LANG = {
    "en": "the of and to in a is that it for on was with as be at by are this have or from but not he she they you we his her".split(),
    "fr": "de la le les et des un une du en que qui est pas dans pour sur au avec ne se ce il elle par plus son ou où mais".split(),
    "de": "der die und das den dem ist zu ein eine von mit sich auf für im nicht es auch werden wird sie er wie aus bei nach".split(),
    "es": "el los las y del por con para no su lo al como más pero sus sin sobre este ya entre cuando muy".split(),
}
STOP_WORDS = [w for words_ in STOP_WORDS_BY_LANG.values() for w in words_]

BASE_MIN_WORDS = 20
BASE_MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie between ``low`` and ``high``; a missing bound is open."""

    measure: str
    low: float | None = None
    high: float | None = None


RULES: tuple[Rule, ...] = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", high=0.10),
    Rule("shout_ratio", high=0.30),
    Rule("stop_ratio", low=0.04),
    Rule("same_word_ratio", high=0.20),
    Rule("dup_line_ratio", high=0.50),
    Rule("bullet_line_ratio", high=0.90),
    Rule("ellipsis_line_ratio", high=0.30),
)


def _repeat_words(tokens: Column, window: int) -> Column:
    """Words inside windows of ``window`` words that occur at least twice in the text, counted once each.

    Windows are compared by 64-bit hash.  Texts without a repeated window, the usual case, stop after one distinct
    count; the others sort (hash, position) pairs of this one row and measure the union of the repeated windows.
    """

    def spans(pairs: Column) -> Column:
        same = lambda x, j: (F.get(pairs, j - 1)["h"] == x["h"]) | (F.get(pairs, j + 1)["h"] == x["h"])
        hits = F.transform(F.filter(pairs, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"])
        return let(
            F.sort_array(hits),
            lambda at: F.aggregate(
                F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - p, F.lit(window)))),
                F.lit(0).cast("long"),
                lambda total, n: total + n.cast("long"),
            ),
        )

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, spans))

    keys = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (window - 1)), lambda i: F.xxhash64(F.slice(ws, i, window)))
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) > window, let(hashed, lambda hs: let(keys(hs), covered))).otherwise(F.lit(0).cast("long"))


def _stop_test(stop_words: dict[str, list[str]], lang: Column | None) -> Callable[[Column], Column]:
    """Whether a word is a stop word: of the row's language, or without ``lang`` of any.  A language without a list, as one
    that is written without spaces, cannot fail by it, so all its words count."""
    if lang is None:
        return lambda w: F.lower(w).isin([x for words_ in stop_words.values() for x in words_])
    tests = [(lang == name, list_) for name, list_ in stop_words.items()]
    return lambda w: F.coalesce(*[F.when(own, F.lower(w).isin(list_)) for own, list_ in tests], F.lit(True))


def _measures(text: Column, is_stop: Callable[[Column], Column]) -> Column:
    """All counts of one text as a struct."""

    def of_lines(lines: Column) -> list[Column]:
        return [
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_word_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(rf"^[{SPACE}]*[-*•]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(rf"(\.\.\.|…)[{SPACE}]*$"))).cast("long").alias("n_ellipsis_lines"),
        ]

    def of_words(ws: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
        return let(
            lines,
            lambda ls: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                F.length(F.regexp_replace(text, r"[^!]+", "")).cast("long").alias("n_shouts"),
                F.size(F.filter(ws, is_stop)).cast("long").alias("n_stop_words"),
                F.size(F.filter(ws, lambda w, i: F.coalesce(w == F.get(ws, i - 1), F.lit(False)))).cast("long").alias("n_same_words"),
                _repeat_words(ws, REPEAT_WINDOW).alias("n_repeat_words"),
                *of_lines(ls),
            ),
        )

    return let(words(text), of_words)


def compile_rules(rules: tuple[Rule, ...], measures: dict[str, Column]) -> Column:
    """The conjunction of all thresholds as one boolean column."""
    verdict = F.lit(True)
    for rule in rules:
        value = measures[rule.measure]
        if rule.low is not None:
            verdict = verdict & (value >= F.lit(rule.low))
        if rule.high is not None:
            verdict = verdict & (value <= F.lit(rule.high))
    return verdict


def quality_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
    stop_words: dict[str, list[str]] = STOP_WORDS_BY_LANG, lang_col: str | None = None,
) -> DataFrame:
    """Measure and judge every document; returns id, counts, ``base_failed`` and ``kept``."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    lang = (F.lit(None) if lang_col is None else F.col(lang_col)).cast("string")
    m = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), lang.alias("_lang"))
    m = m.select("doc_id", _measures(text, _stop_test(stop_words, None if lang_col is None else F.col("_lang"))).alias("m"))
    per_word = lambda c: F.col(f"m.{c}") / F.greatest(F.col("m.n_words"), F.lit(1))
    per_line = lambda c: F.col(f"m.{c}") / F.greatest(F.col("m.n_word_lines"), F.lit(1))
    base_failed = (F.col("m.n_words") < BASE_MIN_WORDS) | (100 * F.col("m.n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("m.n_words"))
    ratios = {
        "mean_word_chars": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "shout_ratio": per_word("n_shouts"),
        "stop_ratio": per_word("n_stop_words"),
        "same_word_ratio": per_word("n_same_words"),
        "dup_line_ratio": per_line("n_dup_lines"),
        "bullet_line_ratio": per_line("n_bullet_lines"),
        "ellipsis_line_ratio": per_line("n_ellipsis_lines"),
    }
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return m.select(
        "doc_id",
        *[F.col(f"m.{c}").alias(c) for c in counts],
        base_failed.alias("base_failed"),
        (~base_failed & compile_rules(rules, ratios)).alias("kept"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    clauses = []
    for r in RULES:
        clauses += [f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None)
    w = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{w}') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
           FROM documents),
 g AS (SELECT doc_id, i, list_aggregate(ws[i:i+7], 'string_agg', ' ') AS g
       FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
 r AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
       FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
 rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words FROM r GROUP BY doc_id),
 m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
              length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
              (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
              coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
              length(regexp_replace(t, '[^!]+', '', 'g')) AS n_shouts,
              len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop,
              len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i-1])) AS n_same, greatest(len(ls), 1) AS nl,
              len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet,
              len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
       FROM w LEFT JOIN rep USING (doc_id)),
 q AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio,
              n_shouts / greatest(n_words, 1) AS shout_ratio, n_stop / greatest(n_words, 1) AS stop_ratio,
              n_same / greatest(n_words, 1) AS same_word_ratio, n_dup_lines / nl AS dup_line_ratio, n_bullet / nl AS bullet_line_ratio, n_ellipsis / nl AS ellipsis_line_ratio,
              (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed
       FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {' AND '.join(clauses)}) AS kept
FROM q"""


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": _sql()}
