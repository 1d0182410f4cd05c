"""Mixing sources to target weights with hash-threshold histograms.

Each document gets a stable hash.  Word totals are summed by source and hash bucket; nested budget thresholds over these
histograms say up to which hash a source is taken.  Only the bucket that holds the threshold is refined, level by level,
until the threshold hash itself is known; then one filter assigns every document its copies.  Nothing is sorted beyond
the histogram rows, whose number is bounded by sources times buckets.  The windows that order sources take one row a source
in one task, so sources are to be thousands, not millions.

The document at the threshold is taken in part, so each source meets its target to within a word.

Defined results: a null text has size 0 and is never taken; the null source is a source of its own, last in order;
repeated rows count as separate documents and share the same hash, so a threshold that falls on them is shared in
proportion to size; an empty table gives an empty result; a text of any length is counted whole.  mix_sources ignores
extra columns; take_mix passes them through and replaces size, source_size, target and taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, cut, spare, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
#: Hash digits taken at each level: 15 hexadecimal digits in all, 4,096 buckets a level.
LEVELS = ((1, 3), (4, 3), (7, 3), (10, 3), (13, 3))
HASH_DIGITS = 15


def hash_key(doc_id: Column) -> Column:
    """Fifteen hexadecimal digits whose text order is their numeric order."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, HASH_DIGITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_REPEAT) -> DataFrame:
    """One row per source: size, weight and capped target.

    The targets are least(most * size, level * weight) where the level makes them add up to share * all sizes.  Sources
    fill up in the order of most * size / weight, so running sums over that order give the level directly.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(picks, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    per = per.withColumn("cap", cap).withColumn("fills_at", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    below = Window.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    room = total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    per = per.withColumn("level", room / open_weight)
    # The level is that of the first source, in filling order, which it leaves unfilled.
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(everything)["level"]
    return per.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "target")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _measured(docs: DataFrame) -> DataFrame:
    """(size, _key, source) of every document."""
    return docs.select(_size().alias("size"), hash_key(F.col("doc_id")).alias("_key"), "source")


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _thresholds(sized: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    """One row per source (src): source_size, target, whole copies, and the hash prefix and budget at its threshold."""
    targets = source_targets(sized, weights, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long")
    plan = targets.withColumn("copies", whole).withColumn("budget", budget).withColumn("prefix", F.lit(""))
    state = cut(plan.withColumnRenamed("source", "src"), "mix-plan")
    for start, width in LEVELS:
        # Nested thresholds: the histogram of the boundary bucket alone, split by the next hash digits.
        inside = sized.filter(F.col("size") > 0).join(state.select("src", "prefix", "budget"), _same("source", "src") & F.col("_key").startswith(F.col("prefix")))
        hist = inside.groupBy("src", F.substring("_key", 1, start + width - 1).alias("bucket")).agg(F.sum("size").alias("n"), F.first("budget").alias("b"))
        upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        edge = hist.filter((F.col("before") <= F.col("b")) & (F.col("b") < F.col("before") + F.col("n")))
        edge = edge.select(F.col("src").alias("s"), F.col("bucket").alias("next_prefix"), (F.col("b") - F.col("before")).alias("left"), F.col("n").alias("edge_size"))
        state = state.drop("edge_size").join(edge, _same("src", "s"), "left").select(
            "src", "source_size", "target", "copies", F.coalesce("next_prefix", F.lit("g")).alias("prefix"), F.coalesce("left", "budget").alias("budget"), "edge_size"
        )
        state = cut(state, "mix-level")
    return state


def _taken(docs: DataFrame, state: DataFrame) -> DataFrame:
    """``docs`` (with size) and source_size, target and taken."""
    key, plan = spare(docs, "key"), spare(docs, "plan")
    state = state.select(F.struct(*state.columns).alias(plan))
    of = lambda c: F.col(f"{plan}.{c}")
    extra = (
        F.when(F.col(key) < of("prefix"), F.col("size"))
        .when(F.col(key) == of("prefix"), F.floor(of("budget") * F.col("size") / F.greatest(of("edge_size"), F.lit(1))))
        .otherwise(0)
    )
    taken = F.least((of("copies") * F.col("size") + extra).cast("long"), F.lit(MAX_REPEAT) * F.col("size"))
    out = docs.withColumn(key, hash_key(F.col("doc_id"))).join(state, F.col("source").eqNullSafe(of("src")))
    return out.withColumn("taken", taken).select(*docs.columns, of("source_size").alias("source_size"), of("target").alias("target"), "taken")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Decide how many words of each document the mix takes; one row of sizes and counts per document."""
    sized = cut(docs.select("doc_id", "source", _size().alias("size")), "mix-sizes")
    return _taken(sized, _thresholds(sized.withColumn("_key", hash_key(F.col("doc_id"))), weights, share))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The documents that the mix takes, whole rows with size, source_size, target and taken."""
    docs = docs.drop("size", "source_size", "target", "taken")
    sized = cut(_measured(docs), "mix-sizes")
    return _taken(docs.withColumn("size", _size()), _thresholds(sized, weights, share)).filter("taken > 0")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


def mix_sql(documents: str = "documents") -> str:
    """The same mix over a DuckDB relation: thresholds from running sums over the hash order."""
    return r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS key FROM """ + documents + r"""),
 p AS (SELECT source, sum(size)::BIGINT AS source_size,
              [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
 c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS fills_at FROM p),
 l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
       FROM c WINDOW b AS (ORDER BY fills_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT source, source_size, least(cap, coalesce((min(CASE WHEN level <= fills_at THEN {'f': fills_at, 'l': level} END) OVER ()).l * weight, cap))::DOUBLE AS target FROM l),
 s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
 b AS (SELECT *, round(target - copies * source_size)::BIGINT AS budget FROM s),
 k AS (SELECT source, key, sum(size)::BIGINT AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY key)::BIGINT AS upto FROM d GROUP BY source, key)
SELECT d.doc_id, d.size, b.source_size, b.target,
       least(2 * d.size, (b.copies * d.size + CASE WHEN k.upto <= b.budget THEN d.size WHEN k.upto - k.n < b.budget
             THEN ((b.budget - (k.upto - k.n)) * d.size) // greatest(k.n, 1) ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.key = d.key"""


QUERIES = {"op7_mix_sources": op7_mix_sources}
ORACLES = {"op7_mix_sources": mix_sql()}
