"""Exact quantiles per group without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.store import written

BINS = 1024
#: Rows of a bin from which it is split again.
SPLIT = 1 << 20


def _refined(rows: DataFrame, wanted: DataFrame, split: int) -> DataFrame:
    """(g, name, at, rank, before, lo, hi): the range that holds each wanted rank and the number of values under it.

    Every round counts BINS equal parts of the ranges that hold more than ``split`` values, so a value far off the others
    costs a round and leaves no bin with a whole group.
    """
    while True:
        open_ = wanted.filter((F.col("c") > split) & (F.col("hi") > F.col("lo"))).select("g", "lo", "hi").distinct()
        if open_.isEmpty():
            return wanted
        width = (F.col("hi") / BINS) - (F.col("lo") / BINS)
        part = F.least(F.greatest(F.floor((F.col("v") - F.col("lo")) / width), F.lit(0)), F.lit(BINS - 1))
        inside = rows.join(open_, "g").filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        bins = inside.groupBy("g", "lo", "hi", F.when(width > 0, part).otherwise(F.when(F.col("v") > F.col("lo"), 1).otherwise(0)).alias("bin"))
        bins = bins.agg(F.count("*").alias("n"), F.min("v").alias("from"), F.max("v").alias("to"))
        upto = F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy("bin"))  # at most BINS rows
        bins = bins.withColumn("under", upto - F.col("n"))
        found = wanted.join(bins, ["g", "lo", "hi"]).filter((F.col("rank") - F.col("before") >= F.col("under")) & (F.col("rank") - F.col("before") < F.col("under") + F.col("n")))
        found = found.select("g", "name", "at", "rank", (F.col("before") + F.col("under")).alias("before"), F.col("from").alias("lo"), F.col("to").alias("hi"), F.col("n").alias("c"))
        rest = wanted.join(open_, ["g", "lo", "hi"], "left_anti").select(*found.columns)
        wanted = written(found.unionByName(rest), "ranges")


def exact_quantiles(df: DataFrame, group: str, value: str, quantiles: dict[str, float], split: int = SPLIT) -> DataFrame:
    """(group, one column per quantile), interpolated between neighbours.

    Ranges of values that hold the wanted ranks are narrowed until each has one value or at most ``split`` rows; only their
    values are counted, one row a distinct value, and ranked range by range.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null")
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(q)).alias("q")) for k, q in quantiles.items()]))
    ranges = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("c"))
    wanted = ranges.select("g", "lo", "hi", "c", asked.alias("a")).select("g", "lo", "hi", "c", "a.name", ((F.col("c") - 1) * F.col("a.q")).alias("at"))
    wanted = wanted.select("g", "name", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"), F.lit(0).cast("long").alias("before"), "lo", "hi", "c")
    places = _refined(rows, written(wanted, "ranks"), split)
    spans = places.select("g", "lo", "hi").distinct()
    counts = rows.join(spans, "g").filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).groupBy("g", "lo", "hi", "v").agg(F.count("*").alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy("v")))
    held = places.join(counts, ["g", "lo", "hi"]).filter((F.col("rank") - F.col("before") < F.col("upto")) & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("n")))
    ends = held.groupBy("g", "name", "at").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    out = ends.withColumn("value", F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    return out.groupBy(F.col("g").alias(group)).agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in quantiles])
