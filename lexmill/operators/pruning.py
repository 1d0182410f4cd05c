"""Top-k over blocks in two waves: the most promising blocks first, then those that may still reach the k-th best score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.store import written

#: Blocks of each query in the first wave, and what rounding may add to a score.
FIRST = 4
ROUNDING = 1e-6


def in_waves(bounds: DataFrame, block: list[str], search: Callable[[DataFrame], DataFrame], score: str, top_k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(hits, visits) of (query_id, *block, bound), where no row of a block scores above its bound.

    ``search`` gives for (query_id, *block) at least the ``top_k`` best rows of each pair, ties with the last included.  The
    second wave leaves out blocks whose bound lies below the k-th score of the first, so nothing is lost.  ``visits`` is
    (query_id, blocks, visited).
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), *block)
    bounds = written(bounds.withColumn("wave", F.when(F.row_number().over(order) <= first, 1).otherwise(2)), "bounds")
    best = written(search(bounds.filter("wave = 1").select("query_id", *block)), "first-wave")
    kth = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score)))).filter(F.col("n") == top_k).select("query_id", F.col(score).alias("kth"))
    rest = bounds.filter("wave = 2").join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - ROUNDING))
    rest = written(rest.select("query_id", *block), "second-wave")
    visited = bounds.filter("wave = 1").select("query_id").unionByName(rest.select("query_id")).groupBy("query_id").agg(F.count("*").alias("visited"))
    return best.unionByName(search(rest)), bounds.groupBy("query_id").agg(F.count("*").alias("blocks")).join(visited, "query_id")
