"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Short test items hide inside long documents, so set similarity is useless and containment of the item in the document is
what counts.  A document that holds 0.75 of an item's m shingles misses m / 4 of them at most, so of any m / 4 + 1 shingles
it holds one: an item's sketch is that many of its least hashes, and no pair can be lost.  Items are partitioned by size, in
powers of two; a document is compared only with partitions whose items it is large enough to hold, and its hashes are looked
up if they lie under the highest hash of any of these partitions' sketches.  Hashes that very many items share come last in
the order, so that boilerplate of a benchmark makes no candidates unless an item has little else.  Candidates are verified on
their real shingles, which a document's row makes once.

Everything is a built-in expression.  The items' sketches are written out first, so Spark knows their size and chooses a
broadcast only when they are small; a large benchmark is joined by shuffling hashes.

Defined results: a null or empty text has no shingles and matches nothing; fewer than five words count as one shingle of
the whole sequence; rows of one id with different texts are judged apart, documents and items alike, and equal results
stand once, so repeated rows of a document or item give one pair; empty tables give no pairs; extra columns are ignored by
the search and kept by the filter.  Rows without a document id cannot be named and are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut, let, lower_ascii, table, words

SHINGLE = 5
CONTAINMENT = 0.75
#: Items from which a hash counts as boilerplate.
COMMON = 64


def _hash(shingle: Column) -> Column:
    """A 62-bit hash of a slice of words."""
    return F.shiftrightunsigned(F.xxhash64(shingle), 2)


def _shingled(ws: Column, make) -> Column:
    """``make`` of each run of five words, or of the whole sequence if it is shorter."""
    runs = F.transform(F.sequence(F.lit(1), F.size(ws) - (SHINGLE - 1)), lambda i: make(F.slice(ws, i, SHINGLE)))
    return F.when(F.size(ws) >= SHINGLE, runs).when(F.size(ws) > 0, F.array(make(ws)))


def _least_size(level: Column, containment: float) -> Column:
    """The fewest shingles of a document that holds enough of an item of this size partition."""
    return F.ceil(F.lit(containment) * F.pow(F.lit(2.0), level) - 1e-9).cast("long")


def _sketches(items: DataFrame, containment: float) -> DataFrame:
    """(h, item_id, own, level): so many hashes of every item that a document with ``containment`` of it has one of them."""
    hashed = items.select("item_id", "own", let(words(lower_ascii(F.col("text"))), lambda ws: F.array_distinct(_shingled(ws, _hash))).alias("hs"))
    per = hashed.filter(F.size("hs") > 0).select("item_id", "own", F.size("hs").alias("m"), F.explode("hs").alias("h"))
    shared = per.groupBy("h").agg(F.count("*").alias("df")).filter(F.col("df") >= COMMON).select("h", F.lit(True).alias("common"))
    per = per.join(shared, "h", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    order = Window.partitionBy("item_id", "own").orderBy("common", "h")
    need = F.col("m") - F.ceil(F.lit(containment) * F.col("m") - 1e-9) + 1
    sketch = per.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= need)
    return sketch.select("h", "item_id", "own", F.floor(F.log2(F.col("m").cast("double"))).cast("int").alias("level"))


def find_leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs (doc_id, item_id) whose item has at least ``containment`` of its shingles in the document."""
    text = F.col("text").cast("string")
    docs = docs.select("doc_id", text.alias("text"))
    # A text is known by a digest beside its id.
    items = items.select("item_id", text.alias("text"), F.md5(text).alias("own")).distinct()
    sketches = cut(_sketches(items, containment), "item-sketches")
    levels = sketches.groupBy("level").agg(F.max("h").alias("top")).orderBy("level").collect()  # a row a size partition, 32 at most
    hashes = let(words(lower_ascii(F.col("text"))), lambda ws: _shingled(ws, _hash))
    # The highest hash of the partitions whose items a document of ``n`` shingles can hold.
    top = lambda n: F.greatest(F.lit(-1), *[F.when(n >= _least_size(F.lit(r["level"]), containment), F.lit(r["top"])).otherwise(-1) for r in levels]) if levels else F.lit(-1)
    low = let(hashes, lambda hs: let(F.struct(top(F.size(hs)).alias("top"), F.size(hs).alias("n")), lambda t: F.transform(F.filter(hs, lambda h: h <= t["top"]), lambda h: F.struct(h.alias("h"), t["n"].alias("n")))))
    asked = docs.select("doc_id", F.explode(low).alias("s")).select("doc_id", "s.h", "s.n")
    pairs = asked.join(sketches.select("h", "item_id", "own", _least_size(F.col("level"), containment).alias("least")), "h").filter(F.col("n") >= F.col("least"))
    pairs = cut(pairs.select("doc_id", "item_id", "own").distinct(), "leak-candidates")

    text_shingles = let(words(lower_ascii(F.col("text"))), lambda ws: F.array_distinct(_shingled(ws, lambda s: F.array_join(s, " "))))
    wanted = items.join(pairs.select("item_id", "own").distinct(), ["item_id", "own"], "left_semi").select("item_id", "own", text_shingles.alias("item_shingles"))
    asked = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", text_shingles.alias("doc_shingles"))
    found = asked.join(pairs, "doc_id").join(wanted, ["item_id", "own"])
    shared = F.size(F.array_intersect("item_shingles", "doc_shingles"))
    found = found.select("doc_id", "item_id", F.size("item_shingles").cast("long").alias("n_item_shingles"), shared.cast("long").alias("n_shared"))
    found = found.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))
    return found.filter(F.col("containment") >= containment).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    leaks = cut(find_leaks(docs, items, containment).select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def leaks_sql(documents: str = "documents") -> str:
    """Every shared shingle of every pair of texts, counted."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def shingles(key: str, src: str) -> str:
        return rf"""SELECT DISTINCT {key}, {key}_text, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
              FROM (SELECT {key}, md5(text) AS {key}_text, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS ws FROM {src})"""

    return f"""
WITH ds AS ({shingles('doc_id', documents)}), bs AS ({shingles('item_id', 'benchmark')}),
 n AS (SELECT item_id, item_id_text, count(*) AS n_item_shingles FROM bs GROUP BY item_id, item_id_text),
 p AS (SELECT doc_id, item_id, item_id_text, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, doc_id_text, item_id, item_id_text)
SELECT DISTINCT doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles AS containment
FROM p JOIN n USING (item_id, item_id_text) WHERE n_shared / n_item_shingles >= 0.75"""


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES = {"op1_decontamination": leaks_sql()}
