"""Nearest neighbours by cosine: exact search that skips blocks by their distance bounds, and a stored, quantised index.

Exact: each vector belongs to the nearest of about sqrt(n) pivots, drawn by hash.  A block holds vectors of one pivot, many
of them split evenly, and its radius, the largest angle to the pivot.  The cosine of (angle to the pivot - radius) bounds
what a query can find in it; blocks are searched in order of that bound until none can reach the k-th best.

Approximate: two levels of cells, fitted on a sample that grows with the number of cells, and codes of a byte for every
SUBSPACE places (product quantisation).  A search compares codes in the cells nearest to the query, and re-ranks the best of
each block of vectors by their exact vectors.  The number of cells to visit is measured once when the index is built.  Inserts and deletes are
layers of a keyed table; vectors are indexed without fitting anything again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.pruning import in_waves
from lexmill.operators.retrieval import ranked
from lexmill.sources.store import KeyedTable, written

#: Vectors of a block, and queries that meet a block in one task.
BLOCK = 4096
QUERIES = 4096
#: Vectors that are compared with all cells at a time, queries of a block of a search by codes, and such blocks whose best rows a task holds.
ROWS, ASKED, HELD = 1024, 1024, 64
#: Sampled vectors a cell and at least, those that codebooks are fitted on, places a code byte, and rounds of fitting.
PER_CELL, LEAST_SAMPLE, CODED_SAMPLE, SUBSPACE, ROUNDS = 16, 4096, 16384, 2, 10
#: Candidates re-ranked for each asked neighbour; queries that the visits are measured on, and the recall aimed at there.
EXPAND, TRIALS, RECALL = 8, 64, 0.97


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _stack(column: pd.Series) -> np.ndarray:
    return _unit(np.stack(column.to_numpy()).astype(np.float64))


def _parts(x) -> Iterator:
    """ROWS rows at a time, since each of them is compared with every cell."""
    return (x[at : at + ROWS] for at in range(0, len(x), ROWS))


def _rows(df: DataFrame) -> np.ndarray:
    """The vectors of a bounded table, unit length."""
    found = df.select("embedding").toArrow()["embedding"].to_pylist()
    return _unit(np.array(found, dtype=np.float64)) if found else np.zeros((0, 1))


_NEAREST = T.StructType([T.StructField("cell", T.LongType()), T.StructField("angle", T.DoubleType())])


def _nearest(centers) -> object:
    @F.pandas_udf(_NEAREST)
    def nearest(embedding: pd.Series) -> pd.DataFrame:
        if not len(embedding):
            return pd.DataFrame({"cell": [], "angle": []})
        found = [(s.argmax(axis=1), s.max(axis=1)) for s in (x @ centers.value.T for x in _parts(_stack(embedding)))]
        cell, sim = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"cell": cell, "angle": np.arccos(np.clip(sim, -1.0, 1.0))})

    return nearest


# -- exact


def pivot_blocks(vectors: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """((cell, part, id, embedding), (cell, part, radius), pivots) of (id, embedding)."""
    n = vectors.count()
    pivots = _rows(vectors.orderBy(F.xxhash64("id"), "id").limit(max(1, int(n**0.5))))  # about sqrt(n) vectors
    held = vectors.sparkSession.sparkContext.broadcast(pivots)
    placed = written(vectors.withColumn("near", _nearest(held)("embedding")).select("id", "embedding", "near.cell", "near.angle"), "pivot-cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    parted = written(placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts"), "pivot-blocks")
    return parted.drop("angle"), parted.groupBy("cell", "part").agg(F.max("angle").alias("radius")), pivots


def _block_best(k: int):
    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(block) and len(asked):
            score, ids = np.round(_stack(asked["q"]) @ _stack(block["embedding"]).T, 6), block["id"].to_numpy()
            for query, row in zip(asked["query_id"], score):
                # one more than asked for, since a vector is no answer to itself; ties stay
                best = np.flatnonzero(row >= (np.partition(row, -k - 1)[-k - 1] if len(row) > k + 1 else -np.inf))
                best = best[ids[best] != query]
                found.append(pd.DataFrame({"query_id": query, "chunk_id": ids[best], "sim": row[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": asked["query_id"][:0], "chunk_id": block["id"][:0], "sim": np.zeros(0)})

    return run


def exact_search(queries: DataFrame, vectors: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, chunk_id, sim, dense_rank), (query_id, blocks, visited)) of (id, embedding) tables; see the module's text."""
    kind = vectors.schema["id"].dataType.simpleString()
    blocks, radii, pivots = pivot_blocks(vectors)
    held = vectors.sparkSession.sparkContext.broadcast(pivots)
    asked = written(queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), "asked-vectors")

    def angles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in _parts(whole)):
            angle = np.arccos(np.clip(_stack(batch["q"]) @ held.value.T, -1.0, 1.0))
            yield pd.DataFrame({"query_id": np.repeat(batch["query_id"].to_numpy(), angle.shape[1]), "cell": np.tile(np.arange(angle.shape[1]), len(batch)), "angle": angle.ravel()})

    # A zero vector has angle pi/2 to all and a similarity of 0, which the bound allows for.
    away = asked.mapInPandas(angles, f"query_id {kind}, cell long, angle double")
    bounds = away.join(radii, "cell").select("query_id", "cell", "part", (F.cos(F.greatest(F.col("angle") - F.col("radius"), F.lit(0.0))) + 1e-9).alias("bound"))
    salts = -(-asked.count() // QUERIES) or 1

    def search(pairs: DataFrame) -> DataFrame:
        need = pairs.join(asked, "query_id").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)))
        keys, names = ["cell", "part", "salt"], ["in_cell", "in_part", "in_salt"]
        again = [F.col(k).alias(n) for k, n in zip(keys, names)]  # both sides come from ``need``
        there = blocks.join(need.select(*keys).distinct(), ["cell", "part"])
        return there.groupBy(*keys).cogroup(need.select(*again, "query_id", "q").groupBy(*names)).applyInPandas(_block_best(top_k), f"query_id {kind}, chunk_id {kind}, sim double")

    hits, visits = in_waves(bounds, ["cell", "part"], search, "sim", top_k)
    return ranked(hits, "sim", "dense_rank", top_k), visits


# -- approximate


def lloyd(x: np.ndarray, k: int, seed: int = 7, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``k`` centres of a bounded sample."""
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        own = (x @ centers.T - 0.5 * (centers**2).sum(axis=1)).argmax(axis=1)
        n = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return centers


class Quantiser:
    """Cell centres, and codebooks of what vectors differ from theirs; ``probes`` is the number of cells that a search visits."""

    def __init__(self, cells: np.ndarray, books: list[np.ndarray], probes: int = 1):
        self.cells, self.books, self.probes = cells, books, probes
        self.edges = np.cumsum([0] + [b.shape[1] for b in books])

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest cell and what is left of it there."""
        cell = (x @ self.cells.T).argmax(axis=1)
        return cell, x - self.cells[cell]

    def encode(self, rest: np.ndarray) -> np.ndarray:
        parts = [rest[:, a:b] for a, b in zip(self.edges, self.edges[1:])]
        return np.stack([(p @ b.T - 0.5 * (b**2).sum(axis=1)).argmax(axis=1) for p, b in zip(parts, self.books)], axis=1).astype(np.uint8)

    def approximate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Similarity of each query to each coded vector of a cell."""
        out = np.repeat(q @ self.cells[cell], len(codes)).reshape(len(q), -1)
        for j, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            out += (q[:, a:b] @ self.books[j].T)[:, codes[:, j]]
        return out


def fit_quantiser(vectors: DataFrame) -> Quantiser:
    """About sqrt(n) cells under the square root of their number of coarse ones; PER_CELL sampled vectors a cell."""
    n = vectors.count()
    cells = max(4, int(n**0.5))
    share = min(1.0, max(LEAST_SAMPLE, PER_CELL * cells) / max(n, 1))
    sample = written(vectors.filter(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000)) < share * 1e6).select("id", F.col("embedding").cast("array<double>").alias("embedding")), "fit-sample")
    features = sample.select(array_to_vector("embedding").alias("features"))
    coarse = _unit(np.array(KMeans(k=max(2, int(cells**0.5)), seed=7, maxIter=ROUNDS).fit(features).clusterCenters()))
    held = vectors.sparkSession.sparkContext.broadcast(coarse)
    each = -(-cells // len(coarse))

    def fine(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"center": list(_unit(lloyd(_stack(rows["embedding"]), each)))})

    by_coarse = sample.select("embedding", _nearest(held)("embedding")["cell"].alias("coarse")).groupBy("coarse")
    centers = np.array(by_coarse.applyInPandas(fine, "center array<double>").toArrow()["center"].to_pylist())  # a row a cell
    centers = centers[np.lexsort(centers.T[::-1])]
    placed = vectors.sparkSession.sparkContext.broadcast(Quantiser(centers, []))

    def rests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rest = placed.value.place(_stack(rows["embedding"]))[1]
            for j, at in enumerate(range(0, rest.shape[1], SUBSPACE)):
                yield pd.DataFrame({"book": j, "part": list(rest[:, at : at + SUBSPACE])})

    coded = sample.orderBy(F.xxhash64("id")).limit(CODED_SAMPLE).select("embedding").mapInPandas(rests, "book int, part array<double>")

    def book(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"book": rows["book"].iloc[:1], "centers": [lloyd(np.stack(rows["part"].to_numpy()), 256).tolist()]})

    books = sorted(coded.groupBy("book").applyInPandas(book, "book int, centers array<array<double>>").toArrow().to_pylist(), key=lambda r: r["book"])
    return Quantiser(centers, [np.array(b["centers"]) for b in books])


class VectorIndex:
    """A stored index of (id, embedding) under ``path``; see the module's text."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "long", buckets: int = 16):
        self.spark, self.path, self.kind = spark, path, kind
        self.table = KeyedTable(spark, f"{path}/vectors", "id", buckets, order=("cell",))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, top_k: int = 10, probes: int | None = None) -> VectorIndex:
        index = cls(vectors.sparkSession, path, vectors.schema["id"].dataType.simpleString())
        index.model = fit_quantiser(vectors)
        index.insert(vectors)
        index.model.probes = probes or index._measured(vectors, top_k)
        m = index.model
        text = json.dumps({"probes": m.probes, "cells": m.cells.tolist(), "books": [b.tolist() for b in m.books]})
        index.spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str, kind: str = "long") -> VectorIndex:
        index = cls(spark, path, kind)
        held = json.loads(spark.read.parquet(f"{path}/model").first()["model"])
        index.model = Quantiser(np.array(held["cells"]), [np.array(b) for b in held["books"]], held["probes"])
        return index

    def insert(self, vectors: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Index the vectors; those whose id is in the index are replaced."""
        held = self.spark.sparkContext.broadcast(self.model)
        kind = vectors.schema["embedding"].dataType.simpleString()

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in (part for batch in batches for part in _parts(batch)):
                cell, rest = held.value.place(_stack(rows["embedding"]))
                yield pd.DataFrame({"id": rows["id"], "embedding": rows["embedding"], "cell": cell, "code": [c.tobytes() for c in held.value.encode(rest)]})

        self.table.write(vectors.select("id", "embedding").mapInPandas(place, f"id {self.kind}, embedding {kind}, cell long, code binary"), batch=batch)

    def delete(self, ids: DataFrame, batch: tuple[str, int] | None = None) -> None:
        rows = self.table.read().limit(0)
        self.table.write(rows, ids.select("id"), batch)

    def _measured(self, vectors: DataFrame, top_k: int) -> int:
        """The fewest cells at which TRIALS queries of least hash would meet RECALL of their neighbours; once, when building."""
        trials = vectors.orderBy(F.xxhash64("id", F.lit("trial")), "id").limit(TRIALS)
        true = exact_search(trials, vectors, top_k)[0].select("query_id", F.col("chunk_id").alias("id"))
        cell = self.table.read().select("id", "cell")
        places = true.join(cell, "id").join(trials.select(F.col("id").alias("query_id"), "embedding"), "query_id").select("embedding", "cell").toArrow()  # TRIALS * top_k rows
        if not places.num_rows:
            return len(self.model.cells)
        sim = _unit(np.array(places["embedding"].to_pylist(), dtype=float)) @ self.model.cells.T
        own = sim[np.arange(len(sim)), places["cell"].to_numpy()]
        return int(np.quantile((sim > own[:, None]).sum(axis=1) + 1, RECALL, method="higher"))

    def search(self, queries: DataFrame, top_k: int, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
        """((query_id, chunk_id, sim, dense_rank), (query_id, vectors, visited)) of (id, embedding); no exact search is made.

        Vectors are packed with their codes into blocks of at most BLOCK, queries into blocks of ASKED, and every pair of
        blocks meets once.  Of each block the vectors with the best codes in the cells of a query are re-ranked where they
        are; a task passes on only the best of all its blocks, so what moves grows with queries times tasks.
        """
        model, kind = self.model, self.kind
        held, wide, probes = self.spark.sparkContext.broadcast(model), EXPAND * top_k, probes or model.probes
        floats = "<f4" if "float" in dict(self.table.read().dtypes)["embedding"] else "<f8"

        def near_cells(q: np.ndarray) -> np.ndarray:
            """Whether a query visits a cell."""
            seen = np.zeros((len(q), len(held.value.cells)), dtype=bool)
            np.put_along_axis(seen, np.argsort(-(q @ held.value.cells.T), axis=1, kind="stable")[:, :probes], True, axis=1)
            return seen

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch = batch.sort_values("cell", kind="stable")
                for at in range(0, len(batch), BLOCK):
                    rows = batch.iloc[at : at + BLOCK]
                    yield pd.DataFrame({"ids": [rows["id"].to_numpy()], "cells": [rows["cell"].to_numpy(np.int64).tobytes()], "codes": [b"".join(rows["code"])], "matrix": [np.stack(rows["embedding"].to_numpy()).astype(floats).tobytes()]})

        def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), ASKED):
                    rows = batch.iloc[at : at + ASKED]
                    yield pd.DataFrame({"q_ids": [rows["id"].to_numpy()], "q": [_stack(rows["embedding"]).tobytes()]})

        def best_of(q: np.ndarray, seen: np.ndarray, q_ids: np.ndarray, row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(query, id, sim) of a block's best vectors."""
            ids, cells = np.asarray(row.ids), np.frombuffer(row.cells, dtype=np.int64)
            codes = np.frombuffer(row.codes, dtype=np.uint8).reshape(len(ids), -1)
            close = np.full((len(q), len(ids)), -np.inf, dtype=np.float32)
            edges = np.flatnonzero(np.diff(cells, prepend=-1, append=-1))
            for low, upto in zip(edges, edges[1:]):
                own = np.flatnonzero(seen[:, cells[low]])
                if len(own):
                    close[own, low:upto] = held.value.approximate(q[own], int(cells[low]), codes[low:upto])
            close[q_ids[:, None] == ids] = -np.inf  # a vector is no answer to itself
            if len(ids) > wide:
                close[close < np.partition(close, -wide, axis=1)[:, -wide, None]] = -np.inf  # ties stay
            query, at = np.nonzero(close > -np.inf)
            v, sim = _unit(np.frombuffer(row.matrix, dtype=floats).reshape(len(ids), -1).astype(np.float64)), np.zeros(len(query))
            for low in range(0, len(query), 16 * ROWS):
                part = slice(low, low + 16 * ROWS)
                sim[part] = np.einsum("ij,ij->i", q[query[part]], v[at[part]])
            return query, ids[at], np.round(sim, 6)

        def top(query: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.lexsort((ids, -sim, query))
            query = query[order]
            kept = np.arange(len(query)) - np.searchsorted(query, query) < top_k
            return query[kept], ids[order][kept], sim[order][kept]

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[bytes, tuple] = {}
            last, seen = b"", np.zeros((0, 0), dtype=bool)  # one block's cells at a time

            def out() -> Iterator[pd.DataFrame]:
                for q_ids, _, (query, ids, sim) in best.values():
                    yield pd.DataFrame({"query_id": q_ids[query], "id": ids, "sim": sim})
                best.clear()

            for batch in batches:
                for row in batch.itertuples():
                    key = hashlib.md5(row.q + repr(row.q_ids[0]).encode()).digest()
                    if key not in best:
                        if len(best) == HELD:
                            yield from out()
                        q_ids = np.asarray(row.q_ids)
                        q = np.frombuffer(row.q).reshape(len(q_ids), -1)
                        best[key] = (q_ids, q, (np.zeros(0, np.int64), q_ids[:0], np.zeros(0)))
                    q_ids, q, before = best[key]
                    if key != last:
                        last, seen = key, near_cells(q)
                    found = best_of(q, seen, q_ids, row)
                    best[key] = (q_ids, q, top(*(np.concatenate(x) for x in zip(before, found))))
            yield from out()

        rows = self.table.read()
        blocks = rows.select("id", "cell", "code", "embedding").mapInPandas(packed, f"ids array<{kind}>, cells binary, codes binary, matrix binary")
        pairs = queries.select("id", "embedding").mapInPandas(asked, f"q_ids array<{kind}>, q binary").join(blocks)  # a stated query set against all rows, in blocks
        exact = pairs.mapInPandas(near, f"query_id {kind}, id {kind}, sim double").withColumnRenamed("id", "chunk_id")

        sizes = np.zeros(len(model.cells))
        for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row a cell
            sizes[r["cell"]] = r["n"]

        def visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    part = batch.iloc[at : at + ROWS]
                    yield pd.DataFrame({"query_id": part["id"], "vectors": int(sizes.sum()), "visited": (near_cells(_stack(part["embedding"])) @ sizes).astype(np.int64)})

        visits = queries.select("id", "embedding").mapInPandas(visited, f"query_id {kind}, vectors long, visited long")
        return ranked(exact, "sim", "dense_rank", top_k), visits
