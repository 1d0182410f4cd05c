"""Batch model steps: texts to vectors, and texts to texts with skips, equal inputs sent once and errors as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.sources.store import written

BATCH = 32


def model_step(df: DataFrame, id_col: str, text_col: str, factory: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int, batch: int = BATCH) -> DataFrame:
    """(id, embedding): texts go through a model in batches.  ``factory`` makes the model once per task; a vector of
    another length than ``dim`` stops the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in batches:
            for at in range(0, len(part), batch):
                rows = part.iloc[at : at + batch]
                vectors = model(rows["text"].fillna("").tolist())
                if any(len(v) != dim for v in vectors):
                    raise ValueError(f"the model returned a vector that has not {dim} places")
                yield pd.DataFrame({"id": rows["id"], "embedding": vectors})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, embedding array<double>")


def text_step(df: DataFrame, text_col: str, factory: Callable[[], Callable[[list[str]], list[str]]], skip: Column | None = None, batch: int = BATCH) -> DataFrame:
    """``df`` with answer, error and skipped: texts go through a model in batches, such as enrichment or answering.

    Equal texts are sent once and share the answer.  Rows for which ``skip`` holds, and null texts, are not sent.  If a batch
    fails its texts are sent one by one; one that fails alone, or gets no text back, has the error instead of an answer.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()

        def one(text: str) -> tuple[str | None, str | None]:
            try:
                (answer,) = model([text])
                return (answer, None) if isinstance(answer, str) else (None, "the model returned no text")
            except Exception as e:  # a failed row is a row
                return None, f"{type(e).__name__}: {e}"[:500]

        for part in batches:
            for at in range(0, len(part), batch):
                rows = part.iloc[at : at + batch]
                texts = rows["text"].tolist()
                try:
                    answers = list(model(texts))
                    good = len(answers) == len(texts) and all(isinstance(a, str) for a in answers)
                except Exception:  # told row by row
                    good = False
                pairs = [(a, None) for a in answers] if good else [one(t) for t in texts]
                yield pd.DataFrame({"key": rows["key"], "answer": [a for a, _ in pairs], "error": [e for _, e in pairs]})

    skipped = F.col(text_col).isNull() | (F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False))
    marked = df.withColumn("skipped", skipped).withColumn("_key", F.when(~F.col("skipped"), F.sha2(F.encode(text_col, "UTF-8"), 256)))
    asked = marked.filter("not skipped").groupBy(F.col("_key").alias("key")).agg(F.first(text_col).alias("text"))
    answers = written(asked.mapInPandas(run, "key string, answer string, error string"), "answers")
    return marked.join(answers, F.col("_key") == F.col("key"), "left").select(*df.columns, "answer", "error", "skipped")
