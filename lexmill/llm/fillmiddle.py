"""Fill-in-the-middle transformation by secondary-sort assembly.

A document is cut at two code points into prefix, middle and suffix, which a training text holds in another order behind
marks.  Tasks emit each output in pieces of UNIT code points keyed by document and output position.  The pieces are dealt
out by document and sorted within partitions (the DataFrame form of repartitionAndSortWithinPartitions), so that a task
streams a document's pieces in order and needs one piece at a time, however long the document.  Restoration reads the sorted
output alone: it finds the marks in the stream, emits the pieces of the text keyed by part and offset, and a second sort in
the same partitions puts them in the order of the text.  Digests are incremental on both ways.

The cuts and the form come from the SHA-256 of the seed, a colon and the document's id, so reruns agree.

Defined results: a null or empty text is plain and gives an empty output; a null doc_id is hashed as the text ``null``; a
text that holds a mark is plain, whatever its hash; documents are rows: repeated rows of one id and text give equal rows,
rows of one id with different texts are cut alike by their own lengths; doc_id may have any type that has an order and a
text form; columns besides doc_id and text are neither read nor returned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby, repeat

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import table

SEED = 1
#: Code points of a piece.
UNIT = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, those that stay plain and, of the others, those with the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Rows that a task hands on at a time, in code points.
FLUSH = 1 << 22
#: The order of the parts in the output and what stands before each.
LAYOUT = {
    "plain": (("text", ""),),
    "psm": (("prefix", PREFIX), ("suffix", SUFFIX), ("middle", MIDDLE)),
    "spm": (("suffix", SUFFIX), ("prefix", PREFIX), ("middle", MIDDLE)),
}
#: The order of the parts in the text.
PLACE = {"text": 0, "prefix": 0, "middle": 1, "suffix": 2}
#: Every piece carries its document's key and what is known of the document.
_KEY = "doc string, text_hash long, task int"
_HEAD = "n long, form string, prefix_chars long, middle_chars long, copies long"
_PIECES = f"{_KEY}, {_HEAD}, pos long, piece string"
_RESTORED = f"{_KEY}, {_HEAD}, part int, start long, piece string, output_sha256 string"
_DIGESTS = "doc string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_WIDTH = len(f"{_KEY}, {_HEAD}".split(", "))


def plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc, text, text_hash, n, form, prefix_chars, middle_chars) of every row; the last two are -1 in plain documents."""
    out = docs.select(F.col("doc_id").cast("string").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("n", F.char_length("text").cast("long"))
    out = out.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("doc", F.lit("null"))), 256))
    h = [F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    a, b = (x % (F.col("n") + 1) for x in h[:2])
    plain = (F.col("n") == 0) | (h[2] % 100 >= PLAIN_FROM)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(mark))
    out = out.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm"))
    whole = F.col("form") == "plain"
    return out.select(
        "doc", "text", F.xxhash64("text").alias("text_hash"), "n", "form",
        F.when(whole, -1).otherwise(F.least(a, b)).alias("prefix_chars"), F.when(whole, -1).otherwise(F.greatest(a, b) - F.least(a, b)).alias("middle_chars"),
    )


def split_text(text: str, form: str, prefix: int, middle: int, unit: int = UNIT) -> Iterator[str]:
    """The output of a text piece by piece; a mark stands at the head of its part's first piece."""
    spans = {"text": (0, len(text)), "prefix": (0, prefix), "middle": (prefix, prefix + middle), "suffix": (prefix + middle, len(text))}
    for part, mark in LAYOUT[form]:
        begin, end = spans[part]
        yield mark + text[begin : min(begin + unit, end)]
        for k in range(begin + unit, end, unit):
            yield text[k : min(k + unit, end)]


class Restorer:
    """Finds the parts of an output that comes piece by piece, wherever the pieces end: (part's place, offset in it, text)."""

    def __init__(self, form: str):
        self.coming = list(LAYOUT[form])
        self.part, self.offset, self.held = "text", 0, ""
        if form == "plain":
            self.coming.clear()

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple[int, int, str]]:
        rest = self.held + piece
        while self.coming and (at := rest.find(self.coming[0][1])) >= 0:
            yield from self._found(rest[:at])
            self.part, mark = self.coming.pop(0)
            self.offset, rest = 0, rest[at + len(mark) :]
        # The end of a piece may be the beginning of the next mark.
        keep = 0 if last or not self.coming else next((k for k in (2, 1) if rest.endswith(self.coming[0][1][:k])), 0)
        self.held = rest[len(rest) - keep :]
        yield from self._found(rest[: len(rest) - keep])

    def _found(self, text: str) -> Iterator[tuple[int, int, str]]:
        if text:
            yield PLACE[self.part], self.offset, text
            self.offset += len(text)


def _frames(rows: Iterator[tuple], schema: str, text: int) -> Iterator[pd.DataFrame]:
    """Rows as frames of about FLUSH code points of the text in column ``text``."""
    names, held, size = [c.split()[0] for c in schema.split(", ")], [], 0
    for row in rows:
        held.append(row)
        size += len(row[text] or "") + 64
        if size >= FLUSH:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from batch.itertuples(index=False, name=None)


def output_pieces(docs: DataFrame, seed: int = SEED, unit: int = UNIT) -> DataFrame:
    """The outputs of all documents in pieces, dealt out by document and sorted by output position.

    Equal rows of a batch are counted instead of repeated, and those of different tasks are dealt out apart, so a row that
    fills a third of the table costs each task a few pieces.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()

        def rows(batch: pd.DataFrame) -> Iterator[tuple]:
            batch["copies"] = batch.groupby(["doc", "text_hash"], dropna=False, sort=False)["n"].transform("size")
            for doc, text, text_hash, n, form, prefix, middle, copies in batch.drop_duplicates(["doc", "text_hash"]).itertuples(index=False, name=None):
                pos = 0
                for piece in split_text(text, form, prefix, middle, unit):
                    yield doc, text_hash, task, n, form, prefix, middle, copies, pos, piece
                    pos += len(piece)

        for batch in batches:
            yield from _frames(rows(batch), _PIECES, -1)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plan(docs, seed).mapInPandas(split, _PIECES).repartition(n, "doc", "text_hash", "task").sortWithinPartitions("doc", "text_hash", "task", "pos")


def _of_documents(rows: Iterator[tuple]) -> Iterator[tuple[tuple, Iterator[tuple[int, str]]]]:
    """(key and head, pieces as (copies, text)) of each document; equal rows of other batches give a piece without text."""
    for key, group in groupby(rows, key=lambda r: r[:3]):
        first = next(group)

        def pieces(group=chain([first], group)) -> Iterator[tuple[int, str | None]]:
            at = -1
            for *_, copies, pos, piece in group:
                yield (copies if pos == 0 else 0), (piece if pos > at else None)
                at = pos

        yield first[: _WIDTH - 1], pieces()


def restored_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces of the texts, from sorted output pieces and their form alone, sorted by document, part and offset.

    A row of part -1 comes first in each document and has output_sha256 and the number of its equal rows.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for head, own in _of_documents(_rows(batches)):
            digest, restorer, copies = hashlib.sha256(), Restorer(head[4]), 0
            for more, piece in own:
                copies += more
                if piece is not None:
                    digest.update(piece.encode())
                    for found in restorer.feed(piece):
                        yield *head, 0, *found, None
            for found in restorer.feed("", last=True):
                yield *head, 0, *found, None
            yield *head, copies, -1, 0, None, digest.hexdigest()

    return pieces.mapInPandas(lambda batches: _frames(rows(batches), _RESTORED, -2), _RESTORED).sortWithinPartitions("doc", "text_hash", "task", "part", "start")


def restored_digests(restored: DataFrame) -> DataFrame:
    """(doc, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): a row a document, equal rows repeated."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for _, group in groupby(_rows(batches), key=lambda r: r[:3]):
            doc, _, _, n, form, prefix, middle, copies, *_, output = next(group)
            digest = hashlib.sha256()
            for r in group:
                digest.update(r[-2].encode())
            yield from repeat((doc, n, form, prefix, middle, output, digest.hexdigest()), copies)

    return restored.mapInPandas(lambda batches: _frames(rows(batches), _DIGESTS, -1), _DIGESTS)


def fim_texts(docs: DataFrame, seed: int = SEED, unit: int = UNIT) -> DataFrame:
    """(doc_id, form, n, prefix_chars, middle_chars, output): the training texts, whole again, a row a document."""
    schema = "doc string, n long, form string, prefix_chars long, middle_chars long, output string"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for (doc, _, _, *head), own in _of_documents(_rows(batches)):
            parts = list(own)
            yield from repeat((doc, *head, "".join(p for _, p in parts if p is not None)), sum(n for n, _ in parts))

    return _typed(output_pieces(docs, seed, unit).mapInPandas(lambda batches: _frames(rows(batches), schema, -1), schema), docs)


def _typed(out: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id in its own type, and null cuts of plain documents."""
    cuts = {c: F.when(F.col(c) >= 0, F.col(c)) for c in ("prefix_chars", "middle_chars")}
    return out.withColumns(cuts).select(F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *out.columns[1:])


def fill_in_middle(docs: DataFrame, seed: int = SEED, unit: int = UNIT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    return _typed(restored_digests(restored_pieces(output_pieces(docs, seed, unit))), docs)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"))


def fim_sql(documents: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM {documents}),
 k AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
        CASE WHEN n = 0 OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= {PLAIN_FROM} OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') THEN 'plain'
             WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM d),
 p AS (SELECT *, substr(text, 1, least(a, b)) AS pre, substr(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS mid, substr(text, greatest(a, b) + 1) AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
                        ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op13_fill_in_middle": fim_sql()}
