"""Corpus operators: chunking, tokens, hashed embeddings, page elements and element content."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHILD_WORDS = 64
CHILD_STRIDE = 48
EMBED_DIM = 64


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def parents(docs: DataFrame) -> DataFrame:
    """(document_id, parent_id, content): the non-blank lines of every document."""
    lines = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "content"))
    return lines.filter(F.trim("content") != "").select("document_id", F.concat_ws("-", "document_id", "line_no").alias("parent_id"), "content")


def children(parents_df: DataFrame, size: int = CHILD_WORDS, stride: int = CHILD_STRIDE) -> DataFrame:
    """(document_id, parent_id, chunk_id, content): windows of ``size`` words every ``stride`` words."""
    split = parents_df.withColumn("ws", F.filter(F.split("content", " "), lambda w: w != "")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - size + stride), F.lit(stride))
    split = split.select("document_id", "parent_id", "ws", F.posexplode(starts).alias("n", "at"))
    return split.select("document_id", "parent_id", F.concat_ws("-", "parent_id", "n").alias("chunk_id"), F.array_join(F.slice("ws", F.col("at"), F.lit(size)), " ").alias("content"))


def windows(content: str, size: int = CHILD_WORDS, stride: int = CHILD_STRIDE) -> Iterator[str]:
    """The windows of ``children`` as a plain chunker."""
    ws = [w for w in content.split(" ") if w]
    for at in range(0, max(1, len(ws) - size + stride) if ws else 0, stride):
        yield " ".join(ws[at : at + size])


def chunk_with(parents_df: DataFrame, chunker: Callable[[str], Iterable[str]]) -> DataFrame:
    """(document_id, parent_id, chunk_id, content) by any chunker, as a table function over the parents of each document.

    A document's parents come to one call of the function in the order of their ids, row by row, so a chunker is a Python
    function of one parent's text; ``children`` is the native form of windows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in parents_df.schema}

    class Chunks:
        def eval(self, row):
            for n, content in enumerate(chunker(row["content"] or "")):
                yield row["document_id"], row["parent_id"], f"{row['parent_id']}-{n}", content

    made = F.udtf(Chunks, returnType=f"document_id {kinds['document_id']}, parent_id {kinds['parent_id']}, chunk_id string, content string")
    return made(parents_df.select("document_id", "parent_id", "content").asTable().partitionBy("document_id").orderBy("parent_id"))


def line_page(parent_id: Column) -> Column:
    """A line's number from 1 on, which stands for its page."""
    return (F.split_part(parent_id, F.lit("-"), F.lit(2)).cast("int") + 1).cast("int")


def line_modality(content: Column) -> Column:
    """table for lines of cells, image for image marks, else empty."""
    return F.when(content.like("%|%|%"), "table").when(content.like("%[image]%"), "image").otherwise("")


def load_corpus(children_df: DataFrame, parents_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children and parents of the documents that have both; the others are skipped."""
    return children_df.join(parents_df, "document_id", "left_semi"), parents_df.join(children_df, "document_id", "left_semi")


def hash_embed(texts: DataFrame, id_col: str, text_col: str, dim: int = EMBED_DIM) -> DataFrame:
    """(id, dim, value): token counts hashed to ``dim`` places, scaled to unit length; places without a token are left out."""
    place = (F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    counts = texts.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("token")).groupBy("id", place.alias("dim")).agg(F.count("*").alias("n"))
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return counts.join(norms, "id").select("id", "dim", (F.col("n") / F.col("norm")).alias("value"))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _embedded(ts: pa.Array, dim: pa.Array) -> pa.Array:
    """Token counts hashed to places, a word of a batch hashed once."""
    d, words = dim[0].as_py() if len(dim) else 1, ts.flatten().dictionary_encode()
    lens = ts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    place = np.fromiter((int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % d for w in words.dictionary.to_pylist()), dtype=np.int64, count=len(words.dictionary))
    cell = np.repeat(np.arange(len(ts)), lens) * d + place[words.indices.to_numpy(zero_copy_only=False)]
    n = np.bincount(cell, minlength=len(ts) * d).astype(float).reshape(-1, d)
    unit = n / np.maximum(np.sqrt((n * n).sum(axis=1)), 1.0)[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(ts) * d + 1, d), pa.int32()), pa.array(unit.ravel()))


def embed_rows(texts: DataFrame, id_col: str, text_col: str, dim: int = EMBED_DIM) -> DataFrame:
    """(id, embedding): the same vectors as ``hash_embed`` with all places, each made within its row; ``text_col`` may hold tokens."""
    ts = F.col(text_col) if dict(texts.dtypes)[text_col].startswith("array") else tokens(F.col(text_col))
    return texts.select(F.col(id_col).alias("id"), _embedded(ts, F.lit(dim)).alias("embedding"))


#: Element type of each tag that is read from a page (fixed values).
PAGE_TAGS = {"title": "title", "h1": "heading", "p": "text", "li": "list_item", "a": "link", "td": "table", "img": "image"}


def page_elements(pages: DataFrame) -> DataFrame:
    """(page_id, element_id, parent_id, element_type, position, content) of every page: elements by tag, scripts and styles stripped.

    Elements are numbered by type.  An image has its alternative text as content.  The page is the parent of title and
    heading, and the heading, or else the page, of all others.  Text is what stands up to the first closing tag of a name.
    """
    clean = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    whole = {t: rf"(?is)<{t}(?: [^>]*)?>(.*?)</{t}>" for t in PAGE_TAGS} | {"img": r"(?is)<img(?: [^>]*)?>"}
    found = [F.struct(F.lit(kind).alias("element_type"), F.regexp_extract_all(clean, F.lit(whole[tag]), F.lit(0 if tag == "img" else 1)).alias("found")) for tag, kind in PAGE_TAGS.items()]
    rows = pages.select("page_id", F.explode(F.array(*found)).alias("e"), clean.rlike(r"(?is)<h1(?: [^>]*)?>.*?</h1>").alias("headed"))
    rows = rows.select("page_id", "headed", "e.element_type", F.posexplode("e.found").alias("position", "raw"))
    of = lambda *parts: F.concat_ws("-", F.col("page_id"), *parts)
    text = F.when(F.col("element_type") == "image", F.regexp_extract("raw", r'(?is)\salt="([^"]*)"', 1)).otherwise(F.regexp_replace("raw", r"(?s)<[^>]*>", " "))
    parent = F.when(~F.col("element_type").isin("title", "heading") & F.col("headed"), of(F.lit("heading-0"))).otherwise(F.col("page_id").cast("string"))
    return rows.select("page_id", of("element_type", "position").alias("element_id"), parent.alias("parent_id"), "element_type", "position", F.trim(text).alias("content"))


def element_type(modality: Column) -> Column:
    """text, table and graph keep their names, picture is an image, anything else is other."""
    names = F.create_map(*[F.lit(x) for kv in {"text": "text", "table": "table", "picture": "image", "graph": "graph"}.items() for x in kv])
    return F.coalesce(F.try_element_at(names, modality), F.lit("other"))


def element_content(content: Column, description: Column) -> Column:
    """Content, a blank line and the picture's description; either alone; null if both are missing."""
    return F.nullif(F.concat_ws("\n\n", F.nullif(content, F.lit("")), F.nullif(description, F.lit(""))), F.lit(""))
