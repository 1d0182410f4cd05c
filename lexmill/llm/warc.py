"""WARC archives: writing with revisits and segments, and reading with segment reassembly.

Writing puts each page's HTTP response, chunked transfer framing included, into one record, or into a first segment and
continuation records where it is long.  Of records with equal payloads the one with the largest id is the response and
the others revisit it.  Only digests are grouped; pages shuffle only if the table of repeated digests is too large to
broadcast by Spark's own size check.

Reading parses every archive by its content lengths.  Continuation records are grouped by origin identifier, ordered by
segment number and joined; the numbers must run from 1 without a gap and the length must equal the declared total, or the
record is marked incomplete.  Records that are not segmented never shuffle.  Then HTTP headers are split off, chunked
framing is decoded and the payload digested.

Archives are plain text writes of UTF-8 records, gzip-compressed by Spark's writer; reading accepts both forms and any
bytes.  Ids of any type that has an order and a text form are archived as text, percent-encoded, and read back in the type
asked for.  Defined results: a null html is an empty payload; a null id or url leaves its header out and reads back as null;
repeated rows are records of their own, and all rows with the largest id of equal payloads are responses; an empty
table gives an empty archive; extra columns are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import cut, hot_rows, scratch_path, table

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Records in one archive file at most.
FILE_RECORDS = 20_000
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that end between characters."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in _pieces(payload, size)) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes | None:
    """The payload of a chunked body, or None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(body):
            return None
        if size == 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            return None
        at += 2


def _record(kind: str, name: str, headers: list[tuple[str, object]], block: bytes) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers if v is not None]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines) + block.decode() + "\r\n\r"  # the text writer adds the last line feed


def _write_records(segment_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, count = TaskContext.get().partitionId(), 0

        def name() -> str:
            nonlocal count
            count += 1
            return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{task}/{count}')}>"

        for batch in batches:
            out = []
            for page_id, url, page, digest, keeper in zip(batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["keeper"]):
                payload = page.encode()
                url = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
                shared = [("WARC-Target-URI", url), ("X-Page-ID", None if page_id is None else quote(page_id, safe="")), ("WARC-Payload-Digest", f"sha1:{digest}")]
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if keeper is not None and keeper != page_id:
                    block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
                    more = [("WARC-Profile", _PROFILE), ("X-Refers-To-Page-ID", quote(keeper, safe="")), ("Content-Type", "application/http;msgtype=response")]
                    out.append(_record("revisit", name(), shared + more, block))
                    continue
                block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
                parts, origin = list(_pieces(block, segment_bytes)), name()
                shared.append(("Content-Type", "application/http;msgtype=response"))
                if len(parts) == 1:
                    out.append(_record("response", origin, shared, block))
                    continue
                out.append(_record("response", origin, [*shared, ("WARC-Segment-Number", 1)], parts[0]))
                for k, part in enumerate(parts[1:], 2):
                    total = len(block) if k == len(parts) else None
                    out.append(_record("continuation", name(), [("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part))
            yield pd.DataFrame({"value": out})

    return run


@F.pandas_udf(T.StringType())
def _digest(page: pd.Series) -> pd.Series:
    return pd.Series([payload_digest(p.encode()) for p in page])


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, min_bytes: int = 0) -> None:
    """Archive (page_id, url, html); equal payloads of at least ``min_bytes`` are stored once."""
    page = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), page.alias("html"))
    rows = rows.withColumn("digest", _digest("html"))
    names = rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    names = cut(names.filter("n > 1"), "warc-repeats")
    # Payloads of very many pages, a bounded number, are met where the pages are; these then join as if each were alone.
    least = hot_rows(rows)
    hot = names.filter(F.col("n") >= least).select("digest", F.col("keeper").alias("hot"))
    cold = names.filter(F.col("n") < least).select(F.col("digest").alias("match"), F.col("keeper").alias("cold"))
    alone = F.when(F.col("hot").isNotNull(), F.concat(F.lit("page "), F.xxhash64("page_id", "url"))).otherwise(F.col("digest"))
    named = rows.join(F.broadcast(hot), "digest", "left").withColumn("own", alone).join(cold, F.col("own") == F.col("match"), "left")
    ids = (F.col("page_id").cast("string").alias("page_id"), F.coalesce("hot", "cold").cast("string").alias("keeper"))
    records = named.select("url", "html", "digest", *ids).mapInPandas(_write_records(segment_bytes), "value string")
    records.write.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of one archive; parsing stops at bytes that are no record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers.get("content-length", "0"))
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


_HEADERS = "record_id string, kind string, origin string, segment long, total long, page_id long, url string, refers_to long, declared string"
#: As archives hold them.
_TEXT_IDS = _HEADERS.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")


def _read_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = lambda v: None if v is None else int(v)
    text = lambda v: None if v is None else unquote(v)
    names = [x.split()[0] for x in _HEADERS.split(", ")] + ["block"]

    def frame(rows):
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("segment", "total")})

    for batch in batches:
        for content in batch["content"]:
            rows, size = [], 0
            for h, block in parse_archive(content):
                rows.append((
                    h.get("warc-record-id"), h.get("warc-type"), h.get("warc-segment-origin-id") or h.get("warc-record-id"), number(h.get("warc-segment-number")),
                    number(h.get("warc-segment-total-length")), text(h.get("x-page-id")), h.get("warc-target-uri"), text(h.get("x-refers-to-page-id")),
                    (h.get("warc-payload-digest") or "").rpartition(":")[2] or None, block,
                ))
                size += len(block)
                if size > 4 << 20:
                    yield frame(rows)
                    rows, size = [], 0
            if rows:
                yield frame(rows)


@F.pandas_udf(T.BinaryType())
def _joined(parts: pd.Series) -> pd.Series:
    return pd.Series([b"".join(p["block"] for p in ps) for ps in parts])


_PAYLOAD = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType())])


@F.pandas_udf(_PAYLOAD)
def _decoded(block: pd.Series, kind: pd.Series, declared: pd.Series) -> pd.DataFrame:
    def of(data: bytes, k: str, digest: str | None) -> tuple:
        head, _, body = data.partition(b"\r\n\r\n")
        fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
        if k == "revisit":
            size = fields.get(b"content-length", b"")
            return None, int(size) if size.isdigit() else None, digest
        payload = dechunk(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
        return (None, None, None) if payload is None else (payload, len(payload), payload_digest(payload))

    rows = [of(*x) for x in zip(block, kind, declared)]
    return pd.DataFrame(rows, columns=["payload", "payload_bytes", "payload_digest"]).astype({"payload_bytes": "Int64"})


def reassemble(records: DataFrame) -> DataFrame:
    """One row per logical record: whole block and ``complete``."""
    whole = records.filter("segment is null").select(*[c for c in records.columns if c not in ("segment", "total", "origin")], F.lit(True).alias("complete"))
    parts = records.filter("segment is not null").dropDuplicates(["origin", "segment"])
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    groups = parts.groupBy("origin").agg(
        *[first(c) for c in ("kind", "page_id", "url", "refers_to", "declared")], F.max("total").alias("total"), F.max("segment").alias("last"),
        F.count("*").alias("n"), F.sum(F.octet_length("block")).alias("size"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    complete = F.coalesce((F.col("n") == F.col("last")) & (F.col("size") == F.col("total")) & F.col("kind").isNotNull(), F.lit(False))
    joined = groups.select(F.col("origin").alias("record_id"), "kind", "page_id", "url", "refers_to", "declared", _joined("parts").alias("block"), complete.alias("complete"))
    return whole.select(*joined.columns).unionByName(joined)


def read_archives(spark: SparkSession, path: str, id_type: str | T.DataType = "long") -> DataFrame:
    """Records of all archives under ``path``: record_id, record_type, page_id, url, refers_to, payload, its size and digest, complete.

    ``id_type`` is the type that the ids had."""
    files = spark.read.format("binaryFile").load(path).select("content")
    records = reassemble(files.mapInPandas(_read_records, _TEXT_IDS + ", block binary")).filter(F.col("kind").isin("response", "revisit"))
    records = records.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
    out = records.withColumn("p", _decoded("block", "kind", "declared"))
    return out.select("record_id", F.col("kind").alias("record_type"), "page_id", "url", "refers_to", "p.*", (F.col("complete") & F.col("p.payload_digest").eqNullSafe(F.col("declared"))).alias("complete"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, path)
    return read_archives(spark, path, pages.schema["page_id"].dataType).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


QUERIES = {"op6_warc": op6_warc}
ORACLES: dict[str, str] = {}
