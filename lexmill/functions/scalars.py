"""Scalar functions of the display layer as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Job status to document status (fixed values); anything else counts as queued.
JOB_TO_DOCUMENT = {"QUEUED": "QUEUED", "EXTRACTING": "EXTRACTING", "CHUNKING": "CHUNKING", "EMBEDDING": "EMBEDDING", "INDEXING": "INDEXING", "COMPLETED": "READY", "FAILED": "FAILED_INDEXING"}
JOB_ORDER = ("QUEUED", "EXTRACTING", "CHUNKING", "EMBEDDING", "INDEXING", "COMPLETED")


def format_bytes(n: Column) -> Column:
    """B, KB, MB or GB with one decimal, by powers of 1,024."""
    power = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), power + 1)
    return F.concat(F.format_string("%.1f", F.round(n / F.pow(F.lit(1024.0), power), 1)), F.lit(" "), unit)


def document_status(job_status: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in JOB_TO_DOCUMENT.items() for x in kv])
    return F.coalesce(F.try_element_at(names, job_status), F.lit("QUEUED"))


def status_class(status: Column) -> Column:
    return F.when(status.isin("READY", "COMPLETED"), "done").when(status.startswith("FAILED"), "failed").otherwise("in_progress")


def source_label(title: Column, filename: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(filename, F.lit("")), F.substring(key.cast("string"), 1, 8))


def default_title(filename: Column) -> Column:
    """A file name without its .pdf suffix, underscores as spaces, first letter in capitals."""
    bare = F.regexp_replace(F.regexp_replace(filename, r"(?i)\.pdf$", ""), "_", " ")
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))


def job_step(status: Column) -> Column:
    """Position of a status in the chain of steps; failures have none."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in JOB_ORDER]), status), F.lit(0))


def content_id(*parts: Column) -> Column:
    """A repeatable id: the SHA-256 of the parts' texts, a separator between them; missing parts count as empty."""
    return F.sha2(F.encode(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "UTF-8"), 256)


def metadata_field(metadata: Column, path: str, kind: str, default=None) -> Column:
    """A typed field of JSON text read as a variant; malformed text, a missing field and one of another type give the default."""
    found = F.try_variant_get(F.try_parse_json(metadata), path, kind)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))
