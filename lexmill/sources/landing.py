"""The landing folder of uploads: files are judged by name and size before a byte of them is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The largest upload and the ending of accepted names (fixed values).
MOST_BYTES = 50 * 1024 * 1024
ENDING = ".pdf"


def rejection(name: Column, size: Column, most_bytes: int = MOST_BYTES) -> Column:
    """INVALID_FILE_TYPE, FILE_TOO_LARGE or ACCEPTED."""
    return F.when(~F.lower(name).endswith(ENDING), "INVALID_FILE_TYPE").when(size > most_bytes, "FILE_TOO_LARGE").otherwise("ACCEPTED")


def _judged(files: DataFrame, most_bytes: int) -> DataFrame:
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    return files.select("path", name.alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("landed_at"), rejection(name, F.col("length"), most_bytes).alias("reason"))


def scan_landing(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, filename, size_bytes, landed_at, reason) of every file under ``path``; contents are not read."""
    return _judged(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), most_bytes)


def stream_landing(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The same as a stream of the files that arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _judged(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path), most_bytes)


def read_accepted(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, filename, size_bytes, content) of the accepted files; the size limit and the ending reach the file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    files = files.filter(F.col("length") <= most_bytes)
    return files.join(_judged(files, most_bytes).filter("reason = 'ACCEPTED'").select("path", "filename"), "path").select("path", "filename", F.col("length").alias("size_bytes"), "content")


def record_uploads(spark: SparkSession, path: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append what arrives under ``path``, accepted and rejected, to the table at ``target``; each file once."""
    stream = stream_landing(spark, path).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()
