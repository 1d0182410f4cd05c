"""Tables in a shared folder: scratch tables, and keyed tables kept as layers under a version manifest."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local master, as in tests, does without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _ROOTS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="lexmill-"))
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's program ends."""
    path = f"{shared_root(spark)}/lexmill-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    target, fs = _fs(spark, path)
    fs.delete(target, True)


class KeyedTable:
    """A table that is replaced key by key.

    A write adds a layer: the new rows of some keys, dealt to buckets, and the keys themselves, which may be left without
    rows.  Readers take each key from the newest layer that names it.  Compaction merges the layers into the base and
    rewrites only the buckets that they touch.  What belongs to a version stands in its manifest, which appears by one
    rename, so a write that fails before it leaves no trace; a write carries the name and number of its batch, and a batch
    that is in the manifest is not written again.  Old versions stay readable until ``vacuum``.

    The number of layers is bounded by compacting from MOST_LAYERS on; the keys of the layers are small beside the base and
    are looked up, so reading moves no base row for them where Spark finds them small enough to broadcast.
    """

    MOST_LAYERS = 8

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, order: tuple[str, ...] = ()):
        """``order``: columns that files are sorted by, so that filters on them skip parts of files."""
        self.spark, self.path, self.key, self.buckets, self.order = spark, path.rstrip("/"), key, buckets, order

    # -- versions

    def versions(self) -> list[int]:
        target, fs = _fs(self.spark, f"{self.path}/versions")
        if not fs.exists(target):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The given or last version: its base parts and layers, and the last batch of every writer."""
        if version is None:
            found = self.versions()
            if not found:
                return {"version": -1, "schema": None, "base": [], "layers": [], "batches": {}}
            version = found[-1]
        target, fs = _fs(self.spark, f"{self.path}/versions/{version:010d}.json")
        stream = fs.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> bool:
        """Publish the next version; false if another writer was first."""
        jvm, name = self.spark._jvm, f"{self.path}/versions/{manifest['version']:010d}.json"
        draft, fs = _fs(self.spark, f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(name), options)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    # -- writing

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _store(self, rows: DataFrame, folder: str) -> None:
        # A bucket's rows come from one task, so a layer has a file a bucket.
        rows.withColumn("bucket", self.bucket()).repartition("bucket").sortWithinPartitions("bucket", *self.order).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/rows/{folder}")

    def write(self, rows: DataFrame, keys: DataFrame | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Replace all rows of ``keys`` (by default those of ``rows``) by ``rows``; false if the batch is in already."""
        before = self.manifest()
        if batch and before["batches"].get(batch[0], -1) >= batch[1]:
            return False
        folder = uuid.uuid4().hex
        named = (rows if keys is None else keys).select(self.key).distinct()
        self._store(rows, folder)
        named.withColumn("bucket", self.bucket()).coalesce(1).write.parquet(f"{self.path}/keys/{folder}")
        touched = [r["bucket"] for r in self.spark.read.parquet(f"{self.path}/keys/{folder}").select("bucket").distinct().collect()]  # a row a bucket
        while True:
            now = self.manifest()
            if batch and now["batches"].get(batch[0], -1) >= batch[1]:
                return False
            layer = {"folder": folder, "buckets": sorted(touched)}
            batches = now["batches"] | ({batch[0]: batch[1]} if batch else {})
            if self._commit(now | {"version": now["version"] + 1, "schema": now["schema"] or json.loads(rows.schema.json()), "layers": [*now["layers"], layer], "batches": batches}):
                break
        if len(now["layers"]) + 1 >= self.MOST_LAYERS:
            self.compact()
        return True

    def compact(self) -> None:
        """Merge the layers into the base; buckets that no layer touches stay where they are."""
        now = self.manifest()
        touched = sorted({b for layer in now["layers"] for b in layer["buckets"]})
        if not touched:
            return
        folder = uuid.uuid4().hex
        self._store(self._merged(now, touched).select(*T.StructType.fromJson(now["schema"]).names), folder)
        base = [{"folder": p["folder"], "buckets": left} for p in now["base"] if (left := [b for b in p["buckets"] if b not in set(touched)])]
        # A write that came in between has its layer after these and stays one.
        while not self._commit((last := self.manifest()) | {"version": last["version"] + 1, "base": [*base, {"folder": folder, "buckets": touched}], "layers": last["layers"][len(now["layers"]) :]}):
            pass

    def vacuum(self, keep: int = 2) -> None:
        """Delete what only versions before the last ``keep`` need.  Not while a write is under way."""
        found = self.versions()
        if not found:
            return
        needed = {p["folder"] for v in found[-keep:] for m in [self.manifest(v)] for p in [*m["base"], *m["layers"]]}
        for kind in ("rows", "keys"):
            target, fs = _fs(self.spark, f"{self.path}/{kind}")
            for s in fs.listStatus(target) if fs.exists(target) else []:
                if s.getPath().getName() not in needed:
                    fs.delete(s.getPath(), True)
        for v in found[:-keep]:
            _remove(self.spark, f"{self.path}/versions/{v:010d}.json")

    # -- reading

    def _rows(self, part: dict, schema: T.StructType) -> DataFrame:
        """The rows of a part; a folder without files, of keys without rows, is empty."""
        held = schema.add("bucket", T.IntegerType()) if "bucket" not in schema.names else schema
        return self.spark.read.schema(held).parquet(f"{self.path}/rows/{part['folder']}").filter(F.col("bucket").isin(part["buckets"]))

    def _merged(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        keys = [self.spark.read.parquet(f"{self.path}/keys/{layer['folder']}").select(self.key) for layer in manifest["layers"]]
        out = None
        for level, parts in enumerate([manifest["base"], *([layer] for layer in manifest["layers"])]):
            for part in parts:
                rows = self._rows(part, T.StructType(list(schema.fields)))
                if buckets is not None:
                    rows = rows.filter(F.col("bucket").isin(buckets))
                for newer in keys[level:]:
                    rows = rows.join(newer, self.key, "left_anti")
                out = rows if out is None else out.unionByName(rows)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError(f"{self.path} has no version")
        return self._merged(manifest).select(*T.StructType.fromJson(manifest["schema"]).names)
