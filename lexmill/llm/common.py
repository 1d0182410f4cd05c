"""Small helpers shared by the corpus operators: scratch tables, table reads and word expressions."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space, and the controls from tab to carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_ROOTS: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir.  Only a local master, as in tests, does without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _ROOTS.setdefault(app, tempfile.mkdtemp(prefix="lexmill-"))
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/lexmill-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table when the driver's program ends; a stopped session leaves it to the folder's owner."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: the lineage ends there and survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(df: DataFrame) -> None:
    """Delete the scratch table that ``cut`` returned; nothing may read it any more."""
    if path := _PATHS.pop(df, None):
        _remove(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """A name for a working column that ``df`` does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


#: Texts sent to Python at a time by the jobs of an operator, so that workers stay small beside Spark's own bound in bytes.
TEXT_ROWS = 2000


def in_small_batches(operator):
    """Run the jobs that ``operator`` starts with small Arrow batches; the session's setting is as before when it returns."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **kwargs):
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        spark, before = df.sparkSession, df.sparkSession.conf.get(key)
        spark.conf.set(key, min(TEXT_ROWS, int(before)) if int(before) > 0 else TEXT_ROWS)
        try:
            return operator(df, *args, **kwargs)
        finally:
            spark.conf.set(key, before)

    return run


#: Rows of a key from which it is hot, and the most hot keys, whatever the number of rows.
HOT_ROWS = 1000
HOT_KEYS = 1 << 16


def hot_rows(rows: DataFrame) -> int:
    """From how many rows on a key of ``rows`` is hot; at most HOT_KEYS keys are."""
    return max(HOT_ROWS, rows.count() // HOT_KEYS)


def meet(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key and the number of its rows as ``count`` (dropped).

    Keys that many rows hold are broadcast and meet their rows where these are: each has at least total / HOT_KEYS rows, so
    there are HOT_KEYS of them at most.  All others are joined as usual.  Both tables are read twice, so cut them first.
    """
    least = hot_rows(rows)
    hot, cold = (keyed.filter(f).drop(count) for f in (F.col(count) >= least, F.col(count) < least))
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys, how)
    return rest if how == "left_anti" else rows.join(F.broadcast(hot), keys, how).unionByName(rest)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, which may use it as often as it likes."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; null gives no words."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
