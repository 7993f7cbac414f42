"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: What lies between words.
GAP = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, on a local master alone, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lakeloom-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/lakeloom/{app}"
    path = f"{root}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if app not in _swept:
        _swept.add(app)
        system, at = _file_system(spark, root)
        system.deleteOnExit(at)  # what no operator forgot goes with the application
    return spark.read.schema(df.schema).parquet(path), path


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Input of fewer bytes is dealt anew before work row by row: one row group is one task, however many cores there are.
SMALL_INPUT = 64 << 20


def input_bytes(df: DataFrame) -> int:
    """Size of what a plan reads, by its own statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is small; as it is where its files give tasks enough."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if input_bytes(df) < SMALL_INPUT else df


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`stored` wrote and that no later read needs."""
    system, at = _file_system(spark, path)
    system.delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage: the plans and compiled classes of the hundreds of jobs that an iterative operator leaves."""
    spark.sparkContext._jvm.java.lang.System.gc()


#: A key that holds over this share of all rows is hot.
SHARES = 1024


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``key`` and ``parts`` of the keys that hold over 1/SHARES of all rows: fewer than SHARES rows, whatever the input."""
    total = counts.agg(F.sum(n)).first()[0] or 1
    return counts.where(F.col(n) * SHARES > total).select(key, F.ceil(F.col(n) * SHARES / F.lit(total)).cast("int").alias("__parts"))


def join_split(rows: DataFrame, other: DataFrame, key: str, hot: DataFrame, spread: Column) -> DataFrame:
    """Inner join on ``key``; the rows of a hot key are dealt by ``spread`` (a hash of them) to its parts, and ``other`` is repeated in each."""
    hot = F.broadcast(hot)  # under SHARES rows
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.withColumn("__at", spread).join(hot, key, "left").withColumn("__at", F.pmod("__at", parts)).drop("__parts")
    each = other.join(hot, key, "left").withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long")))).drop("__parts")
    return dealt.join(each, [key, "__at"]).drop("__at")


def let(value: Column, body) -> Column:
    """``body`` applied to ``value`` computed once, inside one projection."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


#: Rows of an Arrow batch of texts; Spark's own 10,000 would be gigabytes where texts are long.
BATCH_ROWS = 512


def texts_in_batches(rows: DataFrame) -> DataFrame:
    """``rows``, with the session's Arrow batches cut to BATCH_ROWS rows where they would be larger."""
    spark, key = rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return rows


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to so many rows, so that a worker holds few texts as Python strings; memory of a batch is given back after it."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        pa.default_memory_pool().release_unused()


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a[i]-b[i] thinned to (node, smallest node of its component): as many rows as nodes at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]
