"""Turning files into rows: a reader of bytes applied to a table of (path, content), such as Spark's ``binaryFile`` gives."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path``, ``length``, ``modified`` and ``content`` of the files below a folder; unread columns are pruned from the scan."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def rows_of(df: DataFrame, reader: Callable[[bytes], Iterable[tuple]], schema: str, path: str = "path", content: str = "content") -> DataFrame:
    """``path``, the reader's columns and ``failure`` of every row that it finds in each file.

    A file that cannot be read gives one row of nulls with the reason, so one bad file never ends a scan; a null
    content is an empty file. A file is read by one task, whole.
    """
    inner = StructType.fromDDL(schema)
    full = StructType([StructField("path", StringType()), *inner.fields, StructField("failure", StringType())])
    arrow, width = to_arrow_schema(full), len(inner.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [(name, *row, None) for row in reader(data or b"")]
                except Exception as failure:  # any damage of a file
                    out.append((name, *[None] * width, f"{type(failure).__name__}: {failure}"[:200]))
            cols = list(zip(*out, strict=True)) if out else [()] * (width + 2)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, full)


def listing(spark: SparkSession, folder: str, pattern: str = "*", hidden: bool = False, limit: int | None = None) -> DataFrame:
    """``path`` below a folder, ``length`` and ``modified`` of its files, and ``stopped``: whether a limit left some out (S-01, O-11).

    Contents are not read. Names that start with a dot, and what lies below them, are left out unless asked for.
    """
    found = files(spark, folder, pattern).drop("content")
    base = folder.rstrip("/").split("/")[-1]
    found = found.withColumn("path", F.regexp_extract("path", f"/{base}/(.*)$", 1))
    found = found if hidden else found.where(~F.col("path").rlike(r"(^|/)\.[^/.]"))
    if limit is None:
        return found.withColumn("stopped", F.lit(False))
    first = found.orderBy("path").limit(limit + 1)
    rows = first.withColumn("n", F.row_number().over(Window.orderBy("path")))  # limit + 1 rows at most
    return rows.withColumn("stopped", F.count(F.lit(1)).over(Window.partitionBy()) > limit).where(F.col("n") <= limit).drop("n")
