"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stringloom.plans.staging import stage, staging_dir

__all__ = ["append_ends", "arrow_rows", "global_running_sum", "new_folder", "open_folder", "read_table", "row_key", "small", "stage", "width",
           "without"]

# Python tasks look at whole texts in slices of about this many bytes, whatever Arrow's batch size is.
SLICE_BYTES = 4 << 20
# A lookup table is sent to every task only below this size; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """128 bits, ``key`` and ``key2``, that rows share if they agree in id and text, nulls included."""
    own = [F.col(doc_id), F.col(text), F.col(doc_id).isNull(), F.col(text).isNull()]
    return [F.xxhash64(F.lit(i), *own).alias(name) for i, name in enumerate(("key", "key2"))]


def without(docs: DataFrame, bad: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are not in ``bad(key, key2)``."""
    bad = bad.select(F.col("key").alias("_key"), F.col("key2").alias("_key2")).distinct()
    return docs.join(bad, (keys[0] == bad["_key"]) & (keys[1] == bad["_key2"]), "left_anti")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared place that ``spark.checkpoint.dir`` names; nothing is created yet."""
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder given by URI or path, created where it is missing."""
    if "://" not in folder and not folder.startswith("file:"):
        system, path = fs.LocalFileSystem(), folder
    else:
        system, path = fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if "file://" not in folder else folder)
    system.create_dir(path, recursive=True)
    return system, path


def arrow_rows(
    batches: Iterator[pa.RecordBatch], text: str, slice_bytes: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches of at most ``slice_bytes`` of ``text`` (or one row), with its UTF-8 bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        first = total = 0
        for i, size in enumerate(sizes):
            if i > first and total + size > slice_bytes:
                yield batch.slice(first, i - first), column.slice(first, i - first).to_pylist()
                first, total = i, 0
            total += size
        if first < len(sizes):
            yield batch.slice(first), column.slice(first).to_pylist()


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def append_ends(rows: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """Rows dealt by ranges of ``order`` and sorted, with ``_part`` (range number) and ``_row`` (place in it)."""
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())


def global_running_sum(rows: DataFrame, order: list[str], amount: str, name: str, parts: int) -> DataFrame:
    """``name``: sum of ``amount`` over all earlier rows in ``order`` (nulls last).

    The rows are dealt out by ranges once and written. One number per range is summed over all, the
    rest inside a range, so no task sees more than one range.
    """
    dealt = stage(append_ends(rows, [F.col(c).asc_nulls_last() for c in order], parts), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.sum(amount).alias("_total")).select(
        "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(F.broadcast(offsets), "_part")  # one row per range
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("_part", "_row", "_offset")
    )


def small(lookup: DataFrame, weight: Column) -> DataFrame:
    """``lookup``, marked for broadcast if its measured size allows it."""
    size = lookup.agg(F.sum(weight + F.lit(64))).first()[0] or 0
    return F.broadcast(lookup) if size <= BROADCAST_BYTES else lookup
