"""Shared helpers of the training-data operators: the shared folder, materialised
tables, and ordered prefix sums that never put a whole group into one task."""

from __future__ import annotations

import contextlib
import ctypes
import math
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.sources.shared import shared_folder

#: Java regular expression of a word: a run without space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders that this process has written.
WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def cleanup(spark: SparkSession) -> None:
    """Delete all that operators have written; call it when their results have been saved or read."""
    for path in list(WRITTEN):
        discard(spark, path)
    for t in spark.catalog.listTables():
        if t.name.startswith("millrace_texts_"):
            spark.sql(f"DROP TABLE {t.name}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage is cut there,
    the table survives lost executors, and every later use sees the same rows."""
    return materialize_at(df, name)[0]


def materialize_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``materialize``, and where the table is, for ``discard``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def numbered_by(df: DataFrame, order: list[Column], out: str, name: str) -> DataFrame:
    """``df``, written, with a long ``out`` that ascends with ``order``: rows are dealt by ranges, sorted and
    numbered in the order of partitions. The numbers have gaps."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.withColumn(out, F.monotonically_increasing_id()), name)


def bucket_bits(rows: int, per_bucket: int = 1000, most: int = 20) -> int:
    """Bits of a hash that spread ``rows`` over buckets of about ``per_bucket`` rows."""
    return min(most, max(0, math.ceil(math.log2(max(1, rows / per_bucket)))))


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column | str, out: str, rank: str | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` inside each ``group``, in the order (bucket, *order).

    A group is never gathered in one task: rows are summed inside (group, bucket), the bucket
    totals (one row per group and bucket) are summed in bucket order, and both are added.
    ``bucket`` must be a prefix of the order, such as the top bits of a hash. ``rank`` also
    adds the row's place from 0. Groups may be null.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = [*group, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_v", value)
    local = rows.withColumn("_in", F.sum("_v").over(inside) - F.col("_v"))
    if rank:
        local = local.withColumn("_at", F.row_number().over(inside.orderBy(*order)) - 1)
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.sum("_v").alias("_s"), F.count("*").alias("_n"))
    sums = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = local.join(sums, on)
    added = joined.withColumn(out, F.col("_base") + F.col("_in"))
    if rank:
        added = added.withColumn(rank, F.col("_first") + F.col("_at"))
    return added.drop("_v", "_in", "_at", "_base", "_first", *(f"_k{i}" for i in range(len(keys))))


def slices(batches, rows: int = 256):
    """The rows of ``batches`` in small batches, so that a worker holds few texts as objects and sends few at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def trimmed(work):
    """``work`` over batches, after which the Python worker gives free memory back to the system: it is kept for
    later tasks, and what it holds idle is missing in stages that need none."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
