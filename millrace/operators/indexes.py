"""Index semantics over file layouts.

A B+tree index is a copy sorted by key range, so that Parquet's minima and maxima skip files and row groups; a
hash index is a table bucketed by key; a composite index is sorted by several columns. Look-ups are filters
that reach the scan. NULL keys are not indexed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fulltext


def indexed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with no NULL key."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def write_sorted(df: DataFrame, keys: list[str], path: str) -> None:
    """B+tree or composite layout: key ranges as files, sorted inside."""
    indexed(df, keys).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_hashed(df: DataFrame, key: str, table: str, path: str, buckets: int = 256) -> None:
    """Hash layout: bucketed and sorted by key."""
    indexed(df, [key]).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def with_place(df: DataFrame) -> DataFrame:
    """Rows of files with ``_place``: the last folder and name of the file, and the row's number in it."""
    file = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1)
    return df.select("*", F.struct(file.alias("file"), F.col("_metadata.row_index").alias("row")).alias("_place"))


def write_part(df: DataFrame, kind: str, keys: list[str], path: str) -> None:
    """An index of stored rows: all columns in the order of the keys, or a text index of the rows' places."""
    if kind == "FULLTEXT":
        texts = with_place(df).select("_place", F.concat_ws("\n", *keys).alias("_text"))
        fulltext.store(fulltext.build(texts, "_place", "_text"), path)
    elif kind == "HASH":
        indexed(df, keys).repartition(*keys).sortWithinPartitions(*keys).write.parquet(path)
    else:
        indexed(df, keys).repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def matching_rows(df: DataFrame, paths: list[str], terms: list[str], every: bool) -> DataFrame:
    """Stored rows whose text index ``paths`` lists any of the ``terms``, or every one."""
    postings = df.sparkSession.read.parquet(*(f"{p}/postings" for p in paths)).filter(F.col("term").isin(terms))
    hits = postings.groupBy("doc").agg(F.count("*").alias("n"))
    hits = hits.filter(F.col("n") == len(terms)) if every else hits
    return with_place(df).join(hits, F.col("_place") == F.col("doc"), "left_semi").drop("_place")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def point(df: DataFrame, key: str, *values) -> DataFrame:
    """All rows of one or several keys, duplicates included."""
    return df.filter(F.col(key) == values[0]) if len(values) == 1 else df.filter(F.col(key).isin(list(values)))


def key_range(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """Rows with low <= key <= high; an open end is None."""
    out = indexed(df, [key])
    out = out if low is None else out.filter(F.col(key) >= low)
    return out if high is None else out.filter(F.col(key) <= high)


def prefix(df: DataFrame, values: dict) -> DataFrame:
    """Rows with the given values of a composite key's leading columns."""
    for k, v in values.items():
        df = df.filter(F.col(k) == v)
    return df


def composite_range(df: DataFrame, keys: list[str], low: list, high: list) -> DataFrame:
    """Rows whose key is between two composite keys in lexicographic order, inclusive; shorter bounds are prefixes."""

    def beyond(values: list, up: bool) -> Column:
        out = F.lit(True)
        for k, v in reversed(list(zip(keys, values))):
            c = F.col(k)
            out = ((c > v) if up else (c < v)) | ((c == v) & out)
        return out

    first = keys[0]
    return indexed(df, keys).filter((F.col(first) >= low[0]) & (F.col(first) <= high[0])).filter(beyond(low, True) & beyond(high, False))


def starts_with(df: DataFrame, key: str, text: str) -> DataFrame:
    """Trie look-up."""
    return df.filter(F.col(key).startswith(text))


def upsert_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last in ``order``, as a unique index keeps it.

    The last row is a maximum, so rows are combined before the shuffle and a hot key is no bottleneck.
    """
    rest = [c for c in df.columns if c not in (key, *order)]
    last = indexed(df, [key]).groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(key, *(F.col(f"_last.`{c}`") for c in (*order, *rest))).select(df.columns)


def key_stats(df: DataFrame, key: str) -> DataFrame:
    """One row: entries, distinct_keys, min_key, max_key."""
    return indexed(df, [key]).agg(F.count("*").alias("entries"), F.count_distinct(key).alias("distinct_keys"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def number_rows(df: DataFrame, out: str, first: int = 0) -> DataFrame:
    """Rows numbered without gaps in the order of partitions; ``df`` must give the same rows when read again."""
    rows = df.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_mid", 33)
    sizes = dict(rows.groupBy(part.alias("p")).count().collect())  # a row for each partition
    spark, at, starts = df.sparkSession, first, []
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    offsets = spark.createDataFrame(starts or [(0, first)], "_p long, _start long")
    return rows.join(F.broadcast(offsets), part == F.col("_p")).withColumn(out, F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid", "_p", "_start")


