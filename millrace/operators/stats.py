"""Table statistics, selectivity and a cost model.

Statistics are exact and computed in one aggregate over the table (and one count for each column's most
common values), not from a sample. The cost model explains plans; Catalyst and adaptive execution
choose what runs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def column_stats(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """A row for each column: column_name, row_count, null_count, distinct_count, min_value, max_value (as text)."""
    columns = columns or df.columns
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggregates = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        aggregates += [F.count_if(col.isNull()).alias(f"u{i}"), distinct(col).alias(f"d{i}"), F.min(col).cast("string").alias(f"a{i}"), F.max(col).cast("string").alias(f"b{i}")]
    one = df.agg(*aggregates)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("row_count"), F.col(f"u{i}").alias("null_count"), F.col(f"d{i}").alias("distinct_count"), F.col(f"a{i}").alias("min_value"), F.col(f"b{i}").alias("max_value")) for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def most_common(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """(value, frequency) of the most common values, ties by value; NULL is no value."""
    found = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("frequency"))
    return found.orderBy(F.desc("frequency"), "value").limit(top)


def histogram(df: DataFrame, column: str, buckets: int = 10, ranges: int = 64) -> DataFrame:
    """Equi-height histogram bounds (bucket, bound) of a numeric column, exact: bound i is the smallest value that at
    least i / buckets of the values that are not NULL don't exceed. Without values every bound is NULL.

    Distinct values are counted and summed in about even ``ranges`` of them, whose approximate limits only deal the work.
    """
    value = F.col(column)
    limits, total = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000), F.count(value)).first()  # ranges - 1 values
    part = sum((F.when(value > F.lit(x), 1).otherwise(0) for x in sorted(set(limits or []))), F.lit(0))
    counts = df.filter(value.isNotNull()).groupBy(value.alias("bound")).agg(F.count("*").alias("n"), F.first(part).alias("part"))
    inside = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("bound")))
    sums = counts.groupBy(F.col("part").alias("_part")).agg(F.sum("n").alias("s"))
    sums = sums.select("_part", (F.sum("s").over(Window.orderBy("_part")) - F.col("s")).alias("base"))  # a row for each range
    placed = inside.join(F.broadcast(sums), F.col("part") == F.col("_part")).select("bound", (F.col("base") + F.col("upto")).alias("upto"), "n")
    ranks = [(i, max(1, (total * i + buckets - 1) // buckets)) for i in range(buckets + 1)]
    wanted = df.sparkSession.createDataFrame(ranks, "bucket int, rank long")
    found = placed.join(F.broadcast(wanted), (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select(F.col("bucket").alias("_bucket"), "bound")
    return wanted.join(F.broadcast(found), F.col("bucket") == F.col("_bucket"), "left").select("bucket", "bound")


#: Where no histogram is known.
RANGE_SELECTIVITY = 0.33


def selectivity_range(bounds: list, low=None, high=None) -> float:
    """Share of rows in [low, high], by equi-height ``bounds`` (a bucket between each two) and evenly inside a bucket."""
    if len(bounds) < 2:
        return RANGE_SELECTIVITY

    def below(x) -> float:
        full = 0.0
        for a, b in zip(bounds, bounds[1:]):
            full += 1.0 if x >= b else (x - a) / (b - a) if x > a else 0.0
        return full / (len(bounds) - 1)

    return max(0.0, (1.0 if high is None else below(high)) - (0.0 if low is None else below(low)))


def selectivity_eq(distinct: int, common: dict, rows: int, value) -> float:
    """Share of rows equal to ``value``: its frequency if it is a most common value, else an even share of the rest."""
    if not rows or not distinct:
        return 0.0
    if value in common:
        return common[value] / rows
    return max(0.0, 1 - sum(common.values()) / rows) / (distinct - len(common)) if distinct > len(common) else 1.0 / distinct


def selectivity_and(*parts: float) -> float:
    out = 1.0
    for p in parts:
        out *= p
    return out


def selectivity_or(a: float, b: float) -> float:
    return a + b - a * b


# The cost constants.
SEQ_PAGE, RANDOM_PAGE, WRITE_PAGE, CPU_TUPLE, CPU_OPERATOR, CPU_INDEX, MEMORY, NETWORK = 1.0, 4.0, 2.0, 0.01, 0.005, 0.02, 0.0001, 0.1
SORT_MEMORY = 1 << 20


def seq_scan_cost(pages: float, rows: float, predicates: int = 0) -> float:
    return pages * SEQ_PAGE + rows * CPU_TUPLE + rows * predicates * CPU_OPERATOR


def index_scan_cost(pages: float, rows: float, selectivity: float) -> float:
    found = rows * selectivity
    return min(found, pages) * RANDOM_PAGE + found * (CPU_INDEX + CPU_TUPLE)


def nested_loop_cost(left: float, right: float, left_rows: float, right_rows: float) -> float:
    return left + left_rows * right + left_rows * right_rows * CPU_OPERATOR


def hash_join_cost(left: float, right: float, left_rows: float, right_rows: float) -> float:
    return left + right + min(left_rows, right_rows) * (CPU_TUPLE + MEMORY) + max(left_rows, right_rows) * CPU_OPERATOR


def sort_cost(rows: float, width: float = 100) -> float:
    from math import log2

    pages = rows * width / 8192
    spill = 2 * pages * (SEQ_PAGE + WRITE_PAGE) if rows * width > SORT_MEMORY else 0.0
    return rows * log2(max(2.0, rows)) * CPU_OPERATOR + spill


def merge_join_cost(left: float, right: float, left_rows: float, right_rows: float) -> float:
    return left + right + sort_cost(left_rows) + sort_cost(right_rows) + (left_rows + right_rows) * CPU_OPERATOR


def aggregate_cost(child: float, rows: float, groups: float) -> float:
    return child + rows * CPU_OPERATOR + groups * (CPU_TUPLE + MEMORY)


def limit_cost(child: float, rows: float, limit: float) -> float:
    return child * min(1.0, limit / rows) if rows else child


@dataclass(frozen=True)
class Relation:
    name: str
    rows: float
    cost: float


def join_order(tables: list[Relation], selectivity: dict[frozenset, float], exhaustive: int = 7) -> tuple[list[str], float]:
    """Left-deep order of least cost: dynamic programming for few tables, greedy by result size for more."""

    def joined(rows: float, cost: float, names: frozenset, t: Relation) -> tuple[float, float]:
        share = 1.0
        for n in names:
            share *= selectivity.get(frozenset((n, t.name)), 1.0)
        total = min(hash_join_cost(cost, t.cost, rows, t.rows), nested_loop_cost(cost, t.cost, rows, t.rows))
        return rows * t.rows * share, total

    if not tables:
        return [], 0.0
    by_name = {t.name: t for t in tables}
    if len(tables) <= exhaustive:
        best = {frozenset((t.name,)): (t.cost, t.rows, [t.name]) for t in tables}
        for size in range(2, len(tables) + 1):
            for names in map(frozenset, combinations(sorted(by_name), size)):
                options = []
                for last in names:
                    cost, rows, order = best[names - {last}]
                    new_rows, new_cost = joined(rows, cost, names - {last}, by_name[last])
                    options.append((new_cost, new_rows, [*order, last]))
                best[names] = min(options)
        cost, _, order = best[frozenset(by_name)]
        return order, cost
    first = min(tables, key=lambda t: t.rows)
    order, rows, cost = [first.name], first.rows, first.cost
    while len(order) < len(tables):
        rest = [t for t in tables if t.name not in order]
        t = min(rest, key=lambda t: joined(rows, cost, frozenset(order), t))
        rows, cost = joined(rows, cost, frozenset(order), t)
        order.append(t.name)
    return order, cost
