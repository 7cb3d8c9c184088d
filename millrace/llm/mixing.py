"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source has a weight and may be repeated at most ``epochs`` times. Targets share the total by
weight; a source above its cap is clamped there and its excess goes to the others by weight, until
none is above. With sources in the order of cap / weight this is one running sum: the k-th source
is clamped if its cap is at or below its weight's share of what the earlier ones leave.

A source of e = target / size epochs gives each document floor(e) whole repetitions, and one more
to a seeded sample for the rest: documents in the order of a seeded hash are taken until the
words are reached. The sample is drawn in three strata of size (from the source's mean up, from a
quarter of it, below), each correcting what the larger ones over- or undershot, so a source misses its
target by about half of one small document.

Rows of one id (or none) have one hash. More than ``CROWD`` of them are ordered by a hash of the text, and
those of one text by a hash of their place in the written table, so that no window holds them all; up to that
number they follow by size, as the SQL has it.

Cases: null text counts no words, null is a source of its own and comes last, documents of no words
are taken zero words, repeated rows count each, an empty table gives no rows. Each source is one
row in the table of sources, which is ordered in one task; documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import WORD, bucket_bits, materialize, prefix_sums, read_table

#: Rows of one id, and of one id and text, that are ordered in one window at most.
CROWD = 8000


def water_fill(sources: DataFrame, epochs: int, total: Column) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): least(cap, level x weight), summing to ``total``."""
    cap = F.col("source_size") * epochs
    by = Window.orderBy((cap / F.col("weight")).asc(), F.col("place").asc())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = sources.withColumn("_left", total - F.coalesce(F.sum(cap).over(before), F.lit(0)))
    ranked = ranked.withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("_level", F.col("_left").cast("double") / F.col("_weights"))
    ranked = ranked.withColumn("_free", cap > F.col("_level") * F.col("weight"))
    ranked = ranked.withColumn("_water", F.min(F.when(F.col("_free"), F.struct(F.col("_weights") * -1, "_level"))).over(everything)["_level"])
    return ranked.withColumn("target", F.coalesce(F.least(cap.cast("double"), F.col("_water") * F.col("weight")), cap.cast("double"))).drop("_left", "_weights", "_level", "_free", "_water")


def mix(documents: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 8, key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """(key, source, size, source_size, target, taken, repeats, carry) of ``documents`` (key, text, source, carry).

    Weights repeat over the sources in code point order, null last.
    """
    carry = carry or []
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 16)
    rows = materialize(documents.select(F.col(key), "source", size.alias("size"), order.alias("_h"), F.xxhash64("text").alias("_i"), *carry), "mix")
    return mix_sizes(rows, epochs, weights, key, carry)


def bucketed(rows: DataFrame, bits: int) -> DataFrame:
    """Add the bucket ``_b`` to written ``rows`` (_h, _i): the first digits of ``_h``, and for a crowd of rows
    with one ``_h`` all of them and digits of ``_i``, or of the row's place where ``_i`` is one, too."""
    first = F.substring("_h", 1, -(-bits // 4)) if bits else F.lit("")
    full = materialize(rows.groupBy(first.alias("_f")).agg(F.count("*").alias("_n")).filter(F.col("_n") > CROWD).select("_f"), "mix-full")
    if full.isEmpty():
        return rows.withColumn("_b", first)
    held = materialize(rows.join(full, first == F.col("_f"), "left_semi").groupBy("_h", "_i").agg(F.count("*").alias("_n")), "mix-held")
    ids = held.groupBy(F.col("_h").alias("_ch")).agg(F.sum("_n").alias("_all")).filter(F.col("_all") > CROWD)
    texts = held.filter(F.col("_n") > CROWD).select(F.col("_h").alias("_th"), F.col("_i").alias("_ti"), F.col("_n").alias("_same"))

    def digits(value: Column, count: Column) -> Column:
        """As many digits of ``value`` as leave about 1000 of ``count`` rows in a bucket."""
        return F.lpad(F.hex(value), 16, "0").substr(F.lit(1), F.ceil(F.log(16.0, count / 1000)).cast("int"))

    spread = rows.withColumn("_place", F.xxhash64("_i", F.col("_metadata.row_index")))
    spread = spread.join(ids, F.col("_h") == F.col("_ch"), "left").join(texts, (F.col("_h") == F.col("_th")) & (F.col("_i") == F.col("_ti")), "left")
    crowd = F.when(F.col("_same").isNull(), digits(F.col("_i"), F.col("_all"))).otherwise(F.concat(F.lpad(F.hex("_i"), 16, "0"), digits(F.col("_place"), F.col("_same"))))
    bucket = F.when(F.col("_all").isNull(), first).otherwise(F.concat("_h", crowd))
    return spread.withColumn("_b", bucket).drop("_place", "_ch", "_all", "_th", "_ti", "_same")


def mix_sizes(rows: DataFrame, epochs: int, weights: tuple[int, ...], key: str, carry: list[str]) -> DataFrame:
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    everything = Window.partitionBy()
    sources = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    sources = water_fill(sources, epochs, F.sum("source_size").over(everything))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("whole", F.least(whole, F.lit(epochs)).cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = materialize(sources.withColumn("mean", F.col("source_size") / F.col("_n")).withColumnRenamed("source", "_source").drop("_n"), "mix-sources")

    bits = bucket_bits(rows.count())
    known = bucketed(rows, bits).drop("_i").join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    stratum = F.when(F.col("size") >= F.col("mean"), 0).when(F.col("size") >= F.col("mean") / 4, 1).otherwise(2)
    known = known.withColumn("_t", stratum)
    known = materialize(prefix_sums(known, ["source", "_t"], "_b", ["_h", key, "size", *carry], "size", "_start"), "mix-order")
    budget, owed, in_all = [], F.lit(0.0), F.lit(0)
    middle = F.col("_start") + F.col("size") / 2
    parts = known.groupBy(F.col("source").alias("_source")).agg(*(F.sum(F.when(F.col("_t") == t, F.col("size")).otherwise(0)).alias(f"_s{t}") for t in range(3)), *(F.first(c).alias(c) for c in ("rest", "source_size")))
    for t in range(3):
        in_all = in_all + F.col(f"_s{t}")
        share = F.when(F.col("source_size") > 0, F.col("rest") * in_all / F.col("source_size")).otherwise(F.lit(0.0))
        parts = parts.withColumn(f"_b{t}", share - owed)
        budget.append(F.col(f"_b{t}"))
        if t < 2:
            taken = known.filter(F.col("_t") == t).join(parts.select("_source", f"_b{t}"), F.col("source").eqNullSafe(F.col("_source")))
            taken = taken.filter(middle <= budget[t]).groupBy(F.col("source").alias("_got")).agg(F.sum("size").alias(f"_r{t}"))
            parts = parts.join(taken, F.col("_source").eqNullSafe(F.col("_got")), "left").drop("_got").withColumn(f"_r{t}", F.coalesce(f"_r{t}", F.lit(0)))
            parts = materialize(parts, f"mix-budget{t}")
            owed = owed + F.col(f"_r{t}")
    mine = F.element_at(F.array(*budget), F.col("_t") + 1)
    out = known.join(parts.select("_source", *(f"_b{t}" for t in range(3))), F.col("source").eqNullSafe(F.col("_source")))
    repeats = F.least(F.col("whole") + F.when(middle <= mine, 1).otherwise(0), F.lit(epochs))
    return out.select(F.col(key), "source", "size", "source_size", "target", (F.col("size") * repeats).cast("long").alias("taken"), repeats.cast("int").alias("repeats"), *carry)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             substring(md5('8:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
s1 AS (SELECT *, place % 3 + 1 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (SELECT *, CAST(total - coalesce(sum(3 * source_size) OVER w, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS lev,
             sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS ws
       FROM s1 WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max_by(lev, ws) FILTER (WHERE 3 * source_size > lev * weight) OVER () AS water FROM s2),
s4 AS (SELECT *, coalesce(least(CAST(3 * source_size AS DOUBLE), water * weight), CAST(3 * source_size AS DOUBLE)) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS whole,
             CAST(source_size AS DOUBLE) / n AS mean FROM s4),
k AS (SELECT d.doc_id, d.size, d.h, s5.*, target - whole * source_size AS rest,
             CASE WHEN size >= mean THEN 0 WHEN size >= mean / 4 THEN 1 ELSE 2 END AS t
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source, t ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size + size / 2.0::DOUBLE AS middle FROM k),
p AS (SELECT source, any_value(source_size) AS source_size, any_value(rest) AS rest, sum(CASE WHEN t = 0 THEN size ELSE 0 END) AS z0, sum(CASE WHEN t = 1 THEN size ELSE 0 END) AS z1 FROM c GROUP BY source),
b0 AS (SELECT *, CASE WHEN source_size > 0 THEN rest * z0 / source_size ELSE 0 END AS b0 FROM p),
r0 AS (SELECT b0.source, coalesce(sum(size), 0) AS r0 FROM b0 LEFT JOIN c ON c.source IS NOT DISTINCT FROM b0.source AND t = 0 AND middle <= b0.b0 GROUP BY b0.source),
b1 AS (SELECT b0.*, r0, CASE WHEN source_size > 0 THEN rest * (z0 + z1) / source_size ELSE 0 END - r0 AS b1 FROM b0 JOIN r0 ON b0.source IS NOT DISTINCT FROM r0.source),
r1 AS (SELECT b1.source, coalesce(sum(size), 0) AS r1 FROM b1 LEFT JOIN c ON c.source IS NOT DISTINCT FROM b1.source AND t = 1 AND middle <= b1.b1 GROUP BY b1.source),
b2 AS (SELECT b1.*, r1, CASE WHEN source_size > 0 THEN rest ELSE 0 END - (r0 + r1) AS b2 FROM b1 JOIN r1 ON b1.source IS NOT DISTINCT FROM r1.source)
SELECT doc_id, size, c.source_size, target,
  CAST(size * least(3, whole + CASE WHEN middle <= CASE t WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c JOIN b2 ON c.source IS NOT DISTINCT FROM b2.source
"""
