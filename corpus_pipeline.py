"""A corpus pipeline in stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

toxicity: documents that the classifier chain rejects go. simhash: of each group of equal or near-equal
texts (five-word shingles, similarity 0.8; candidates by SimHash fingerprints through the pigeonring filter and by MinHash
keys, decided exactly) the document with the smallest id stays. decontamination:
documents that hold a copy of a test item go. mixing: sources are brought to their targets, so documents
are dropped or repeated. sharding: the result is dealt to 40 shards by bytes, with a slot for each row.

Rows are told apart by the file and place they are read from, so documents with null, equal or no ids are
kept apart; where ``docs`` is not read from files, rows are numbered in a table written first. Each stage takes
the columns of ``documents`` by name and drops others, of whatever names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, decontamination, mixing, sharding, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``_row`` that no other row has and every read gives again."""
    try:
        at = docs.select(*COLUMNS, F.concat_ws(":", F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.row_index")).alias("_row"))
        at.schema
        return at
    except AnalysisException:
        return common.materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().cast("string").alias("_row")), "numbered")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of ``toxic`` is below 0.5; null and empty texts are scored like any other, repeated rows alike."""
    docs = docs.select(COLUMNS)
    labels = common.read_table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, labels).filter(~F.col("rejected")).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id; of null ids, or repeated rows, any one. Null and empty texts are equal."""
    docs = _numbered(docs)
    named = docs.select("text", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("name"))
    groups = simhash.near_copies(named, key="name")
    gone = groups.filter(F.col("name") != F.col("component")).select(F.col("name._row").alias("_gone"))
    return docs.join(gone, F.col("_row") == F.col("_gone"), "left_anti").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item; null and empty texts hold none."""
    return decontamination.clean(docs.select(COLUMNS), common.read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, dropped or repeated up to three times, so that sources reach their targets; null is a source, documents without words go."""
    docs = _numbered(docs)
    taken = mixing.mix(docs, carry=["_row"]).filter("repeats > 0").select(F.col("_row").alias("_taken"), "repeats")
    mixed = docs.join(taken, F.col("_row") == F.col("_taken"))
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "repeats"))).select(COLUMNS)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``size``, ``shard`` (0 to 39) and ``slot``; null texts count 16 bytes."""
    docs = _numbered(docs)
    placed = sharding.reshard(sharding.document_rows(docs, carry=["_row"])).select(F.col("_row").alias("_placed"), "shard", "slot", "size")
    return docs.join(placed, F.col("_row") == F.col("_placed")).select(*COLUMNS, "size", "shard", "slot")


STAGES = [("toxicity", drop_toxic), ("simhash", drop_copies), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", deal_shards)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again by the next."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
