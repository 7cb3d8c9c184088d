"""Full-text search: tokens, postings, TF-IDF scores for any (OR) or all (AND) terms.

An index is two DataFrames: postings (term, doc, tf) and documents (doc, length); ``store`` writes them once, sorted
by term, and ``load`` reads them, so the filter of a search on ``term`` skips all other terms. Each text is scanned
once: lengths are sums over the postings. ``remove`` and ``update`` take documents out of an index or replace them. Documents without tokens do not count in N.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values, without repeats: English stop words, and Chinese ones of one character.
ENGLISH_STOP_WORDS = (
    "a about after all also am an and any are as at be because been before being both but by can could did do does each for "
    "from had has have he her here him his how i if in into is it its just may might more most must my no not now of on only or "
    "other our out over same shall she should so some such than that the their them then there these they this through to up "
    "very was we were what when where which who why will with would you your"
).split()
CHINESE_STOP_WORDS = list("的了在是我有和就不人都一上也很到说要去你会着看好这那个们中来为能对生于子得出以里后自大多然可下")

#: Around an ASCII word: no letter, digit or underscore.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
ENGLISH = f"{BEFORE}[a-zA-Z]++{AFTER}"
CHINESE = r"[㐀-䶿一-鿿]"


#: Bytes of a file that one task reads by default.
SPLIT = 1 << 27


def words(text: Column, mode: str) -> Column:
    """English words in their own case, then single Chinese characters, stop words included."""
    english, chinese = (F.regexp_extract_all(text, F.lit(p), 0) for p in (ENGLISH, CHINESE))
    return {"english": english, "chinese": chinese, "mixed": F.concat(english, chinese)}[mode]


def kept(term: Column, stop_words: list[str] | None) -> Column:
    stops = [*ENGLISH_STOP_WORDS, *CHINESE_STOP_WORDS] if stop_words is None else stop_words
    return ~term.isin(stops) if stops else F.lit(True)


def tokens(text: Column, mode: str = "mixed", stop_words: list[str] | None = None) -> Column:
    """The tokens of a text in order, repeats included: words in lower case, then single Chinese characters."""
    lower = F.transform(words(text, mode), F.lower)
    return F.coalesce(F.filter(lower, lambda t: kept(t, stop_words)), F.array().cast("array<string>"))


def has_term_sql(text: str, term: str) -> str:
    """SQL that is true if ``term``, a token, is one of the text's; ``text`` is an SQL expression."""
    return f"contains({text}, '{term}')" if re.fullmatch(CHINESE, term) else f"{text} RLIKE '{BEFORE}(?i:{term}){AFTER}'"


@dataclass
class TextIndex:
    postings: DataFrame
    documents: DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if it is smaller than one split of a file, which one task would read."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(spark.sparkContext.defaultParallelism) if size < SPLIT else df


def build(df: DataFrame, doc: str, text: str, mode: str = "mixed", stop_words: list[str] | None = None) -> TextIndex:
    """Index ``text`` by ``doc``. Null and tokenless texts have no postings."""
    listed = spread(df.select(F.col(doc).alias("doc"), F.col(text).alias("text")))
    listed = listed.select("doc", F.explode(words(F.col("text"), mode)).alias("term")).select("doc", F.lower("term").alias("term"))
    return of_postings(listed.filter(kept(F.col("term"), stop_words)).groupBy("term", "doc").agg(F.count("*").alias("tf")))


def of_postings(postings: DataFrame) -> TextIndex:
    return TextIndex(postings, postings.groupBy("doc").agg(F.sum("tf").alias("length")))


def store(index: TextIndex, path: str) -> None:
    """Write an index: postings in the order of terms, and documents in that of their ids."""
    index.postings.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.parquet(f"{path}/postings")
    lengths = of_postings(index.postings.sparkSession.read.parquet(f"{path}/postings")).documents
    lengths.repartitionByRange("doc").sortWithinPartitions("doc").write.parquet(f"{path}/documents")


def load(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents"))


def remove(index: TextIndex, docs: DataFrame) -> TextIndex:
    """The index without the documents ``docs`` (doc)."""
    gone = docs.select(F.col("doc").alias("_gone")).distinct()
    return TextIndex(*(part.join(gone, F.col("doc") == F.col("_gone"), "left_anti") for part in (index.postings, index.documents)))


def update(index: TextIndex, df: DataFrame, doc: str, text: str, mode: str = "mixed") -> TextIndex:
    """The index with the documents of ``df`` in place of those of the same id; new ids are added."""
    kept, new = remove(index, df.select(F.col(doc).alias("doc"))), build(df, doc, text, mode)
    return TextIndex(kept.postings.unionByName(new.postings), kept.documents.unionByName(new.documents))


def document_terms(index: TextIndex, doc) -> DataFrame:
    """(term, tf) of a document."""
    return index.postings.filter(F.col("doc") == doc).select("term", "tf")


def document_frequency(index: TextIndex) -> DataFrame:
    return index.postings.groupBy("term").agg(F.count("*").alias("df"))


def statistics(index: TextIndex) -> DataFrame:
    """One row: num_terms, num_documents, total_postings, avg_doc_length."""
    of_terms = index.postings.agg(F.count_distinct("term").alias("num_terms"), F.count("*").alias("total_postings"))
    of_documents = index.documents.agg(F.count("*").alias("num_documents"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_doc_length"))
    return of_terms.crossJoin(of_documents).select("num_terms", "num_documents", "total_postings", "avg_doc_length")


def query_terms(spark, query: str, mode: str = "mixed") -> list[str]:
    """The distinct tokens of a query."""
    return spark.range(1).select(F.array_distinct(tokens(F.lit(query), mode))).first()[0]


def search(index: TextIndex, query: str, every: bool = False, mode: str = "mixed") -> DataFrame:
    """(doc, score) of documents with any of the query's terms, or with every one.

    A term scores ln(1 + tf) / length x ln(1 + N / df). A term no document has makes an AND search empty.
    """
    terms = query_terms(index.postings.sparkSession, query, mode)
    hits = index.postings.filter(F.col("term").isin(terms)) if terms else index.postings.limit(0)
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    size = index.documents.agg(F.count("*").alias("n"))
    scored = hits.join(F.broadcast(frequency), "term").join(index.documents, "doc").crossJoin(F.broadcast(size))  # a row for each query term; one row
    score = F.log(1 + F.col("tf")) / F.col("length") * F.log(1 + F.col("n") / F.col("df"))
    summed = scored.groupBy("doc").agg(F.sum(score).alias("score"), F.count("*").alias("matched"))
    return (summed.filter(F.col("matched") == len(terms)) if every else summed).select("doc", "score")


def match_against(df: DataFrame, doc: str, columns: list[str], query: str, boolean: bool = False, limit: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``columns`` match, with ``score``; best first if limited."""
    texts = df.select(F.col(doc), F.concat_ws("\n", *columns).alias("_text"))
    scores = search(build(texts, doc, "_text"), query, boolean)
    rows = df.join(scores, F.col(doc) == F.col("doc")).drop("doc") if doc != "doc" else df.join(scores, "doc")
    return rows.orderBy(F.desc("score"), doc).limit(limit) if limit else rows
