"""Toxicity by classifier chains.

Categories are 0/1 label columns in a given order. Each has a logistic model over the presence of
words and word beginnings; a later model also sees the earlier categories' probabilities (as log
odds). While training, those are out-of-fold predictions, made by models that did not see the row, so
later models learn how far earlier ones can be trusted; while scoring they come from the full models.

Training reads a bounded sample: the ``sample_rows`` labelled documents with the smallest hash of their
id, equal texts once and those that begin alike in one fold. Features are counted over it in Spark, for all rows and without each
fold, and at most ``n_features`` a category that tell positive from negative rows (two-proportion z) are
fetched. Scoring reads every document whole, in Arrow batches.

Cases: a null or wordless text has no features and gets the base rate; a null label leaves its row
out for that category; a category with one class only predicts that class; an empty label table
predicts 0 for all. A document labelled twice counts twice; repeated documents get equal scores. The
input's columns are kept, results come as ``p_<category>``.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import materialize, read_table, slices, trimmed

WORDS = re.compile(r"\w+")
FOLDS = 3
#: The fewest positive rows and the least z of a feature.
LEAST_ROWS, LEAST_Z = 3, 4.0


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings of 3 to 6 letters."""
    w = word.encode()
    return tuple({zlib.crc32(b"w" + w), *(zlib.crc32(b"p" + word[:n].encode()) for n in range(3, min(6, len(word)) + 1))})


class Memo(dict):
    """Features of the words seen lately, of ``known`` ones if given; emptied when large."""

    def __init__(self, known: dict | None = None) -> None:
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        found = word_features(word)
        self[word] = found = found if self.known is None else tuple(self.known[f] for f in found if f in self.known)
        return found


def text_features(text: str | None, memo: Memo) -> set[int]:
    found: set[int] = set()
    for w in set(WORDS.findall(text.lower())) if text else ():
        if more := memo[w]:
            found.update(more)
    return found


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, steps: int = 200) -> np.ndarray:
    """Weights, the last being the intercept, of an L2-penalised logistic model (accelerated gradient descent)."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):  # largest eigenvalue of x'x
        v = x.T @ (x @ v)
        top = np.linalg.norm(v)
        v /= top or 1
    rate = 1 / (top / 4 + penalty)
    ridge = np.full(x.shape[1], penalty, x.dtype)
    ridge[-1] = 0
    w = np.zeros(x.shape[1], x.dtype)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        grad = x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - y) + ridge * ahead
        new = ahead - rate * grad
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def logit(p):
    return np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """Fitted models: for each category its features {hash: column} and weights [features, earlier log odds, intercept]."""

    def __init__(self, categories: list[str], columns: dict[int, int], models: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
        self.categories, self.columns, self.models = categories, columns, models

    def predict(self, found: list[int]) -> list[float]:
        """Probabilities, category by category, of a text with the feature columns ``found``."""
        odds: list[float] = []
        for word_weights, chain_weights, intercept in self.models:
            z = float(word_weights[found].sum()) + intercept + float(np.dot(chain_weights, odds)) if odds else float(word_weights[found].sum()) + intercept
            odds.append(float(logit(sigmoid(z))))
        return [float(sigmoid(z)) for z in odds]


def z_score(pos, neg, all_pos, all_neg):
    share = (pos + neg) / (all_pos + all_neg)
    spread = F.sqrt(share * (1 - share) * (F.lit(1.0) / all_pos + F.lit(1.0) / all_neg))
    return F.when(spread > 0, (pos / all_pos - neg / all_neg) / spread).otherwise(F.lit(0.0))


def fit_chain(documents: DataFrame, labels: DataFrame, categories: list[str], sample_rows: int = 6000, n_features: int = 800, key: str = "doc_id", text: str = "text") -> Chain:
    """Fit on at most ``sample_rows`` labelled rows of ``labels`` (key, categories)."""
    drawn = labels.filter(F.col(key).isNotNull()).select(key, *(F.col(c).cast("int").alias(f"_y{i}") for i, c in enumerate(categories)))
    drawn = drawn.withColumn("_o", F.xxhash64(F.col(key), F.lit("sample"))).orderBy("_o", key, *(f"_y{i}" for i in range(len(categories)))).limit(sample_rows)
    rows = documents.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(drawn), key)
    beginning = F.md5(F.lower(F.substring("_text", 1, 200)))
    once = rows.withColumn("_k", F.coalesce(F.md5("_text"), F.lit(""))).withColumn("_b", F.coalesce(beginning, F.lit("")))
    ys = [f"_y{i}" for i in range(len(categories))]

    def features(batches):
        memo = Memo()
        for batch in batches:
            found = [sorted(text_features(t, memo)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_k", "_b", "_o", *ys)), pa.array(found, pa.list_(pa.int64()))], names=["_k", "_b", "_o", *ys, "f"])

    shape = T.StructType([T.StructField("_k", T.StringType()), T.StructField("_b", T.StringType()), T.StructField("_o", T.LongType()), *(T.StructField(y, T.IntegerType()) for y in ys), T.StructField("f", T.ArrayType(T.LongType()))])
    once = once.groupBy("_k").agg(F.min(F.struct("_o", "_b", "_text", *ys)).alias("s")).select("_k", "s.*")
    rows = materialize(once.mapInArrow(trimmed(features), shape).withColumn("fold", F.pmod(F.xxhash64("_b"), F.lit(FOLDS)).cast("int")), "toxicity-sample")
    seen = rows.select("fold", *ys, F.explode("f").alias("h"))
    labelled = rows.groupBy("fold").agg(*(F.sum(F.when(F.col(y) == v, 1).otherwise(0)).alias(f"{y}{v}") for y in ys for v in (0, 1))).collect()
    size = {(y, v, k): sum(r[f"{y}{v}"] for r in labelled if r["fold"] != k) for y in ys for v in (0, 1) for k in (None, *range(FOLDS))}

    counts = seen.groupBy("h").agg(*(F.sum(F.when((F.col(y) == v) & (F.col("fold") == k), 1).otherwise(0)).alias(f"{y}{v}{k}") for y in ys for v in (0, 1) for k in range(FOLDS)))
    counts = materialize(counts, "toxicity-counts")
    chosen: list[dict] = []
    for y in ys:
        scores = {}
        for k in (None, *range(FOLDS)):
            if size[y, 0, k] and size[y, 1, k]:
                pos, neg = (sum((F.col(f"{y}{v}{j}") for j in range(FOLDS) if j != k), F.lit(0)) for v in (1, 0))
                z = F.abs(z_score(pos, neg, size[y, 1, k], size[y, 0, k]))
                scores[k] = F.when(F.greatest(pos, neg) >= LEAST_ROWS, z).otherwise(F.lit(0.0))
        if not scores:
            chosen.append({})
            continue
        best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
        top = counts.select("h", *(s.alias(f"z{k}") for k, s in scores.items()), best.alias("best")).filter(F.col("best") >= LEAST_Z).orderBy(F.desc("best"), "h").limit(n_features).collect()
        chosen.append({k: [r["h"] for r in top if r[f"z{k}"] >= LEAST_Z] for k in scores})
    columns = {h: i for i, h in enumerate(sorted({h for c in chosen for hs in c.values() for h in hs}))}
    kept = rows.select("fold", *ys, F.array_intersect("f", F.array(*(F.lit(h).cast("long") for h in columns)) if columns else F.array().cast("array<bigint>")).alias("f")) if len(columns) < 200 else rows.select("fold", *ys, "f")
    if len(columns) >= 200:
        wanted = rows.sparkSession.createDataFrame([(h,) for h in columns], "h long")
        kept = rows.select("_k", "fold", *ys, F.explode_outer("f").alias("h")).join(F.broadcast(wanted.withColumn("in", F.lit(True))), "h", "left")
        kept = kept.groupBy("_k", "fold", *ys).agg(F.collect_list(F.when(F.col("in"), F.col("h"))).alias("f"))
    table = kept.select("fold", *ys, "f").toPandas()  # at most sample_rows rows
    fold = table["fold"].to_numpy(int)
    x = np.zeros((len(table), len(columns)), np.float32)
    for i, hs in enumerate(table["f"]):
        x[i, [columns[h] for h in hs]] = 1

    models, earlier = [], np.zeros((len(table), 0), np.float32)
    for n, y in enumerate(ys):
        target = table[y].to_numpy(float)
        known = ~np.isnan(target)

        def fit(rows_in, names):
            use = [columns[h] for h in names]
            full = np.zeros(len(columns), np.float32)
            t = (target[rows_in] > 0).astype(np.float32)
            if not len(t) or t.min() == t.max():
                return full, np.zeros(earlier.shape[1], np.float32), 9.0 if len(t) and t[0] else -9.0
            w = fit_logistic(np.hstack([x[rows_in][:, use], earlier[rows_in] / 4]), t)
            full[use] = w[: len(use)]
            return full, w[len(use) : -1] / 4, float(w[-1])

        models.append(fit(known, chosen[n].get(None, [])))
        if n + 1 < len(ys):
            odds = np.zeros(len(table), np.float32)
            for k in range(FOLDS):
                held = fold == k
                word_weights, chain_weights, intercept = fit(known & ~held, chosen[n].get(k, []))
                odds[held] = logit(sigmoid(x[held] @ word_weights + earlier[held] @ chain_weights + intercept))
            earlier = np.hstack([earlier, odds[:, None]])
    return Chain(list(categories), columns, models)


def score(documents: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``documents`` with ``p_<category>`` for each category of the chain."""
    names = documents.columns
    results = [f"p_{c}" for c in chain.categories]
    kept = documents.drop(*results)
    shape = T.StructType([*kept.schema.fields, *(T.StructField(r, T.DoubleType()) for r in results)])
    place = [c for c in names if c not in results].index(text)

    def run(batches):
        memo = Memo(chain.columns)
        for batch in slices(batches):
            found = [chain.predict(sorted(text_features(t, memo))) for t in batch.column(place).to_pylist()]
            added = [pa.array([p[i] for p in found], pa.float64()) for i in range(len(results))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=shape.names)

    return kept.mapInArrow(trimmed(run), shape)


def toxicity(documents: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), reject: str = "toxic", threshold: float = 0.5, **fit) -> DataFrame:
    """``documents`` with a probability for each category and ``rejected``."""
    return score(documents, fit_chain(documents, labels, list(categories), **fit)).withColumn("rejected", F.col(f"p_{reject}") >= threshold)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(documents, read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), F.col("rejected").cast("int").alias("toxic"))
