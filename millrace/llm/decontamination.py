"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-case runs of letters and digits (a run of text without spaces is one word), so case, white space
and punctuation do not matter. A word n-gram is a 64-bit hash. The steps, each a table:

1. The test items' grams, and a Bloom filter of them.
2. A scan of all documents counts in how many each of these grams occurs.
3. Seeds: an item's grams that are in few documents, or in no more than the median of its grams is (so an item
   copied into very many documents keeps seeds).
4. A second scan cuts out the regions around seeds; their seeds are joined with the items' by hash, and seeds of
   one item on nearby diagonals give a passage.
5. Passage and item are aligned by words (match 2, mismatch -1, gap -1); the score over the best one possible
   is 1 for a copy and about 0.7 with a fifth of the words replaced.

The documents are read twice, however many items there are. Executors are sent a filter of at most 16 MB, which only
saves work: what it lets through wrongly meets nothing in the joins. Items, counts and seeds stay distributed.

Cases: null or wordless texts and items match nothing; items shorter than an n-gram are matched by
all their words in a row; null ids come back null; repeated rows come back repeated; an item listed
twice is reported under each id; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import materialize, read_table, trimmed

TOKEN = re.compile(r"[^\W_]+")


#: ASCII letters and digits as they are, other bytes as spaces: for ASCII texts what TOKEN finds, four times as fast.
SPACED = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return text.encode().translate(SPACED).decode().split() if text.isascii() else TOKEN.findall(text)


def smith_waterman(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Best local alignment of two integer sequences: (score, first, last + 1) in ``b``."""
    across = np.arange(len(b) + 1) * -gap
    row, start = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    best = (0, 0, 0)
    for x in a:
        diagonal = row[:-1] + np.where(b == x, match, mismatch)
        down = row[1:] + gap
        new, begin = np.zeros_like(row), np.arange(len(b) + 1)
        new[1:] = np.maximum(0, np.maximum(diagonal, down))
        begin[1:] = np.where(new[1:] == 0, begin[1:], np.where(diagonal >= down, start[:-1], start[1:]))
        lifted = new + across  # a run of gaps from k to j costs across[j] - across[k]
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(len(b) + 1), 0))
        row, start = top - across, begin[source]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(start[j]), j)
    return best


#: Odd multipliers of the gram hash.
STEP, STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Slots of the table of region widths.
SLOTS = 1 << 16


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(numbers: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words; runs of other lengths have other hashes."""
    m = max(0, len(numbers) - n + 1)
    code = np.full(m, n, np.uint64)
    for k in range(n):
        code = code * STEP + numbers[k : k + m]
    code ^= code >> np.uint64(31)
    code *= STIR
    return code ^ (code >> np.uint64(29))


class Filter:
    """A Bloom filter of gram hashes, and by slot of the hash the longest item that has the gram."""

    def __init__(self, bits: int) -> None:
        self.mask, self.bytes, self.widths = np.uint64(bits - 1), np.zeros(bits >> 3, np.uint8), np.zeros(SLOTS, np.int64)

    def places(self, codes: np.ndarray):
        return ((codes >> np.uint64(shift)) & self.mask for shift in (0, 18, 36))

    def add(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        for place in self.places(codes):
            np.bitwise_or.at(self.bytes, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        np.maximum.at(self.widths, codes & np.uint64(SLOTS - 1), sizes)

    def merge(self, data: bytes, widths: bytes) -> None:
        self.bytes |= np.frombuffer(data, np.uint8)
        self.widths = np.maximum(self.widths, np.frombuffer(widths, np.int64))

    def has(self, codes: np.ndarray) -> np.ndarray:
        """Where the gram may be in; those outside are left after the first probe that misses."""
        left = np.arange(len(codes))
        for shift in (0, 18, 36):
            place = (codes[left] >> np.uint64(shift)) & self.mask
            left = left[(self.bytes[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return left


def filter_of(grams: DataFrame, filter_bits: int) -> Filter:
    """The filter of the grams in (g, size): at most 16 tasks make one each, the driver adds one after the other."""
    wanted = 1 << max(16, math.ceil(math.log2(max(1, 64 * grams.count()))))
    bits = min(wanted, filter_bits)

    def make(batches):
        part = Filter(bits)
        for batch in batches:
            part.add(batch.column("g").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("size").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([part.bytes.tobytes()], pa.binary()), pa.array([part.widths.tobytes()], pa.binary())], names=["bits", "widths"])

    out = Filter(bits)
    for row in grams.select("g", "size").coalesce(16).mapInArrow(make, "bits binary, widths binary").toLocalIterator():
        out.merge(row[0], row[1])
    return out


def _hits(texts: list, lengths: list[int], wanted: Filter):
    """(word hashes, first word of each text, hits' texts, places and hashes) of some texts laid end to end."""
    words = [tokens(t) for t in texts]
    ends = np.cumsum([len(w) for w in words])
    firsts = ends - [len(w) for w in words]
    numbers = word_hashes([w for found in words for w in found])
    owner = np.repeat(np.arange(len(texts)), ends - firsts)
    at, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in lengths:
        grams = gram_hashes(numbers, n)
        inside = wanted.has(grams)
        inside = inside[inside + n <= ends[owner[inside]]]
        at.append(inside)
        codes.append(grams[inside])
    at, codes = np.concatenate(at), np.concatenate(codes)
    return numbers, firsts, ends, owner[at], at, codes


def _runs(batches, text: int, characters: int = 1 << 20):
    """Rows of batches as lists of columns, cut where a million characters are full."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        first = held = 0
        for j, t in enumerate(columns[text]):
            held += len(t or "")
            if held >= characters or j == batch.num_rows - 1:
                yield [c[first : j + 1] for c in columns]
                first, held = j + 1, 0


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """(i, size, g, places): the different grams of (i, words as bytes), an item's own few words if it is shorter."""

    def split(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for i, data in zip(batch.column("i").to_pylist(), batch.column("words").to_pylist()):
                words = np.frombuffer(data, np.uint64)
                codes = gram_hashes(words, min(n, len(words)))
                order = np.argsort(codes, kind="stable")
                unique, start = np.unique(codes[order], return_index=True)
                for g, places in zip(unique.view(np.int64).tolist(), np.split(order, start[1:])):
                    for column, value in zip(rows, (i, len(words), g, places.tolist())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.list_(pa.int64()))], names=["i", "size", "g", "places"])

    return items.select("i", "words").mapInArrow(split, "i long, size long, g long, places array<long>")


def contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.6, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_items: int | None = None, filter_bits: int = 1 << 27) -> DataFrame:
    """(key, text_md5, item, score, first_word, last_word): passages of ``documents`` that are copies of test items.

    Words are numbered from 0 in the document. ``text_md5`` tells documents apart that share an id.
    ``filter_bits`` (a power of two) bounds the filter sent to executors. ``block_items`` has no effect any more.
    """
    key_type = documents.schema[key].dataType.simpleString()

    def number(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([word_hashes(tokens(t)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["_i", "_w"])

    listed = materialize(benchmark.select(F.monotonically_increasing_id().alias("i"), F.col(item).alias("id"), F.col(item_text).cast("string").alias("t")), "items")
    words = listed.select("i", "t").mapInArrow(number, "_i long, _w binary").filter(F.length("_w") > 0)
    items = materialize(listed.join(words, F.col("i") == F.col("_i")).select("i", "id", F.col("_w").alias("words")), "item-words")
    grams = materialize(item_grams(items, n), "item-grams")
    lengths = sorted({min(n, r[0]) for r in grams.filter(F.col("size") < n).select("size").distinct().collect()} | {n})  # at most n
    rows = documents.select(F.col(key), F.col(text).cast("string"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))

    known = filter_of(grams, filter_bits)

    def count(batches):
        for (texts,) in _runs(batches, 0):
            _, _, _, owner, _, codes = _hits(texts, lengths, known)
            if not len(codes):
                continue
            order = np.lexsort((owner, codes))
            owner, codes = owner[order], codes[order]
            new = np.append(True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1]))
            unique, times = np.unique(codes[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(times.astype(np.int64))], names=["_g", "c"])

    counts = rows.select(text).mapInArrow(trimmed(count), "_g long, c long").groupBy("_g").agg(F.sum("c").alias("c"))
    counted = materialize(grams.join(counts, F.col("g") == F.col("_g"), "left").select("i", "size", "g", "places", F.coalesce("c", F.lit(0)).alias("c")), "gram-counts")
    few = 50 + documents.count() // 10_000
    middle = counted.groupBy(F.col("i").alias("_i")).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY c)").alias("_middle"))
    rare = counted.join(middle, F.col("i") == F.col("_i")).filter((F.col("c") > 0) & ((F.col("c") <= few) | (F.col("c") <= F.col("_middle"))))
    seeds = materialize(rare.select("i", "size", F.col("g").alias("_g"), "places"), "seeds")

    wanted = filter_of(seeds.withColumnRenamed("_g", "g"), filter_bits)

    def cut(batches):
        for keys, texts, md5s in _runs(batches, 1):
            numbers, firsts, ends, owner, at, codes = _hits(texts, lengths, wanted)
            out: list[list] = [[] for _ in range(6)]
            order = np.lexsort((at, owner))
            owner, at, codes = owner[order], at[order], codes[order]
            reach = 2 * wanted.widths[codes & np.uint64(SLOTS - 1)] + 4
            low, high = np.maximum(at - reach, firsts[owner]), np.minimum(at + reach, ends[owner])
            first = 0
            a, b = (low[0], high[0]) if len(at) else (0, 0)
            for j in range(1, len(at) + 1):
                if j < len(at) and owner[j] == owner[first] and low[j] <= b:
                    a, b = min(a, low[j]), max(b, high[j])
                    continue
                o = owner[first]
                by_gram: dict[int, list[int]] = {}
                for g, p in zip(codes[first:j].view(np.int64).tolist(), (at[first:j] - firsts[o]).tolist()):
                    by_gram.setdefault(g, []).append(p)
                for column, value in zip(out, (keys[o], md5s[o], int(a - firsts[o]), numbers[a:b].tobytes(), list(by_gram), list(by_gram.values()))):
                    column.append(value)
                if j < len(at):
                    first, a, b = j, low[j], high[j]
            types = [types_of_key, pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["k", "text_md5", "a", "part", "gs", "ps"])

    types_of_key = to_arrow_type(documents.schema[key].dataType)
    regions = rows.mapInArrow(trimmed(cut), f"k {key_type}, text_md5 string, a long, part binary, gs array<long>, ps array<array<long>>")
    regions = materialize(regions.withColumn("r", F.monotonically_increasing_id()), "seed-regions")
    hits = regions.select("r", F.explode(F.arrays_zip("gs", "ps")).alias("h")).select("r", F.col("h.gs").alias("g"), F.col("h.ps").alias("at"))
    met = hits.join(seeds, F.col("g") == F.col("_g")).groupBy(F.col("r").alias("_r"), F.col("i").alias("_i")).agg(F.collect_list(F.struct("at", "places")).alias("met"))
    pairs = met.join(regions.select("r", "k", "text_md5", "a", "part"), F.col("_r") == F.col("r")).join(items, F.col("_i") == F.col("i"))

    def align(batches):
        for batch in batches:
            kept, scores, firsts, lasts = [], [], [], []
            for j, (a, part, data, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "part", "words", "met")))):
                words, passage = np.frombuffer(data, np.uint64), np.frombuffer(part, np.uint64)
                for start, end in stretches(found, a, len(words), len(passage)):
                    if np.isin(words, passage[start:end]).sum() < least * len(words):
                        continue  # an alignment scores 2 at most for each of the item's words that is there
                    score, first, last = smith_waterman(words, passage[start:end])
                    if score >= least * 2 * len(words):
                        for column, value in zip((kept, scores, firsts, lasts), (j, round(score / (2 * len(words)), 4), a + start + first, a + start + last - 1)):
                            column.append(value)
            taken = batch.select(["k", "text_md5", "id"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(scores, pa.float64()), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64())], names=[key, "text_md5", item, "score", "first_word", "last_word"])

    item_type = benchmark.schema[item].dataType.simpleString()
    tasks = max(documents.sparkSession.sparkContext.defaultParallelism, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.select("k", "text_md5", "id", "a", "part", "words", "met", "_r").repartition(tasks, "_r").drop("_r")  # aligning takes time, not bytes
    return pairs.mapInArrow(trimmed(align), f"`{key}` {key_type}, text_md5 string, `{item}` {item_type}, score double, first_word long, last_word long")


def stretches(met: list[dict], start: int, size: int, length: int):
    """(first, last + 1) in a region, which starts at word ``start``, of where an item of ``size`` words may lie:
    diagonals of seeds at most ``slack`` apart make one stretch."""
    slack = max(4, size // 2)
    diagonals = np.unique(np.concatenate([np.unique(np.subtract.outer(m["at"], m["places"])) for m in met])) - start
    for run in np.split(diagonals, np.flatnonzero(np.diff(diagonals) > slack) + 1):
        yield max(0, int(run[0]) - slack), min(length, int(run[-1]) + size + slack)


def clean(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``documents`` without those that hold a copy of a test item."""
    found = contaminated(documents, benchmark, key=key, text=text, **options).select(F.col(key).alias("_k"), F.col("text_md5").alias("_m")).distinct()
    md5 = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = documents.select(F.struct("*").alias("_document"), F.col(key).alias("_key"), md5.alias("_md5"))
    return rows.join(found, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_md5") == F.col("_m")), "left_anti").select("_document.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "first_word", "last_word")
