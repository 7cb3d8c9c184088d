"""SimHash near-duplicates with a pigeonring filter.

A document's fingerprint has 64 bits; bit b is set if more than half of its word shingles' XXH64
values have it set. Fingerprints that differ in at most ``most`` bits are linked.

Pigeonring: lay the fingerprint out as a ring of m equal segments. If two fingerprints differ in at most t
bits in all, there is a segment from which every chain of l consecutive segments differs in at most
floor(l * t / m) bits. For small l that budget is zero, so linked fingerprints agree on a whole chain of segments,
which is the join key (one for each starting segment); pairs then have to keep the budgets of all longer
chains from there before their full Hamming distance is taken.

Only distinct fingerprints are joined. A key shared by more than ``crowd`` of them isn't joined pair by
pair: inside it, each fingerprint is listed under itself and its one-bit changes in the bits outside the
chain, and those listed together are within two bits of each other and form a star. That is exact for two bits,
linear, and each list has at most one member for each bit. So no group of near copies makes quadratic work.

Cases: null or wordless texts have fingerprint zero and link like any other; texts shorter than a shingle
are one shingle; repeated rows share a fingerprint; null ids are kept, and are the component's id only
where every member's is null; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, numbered_by, read_table, slices, trimmed
from millrace.llm.components import components, local_roots, named

#: Set bits of each byte value, by bit.
BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], np.int64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as a signed 64-bit integer."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [hash_of(b" ".join(tokens), seed)]
    else:
        joined = b" ".join(tokens)
        ends = list(accumulate(len(t) + 1 for t in tokens))
        starts = [0, *ends]
        hashes = [hash_of(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :])]
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ BITS for i in range(8)])  # little-endian: bit 0 first
    value = sum(1 << b for b in range(64) if 2 * counts[b] > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp) for each row."""

    def run(batches):
        for batch in batches:
            found = pa.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[key, "fp"])

    rows = documents.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, fp long")


def ring_bits(start: int, length: int, segments: int) -> int:
    """A signed mask of ``length`` consecutive segments of the ring."""
    width = 64 // segments
    mask = 0
    for s in range(start, start + length):
        mask |= ((1 << width) - 1) << (s % segments * width)
    return mask - (1 << 64) if mask >> 63 else mask


def free_chain(segments: int, most: int) -> int:
    """How many consecutive segments the budget leaves without a difference."""
    return max(n for n in range(1, segments + 1) if n * most // segments == 0)


def chain_budgets(a: Column, b: Column, start: Column, segments: int, most: int) -> Column:
    """True if every chain from ``start`` keeps its share of the budget."""
    masks = lambda n: F.element_at(F.array(*(F.lit(ring_bits(s, n, segments)) for s in range(segments))), start + 1)
    differ = a.bitwiseXOR(b)
    lengths = [n for n in range(1, segments + 1) if n == segments or n * most // segments < (n + 1) * most // segments]
    out = F.bit_count(differ) <= most
    for n in lengths[:-1]:
        out = (F.bit_count(differ.bitwiseAND(masks(n))) <= n * most // segments) & out
    return out


def fingerprint_links(distinct: DataFrame, most: int = 2, segments: int = 16, crowd: int = 64, node: str = "fp") -> DataFrame:
    """Edges (u, v) that connect what is linked among the ``distinct`` fingerprints (fp, node); the ends are nodes."""
    if most > 2:
        raise ValueError("the exact way for crowded keys is for two bits at most")
    length = free_chain(segments, most)
    fp = F.col("fp")
    keyed = distinct.select("fp", F.col(node).alias("uid"), F.posexplode(F.array(*(fp.bitwiseAND(F.lit(ring_bits(s, length, segments))) for s in range(segments)))).alias("start", "chain"))
    counts = keyed.groupBy("start", "chain").count().filter("count > 1")
    shared = materialize(keyed.join(counts, ["start", "chain"]), "simhash-keys")
    few = shared.filter(F.col("count") <= crowd)
    other = few.select(F.col("start").alias("start2"), F.col("chain").alias("chain2"), F.col("fp").alias("fp2"), F.col("uid").alias("uid2"))
    pairs = few.join(other, (F.col("start") == F.col("start2")) & (F.col("chain") == F.col("chain2")) & (fp < F.col("fp2")) & chain_budgets(fp, F.col("fp2"), F.col("start"), segments, most))
    pairs = pairs.select(F.col("uid").alias("u"), F.col("uid2").alias("v"))
    many = shared.filter(F.col("count") > crowd)
    flips = [[1 << b if b < 63 else -(1 << 63) for b in range(64) if not (ring_bits(s, length, segments) >> b) & 1] for s in range(segments)]
    changes = F.element_at(F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(x).cast("long") for x in f)) for f in flips)), F.col("start") + 1)
    listed = many.select("fp", "uid", "start", F.explode(changes).alias("flip")).select("uid", "start", fp.bitwiseXOR(F.col("flip")).alias("near"))
    lists = listed.groupBy("start", "near").agg(F.collect_set("uid").alias("near_uids")).filter(F.size("near_uids") > 1)
    stars = lists.select(F.array_min("near_uids").alias("u"), F.explode("near_uids").alias("v")).filter("u <> v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, most: int = 2) -> DataFrame:
    """(key, fp, component_id) for each row of ``documents``; component_id is the smallest key of the component.

    Fingerprints are numbered in the order of their smallest key, so the smallest number of a component names it.
    """
    rows = materialize(fingerprints(documents, key, text, words), "simhash")
    classes = numbered_by(rows.groupBy("fp").agg(F.min(key).alias("least")), [F.col("least").asc_nulls_last(), F.col("fp").asc()], "uid", "simhash-classes")
    linked = components(fingerprint_links(classes.select("fp", "uid"), most, node="uid"))
    classes = named(classes, linked, "uid", "least", "component_id").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(classes, F.col("fp") == F.col("_fp")).select(F.col(key), "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by shingle similarity.

#: Bins of a one-permutation MinHash sketch; the share of equal bins estimates Jaccard similarity to about 0.025.
BINS = 256
#: How far below the similarity asked for an estimate may be (six standard deviations) for a pair to be compared exactly.
MARGIN = 0.15
#: Keys of a text, and MinHash minima that one key combines: texts of similarity s share no key with chance (1 - s^4)^24, 3e-6 at 0.8.
BANDS, BAND = 24, 4
#: Texts, and shingles, of about one side of a cell, in which the texts of a crowded key are compared.
SIDE, SIDE_SHINGLES = 256, 1 << 20
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
DRAWS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * BAND, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ MIX[seed]) * MIX[2]
    h ^= h >> np.uint64(31)
    h *= MIX[0]
    return h ^ (h >> np.uint64(29))


def shingle_hashes(tokens: list[bytes], words: int, known: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; ``known`` remembers hashes of words."""
    if len(known) > 500_000:
        known.clear()
    for w in set(tokens):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter((known[w] for w in tokens), np.uint64, len(tokens)) if tokens else np.zeros(1, np.uint64)
    n = min(words, len(h))
    shingles = mixed(h[: len(h) - n + 1].copy(), 0)
    for j in range(1, n):
        shingles = mixed(shingles + h[j : len(h) - n + 1 + j] * MIX[1], 1)
    return np.unique(shingles)


def sketch(h: np.ndarray) -> bytes:
    """One byte for each bin: 0 if no shingle fell there, else from the least hash."""
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    bins = (h & np.uint64(BINS - 1)).astype(np.int64)
    np.minimum.at(least, bins, h >> np.uint64(8))
    out = (least % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    full = np.zeros(BINS, bool)
    full[bins] = True
    out[~full] = 0
    return out.tobytes()


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band, equal for texts with the same minima there."""
    least = (h[:1024] * DRAWS).min(1)
    for at in range(1024, len(h), 1024):
        np.minimum(least, (h[at : at + 1024] * DRAWS).min(1), out=least)
    least = least.reshape(BANDS, BAND)
    keys = mixed(least[:, 0].copy(), 0)
    for j in range(1, BAND):
        keys = mixed(keys + least[:, j] * MIX[1], 1)
    return keys.view(np.int64)


def text_marks(documents: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, x, t1, t2, n, fp, bands, marks): a text's hashes, and the number, keys and sketch of its distinct shingles; fp is its SimHash."""

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for t in batch.column(2).to_pylist():
                data = (t or "").encode()
                digest = xxhash.xxh128_digest(data)
                h = shingle_hashes(data.lower().split(), words, known)
                values = (int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), len(h), fingerprint(t), band_keys(h), sketch(h))
                for column, value in zip(out, values):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, types))], names=["k", "x", "t1", "t2", "n", "fp", "bands", "marks"])

    rows = documents.select(F.col(key), text_hash(text), F.col(text).cast("string"))
    return rows.mapInArrow(trimmed(run), f"k {rows.schema[0].dataType.simpleString()}, x long, t1 long, t2 long, n long, fp long, bands array<long>, marks binary")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("x")


def shingle_sets(documents: DataFrame, wanted: DataFrame, text: str, words: int) -> DataFrame:
    """(uid, shingles) of the texts ``wanted`` (uid, x)."""

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_hashes((t or "").encode().lower().split(), words, known) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], names=["uid", "shingles"])

    texts = documents.select(text_hash(text), F.col(text).cast("string").alias("text")).join(wanted.withColumnRenamed("x", "_x"), F.col("x") == F.col("_x"))
    return texts.select("uid", "text").dropDuplicates(["uid"]).mapInArrow(trimmed(run), "uid long, shingles array<long>")


def similar_pairs(pairs: DataFrame, least: float) -> DataFrame:
    """The (u, v) of ``pairs`` (u, v, a, b: sketches) with an estimated similarity of at least ``least``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("a", "b"))
                used = ((a > 0) | (b > 0)).sum(1)
                same = ((a == b) & (a > 0)).sum(1)
                yield batch.select(["u", "v"]).filter(pa.array(same >= least * np.maximum(used, 1)))

    return pairs.select("u", "v", "a", "b").mapInArrow(trimmed(run), "u long, v long")


def exact_pairs(documents: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, words: int, text: str) -> DataFrame:
    """The ``pairs`` (u, v) of ``nodes`` whose whole sets of shingles have a Jaccard similarity of at least ``similarity``."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("end")).distinct()
    wanted = nodes.join(ends, F.col("uid") == F.col("end"), "left_semi").select("uid", "x")
    sets = materialize(shingle_sets(documents, wanted, text, words), "copies-sets")
    a = sets.select(F.col("uid").alias("_a"), F.col("shingles").alias("a"))
    b = sets.select(F.col("uid").alias("_b"), F.col("shingles").alias("b"))
    both = pairs.join(a, F.col("u") == F.col("_a")).join(b, F.col("v") == F.col("_b"))
    both = both.select("u", "v", (F.size("a") + F.size("b")).alias("sizes"), F.size(F.array_intersect("a", "b")).alias("shared"))
    return both.filter(F.col("shared") / (F.col("sizes") - F.col("shared")) >= similarity).select("u", "v")


def shared_shingles(sets: list[np.ndarray], rows: np.ndarray, others: np.ndarray, columns: int = 8192) -> np.ndarray:
    """How many shingles each of the sets ``rows`` shares with each of the sets ``others``: a matrix product over the shingles of several sets."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, count = np.unique(every, return_inverse=True, return_counts=True)
    several = count > 1
    number, owner = (np.cumsum(several) - 1)[number[several[number]]], owner[several[number]]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    out = np.zeros((len(rows), len(others)), np.float32)
    for first in range(0, int(several.sum()), columns):
        a, b = np.searchsorted(number, (first, first + columns))
        held = np.zeros((len(sets), columns), np.float32)
        held[owner[a:b], number[a:b] - first] = 1
        out += held[rows] @ held[others].T
    return out


def crowded_links(keys: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v), reduced to stars in each cell, between texts of different components in the keys ``keys``
    (band, value, uid, own, blocks, c, lead, rest_blocks), decided by the whole ``sets`` (uid, shingles).

    ``lead`` is the largest component of a key. The texts of the others are dealt to ``rest_blocks`` blocks, all
    texts to ``blocks``, and each two blocks meet in a cell. So every pair is seen, no task holds a whole key, and
    no pairs are listed but those that link.
    """

    def run(table: pa.Table) -> pa.Table:
        uid, c, side = (table[x].to_numpy() for x in ("uid", "c", "side"))
        rest, every = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        u = v = np.zeros(0, np.int64)
        if len(rest) and len(every) and (c != c[0]).any():
            sets = [np.asarray(x.values) for x in table["shingles"].combine_chunks()]
            n = np.array([len(x) for x in sets])
            shared = shared_shingles(sets, rest, every)
            close = shared / (n[rest][:, None] + n[every][None, :] - shared) >= similarity
            i, j = np.nonzero(close & (c[rest][:, None] != c[every][None, :]))
            u, v = uid[rest[i]], uid[every[j]]
            names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = names[local_roots(len(names), ends[: len(u)], ends[len(u) :])]
            u, v = names[root != names], root[root != names]
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    rest = F.col("c") != F.col("lead")
    mine = F.pmod(F.xxhash64("uid", F.lit("rest")), F.col("rest_blocks"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rest_blocks") - 1), lambda t: F.struct(t.alias("b"), F.col("own").alias("a"), F.lit(0).alias("side")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda t: F.struct(mine.alias("b"), t.alias("a"), F.lit(1).alias("side")))
    placed = keys.withColumn("cell", F.when(rest, F.concat(met, meets)).otherwise(met)).join(sets.withColumnRenamed("uid", "_uid"), F.col("uid") == F.col("_uid"))
    cells = placed.select("band", "value", "uid", "c", "shingles", F.explode("cell").alias("cell")).select("band", "value", "cell.*", "uid", "c", "shingles")
    return cells.groupBy("band", "value", "b", "a").applyInArrow(run, "u long, v long").distinct()


def near_copies(documents: DataFrame, similarity: float = 0.8, words: int = 5, key: str = "doc_id", text: str = "text", crowd: int = 16) -> DataFrame:
    """(key, t1, t2, component): groups of documents whose ``words``-word shingles are similar to ``similarity``.

    Candidates come from two filters. The SimHash fingerprints of ``near_duplicates`` pass the pigeonring filter, which
    gives texts with equal ones, or with ones that differ in two bits at most, as stars. Texts at ``similarity`` mostly differ in more
    bits; those share a key: ``BAND`` MinHash minima of all their shingles, in one of ``BANDS`` bands. Candidates are
    linked if the Jaccard similarity of their whole sets of shingles is at least ``similarity``; sizes and
    sketches only spare comparisons that can't reach it. Equal texts are one node. In a key with more than
    ``crowd`` different texts each is first compared with two of them, the one of the smallest uid and one drawn by
    hash. In the keys whose texts are then not all in one component, the texts outside the largest one are compared
    with all, in cells. So a group of near copies around a hub costs no more than its size in pairs, and no
    key drops a pair. component is the smallest key.
    """
    rows = materialize(text_marks(documents, key, text, words), "marks")
    same = rows.groupBy("t1", "t2").agg(F.min("k").alias("least"), *(F.first(c).alias(c) for c in ("x", "n", "fp", "bands", "marks")))
    nodes = numbered_by(same, [F.col("least").asc_nulls_last(), F.col("t1").asc(), F.col("t2").asc()], "uid", "nodes")
    marks = nodes.select(F.col("uid").alias("_w"), "marks")

    keys = nodes.select("uid", "n", F.posexplode("bands").alias("band", "value"))
    blocks = F.ceil(F.greatest(F.count("*") / SIDE, F.sum("n") / SIDE_SHINGLES))
    counts = keys.groupBy("band", "value").agg(F.count("*").alias("members"), blocks.alias("blocks"), F.min(F.struct("uid", "n")).alias("hub"), F.min(F.struct(F.xxhash64("uid"), "uid", "n")).alias("hub2")).filter("members > 1")
    shared = materialize(keys.join(counts, ["band", "value"]), "copies-keys")
    sizes = lambda a, b: F.least(a, b) / F.greatest(a, b) >= similarity
    few = shared.filter(F.col("members") <= crowd).select("band", "value", "uid", "n")
    other = few.select("band", "value", F.col("uid").alias("v"), F.col("n").alias("m"))
    pairs = few.join(other, ["band", "value"]).filter((F.col("uid") < F.col("v")) & sizes("n", "m")).select(F.col("uid").alias("u"), "v")
    many = shared.filter(F.col("members") > crowd)
    for hub in ("hub", "hub2"):
        star = many.filter((F.col("uid") != F.col(f"{hub}.uid")) & sizes("n", f"{hub}.n"))
        pairs = pairs.unionByName(star.select(F.least("uid", F.col(f"{hub}.uid")).alias("u"), F.greatest("uid", F.col(f"{hub}.uid")).alias("v")))
    prints = materialize(nodes.groupBy("fp").agg(F.min("uid").alias("first")), "copies-prints")
    near = fingerprint_links(prints, node="first").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    equal = nodes.select("uid", F.col("fp").alias("_fp")).join(prints, F.col("_fp") == F.col("fp")).filter(F.col("uid") != F.col("first")).select(F.col("first").alias("u"), F.col("uid").alias("v"))
    found = pairs.unionByName(near).unionByName(equal).distinct().join(marks, F.col("u") == F.col("_w")).withColumnRenamed("marks", "a").drop("_w").join(marks, F.col("v") == F.col("_w")).withColumnRenamed("marks", "b")
    likely = materialize(similar_pairs(found, similarity - MARGIN), "copies-pairs")
    links = materialize(exact_pairs(documents, nodes, likely, similarity, words, text), "copies-links")
    linked = components(links)

    own = F.pmod(F.xxhash64("uid"), F.col("blocks"))
    many = many.select("band", "value", "blocks", own.alias("own"), "uid", "n")
    placed = materialize(many.join(linked, F.col("uid") == F.col("node"), "left").withColumn("c", F.coalesce("component", "uid")).drop("node", "component"), "copies-crowds")
    parts = placed.groupBy("band", "value", "blocks", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    open_keys = parts.groupBy("band", "value", "blocks").agg(F.max(F.struct("m", "n", "c")).alias("most"), F.sum("m").alias("m"), F.sum("n").alias("n")).filter("m > most.m")
    rest = F.ceil(F.greatest((F.col("m") - F.col("most.m")) / SIDE, (F.col("n") - F.col("most.n")) / SIDE_SHINGLES))
    open_keys = open_keys.select("band", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("own"), F.col("most.c").alias("lead"), rest.alias("rest_blocks"))
    left = materialize(placed.join(open_keys, ["band", "value", "own"]).drop("n"), "copies-open")
    if left.head(1):
        wanted = nodes.join(left.select(F.col("uid").alias("_w")).distinct(), F.col("uid") == F.col("_w"), "left_semi").select("uid", "x")
        sets = materialize(shingle_sets(documents, wanted, text, words), "copies-crowd-sets")
        linked = components(links.unionByName(materialize(crowded_links(left, sets, similarity), "copies-crowd-links")))

    groups = named(nodes.select("uid", "t1", "t2", "least"), linked, "uid", "least", "group").select(F.col("t1").alias("_1"), F.col("t2").alias("_2"), "group")
    out = rows.select("k", "t1", "t2").join(groups, (F.col("t1") == F.col("_1")) & (F.col("t2") == F.col("_2")))
    return out.select(F.col("k").alias(key), "t1", "t2", F.col("group").alias("component"))
