"""Suffix arrays, SimHash, components, embeddings: against brute force, and odd inputs."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import embeddings, simhash, suffix_dedup
from millrace.llm.components import components

WIDTH = suffix_dedup.WIDTH


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=300), st.integers(1, 6))
def test_suffix_array_and_kasai(values, times):
    t = np.array(values * times, np.uint8)
    raw = t.tobytes()
    order = sorted(range(len(raw)), key=lambda i: raw[i:])
    sa = suffix_dedup.suffix_array(t)
    assert sa.tolist() == order
    common = suffix_dedup.kasai(t, sa, np.array([0]), np.array([len(t)]))
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert common[b] == min(n, WIDTH)


def removed_by_brute_force(texts):
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - WIDTH + 1):
            w = r[i : i + WIDTH]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - WIDTH + 1):
            if seen[r[i : i + WIDTH]] > 1:
                gone[i : i + WIDTH] = b"\1" * WIDTH
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(5)]
    texts = [None, "", "a" * 700, "xy" * 300, "k" * 199, "k" * 199, "q" * 200, "q" * 200, "0123456789" * 19 + "abcdefghij", "z" + "0123456789" * 19 + "abcdefghijk"]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(3)]
        texts.append(parts[0] + rng.choice(passages) + parts[1] + rng.choice(passages)[rng.randint(0, 40) :] + parts[2])
    return texts + texts[12:15]


@pytest.mark.parametrize("shard_bytes", [1 << 21, 2000])
def test_repeats_are_removed_as_by_brute_force(spark, monkeypatch, shard_bytes):
    """Whole shards, and tiny ones, so shards are merged."""
    ranges = suffix_dedup.repeated_ranges
    monkeypatch.setattr(suffix_dedup, "repeated_ranges", lambda s: ranges(s, shard_bytes))
    texts = corpus(shard_bytes)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tk", F.lit("x")).repartition(3)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert [found[i] for i in range(len(texts))] == removed_by_brute_force(texts)


def test_suffix_dedup_of_repeated_rows_and_nothing(spark):
    text = "lorem ipsum " * 30
    df = spark.createDataFrame([(1, text), (1, text), (None, "short")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["n_spans"]) for r in suffix_dedup.suffix_dedup(df).collect()) == [(0, 0, 0), (1, 360, 1), (1, 360, 1)]
    assert suffix_dedup.suffix_dedup(df.limit(0)).collect() == []


def test_long_texts_are_cut_in_slices():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 50_000).astype(np.uint8)
    offsets = np.array([0, 40_000, 40_100, 50_000])
    windows = {}
    for size in (1 << 19, 3000):
        got = set()
        for text, first, n, h in suffix_dedup.text_runs(data, offsets, size):
            got |= {(int(t), int(f) + k, int(x)) for t, f, m, x in zip(text, first, n, h) for k in range(int(m))}
        windows[size] = got
    assert windows[1 << 19] == windows[3000] and len(windows[3000]) == (40_000 - 199) + (9_900 - 199)


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark):
    rng = random.Random(4)
    base = [" ".join("".join(rng.choices("abcdef", k=4)) for _ in range(60)) for _ in range(30)]
    texts = [None, "", " \t\n", "one", "One", "two words", "Ünï Code Wörds", *base]
    for t in base[:12]:
        words = t.split()
        words[rng.randrange(60)] = "edit"
        texts += [" ".join(words), t.upper(), t]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    found = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(df).collect()}
    fps = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: f & (1 << 64) - 1 for i, (f, _) in found.items()} == fps
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {i: c for i, (_, c) in found.items()} == union(fps, links)
    spark_hash = spark.sql("SELECT xxhash64('a b c')").first()[0] & (1 << 64) - 1
    assert spark_hash == xxhash.xxh64_intdigest(b"a b c", 42)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("crowd", [4, 64])
def test_crowded_fingerprints_lose_no_link(spark, crowd):
    rng = random.Random(crowd)
    center, values = rng.getrandbits(64), set()
    for _ in range(250):
        v = center
        for _ in range(rng.randint(0, 6)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    edges = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), crowd=crowd)
    found = dict(map(tuple, components(edges).collect()))
    links = [(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 2]
    assert {s: found.get(s, s) for s in signed} == union(signed, links)


def test_pigeonring_bounds():
    for segments in (8, 16):
        n = simhash.free_chain(segments, 2)
        rng = random.Random(segments)
        for _ in range(300):
            x = (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            assert any(not x & (simhash.ring_bits(s, n, segments) & (1 << 64) - 1) for s in range(segments))


def test_near_copies_by_shingles(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [[word() for _ in range(200)] for _ in range(25)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:20]):
        edited = list(w)
        for k in range(2):
            edited[40 + 90 * k] = "changed"
        rows.append((100 + i, " ".join(edited)))
    rows += [(200, rows[0][1]), (201, None), (202, "")]
    found = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[100 + i] == i for i in range(20)) and found[200] == 0 and found[202] == 201
    assert len(set(found.values())) == 26


def shingle_similarity(a, b, words=5):
    a, b = ({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def same_component(found, exact):
    roots = union(list(found), exact)
    return {frozenset(k for k in found if found[k] == c) for c in found.values()} == {frozenset(k for k in roots if roots[k] == c) for c in roots.values()}


def test_near_copies_by_fingerprints(spark, monkeypatch):
    """Without a shared MinHash key the pigeonring filter finds texts within two bits; those below the similarity stay apart."""
    rng = random.Random(11)
    rows, pairs = [], []
    while len(pairs) < 6:
        words = [f"w{rng.randrange(5000)}" for _ in range(1500)]
        other = [*words[:-1], "changed"]
        bits = (simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(" ".join(other))).bit_count()
        if bits <= 2 and (bits or len(pairs) < 3):
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    alone = [(900, "lone " * 3000 + "a b c d e f g"), (901, "lone " * 3000 + "h i j k l m n")]
    assert simhash.fingerprint(alone[0][1]) == simhash.fingerprint(alone[1][1])

    def no_keys(h):
        return np.random.default_rng(int(h.sum() % np.uint64(1 << 32))).integers(-(1 << 62), 1 << 62, simhash.BANDS)

    monkeypatch.setattr(simhash, "band_keys", no_keys)
    df = spark.createDataFrame(rows + alone, "doc_id long, text string")
    found = {r["doc_id"]: r["component"] for r in simhash.near_copies(df).collect()}
    assert all(found[b] == a for a, b in pairs) and found[900] == 900 and found[901] == 901


def test_near_copies_of_one_vocabulary(spark):
    """Orderings of one text's blocks share all words; each has one near copy."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(240)]
    blocks = [words[i : i + 6] for i in range(0, len(words), 6)]
    rows = []
    for i in range(60):
        order = [w for b in rng.sample(blocks, len(blocks)) for w in b]
        edited = list(order)
        edited[120] = "changed"
        rows += [(i, " ".join(order)), (100 + i, " ".join(edited))]
    found = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == found[100 + i] == i for i in range(60))


def test_near_copies_in_crowded_keys(spark):
    """Texts of one template share keys and hubs but only their own near copies are linked."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    template = [word() for _ in range(150)]
    rows = []
    for i in range(40):
        own = template + [word() for _ in range(50)]
        edited = list(own)
        edited[180] = "changed"
        rows += [(i, " ".join(own)), (100 + i, " ".join(edited))]
    found = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), crowd=4).collect()}
    exact = [(a, b) for a, s in rows for b, t in rows if a < b and shingle_similarity(s, t) >= 0.8]
    assert len(exact) >= 40 and same_component(found, exact)


@pytest.mark.parametrize("kind", ["replaced", "appended", "deleted"])
def test_near_copies_above_the_limit(spark, kind):
    """No pair just above the similarity is lost, by any kind of edit."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for i in range(120):
        base = [word() for _ in range(400)]
        edited = list(base)
        while True:
            further = list(edited)
            if kind == "replaced":
                further[rng.randrange(400)] = word()
            elif kind == "appended":
                further.append(word())
            else:
                further = base[: len(edited) - 1]
            if shingle_similarity(" ".join(base), " ".join(further)) < 0.8:
                break
            edited = further
        rows += [(i, " ".join(base)), (1000 + i, " ".join(edited))]
    found = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    exact = [(i, 1000 + i) for i in range(120) if shingle_similarity(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.8]
    assert len(exact) == 120 and all(found[a] == found[b] for a, b in exact)


@pytest.mark.parametrize("kind", ["replaced", "appended", "deleted"])
def test_near_copies_at_the_limit(spark, kind):
    """Pairs just above and below the similarity are told apart, by every kind of edit."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for i in range(120):
        base = [word() for _ in range(400)]
        edited = list(base)
        least = 0.8 if i % 2 else 0.77
        while True:
            further = list(edited)
            if kind == "replaced":
                further[rng.randrange(400)] = word()
            elif kind == "appended":
                further.append(word())
            else:
                further = base[: len(edited) - 1]
            if shingle_similarity(" ".join(base), " ".join(further)) < least:
                break
            edited = further
        rows += [(i, " ".join(base)), (1000 + i, " ".join(edited))]
    found = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    exact = [(i, 1000 + i) for i in range(120) if shingle_similarity(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.8]
    assert 60 <= len(exact) < 120 and same_component(found, exact)


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(200, 300)]
    edges = spark.createDataFrame([*path, *hub, (7, 7), (None, 3), (150, 100), (150, 100)], "u long, v long")
    found = dict(map(tuple, components(edges).collect()))
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[i] == 5 for i in (5, *range(200, 300))) and 7 not in found
    assert components(edges.limit(0)).collect() == []


def vectors(rng, n):
    centers = rng.normal(size=(n // 6, 32))
    return [(centers[i % len(centers)] + rng.normal(size=32) * 0.12 * (i % 3)).tolist() for i in range(n)]


def test_embedding_links_and_classes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(rng, 600))]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(5)] + [(2000 + i, rows[0][1], 0) for i in range(20)]
    odd = [(3000, None, 0), (3001, [0.0] * 32, 0), (3002, [float("nan")] * 32, 0), (3003, [None] * 32, 0), (3004, rows[0][1], None), (3005, [float("inf")] + [0.0] * 31, 0), (3006, [], 0), (3007, rows[0][1][:16], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("g", F.lit(1))
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(df, shard_rows=100).collect()}
    x = np.array([np.float32(r[1]) for r in rows], np.float64)
    c = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    label = np.array([r[2] for r in rows])
    linked = (c >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    ids = [r[0] for r in rows]
    counts = {i: int(k) for i, k in zip(ids, linked.sum(1))}
    exact = sum(found[i]["n_links"] == counts[i] for i in ids)
    assert sum(found[i]["n_links"] for i in ids) >= 0.97 * sum(counts.values()) and exact >= 0.95 * len(ids)
    assert all(found[i]["n_links"] <= counts[i] for i in ids)
    roots = union(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(linked)))])
    assert sum(found[i]["component_id"] == roots[i] for i in ids) >= 0.97 * len(ids)
    assert all(found[o[0]]["n_links"] == 0 and found[o[0]]["kept"] for o in odd)
    assert found[0]["recall"] >= 0.9
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("spread,size", [(0.035, 1500), (0.022, 10_000)])
def test_a_crowd_over_many_shards_keeps_every_link(spark, spread, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=32)
    x = np.float32(x / np.linalg.norm(x) + spread * rng.normal(size=(size, 32)))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(size + i, v, 0) for i, v in enumerate(vectors(rng, 60))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(df, shard_rows=size // 10).collect()}
    y = np.array([np.float32(r[1]) for r in rows], np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = y[:size] @ y.T >= 0.93
    truth = linked.sum(1) - 1
    assert (truth.min() < size - 1) == (size == 1500)  # in the larger crowd all pairs are linked
    assert [found[i]["n_links"] for i in range(size)] == truth.tolist()
    assert all(found[i]["component_id"] == 0 for i in range(size)) and found[0]["recall"] == 1.0


def test_a_large_label_is_split_once(spark):
    """Each split multiplies the rows of a label: in two rounds they were at least four times as many."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(6000, 8)))], "vec_id long, embedding array<float>, label int")
    classes = embeddings.vector_classes(df, "vec_id", "embedding", "label")[1]
    shards = embeddings.sharded(classes, 20)
    assert 3 * 6000 <= shards.count() < 4 * 6000
    x, c = rng.normal(size=(5000, 8)), rng.normal(size=(9, 8))
    assert (embeddings.nearest(x, c, 3) == np.argsort(-(x @ c.T), axis=1)[:, :3]).all()


def test_small_labels_and_split_cells(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v, i % 300) for i, v in enumerate(vectors(rng, 900))] + [(2000 + i, v, 999) for i, v in enumerate(vectors(rng, 800))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    classes = embeddings.vector_classes(df, "vec_id", "embedding", "label")[1]
    cells = embeddings.sharded(classes, 20, fan=4).groupBy("cell").count().collect()
    assert len(cells) > 320 and max(r["count"] for r in cells) <= 60
    assert {r["cell"].split("/")[0] for r in cells} == {f"{i}|32" for i in [*range(300), 999]}
