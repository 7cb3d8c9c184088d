"""The corpus pipeline: every stage against brute force over what it is given, and odd inputs."""

import re
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, decontamination, toxicity

DATA = "/root/testdata/sf0.001"
COLUMNS = pipeline.COLUMNS
ODD = [(None, None, "en", "web", None), (None, "", None, None, 0), (None, "", None, None, 0), (900001, "x", "en", "web", 1), (900001, "x", "en", "web", 1), (900002, "lone " * 3000 + "long text", "de", "wiki", 9), (None, "two words", "en", "web", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    """The documents and odd rows, with columns that clash with names used inside."""
    found = spark.read.parquet(f"{DATA}/documents.parquet").select(COLUMNS)
    odd = spark.createDataFrame(ODD, found.schema)
    extra = found.unionByName(odd).withColumns({c: F.lit("extra") for c in ("shard", "slot", "_row", "rejected", "_k", "name", "component", "uid", "k", "size", "repeats")})
    return common.materialize(extra, "pipeline-test")


def rows(df):
    return Counter(map(tuple, df.select(COLUMNS).collect()))


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_copies_by_brute_force(spark, docs):
    kept, every = rows(pipeline.drop_copies(spark, docs, DATA)), [tuple(r) for r in docs.select(COLUMNS).collect()]
    sets = [shingles(r[1]) for r in every]
    root = list(range(len(every)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(every)):
        for j in range(i):
            if every[i][1] == every[j][1] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(every):
        groups.setdefault(find(i), []).append(r)
    assert sum(kept.values()) == len(groups)
    for members in groups.values():
        ids = [m[0] for m in members if m[0] is not None]
        here = [m for m in members if kept[m]]
        assert any(m[0] == (min(ids) if ids else None) for m in here)
    assert any(len(g) > 1 for g in groups.values())


def test_toxic_and_contaminated_documents_go(spark, docs):
    labels, benchmark = (common.read_table(spark, DATA, t) for t in ("labels", "benchmark"))
    scored = toxicity.toxicity(docs.select(COLUMNS), labels)
    assert rows(pipeline.drop_toxic(spark, docs, DATA)) == rows(scored.filter(~F.col("rejected")))
    left = rows(pipeline.drop_contaminated(spark, docs, DATA))
    items = [decontamination.tokens(r["text"]) for r in benchmark.collect()]

    def share(words, item):
        """The best alignment score of an item, by the plain recurrence."""
        best, above = 0, [0] * (len(words) + 1)
        for x in item:
            row = [0]
            for j, y in enumerate(words, 1):
                row.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, row[j - 1] - 1))
            best, above = max(best, *row), row
        return best / (2 * len(item))

    def grams(words, n=3):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}

    dirty = 0
    for r in rows(docs):
        words = decontamination.tokens(r[1])
        near = [i for i in items if i and grams(i) & grams(words)]
        hit = bool(words) and len(words) < 600 and any(share(words, i) >= 0.6 for i in near)
        dirty += hit
        if hit or not near:
            assert (r in left) != hit
    assert dirty > 0


def test_mixing_and_sharding_keep_what_they_say(spark, docs):
    sizes = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    before, mixed = rows(docs), pipeline.mix_sources(spark, docs, DATA)
    after = rows(mixed)
    assert set(after) <= set(before) and all(after[r] <= 3 * before[r] for r in after)
    by = Counter()
    for r, n in before.items():
        by[r[3]] += n * sizes(r)
    sources = sorted(by, key=lambda s: (s is None, s))
    weights = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while True:
        level = (sum(by.values()) - sum(target.values())) / max(1, sum(weights[s] for s in open_))
        above = {s for s in open_ if level * weights[s] > 3 * by[s]}
        if not above:
            break
        target |= {s: 3 * by[s] for s in above}
        open_ -= above
    target |= {s: level * weights[s] for s in open_}
    for s in sources:
        taken = sum(n * sizes(r) for r, n in after.items() if r[3] == s)
        least = min(sizes(r) for r in before if r[3] == s)
        assert abs(taken - target[s]) <= 0.05 * target[s] + max(50, least / 2)  # documents are whole
    dealt = pipeline.deal_shards(spark, docs, DATA).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in dealt) == before
    for s in range(40):
        assert sorted(r["slot"] for r in dealt if r["shard"] == s) == list(range(sum(r["shard"] == s for r in dealt)))


def test_every_stage_of_nothing(spark, docs):
    none = common.materialize(docs.limit(0), "nothing")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, DATA).collect() == []


def test_run_applies_the_stages_in_turn(spark):
    found = pipeline.run(spark, DATA)
    first = rows(common.read_table(spark, DATA, "documents"))
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    assert {"shard", "slot"} <= set(found.columns) and set(rows(found)) <= set(first)
