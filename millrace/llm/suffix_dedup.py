"""Exact removal of repeated byte strings with suffix arrays.

Every byte of a text that lies in a string of ``WIDTH`` bytes which also starts anywhere else in the corpus,
the same text included, is removed; strings are judged on the input and never cross texts.

1. Equal texts form one class with a count, kept in a table bucketed by a hash of the text, so the
   later joins bring small rows to the texts and never move these again.
2. Each window of WIDTH bytes has an anchor: the leftmost of its GRAM-byte grams with the least hash.
   Equal windows have equal anchors, so an anchor that occurs once has no repeated window. Runs of
   windows with one anchor become rows; rows of an anchor are counted once for each batch of texts
   before they are shuffled, so a string in very many texts is no hot key.
3. Around shared anchors texts are cut into segments (a run of windows), equal ones of a batch once.
4. Shards of segments, dealt by anchor, get a suffix array by Larsson-Sadakane refinement: ranks by the first
   8 bytes, then by doubling over the groups still unsorted. Kasai's algorithm, run over all segments of
   the shard in lockstep, gives the common prefixes of neighbours; windows that share WIDTH bytes
   with a neighbour repeat. An anchor with more segments than a shard holds gets several shards,
   whose sorted windows are merged by binary search.
5. What repeats goes back to the texts through the segments' hashes.

Cases: null texts are empty; texts shorter than WIDTH keep all bytes; rows that repeat, whole documents
included, are copies like any other; null ids are kept; an empty table gives no rows; other columns
are not read. Texts are told apart by a 64-bit hash, which is checked against a second one; on a
collision the table is made again with another seed.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, new_path, read_table, trimmed

WIDTH, GRAM = 200, 64
#: Grams in a window.
SPAN = WIDTH - GRAM + 1
RNG = np.random.default_rng(11)
BYTE = RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = RNG.integers(1, 1 << 63, 6, dtype=np.uint64) | np.uint64(1)
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def anchor_runs(t: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, gram hash) of the runs of windows with one anchor, over texts [start, end) of ``t``."""
    h = BYTE[t]
    for i in range(6):
        j = 1 << i
        h = h[:-j] * STEP[i] + h[j:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    least = (h & HIGH) | np.arange(len(h), dtype=np.uint64)
    for i in range(7):
        j = 1 << i
        least = np.minimum(least[:-j], least[j:])
    least = np.minimum(least[: -(SPAN - 128)], least[SPAN - 128 :])
    at = (least & LOW).astype(np.int64)
    depth = np.zeros(len(at) + 1, np.int32)
    whole = ends - starts >= WIDTH
    np.add.at(depth, starts[whole], 1)
    np.add.at(depth, ends[whole] - WIDTH + 1, -1)
    valid = np.cumsum(depth[:-1]) > 0
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    last = np.ones(len(at), bool)
    last[:-1] = new[1:] | ~valid[1:]
    first = np.flatnonzero(valid & new)
    return first, np.flatnonzero(valid & last), h[at[first]]


def text_runs(data: np.ndarray, offsets: np.ndarray, slice_bytes: int = 1 << 19):
    """(text number, first window, windows, gram hash) over texts ``data[offsets[i]:offsets[i + 1]]``, in slices."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= slice_bytes:
            j += 1
        begin, end = int(offsets[i]), int(offsets[j])
        if j == i + 1 and end - begin > 2 * slice_bytes:  # one long text: slices that share WIDTH - 1 bytes
            for a in range(begin, end - WIDTH + 1, slice_bytes):
                b = min(end, a + slice_bytes + WIDTH - 1)
                first, last, h = anchor_runs(data[a:b], np.array([0]), np.array([b - a]))
                yield np.full(len(first), i), first + (a - begin), last - first + 1, h
        elif end - begin >= WIDTH:
            starts, ends = offsets[i:j] - begin, offsets[i + 1 : j + 1] - begin
            first, last, h = anchor_runs(data[begin:end], starts, ends)
            text = np.searchsorted(ends, first, side="right")
            yield text + i, first - starts[text], last - first + 1, h
        i = j


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without nulls."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def leading_words(t: np.ndarray) -> np.ndarray:
    """At each byte the 8 bytes from there as a big-endian number; ``t`` ends with 8 bytes of padding."""
    n = len(t) - 8
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | t[j : j + n]
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of bytes by Larsson-Sadakane refinement."""
    n = len(t)
    words = leading_words(np.concatenate([t, np.zeros(8, np.uint8)]))
    sa = np.argsort(words)
    sorted_words = words[sa]
    first = np.ones(n, bool)
    first[1:] = sorted_words[1:] != sorted_words[:-1]
    places = np.arange(n)
    group = np.empty(n, np.int64)
    group[sa] = np.maximum.accumulate(np.where(first, places, 0))
    tail = max(0, n - 8)  # suffixes shorter than 8 bytes: padding must not equal real zeros
    if n and tail < n:
        group, sa, first = _order_tail(t, words, group, sa, first, tail)
    h = 8
    while True:
        alone = first.copy()
        alone[:-1] &= first[1:]
        todo = np.flatnonzero(~alone)
        if not len(todo):
            return sa
        s = sa[todo]
        second = np.where(s + h < n, group[np.minimum(s + h, n - 1)] + 1, 0)
        key = (group[s].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        order = np.argsort(key)
        s, key = s[order], key[order]
        sa[todo] = s
        fresh = np.ones(len(todo), bool)
        fresh[1:] = key[1:] != key[:-1]
        first[todo] = fresh
        group[s] = np.maximum.accumulate(np.where(fresh, todo, 0))
        h *= 2


def _order_tail(t, words, group, sa, first, tail):
    """Put suffixes shorter than 8 bytes before equal-looking longer ones."""
    n = len(t)
    length = np.minimum(n - np.arange(n), 8)
    sa = np.lexsort((length, words))
    w, l = words[sa], length[sa]
    first = np.ones(n, bool)
    first[1:] = (w[1:] != w[:-1]) | (l[1:] != l[:-1])
    group[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return group, sa, first


def kasai(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, up to ``most`` bytes, by position.

    Kasai's bound (a suffix keeps all but one byte of the common prefix of the one a byte before it) is
    followed along every stretch [start, start + length) at once.
    """
    n = len(t)
    words = leading_words(np.concatenate([t, np.zeros(8 + most, np.uint8)]))
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    keep = np.zeros(len(starts), np.int64)
    live = len(starts)
    for j in range(int(lengths[0]) if len(lengths) else 0):
        while live and lengths[live - 1] <= j:
            live -= 1
        i = starts[:live] + j
        p = before[i]
        k = np.where(p >= 0, np.maximum(keep[:live] - 1, 0), 0)
        work = np.flatnonzero((p >= 0) & (k < most))
        while len(work):
            a, b = i[work] + k[work], p[work] + k[work]
            inside = (a < n) & (b < n)
            differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
            same = np.where(differ == 0, 8, (63 - np.frexp(np.maximum(differ, np.uint64(1)).astype(np.float64))[1] + 1) // 8)
            same = np.where(differ == 0, 8, np.minimum(same, 7))
            exact = _equal_bytes(differ, same)
            exact = np.where(inside, np.minimum(exact, np.minimum(n - a, n - b)), 0)
            k[work] = np.minimum(k[work] + exact, most)
            work = work[(exact == 8) & (k[work] < most)]
        out[i] = k
        keep[:live] = k
    return out


def _equal_bytes(differ: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two big-endian words from their difference; ``guess`` may be one off by rounding."""
    out = guess.astype(np.int64)
    shift = (np.uint64(56) - np.uint64(8) * np.minimum(out, 7).astype(np.uint64))
    wrong = (out < 8) & ((differ >> shift) == 0)
    return out + wrong


class Shard:
    """Segments of windows and their suffix array; ``repeated`` flags each segment's windows."""

    def __init__(self, segments: list[bytes], windows: list[int], counts: list[int]) -> None:
        parts = []
        for i, s in enumerate(segments):  # bytes from 0xF8 up are in no UTF-8 text
            digits, rest = [], i
            for _ in range(7):
                digits.append(0xF8 + rest % 7)
                rest //= 7
            parts += [s, b"\xff", bytes(digits)]
        self.t = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(s) + 8 for s in segments])
        self.starts = np.cumsum(sizes) - sizes
        self.windows = np.array(windows)
        is_window = np.zeros(len(self.t) + 1, np.int32)
        np.add.at(is_window, self.starts, 1)
        np.add.at(is_window, self.starts + self.windows, -1)
        self.is_window = np.cumsum(is_window[:-1]) > 0
        self.repeated = np.zeros(len(self.t), bool)
        for s, w in zip(self.starts[np.array(counts) > 1], self.windows[np.array(counts) > 1]):
            self.repeated[s : s + w] = True
        sa = suffix_array(self.t)
        common = kasai(self.t, sa, self.starts, self.windows)
        order = sa[self.is_window[sa]]
        equal = common[order] >= WIDTH
        self.repeated[order[equal]] = True
        self.repeated[order[:-1][equal[1:]]] = True
        self.order = order[~equal]  # each different window once
        self.leader = np.zeros(len(order), np.int64)
        self.leader = order[np.maximum.accumulate(np.where(~equal, np.arange(len(order)), 0))] if len(order) else order
        self.sorted_all = order

    def words_at(self, at: np.ndarray, w: int) -> np.ndarray:
        i = at[:, None] + np.arange(8 * w, 8 * w + 8)
        return self.t[i].astype(np.uint64) @ (np.uint64(1) << (np.uint64(56) - np.uint64(8) * np.arange(8, dtype=np.uint64)))

    def compare(self, mine: np.ndarray, other: "Shard", theirs: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for windows at ``mine`` against windows of ``other``."""
        out = np.zeros(len(mine), np.int8)
        work = np.arange(len(mine))
        for w in range(WIDTH // 8):
            a, b = self.words_at(mine[work], w), other.words_at(theirs[work], w)
            out[work] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
            work = work[a == b]
            if not len(work):
                break
        return out

    def merge(self, other: "Shard") -> None:
        """Flag the windows that are in both shards, by binary search of this one's in the other's."""
        low, high = np.zeros(len(self.order), np.int64), np.full(len(self.order), len(other.order))
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            after = self.compare(self.order[open_], other, other.order[middle]) > 0
            low[open_] = np.where(after, middle + 1, low[open_])
            high[open_] = np.where(after, high[open_], middle)
        there = np.flatnonzero(low < len(other.order))
        hit = there[self.compare(self.order[there], other, other.order[low[there]]) == 0]
        for shard, found in ((self, self.order[hit]), (other, other.order[low[hit]])):
            wanted = np.zeros(len(shard.t), bool)
            wanted[found] = True
            shard.repeated[shard.sorted_all[wanted[shard.leader]]] = True

    def ranges(self, i: int) -> list[int]:
        """Covered bytes [a, b) of segment ``i``, flattened."""
        s = int(self.starts[i])
        return covered(self.repeated[s : s + int(self.windows[i])])


def covered(flags: np.ndarray) -> list[int]:
    """Byte ranges [a, b), flattened, of the windows flagged."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    out: list[int] = []
    for a, b in zip(edge[::2].tolist(), (edge[1::2] - 1 + WIDTH).tolist()):
        if out and a <= out[-1]:
            out[-1] = b
        else:
            out += [a, b]
    return out


def text_classes(texts: DataFrame, seed: int = 0) -> DataFrame:
    """(tk, n, text): the different texts of ``texts`` (text), bucketed by the hash ``tk``."""
    spark = texts.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = texts.select(text_key(text, seed).alias("tk"), F.xxhash64(text, F.lit("check")).alias("c"), text.alias("text"))
    classes = keyed.groupBy("tk").agg(F.count("*").alias("n"), F.first("text").alias("text"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    name = f"millrace_texts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes.write.option("compression", "zstd").option("path", new_path(spark, "texts")).bucketBy(parts, "tk").sortBy("tk").saveAsTable(name)
    table = spark.table(name)
    if table.filter("c0 <> c1").select(F.lit(1)).head(1):
        raise ArithmeticError("two texts share a hash")
    return table.drop("c0", "c1")


def text_key(text, seed: int):
    return F.xxhash64(text) if not seed else F.xxhash64(text, F.lit(seed))


def shared_runs(classes: DataFrame) -> DataFrame:
    """(tk, h, run): runs of windows whose anchor occurs more than once; run is first window << 8 | windows - 1."""
    shape = pa.schema([("part", pa.int64()), ("tk", pa.int64()), ("h", pa.int64()), ("run", pa.int64()), ("rep", pa.int8())])

    def runs(batches):
        for batch in batches:
            data, offsets = binary_parts(batch.column(1))
            tk = np.asarray(batch.column(0))
            found = list(text_runs(data, offsets))
            if not found:
                continue
            text, first, windows, h = (np.concatenate(x) for x in zip(*found))
            _, at, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            rep = np.zeros(len(h), np.int8)
            rep[at] = 1
            rep[(rep == 1) & (counts[inverse] > 1)] = 2  # stands for several of this batch
            h = h.view(np.int64)
            run = (first << 8) | (windows - 1)
            part = np.where(rep > 0, h, (h + run) * -7046029254386353131)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(tk[text]), pa.array(h), pa.array(run), pa.array(rep)], schema=shape)

    def shared(batches):
        held = None
        for batch in batches:
            now = {c: np.asarray(batch.column(c)) for c in shape.names}
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in now}
            more = _shared(now, held is not None and held["again"])
            held = {c: now[c][-1:] for c in shape.names} | {"again": more[1]}
            yield more[0]
        if held is not None:
            known = held["again"] or held["rep"][0] != 1
            yield _rows({c: held[c] for c in shape.names}, np.array([known]))

    def _shared(x, again):
        """Rows but the last whose anchor is shared, and whether the last one is."""
        same = (x["part"][1:] == x["part"][:-1]) & (x["rep"][1:] > 0) & (x["rep"][:-1] > 0)
        keep = x["rep"] != 1
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= bool(again)
        return _rows({c: x[c][:-1] for c in shape.names}, keep[:-1]), bool(keep[-1])

    def _rows(x, keep):
        return pa.RecordBatch.from_arrays([pa.array(x[c][keep]) for c in ("tk", "h", "run")], names=["tk", "h", "run"])

    rows = classes.filter(F.octet_length("text") >= WIDTH).select("tk", "text").mapInArrow(trimmed(runs), "part long, tk long, h long, run long, rep byte")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "part").sortWithinPartitions("part", F.desc("rep")).mapInArrow(trimmed(shared), "tk long, h long, run long")


def cut_segments(classes: DataFrame, runs: DataFrame, chunk_bytes: int = 32 << 20) -> DataFrame:
    """Members (tk, run, s1, s2) and, with ``seg`` set, the different segments of each chunk of texts (h, s1, s2, n, windows, seg)."""
    shape = pa.schema([("tk", pa.int64()), ("run", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("windows", pa.int32()), ("seg", pa.binary())])

    def cut(batches):
        known: dict = {}
        size = 0

        def flush():
            rows = {c: [] for c in shape.names}
            for (s1, s2), (h, n, windows, seg) in known.items():
                for c, v in zip(shape.names, (None, None, s1, s2, h, n, windows, seg)):
                    rows[c].append(v)
            return pa.RecordBatch.from_pydict(rows, shape)

        for batch in batches:
            data, offsets = binary_parts(batch.column("text"))
            tks, counts = batch.column("tk").to_pylist(), batch.column("n").to_pylist()
            lists = batch.column("runs")
            edges = np.asarray(lists.offsets).tolist()
            flat = lists.values
            hs, runs_ = np.asarray(flat.field("h")).tolist(), np.asarray(flat.field("run")).tolist()
            out_tk, out_run, out_1, out_2 = [], [], [], []
            for i, (tk, n) in enumerate(zip(tks, counts)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                for k in range(edges[i], edges[i + 1]):
                    run, h = runs_[k], hs[k]
                    first, windows = run >> 8, (run & 255) + 1
                    seg = text[first : first + windows - 1 + WIDTH]
                    digest = xxhash.xxh128_digest(seg)
                    sid = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                    out_tk.append(tk), out_run.append(run), out_1.append(sid[0]), out_2.append(sid[1])
                    old = known.get(sid)
                    if old is None:
                        known[sid] = [h, n, windows, seg]
                        size += len(seg)
                    else:
                        old[1] += n
            none = [None] * len(out_tk)
            yield pa.RecordBatch.from_pydict({"tk": out_tk, "run": out_run, "s1": out_1, "s2": out_2, "h": none, "n": none, "windows": none, "seg": none}, shape)
            if size >= chunk_bytes:
                yield flush()
                known, size = {}, 0
        if known:
            yield flush()

    lists = runs.groupBy("tk").agg(F.collect_list(F.struct("h", "run")).alias("runs"))  # at most one for each byte of the text
    joined = classes.join(lists, "tk").select("tk", "n", "text", "runs")
    return materialize(joined.mapInArrow(trimmed(cut), "tk long, run long, s1 long, s2 long, h long, n long, windows int, seg binary"), "segments")


def repeated_ranges(segments: DataFrame, shard_bytes: int = 1 << 21) -> DataFrame:
    """(s1, s2, ranges): bytes [a, b), flattened, of each segment that lie in repeated windows."""

    def resolve(batches):
        held: dict = {}  # anchor -> {sid: [n, windows, seg]}, of the anchors of one shard
        size = 0

        def shards():
            """Shards of what is held: many anchors in one, or several for one anchor."""
            out: list[tuple[list, Shard]] = []
            rows = [(sid, *row) for group in held.values() for sid, row in group.items()]
            at = 0
            while at < len(rows):
                end, total = at, 0
                while end < len(rows) and (end == at or total + len(rows[end][3]) <= 2 * shard_bytes):
                    total += len(rows[end][3])
                    end += 1
                part = rows[at:end]
                shard = Shard([r[3] for r in part], [r[2] for r in part], [r[1] for r in part])
                for _, earlier in out:
                    shard.merge(earlier)
                out.append(([r[0] for r in part], shard))
                at = end
            s1, s2, ranges = [], [], []
            for sids, shard in out:
                for i, sid in enumerate(sids):
                    if found := shard.ranges(i):
                        s1.append(sid[0]), s2.append(sid[1]), ranges.append(found)
            return pa.RecordBatch.from_arrays([pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(ranges, pa.list_(pa.int32()))], names=["s1", "s2", "ranges"])

        for batch in batches:
            for h, s1, s2, n, windows, seg in zip(*(batch.column(c).to_pylist() for c in ("h", "s1", "s2", "n", "windows", "seg"))):
                if h not in held and size >= shard_bytes:
                    yield shards()
                    held, size = {}, 0
                group = held.setdefault(h, {})
                if (s1, s2) in group:
                    group[s1, s2][0] += n
                else:
                    group[s1, s2] = [n, windows, seg]
                    size += len(seg)
        if held:
            yield shards()

    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = segments.filter("seg is not null").select("h", "s1", "s2", "n", "windows", "seg").repartition(parts, "h").sortWithinPartitions("h")
    return rows.mapInArrow(trimmed(resolve), "s1 long, s2 long, ranges array<int>")


def remove_repeats(classes: DataFrame, with_text: bool = True) -> DataFrame:
    """(tk, n_bytes, n_removed, n_spans, kept_sha256, kept) for each text class; ``kept`` is null unless asked for."""
    segments = cut_segments(classes, shared_runs(classes))
    found = materialize(repeated_ranges(segments), "repeats")
    members = segments.filter("seg is null").select("tk", F.shiftright("run", 8).alias("at"), "s1", "s2")
    spans = members.join(found, ["s1", "s2"]).select("tk", "at", "ranges").groupBy("tk").agg(F.collect_list(F.struct("at", "ranges")).alias("spans"))

    def apply(batches):
        for batch in batches:
            data, offsets = binary_parts(batch.column("text"))
            out: list[list] = [[] for _ in range(5)]
            for i, (n, spans) in enumerate(zip(batch.column("n").to_pylist(), batch.column("spans").to_pylist())):
                text = data[offsets[i] : offsets[i + 1]]
                if n > 1 and len(text) >= WIDTH:
                    removed, runs, kept = len(text), 1, b""
                elif spans:
                    edge = np.zeros(len(text) + 1, np.int32)
                    for s in spans:
                        for a, b in zip(s["ranges"][::2], s["ranges"][1::2]):
                            edge[s["at"] + a] += 1
                            edge[s["at"] + b] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                    kept = text[~gone].tobytes()
                else:
                    removed, runs, kept = 0, 0, text.tobytes()
                for column, value in zip(out, (len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("tk"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["tk", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = classes.join(spans, "tk", "left").select("tk", "n", "text", "spans")
    return joined.mapInArrow(trimmed(apply), "tk long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of ``documents``."""
    rows = documents.select(F.col(key), F.col(text).alias("text"))
    for seed in range(4):
        try:
            classes = text_classes(rows.select("text"), seed)
            break
        except ArithmeticError:
            if seed == 3:
                raise
    done = remove_repeats(classes, with_text)
    if not with_text:
        done = materialize(done, "removed")
    ids = rows.select(F.col(key), text_key(F.coalesce(F.col("text").cast("string"), F.lit("")), seed).alias("_tk"))
    return ids.join(done, F.col("_tk") == F.col("tk")).drop("_tk", "tk")


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(read_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP1_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT r, p, md5(substr(x, 2 * p + 1, 400)) AS m FROM (SELECT r, x, unnest(range(len(x) // 2 - 199)) AS p FROM d WHERE len(x) >= 400)),
f AS (SELECT r, p FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
s AS (SELECT r, p, CASE WHEN p <= 200 + lag(p) OVER (PARTITION BY r ORDER BY p) THEN 0 ELSE 1 END AS new FROM f),
g AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS i FROM s),
i AS (SELECT r, i, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY r, i),
k AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS e FROM i),
t AS (SELECT r, sum(b - a) AS gone, count(*) AS n, max(b) AS last, string_agg(substr(x, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS kept FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
