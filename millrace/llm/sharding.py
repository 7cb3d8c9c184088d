"""Minimum-cost-flow resharding.

Rows sit in old shards; new shards have byte capacities. A flow from old to new shards, where a
byte that stays costs nothing and a byte that moves costs one, gives the block transfers that move
the fewest bytes; rows then follow the blocks, and only shards that gain or lose rows are rewritten. The documents
have no shards to begin with, so ``reshard_documents`` writes old ones first, by a hash of the source.

The flow is solved on the driver. Its size is old shards x new shards, whatever the data hold.

Rows are whole, so a block may end up to one row away from its byte position. Rows larger than a
hundredth of a capacity (at most 100 x new shards, since together they can't exceed the total) are
therefore placed one by one first, at home where they fit, and the flow fills up what is left.

With ``group``, rows of a group go to one shard: they are one unit, at home in the old shard that holds most of
its bytes. A group above a quarter of a capacity can't be kept whole with near-equal bytes (one text may be on a
third of the rows), so it is cut into units of about a hundredth of a capacity.

Cases: null text counts as empty (crc32 0, size 16); null ids and repeated rows are placed like any
other row; an empty table gives no rows; further columns are kept, but for ``shard``, ``slot`` and ``moved``,
which are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import bucket_bits, materialize, new_path, prefix_sums, read_table


def min_cost_flow(supplies: list[int], capacities: list[int], cost) -> dict[tuple[int, int], int]:
    """Flows {(old, new): bytes} of least total ``cost(old, new)`` that place every supply.

    Successive shortest paths with potentials; raises ValueError if the capacities are too small.
    """
    if sum(capacities) < sum(supplies):
        raise ValueError("the new shards' capacities are below the old shards' sizes")
    n, m = len(supplies), len(capacities)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, price: float) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supplies):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacities):
        arc(n + j, sink, c, 0)
    potential, left = [0] * (n + m + 2), sum(supplies)
    while left:
        dist, via = [float("inf")] * (n + m + 2), [None] * (n + m + 2)
        dist[source], queue = 0, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and (e := d + price + potential[a] - potential[b]) < dist[b]:
                    dist[b], via[b] = e, (a, k)
                    heapq.heappush(queue, (e, b))
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, dist)]
        push, b = left, sink
        while b != source:
            a, k = via[b]
            push, b = min(push, graph[a][k][1]), a
        b = sink
        while b != source:
            a, k = via[b]
            graph[a][k][1] -= push
            graph[b][graph[a][k][3]][1] += push
            b = a
        left -= push
    return {(i, b - n): graph[b][back][1] for i in range(n) for b, _, _, back in graph[i] if n <= b < n + m and graph[b][back][1]}


def level_room(loads: list[int], amount: int) -> list[int]:
    """Room that brings the least loaded shards up to one common level, ``amount`` in all."""
    room, rest, order = [0] * len(loads), amount, sorted(range(len(loads)), key=lambda j: loads[j])
    for k in range(1, len(order) + 1):
        level = loads[order[k - 1]]
        following = loads[order[k]] if k < len(order) else None
        step = rest if following is None else min(rest, (following - level) * k)
        share, odd = divmod(step, k)
        for at, j in enumerate(order[:k]):
            room[j] += share + (at < odd)
        rest -= step
        if not rest:
            break
    return room


def place_large(large: list[tuple], home: dict, capacity: float, n_new: int) -> tuple[list[int], list[int]]:
    """Places for single large rows [(size, old shard), ...], largest first: at home while it fits, else in the emptiest shard."""
    loads = [0] * n_new
    heap = [(0, j) for j in range(n_new)]
    where = [0] * len(large)
    for at in sorted(range(len(large)), key=lambda i: -large[i][0]):
        size, old = large[at]
        j = home.get(old)
        if j is None or loads[j] + size > capacity:
            while heap[0][0] != loads[heap[0][1]]:
                heapq.heapreplace(heap, (loads[heap[0][1]], heap[0][1]))
            j = heap[0][1]
        loads[j] += size
        where[at] = j
        if heap[0][1] == j:
            heapq.heapreplace(heap, (loads[j], j))
    return where, loads


def place(units: DataFrame, n_new: int, total: int, limit: int, key: str, size: str, old: str) -> DataFrame:
    """Add ``shard`` to the ``units`` (key, size, old, _h, _b)."""
    ident = Window.partitionBy(key, size, old, "_h").orderBy("_h")
    large = units.filter(F.col(size) > limit).withColumn("_copy", F.row_number().over(ident))
    listed = large.select(key, size, old, "_h", "_copy").orderBy(F.desc(size), key, old, "_h", "_copy").collect()  # at most total / limit rows
    olds = [r[0] for r in units.select(old).distinct().collect()]  # old shards
    home = {o: o for o in olds if o is not None and 0 <= o < n_new}
    where, loads = place_large([(r[1], r[2]) for r in listed], home, total / n_new, n_new)
    spark = units.sparkSession
    placed = spark.createDataFrame([(*r, j) for r, j in zip(listed, where)], f"_pk {units.schema[key].dataType.simpleString()}, _ps long, _po int, _ph long, _pc int, shard int")
    large = large.join(F.broadcast(placed), F.col(key).eqNullSafe(F.col("_pk")) & (F.col(size) == F.col("_ps")) & F.col(old).eqNullSafe(F.col("_po")) & (F.col("_h") == F.col("_ph")) & (F.col("_copy") == F.col("_pc"))).drop("_pk", "_ps", "_po", "_ph", "_pc", "_copy")

    small = units.filter(F.col(size) <= limit)
    sizes = {r[0]: r[1] for r in small.groupBy(old).agg(F.sum(size)).collect()}  # a row for each old shard
    order = sorted(sizes, key=lambda o: (o is None, o))
    flows = min_cost_flow([sizes[o] for o in order], level_room(loads, sum(sizes.values())), lambda i, j: int(home.get(order[i]) != j))
    blocks = []
    for i, o in enumerate(order):
        at = 0
        for j in sorted((j for a, j in flows if a == i), key=lambda j: (home.get(o) != j, j)):
            blocks.append((o, at, at + flows[i, j], j))
            at += flows[i, j]
    cuts = spark.createDataFrame(blocks, "_o int, _from long, _to long, shard int")
    small = prefix_sums(small, [old], "_b", ["_h", key, size], size, "_start")
    middle = F.col("_start") + F.expr(f"`{size}` div 2")
    small = small.join(F.broadcast(cuts), F.col(old).eqNullSafe(F.col("_o")) & (middle >= F.col("_from")) & (middle < F.col("_to"))).drop("_o", "_from", "_to", "_start")
    return small.unionByName(large)


def reshard(rows: DataFrame, n_new: int = 40, key: str = "doc_id", size: str = "size", old: str = "old_shard", fine: int = 100, group: str | None = None) -> DataFrame:
    """Add ``shard`` (0 to n_new - 1), ``slot`` (place in the shard, from 0) and ``moved`` to ``rows``.

    ``rows`` holds ``key``, a positive byte ``size``, the ``old`` shard number and, if wanted, a ``group``; new shard j
    is at home where old shard j was. All other columns are kept. Capacities are equal shares of the bytes.
    Rows are ordered by a hash of these columns and of their place in a file, so equal ids make no hot bucket.
    """
    if {"shard", "slot", "moved"} & {key, size, old, group}:
        raise ValueError("shard, slot and moved are columns of the result")
    rows = materialize(rows.drop("shard", "slot", "moved"), "reshard")
    names = [key, size, old, *([group] if group else [])]
    rows = rows.select("*", F.xxhash64(*names, F.col("_metadata.row_index")).alias("_h"))
    total, count = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    bits = bucket_bits(count)
    bucket = F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long")
    limit = max(1, total // (n_new * fine))
    if group:
        sums = rows.groupBy(F.col(group).alias("_g")).agg(F.sum(size).alias("_gs"), F.count("*").alias("_gn")).filter("_gn > 1")
        sums = sums.select("_g", F.when(F.col("_gs") <= total // (4 * n_new), 1).otherwise(F.ceil(F.col("_gs") / limit)).alias("_parts"))
        unit = F.when(F.col("_parts").isNull(), F.col("_h")).otherwise(F.xxhash64(group, F.pmod(F.col("_h"), F.col("_parts"))))
        rows = materialize(rows.join(sums, F.col(group) == F.col("_g"), "left").withColumn("_unit", unit).drop("_g", "_parts"), "reshard-units")
        held = rows.groupBy("_unit", old).agg(F.sum(size).alias("_s"))
        units = held.groupBy("_unit").agg(F.sum("_s").alias("_size"), F.max(F.struct("_s", (-F.col(old)).alias("o")))["o"].alias("_old"))
        units = units.select("_unit", "_size", (-F.col("_old")).cast("int").alias("_old"), F.col("_unit").alias("_h")).withColumn("_b", bucket)
        placed = place(materialize(units, "reshard-placed"), n_new, total, limit, "_unit", "_size", "_old").select(F.col("_unit").alias("_u"), "shard")
        new = rows.join(placed, F.col("_unit") == F.col("_u")).drop("_unit", "_u").withColumn("_b", bucket)
    else:
        new = place(rows.withColumn("_b", bucket), n_new, total, limit, key, size, old)
    new = prefix_sums(materialize(new, "reshard-new"), ["shard"], "_b", ["_h", key, size], F.lit(1).cast("long"), "slot")
    return new.withColumn("moved", ~F.col("shard").eqNullSafe(F.col(old))).drop("_h", "_b")


def write_shards(assigned: DataFrame, path: str, ranges: bool = True) -> None:
    """Write rows as ``path/shard=N``, in slot order; a shard may be more than one task and file, each a range of slots.

    Without ``ranges`` rows stay in the tasks they are in, which saves a shuffle: files are in slot order each, but their slots interleave.
    """
    dealt = assigned.repartitionByRange("shard", "slot") if ranges else assigned
    dealt.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def rewrite_shards(spark: SparkSession, old_path: str, assigned: DataFrame, new_path: str, old: str = "old_shard", placed: DataFrame | None = None, ranges: bool = True) -> DataFrame:
    """Rewrite only the shards that gain or lose rows to ``new_path``; others stay under ``old_path``.

    Returns a manifest (shard, path, rewritten), a row for each new shard that holds rows. ``placed`` may be a narrow
    table of the same rows (shard, old, moved), read to tell the shards; for ``ranges`` see ``write_shards``.
    """
    placed = assigned if placed is None else placed
    touched = placed.filter("moved").select(F.explode(F.array("shard", F.col(old).cast("int"))).alias("shard")).distinct()
    names = {r[0] for r in touched.collect()}  # shard numbers
    write_shards(assigned.filter(F.col("shard").isin(sorted(n for n in names if n is not None))), new_path, ranges)
    found = sorted(r[0] for r in placed.select("shard").distinct().collect())
    return spark.createDataFrame([(s, f"{new_path if s in names else old_path}/shard={s}", s in names) for s in found], "shard int, path string, rewritten boolean")


def old_shard(old_shards: int) -> Column:
    """The old shard of a document: a hash of its source."""
    return F.pmod(F.xxhash64("source"), F.lit(old_shards)).cast("int")


def document_rows(documents: DataFrame, old_shards: int = 40, carry: list[str] | None = None, old: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, text_hash, old_shard, carry) of documents that lie in the shard ``old``, or in one for each hash of their source.

    What is to be placed, without the texts: ``reshard_documents`` moves those.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return documents.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        (F.col(old) if old else old_shard(old_shards)).alias("old_shard"),
        *(carry or []),
    )


def reshard_documents(documents: DataFrame, old_shards: int = 40, n_new: int = 40) -> tuple[DataFrame, DataFrame]:
    """Whole documents as old shards on files, dealt to new ones, of which those that gain or lose documents are rewritten.

    Returns the documents as read from the shards' files, with ``old_shard``, ``shard``, ``slot`` and ``moved`` (columns of these
    names are replaced), and the manifest. Texts are shuffled once, to meet their places; only places go through the flow.
    """
    spark = documents.sparkSession
    kept = documents.drop("old_shard", "shard", "slot", "moved", "_file", "_line")
    old_path, path = new_path(spark, "old-shards"), new_path(spark, "new-shards")
    kept.withColumn("shard", old_shard(old_shards)).write.option("compression", "zstd").partitionBy("shard").parquet(old_path)
    old = spark.read.schema(kept.withColumn("shard", F.lit(0)).schema).parquet(old_path)
    old = old.select(*kept.columns, F.col("shard").alias("old_shard"), F.xxhash64(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_line"))
    placed = reshard(document_rows(old, carry=["_file", "_line"], old="old_shard"), n_new, group="text_hash")
    placed = materialize(placed.select(F.col("_file").alias("_f"), F.col("_line").alias("_l"), "old_shard", F.col("slot").cast("long").alias("slot"), "moved", "shard"), "placed")
    assigned = old.join(placed.drop("old_shard").hint("merge"), (F.col("_file") == F.col("_f")) & (F.col("_line") == F.col("_l"))).drop("_file", "_line", "_f", "_l")
    manifest = rewrite_shards(spark, old_path, assigned, path, placed=placed, ranges=False)
    same = [r["shard"] for r in manifest.filter("not rewritten").collect()]  # shard numbers
    found = spark.read.schema(assigned.schema).parquet(path)
    return found.unionByName(assigned.filter(F.col("shard").isin(same))) if same else found, manifest


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums are those of the texts that the shards' files hold."""
    found = document_rows(reshard_documents(read_table(spark, sf_dir, "documents"))[0], carry=["shard", "slot", "moved"], old="old_shard")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
