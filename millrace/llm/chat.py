"""Chat formatting as prefix trees.

A conversation is formatted turn by turn with a template whose control strings are escaped inside
texts, so the text can be read back. Conversations that share initial turns share them as nodes of a
tree; a pack holds such a tree depth-first, each shared turn once, and every node carries

- ``start``, ``end``: its characters in the pack, and ``until``: the end of its subtree. A character attends
  to those before it in its own node and to its ancestors, that is, to nodes whose [start, until) covers it;
- ``position``: the position id of its first character, which is the length of its ancestors;
- ``loss_from``, ``loss_to``: the trained part (the text of an assistant's turn, without control strings).

``token_arrays`` expands a pack to token ids, position ids, attention interval ends and a loss mask with any
tokenizer that is called with a text.

Conversations are put in the order of their prefix hashes by range partitioning, so that those with a
common start are neighbours; packs are cut every ``pack_chars`` characters. A start shared by very many
conversations is thus spread over many packs and tasks, each holding it once, and no tree is gathered whole.

Cases: null texts and roles count as empty; turns are taken in the order of (turn, role, text), nulls first,
repeated rows as repeated turns; a null conversation id is one conversation; equal conversations share
all nodes; a conversation is one record and must fit in memory; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, read_table

# Fixed values of the template: what opens and closes a turn, and the escapes of control strings.
OPEN, SPLIT, CLOSE = "### ", ": ", " </turn>\n"
ESCAPES = [("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c"), ("\n", "\\n")]
PLAIN = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":", "n": "\n"}
ESCAPED = re.compile(r"\\([\\hecn])")


def escape(text: str, escapes=ESCAPES) -> str:
    for plain, coded in escapes:
        text = text.replace(plain, coded)
    return text


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: PLAIN[m[1]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its trained text begins and ends."""
    head = f"{OPEN}{escape(role, ROLE_ESCAPES)}{SPLIT}"
    body = escape(text)
    out = head + body + CLOSE
    return (out, len(head), len(head) + len(body)) if role == "assistant" else (out, 0, 0)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation; ValueError if it isn't one."""
    out = []
    for piece in formatted.split(CLOSE)[:-1] if formatted.endswith(CLOSE) else [formatted] if formatted else []:
        head, gap, body = piece.partition(SPLIT)
        if not gap or not head.startswith(OPEN):
            raise ValueError("not a formatted turn")
        out.append((unescape(head[len(OPEN) :]), unescape(body)))
    return out


NODE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("until", pa.int64()), ("parent", pa.int32()), ("position", pa.int64()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])
LEAF = pa.struct([("id", pa.int64()), ("node", pa.int32())])
PACK = "text string, nodes array<struct<start:long,end:long,until:long,parent:int,position:long,loss_from:long,loss_to:long>>, leaves array<struct<id:long,node:int>>"


class Pack:
    """A tree under construction; conversations arrive in the order of their prefixes."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []  # the last conversation's turns and nodes
        self.size = 0

    def add(self, key, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        self.close(shared)
        for role, text in turns[shared:]:
            part, a, b = format_turn(role, text)
            parent = self.path[-1][1] if self.path else -1
            position = 0 if parent < 0 else self.nodes[parent]["position"] + self.nodes[parent]["end"] - self.nodes[parent]["start"]
            self.nodes.append({"start": self.size, "end": self.size + len(part), "until": -1, "parent": parent, "position": position, "loss_from": self.size + a, "loss_to": self.size + b})
            self.path.append(((role, text), len(self.nodes) - 1))
            self.parts.append(part)
            self.size += len(part)
        self.leaves.append({"id": key, "node": self.path[-1][1] if self.path else -1})

    def close(self, depth: int) -> None:
        while len(self.path) > depth:
            self.nodes[self.path.pop()[1]]["until"] = self.size

    def row(self) -> tuple:
        self.close(0)
        return "".join(self.parts), self.nodes, self.leaves


def pack_conversations(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", pack_chars: int = 65536) -> DataFrame:
    """Packs (text, nodes, leaves) of all conversations."""
    turns = conversations.select(F.col(key).cast("long").alias("id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    hashes = F.transform("t", lambda t: F.xxhash64(t["role"], t["text"]))
    ordered = whole.withColumn("path", hashes).repartitionByRange("path", F.xxhash64("id")).sortWithinPartitions("path", "id")

    def run(batches):
        pack = Pack()
        for batch in batches:
            done = []
            for key, turns in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist()):
                pack.add(key, [(t["role"], t["text"]) for t in turns])
                if pack.size >= pack_chars:
                    done.append(pack.row())
                    pack = Pack()
            yield rows(done)
        if pack.leaves:
            yield rows([pack.row()])

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(NODE)), pa.array([d[2] for d in done], pa.list_(LEAF))], names=["text", "nodes", "leaves"])

    return ordered.select("id", "t").mapInArrow(run, PACK)


def token_arrays(text: str, nodes: list[dict], encode) -> dict[str, list[int]]:
    """A pack's tokens with position ids, the end of each token's attention interval and the loss mask.

    Token j attends to token i <= j if j < until[i]. ``encode`` turns a text into token ids; nodes are
    encoded in three parts (head, trained text, end), so no token straddles a mask's edge.
    """
    out: dict[str, list[int]] = {"ids": [], "positions": [], "until": [], "loss": []}
    begin, after = [], []
    for n in nodes:
        begin.append(len(out["ids"]))
        place = after[n["parent"]] if n["parent"] >= 0 else 0
        for a, b, trained in ((n["start"], n["loss_from"], 0), (n["loss_from"], n["loss_to"], 1), (n["loss_to"], n["end"], 0)) if n["loss_to"] > n["loss_from"] else ((n["start"], n["end"], 0),):
            ids = list(encode(text[a:b])) if b > a else []
            out["ids"] += ids
            out["positions"] += range(place, place + len(ids))
            out["loss"] += [trained] * len(ids)
            place += len(ids)
        after.append(place)
    for i, n in enumerate(nodes):
        following = next((begin[j] for j in range(i + 1, len(nodes)) if nodes[j]["start"] >= n["until"]), len(out["ids"]))
        end = begin[i + 1] if i + 1 < len(nodes) else len(out["ids"])
        out["until"] += [following] * (end - begin[i])
    return out


def read_packs(packs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from packs alone."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, nodes, leaves in zip(*(batch.column(c).to_pylist() for c in ("text", "nodes", "leaves"))):
                for leaf in leaves:
                    path, n = [], leaf["node"]
                    while n >= 0:
                        path.append(nodes[n])
                        n = nodes[n]["parent"]
                    path.reverse()
                    formatted = "".join(text[n["start"] : n["end"]] for n in path)
                    turns = parse_turns(formatted)
                    loss = "".join(unescape(text[n["loss_from"] : n["loss_to"]]) for n in path if n["loss_to"] > n["loss_from"])
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    for column, value in zip(out, (leaf["id"], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return packs.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


HARD = r"\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    return read_packs(materialize(pack_conversations(rows.unionByName(hard)), "packs"))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS et,
  replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c'), chr(10), '\n') AS er FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS l,
  CAST(sum(length(er) + length(et) + 15) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g
"""
