"""WARC archives: write pages as records, read archives back, put segments together again.

Writing: every page becomes a response record whose block is an HTTP response in chunked transfer
framing; of pages with equal payloads the one with the smallest id keeps the payload and the others
are revisits that refer to it. A block above ``segment_bytes`` is cut: the first record has segment
number 1, continuation records name it as their origin, the last one states the total length.
Archives are rows (archive, content) of a Parquet table in the shared folder, a few MB each, so that
any store Spark can write to will do; ``read_files`` reads .warc and .warc.gz files into the same form.

Reading: records are parsed archive by archive. Those that are whole are decoded at once; only
segments are shuffled, grouped by their origin, ordered by number, checked (numbers 1 to n, the
stated total length) and decoded. A revisit takes its payload's length and digest from the record
it refers to.

Cases: null html is an empty payload, null ids and urls leave their header out and come back null,
and a null id is the largest among equal payloads. Rows that repeat are told apart by ``tie``. A
record with missing segments or broken framing comes back with ``problem`` set. An empty table
gives no rows. Further columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, new_path, read_table

HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
VISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS = "kind string, record_id string, id long, url string, refers_to string, payload_digest string, payload_bytes long, segment int, origin string, total long, payload binary, problem string"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload inside chunked framing; ValueError if a chunk is cut short or not a chunk."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP header")
    return unchunked(body) if re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", head, re.I) else body


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None]
    return b"".join([b"WARC/1.1\r\n", "".join(lines).encode(), b"\r\n", block, b"\r\n\r\n"])


def page_records(uri: str, page_id, url: str | None, payload: bytes, digest: str, refers: str | None, date: str, segment_bytes: int) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations."""
    common = [("WARC-Date", date), ("WARC-Target-URI", None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    kind = ("Content-Type", "application/http;msgtype=response")
    if refers is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{uri}>"), *common, profile, ("WARC-Refers-To", f"<{refers}>"), kind], VISIT)]
    block = HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{uri}>"), *common, kind], block)]
    pieces = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{uri}>"), *common, kind, ("WARC-Segment-Number", 1)], pieces[0])]
    for n, piece in enumerate(pieces[1:], 2):
        last = ("WARC-Segment-Total-Length", len(block) if n == len(pieces) else None)
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uri}:{n}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", f"<{uri}>"), ("WARC-Segment-Number", n), last], piece))
    return out


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", tie: str | None = None, segment_bytes: int = 16384, archive_bytes: int = 4 << 20, revisit_from: int = 0, date: str = "2025-01-01T00:00:00Z") -> None:
    """Write the pages as archives at ``path``. Payloads of at least ``revisit_from`` bytes are kept once.

    ``tie`` names a column that tells rows with equal key and payload apart, such as file and row number.
    """
    tie_col = F.col(tie).cast("string") if tie else F.coalesce(F.col(url), F.lit(""))
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"), F.sha1(payload).alias("sha"), F.substring(F.md5(F.coalesce(tie_col, F.lit(""))), 1, 12).alias("tie"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "tie")
    firsts = rows.filter(F.octet_length("html") >= revisit_from).groupBy(F.col("sha").alias("_sha")).agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(firsts, F.col("sha") == F.col("_sha"), "left").withColumn("refers", F.when(F.col("first") != rank, F.col("first"))).drop("_sha", "first")
    shape = pa.schema([("archive", pa.string()), ("content", pa.binary())])

    def uri(page_id, tie: str) -> str:
        return f"urn:page:{'' if page_id is None else page_id}:{tie}"

    def pack(batches):
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            return pa.RecordBatch.from_pydict({"archive": [f"{part:06d}-{n:06d}.warc"], "content": [b"".join(held)]}, shape)

        for batch in batches:
            for page_id, link, text, sha, mark, refers in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "sha", "tie", "refers"))):
                to = None if refers is None else uri(refers["id"], refers["tie"])
                for r in page_records(uri(page_id, mark), page_id, link, text.encode(), base64.b32encode(bytes.fromhex(sha)).decode(), to, date, segment_bytes):
                    held.append(r)
                    size += len(r)
                    if size >= archive_bytes:
                        yield flush()
                        n, held, size = n + 1, [], 0
        if held:
            yield flush()

    rows.mapInArrow(pack, "archive string, content binary").write.option("compression", "zstd").option("maxRecordsPerFile", 8).parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of .warc and .warc.gz files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def parse(content: bytes):
    """(headers by lower-case name, block) of each record of an archive."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = content[at:end].decode().split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        yield headers, content[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def read_records(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row for each page in the archives: record_id, id, url, record_type, refers_to (id), payload_digest, payload_bytes, payload, problem."""
    shape = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])

    def bare(x):
        return x and x.strip("<>")

    def decoded(block, stated):
        try:
            payload = http_payload(block)
        except ValueError as e:
            return None, None, None, str(e)
        digest = base32_digest(payload)
        return digest, len(payload), payload if with_payload else None, None if stated in (None, digest) else "payload digest differs"

    def rows(batches):
        for batch in batches:
            for content in batch.column("content"):
                out = []
                for h, block in parse(content.as_py()):
                    kind, url = h["warc-type"], h.get("warc-target-uri")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    stated = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    part = int(h.get("warc-segment-number", 0))
                    row = dict.fromkeys(shape.names) | {"kind": kind, "record_id": bare(h["warc-record-id"]), "id": int(h["warc-page-id"]) if "warc-page-id" in h else None, "url": url and unquote(url), "refers_to": bare(h.get("warc-refers-to")), "payload_digest": stated}
                    if part:
                        row |= {"kind": "segment", "segment": part, "origin": bare(h.get("warc-segment-origin-id")) or row["record_id"], "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, "payload": block}
                    elif kind == "response":
                        row["payload_digest"], row["payload_bytes"], row["payload"], row["problem"] = decoded(block, stated)
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, shape)

    found = materialize(archives.select("content").mapInArrow(rows, RECORDS), "warc-records")
    cut = found.filter("kind = 'segment'").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "payload"))).alias("parts"), F.max("total").alias("total"), F.max("id").alias("id"), F.max("url").alias("url"), F.max("payload_digest").alias("stated"))

    def join(batches):
        for batch in batches:
            out = []
            for origin, parts, total, page_id, url, stated in zip(*(batch.column(c).to_pylist() for c in ("origin", "parts", "total", "id", "url", "stated"))):
                row = dict.fromkeys(shape.names) | {"kind": "response", "record_id": origin, "id": page_id, "url": url, "payload_digest": stated}
                block = b"".join(p["payload"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or total != len(block):
                    row["problem"] = "segments are missing"
                else:
                    row["payload_digest"], row["payload_bytes"], row["payload"], row["problem"] = decoded(block, stated)
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, shape)

    whole = found.filter("kind = 'response'").unionByName(cut.mapInArrow(join, RECORDS))
    if not with_payload:
        whole = materialize(whole, "warc-whole")
    visits = found.filter("kind = 'revisit'")
    known = whole.select(F.col("record_id").alias("_r"), F.col("id").alias("_id"), F.col("payload_bytes").alias("_n"), F.col("payload_digest").alias("_d"), F.col("payload").alias("_p"))
    visits = visits.join(known, F.col("refers_to") == F.col("_r"), "left")
    lost = F.when(F.col("_r").isNull(), "what it refers to is missing").when(F.col("_d") != F.col("payload_digest"), "payload digest differs")
    columns = ["record_id", "id", "url"]
    visits = visits.select(*columns, F.col("kind").alias("record_type"), F.col("_id").alias("refers_to"), "payload_digest", F.col("_n").alias("payload_bytes"), F.col("_p").alias("payload"), lost.alias("problem"))
    return whole.select(*columns, F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload_digest", "payload_bytes", "payload", "problem").unionByName(visits)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    pages = pages.select("page_id", "url", "html", F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("at"))
    path = new_path(spark, "archives")
    write_archives(pages, path, tie="at")
    read = read_records(spark.read.schema("archive string, content binary").parquet(path), with_payload=False)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(sha, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), 'string_agg', '') AS digest,
        row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS rn, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS lead FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN rn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN rn > 1 THEN lead END AS refers_to FROM b
"""
