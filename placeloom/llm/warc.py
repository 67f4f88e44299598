"""WARC archives as chunked record tables.

An archive is a table of (archive, number, record_id, chunk, digest, data): the chunks of a record,
in order, are the literal bytes of a WARC/1.1 record, and the records of an archive, in order of
their numbers, are a WARC file.  Chunk 0 is the header, the last one the record's end; payload
chunks have a bounded size and carry the SHA-1 of the payload up to their end, so neither writer
nor reader holds a record as a whole: payloads are cut before they leave the table that holds
them, digested chunk by chunk and written as rows, and types are decided on one small row a record.

Records with equal payloads of a least size are written once: the one with the smallest page_id
is a response, the others are revisits that refer to it by its record identifier and carry no
payload.

Defined results: a null payload is the empty one; a null url is written as an empty target; of
rows that share the smallest page_id one is the response; rows with a null page_id are never the
response of another row, so copies that all lack ids are all responses; repeated page_ids each give
a record; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import discard, materialize, table

CHUNK_BYTES = 1 << 20
#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 0
#: Keys of records or payloads that are broadcast; more are joined by an exchange.
KEYS_BOUND = 300_000
#: Parts of which rows of one payload are spread where they are joined by an exchange.
SPREAD = 32
#: The date of records that state none, the profile of revisits, the end of records.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
_PAYLOAD = "archive int, number bigint, page_id bigint, url string, chunk int, last boolean, size bigint, digest string, second bigint, data binary"
CHUNK_SCHEMA = "archive int, number bigint, record_id string, chunk int, digest string, data binary"
RECORD_SCHEMA = "page_id bigint, record_id string, record_type string, target string, refers_to bigint, payload_bytes bigint, payload_digest string, intact boolean"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def parse_header(block: bytes) -> dict[str, str]:
    """Fields of a header block, names in lower case."""
    lines = block.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def record_id(page_id: Column, archive: Column, number: Column) -> Column:
    """The identifier of a record, from which its page_id can be read back."""
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), archive.cast("string"), F.lit(":"), number.cast("string"))


def page_of(identifier: str) -> int | None:
    """The page_id in a record identifier of ours."""
    parts = identifier.strip("<>").split(":")
    return int(parts[2]) if parts[:2] == ["urn", "page"] and len(parts) == 5 and parts[2] else None


def payload_chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Payloads as rows of bounded size, numbered by record and chunk, with running digests (see ``_PAYLOAD``); to be written."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    plain = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    n = F.greatest(F.ceil(F.octet_length("html") / chunk_bytes), F.lit(1)).cast("int")
    each = plain.select("page_id", "url", "html", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("chunk"))
    data = F.substring(F.col("html"), (F.col("chunk") - 1) * chunk_bytes + 1, F.lit(chunk_bytes))
    cut = each.select("page_id", "url", "chunk", (F.col("chunk") == F.col("n")).alias("last"), data.alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive = TaskContext.get().partitionId()
        number, size = 0, 0
        sha, second = hashlib.sha1(), xxhash.xxh3_64()
        for batch in batches:
            numbers, sizes, digests, seconds = [], [], [], []
            for i, first in enumerate(c == 1 for c in batch.column(2).to_pylist()):
                if first:
                    number, size = number + 1, 0
                    sha, second = hashlib.sha1(), xxhash.xxh3_64()
                data = memoryview(batch.column(4)[i].as_buffer())
                sha.update(data)
                second.update(data)
                size += len(data)
                numbers.append(number)
                sizes.append(size)
                digests.append(base64.b32encode(sha.digest()).decode())
                seconds.append(second.intdigest() - (1 << 63))
            page_id, url, chunk, last, body = batch.columns
            columns = [pa.array([archive] * len(numbers), pa.int32()), pa.array(numbers, pa.int64()), page_id, url, chunk, last, pa.array(sizes, pa.int64()), pa.array(digests), pa.array(seconds, pa.int64()), body]
            yield pa.RecordBatch.from_arrays(columns, names=_names(_PAYLOAD))

    return cut.mapInArrow(run, _PAYLOAD)


def assign_types(payloads: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """One row a record of the written table ``payload_chunks``: its last chunk's columns without data, and the response it refers to (null: it is one)."""
    known = payloads.where("last").drop("data", "last")
    # a collision of SHA-1 is told apart by a second digest
    key = ["digest", "second", "size"]
    firsts = (
        known.where((F.col("size") >= least) & F.col("page_id").isNotNull())
        .groupBy(*key)
        .agg(F.min(F.struct("page_id", "archive", "number")).alias("first"))
    )
    copies = known.where(F.col("size") >= least).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = materialize(firsts.join(copies, key), "firsts")
    if firsts.count() <= KEYS_BOUND:
        joined = known.join(F.broadcast(firsts), key, "left")
    else:
        # rows of one payload may be a third of all
        part = F.pmod(F.xxhash64("archive", "number"), F.lit(SPREAD)).cast("int")
        spread = firsts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        joined = known.withColumn("part", part).join(spread, [*key, "part"], "left").drop("part")
    own = (F.col("archive") == F.col("first.archive")) & (F.col("number") == F.col("first.number"))
    return joined.withColumn("first", F.when(~own, F.col("first")))


def _headers(typed: DataFrame) -> DataFrame:
    """Header and end rows of the records."""
    own = record_id(F.col("page_id"), F.col("archive"), F.col("number"))
    refers = record_id(F.col("first.page_id"), F.col("first.archive"), F.col("first.number"))
    again = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    target = F.trim(F.regexp_replace(F.coalesce("url", F.lit("")), r"[\s\p{Z}\p{Cc}]+", " "))
    fields = [
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), own, F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, 0).otherwise(F.col("size")).cast("string")),
        F.when(again, line("WARC-Profile", F.lit(PROFILE))),
        F.when(again, line("WARC-Refers-To", F.concat(F.lit("<"), refers, F.lit(">")))),
        F.when(again, line("WARC-Refers-To-Payload-Length", F.col("size").cast("string"))),
    ]
    head = F.encode(F.concat(F.concat_ws("\r\n", *fields), F.lit("\r\n\r\n")), "UTF-8")
    ends = F.array(
        F.struct(F.lit(0).alias("chunk"), head.alias("data")),
        F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(END).alias("data")),
    )
    rows = typed.select("archive", "number", own.alias("record_id"), F.explode(ends).alias("r"))
    return rows.select("archive", "number", "record_id", "r.chunk", F.lit(None).cast("string").alias("digest"), "r.data")


def write_archives(pages: DataFrame, least: int = REVISIT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The written chunked record table of ``pages`` (page_id, url, html); each task that reads pages numbers an archive."""
    payloads = materialize(payload_chunks(pages, chunk_bytes), "payloads")
    typed = materialize(assign_types(payloads, least), "types")
    revisits = materialize(typed.where("first IS NOT NULL").select("archive", "number"), "revisits")
    few = revisits.count() <= KEYS_BOUND
    body = payloads.where(F.octet_length("data") > 0).join(F.broadcast(revisits) if few else revisits, ["archive", "number"], "left_anti")
    body = body.select("archive", "number", record_id(F.col("page_id"), F.col("archive"), F.col("number")).alias("record_id"), "chunk", "digest", "data")
    written = materialize(_headers(typed).unionByName(body), "warc")
    discard(payloads, typed, revisits)
    return written


class _Reader:
    """One record at a time: header fields, then a running digest over its chunks."""

    def __init__(self, key: tuple[int, int]):
        self.key = key
        self.head = b""
        self.fields: dict[str, str] | None = None
        self.left = 0
        self.digest = hashlib.sha1()
        self.agrees = True

    def feed(self, data: bytes, stated: str | None) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(END)
            if end < 0:
                return
            self.fields, data = parse_header(self.head[:end]), self.head[end + 4 :]
            self.left = int(self.fields.get("content-length", 0))
            self.head = b""
        body = data[: self.left] if self.left < len(data) else data
        self.left -= len(body)
        self.digest.update(body)
        # a chunk that carries a digest is checked at once
        if stated is not None and stated != base64.b32encode(self.digest.digest()).decode():
            self.agrees = False

    def row(self) -> tuple:
        f = self.fields or {}
        kind = f.get("warc-type", "")
        own = f.get("warc-record-id", "").strip("<>")
        stated = f.get("warc-payload-digest", "").removeprefix("sha1:")
        got = base64.b32encode(self.digest.digest()).decode()
        if kind == "revisit":
            refers = page_of(f.get("warc-refers-to", ""))
            size, digest, intact = int(f.get("warc-refers-to-payload-length", 0)), stated, self.left == 0
            return (page_of(own), own, kind, f.get("warc-target-uri"), refers, size, digest, intact)
        size = int(f.get("content-length", 0))
        return (page_of(own), own, kind, f.get("warc-target-uri"), None, size, got, self.left == 0 and self.agrees and got == stated)


def read_chunks(chunks: DataFrame) -> DataFrame:
    """Records of a chunked record table (see ``RECORD_SCHEMA``), chunk after chunk."""
    ordered = chunks.select("archive", "number", "chunk", "digest", "data").repartition("archive", "number").sortWithinPartitions("archive", "number", "chunk")
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_names(RECORD_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        rows: list[tuple] = []
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for i, key in enumerate(keys):
                if reader is None or reader.key != key:
                    if reader is not None:
                        rows.append(reader.row())
                    reader = _Reader(key)
                reader.feed(batch.column(4)[i].as_py(), batch.column(3)[i].as_py())
            if len(rows) >= 1000:
                yield made(rows)
                rows = []
        if reader is not None:
            rows.append(reader.row())
        if rows:
            yield made(rows)

    return ordered.mapInArrow(run, RECORD_SCHEMA)


def export(chunks: DataFrame, archive: int, out: BinaryIO) -> None:
    """Stream one archive of a chunked record table into a WARC file, chunk by chunk."""
    own = chunks.where(F.col("archive") == archive).orderBy("number", "chunk").select("data")
    for row in own.toLocalIterator():
        out.write(row[0])


def chunks_of(stream: BinaryIO, archive: int = 0, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Chunk rows of a WARC file, read in bounded pieces, with running digests."""
    number = 0
    while first := stream.readline():
        if first in (b"\r\n", b"\n"):
            continue
        block = first
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            block += line
        fields = parse_header(block.rstrip(b"\r\n"))
        number += 1
        own = fields.get("warc-record-id", "").strip("<>")
        yield (archive, number, own, 0, None, block + b"\r\n")
        left, chunk = int(fields.get("content-length", 0)), 0
        sha = hashlib.sha1()
        while left:
            piece = stream.read(min(left, chunk_bytes))
            if not piece:
                raise ValueError("a record ends early")
            left -= len(piece)
            chunk += 1
            sha.update(piece)
            yield (archive, number, own, chunk, base64.b32encode(sha.digest()).decode(), piece)
        yield (archive, number, own, chunk + 1, None, END)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    archives = write_archives(table(spark, sf_dir, "pages"))
    return read_chunks(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((g >> {}) & 31), 1)"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, string_agg({' || '.join(_DIGIT.format(s) for s in (15, 10, 5, 0))}, '' ORDER BY i) AS payload_digest
      FROM (SELECT h, i, CAST('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER) AS g FROM (SELECT DISTINCT h FROM p), range(8) r(i)) GROUP BY h),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT p.page_id, p.payload_bytes, d.payload_digest, CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p JOIN d ON p.h = d.h JOIN f ON p.html = f.html
"""
