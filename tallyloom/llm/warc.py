"""WARC archives with a two-level capture index.

Archives hold one gzip member per record. The index sorts captures by a key of the reversed host
and packs them into compressed blocks; a sparse directory keeps each block's first key and place.
A capture is found by binary search in the directory, one range read for its block, binary search
in the block, and one range read for its record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_rows, materialize, new_path, table
from .url_filter import parts

LINES = 512  # captures in a block


def capture_key(pages: DataFrame) -> DataFrame:
    """pages with `key`: the reversed-host key com,example,www)/path?query of url, and the page's id.

    White space of the address itself becomes %20; without a host the key begins with ')'.
    """
    named = parts(pages)
    way = F.coalesce(F.substring("node", F.length("host") + 1, F.length("node")), F.lit(""))
    surt = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), ","), F.lit(")"), way)
    key = F.concat_ws(" ", F.regexp_replace(surt, r"\s", "%20"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    return named.withColumn("key", key).drop("host", "path", "node")


def _gzip(data: bytes, level: int = 1) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def record(page_id, url: str | None, payload: bytes, first) -> bytes:
    """One WARC record: a response with its payload, or (first given) a revisit of page `first` without."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head.encode() + (payload if first is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers of a record by lower-case name, and its payload (as far as it holds one)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    out = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        out[name.lower()] = value
    body = rest[: int(out["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    out["payload"] = payload
    out["payload-bytes"] = int(http.rpartition(b"Content-Length: ")[2])
    return out


def _page(urn: str | None) -> str | None:
    return urn[len("<urn:page:") : -1] or None if urn else None


@dataclass
class Archive:
    """Where the archives and their index lie. captures: key, file, begin, length. directory: key, file, begin, length, lines."""

    folder: str
    captures: DataFrame
    directory: DataFrame


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, file_bytes: int = 256 << 20) -> Archive:
    """Write a record for every row of pages (page_id, url, html) and index them.

    Of payloads of at least least_bytes that are equal, the one of the smallest page_id is a response
    (rows that repeat that page_id all are) and the others revisit it; a null page_id never comes
    first unless all are null (then all are responses). A null html is an empty payload, a null url
    leaves its header out. An empty table gives empty archives.
    Tasks write their own files in the shared folder; a file that a failed attempt left is in no index.
    """
    folder = folder or new_path(long_rows(pages).sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    named = pages.select("page_id", "url", payload.alias("payload"))
    same = F.sha1("payload")
    dups = named.where(F.octet_length("payload") >= least_bytes).select("page_id", same.alias("sha")).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    dups = materialize(dups.where("n > 1"), "payloads")
    plan = _first_pages(capture_key(named.withColumn("sha", same)), dups)
    plan = plan.select("key", "page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("first"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for key, page, url, data, first in zip(*b.columns, strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid4().hex}.warc.gz", 0
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    packed = _gzip(record(page.as_py(), url.as_py(), data.as_py(), first.as_py()))
                    out.write(packed)
                    rows.append((key.as_py(), name, at, len(packed)))
                    at += len(packed)
                yield _rows(rows, [("key", pa.string()), ("file", pa.string()), ("begin", pa.int64()), ("length", pa.int64())])
        finally:
            if out is not None:
                out.close()

    captures = materialize(plan.mapInArrow(put, "key string, file string, begin long, length long"), "captures")
    return Archive(folder, captures, _index(captures, folder))


def _first_pages(named: DataFrame, dups: DataFrame, most: int = 200_000) -> DataFrame:
    """named (sha, page_id, url, payload, key) with `first`, by dups (sha, first, n).

    At most `most` payloads are broadcast. Beyond that the most frequent ones, `most` of them at most, are, so that they
    gather in no task; rows of the others are joined by sha, each with few copies.
    """
    if dups.count() <= most:
        return named.join(F.broadcast(dups.select("sha", "first")), "sha", "left")
    total = dups.agg(F.sum("n")).first()[0]
    often = F.col("n") > max(100, total // most)
    hot = F.broadcast(dups.where(often).select("sha", F.col("first").alias("hot")))
    rare = dups.where(~often).select("sha", "first")
    told = named.join(hot, "sha", "left")
    # a sha with few copies is no hot key; rows of frequent ones have none here and are spread by their page
    key = F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("of "), F.xxhash64("page_id", "url").cast("string")))
    return told.withColumn("sha", key).join(rare, "sha", "left").withColumn("first", F.coalesce("hot", "first")).drop("hot")


def _rows(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _tasks(df: DataFrame, n: int) -> int:
    """At least the session's parallelism, so that few large tasks are not made of many small keys."""
    return max(n, df.sparkSession.sparkContext.defaultParallelism)


def _index(captures: DataFrame, folder: str, task_lines: int = 200_000) -> DataFrame:
    """Sort captures by key, pack every LINES of them into a block, and return the directory."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at, lines = None, f"{uuid4().hex}.idx.gz", 0, []

        def block():
            nonlocal out, at
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            data = _gzip("\n".join(lines).encode(), 6)
            out.write(data)
            row = (_key(lines[0]), name, at, len(data), len(lines))
            at += len(data)
            lines.clear()
            return _rows([row], [("key", pa.string()), ("file", pa.string()), ("begin", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])

        try:
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    lines.append("\t".join(map(str, row)))
                    if len(lines) == LINES:
                        yield block()
            if lines:
                yield block()
        finally:
            if out is not None:
                out.close()

    ordered = captures.repartitionByRange(_tasks(captures, captures.count() // task_lines), "key", "file", "begin").sortWithinPartitions("key", "file", "begin")
    return materialize(ordered.mapInArrow(pack, "key string, file string, begin long, length long, lines long"), "directory")


def _key(line: str) -> str:
    return line.rsplit("\t", 3)[0]


class Reader:
    """Range reads from the archives' folder. Keeps a few blocks and the open files of one task."""

    def __init__(self, folder: str, blocks: int = 8):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.files, self.blocks, self.most = OrderedDict(), OrderedDict(), blocks

    def read(self, file: str, begin: int, length: int) -> bytes:
        if file not in self.files:
            if len(self.files) > 32:
                self.files.popitem(last=False)[1].close()
            self.files[file] = self.store.open_input_file(f"{self.root}/{file}")
        return zlib.decompress(self.files[file].read_at(length, begin), 31)

    def block(self, file: str, begin: int, length: int) -> list[str]:
        if (file, begin) not in self.blocks:
            if len(self.blocks) >= self.most:
                self.blocks.popitem(last=False)
            self.blocks[file, begin] = self.read(file, begin, length).decode().split("\n")
        return self.blocks[file, begin]


FIELDS = [("key", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]
KINDS = "key string, page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _captures(reader: Reader, lines: list[str], with_payload: bool) -> Iterator[tuple]:
    for line in lines:
        key, file, begin, length = line.rsplit("\t", 3)
        x = parse(reader.read(file, int(begin), int(length)))
        if x["warc-type"] == "response" and f"sha1:{base64.b32encode(hashlib.sha1(x['payload']).digest()).decode()}" != x["warc-payload-digest"]:
            raise ValueError(f"damaged record {file} at {begin}")
        yield key, _page(x["warc-record-id"]), x.get("warc-target-uri"), x["payload"] if with_payload else None, x["payload-bytes"], x["warc-payload-digest"].removeprefix("sha1:"), x["warc-type"], _page(x.get("warc-refers-to"))


def lookup(archive: Archive, keys: DataFrame, with_payload: bool = True, most_blocks: int = 200_000, task_bytes: int = 128 << 20) -> DataFrame:
    """The captures (KINDS) of every distinct key in keys (column key); unknown keys and null give none.

    The directory goes to the tasks if it has most_blocks entries at most; beyond that all blocks are
    read by read_all() and joined with the keys. A task looks up so many keys as would read about task_bytes of archives.
    """
    folder = archive.folder
    wanted = keys.select("key").where("key is not null").distinct()
    if len(head := archive.directory.limit(most_blocks + 1).collect()) > most_blocks:
        return read_all(archive, with_payload).join(wanted, "key", "left_semi")
    directory = sorted((tuple(r) for r in head), key=lambda r: r[:3])
    firsts = [r[0] for r in directory]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for key in b.column(0).slice(at, 256).to_pylist():
                    # the last block that begins before the key, and all that begin with it
                    for block in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
                        lines = reader.block(*directory[block][1:4])
                        own = lines[bisect_left(lines, key, key=_key) : bisect_right(lines, key, key=_key)]
                        rows += _captures(reader, own, with_payload)
                yield _rows(rows, FIELDS)

    size = archive.captures.agg(F.sum("length")).first()[0] or 0
    return wanted.repartitionByRange(_tasks(wanted, size // task_bytes), "key").sortWithinPartitions("key").mapInArrow(run, KINDS)


def read_all(archive: Archive, with_payload: bool = True) -> DataFrame:
    """All captures (KINDS), block by block."""
    folder = archive.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for b in batches:
            for file, begin, length in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                lines = reader.block(file, begin, length)
                for at in range(0, len(lines), 256):
                    yield _rows(list(_captures(reader, lines[at : at + 256], with_payload)), FIELDS)

    return archive.directory.mapInArrow(run, KINDS)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back by their keys; see write() and lookup()."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = lookup(write(pages), capture_key(pages.select("page_id", "url")), with_payload=False)
    return found.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


#: The same rows in DuckDB SQL: the hex digest is regrouped into 32 letters of five bits.
SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
f as (select sha, min(page_id) as first, count(*) as n from p group by sha),
d as (select sha, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + v, 1), '' order by i) as payload_digest from (
  select sha, i, (((instr('0123456789abcdef', substr(sha, 1 + (5 * i) // 4, 1)) - 1) * 16
    + greatest(instr('0123456789abcdef', substr(sha || '0', 2 + (5 * i) // 4, 1)) - 1, 0)) // cast(pow(2, 3 - (5 * i) % 4) as bigint)) % 32 as v
  from (select distinct sha from p) cross join (select unnest(range(0, 32)) as i)) group by sha)
select page_id, cast(strlen(html) as bigint) as payload_bytes, payload_digest,
  case when page_id is not null and page_id <> first or page_id is null and first is not null then 'revisit' else 'response' end as record_type,
  case when page_id is not null and page_id <> first or page_id is null and first is not null then first end as refers_to
from p join f using (sha) join d using (sha)
"""
