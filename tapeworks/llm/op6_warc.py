"""WARC: a deterministic sharded writer, and a reader of what it committed.

Records are sorted by payload digest and, within one, by descending page id, so the response of equal payloads comes
first and its revisits follow without a join. Shards are ranges of that order with near equal bytes, found by the
exact histogram of the sharding operator; a digest with very many pages is cut between page ids, and the few
responses that such cuts leave in an earlier shard are looked up beforehand.

A task writes the shards it gets record by record: each record is its own gzip member, a file is closed when its
compressed size reaches ``roll_bytes`` and the next one begins. Files are written under a temporary name and then renamed;
names and bytes depend on the records alone, so a repeated task replaces its files by equal ones. The manifest is
written last: readers only open what it lists, and check sizes and digests.

Files are reached through ``pyarrow.fs`` by the URI of the target folder, which all executors must share.

Defined results: null html is an empty payload; null urls leave the target out; rows without a page id are responses and
come last among equal payloads; rows that share page id and payload are all responses where one is; an empty
table gives an empty manifest. Extra columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.op9_sharding import histogram_ranges, in_ranges
from tapeworks.llm.shared import table
from tapeworks.session import scratch_path, staged

LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record_id(page_id: int | None, digest: str, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(
    page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None, date: str
) -> bytes:
    """One uncompressed record; without a payload it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    headers = [("WARC-Type", "response" if payload is not None else "revisit")]
    headers.append(("WARC-Record-ID", _record_id(page_id, digest, url)))
    headers.append(("WARC-Date", date))
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%")))
    if payload is None:
        headers.append(("WARC-Profile", PROFILE))
        headers.append(("Refers-To-Page-ID", refers_to))
    if page_id is not None:
        headers.append(("Page-ID", page_id))
    headers.append(("WARC-Payload-Digest", f"sha1:{_base32(digest)}"))
    headers.append(("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).hexdigest())}"))
    headers.append(("Content-Type", "application/http; msgtype=response"))
    headers.append(("Content-Length", len(block)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    """A gzip member without a time, so that equal records give equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))


class _Files:
    """Files of one shard: the open one under a temporary name, and the manifest rows of closed ones."""

    def __init__(self, store, root: str, shard: int, roll_bytes: int) -> None:
        self.store, self.root, self.shard, self.roll = store, root, shard, roll_bytes
        self.seq, self.stream, self.done = -1, None, []

    def add(self, member: bytes) -> None:
        if self.stream is None:
            self.seq += 1
            self.name = f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.part = f"{self.root}/_part-{uuid.uuid4().hex}"
            self.stream, self.digest, self.size, self.records = (
                self.store.open_output_stream(self.part, compression=None), hashlib.sha256(), 0, 0,
            )
        self.stream.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.stream is None:
            return
        self.stream.close()
        self.stream = None
        try:
            self.store.move(self.part, f"{self.root}/{self.name}")
        except OSError:
            # some stores don't replace: an earlier attempt of this task left the same bytes
            if self.store.get_file_info(f"{self.root}/{self.name}").size != self.size:
                raise
            self.store.delete_file(self.part)
        self.done.append((self.shard, self.seq, self.name, self.records, self.size, self.digest.hexdigest()))


def write_warc(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    shard_bytes: int = 16 << 20, roll_bytes: int = 4 << 20, most_shards: int = 20_000, date: str = "2024-01-01T00:00:00Z", level: int = 5,
) -> DataFrame:
    """Write one record per row into ``folder`` and return the committed manifest.

    Each shard is one task's work. Beyond ``most_shards`` shards they grow instead, and roll more files each.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    size, digest = F.octet_length(body).cast("long"), F.sha1(F.encode(body, "UTF-8"))
    # 60 bits of the digest over the whole span of longs, then descending ids; a missing id comes last
    high = (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") - (1 << 59)) * 16
    low = F.coalesce(F.bitwise_not(F.col(page_id).cast("long")), F.lit((1 << 63) - 1))
    keys = pages.select(
        F.col(page_id).cast("long").alias("page_id"), digest.alias("digest"), size.alias("size"),
        high.alias("high"), low.alias("low"), (size + 600).alias("weight"),
    )
    keys = staged(keys, "warc-keys")
    total = keys.agg(F.sum("weight")).first()[0] or 0
    shards = max(1, min(most_shards, -(-total // shard_bytes)))
    placed = histogram_ranges(keys, shards, tolerance=0.05)
    # digests that begin in an earlier shard than they end in: one per border at most
    cut = [b.first[0] for (a, s), (b, t) in zip(placed, placed[1:]) if s != t and a.last[0] == b.first[0]]
    earlier = {}
    if cut:
        tops = keys.where(F.col("high").isin(cut) & (F.col("size") >= LEAST_REVISIT)).groupBy("digest")
        earlier = {r[0]: r[1] for r in tops.agg(F.max("page_id").alias("top")).collect()}
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"),
        digest.alias("digest"), high.alias("high"), low.alias("low"),
    )
    rows = in_ranges(rows, placed).drop("range", "offset")
    rows = rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "high", "digest", "low", "url")
    rows = rows.select("shard", "page_id", "url", "html", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        files, before, top = None, None, None
        for batch in batches:
            for shard, pid, link, text, sha in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        yield manifest_rows(files.done)
                    files, before = _Files(store, root, shard, roll_bytes), None
                payload = text.encode()
                if sha != before:
                    before, top = sha, earlier.get(sha, pid)
                revisit = len(payload) >= LEAST_REVISIT and pid is not None and top is not None and pid != top
                kept, refers_to = (None, top) if revisit else (payload, None)
                files.add(_member(record_bytes(pid, link, sha, len(payload), kept, refers_to, date), level))
        if files is not None:
            files.close()
            yield manifest_rows(files.done)

    def manifest_rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(c, t) for c, t in zip(
                zip(*done, strict=True),
                (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True,
            )
        ], names=["shard", "seq", "file", "records", "bytes", "sha256"])

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _members(data) -> Iterator[bytes]:
    """Uncompressed records of a stream of gzip members."""
    rest = b""
    while True:
        chunk = rest or data.read(1 << 20)
        if not chunk:
            return
        reader, parts = zlib.decompressobj(31), []
        while True:
            parts.append(reader.decompress(chunk))
            if reader.eof:
                break
            chunk = data.read(1 << 20)
            if not chunk:
                raise ValueError("a record is cut off")
        rest = reader.unused_data
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple:
    """Values of ``RECORDS``; digests and lengths are checked against the content."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    length = int(fields["Content-Length"])
    block, ending = rest[:length], rest[length:]
    if lines[0] != "WARC/1.1" or len(block) != length or ending != b"\r\n\r\n":
        raise ValueError("not a whole record")
    if fields["WARC-Block-Digest"] != f"sha1:{_base32(hashlib.sha1(block).hexdigest())}":
        raise ValueError("the block does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.split(b"Content-Length: ")[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind, refers = fields["WARC-Type"], fields.get("Refers-To-Page-ID")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload does not match its digest")
    page = fields.get("Page-ID")
    return (
        int(page) if page else None, fields.get("WARC-Target-URI"), size, digest, kind, int(refers) if refers else None,
        payload if kind == "response" else None,
    )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all committed files of ``folder``; ``payload`` is null for revisits."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    n_files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{name}").size != size:
                    raise ValueError(f"{name} is not as committed")
                out, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as data:
                    for raw in _members(data):
                        out.append(parse_record(raw))
                        held += len(raw)
                        if held > 4 << 20:
                            yield records(out)
                            out, held = [], 0
                if out:
                    yield records(out)

    def records(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names
        )

    files = manifest.select("file", "bytes").repartition(min(n_files, 20_000), "file")
    return files.mapInArrow(run, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).drop("url", "payload")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM t
"""
