"""WARC archives with a globally ordered index by external merge.

Tasks write runs: an archive file of bounded size each in the shared folder, one gzip member a record,
and its index lines sorted by URL key and timestamp. The lines of all runs are dealt out by ranges of
the key; each range is merged from its runs with a loser tree, which gives every URL's captures in
order, and all URLs in order over the ranges. Archives are read back file by file, each in one pass beside
its index lines.

A record whose payload of at least MIN_REVISIT bytes was captured before (by a smaller page id) is
written as a revisit that refers to that response.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from io import BytesIO
from itertools import chain, groupby, islice, zip_longest
from operator import itemgetter
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_REVISIT = 100
RUN_BYTES = 24_000_000
READ_BYTES = 1 << 20
#: Tasks that read archives back: two a file, so that few get several, up to so many.
READ_TASKS = 20_000
#: Of the payloads that recur, at most so many are broadcast, the most common; the others are joined by shuffle.
BROADCAST_ROWS = 200_000
START = datetime(2024, 1, 1, tzinfo=UTC)
LINE = "run string, url_key string, captured string, page_id bigint, file string, at bigint, size bigint"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, in lower case."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", (url or "").lower())
    if not m:
        return (url or "").lower()
    return ",".join(reversed(m[1].split("."))) + ")" + (m[2] or "/")


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def record(kind: str, page_id: int, url: str, captured: str, digest: str, payload: bytes, full: int, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full}\r\n\r\n".encode()
    body = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Date: {captured}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def members(source: BinaryIO | bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, contents) of the gzip members of a stream, one member held at a time."""
    source = BytesIO(source) if isinstance(source, bytes) else source
    at, chunk = 0, source.read(READ_BYTES)
    while chunk:
        reader, parts, begin = zlib.decompressobj(31), [], at
        while chunk:
            parts.append(reader.decompress(chunk))
            at += len(chunk) - len(reader.unused_data)
            chunk = reader.unused_data or source.read(READ_BYTES)
            if reader.eof:
                break
        if not reader.eof:
            raise ValueError(f"the member at {begin} ends early")
        yield begin, b"".join(parts)


class LoserTree:
    """Merges sorted sequences: inner nodes keep the losers of their matches, the winner goes up."""

    def __init__(self, sources: Iterable[Iterable]):
        self.sources = [iter(s) for s in sources]
        self.leaves = len(self.sources)
        self.heads = [next(s, None) for s in self.sources]
        self.losers = [0] * max(1, self.leaves)
        self.winner = self._build(1) if self.leaves > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _build(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._beats(a, b):
            self.losers[node] = b
            return a
        self.losers[node] = a
        return b

    def __iter__(self) -> Iterator:
        while self.leaves and self.heads[self.winner] is not None:
            own = self.winner
            yield self.heads[own]
            self.heads[own] = next(self.sources[own], None)
            node = (own + self.leaves) // 2
            while node >= 1:
                if self._beats(self.losers[node], own):
                    self.losers[node], own = own, self.losers[node]
                node //= 2
            self.winner = own


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write page_id, url, payload, digest, refers_to as archives; returns the index lines, sorted within runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"  # an attempt that is lost leaves files that no line names
        number, out, at, lines = 0, None, 0, []

        def closed():
            out.close()
            rows = sorted(lines, key=lambda x: (x[1], x[2], x[3] is not None, x[3]))
            names, kinds = zip(*(c.split() for c in LINE.split(", ")))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                for r in batch.slice(begin, 200).to_pylist():
                    if out is None:
                        number += 1
                        file = f"{base}/{name}-{number:05d}.warc.gz"
                        out, at, lines = filesystem.open_output_stream(file, compression=None), 0, []
                    page, payload, refers = r["page_id"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["refers_to"]
                    captured = (START + timedelta(seconds=(page or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = record("response" if refers is None else "revisit", page, r["url"], captured, r["digest"], payload, len(payload), refers)
                    data = packer.compress(data) + packer.flush()
                    out.write(data)
                    lines.append((file, url_key(r["url"]), captured, page, file, at, len(data)))
                    at += len(data)
                    if at >= RUN_BYTES:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, LINE)


def merged_index(lines: DataFrame) -> DataFrame:
    """The lines of all runs in one order: position (range, then place) grows with url_key, captured, page_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "file", "at", "size", "run"))):
                runs.setdefault(row[-1], []).append((row[0], row[1], row[2] if row[2] is not None else -(2**63), *row[3:6]))
        for own in runs.values():
            own.sort()  # linear where the shuffle has kept the run's order
        position, rows = TaskContext.get().partitionId() << 36, []
        for key, captured, page, file, at, size in LoserTree(runs.values()):
            rows.append((position, key, captured, file, at, size))
            position += 1
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["position", "url_key", "captured", "file", "at", "size"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["position", "url_key", "captured", "file", "at", "size"])

    return lines.repartitionByRange("url_key", "captured", "page_id", "file", "at").mapInArrow(run, "position bigint, url_key string, captured string, file string, at bigint, size bigint")


def read(index: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Every record that ``index`` names (file, at, position): page_id, payload_bytes, payload_digest, record_type,
    refers_to, position. A task reads its files one after the other, each in one pass beside its index lines, so that
    records need no join. Digest and length of a response are taken from its payload again."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def checked(file: str, lines: Iterable[tuple[str, int, int]], filesystem: fs.FileSystem) -> Iterator[tuple]:
        number = lambda urn: None if urn is None or urn == "<urn:page:None>" else int(urn[10:-1])
        with filesystem.open_input_stream(file, compression=None) as source:
            for (at, raw), line in zip_longest(members(source), lines, fillvalue=(None, None, None)):
                if at is None or at != line[1]:
                    raise ValueError(f"{file}: a record at {at}, an index line at {line[1]}")
                fields, payload = parse(raw)
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"][7:]
                size = int(re.search(rb"Content-Length: (\d+)\r\n\r\n", raw.partition(b"\r\n\r\n")[2])[1])
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{file} at {at}: the payload isn't what was written")
                yield number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To")), line[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _filesystem(folder)
        lines = (line for batch in batches for line in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "position"))))
        records = chain.from_iterable(checked(file, own, filesystem) for file, own in groupby(lines, itemgetter(0)))
        while rows := list(islice(records, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    dealt = index.select("file", "at", "position").repartition(tasks, "file").sortWithinPartitions("file", "at")
    return dealt.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, position bigint")


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to: the smallest page id with an equal payload of at least
    MIN_REVISIT bytes, where that isn't the row's own. Payloads that recur often travel to their pages; there are at
    most BROADCAST_ROWS of them, so no task gets all pages of a common one."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = C.small_batches(pages).select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    again = C.stored(own.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"))
    out = C.left_join_with_hot(own, again, ["digest"], "n", BROADCAST_ROWS)
    return out.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).select("page_id", "url", "html", "digest", "refers_to")


def archived(pages: DataFrame) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record, read the archives back, and return
    what they hold with each record's position in the merged index.

    Null pages have an empty payload; null urls an empty target; rows that repeat an id and payload are
    all responses; an empty table gives no rows; other columns are ignored."""
    folder = C.shared_folder(pages.sparkSession)
    lines = C.stored(write(with_revisits(pages), folder))
    files = lines.select("file").distinct().count()
    return read(merged_index(lines), folder, min(max(1, 2 * files), READ_TASKS))
