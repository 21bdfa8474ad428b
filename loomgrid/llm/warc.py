"""WARC archives: a distributed writer and a PySpark Python data source (format "warc").

Reading: the source lists the archives (.warc and .warc.gz) of a folder or file and plans partitions of about `split_bytes`
by their sizes alone. A task looks up in the archive's sidecar index (.idx, written beside it) which records begin in its
part; an archive without an index is one partition. Filters on record_type and on the header columns are pushed down. A
record's headers are parsed first; if a pushed filter fails or no payload column is asked for, the reader steps over the
block and decodes nothing: by the Content-Length in .warc; in .warc.gz, where each record is a gzip member of its own, by
the index, or without one by inflating the member without keeping it. The option columns names what is wanted (all by
default). With the option verify every block that is wanted is read, and its payload's length and SHA-1 must be those in the
headers; ValueError tells of the first record where they aren't.

Writing: one archive per task. In .warc, records are plain and payloads gzip (Content-Encoding in the HTTP header); in
.warc.gz each record is a gzip member around a plain payload. An archive is written under the task attempt's name and renamed
when whole, so a lost executor leaves no half archive. Folders can be local or any that pyarrow.fs reaches.

Of records with equal payloads of at least `least` bytes the one with the largest id is the response; the others are
revisits that refer to it and carry no payload, only its digest and length. Payloads are not shuffled to find them: groups are
formed of digests, and only those of several rows come back to the rows, in a broadcast if they are few; else a filter of
their digests keeps all other rows where they are. A null id is the smallest. Null payloads are empty. Rows that repeat the
response's id and payload are responses too; rows of a group that has no id at all are.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull

from loomgrid.llm import filters
from loomgrid.operators.shared import BROADCAST, cut

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
INDEX_EVERY = 4 << 20
SPLIT = 256 << 20

SCHEMA = "record_id string, record_type string, target_uri string, page_id long, payload_digest string, payload_bytes long, refers_to long, content_type string, block_bytes long, payload string"
HEADER_OF = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type"}
URN = "urn:page:"


def filesystem(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url.removeprefix("file:"))


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def page_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, plain: bool = False) -> bytes:
    name = lambda i: f"<{URN}{'none' if i is None else i}>"
    body = b"" if kind == "revisit" else payload if plain else gzip.compress(payload, 1, mtime=0)
    coding = "" if plain else "Content-Encoding: gzip\r\n"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{coding}Content-Length: {len(body)}\r\n\r\n".encode()
    headers = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url or "")), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    headers += [("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    return record(headers, http + body)


def _write(batches: Iterator[pa.RecordBatch], folder: str, index_every: int, members: bool) -> Iterator[pa.RecordBatch]:
    """Columns: id, url, payload, digest, kind, refers_to. Gives a row for the archive, if there are records."""
    system, root = filesystem(folder)
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    attempt = f"{root}/.attempt-{part}-{uuid.uuid4().hex}"
    at, last, index, n = 0, 0, [0], 0
    out = None
    pack = (lambda r: gzip.compress(r, 1, mtime=0)) if members else (lambda r: r)
    every = 0 if members else index_every  # members can only be stepped over by the index
    for batch in batches:
        for i, url, payload, digest, kind, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                out = system.open_output_stream(attempt)
                at = out.write(pack(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(part))}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
            if at - last >= every:
                index.append(at)
                last = at
            at += out.write(pack(page_record(i, url, (payload or "").encode(), digest, kind, to, members)))
            n += 1
    name = f"part-{part:06d}.warc{'.gz' * members}"
    if out is not None:
        out.close()
        with system.open_output_stream(f"{root}/{name}.idx") as side:
            side.write("\n".join(map(str, index)).encode())
        system.move(attempt, f"{root}/{name}")
    yield pa.RecordBatch.from_arrays([pa.array([name] * (n > 0)), pa.array([n] * (n > 0), pa.int64()), pa.array([at] * (n > 0), pa.int64())], names=["archive", "records", "bytes"])


def _split(batches: Iterator[pa.RecordBatch], table, hits: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose digest (the last column) the filter may hold, or the others."""
    for batch in batches:
        keys = np.array([int(d[:16], 16) for d in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64).view(np.int64)
        maybe = filters.might_hold_parts(table.value, keys)
        yield batch.filter(pa.array(maybe if hits else ~maybe))


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, broadcast: int = BROADCAST) -> DataFrame:
    """id, url, payload, digest, kind, refers_to of each row. Only digests are shuffled, if at most `broadcast` of them repeat;
    beyond, the rows too that a filter of those digests may hold."""
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = rows.where(F.octet_length("payload") >= least)
    groups = cut(large.groupBy("digest").agg(F.max("id").alias("to"), F.count("*").alias("n")).where("n > 1").select("digest", "to"))
    if groups.count() <= broadcast:
        found = rows.join(F.broadcast(groups), "digest", "left")
    else:
        key = F.conv(F.substring("digest", 1, 16), 16, -10).cast("long")
        keys = cut(groups.groupBy(filters.part_of_column(key).alias("part"), F.pmod(key, F.lit(64)).alias("salt")).agg(F.collect_list(key).alias("keys")).select("part", "keys"))
        table = pages.sparkSession.sparkContext.broadcast(filters.by_part(keys))
        kind = "id long, url string, payload string, digest string"
        deal = lambda hits: rows.select("id", "url", "payload", "digest").mapInArrow(partial(_split, table=table, hits=hits), kind)
        found = deal(False).withColumn("to", F.lit(None).cast("long")).unionAll(deal(True).join(groups, "digest", "left").select("id", "url", "payload", "digest", "to"))
    revisit = F.col("to").isNotNull() & ~F.col("id").eqNullSafe(F.col("to"))
    return found.select("id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("to")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, index_every: int = INDEX_EVERY, members: bool = False, broadcast: int = BROADCAST) -> DataFrame:
    """Writes a record per row below folder and returns (archive, records, bytes) of what was written. members: .warc.gz."""
    system, root = filesystem(folder)
    system.create_dir(root, recursive=True)
    work = partial(_write, folder=folder, index_every=index_every, members=members)
    done = plan_records(pages, page_id, url, payload, least, broadcast).mapInArrow(work, "archive string, records long, bytes long").collect()  # a row an archive
    return pages.sparkSession.createDataFrame(done, "archive string, records long, bytes long")


class Range(InputPartition):
    """The records that the index names at start or behind it and before end."""

    def __init__(self, path: str, start: int, end: int, indexed: bool):
        super().__init__((path, start, end))
        self.path, self.start, self.end, self.indexed = path, start, end, indexed


class WarcSource(DataSource):
    """Options: path (folder or archive), columns (comma-separated), split_bytes, verify."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        fields = dict(f.split(" ") for f in SCHEMA.split(", "))
        if unknown := [c for c in wanted if c not in fields]:
            raise ValueError(f"no such columns: {unknown}")
        return ", ".join(f"{c} {fields[c]}" for c in wanted or fields)

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options, schema.fieldNames())


class WarcReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT))
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.columns = columns
        self.tests: list[tuple[str, frozenset | None, bool]] = []  # column, allowed values, or null wanted

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            path = getattr(f, "attribute", ())
            column = path[0] if len(path) == 1 else ""
            if column not in HEADER_OF and column not in ("page_id", "refers_to"):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, frozenset([f.value]), False))
            elif isinstance(f, In):
                self.tests.append((column, frozenset(f.value), False))
            elif isinstance(f, IsNull):
                self.tests.append((column, None, True))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, None, False))
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, root = filesystem(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if not f.base_name.startswith(".")]
        indexed = {f.path for f in files if f.base_name.endswith(".idx")}
        if info.type == fs.FileType.File and system.get_file_info(info.path + ".idx").type == fs.FileType.File:
            indexed.add(info.path + ".idx")
        found = []
        for f in sorted(files, key=lambda f: f.path):
            if f.base_name.endswith((".warc", ".warc.gz")):
                step = self.split if f.path + ".idx" in indexed else max(1, f.size)
                found += [Range(f.path, s, min(f.size, s + step), f.path + ".idx" in indexed) for s in range(0, f.size, step)]
        return found or [Range("", 0, 0, False)]

    def passes(self, row: dict) -> bool:
        return all((row[c] is None) == null if allowed is None else row[c] in allowed for c, allowed, null in self.tests)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = filesystem(self.path)
        kinds = {"long": pa.int64(), "string": pa.string()}
        fields = dict(f.split(" ") for f in SCHEMA.split(", "))
        schema = pa.schema([(c, kinds[fields[c]]) for c in self.columns])
        starts = [0]
        if partition.indexed:
            with system.open_input_stream(partition.path + ".idx") as side:
                starts = [int(x) for x in side.read().split()]
        size = system.get_file_info(partition.path).size
        k, stop = bisect_left(starts, partition.start), bisect_left(starts, partition.end)
        end = starts[stop] if stop < len(starts) else size
        if k == stop:
            return
        archive = Members if partition.path.endswith(".gz") else Plain
        rows, held = [], 0
        with system.open_input_file(partition.path) as raw:
            for headers, length, block in archive(raw, starts, size).records(starts[k], end):
                row = header_row(headers, length)
                if not self.passes(row):
                    continue
                if self.verify or "payload" in self.columns or ("payload_bytes" in self.columns and row["payload_bytes"] is None):
                    body = block()
                    if self.verify:
                        check(headers, row, body)
                    row |= block_row(headers, body)
                    held += length
                rows.append(row)
                if len(rows) >= 5_000 or held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in self.columns} for r in rows], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in self.columns} for r in rows], schema=schema)


class Plain:
    """Records one behind another; a block that isn't asked for is stepped over."""

    def __init__(self, raw, starts: list[int], size: int):
        self.raw = raw

    def records(self, start: int, end: int) -> Iterator[tuple[dict[str, str], int, Callable[[], bytes]]]:
        self.raw.seek(start)
        data, at = io.BufferedReader(self.raw, 1 << 20), start
        while at < end and (found := read_headers(data)) is not None:
            headers, taken = found
            length = int(headers.get("content-length", "0"))
            at += taken
            yield headers, length, lambda: data.read(length)  # noqa: B023  (called before the next step)
            at += length + 4
            data.seek(at)


class Members:
    """Gzip members of one record each or of several. Only as much of a member is inflated as is asked for, if the index tells the next
    one; without an index every record of a member is read."""

    def __init__(self, raw, starts: list[int], size: int):
        self.raw, self.starts, self.size = raw, starts, size

    def records(self, start: int, end: int) -> Iterator[tuple[dict[str, str], int, Callable[[], bytes]]]:
        at = start
        while at < end:
            self.raw.seek(at)
            member = Inflated(self.raw)
            following = bisect_right(self.starts, at)
            indexed = following < len(self.starts) and len(self.starts) > 1
            while (found := read_headers(member)) is not None:
                headers, length = found[0], int(found[0].get("content-length", "0"))
                left = length

                def block() -> bytes:
                    nonlocal left
                    body = member.read(left)  # noqa: B023  (called before the next step)
                    left -= len(body)
                    return body

                yield headers, length, block
                if indexed:
                    break
                member.skip(left + 4)
            at = self.starts[following] if indexed else at + member.rest()


class Inflated:
    """A gzip member as a stream, inflated as far as it is read."""

    def __init__(self, raw):
        self.raw, self.inflate, self.held, self.fed = raw, zlib.decompressobj(31), b"", 0

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        part = self.inflate.unconsumed_tail or self.raw.read(1 << 16)
        if not part:
            raise ValueError("a gzip member ends too early")
        self.fed += len(part) - len(self.inflate.unconsumed_tail)
        self.held += self.inflate.decompress(part, 1 << 18)
        return True

    def readline(self) -> bytes:
        while (k := self.held.find(b"\n")) < 0 and self._more():
            pass
        k = len(self.held) if k < 0 else k + 1
        line, self.held = self.held[:k], self.held[k:]
        return line

    def read(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self._more():
                break
            parts.append(self.held)
            have += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held = b""
            if not self._more():
                return
        self.held = self.held[n:]

    def rest(self) -> int:
        """Steps to the member's end; the bytes it takes in the file."""
        while self._more():
            self.held = b""
        return self.fed - len(self.inflate.unused_data)


def check(headers: dict[str, str], row: dict, block: bytes) -> None:
    """ValueError if the block's payload isn't what the headers tell."""
    if headers.get("warc-type") not in ("response", "resource"):
        return
    payload = payload_of(headers, block)
    if row["payload_bytes"] is not None and row["payload_bytes"] != len(payload):
        raise ValueError(f"{row['record_id']}: {len(payload)} bytes of payload, not {row['payload_bytes']}")
    told = headers.get("warc-payload-digest", "")
    # digests are of the decoded payload here; other writers take them of the body as it was sent
    if told.startswith("sha1:") and row["payload_digest"] not in (hashlib.sha1(x).hexdigest() for x in (payload, body_of(headers, block)[1])):
        raise ValueError(f"{row['record_id']}: the payload's digest differs")


def read_headers(data) -> tuple[dict[str, str], int] | None:
    """Header fields by lower-case name, and the bytes they took; None at the end."""
    line = data.readline()
    taken = len(line)
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("no WARC record begins here")
    found: dict[str, str] = {}
    last = ""
    while (line := data.readline()) not in (b"\r\n", b"\n", b""):
        taken += len(line)
        if line[:1] in b" \t" and last:
            found[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        last = name.strip().lower()
        found[last] = value.strip()
    return found, taken + len(line)


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").removeprefix(URN)
    return int(tail) if tail.lstrip("-").isdigit() else None


def header_row(headers: dict[str, str], length: int) -> dict:
    row = {c: headers.get(h.lower()) for c, h in HEADER_OF.items()}
    row |= {"page_id": _page(row["record_id"]), "refers_to": _page(headers.get("warc-refers-to")), "block_bytes": length}
    told = headers.get("x-payload-length", "")
    row["payload_bytes"] = int(told) if told.isdigit() else None
    if (d := row["payload_digest"]) and d.startswith("sha1:"):
        value = d[5:]
        row["payload_digest"] = base64.b32decode(value).hex() if len(value) == 32 else value.lower()
    return row


def body_of(headers: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """Head and body of an HTTP block; other blocks are body alone."""
    if not headers.get("content-type", "").startswith("application/http"):
        return b"", block
    head, _, body = block.partition(b"\r\n\r\n")
    return head, body


def joined_chunks(body: bytes) -> bytes:
    """A body without its chunk sizes; from the first size that can't be read on, what is left belongs to no chunk."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        told = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", told) or not (size := int(told, 16)):
            break
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(parts)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The body of an HTTP block, out of its chunks and inflated (gzip, deflate); an encoding that isn't known is left as it is.
    Other blocks are their own payload."""
    head, body = body_of(headers, block)
    field = lambda name: [x.strip().lower() for v in re.findall(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head) for x in v.split(b",")]
    if b"chunked" in field(b"transfer-encoding"):
        body = joined_chunks(body)
    for coding in reversed(field(b"content-encoding")):
        if coding in (b"gzip", b"x-gzip"):
            body = gzip.decompress(body)
        elif coding == b"deflate":  # with a zlib head, as it should be, or without
            body = zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
        elif coding not in (b"identity", b""):
            break
    return body


def block_row(headers: dict[str, str], block: bytes) -> dict:
    """payload and payload_bytes; a revisit has no payload."""
    if headers.get("warc-type") == "revisit":
        return {"payload": None}
    body = payload_of(headers, block)
    return {"payload_bytes": len(body), "payload": body.decode("utf-8", "replace")}


def read_archives(spark, folder: str, columns: list[str] | None = None, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("path", folder)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
