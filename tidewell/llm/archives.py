"""Legacy ARC archives to WARC archives, and back from them as rows.

An ARC file begins with a version block, whose second line names the fields of all later header lines: five in version 1,
ten in version 2, the declared length last in both. Headers are taken apart from their ends, as old URLs may hold spaces,
and blocks by their declared lengths alone. From each record the converter makes what WARC asks for and ARC lacks: a
record id (from the file's name and the record's number, so a task that runs again writes the same), an ISO timestamp, a type
(warcinfo for the version block, response for HTTP blocks, resource for others, revisit for repeats) and digests.

Of HTTP records with equal payloads of at least `least` bytes one is the response, that with the largest key (a header of the HTTP
block; then the largest record id); all others become revisits that name it and keep their HTTP headers. Which ones is decided on a table of digests, made by
reading every ARC file once; then each file is converted by one task, with only its own revisits beside it. Files are rolled
over at `ROLL` bytes, so tasks stay small; a record is a gzip member of its own. A task writes under a name of its
own attempt and reports it, and only reported files are read.

Cases: a null or empty payload is an empty block after its HTTP headers; a null url becomes a urn of the key, white space and other
bytes that headers can't hold are percent-encoded; a null key has no header, is the smallest of its copies and comes back null; repeated rows are
records of their own (one response, the others revisits that refer to the same key); payloads of any length are one record; an empty
table makes no files and no rows; extra columns are ignored. A header line with too few fields, a block that is cut short or a wrong
digest raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, storage, trimmed

ROLL, READ, LEVEL = 32_000_000, 1 << 16, 1
#: The fields of header lines by version, the profile of revisits.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = "X-Page-Id"
MANIFEST = "file string, records long, bytes long"
INDEX = "file string, number long, id string, key long, digest binary, n long, uri string, date string"
REVISITS = "array<struct<number:long,id:string,uri:string,date:string>>"
ROWS = "record_id string, record_type string, uri string, key long, payload_bytes long, payload_digest string, refers_id string"


class Inflated(io.RawIOBase):
    """The bytes of a file, unpacked if it is a run of gzip members, in bounded memory."""

    def __init__(self, f):
        self.f, self.z, self.ready, self.rest = f, None, b"", f.read(READ)
        self.packed = self.rest[:2] == b"\x1f\x8b"

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.ready:
            self.rest = self.rest or self.f.read(READ)
            if not self.rest:
                if self.z:
                    raise ValueError("the last gzip member is cut short")
                return 0
            if not self.packed:
                self.ready, self.rest = self.rest, b""
                break
            self.z = self.z or zlib.decompressobj(31)
            self.ready = self.z.decompress(self.rest, READ)
            self.rest, self.z = (self.z.unused_data, None) if self.z.eof else (self.z.unconsumed_tail, self.z)
        n = min(len(out), len(self.ready))
        out[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def exactly(f, n: int, what: str) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"{what} is cut short: {len(data)} of {n} bytes")
    return data


@dataclass
class Arc:
    """A record of an ARC file."""

    number: int
    uri: str
    date: str
    ip: str
    mime: str
    block: bytes


def header(line: bytes, names: list[str]) -> dict[str, str]:
    """The fields of a header line; the URL is what stands before the others."""
    values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
    if len(values) != len(names) or not values[-1].isdigit():
        raise ValueError(f"not a header line of {len(names)} fields: {line[:200]!r}")
    return dict(zip(names, values, strict=True))


def read_arc(f) -> Iterator[Arc]:
    """The records of an open ARC file, its version block first."""
    line = f.readline()
    while line.strip():
        parts = line.split()
        length = int(parts[-1]) if parts[-1].isdigit() else -1
        if not line.startswith(b"filedesc:") or length < 0:
            raise ValueError(f"not a version block: {line[:200]!r}")
        block = exactly(f, length, "the version block")
        version, names = block.split(b"\n", 1)[0].split()[:1], block.decode().split("\n")[1].split()
        if version[:1] not in ([b"1"], [b"2"]) or names != FIELDS[int(version[0])].split():
            raise ValueError(f"unknown version or fields: {block[:200]!r}")
        yield Arc(0, parts[0].decode(), parts[2].decode(), parts[1].decode(), "text/plain", block)
        number, line = 0, f.readline()
        while line:
            if not line.strip():
                line = f.readline()
                continue
            if line.startswith(b"filedesc:"):
                break
            own, number = header(line, names), number + 1
            yield Arc(number, own["URL"], own["Archive-date"], own["IP-address"], own["Content-type"], exactly(f, int(own["Archive-length"]), own["URL"]))
            line = f.readline()


def parted(block: bytes) -> tuple[bytes, bytes] | None:
    """(headers with the blank line, payload) of an HTTP block."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [(at, len(x)) for x in (b"\r\n\r\n", b"\n\n") if (at := block.find(x)) >= 0]
    at, n = min(ends, default=(len(block), 0))
    return block[: at + n], block[at + n :]


def named(head: bytes, name: str) -> str | None:
    """A header's value."""
    for line in head.split(b"\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def whole(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def record_id(file: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{number}')}>"


def iso(date: str) -> str:
    """An ARC timestamp, of 14 digits or cut after any pair of them, as WARC writes it."""
    d = (date if date.isdigit() and 4 <= len(date) <= 14 else "19700101000000").ljust(4, "0")
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def written(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{a}: {b}" for a, b in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def converted(own: Arc, file: str, repeat: dict | None) -> bytes:
    """The WARC record of an ARC record; `repeat` names the response that it repeats."""
    fields = [("WARC-Record-ID", record_id(file, own.number)), ("WARC-Date", iso(own.date))]
    if own.number == 0:
        text = f"software: tidewell\r\nformat: WARC File Format 1.1\r\nisPartOf: {own.uri}\r\n".encode() + own.block
        return warc("warcinfo", [*fields, ("WARC-Filename", file), ("Content-Type", "application/warc-fields")], text)
    fields.append(("WARC-Target-URI", own.uri))
    if own.ip not in ("-", "0.0.0.0"):
        fields.append(("WARC-IP-Address", own.ip))
    http = parted(own.block)
    digests = [("WARC-Payload-Digest", written(hashlib.sha1(http[1] if http else own.block).digest()))]
    if not http:
        return warc("resource", [*fields, *digests, ("Content-Type", "text/dns" if own.uri.startswith("dns:") else own.mime)], own.block)
    kind, block = "response", own.block
    if repeat:
        kind, block = "revisit", http[0]
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", repeat["id"]), ("WARC-Refers-To-Target-URI", repeat["uri"]), ("WARC-Refers-To-Date", repeat["date"])]
    return warc(kind, [*fields, *digests, ("WARC-Block-Digest", written(hashlib.sha1(block).digest())), ("Content-Type", "application/http; msgtype=response")], block)


def read_warc(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record of an open WARC file."""
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:100]!r}")
        own = {}
        while line := f.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            own[name.decode().lower()] = value.strip().decode()
        block = exactly(f, int(own["content-length"]), own.get("warc-record-id", "a record"))
        exactly(f, 4, "the end of a record")
        yield own, block


def row(own: dict[str, str], block: bytes) -> tuple | None:
    """`ROWS` of a record with a payload. The payload's length, where it is left out, is in its HTTP headers."""
    kind = own["warc-type"]
    if kind == "warcinfo":
        return None
    head, payload = parted(block) or (b"", block)
    n = len(payload) if kind != "revisit" else whole(named(head, "Content-Length"))
    digest = base64.b32decode(own["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"wrong payload digest: {own['warc-record-id']}")
    return own["warc-record-id"], kind, own["warc-target-uri"], whole(named(head, KEY)), n, digest, own.get("warc-refers-to")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*[c.split() for c in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], list(names))


def write_arc(pages: DataFrame, to: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "20240101000000", roll: int = ROLL) -> DataFrame:
    """Writes `pages` as ARC files of both versions, by turns, under `to`, which all executors see; the manifest."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = storage(to)
        where.create_dir(root, recursive=True)
        part, attempt, out, n, records, at = TaskContext.get().partitionId(), uuid.uuid4().hex, None, 0, 0, 0
        for rb in batches:
            for k, address, body in zip(*[c.to_pylist() for c in rb.columns], strict=True):
                if out is None:
                    version, name, records, at = 1 + (part + n) % 2, f"part-{part:06d}-{attempt}-{n:04d}.arc.gz", 0, 0
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                    block = f"{version} 0 tidewell\n{FIELDS[version]}\n".encode()
                    line = f"filedesc://{name} 0.0.0.0 {date} text/plain " + ("" if version == 1 else f"200 - - 0 {name} ") + f"{len(block)}\n"
                    data = member(line.encode() + block + b"\n")
                    out.write(data)
                    at += len(data)
                body = body or b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n" + (f"{KEY}: {k}\r\n" if k is not None else "") + "\r\n"
                uri = quote(address, safe="!#$%&'()*+,/:;=?@[]~") if address else f"urn:page:{k}"
                rest = "" if version == 1 else f"200 - - {at} {name} "
                block = head.encode() + body
                data = member(f"{uri} 0.0.0.0 {date} text/html {rest}{len(block)}\n".encode() + block + b"\n")
                out.write(data)
                records, at = records + 1, at + len(data)
                if at >= roll:
                    out.close()
                    yield _batch([(name, records, at)], MANIFEST)
                    out, n = None, n + 1
        if out:
            out.close()
            yield _batch([(name, records, at)], MANIFEST)

    return pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(payload).cast("binary")).mapInArrow(run, MANIFEST)


def _files(manifest: DataFrame) -> DataFrame:
    """A file of the manifest for each task, nearly."""
    return manifest.repartition(min(max(manifest.count(), 1), 20_000), "file")


def index(arcs: DataFrame, at: str) -> DataFrame:
    """`INDEX` of every HTTP record of the ARC files of the manifest `arcs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = storage(at)
        for rb in batches:
            for file in rb.column(0).to_pylist():
                rows = []
                with where.open_input_stream(f"{root}/{file}", compression=None) as f:
                    for own in read_arc(io.BufferedReader(Inflated(f), READ)):
                        if own.number and (http := parted(own.block)):
                            rows.append((file, own.number, record_id(file, own.number), whole(named(http[0], KEY)), hashlib.sha1(http[1]).digest(), len(http[1]), own.uri, iso(own.date)))
                        if len(rows) >= 4096:
                            yield _batch(rows, INDEX)
                            rows = []
                yield _batch(rows, INDEX)

    return _files(arcs.select("file")).mapInArrow(run, INDEX)


def repeats(records: DataFrame, least: int) -> DataFrame:
    """(file, revisits): the records of each file that repeat another's payload, with the one they repeat."""
    large = records.where(F.col("n") >= least)
    best = large.groupBy("digest", "n").agg(F.max(F.struct("key", "id", "uri", "date")).alias("kept"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    again = large.select("file", "number", "id", "digest", "n").join(best, ["digest", "n"]).where("id <> kept.id")
    return again.groupBy("file").agg(F.collect_list(F.struct("number", "kept.id", "kept.uri", "kept.date")).alias("revisits"))


def convert(arcs: DataFrame, at: str, to: str, least: int = 1000) -> DataFrame:
    """Writes a WARC file under `to` for each ARC file of the manifest `arcs` under `at`; the manifest."""
    records = Scratch(arcs.sparkSession, "arc-index").table("records", index(arcs, at))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (source, root), (where, there) = storage(at), storage(to)
        where.create_dir(there, recursive=True)
        for rb in batches:
            for file, again in zip(*[c.to_pylist() for c in rb.columns], strict=True):
                again = {r["number"]: r for r in again or []}
                name, n, size = f"{file.removesuffix('.gz').removesuffix('.arc')}-{uuid.uuid4().hex}.warc.gz", 0, 0
                with source.open_input_stream(f"{root}/{file}", compression=None) as f, where.open_output_stream(f"{there}/{name}", compression=None) as out:
                    for own in read_arc(io.BufferedReader(Inflated(f), READ)):
                        data = member(converted(own, file, again.get(own.number)))
                        out.write(data)
                        n, size = n + (own.number > 0), size + len(data)
                yield _batch([(name, n, size)], MANIFEST)

    found = arcs.select("file").join(repeats(records, least), "file", "left")
    return _files(found).mapInArrow(run, MANIFEST)


def read(warcs: DataFrame, at: str) -> DataFrame:
    """`ROWS` of every record of the WARC files of the manifest `warcs`, payloads checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = storage(at)
        for rb in batches:
            for file in rb.column(0).to_pylist():
                rows = []
                with where.open_input_stream(f"{root}/{file}", compression=None) as f:
                    for own, block in read_warc(io.BufferedReader(Inflated(f), READ)):
                        if found := row(own, block):
                            rows.append(found)
                        if len(rows) >= 4096:
                            yield _batch(rows, ROWS)
                            rows = []
                yield _batch(rows, ROWS)

    return _files(warcs.select("file")).mapInArrow(run, ROWS)


def resolved(rows: DataFrame) -> DataFrame:
    """`rows` with `refers_to`, the key of the record that a revisit names. Only revisits meet the responses."""
    target = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("key").alias("refers_to"))
    again = rows.where("record_type = 'revisit'").join(target, "refers_id", "left")
    return rows.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)


def archived(spark: SparkSession, pages: DataFrame, least: int = 1000, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """`pages` as ARC files, converted to WARC files and read back: `ROWS` and refers_to."""
    scratch = Scratch(spark, "archives")
    arcs = scratch.table("arcs", write_arc(pages, f"{scratch.root}/arc", key, url, payload))
    warcs = scratch.table("warcs", convert(arcs, f"{scratch.root}/arc", f"{scratch.root}/warc", least))
    scratch.drop("arc")
    return resolved(scratch.table("rows", read(warcs, f"{scratch.root}/warc")))
