"""WARC archives with a two-level capture index.

Writing: records are dealt out and sorted by the key of their URL (host labels reversed, so that captures of a site stand together), and each task writes one
archive of gzip members, one member a record, with its shard of the index: lines of key and position in compressed blocks of BLOCK_LINES, and a directory file with the first key
and the place of each block.  Files carry a name of the attempt that wrote them, and only the names that successful tasks return are listed, so a task that is run again
leaves unlisted files at most.

Reading: a key is looked up in the shard list (one entry for each archive, held by the driver), then in the shard's sparse directory, then in one
decompressed block, each by binary search; then exactly the record's bytes are read from the archive.  Lookups come in the order of keys, so neighbours share blocks.
Several records may have one key: all are found, in the blocks and shards after the first.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shared_path, table

BLOCK_LINES = 300
HELD_BLOCKS = 64


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query`` in lower case: labels of the host reversed, without scheme, user, default port and fragment.  Null gives ''; what doesn't parse is its own key."""
    if not url:
        return ""
    try:
        p = urlsplit(url.strip())
        host, port = p.hostname, p.port
    except ValueError:
        return url
    if not host:
        return url
    port = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{p.query}" if p.query else ""
    return f"{','.join(reversed(host.rstrip('.').split('.')))}{port}){p.path or '/'}{query}".lower()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    m = re.match(r"^file:(?://)?(/.*)$", path)
    if m or path.startswith("/"):
        return pafs.LocalFileSystem(), m[1] if m else path
    return pafs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str, url: str, sha1: str, n: int = 0) -> str:
    """The name of the n-th record of one page id, URL and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page_id, url, sha1, n]))}>"


def record(page_id: str, url: str, payload: bytes, sha1: str, refers_to: tuple[str, str] | None, date: str, n: int = 0) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the digest and the length of it.  ``refers_to``: page id and URL of the response; ``n``: how many
    records of the same page id, URL and payload came before.  Page ids stand in fields of our own, as the standard allows."""
    clean = lambda x: re.sub(r"[\r\n]", "", x)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, url, sha1, n)), ("WARC-Date", date), ("WARC-Target-URI", clean(url)), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Page-ID", page_id)]
    if refers_to is not None:
        fields += [
            ("WARC-Refers-To", record_id(*refers_to, sha1)), ("WARC-Refers-To-Target-URI", clean(refers_to[1])), ("WARC-Refers-To-Date", date), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("Refers-To-Page-ID", refers_to[0]),
        ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields, page_id, refers_to, http length and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return {"fields": fields, "page_id": fields["Page-ID"], "refers_to": fields.get("Refers-To-Page-ID"), "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"][5:], "length": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload": payload}


class Archive:
    """Writes one archive and its shard of the index."""

    def __init__(self, root: str, number: int):
        self.fs, base = filesystem(root)
        self.name = f"part-{number:06d}-{uuid.uuid4().hex[:12]}"
        self.path = f"{base}/{self.name}"
        self.out = {x: self.fs.open_output_stream(f"{self.path}.{x}", compression=None) for x in ("warc.gz", "cdx.gz")}
        self.at, self.lines, self.places, self.place = 0, [], [], 0

    def add(self, key: str, page_id: str, raw: bytes) -> None:
        data = gzip.compress(raw, 6, mtime=0)
        self.out["warc.gz"].write(data)
        self.lines.append(json.dumps([key, page_id, self.at, len(data)]))
        self.at += len(data)
        if len(self.lines) == BLOCK_LINES:
            self.flush()

    def flush(self) -> None:
        if self.lines:
            data = zlib.compress("\n".join(self.lines).encode())
            key, page_id = json.loads(self.lines[0])[:2]
            self.places.append(json.dumps([key, page_id, self.place, len(data)]))
            self.out["cdx.gz"].write(data)
            self.place += len(data)
            self.lines = []

    def close(self) -> str:
        self.flush()
        for f in self.out.values():
            f.close()
        with self.fs.open_output_stream(f"{self.path}.idx", compression=None) as f:
            f.write("\n".join(self.places).encode())
        return self.name


def order(key: str, page_id: str) -> tuple[bytes, int, str]:
    """Byte order of keys, as Spark sorts strings; then ids as numbers."""
    return key.encode(), int(page_id) if page_id else -(1 << 63), page_id


class Index:
    """Looks captures up by (key, page id) in an archive folder.  ``shards``: (first key, first id, name) in order."""

    def __init__(self, root: str, shards: list[tuple[str, str, str]]):
        self.fs, self.base = filesystem(root)
        self.shards, self.first = shards, [order(k, p) for k, p, _ in shards]
        self.directories: dict[str, tuple[list, list]] = {}
        self.blocks: dict[tuple[str, int], tuple[list, list]] = {}
        self.files: dict[str, object] = {}

    def _file(self, name: str):
        if name not in self.files:
            if len(self.files) > 16:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.fs.open_input_file(f"{self.base}/{name}")
        return self.files[name]

    def _range(self, name: str, at: int, n: int) -> bytes:
        f = self._file(name)
        f.seek(at)
        return f.read(n)

    def _directory(self, shard: str):
        if shard not in self.directories:
            if len(self.directories) > 8:
                self.directories.pop(next(iter(self.directories)))
            with self.fs.open_input_file(f"{self.base}/{shard}.idx") as f:
                rows = [json.loads(x) for x in f.read().decode().split("\n") if x]
            self.directories[shard] = [order(r[0], r[1]) for r in rows], rows
        return self.directories[shard]

    def _block(self, shard: str, row: list):
        at = shard, row[2]
        if at not in self.blocks:
            if len(self.blocks) >= HELD_BLOCKS:
                self.blocks.pop(next(iter(self.blocks)))
            rows = [json.loads(x) for x in zlib.decompress(self._range(f"{shard}.cdx.gz", row[2], row[3])).decode().split("\n")]
            self.blocks[at] = [order(r[0], r[1]) for r in rows], rows
        return self.blocks[at]

    def find(self, key: str, page_id: str):
        """The records of a key and page id, one by one: none, one, or as many as rows had them."""
        want = order(key, page_id)
        for k in range(max(bisect.bisect_left(self.first, want) - 1, 0), bisect.bisect_right(self.first, want)):
            shard = self.shards[k][2]
            keys, places = self._directory(shard)
            for j in range(max(bisect.bisect_left(keys, want) - 1, 0), bisect.bisect_right(keys, want)):
                names, rows = self._block(shard, places[j])
                for i in range(bisect.bisect_left(names, want), bisect.bisect_right(names, want)):
                    yield parse(gzip.GzipFile(fileobj=io.BytesIO(self._range(f"{shard}.warc.gz", rows[i][2], rows[i][3]))).read())


@F.arrow_udf(T.StringType())
def key_of(url: pa.Array) -> pa.Array:
    """The keys of a column of URLs; only that column goes to Python."""
    return pa.array([url_key(u) for u in url.to_pylist()], pa.string())


HOT = 1000  # payloads with more than one in HOT of all rows: fewer than HOT of them, which bounds what is broadcast


def _references(small: DataFrame) -> DataFrame:
    """(page_id, url, sha, refers_to, refers_url), each once, for pages (page_id, url, sha) whose payload a page of a larger id has, with the URL of that page.

    Only payloads that occur more than once are joined; frequent ones, whose rows would meet in one task, by a broadcast of bounded size."""
    counts = small.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "n", F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url"))
    total = small.count()
    hot = counts.where(F.col("n") * HOT > total).select("sha", "refers_to", "refers_url")
    rest = counts.where(F.col("n") * HOT <= total).select("sha", "refers_to", "refers_url")
    seen = small.join(F.broadcast(hot), "sha", "left")
    both = seen.where("refers_to is not null").unionByName(small.join(F.broadcast(hot), "sha", "left_anti").join(rest, "sha"))
    return both.where("page_id is null or page_id < refers_to").select("page_id", "url", "sha", "refers_to", "refers_url").distinct()


def write_archives(pages: DataFrame, root: str, date: str | None = None) -> list[tuple[str, str, str]]:
    """Write ``pages`` (page_id, url, html) below ``root``; the list of (first key, first id, name) of the archives, in order of keys.

    One record for each row.  Of rows with equal payloads those with the largest page_id (one, unless the id is repeated) are responses and the others revisit it; a row without
    an id revisits any that has one.  A null html is an empty payload, a null url an empty one.  Payloads are dealt out once, by key and id: which page a record refers to comes as a row of its
    own, sorted just before it.  A payload is held whole, one at a time.  Columns but these three play no part.  ``date`` (UTC, as 2020-01-31T12:00:00Z) is that of all records; the time of the call
    unless given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html")).withColumn("sha", sha)
    refers = _references(rows.select("page_id", "url", "sha")).select("page_id", "url", F.col("refers_url").alias("html"), "sha", "refers_to", F.lit(0).alias("kind"))  # such a row has the URL it refers to in the place of a payload
    every = rows.select("page_id", "url", "html", "sha", F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind")).unionByName(refers)
    keyed = every.withColumn("key", key_of("url")).repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "sha", "url", "kind")

    def write(batches):
        out, first, last, refers_to, n = None, None, None, None, 0
        for b in batches:
            for page_id, url, html, own, top, kind, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (page_id, own, url) != last:
                    last, refers_to, n = (page_id, own, url), None, 0
                if kind == 0:
                    refers_to = str(top), html or ""
                    continue
                name = "" if page_id is None else str(page_id)
                if out is None:
                    out, first = Archive(root, TaskContext.get().partitionId()), (key, name)
                payload = (html or "").encode()
                out.add(key, name, record(name, url or "", payload, digest(payload), refers_to, date, n))
                n += 1
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (*first, out.close())], ["key", "page_id", "name"])

    fs, base = filesystem(root)
    fs.create_dir(base, recursive=True)
    made = keyed.mapInArrow(write, "key string, page_id string, name string").collect()  # a row for each archive
    return sorted(((r.key, r.page_id, r.name) for r in made), key=lambda r: order(r[0], r[1]))


def read_captures(pages: DataFrame, root: str, shards: list[tuple[str, str, str]], payloads: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of each record of the captures that ``pages`` (page_id, url) names, by way of the index.

    Length and digest of a response are made from the payload that was read; a revisit has its own in its headers.  A capture that isn't there gives no row; one that is named
    several times is answered once, with all its records."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), key_of(pages["url"]).alias("key")).distinct()
    keyed = rows.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")

    def read(batches):
        index = Index(root, shards)
        for b in batches:
            out, held = [], 0
            for i, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for g in index.find(k, "" if i is None else str(i)):
                    whole = g["type"] == "response"
                    out.append((i, len(g["payload"]) if whole else g["length"], digest(g["payload"]) if whole else g["digest"], g["type"], int(g["refers_to"]) if g["refers_to"] else None, g["payload"] if whole and payloads else None))
                    held += 100 + len(g["payload"]) * payloads
                    if held > 16 << 20:
                        yield _captures(out, payloads)
                        out, held = [], 0
            if out:
                yield _captures(out, payloads)

    return keyed.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def _captures(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + payloads]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[: len(names)], kinds[: len(names)], strict=True)], names)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back by their index."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    root = shared_path(spark, "warc")
    return read_captures(pages, root, write_archives(pages, root))
