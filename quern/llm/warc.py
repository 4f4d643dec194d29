"""WARC archives: writer with revisit records, and a sequential reader.

Writer: rows are split by a hash of their key into archives of bounded size; each record is one
gzip member. A task streams its archive to the shared folder under a name of its own attempt and
returns one manifest row; only attempts that Spark commits are in the manifest, so a lost executor
leaves at most files that nobody reads.

Reader: one pass over a file in blocks of ``_BLOCK`` bytes. Members are inflated incrementally, headers
are parsed as they arrive, the block is framed by its Content-Length, and block and payload digests
are verified. Memory is bounded by one record.

Defined results: null content is an empty payload. Equal payloads (SHA-1, SHA-256 and size) of at least
``min_bytes`` bytes refer to the row with the largest key; a null key is never preferred. Rows that
repeat both key and payload share one decision. A damaged file gives a record with ``error`` and
reading goes on with the next file; a record cut short is never returned as whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.files import open_shared
from quern.session import materialize, scratch, ship

_BLOCK = 1 << 18
_CRLF = b"\r\n"


# --- records ---


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, date: str, payload: bytes, refers_to: str | None = None, refers_uri: str | None = None) -> bytes:
    """An HTTP response or revisit record. A revisit keeps the response's headers (and so its length), not its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", sha1_label(payload)), ("WARC-Block-Digest", sha1_label(block)),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Refers-To-Target-URI", refers_uri or "")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {clean(v)}\r\n".encode() for k, v in head) + _CRLF + block + _CRLF * 2


def member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Members:
    """The concatenation of a file's gzip members as a stream; ``boundary`` tells whether one has just ended."""

    def __init__(self, file) -> None:
        self.file, self.left, self.inflate, self.buffer, self.ended = file, b"", None, bytearray(), False

    def _more(self) -> bool:
        if not self.left:
            self.left = self.file.read(_BLOCK)
            if not self.left:
                if self.inflate is not None:
                    raise EOFError("a gzip member is cut short")
                return False
        if self.inflate is None:
            self.inflate = zlib.decompressobj(31)
        self.buffer += self.inflate.decompress(self.left, _BLOCK)
        if self.inflate.eof:
            self.left, self.inflate = self.inflate.unused_data, None
        else:
            self.left = self.inflate.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        at = 0
        while (end := self.buffer.find(_CRLF, at)) < 0:
            at = max(0, len(self.buffer) - 1)
            if not self._more():
                if self.buffer:
                    raise EOFError("a header line is cut short")
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise EOFError("a record is cut short")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def end_of_member(self) -> bool:
        """After a record: nothing of its member may be left."""
        while not self.buffer and self.inflate is not None:
            self._more()
        return not self.buffer and self.inflate is None


def read_records(file) -> Iterator[dict]:
    """Headers (lower-case names), HTTP headers and payload of each record; checks framing and digests."""
    stream = _Members(file)
    while True:
        version = stream.line()
        if version is None:
            return
        if not version.startswith(b"WARC/"):
            raise ValueError("no WARC version line")
        head: dict[str, str] = {}
        while line := stream.line():
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if not colon:
                raise ValueError("a header without a colon")
            head[name.strip().lower()] = value.strip()
        if line is None:
            raise EOFError("headers are cut short")
        block = stream.take(int(head["content-length"]))
        if stream.take(4) != _CRLF * 2:
            raise ValueError("the block isn't framed by its Content-Length")
        if not stream.end_of_member():
            raise ValueError("a gzip member holds more than one record")
        if head.get("warc-block-digest", sha1_label(block)) != sha1_label(block):
            raise ValueError("block digest differs")
        http, payload = {}, block
        if head.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(_CRLF * 2)
            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("latin-1").split("\r\n")[1:])}
        if head.get("warc-type") == "response" and head.get("warc-payload-digest", sha1_label(payload)) != sha1_label(payload):
            raise ValueError("payload digest differs")
        yield {"head": head, "http": http, "payload": payload}


# --- DataFrame operators ---


def mark_revisits(rows: DataFrame, key: str, content: str, min_bytes: int) -> DataFrame:
    """Adds refers_to (key of the response, null for responses). Contents travel once, and only to meet their own mark."""
    data = F.coalesce(F.col(content), F.lit("")).cast("binary")
    keyed = rows.withColumns({"__sha1": F.unhex(F.sha1(data)), "__sha2": F.unhex(F.sha2(data, 256)), "__size": F.octet_length(data)})
    same = ["__sha1", "__sha2", "__size"]
    light = keyed.select(key, *same).where(F.col("__size") >= min_bytes)
    best = light.groupBy(*same).agg(F.max(key).alias("__best"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    marks = light.join(best, same).where(~F.col(key).eqNullSafe(F.col("__best"))).select(F.col(key).alias("__key"), F.col("__sha2").alias("__of"), F.col("__best").alias("refers_to")).distinct()
    return keyed.join(marks, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__sha2") == F.col("__of")), "left").drop(*same, "__key", "__of")


def write_archives(rows: DataFrame, folder: str, key: str = "page_id", uri: str = "url", content: str = "html", min_bytes: int = 1000, files: int | None = None, level: int = 6, date: str = "2024-01-01T00:00:00Z", max_bytes: int = 1 << 28) -> DataFrame:
    """Writes one record a row; the manifest (path, records, bytes), already written and read again.

    A task writes one archive, and begins another after ``max_bytes``; ``files`` deals rows out anew.
    """
    spark = rows.sparkSession
    ship(spark)
    marked = mark_revisits(rows.select(F.col(key).cast("bigint").alias("page_id"), F.col(uri).alias("url"), F.col(content).alias("html")), "page_id", "html", min_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, out, n, size = "", None, 0, 0
        name = lambda k: f"urn:page:{'' if pd.isna(k) else int(k)}"
        done = lambda: pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})
        for b in batches:
            for page_id, url, html, other in zip(b["page_id"].astype("object"), b["url"], b["html"], b["refers_to"].astype("object")):
                if out is None:
                    path, n, size = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_shared(path, True)
                kind = "response" if pd.isna(other) else "revisit"
                data = member(record(kind, name(page_id), url or "", date, (html or "").encode("utf-8"), None if kind == "response" else name(other)), level)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= max_bytes:
                    out.close()
                    out = None
                    yield done()
        if out is not None:
            out.close()
            yield done()

    marked = marked.select("page_id", "url", "html", "refers_to")
    if files:
        marked = marked.repartition(files, F.xxhash64("page_id", "url"))
    return materialize(marked.mapInPandas(run, "path string, records long, bytes long"), "warc-manifest")


RECORDS = "path string, ordinal long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the files in ``manifest.path``, in file order; ``error`` where a file is damaged."""
    spark = manifest.sparkSession
    ship(spark)

    def bare(v: str | None) -> str | None:
        return v.strip("<>") if v is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for b in batches:
            for path in b["path"]:
                rows: list[tuple] = []
                held = k = 0
                try:
                    with open_shared(path) as f:
                        for k, r in enumerate(read_records(f), 1):
                            h, p = r["head"], r["payload"]
                            label = h.get("warc-payload-digest", sha1_label(p))
                            digest = base64.b32decode(label.partition(":")[2]).hex()
                            size = int(r["http"].get("content-length", len(p)))
                            if h["warc-type"] == "response" and size != len(p):
                                raise ValueError("HTTP length and payload differ")
                            rows.append((path, k - 1, h["warc-type"], bare(h.get("warc-record-id")), h.get("warc-target-uri"), bare(h.get("warc-refers-to")), digest, size, p if payloads else None, None))
                            held += len(p) if payloads else 200
                            if held > 8 << 20:
                                yield pd.DataFrame(rows, columns=names)
                                rows, held = [], 0
                except (ValueError, EOFError, KeyError, zlib.error, OSError) as e:
                    rows.append((path, k, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    files = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(files).mapInPandas(run, RECORDS)


def page_records(rows: DataFrame, min_bytes: int = 1000, **names: str) -> DataFrame:
    """Round trip: page_id, payload_bytes, payload_digest, record_type, refers_to as read from the archives."""
    manifest = write_archives(rows, scratch(rows.sparkSession, "warc"), min_bytes=min_bytes, **names)
    found = read_archives(manifest, payloads=False)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) as bigint)")
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("WARC: "), F.col("error")))).otherwise(F.col("record_type"))
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", sound.cast("string").alias("record_type"), number("refers_to").alias("refers_to"))


def parse(data: bytes) -> list[dict]:
    return list(read_records(io.BytesIO(data)))
