"""WARC archives with a two-level capture index.

Archives: one gzip member per record. A response holds the payload behind an
HTTP head; a revisit refers to the response with the same payload and holds
the head alone. Files are written to the shared folder through Arrow's file
systems, under a name of the writing attempt's own; only files that the
committed rows of the index name count, so an attempt that was lost leaves
nothing that is read.

Index: captures sorted by reversed-host key, page and digest, cut into blocks
of ``BLOCK_LINES`` lines that are compressed one by one (the lower level), and
for each index file a sparse directory with the first entry of each block. A
list of the files' first entries, a row for each file, is what lookups share. A
lookup searches that list, the file's directory and the block, each by bisection,
and then reads one range of the block file and one range of an archive.

Defined cases: a null html is the empty payload. A null url has the key ``)``.
Equal payloads of at least ``MIN_REVISIT`` bytes are one response, that with the
largest page id, and revisits; rows that repeat the response's id and payload
are responses as well. Among rows without an id no one refers to another; a
null id never wins over an id. An empty table gives no archives and an empty
result. Extra columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, maybe_broadcast, shared_dir, tidy

MIN_REVISIT = 1000
#: Pages from which a shared payload is always broadcast; there are fewer of them than pages divided by this.
HOT = 100_000
#: Index files at most: the driver and every lookup task hold a line for each.
MOST_FILES = 20_000
BLOCK_LINES = 512
NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: Column) -> Column:
    """Host labels reversed, then ``)`` and the rest of the address."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]*://[^/?#]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(url.contains("://"), rest).otherwise(url))


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """A WARC record, before compression."""
    name = lambda n: f"<urn:page:{'none' if n is None else n}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers is None else head
    target = "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers is not None:
        lines[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload of a record, checked."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: None if x is None or "none" in x else int(x.removeprefix("<urn:page:")[:-1])
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "url": fields["WARC-Target-URI"], "payload": payload}


_CAPTURES = "key string, page long, digest string, file string, offset long, length long"


def _write_archives(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _store(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for key, page, url, digest, refers, html in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5).cast(pa.binary()), strict=True):
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                data = _gzip(record(page, url, html.as_py(), digest, refers))
                out.write(data)
                rows.append((key, NO_ID if page is None else page, digest, name, at, len(data)))
                at += len(data)
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "page", "digest", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def _write_index(folder: str):
    """Blocks of a sorted part and their directory; a row for the file: first entry and where the directory is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _store(folder)
        name, out, at, directory, lines = f"{uuid.uuid4().hex}.idx", None, 0, [], []

        def flush():
            nonlocal at, out
            if lines:
                out = out or system.open_output_stream(f"{path}/{name}", compression=None)
                data = _gzip("\n".join(json.dumps(x) for x in lines).encode())
                out.write(data)
                directory.append((lines[0][:3], at, len(data)))
                at += len(data)
                lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    flush()
        flush()
        if out is not None:
            data = _gzip(json.dumps(directory).encode())
            out.write(data)
            out.close()
            first = directory[0][0]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*first, name, at, len(data)), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page", "digest", "file", "offset", "length"])

    return run


def _place(entry) -> tuple[bytes, int, str]:
    return (entry[0].encode(), entry[1], entry[2])


def _lookup(folder: str, top: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _store(folder)
        opened: dict[str, object] = {}
        now_file, now_block, directory, block = None, None, [], []

        def read(name: str, offset: int, length: int) -> bytes:
            if name not in opened:
                if len(opened) >= 64:
                    opened.pop(next(iter(opened))).close()
                opened[name] = system.open_input_file(f"{path}/{name}")
            return zlib.decompress(opened[name].read_at(length, offset), 31)

        for batch in batches:
            found = []
            for query in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                want = _place(query)
                file = top[max(0, bisect_right(top, want, key=_place) - 1)][3:]
                if file != now_file:
                    now_file, now_block = file, None
                    directory = json.loads(read(*file))
                at = max(0, bisect_right(directory, want, key=lambda d: _place(d[0])) - 1)
                if at != now_block:
                    now_block = at
                    block = [json.loads(x) for x in read(file[0], *directory[at][1:]).split(b"\n")]
                hit = block[bisect_right(block, want, key=_place) - 1]
                if _place(hit) == want:
                    found.append(parsed(read(*hit[3:])))
            kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], k) for c, k in kinds.items()], names=list(kinds))

    return run


class CaptureStore:
    """Archives and their index, as written by ``write``."""

    def __init__(self, folder: str, top: list[tuple]):
        self.folder, self.top = folder, top

    def lookup(self, queries: DataFrame) -> DataFrame:
        """The records of ``queries`` (key, page, digest), read by way of the index; queries without a capture give no row."""
        spark = queries.sparkSession
        if not self.top:
            return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
        ordered = queries.select("key", "page", "digest").repartitionByRange(max(len(self.top), spark.sparkContext.defaultParallelism), "key", "page", "digest").sortWithinPartitions("key", "page", "digest")
        return ordered.mapInArrow(tidy(_lookup(self.folder, self.top)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """key, page, digest of each page: what the index is searched by."""
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    return pages.select(surt(pages[url_col]).alias("key"), F.coalesce(pages[id_col].cast("long"), F.lit(NO_ID)).alias("page"), F.sha1(html.cast("binary")).alias("digest"))


def _with_verdicts(rows: DataFrame, shared: DataFrame, most: int) -> DataFrame:
    """``rows`` with refers, the page that holds their payload if others share it.

    Past ``most`` shared payloads, those of ``HOT`` pages and more are broadcast, a bounded number, small payloads
    pass, and only the rest moves by digest.
    """
    if (n := shared.count()) <= most:
        return rows.join(maybe_broadcast(shared.drop("n"), n, most), rows["digest"] == shared["d_"], "left")
    hot = shared.filter(F.col("n") >= HOT).drop("n")
    rest = shared.filter(F.col("n") < HOT).drop("n")
    tried = rows.join(F.broadcast(hot), rows["digest"] == hot["d_"], "left")
    settled = F.col("d_").isNotNull() | (F.octet_length("html") < MIN_REVISIT)
    moved = tried.filter(~settled).drop("d_", "refers")
    return tried.filter(settled).unionByName(moved.join(rest, moved["digest"] == rest["d_"], "left"))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", index_rows: int = 50_000, broadcast_rows: int = 200_000) -> CaptureStore:
    """Writes a record per page, and the index of all of them: files of about ``index_rows`` captures, larger ones past ``MOST_FILES``."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    system, path = _store(folder)
    system.create_dir(path, recursive=True)
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    rows = pages.select(surt(pages[url_col]).alias("key"), pages[id_col].cast("long").alias("page"), pages[url_col].cast("string").alias("url"), F.sha1(html.cast("binary")).alias("digest"), html.alias("html"))
    sizes = materialize(rows.select("page", "digest", F.octet_length("html").alias("size")), "payloads")
    shared = sizes.filter(f"size >= {MIN_REVISIT}").groupBy("digest").agg(F.max("page").alias("refers"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND refers IS NOT NULL")
    shared = materialize(shared.select(F.col("digest").alias("d_"), "refers", "n"), "shared")
    joined = _with_verdicts(rows, shared, broadcast_rows)
    refers = F.when(~F.col("page").eqNullSafe(F.col("refers")), F.col("refers"))
    found = joined.select("key", "page", "url", "digest", refers.alias("refers"), "html").mapInArrow(tidy(_write_archives(folder)), _CAPTURES)
    index = materialize(found, "captures")
    n = index.count()
    files = min(MOST_FILES, max(1, -(-n // index_rows)))
    parts = index.repartitionByRange(files, "key", "page", "digest").sortWithinPartitions("key", "page", "digest")
    top = materialize(parts.mapInArrow(tidy(_write_index(folder)), _CAPTURES), "directory")
    return CaptureStore(folder, sorted((tuple(r) for r in top.collect()), key=_place))  # a row for each index file, ``MOST_FILES`` at most
