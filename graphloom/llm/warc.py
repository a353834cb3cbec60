"""WARC archives of pages, with an index first: where each record is, then sorted, coalesced byte-range reads of those wanted.

A task writes its pages to an archive of its own, one gzip member a record, and returns the index of it: file, offset, length,
URL and digest of every record. The index is a table; archives that it does not name, of attempts that were lost, count for
nothing. Reading takes any part of the index: ranges are dealt by file and stretch, sorted, and those that lie near one another are
fetched together.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import new_path

from .common import map_arrow, pieces, written

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Up to so many repeated digests (about 80 bytes each) are broadcast to the pages; beyond, pages are shuffled to them.
BROADCAST_DIGESTS = 200_000
#: Bytes between two wanted records that are read rather than skipped, bytes read at once, bytes of a file that one task reads
#: in a row, and tasks at most (each then reads more stretches, one after the other).
GAP, READ, STRETCH, TASKS = 1 << 16, 1 << 22, 1 << 24, 20_000
INDEX = "file string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record: a response, or a revisit of the page `refers_to`, which has no payload but its HTTP header."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:  # as it is, but for what would end or fold the line
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        fields.append(f"Page-ID: {page_id}")
    fields.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        fields += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_name(refers_to, digest)}", f"Refers-To-Page: {refers_to}"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Fields and payload of one record; ValueError where it breaks its own lengths or digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if not lines[0].startswith("WARC/") or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload differs from its length or digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("Refers-To-Page"), "payload_bytes": length,
        "payload_digest": digest, "payload": None if revisit else payload,
    }


def _folder(uri: str):
    """The store of a file and its path there."""
    from pyarrow import fs

    if uri.startswith(("/", "file:/")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _rows(rows: list[dict], schema) -> Iterator:
    import pyarrow as pa

    if rows:
        yield from pa.Table.from_pylist(rows, schema).to_batches()


def _index_schema():
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in INDEX.split(", "))])


class _Write:
    def __init__(self, folder: str, date: str, level: int):
        self.folder, self.date, self.level = folder, date, level

    def __call__(self, batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        store, path = _folder(self.folder)
        store.create_dir(path, recursive=True)
        name, out, at, schema = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", None, 0, _index_schema()
        try:
            for batch in pieces(batches, 256):
                found = []
                for page_id, url, html, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_id, url, html, digest, refers_to, self.date)) + packer.flush()
                    out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(data)
                    kind = "response" if refers_to is None else "revisit"
                    found.append({"file": f"{self.folder}/{name}", "offset": at, "length": len(data), "page_id": page_id, "url": url, "payload_bytes": len(html), "payload_digest": digest, "record_type": kind, "refers_to": refers_to})
                    at += len(data)
                yield from _rows(found, schema)
        finally:
            if out:
                out.close()


def spans(wanted: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[int, int, int]]:
    """Ranges to fetch, as (start, end, number of wanted ones in it), for sorted (offset, length): those near one another are one."""
    start = end = n = 0
    for offset, length in wanted:
        if n and (offset - end > gap or offset + length - start > most):
            yield start, end, n
            n = 0
        if not n:
            start = end = offset
        end, n = max(end, offset + length), n + 1
    if n:
        yield start, end, n


class _Read:
    def __init__(self, payloads: bool):
        self.payloads = payloads

    def __call__(self, batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORD.split(", "))])
        opened, source = None, None
        try:
            for batch in pieces(batches, 4096):
                files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
                at = 0
                while at < len(files):
                    to = at
                    while to < len(files) and files[to] == files[at]:
                        to += 1
                    if opened != files[at]:
                        if source:
                            source.close()
                        store, path = _folder(files[at])
                        opened, source = files[at], store.open_input_file(path)
                    for start, end, n in spans(list(zip(offsets[at:to], lengths[at:to], strict=True))):
                        data, rows = source.read_at(end - start, start), []
                        for i in range(at, at + n):
                            own = zlib.decompress(data[offsets[i] - start : offsets[i] - start + lengths[i]], 31)
                            rows.append(parsed(own))
                            if not self.payloads:
                                rows[-1]["payload"] = None
                        yield from _rows(rows, schema)
                        at += n
        finally:
            if source:
                source.close()


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes a record for each of pages(page_id, url, html) and returns the index, a written table.

    Of records with equal payloads of at least `least` bytes the one of the smallest page_id is a response, the others are
    revisits of it; all smaller ones are responses. Null html is an empty payload, a null url or page_id leaves its
    field out. A row without page_id revisits the page with the smallest one, and is a response where there is none. Where the
    smallest page_id repeats, all its rows are responses. An empty table makes no archive and an empty index. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html")).withColumn("digest", F.sha2("html", 256))
    repeated = rows.where(F.length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    repeated = written(repeated, "warc-repeated")
    if repeated.count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    refers = F.when(F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)), F.col("first"))
    decided = rows.join(repeated, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return written(map_arrow(decided, _Write(folder, date, level), INDEX), "warc-index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that `index` (any part of it) names, read from their archives: `page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload`. Responses are held against their digest; a revisit tells the length and digest of the
    payload that it refers to and has none itself. A record named twice is read twice; an empty index gives an empty result.
    """
    wanted = index.agg(F.sum("length")).first()[0] or 0  # by bytes to read: rows of the index are small
    tasks = min(TASKS, 1 + int(wanted) // STRETCH)
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return map_arrow(dealt, _Read(payloads), RECORD)


def _members(batches: Iterator) -> Iterator:
    schema = _index_schema()
    for batch in batches:
        for name in batch.column(0).to_pylist():
            store, path = _folder(name)
            at, found = 0, []
            with store.open_input_stream(path, compression=None) as source:
                left = b""
                while left or (left := source.read(READ)):
                    unpack, data, start = zlib.decompressobj(31), bytearray(), at
                    while not unpack.eof:
                        if not left and not (left := source.read(READ)):
                            raise ValueError(f"{name} ends within a record")
                        data += unpack.decompress(left)
                        at += len(left) - len(unpack.unused_data)
                        left = unpack.unused_data
                    r = parsed(bytes(data))
                    del r["payload"]
                    found.append({"file": name, "offset": start, "length": at - start, **r})
                    if len(found) == 1000:
                        yield from _rows(found, schema)
                        found = []
            yield from _rows(found, schema)


def index_archives(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The index of archives that come without one: `files(file)` is scanned record by record, a task for some files each."""
    return map_arrow(files.select("file").repartition("file"), _members, INDEX)


#: The query over DuckDB.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
