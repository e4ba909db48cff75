"""WARC archives with the index first.

Writing yields one index row per record (file, offset, length, URL, digest); reading takes selected index rows, sorts
them by place, joins neighbouring byte ranges and fetches each range once. Every record is a gzip member of its own.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
ARCHIVE_BYTES = 1 << 30
GAP = 64 << 10
READ_BYTES, READ_TASKS = 32 << 20, 50_000  # of archives for each task, up to so many tasks
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def encode(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head alone; its Content-Length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=~-._' + chr(39))}")
        lines.append(f"X-Page-Url: {quote(url, safe='')}")  # the URL as it was: the one above is brought into the form of a URI
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode(member: bytes) -> dict:
    """A record's fields, with block, payload and length checked against what its headers say."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + sha1_base32(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"damaged payload {fields.get('WARC-Record-ID')}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-Id"), "url": unquote(fields["X-Page-Url"]) if "X-Page-Url" in fields else fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "payload": None if revisit else payload,
    }


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives under path; returns the index, itself written first of all reads.

    Of rows with equal payloads that with the smallest page_id is a response and the others revisit it; null html is an
    empty payload. Rows repeating both page_id and payload are one capture and share its type. Where all page_ids of a
    group are null, each is a response; a null page_id beside others revisits. Payloads move once, to their decision, on
    the page's own key, so no group of copies meets in one task. A task that is run again writes a new file, and the
    index names only the files of the attempts that counted.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    narrow = written(pages.select("page_id", F.sha2(payload, 256).alias("same")), "digests")
    firsts = written(narrow.groupBy("same").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    again = narrow.join(firsts, "same").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    full = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("same")).alias("p")
    again = written(again, "revisits").alias("r")
    decided = full.join(again, F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.same") == F.col("r.same")), "left")
    decided = decided.select("p.page_id", "p.url", "p.payload", "r.refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, body, refers_to in zip(*(c for c in batch.columns), strict=True):
                page_id, url, body, refers_to = page_id.as_py(), url.as_py(), body.as_py(), refers_to.as_py()
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                digest, revisit = sha1_base32(body), refers_to is not None
                member = encode(page_id, url, body, digest, refers_to, revisit)
                out.write(member)
                rows.append((page_id, url, digest, "revisit" if revisit else "response", refers_to, f"{path}/{name}", at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _schema(INDEX), strict=True)], schema=_schema(INDEX))
        if out is not None:
            out.close()

    return written(decided.mapInArrow(write, INDEX), "index")


def coalesced(places: list[tuple[str, int, int]], gap: int = GAP, most: int = 8 << 20) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as byte ranges to fetch: (file, start, end, records); neighbours closer than `gap` share one, up to `most` bytes."""
    out: list[tuple[str, int, int, list[tuple[int, int]]]] = []
    for file, offset, length in places:
        if out and out[-1][0] == file and offset - out[-1][2] <= gap and offset + length - out[-1][1] <= most:
            out[-1][3].append((offset, length))
            out[-1] = (file, out[-1][1], max(out[-1][2], offset + length), out[-1][3])
        else:
            out.append((file, offset, offset + length, [(offset, length)]))
    return out


def read_records(index: DataFrame, gap: int = GAP, payloads: bool = True) -> DataFrame:
    """The records that the index rows name, read back from the archives in order of place.

    Tasks are dealt by the bytes that the rows name, not by the size of the index. The URL comes as it was written.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = min(READ_TASKS, max(1, -(-total // READ_BYTES)))
    sorted_rows = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ExitStack() as open_:
            name, source = None, None
            for batch in batches:
                for file, start, end, members in coalesced(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), gap):
                    if file != name:
                        open_.close()
                        fs, place = pa.fs.FileSystem.from_uri(file)
                        name, source = file, open_.enter_context(fs.open_input_file(place))
                    data = source.read_at(end - start, start)
                    rows = [decode(data[o - start : o - start + n]) for o, n in members]
                    if not payloads:
                        for r in rows:
                            r["payload"] = None
                    yield pa.RecordBatch.from_pylist(rows, schema=_schema(RECORD))

    return sorted_rows.mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write every page, then read every archive back: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    index = write_archives(pages, path or scratch(pages.sparkSession, "warc"))
    return read_records(index, payloads=False).drop("payload")
