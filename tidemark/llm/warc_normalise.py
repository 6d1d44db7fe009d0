"""WARC archives: write, normalise from one gzip stream to one member a record, read back by offset.

`write` makes archives as crawlers that compress whole files do: one gzip stream over many records.  `normalise`
inflates each stream once, in pieces, and writes every record as a member of its own, with a sidecar index of offsets
(<archive>.idx, and the same rows as a table).  `read` seeks to each indexed member and inflates only that.

Of records with equal payloads the one with the largest id is a response; the others are revisits that refer to it
and carry no payload.  Only payloads that occur more than once matter for this; their digests are broadcast up to
`broadcast_rows` of them, beyond that the join is left to Catalyst.

Tasks write files of fresh names and report them; only reported files count, so retried or speculative tasks leave
at most unused files, which go with the folder.  Files go through pyarrow's filesystem of the folder's URI.  A stream is
inflated in steps of `PIECE` bytes on both sides, so only a record is held whole, however well the stream compresses.

Edge cases: null html is an empty payload; equal ids with equal payloads are all responses when they are the largest;
null ids are kept, below all others, ids are whole numbers; urls may be null or hold any characters (escaped in the
header, "%" too, and read back as they were); other columns
are ignored; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

PIECE = 1 << 20
INDEX = "path string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, known: str, keep, date: str) -> bytes:
    """One WARC/1.1 record; a revisit if `keep`, the id of the response of that payload, is another's."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    revisit = keep is not None and keep != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=-._~')}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(keep)}"]
    head += [f"WARC-Payload-Digest: sha1:{known}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """A row of RECORD from one record; sizes and digests of responses come from the payload itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda s: int(s[10:-1]) if s[10:-1] else None
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    page, url = number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI")
    url = None if url is None else unquote(url)
    if fields["WARC-Type"] == "revisit":
        full = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
        return page, full, fields["WARC-Payload-Digest"][5:], "revisit", number(fields["WARC-Refers-To"]), url, None
    if digest(payload) != fields["WARC-Payload-Digest"][5:]:
        raise ValueError(f"record of page {page} is damaged")
    return page, len(payload), digest(payload), "response", None, url, payload


def _write(folder: str, date: str, most: int):
    def run(batches):
        out, squeeze, size, path = None, None, 0, ""
        fs, root = open_fs(folder)
        for batch in batches:
            for page, url, html, keep in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    path = f"{uuid.uuid4().hex}.warc.gz"
                    out, squeeze, size = fs.open_output_stream(f"{root}/{path}", compression=None), zlib.compressobj(1, wbits=31), 0
                payload = html or b""
                raw = record(page, url, payload, digest(payload), keep, date)
                out.write(squeeze.compress(raw))
                size += len(raw)
                if size >= most:
                    out.write(squeeze.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return run


def records(stream) -> "iter":
    """The records of one gzip stream, inflated piece by piece."""
    inflate, held, need, raw = zlib.decompressobj(wbits=31), bytearray(), None, b""
    while True:
        raw = raw or stream.read(PIECE)
        held += inflate.decompress(raw, PIECE) if raw else inflate.flush()
        last, raw = not raw, inflate.unconsumed_tail
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                at = held.rindex(b"\r\nContent-Length: ", 0, end + 2)
                need = end + 4 + int(held[at + 18 : end]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
        if last:
            if held:
                raise ValueError("the archive ends within a record")
            return


def _normalise(source: str, target: str):
    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                (from_, there), (to, here) = open_fs(source), open_fs(target)
                path, offset, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                with from_.open_input_stream(f"{there}/{name}", compression=None) as stream, to.open_output_stream(f"{here}/{path}", compression=None) as out:
                    for raw in records(stream):
                        squeeze = zlib.compressobj(6, wbits=31)
                        member = squeeze.compress(raw) + squeeze.flush()
                        out.write(member)
                        rows.append((offset, len(member)))
                        offset += len(member)
                with to.open_output_stream(f"{here}/{path}.idx", compression=None) as out:
                    out.write("".join(f"{a} {n}\n" for a, n in rows).encode())
                at, n = zip(*rows) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["path", "offset", "length"])

    return run


def _read(folder: str, payloads: bool):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        fs, root = open_fs(folder)
        opened, stream = None, None
        for batch in batches:
            rows, held = [], 0
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if path != opened:
                    if stream is not None:
                        stream.close()
                    opened, stream = path, fs.open_input_file(f"{root}/{path}")
                stream.seek(offset)
                row = parse(zlib.decompress(stream.read(length), wbits=31))
                rows.append(row if payloads else (*row[:6], None))
                held += len(rows[-1][6] or b"")
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z", file_bytes: int = 64 << 20, broadcast_rows: int = 200_000) -> DataFrame:
    """Write archives of one gzip stream each; returns (path) of those that count."""
    flat = c.bounded_batches(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), c.text_of(html_col).alias("html"))
    flat = flat.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    twice = flat.groupBy("sha").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where("n > 1").select("sha", "keep")
    twice = c.materialize(twice, "twice")
    small = twice.limit(broadcast_rows + 1).count() <= broadcast_rows
    full = flat.join(F.broadcast(twice) if small else twice, "sha", "left").select("id", "url", F.col("html").cast("binary"), "keep")
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    done = c.materialize(full.mapInArrow(c.tidy(_write(folder, date, file_bytes)), "path string"), "archives")
    return done


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite archives with one member a record; returns the index (path, offset, length), one row a record."""
    fs, root = open_fs(target)
    fs.create_dir(root, recursive=True)
    each = archives.repartitionByRange(max(1, archives.count()), "path")  # names are random: about one archive a task
    return c.materialize(each.mapInArrow(c.tidy(_normalise(source, target)), INDEX), "index")


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records that the index names."""
    return index.mapInArrow(c.tidy(_read(folder, payloads)), RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, **more) -> DataFrame:
    """Write, normalise, remove the streams, and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{c.shared_dir(spark)}/tidemark/warc-{uuid.uuid4().hex}"
    whole, split = f"{folder}/whole", f"{folder}/members"
    archives = write(pages, whole, **more)
    index = normalise(archives, whole, split)
    fs, root = open_fs(whole)
    fs.delete_dir(root)
    return read(index, split, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
