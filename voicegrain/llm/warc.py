"""WARC archives: writing pages, and reading them back with segment reassembly (operator 5).

Archives are gzip files of WARC/1.1 records written through Spark's text sink, so
they land in whatever store the path names.  A record's block is cut into segments
of at most ``segment_bytes``: the first keeps its type, the rest are
``continuation`` records that name the first by ``WARC-Segment-Origin-ID``; the
last one gives the total length.  Reading parses each file as a stream, groups
segments by origin, orders them by number, checks count and total length, and
decodes the chunked transfer framing of the HTTP message.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_PER_FILE = 10_000
_SMALL = "record_id string, origin_id string, number int, total long, type string, page_id long, url string, digest string, refers_to long, block binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes that do not split a UTF-8 character; at least one piece."""
    out, at = [], 0
    while len(data) - at > size:
        end = at + size
        while data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    out.append(data[at:])
    return out


def _chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in _cuts(payload, size) if c]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """Undo chunked transfer framing (RFC 9112, 7.1); ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of a wrong length")
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n" + block.decode() + "\r\n\r"  # the sink adds the last line feed


def page_records(page_id, url: str, payload: bytes, digest: str, first, segment_bytes: int, chunk_bytes: int) -> list[str]:
    """The records of one page: a revisit, or a response in as many segments as it needs."""
    record_id, target = f"urn:page:{page_id}:{digest}", re.sub(r"[\r\n]", "", url or "")
    fields = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is not None and first != page_id:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{first}:{digest}>")]
        return [_record("revisit", record_id, fields, b"HTTP/1.1 200 OK\r\n\r\n")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if len(payload) > chunk_bytes:
        block = http + b"Transfer-Encoding: chunked\r\n\r\n" + _chunked(payload, chunk_bytes)
    else:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    fields.append(("Content-Type", "application/http; msgtype=response"))
    pieces = _cuts(block, segment_bytes)
    if len(pieces) == 1:
        return [_record("response", record_id, fields, block)]
    out = [_record("response", record_id, [*fields, ("WARC-Segment-Number", "1")], pieces[0])]
    for n, piece in enumerate(pieces[1:], 2):
        more = [("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(n))]
        if n == len(pieces):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record("continuation", f"{record_id}:{n}", more, piece))
    return out


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_payload: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
) -> None:
    """Write one logical record for each row of ``pages`` as archives below ``path``.

    Of rows whose payloads (html in UTF-8; null is empty) are equal and of at least
    ``min_payload`` bytes, those with the smallest id are responses and the others
    revisits of it; rows with a null id revisit a copy that has one.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def digests(batches):
        for b in batches:
            data = [x.encode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([base32_sha1(x) for x in data]), pa.array([len(x) for x in data], pa.int64())], ["page_id", "digest", "n"])

    marks = written(base.select("page_id", "html").mapInArrow(digests, "page_id long, digest string, n long"), "digests")
    firsts = marks.where(F.col("n") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    refers = marks.join(firsts, "digest").select(F.col("page_id").alias("_id"), "digest", "first").distinct()
    keyed = base.join(refers, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == _native_digest(F.col("html"))), "left")

    def records(batches):
        for b in batches:
            out = []
            for page_id, url, html, first in zip(*(b.column(k).to_pylist() for k in range(4))):
                payload = html.encode()
                out += page_records(page_id, url, payload, base32_sha1(payload), first, segment_bytes, chunk_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    text = keyed.select("page_id", "url", "html", "first").mapInArrow(records, "value string")
    text.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _native_digest(html):
    """Base32 of SHA-1 in SQL functions: 5 hexadecimal digits make 4 characters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    five = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substr(F.sha1(html), 1 + 5 * g, F.lit(5)), 16, 10).cast("int"))
    char = lambda v, k: F.substr(alphabet, 1 + F.shiftright(v, 15 - 5 * k).bitwiseAND(F.lit(31)), F.lit(1))
    return F.array_join(F.transform(five, lambda v: F.concat(*[char(v, k) for k in range(4)])), "")


def parse(stream) -> list:
    """Yield ``(fields dict with lower-case names, block)`` of each record of an uncompressed byte stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        yield fields, stream.read(int(fields["content-length"]))


class _Gunzip(io.RawIOBase):
    """Uncompressed bytes of gzip data of one or more members, a piece at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.unzip = data, 0, zlib.decompressobj(31)

    def readable(self):
        return True

    def readinto(self, buf):
        while True:
            if self.unzip.eof:
                self.at -= len(self.unzip.unused_data)
                if self.at >= len(self.data):
                    return 0
                self.unzip = zlib.decompressobj(31)
            piece = self.unzip.unconsumed_tail
            if not piece:
                piece = self.data[self.at : self.at + 65536]
                self.at += len(piece)
            out = self.unzip.decompress(piece, len(buf))
            if out:
                buf[: len(out)] = out
                return len(out)
            if not piece:
                return 0


def _urn(value: str | None) -> int | None:
    part = (value or "").strip("<>").split(":")
    return int(part[2]) if len(part) > 2 and re.fullmatch(r"-?\d+", part[2]) else None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The raw records of all archives below ``path``, segments apart."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                size = 0
                stream = io.BufferedReader(_Gunzip(data.as_py()), 1 << 16)
                for f, block in parse(stream):
                    rid = f["warc-record-id"].strip("<>")
                    total = f.get("warc-segment-total-length")
                    number = f.get("warc-segment-number")
                    rows.append({
                        "record_id": rid, "origin_id": f.get("warc-segment-origin-id", rid).strip("<>"), "number": number and int(number), "total": total and int(total),
                        "type": f["warc-type"], "page_id": _urn(rid), "url": f.get("warc-target-uri"), "digest": f.get("warc-payload-digest", "").removeprefix("sha1:"),
                        "refers_to": _urn(f.get("warc-refers-to")), "block": block,
                    })
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _schema)

    _schema = pa.schema([("record_id", pa.string()), ("origin_id", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()),
                         ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _SMALL)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: segments joined by origin and number, with ``n_segments`` and ``complete``.

    ``complete`` is false if a number is missing or the total length differs or is
    absent; the block then holds what there is.  A segment that occurs more than
    once counts once; as many rows come out as the origin has first segments.
    """
    whole = records.where("number is null").select("record_id", "type", "page_id", "url", "digest", "refers_to", "block", F.lit(1).alias("n_segments"), F.lit(True).alias("complete"))
    pieces = (
        records.where("number is not null")
        .groupBy("origin_id", "number")
        .agg(F.count("*").alias("copies"), F.max("total").alias("total"), *[F.first(c, True).alias(c) for c in ("type", "page_id", "url", "digest", "refers_to", "block")])
    )
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    joined = (
        pieces.groupBy("origin_id")
        .agg(*[first(c) for c in ("type", "page_id", "url", "digest", "refers_to", "copies")], F.max("total").alias("total"), F.max("number").alias("last"),
             F.sum(F.octet_length("block")).alias("length"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"))
        .select(
            F.col("origin_id").alias("record_id"), "type", "page_id", "url", "digest", "refers_to",
            F.expr("unhex(array_join(transform(parts, p -> hex(p.block)), ''))").alias("block"), F.size("parts").alias("n_segments"),
            (F.col("total").isNotNull() & (F.col("total") == F.col("length")) & (F.size("parts") == F.col("last"))).alias("complete"),
            F.explode(F.array_repeat(F.lit(0), F.coalesce(F.col("copies"), F.lit(1)).cast("int"))).alias("_copy"),
        )
        .drop("_copy")
    )
    return whole.unionByName(joined)


def decode(records: DataFrame) -> DataFrame:
    """Adds ``payload`` (body of the HTTP message, framing undone) and ``intact`` (its digest is the stated one); revisits have no payload."""

    def run(batches):
        for b in batches:
            types, blocks, digests = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("type", "block", "digest"))
            payloads = []
            for kind, block in zip(types, blocks):
                head, _, body = (block or b"").partition(b"\r\n\r\n")
                if kind != "response":
                    payloads.append(None)
                elif re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head):
                    try:
                        payloads.append(dechunk(body))
                    except ValueError:
                        payloads.append(None)
                else:
                    payloads.append(body)
            good = [None if p is None else base32_sha1(p) == d for p, d in zip(payloads, digests)]
            keep = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(payloads, pa.binary()), pa.array(good, pa.bool_())], [*kept, "payload", "intact"])

    kept = ["record_id", "type", "page_id", "url", "digest", "refers_to", "n_segments", "complete"]
    shape = "record_id string, type string, page_id long, url string, digest string, refers_to long, n_segments int, complete boolean, payload binary, intact boolean"
    return records.select(*kept, "block").mapInArrow(run, shape)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every logical record of the archives below ``path``, reassembled and decoded."""
    return decode(reassemble(read_records(spark, path)))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and report what reading them back gives, one row per page.

    Columns: page_id, payload_bytes and payload_digest (of the full payload, also
    for revisits), record_type, refers_to.  A null html is an empty payload;
    repeated rows each give a row; an empty table gives none; further columns of
    ``pages`` are not read.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    found = written(
        read_archives(pages.sparkSession, path).select(
            "page_id", "refers_to", "type", F.col("digest"), F.octet_length("payload").cast("long").alias("n"), F.coalesce(F.col("complete") & F.coalesce("intact", F.lit(True)), F.lit(False)).alias("good")
        ),
        "warc-read",
    )
    found = found.select("page_id", "refers_to", "type", F.when(F.col("good"), F.col("digest")).alias("digest"), "n")
    sizes = found.where("type = 'response' and digest is not null").groupBy("digest").agg(F.max("n").alias("size"))
    return found.join(sizes, "digest", "left").select("page_id", F.coalesce("n", "size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
