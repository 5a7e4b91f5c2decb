"""WARC archives: writing with segmented records, and reassembly of the segments.

Every page becomes a WARC record whose block is an HTTP response with chunked
transfer framing; repeated payloads become ``revisit`` records.  Blocks over
``SEGMENT_BYTES`` are segmented: the first segment keeps the record's type,
``continuation`` records follow with the origin's id and their segment number,
and the last one tells the total length.  Archives are gzip files written by
Spark's text writer, whose line separator is the blank lines that end a
record.

Reading parses the archives file by file.  Whole records are decoded at once;
segments are grouped by the id of their origin, ordered by segment number,
checked against the total length, joined, and then decoded.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_folder
from .common import slices

REVISIT_BYTES = 1000     # payloads from this size on are written once
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
FILE_RECORDS = 1_000
BROADCAST_ROWS = 100_000  # of (digest, page_id) pairs: 6 MB; larger tables are joined by shuffle

_END = "\r\n\r\n"


def _cut(raw: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes that split no UTF-8 character."""
    out, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + size)
        while to < len(raw) and raw[to] & 0xC0 == 0x80 and to > at + 1:
            to -= 1
        out.append(raw[at:to])
        at = to
    return out


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cut(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions are skipped, broken framing raises ValueError."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        at = end + 2 + size
        if len(out[-1]) != size or body[at:at + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        at += 2


def _header(fields: list[tuple[str, object]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"


def _uri(url: str | None) -> str | None:
    if url is None:
        return None
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def page_records(page_id, url, payload: bytes, original, name: str, segment_bytes: int = SEGMENT_BYTES) -> list[str]:
    """The WARC records of one page; ``original`` is the page whose payload this one repeats, ``name`` makes ids unique."""
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = f"<urn:page:{page_id}:{name}>"
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _uri(url)), ("X-Page-Id", page_id),
              ("WARC-Payload-Digest", f"sha1:{sha}")]
    if original is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        return [_header([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common,
                         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                         ("WARC-Refers-To", f"<urn:page:{original}>"),
                         ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]) + block.decode()]
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload))
    parts = _cut(block, segment_bytes)
    out = []
    for i, part in enumerate(parts):
        first, last = i == 0, i == len(parts) - 1
        fields = [("WARC-Type", "response" if first else "continuation"),
                  ("WARC-Record-ID", own if first else f"<urn:page:{page_id}:{name}.{i + 1}>"), *(common if first else common[:2])]
        if len(parts) > 1:
            fields += [("WARC-Segment-Number", i + 1), ("WARC-Segment-Origin-ID", None if first else own),
                       ("WARC-Segment-Total-Length", len(block) if last else None)]
        fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(part))]
        out.append(_header(fields) + part.decode("utf-8", "surrogateescape"))
    return out


def _records(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for rb in slices(batches, "html"):
            out = []
            for p, u, h, o in zip(*(rb.column(c).to_pylist() for c in ("page_id", "url", "html", "original"))):
                out += page_records(p, u, (h or "").encode("utf-8"), o, f"{task}-{n}", segment_bytes)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
    return run


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as WARC archives.

    Null html is an empty payload.  Of records with equal payloads of
    ``REVISIT_BYTES`` or more, that with the largest page_id is the response;
    further rows of that page_id are responses too, all others revisit it
    (rows without page_id revisit any other).  Only digests are grouped, and
    only those that repeat are matched against the pages: by broadcast while
    their checked number is small, else by a shuffle.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    large = F.octet_length("html") >= REVISIT_BYTES
    digests = rows.where(large).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"))
    many = cut_lineage(digests.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
                       .where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    many = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    named = rows.withColumn("digest", F.when(large, F.sha1(F.encode("html", "UTF-8")))).join(many, "digest", "left")
    named = named.select("page_id", "url", "html", F.when(~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)),
                                                          F.col("first")).alias("original"))
    (named.mapInArrow(_records(segment_bytes), "value string").write.option("lineSep", _END)
     .option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an archive's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4:end + 4 + size]
        if len(block) != size:
            raise ValueError("record cut short")
        yield fields, block
        at = end + 4 + size
        while data[at:at + 2] == b"\r\n":
            at += 2


_PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64()), ("segments", pa.int64()), ("intact", pa.bool_()),
                   ("uri", pa.string()), ("payload", pa.binary())])
_PART = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("page_id", pa.int64()),
                   ("uri", pa.string()), ("digest", pa.string()), ("block", pa.binary())])


def _page_row(page_id, block: bytes, digest: str | None, segments: int, whole: bool = True, uri: str | None = None,
              payloads: bool = False) -> dict:
    """Decode a response block and check it against its digest."""
    try:
        head, _, body = block.partition(b"\r\n\r\n")
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        payload, whole = b"", False
    sha = hashlib.sha1(payload)
    good = whole and (digest is None or base64.b32encode(sha.digest()).decode() == digest)
    return {"page_id": page_id, "payload_bytes": len(payload), "payload_digest": sha.hexdigest(), "record_type": "response",
            "refers_to": None, "segments": segments, "intact": good, "uri": uri, "payload": payload if payloads else None}


def _number(text: str | None):
    return None if text is None or text == "None" else int(text)


def _digest(fields) -> str | None:
    return fields["WARC-Payload-Digest"].removeprefix("sha1:") if "WARC-Payload-Digest" in fields else None


def plain_bytes(content: bytes) -> bytes:
    """An archive's bytes; gzip files may have a member for every record, or one for all."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        if not member.eof:
            raise ValueError("gzip member cut short")
        content = member.unused_data.lstrip(b"\0")  # zeros may pad a file
    return b"".join(out)


def _parsed(content: bytes):
    return parse(plain_bytes(content))


def _whole(payloads: bool):
    """Pages of the records that are not segmented."""
    def run(batches):
        for rb in batches:
            for content in rb.column("content"):
                out = []
                for fields, block in _parsed(content.as_py()):
                    page, uri = _number(fields.get("X-Page-Id")), fields.get("WARC-Target-URI")
                    if fields["WARC-Type"] == "revisit":
                        size = int(block.split(b"Content-Length: ")[1].split(b"\r\n")[0])
                        sha = base64.b32decode(_digest(fields)).hex()
                        out.append({"page_id": page, "payload_bytes": size, "payload_digest": sha, "record_type": "revisit",
                                    "refers_to": int(fields["WARC-Refers-To"].strip("<>").split(":")[2]), "segments": 1, "intact": True,
                                    "uri": uri, "payload": None})
                    elif fields["WARC-Type"] == "response" and "WARC-Segment-Number" not in fields:
                        out.append(_page_row(page, block, _digest(fields), 1, True, uri, payloads))
                yield pa.RecordBatch.from_pylist(out, schema=_PAGE)
    return run


def _parts(batches):
    """Segments, named by the id of their origin."""
    for rb in batches:
        for content in rb.column("content"):
            out = []
            for fields, block in _parsed(content.as_py()):
                if "WARC-Segment-Number" in fields:
                    out.append({"origin": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]),
                                "number": int(fields["WARC-Segment-Number"]), "total": _number(fields.get("WARC-Segment-Total-Length")),
                                "page_id": _number(fields.get("X-Page-Id")), "uri": fields.get("WARC-Target-URI"),
                                "digest": _digest(fields), "block": block})
            yield pa.RecordBatch.from_pylist(out, schema=_PART)


def _joined(payloads: bool):
    """Pages of gathered segments: numbers 1 to n without gaps, and the total length that the last one tells."""
    def run(batches):
        for rb in batches:
            out = []
            for r in rb.to_pylist():
                parts = sorted(r["parts"], key=lambda p: p["number"])
                block = b"".join(p["block"] for p in parts)
                whole = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
                out.append(_page_row(parts[0]["page_id"], block, parts[0]["digest"], len(parts), whole, parts[0]["uri"], payloads))
            yield pa.RecordBatch.from_pylist(out, schema=_PAGE)
    return run


_PAGE_DDL = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments long, "
             "intact boolean, uri string, payload binary")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, segments, intact, uri, payload.

    ``intact`` is false where a segment is missing, the total length differs,
    the framing is broken or the payload does not have its digest.  ``payload``
    holds the decoded bytes of responses (null for revisits, and without
    ``payloads``).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    parts = files.mapInArrow(_parts, "origin string, number long, total long, page_id long, uri string, digest string, block binary")
    gathered = parts.groupBy("origin").agg(F.collect_list(F.struct("number", "total", "page_id", "uri", "digest", "block")).alias("parts"))
    return files.mapInArrow(_whole(payloads), _PAGE_DDL).unionByName(gathered.select("parts").mapInArrow(_joined(payloads), _PAGE_DDL))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives into the checkpoint folder and read back what they tell of the payloads.

    The archives are deleted with the other copies (``session.release``).
    """
    spark = pages.sparkSession
    folder = scratch_folder(spark, "warc")
    write_archives(pages, folder)
    return read_archives(spark, folder, payloads=False).drop("uri", "payload")
