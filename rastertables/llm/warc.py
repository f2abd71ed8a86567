"""WARC archives: pages are written as response records, long ones in segments, repeated payloads as revisits; reading groups
continuation records by their origin, orders them by segment number, verifies the total length and decodes the chunked
transfer framing. Archives are gzip files of some MAX_RECORDS records, written and read by Spark."""
from __future__ import annotations

import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import group_least, materialize

SEGMENT, CHUNK, MAX_RECORDS, LEAST_REVISIT = 16_384, 4_096, 1_000, 100
_END = b"\r\n\r\n"


def _cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most size bytes that end between UTF-8 characters; one empty piece for no data."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out or [b""]


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in _cuts(payload, size) if c) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[line + 2:line + 2 + n])
        if len(out[-1]) != n or body[line + 2 + n:line + 4 + n] != b"\r\n":
            raise ValueError("Broken chunk")
        at = line + 4 + n


def _record(headers: dict[str, object], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n" + block.decode()


def records(page: object, row: int, url: str | None, html: str, refers_to: object) -> list[str]:
    """The records of one page, without the two line ends that follow each."""
    payload = html.encode()
    ident = f"<urn:page:{page}:{row}>"
    common = {"WARC-Record-ID": ident, "WARC-Target-URI": quote(url or "", safe="%/:=&?~#+!$,;'@()*[]"), "WARC-Page-ID": page, "WARC-Date": "1970-01-01T00:00:00Z"}
    digest = {"WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest()}
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [_record({"WARC-Type": "revisit", **common, **digest, "WARC-Refers-To": f"<urn:page:{refers_to}>"}, head)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = _cuts(block, SEGMENT)
    if len(parts) == 1:
        return [_record({"WARC-Type": "response", **common, **digest}, block)]
    out = [_record({"WARC-Type": "response", **common, **digest, "WARC-Segment-Number": 1}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if k == len(parts) else {}
        out.append(_record({"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:page:{page}:{row}:{k}>", "WARC-Page-ID": page, "WARC-Date": common["WARC-Date"], "WARC-Segment-Origin-ID": ident, "WARC-Segment-Number": k, **last}, part))
    return out


def revisits(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """_page, _digest, _first: the pages with a payload that a page with a smaller key has too, and the least of those."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    named = pages.where(F.col(key).isNotNull() & (F.octet_length(payload) >= LEAST_REVISIT)).select(F.col(key).alias("_page"), F.sha2(payload, 256).alias("_digest"))
    return group_least(named, ["_digest"], "_page", "_first").where("_page <> _first").distinct()


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record per row. Null pages are empty. Of equal payloads of LEAST_REVISIT bytes or more, the rows with the least
    key are responses, the others revisit it; rows with a null key are responses. Keys may repeat: a row is a revisit by its
    own payload. Pages move only if there are too many revisits for Spark to broadcast them."""
    again = materialize(revisits(pages, key, html))
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("_page"), F.monotonically_increasing_id().alias("_row"), F.col(url), payload.alias("_html"), F.sha2(payload.cast("binary"), 256).alias("_digest")).join(again, ["_page", "_digest"], "left")

    def run(batches):
        for b in batches:
            out = [r for page, row, u, h, first in zip(*(c.to_pylist() for c in b.columns)) for r in records(page, row, u, h, first)]
            for s in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(out[s:s + 256], pa.string())], names=["value"])

    lines = rows.select("_page", "_row", url, "_html", "_first").mapInArrow(run, "value string")
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", MAX_RECORDS).text(path)


def parse(archive: bytes):
    """(headers, block) of every record."""
    at = 0
    while at < len(archive):
        end = archive.index(_END, at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"No record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        n = int(headers["Content-Length"])
        yield headers, archive[start:start + n]
        if archive[start + n:start + n + 4] != _END:
            raise ValueError(f"Record at {at} does not end where its length says")
        at = start + n + 4


def unpacked(archive: bytes) -> bytes:
    """The content of all gzip members of a file: one for the whole file, or one per record."""
    out = []
    while archive:
        member = zlib.decompressobj(31)
        out.append(member.decompress(archive))
        if not member.eof:
            raise ValueError("The last gzip member is cut off")
        archive = member.unused_data.lstrip(b"\0")
    return b"".join(out)


_PARSED = "page_id long, record_type string, origin string, segment int, total_length long, refers_to long, digest string, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives. A file is at most MAX_RECORDS records of SEGMENT bytes and some headers."""
    names = [x.split()[0] for x in _PARSED.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def number(x):
        return int(x) if x not in (None, "None") else None

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse(unpacked(content.as_py())):
                    refers = h.get("WARC-Refers-To")
                    rows.append((number(h.get("WARC-Page-ID")), h["WARC-Type"], h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), number(h.get("WARC-Segment-Number")), number(h.get("WARC-Segment-Total-Length")),
                                 number(refers[1:-1].rpartition(":")[2]) if refers else None, h.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, block))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, _PARSED)


_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def assemble(rows: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per page: size, digest and kind of its payload (and the payload). Archives are read once: whole records are
    decoded where they are read, segments are written as they are and then grouped by origin. A missing or repeated segment, a wrong total length or a digest that does not
    fit raises an error."""
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def decoded(page, kind, block, refers, digest):
        head, _, body = block.partition(_END)
        if kind == "revisit":
            n = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            return page, n, digest, kind, refers, None
        payload = unchunked(body)
        found = hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError(f"Page {page}: the payload does not have the digest of its record")
        return page, len(payload), found, kind, refers, payload if with_payload else None

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def opened(batches):
        """Whole records decoded, segments as they are, in columns of their own."""
        for b in batches:
            cut = b.column(3).is_valid()
            rest = b.filter(cut)
            out = [decoded(page, kind, block, refers, digest) for page, kind, _, _, _, refers, digest, block in zip(*(c.to_pylist() for c in b.filter(pc.invert(cut)).columns))]
            done = batch(out) if out else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)
            both = [pa.concat_arrays([c, pa.nulls(len(rest), c.type)]) for c in done.columns] + [pa.concat_arrays([pa.nulls(len(done), c.type), c]) for c in rest.columns]
            yield pa.RecordBatch.from_arrays(both, names=[f"w_{x}" for x in names] + [f"s_{x}" for x in b.schema.names])

    def joined(held):
        first = held[0]
        if [x[3] for x in held] != list(range(1, len(held) + 1)) or held[-1][4] is None:
            raise ValueError(f"Page {first[0]}: segments {[x[3] for x in held]} are not complete")
        block = b"".join(x[7] for x in held)
        if len(block) != held[-1][4]:
            raise ValueError(f"Page {first[0]}: {len(block)} bytes instead of {held[-1][4]}")
        return batch([decoded(first[0], first[1], block, first[5], first[6])])

    def segments(batches):
        held = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and row[2] != held[0][2]:
                    yield joined(held)
                    held = []
                held.append(row)
        if held:
            yield joined(held)

    columns = lambda schema, lead: ", ".join(lead + x for x in schema.split(", "))
    once = materialize(rows.mapInArrow(opened, f"{columns(_OUT, 'w_')}, {columns(_PARSED, 's_')}"))
    cut = once.where("s_segment IS NOT NULL").select(*[F.col(f"s_{x}").alias(x) for x in rows.columns])
    cut = cut.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(segments, _OUT)
    return once.where("s_segment IS NULL").select(*[F.col(f"w_{x}").alias(x) for x in names]).unionAll(cut)
