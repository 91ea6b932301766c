"""WARC archives: writing pages as records and reassembling them from segments.

A record ends with two line ends, and so does a row that Spark's text writer ends with that separator: archives are
written by the plain text writer and read as binary files, on any store. Long records are split: the first segment
carries the record's id, continuation records name it as their origin, the last tells the total length. Bodies are
in chunked transfer framing. Payloads are text (UTF-8), and segments and chunks end between characters.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Stage, arrow_rows, small_batches

SEPARATOR = "\r\n\r\n"
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 4 << 10
LEAST_REVISIT = 1000
DATE = "2000-01-01T00:00:00Z"  # archives of equal pages are equal


def _pieces(body: bytes, size: int) -> Iterator[bytes]:
    """Parts of UTF-8 bytes of at most ``size`` (4 or more), none of which begins within a character."""
    at = 0
    while at < len(body):
        to = min(at + size, len(body))
        while to < len(body) and body[to] & 0xC0 == 0x80:
            to -= 1
        yield body[at:to]
        at = to


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in _pieces(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. ValueError if it is cut or malformed."""
    at, out = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Date", DATE), ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n" + block.decode("utf-8", "surrogatepass")


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def _uri(url: str | None) -> str:
    return "".join(c for c in url or "" if c > " ") or "urn:page:unknown"


def _records(segment: int):
    """Text rows of the records of pages (page_id, url, payload, digest, keeper, bytes)."""

    def records(page_id, url, payload, digest, keeper, size):
        common = [("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", "sha1:" + b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http;msgtype=response")]
        if keeper is not None:
            yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(page_id, digest)), ("WARC-Refers-To", _urn(keeper, digest)),
                           ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common],
                          b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % size)
            return
        raw = payload.encode("utf-8", "surrogatepass")
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(raw)
        own = [("WARC-Type", "response"), ("WARC-Record-ID", _urn(page_id, digest)), *common]
        if len(block) <= segment:
            yield _record(own, block)
            return
        parts = list(_pieces(block, segment))
        yield _record([*own, ("WARC-Segment-Number", "1")], parts[0])
        for number, part in enumerate(parts[1:], 2):
            last = [("WARC-Segment-Total-Length", str(len(block)))] if number == len(parts) else []
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:segment:{number}:{_urn(page_id, digest)[1:]}"),
                           ("WARC-Segment-Origin-ID", _urn(page_id, digest)), ("WARC-Segment-Number", str(number)), *last], part)

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array([r for row in rows for r in records(*row)], pa.string())], ["value"])

    return run


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT_BYTES) -> None:
    """Archives of the pages in gzip files, one for each partition in which equal payloads meet: pages move once.

    Of pages with equal payloads of at least 1000 bytes that with the largest key is a response and the others
    revisit it; where rows repeat that key, each is a response. Null keys come last and revisit if they can.
    """
    small_batches(pages.sparkSession, 500)
    known = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    known = known.withColumn("digest", F.sha1(F.encode("payload", "UTF-8"))).withColumn("bytes", F.octet_length("payload"))
    equal = known.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest", "bytes").agg(F.max("page_id").alias("largest"), F.count("*").alias("rows"))
    equal = equal.filter("rows > 1").select("digest", "bytes", "largest")
    joined = known.join(equal, ["digest", "bytes"], "left")
    keeper = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    # A revisit needs only the length of its payload.
    rows = joined.select("page_id", "url", F.when(keeper.isNull(), F.col("payload")).alias("payload"), "digest", keeper.alias("keeper"), "bytes")
    rows.mapInArrow(_records(segment), "value string").write.mode("overwrite").option("lineSep", SEPARATOR).option("compression", "gzip").text(folder)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record; bytes may be gzipped, in several members."""
    raw = content
    if content[:2] == b"\x1f\x8b":
        parts, rest = [], content
        while rest:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(rest) + member.flush())
            rest = member.unused_data
        raw = b"".join(parts)
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record begins where the last one ended")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) != size or raw[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record is cut")
        yield fields, block
        at = end + 8 + size


PAYLOAD = "record_id string, type string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"
#: What is read of the archives: whole records decoded, and segments (``digest`` and on) as they stand.
FOUND = f"{PAYLOAD}, digest string, number int, origin string, total long, block binary"


def _columns(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _decoded(kind: str, digest: str, number: int | None, block: bytes, parts: list[dict] | None, keep_payload: bool) -> tuple:
    """(bytes, digest, payload, error) of a record; parts are the continuations (number, total, block) in order."""
    try:
        if number is not None:
            numbers = [number, *(p["number"] for p in parts or [])]
            if numbers != list(range(1, len(numbers) + 1)):
                raise ValueError("a segment is missing")
            block = b"".join([block, *(p["block"] for p in parts or [])])
            total = (parts or [{"total": None}])[-1]["total"]
            if total != len(block):
                raise ValueError(f"the segments have {len(block)} bytes, the record {total}")
        head, _, body = block.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
        known = b32decode(digest.partition(":")[2]).hex()
        if kind == "revisit":
            return int(fields[b"content-length"]), known, None, None
        payload = dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
        if (found := hashlib.sha1(payload).hexdigest()) != known:
            raise ValueError("the payload has another digest")
        return len(payload), found, payload if keep_payload else None, None
    except ValueError as fault:
        return None, None, None, str(fault)


def _read(keep_payload: bool, flush: int = 1 << 24):
    """The records of each file: one that stands whole is decoded here, so only segments are stored as blocks."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows, held = [], 0
                for fields, block in parse(content):
                    kind, digest = fields["warc-type"], fields.get("warc-payload-digest")
                    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                    head = (fields["warc-record-id"], kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"))
                    if kind != "continuation" and number is None:
                        rows.append((*head, *_decoded(kind, digest, None, block, None, keep_payload), None, None, None, None, None))
                    else:
                        rows.append((*head, None, None, None, None, digest, number and int(number), fields.get("warc-segment-origin-id"), total and int(total), block))
                    held += len(block)
                    if held > flush:
                        yield _batch(rows, FOUND)
                        rows, held = [], 0
                yield _batch(rows, FOUND)

    return run


def _whole(keep_payload: bool):
    """Records from their first segments and their parts."""

    def run(batches):
        for batch in batches:
            yield _batch([
                (r["record_id"], r["type"], r["url"], r["refers_to"], *_decoded(r["type"], r["digest"], r["number"], r["block"], r["parts"], keep_payload))
                for r in batch.to_pylist()], PAYLOAD)

    return run


def read(spark, folder: str, keep_payload: bool = True) -> DataFrame:
    """One row per response and revisit: record_id, type, url, refers_to, payload_bytes, payload_digest, payload (null
    for revisits), error. A record whose segments are missing, have another total length or digest, or are badly
    framed, keeps its row with the reason in ``error``. Segments may lie in different files; repeated continuations
    count once, and each repeated first segment gives a row.
    """
    stage = Stage(spark, "warc")
    with arrow_rows(spark, 1):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
        found = stage.write(files.mapInArrow(_read(keep_payload), FOUND), "found")
    whole = found.filter("block IS NULL").select(*_columns(PAYLOAD))
    rest = found.filter("block IS NOT NULL AND type = 'continuation'").dropDuplicates(["origin", "number"])
    parts = rest.groupBy(F.col("origin").alias("of")).agg(F.sort_array(F.collect_list(F.struct("number", "total", "block"))).alias("parts"))
    columns = ["record_id", "type", "url", "refers_to", "digest", "number", "block"]
    first = found.filter("block IS NOT NULL AND type <> 'continuation'").select(*columns)
    split = first.join(parts, F.col("record_id") == F.col("of"), "left").select(*columns, "parts")
    small_batches(spark, 200)
    return whole.union(split.mapInArrow(_whole(keep_payload), PAYLOAD))


def page_of(record: str) -> Column:
    """The page key in a column of record ids, null for pages without one."""
    return F.expr(f"try_cast(nullif(split({record}, ':')[2], 'null') AS bigint)")
