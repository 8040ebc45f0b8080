"""WARC archives written and read as rows of bounded size.

A payload above ``CHUNK_BYTES`` becomes several WARC records: a response (segment 1) and
continuation records, as the format's segmentation has it; so a record identifier and a segment
number name each row, and no step holds more than one chunk beside the input cell. Each segment
carries the digest of the payload up to its own end, so a reader checks as it goes and the last
segment's digest is the payload's.

Archives are gzip-compressed WARC 1.1 files written by Spark's text writer, one per partition,
in the given folder: one row is one WARC record, and the line separator is the CRLF that ends
it. They are read back line by line; a gzip file is one stream, so a task sees it in order and
keeps one record's digest as its only state.

Of equal payloads of at least ``min_bytes`` the row with the smallest id is written as response,
the others as revisit records that name it. The choice moves ids and digests only (a minimum
combined before the shuffle, and an equi-join that may be split where one payload is hot).

Defined cases: null payloads count as empty; null ids come after all others and, if nothing else
has the payload, stay responses; of repeated rows (same id, same payload) one is the response and
the rest revisit it; rows of one id with other payloads, and rows without id, have the digest in
their record identifier, so that each row is a record of its own; null addresses become urn:page:<id>; control characters in addresses are
percent-encoded; extra columns are ignored; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagefacts.llm.common import same
from pagefacts.session import cut_lineage

CHUNK_BYTES = 65_536
DATE = "1970-01-01T00:00:00Z"

# Digits of base 32 as Spark's conv() writes them, and as RFC 4648 does.
_CONV, _RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(binary: Column) -> Column:
    """SHA-1 in base 32, twenty bits (four digits) at a time."""
    digest = F.sha1(binary)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _CONV, _RFC)


def _deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        columns["body"] = pa.array([zlib.compress(b, 1) for b in columns["body"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def record_name(page: Column, number: Column, digest: Column, rest: Column) -> Column:
    """The identifier of a row's record. Rows beside the least digest of their id (``rest``) and rows without id carry theirs."""
    plain = F.concat(F.lit("urn:page:"), page, F.lit(":"), number)
    bare = F.concat(F.lit("urn:page:"), number, F.lit("."), digest)
    return F.when(page.isNull(), bare).when(rest, F.concat(plain, F.lit("."), digest)).otherwise(plain)


def plan_records(pages: DataFrame, id_col: str, html: str, url: str, min_bytes: int) -> DataFrame:
    """(id, url, body, digest, name, refers): names are distinct, refers is the name a revisit refers to.

    Bodies travel once, by id, and deflated; ids and digests are written once and read by all that choose among them.
    """
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(id_col).alias("order"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("body"),
    ).withColumns({"digest": sha1_base32(F.col("body")), "size": F.octet_length("body").cast("long")})
    kind = pages.schema[id_col].dataType.simpleString()
    deflated = rows.mapInArrow(_deflate, f"id string, order {kind}, url string, body binary, digest string, size long")
    keys = cut_lineage(rows.select("order", "digest", "size"), "warc-keys")
    several = (
        keys.filter("order is not null")
        .groupBy(F.col("order").alias("o"))
        .agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
        .filter("least < most")
    )
    rest = keys.join(several, F.col("order") == F.col("o")).filter("digest > least").select("order", "digest").distinct()
    rest = rest.select(F.col("order").alias("o1"), F.col("digest").alias("d1"), F.lit(True).alias("rest"))
    large = keys.filter(F.col("size") >= min_bytes).select("order", "digest")
    first = (
        large.groupBy("digest")
        .agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
        .join(rest, (F.col("first") == F.col("o1")) & (F.col("digest") == F.col("d1")), "left")
    )
    beside = F.coalesce(F.col("rest"), F.lit(False))
    named = record_name(F.col("first").cast("string"), F.lit(0), F.col("digest"), beside)
    first = first.select("digest", "first", named.alias("refers"))
    others = large.join(first, "digest").filter(~F.col("order").eqNullSafe(F.col("first")))
    marks = (
        others.select(F.col("order").alias("o2"), F.col("digest").alias("d2"), "refers", F.lit(False).alias("rest"))
        .unionByName(rest.select(F.col("o1").alias("o2"), F.col("d1").alias("d2"), F.lit(None).cast("string").alias("refers"), "rest"))
        .groupBy("o2", "d2")
        .agg(F.max("refers").alias("refers"), F.max("rest").alias("rest"))
    )
    number = F.row_number().over(Window.partitionBy("order", "digest").orderBy("url")) - 1
    joined = deflated.join(marks, same([F.col("order"), F.col("digest")], [F.col("o2"), F.col("d2")]), "left")
    repeated = (F.col("size") >= min_bytes) & (F.col("number") > 0)
    own = record_name(F.col("id"), F.lit(0), F.col("digest"), beside)
    return joined.withColumn("number", number).select(
        "id", "url", "body", "digest",
        record_name(F.col("id"), F.col("number"), F.col("digest"), beside).alias("name"),
        F.coalesce("refers", F.when(repeated, own)).alias("refers"),
    )


def _chunks(body: bytes, size: int) -> Iterator[bytes]:
    """Slices of at most ``size`` bytes that end between UTF-8 characters."""
    at = 0
    while at < len(body):
        end = min(at + size, len(body))
        while end < len(body) and end > at + 1 and body[end] & 0xC0 == 0x80:
            end -= 1
        yield body[at:end]
        at = end
    if not body:
        yield b""


def _b32(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def _record(headers: list[tuple[str, object]], block: bytes) -> str:
    """One WARC record without its last CRLF, which is the writer's line separator."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines) + block.decode("utf-8", "replace") + "\r\n"


def _address(url: str | None, page: str) -> str:
    if url is None:
        return f"urn:page:{page}"
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def page_records(page, url, body: bytes, digest: str, name: str, refers, size: int, date: str) -> Iterator[str]:
    """The WARC records of one page row, chunk by chunk."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    about = [("WARC-Date", date), ("WARC-Target-URI", _address(url, page or ""))]
    kind = [("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        yield _record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *about,
             ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
             ("WARC-Refers-To", f"<{refers}>"), ("WARC-Payload-Digest", f"sha1:{digest}"), *kind],
            head,
        )
        return
    sha, done = hashlib.sha1(), 0
    for segment, chunk in enumerate(_chunks(body, size), 1):
        sha.update(chunk)
        done += len(chunk)
        last, running = done == len(body), ("X-Running-Digest", f"sha1:{_b32(sha)}")
        if segment == 1:
            more = [] if last else [("WARC-Segment-Number", 1)]
            yield _record(
                [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *about,
                 ("WARC-Payload-Digest", f"sha1:{digest}"), *kind, *more, running],
                head + chunk,
            )
        else:
            total = [("WARC-Segment-Total-Length", len(head) + len(body))] if last else []
            yield _record(
                [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}#{segment}>"), *about,
                 ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", segment), *total, running],
                chunk,
            )


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", html: str = "html", url: str = "url",
    min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str = DATE,
) -> None:
    """Write the rows of ``pages`` as WARC files into ``folder``."""

    def lines(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                out = []
                body = zlib.decompress(row["body"])
                for text in page_records(
                    row["id"], row["url"], body, row["digest"], row["name"], row["refers"], chunk_bytes, date
                ):
                    out.append(text)
                    if len(out) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    records = plan_records(pages, id_col, html, url, min_bytes).mapInArrow(lines, "value string")
    records.write.option("lineSep", "\r\n").option("compression", "gzip").text(folder)


def _parse(lines: Iterator[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    for line in lines:
        if not line:
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        for line in lines:
            if not line:
                break
            key, _, value = line.partition(b":")
            headers[key.strip().lower()] = value.strip()
        need, got, parts = int(headers[b"content-length"]), -2, []
        while got < need:
            part = next(lines)
            parts.append(part)
            got += len(part) + 2
        if got != need:
            raise ValueError(f"a record of {need} bytes has {got}")
        yield headers, b"\r\n".join(parts)


CHUNK_SCHEMA = (
    "record_id string, chunk int, record_type string, page string, refers_to string, payload_bytes long, "
    "chunk_bytes long, running_digest string, data binary"
)


def _digest_of(value: bytes) -> str:
    return value.decode().removeprefix("sha1:")


def _page_of(record_id: str) -> str | None:
    page, colon, _ = record_id.removeprefix("urn:page:").rpartition(":")
    return page if colon else None


def _read(with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("record_id", pa.string()), ("chunk", pa.int32()), ("record_type", pa.string()), ("page", pa.string()),
             ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("chunk_bytes", pa.int64()),
             ("running_digest", pa.string()), ("data", pa.binary())]
        )
        rows, size = [], 0
        sha, origin = hashlib.sha1(), None
        for headers, block in _parse(line for b in batches for line in b.column(0).to_pylist()):
            kind = headers[b"warc-type"].decode()
            name = headers[b"warc-record-id"].decode().strip("<>")
            if kind == "continuation":
                head, data = None, block
                name = headers[b"warc-segment-origin-id"].decode().strip("<>")
                if name != origin:
                    raise ValueError(f"a segment of {name} doesn't follow its record")
            else:
                http, _, data = block.partition(b"\r\n\r\n")
                head = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:])
                sha, origin = hashlib.sha1(), name
            sha.update(data)
            running = _b32(sha)
            if kind == "revisit":
                running = _digest_of(headers[b"warc-payload-digest"])
            elif running != _digest_of(headers[b"x-running-digest"]):
                raise ValueError(f"the digest of {name} differs")
            refers = _page_of(headers[b"warc-refers-to"].decode().strip("<>")) if kind == "revisit" else None
            rows.append(
                (name, int(headers.get(b"warc-segment-number", b"1")), "revisit" if kind == "revisit" else "response", _page_of(name), refers,
                 int(head[b"content-length"]) if head else None, len(data), running, data if with_data else None)
            )
            size += len(data)
            if len(rows) >= 2000 or size >= 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def read_chunks(spark: SparkSession, folder: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives: one row per record and chunk, digests checked."""
    lines = spark.read.option("lineSep", "\r\n").schema("value string").text(folder)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(_read(with_data), CHUNK_SCHEMA)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: page, payload_bytes, payload_digest, record_type, refers_to, n_chunks."""
    return (
        chunks.groupBy("record_id")
        .agg(
            F.first("page", ignorenulls=True).alias("page"),
            F.max("payload_bytes").alias("payload_bytes"),
            F.max_by("running_digest", "chunk").alias("payload_digest"),
            F.first("record_type").alias("record_type"),
            F.first("refers_to", ignorenulls=True).alias("refers_to"),
            F.count(F.lit(1)).alias("n_chunks"),
            F.sum("chunk_bytes").alias("stored_bytes"),
        )
        .withColumn(
            "payload_bytes",
            F.when((F.col("record_type") == "revisit") | (F.col("stored_bytes") == F.col("payload_bytes")), F.col("payload_bytes")),
        )
    )
