"""WARC archives: one gzip member a record, and a sequential reader.

Writing: each record becomes one gzip member; Spark's text sink writes the members of a partition one after
another, so archives land on any file system that Spark reaches, through its committer (a lost executor's files
are written anew). The sink ends every line with a separator; that is the byte 0 here, which also ends any
gzip member of less than 16 MiB of content (the high byte of ISIZE), so it is left off the row and put back by the
sink. Longer members keep it and are followed by a zero byte of padding, as gzip readers allow.

Reading: the archive's bytes go through zlib in steps of CHUNK, members are framed by the stream itself, blocks
by Content-Length, and the digests of block and payload are computed again.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table

CHUNK = 1 << 16
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: object) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in str(value))


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """An uncompressed record: a response, or with refers_to a revisit (its block ends after the HTTP head)."""
    block = HTTP_HEAD + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _field(url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{b32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{b32_sha1(block)}"), ("X-Payload-Length", len(payload)), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, path: str, max_records: int = 20_000) -> None:
    """pages(page_id, url, payload binary, refers_to) to archives under path, max_records in each at most."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for page_id, url, payload, ref in zip(x["page_id"], x["url"], x["payload"], x["refers_to"], strict=True):
                m = member(record("null" if page_id is None or pd.isna(page_id) else int(page_id), url, payload or b"", None if pd.isna(ref) else int(ref)))
                out.append(m[:-1] if m[-1] == 0 else m)
            yield pd.DataFrame({"value": out})

    packed = pages.select("page_id", "url", "payload", "refers_to").mapInPandas(pack, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", max_records).text(path)


def read_members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of each gzip member of a stream, read in one pass; zero bytes between members are padding."""
    z, parts, left = None, [], b""
    for chunk in chunks:
        data = left + chunk
        left = b""
        while data:
            if z is None:
                data = data.lstrip(b"\0")
                if not data:
                    break
                z, parts = zlib.decompressobj(31), []
            parts.append(z.decompress(data))
            data = b""
            if z.eof:
                yield b"".join(parts)
                data, z = z.unused_data, None
    if z is not None:
        raise ValueError("the archive ends inside a member")


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record, framed by Content-Length."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the block does not end where Content-Length says")
    return fields, rest[:n]


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"


def _records(content: bytes, with_payload: bool) -> Iterator[tuple]:
    view = memoryview(content)
    for data in read_members(bytes(view[i : i + CHUNK]) for i in range(0, len(view), CHUNK)):
        fields, block = parse(data)
        number = lambda k: (v := fields.get(k, "")[10:-1]) and v != "null" and int(v) or (0 if v == "0" else None)
        payload = block.partition(b"\r\n\r\n")[2]
        said = fields["warc-payload-digest"].removeprefix("sha1:")
        ok = fields["warc-block-digest"] == f"sha1:{b32_sha1(block)}"
        if fields["warc-type"] == "response":
            ok = ok and said == b32_sha1(payload) and int(fields["x-payload-length"]) == len(payload)
        yield number("warc-record-id"), fields.get("warc-target-uri"), fields["warc-type"], number("warc-refers-to"), int(fields["x-payload-length"]), said, ok, payload if with_payload else None


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record; digest_ok tells whether block and payload have the digests that the header names."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        for x in batches:
            for content in x["content"]:
                rows, held = [], 0
                for r in _records(content, payload):
                    rows.append(r)
                    held += len(r[-1] or b"") + 300
                    if held > 4 << 20:
                        yield _frame(rows, names)
                        rows, held = [], 0
                yield _frame(rows, names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(unpack, READ_SCHEMA)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    x = pd.DataFrame(rows, columns=names)
    return x.astype({"page_id": "Int64", "refers_to": "Int64"})


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to (page_id, url, payload, refers_to): of equal payloads the largest page_id is stored.

    Null html is an empty payload. Rows that share the largest page_id and the payload are all stored.
    """
    pages = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    # counts are combined before the shuffle; the join below carries only digests that repeat on its right side
    twice = pages.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select("digest", "largest")
    return pages.join(twice, "digest", "left").select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("largest"), F.col("largest")).alias("refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder and read back; digest_ok is the reader's verification."""
    path = fresh_path(spark, "warc")
    write_archives(with_revisits(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


#: 160 bits are eight groups of five hexadecimal digits, each four base32 digits.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, g * 5 + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT + 1, 1) for j in range(4)], '') for g in range(8)], '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to, TRUE AS digest_ok
FROM d
"""
