"""Legacy ARC archives and their conversion to WARC.

Archives are written with Spark's text writer: a record is one value whose last
line feed is the line separator, so tasks commit their files like any other
output and any file system Spark knows will do. They are read as binary files
and cut by the declared lengths, never by a separator.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scimetrics.llm.tables import checked
from scimetrics.session import materialize, new_path

SEGMENT_BYTES, FILE_SEGMENTS, FILE_RECORDS = 4 << 20, 4, 2000
LEAST_PAYLOAD = 100
FIRST_DATE = datetime(1997, 1, 1, tzinfo=UTC).timestamp()

#: Field names of the record lines of both versions of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def _arc_head(version: int) -> bytes:
    """The version block that begins every archive."""
    body = f"{version} 0 scimetrics\n{ARC_FIELDS[version]}\n".encode()
    if version == 1:
        line = f"filedesc://segment.arc 0.0.0.0 19970101000000 text/plain {len(body)}\n"
    else:
        line = f"filedesc://segment.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 segment.arc {len(body)}\n"
    return line.encode() + body + b"\n"


def _arc_record(version: int, page_id: int | None, url: str, html: str, offset: int) -> bytes:
    payload = html.encode()
    # the field separator may not stand in a URL
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url) or "about:blank"
    name = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{name}Content-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + payload
    when = datetime.fromtimestamp(FIRST_DATE + (page_id or 0) % 10**9, UTC).strftime("%Y%m%d%H%M%S")
    if version == 1:
        line = f"{url} 0.0.0.0 {when} text/html {len(block)}\n"
    else:
        line = f"{url} 0.0.0.0 {when} text/html 200 {zlib.crc32(block):08x} - {offset} segment.arc {len(block)}\n"
    return line.encode() + block + b"\n"


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole small archives, the two versions of the format in turn."""
    version, parts, size = 1, [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            page_id = None if row.no_id else int(row.page_id)
            parts.append(_arc_record(version, page_id, row.url, row.html, size))
            size += len(parts[-1])
            if size >= SEGMENT_BYTES:
                # the writer adds the last line feed
                yield pd.DataFrame({"value": [_arc_head(version) + b"".join(parts)[:-1]]})
                version, parts, size = 3 - version, [], 0
    if parts:
        yield pd.DataFrame({"value": [_arc_head(version) + b"".join(parts)[:-1]]})


def _write(values: DataFrame, path: str, per_file: int) -> None:
    """One archive value per row to gzip files; the writer ends each with a line feed."""
    text = values.select(F.col("value").cast("string").alias("value"))
    text.write.option("compression", "gzip").option("lineSep", "\n").option(
        "maxRecordsPerFile", per_file
    ).text(path)


def write_arc(pages: DataFrame, path: str) -> None:
    """Archive ``pages(page_id, url, html)``; a null url or html is empty."""
    wanted = F.col("page_id").cast("long")
    rows = pages.select(
        F.coalesce(wanted, F.lit(0)).alias("page_id"),
        wanted.isNull().alias("no_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    _write(rows.mapInPandas(_segments, "value binary"), path, FILE_SEGMENTS)


class _Stream:
    """Lines and counted bytes of a gzip file of any number of members."""

    def __init__(self, content: bytes) -> None:
        self.rest, self.buffer, self.at, self.unzip = content, b"", 0, None

    def _fill(self) -> bool:
        if self.unzip is None or self.unzip.eof:
            if self.unzip is not None:
                self.rest = self.unzip.unused_data
            if not self.rest:
                return False
            self.unzip, fresh = zlib.decompressobj(31), self.rest
        else:
            fresh = self.unzip.unconsumed_tail
        more = self.unzip.decompress(fresh, 1 << 20)
        if not (more or fresh or self.unzip.eof):
            return False
        self.buffer, self.at = self.buffer[self.at :] + more, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end, None at the end of the file."""
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._fill():
                if self.at == len(self.buffer):
                    return None
                end = len(self.buffer)
                break
        found, self.at = self.buffer[self.at : end], min(end + 1, len(self.buffer))
        return found.removesuffix(b"\r")

    def take(self, size: int) -> bytes:
        parts = []
        while size > len(self.buffer) - self.at:
            parts.append(self.buffer[self.at :])
            size -= len(parts[-1])
            self.at = len(self.buffer)
            if not self._fill():
                raise ValueError(f"the archive ends {size} bytes before the declared length")
        parts.append(self.buffer[self.at : self.at + size])
        self.at += size
        return b"".join(parts)


def _http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, header bytes and body of an HTTP response; without one all is body."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, found, body = block.partition(b"\r\n\r\n")
    pairs = (line.split(":", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}, head + found, body


def _declared(url: str, block: bytes) -> list[str] | None:
    """Fields that a version block declares in its second line; None for any other record."""
    lines = block.split(b"\n", 2)
    if not url.startswith("filedesc://") or len(lines) < 2 or not re.match(rb"\d+ \d+ ", lines[0]):
        return None
    fields = lines[1].decode("latin-1").split()
    return fields if fields[:1] == ["URL"] and fields[-1:] == ["Archive-length"] else None


def arc_records(content: bytes) -> Iterator[dict]:
    """Records of an ARC file; the version blocks say which fields a record line has.

    A page may have a ``filedesc://`` address too: only a block that declares
    fields is a version block. A stated checksum (hex CRC-32) must agree.
    """
    stream, fields = _Stream(content), ARC_FIELDS[1].split()
    while (line := stream.line()) is not None:
        if not line:
            continue
        values = line.decode("utf-8", "replace").split(" ")
        block = stream.take(int(values[-1]))
        if declared := _declared(values[0], block):
            fields = declared
            continue
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields where {len(fields)} were declared")
        record = dict(zip(fields, values))
        stated = record.get("Checksum", "-")
        if re.fullmatch("[0-9a-f]{8}", stated) and int(stated, 16) != zlib.crc32(block):
            raise ValueError(f"the checksum of {record['URL']} is not that of its block")
        http, head, payload = _http(block)
        yield {
            "page_id": int(http["x-page-id"]) if "x-page-id" in http else None,
            "url": record["URL"],
            "ip": record["IP-address"],
            "date": datetime.strptime(record["Archive-date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ"),
            "http": head,
            "payload": payload,
        }


ARC_SCHEMA = "page_id long, url string, ip string, date string, http binary, payload binary, digest string, size long"


def _arc_rows(batches: Iterator[pd.DataFrame], payload: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows, size = [], 0
            for record in arc_records(content):
                body = record["payload"]
                record |= {"digest": hashlib.sha256(body).hexdigest(), "size": len(body)}
                if payload:
                    size += len(body)
                else:
                    record["payload"] = None
                rows.append(record)
                if size > SEGMENT_BYTES:
                    yield _arc_frame(rows)
                    rows, size = [], 0
            if rows:
                yield _arc_frame(rows)


def _arc_frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in ARC_SCHEMA.split(", ")])
    return frame.assign(page_id=pd.array([r["page_id"] for r in rows], "Int64"))


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of a folder of ARC files, with or without their payload."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(partial(_arc_rows, payload=payload), ARC_SCHEMA)


def _record_id(*columns: str) -> Column:
    """A name-based identifier: the same record gets the same one in every attempt."""
    h = F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def decisions(records: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """(page_id, digest, refers_id, ...) of the records that revisit another one.

    Of records with equal payloads of at least ``least`` bytes the one with
    the smallest page_id is the response. Only digests are grouped and joined.
    """
    large = records.where((F.col("size") >= least) & F.col("page_id").isNotNull())
    first = materialize(
        large.groupBy("digest")
        .agg(F.min(F.struct("page_id", "url", "date")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first"),
        "first",
    )
    later = large.join(first, "digest").where(F.col("page_id") > F.col("first.page_id"))
    target = later.select(
        F.col("page_id").alias("own"),
        "digest",
        F.col("first.page_id").alias("page_id"),
        F.col("first.url").alias("url"),
        F.col("first.date").alias("date"),
    )
    return target.select(
        F.col("own").alias("page_id"),
        "digest",
        _record_id("page_id", "url", "date", "digest").alias("refers_id"),
        F.col("url").alias("refers_uri"),
        F.col("date").alias("refers_date"),
    ).dropDuplicates(["page_id", "digest"])


def convert(spark: SparkSession, arc: str, path: str, least: int = LEAST_PAYLOAD) -> None:
    """Convert a folder of ARC files to WARC files.

    The payloads are read once more after the decisions are known and are not
    shuffled as long as the revisits fit a broadcast of checked size. A revisit
    keeps the HTTP headers, which state the length of its payload.
    """
    light = materialize(read_arc(spark, arc, payload=False).drop("http", "payload"), "records")
    found = materialize(decisions(light, least), "revisits")
    records = read_arc(spark, arc).join(checked(found, 300), ["page_id", "digest"], "left")
    revisit = F.col("refers_id").isNotNull()
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id("page_id", "url", "date", "digest")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        F.coalesce(
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                line("WARC-Refers-To", F.col("refers_id")),
                line("WARC-Refers-To-Target-URI", F.col("refers_uri")),
                line("WARC-Refers-To-Date", F.col("refers_date")),
            ),
            F.lit(""),
        ),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    value = F.concat(F.encode(head, "UTF-8"), block, F.encode(F.lit("\r\n\r"), "UTF-8"))
    _write(records.select(value.alias("value")), path, FILE_RECORDS)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of a WARC file."""
    stream = _Stream(content)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with {line[:40]!r}")
        headers = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.take(int(headers["content-length"]))


WARC_SCHEMA = (
    "page_id long, record_id string, record_type string, url string, date string, "
    "payload_bytes long, payload_digest string, refers_id string, intact boolean"
)


def _warc_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for headers, block in warc_records(content):
                http, _, body = _http(block)
                stated = headers["warc-payload-digest"].removeprefix("sha256:")
                intact = headers["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
                revisit = headers["warc-type"] == "revisit"
                own = stated if revisit else hashlib.sha256(body).hexdigest()
                rows.append(
                    (
                        int(http["x-page-id"]) if "x-page-id" in http else None,
                        headers["warc-record-id"],
                        headers["warc-type"],
                        headers["warc-target-uri"],
                        headers["warc-date"],
                        int(http["content-length"]) if revisit else len(body),
                        own,
                        headers.get("warc-refers-to"),
                        intact and own == stated,
                    )
                )
            if rows:
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in WARC_SCHEMA.split(", ")])
                yield frame.assign(page_id=pd.array([r[0] for r in rows], "Int64"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Index of a folder of WARC files; ``intact`` says that both digests agree with the bytes."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_warc_rows, WARC_SCHEMA)


def archive(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Write pages as ARC, convert to WARC, and read that back.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    record_id, intact), one row per page. A null html is an empty payload. A
    page without page_id is a response of its own. Rows that repeat a page_id
    are records of their own; if their payloads are equal both have the same
    type. White space in a url is percent-encoded and an empty or null url
    becomes about:blank. Other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, least)
    index = materialize(read_warc(spark, warc), "warc-index")
    wanted = index.select("refers_id").where("refers_id is not null").distinct()
    target = index.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    target = materialize(target.join(wanted, "refers_id", "left_semi").dropDuplicates(["refers_id"]), "targets")
    return index.join(target, "refers_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "intact"
    )
