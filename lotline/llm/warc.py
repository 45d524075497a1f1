"""Legacy archives: ARC written, read and converted to WARC, and WARC read back.

ARC files of version 1 (five fields a record) and 2 (ten fields) are parsed by the field line that
their version block declares and by each record's declared length. WARC records get identifiers,
timestamps, types and digests derived from the ARC record, so a conversion can be repeated.

Archives are read as (path, content) rows, as Spark's binaryFile source gives them, and written,
gzipped, by Spark's text writer, one archive a row, so any store that Spark reaches will do. Archives
hold about ``ARCHIVE_BYTES``; a record is never split. Which records become revisits is decided on a
narrow index; payloads stay in their archives until the task that converts one reads it.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.llm.common import BROADCAST_ROWS, Scratch, join_small, small_batches

ARCHIVE_BYTES = 8 << 20
#: Smaller payloads are never revisits.
REVISIT_BYTES = 1000
#: A record of an ARC archive: ``n`` is its place there.
ENTRY = "path string, n int, page_id long, url string, date string, length long, sha1 string, record_id string"

# Field lines of the two ARC versions, WARC/1.0 names
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: What a version 2 line has between type and length: result code, checksum, location, offset, file name.
MORE = {1: "", 2: " 200 - - 0 -"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs


class _Archive:
    """Records gathered into one archive until it is large enough."""

    def __init__(self, start: bytes, sep: bytes):
        self.start, self.sep, self.parts, self.size = start, sep, [], 0

    def add(self, record: bytes) -> Iterator[pd.DataFrame]:
        self.parts.append(record)
        self.size += len(record)
        if self.size >= ARCHIVE_BYTES:
            yield from self.end()

    def end(self) -> Iterator[pd.DataFrame]:
        if self.parts:
            yield pd.DataFrame({"value": [self.start + self.sep.join(self.parts)]})
        self.parts, self.size = [], 0


def _field(value: object) -> str:
    """A header field: no blanks inside, ``-`` for nothing."""
    return re.sub(r"\s+", "%20", str(value)) if value not in (None, "") else "-"


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1,)) -> None:
    """Write ``pages`` (page_id, url, html) as ARC files into ``path``; where there are several
    ``versions``, a page's id decides which it gets.

    The body of a record is an HTTP response whose payload is the html in UTF-8 (null: empty).
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def start(version: int) -> bytes:
            block = f"{version} 0 archive\n{ARC_FIELDS[version]}\n"
            return f"filedesc://archive 0.0.0.0 20240101000000 text/plain{MORE[version]} {len(block)}\n{block}\n".encode()

        open_ = {v: _Archive(start(v), b"\n") for v in versions}
        for pdf in batches:
            for page, version, url, html in zip(pdf["page_id"], pdf["version"], pdf["url"], pdf["html"]):
                payload = (html or "").encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page or ''}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                head = f"{_field(url)} 0.0.0.0 20240101000000 text/html{MORE[version]} {len(http) + len(payload)}\n".encode()
                yield from open_[version].add(head + http + payload)
        for archive in open_.values():
            yield from archive.end()

    small_batches(pages.sparkSession)
    which = F.pmod(F.xxhash64("page_id"), F.lit(len(versions))).cast("int")
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.get(F.array(*[F.lit(v) for v in versions]), which).alias("version"), "url", "html")
    _write(rows.mapInPandas(make, "value binary"), path, "\n")


def _write(archives: DataFrame, path: str, end: str) -> None:
    rows = archives.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", end)
    rows.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def arc_records(data: bytes) -> Iterator[tuple[list[str], list[str], bytes]]:
    """(field names, fields, body) of each record, by version block and declared lengths.

    Urls with blanks keep them: fields are counted from the right. A record whose declared length
    passes the end of the archive is cut there; a line that is no header line is skipped.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, names = 0, ARC_FIELDS[1].split(" ")
    while at < len(data):
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        at = stop + 1
        parts = line.rsplit(" ", len(names) - 1)
        if line.startswith("filedesc:"):
            parts = line.split(" ")
        if len(parts) < 2 or not parts[-1].isdigit():
            continue
        body = data[at : at + int(parts[-1])]
        at += int(parts[-1])
        if line.startswith("filedesc:"):
            block = body.decode("utf-8", "replace").split("\n")
            version = block[0].split(" ")[0] if block else "1"
            declared = block[1].split(" ") if len(block) > 1 and block[1] else []
            names = declared or ARC_FIELDS[2 if version == "2" else 1].split(" ")
        elif len(parts) == len(names):
            yield names, parts, body


def _http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP headers with the blank line, and the payload; a body that is no response is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    m = re.search(rb"\r?\n\r?\n", body)
    return (body[: m.end()], body[m.end() :]) if m else (body, b"")


def _header(http: bytes, name: bytes) -> str:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", http)
    return m[1].decode("utf-8", "replace") if m else ""


def _identity(fields: dict[str, str], http: bytes, payload: bytes) -> tuple[int | None, str, str]:
    """page_id, SHA-1 of the payload and record id of an ARC record."""
    page = _header(http, b"X-Page-Id")
    sha1 = hashlib.sha1(payload).hexdigest()
    record = uuid.uuid5(SPACE, " ".join([fields["URL"], fields["Archive-date"], page, sha1]))
    return int(page) if page.lstrip("-").isdigit() else None, sha1, f"urn:uuid:{record}"


def arc_index(archives: DataFrame) -> DataFrame:
    """One narrow row per record of ARC ``archives`` (path, content): see ENTRY."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split(" ")[0] for c in ENTRY.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for n, (names, parts, body) in enumerate(arc_records(content)):
                    f, (http, payload) = dict(zip(names, parts)), _http(body)
                    page, sha1, record = _identity(f, http, payload)
                    rows.append((path, n, page, f["URL"], f["Archive-date"], len(payload), sha1, record))
                out = pd.DataFrame(rows, columns=cols)
                # a column of numbers and nulls would become floating point
                yield out.assign(page_id=pd.array([r[2] for r in rows], "Int64"))

    return archives.mapInPandas(parse, ENTRY)


def warc_date(arc: str) -> str:
    """ARC's fourteen digits as WARC's timestamp; missing digits are filled with the earliest."""
    d = (re.sub(r"\D", "", arc) + "00000101000000"[len(re.sub(r"\D", "", arc)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def revisits(index: DataFrame, at: Scratch, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Per record of ``index`` (an arc_index) that revisits another: path, n, and ``of``, the other's
    record_id, url and date.

    Of records with equal payloads of at least ``revisit_bytes``, those with the largest page_id are
    responses; others revisit the one of them whose record id is largest. A null page_id ranks below
    any other.
    """
    big = index.where(F.col("length") >= revisit_bytes)
    best = big.groupBy("sha1").agg(F.max(F.struct("page_id", "record_id", "url", "date")).alias("best"), F.count("*").alias("_n"))
    best = at.written(best.where("_n > 1").select("sha1", "best"), "best")
    found = join_small(big, best, ["sha1"], F.xxhash64("path", "n")).where(F.col("best").isNotNull() & ~F.col("best.page_id").eqNullSafe(F.col("page_id")))
    return found.select("path", "n", F.struct("best.record_id", "best.url", "best.date").alias("of"))


def convert(archives: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Convert ARC ``archives`` (path, content) to WARC files in ``path``; see revisits().

    The archives are read twice: for the index, and, each with the decisions for its own records, to
    be converted. Up to BROADCAST_ROWS decisions are broadcast; beyond that, archives are dealt by
    path, which no two share, as they are stored.
    """
    spark = archives.sparkSession
    with Scratch(spark, "conversion") as at:
        index = at.written(arc_index(archives), "index")
        decided = at.written(revisits(index, at, revisit_bytes), "revisits")
        # at most the records of one archive to a row
        each = decided.groupBy("path").agg(F.collect_list(F.struct("n", "of")).alias("decided"))
        each = F.broadcast(each) if decided.count() <= BROADCAST_ROWS else each
        _convert(archives.join(each, "path", "left").select("content", "decided"), path)


def _convert(archives: DataFrame, path: str) -> None:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        info = b"software: lotline\r\nformat: WARC File Format 1.0\r\n"
        start = _record({"WARC-Type": "warcinfo", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(SPACE, 'warcinfo')}>", "Content-Type": "application/warc-fields"}, info) + b"\r\n\r\n"
        out = _Archive(start, b"\r\n\r\n")
        for pdf in batches:
            for content, decided in zip(pdf["content"], pdf["decided"]):
                other = {d["n"]: d["of"] for d in decided} if decided is not None else {}
                for n, (names, parts, body) in enumerate(arc_records(content)):
                    yield from out.add(_converted(dict(zip(names, parts)), body, other.get(n)))
        yield from out.end()

    _write(archives.mapInPandas(make, "value binary"), path, "\r\n\r\n")


def _converted(fields: dict[str, str], body: bytes, of: dict | None) -> bytes:
    """The WARC record of an ARC record; ``of``: what it revisits."""
    http, payload = _http(body)
    _, sha1, record = _identity(fields, http, payload)
    head = {"WARC-Type": "response" if http else "resource", "WARC-Target-URI": fields["URL"], "WARC-Date": warc_date(fields["Archive-date"]), "WARC-Record-ID": f"<{record}>", "WARC-IP-Address": fields["IP-address"]}
    if of is not None:
        head |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{of['record_id']}>", "WARC-Refers-To-Target-URI": of["url"], "WARC-Refers-To-Date": warc_date(of["date"])}
    head |= {"WARC-Payload-Digest": f"sha1:{sha1}", "Content-Type": "application/http; msgtype=response" if http else fields["Content-type"]}
    return _record(head, http + (payload if of is None else b""))


def _record(head: dict[str, str], block: bytes) -> bytes:
    head = head | {"WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}", "Content-Length": str(len(block))}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head.get("content-length", 0))
        yield head, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size


WARC = "page_id long, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to_id string"


def warc_pages(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Response, resource and revisit records of WARC ``archives`` (path, content): see WARC, and
    ``payload`` unless ``payloads`` is false.

    Length and digest are those of the full payload; a revisit has them from its headers.
    """
    schema = WARC + (", payload binary" if payloads else "")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split(" ")[0] for c in schema.split(", ")]

        def table(rows: list) -> pd.DataFrame:
            # columns of numbers and nulls would become floating point
            whole = {c: pd.array([r[cols.index(c)] for r in rows], "Int64") for c in ("page_id", "payload_bytes")}
            return pd.DataFrame(rows, columns=cols).assign(**whole)

        for pdf in batches:
            for content in pdf["content"]:
                rows, size = [], 0
                for head, block in warc_records(content):
                    kind = head.get("warc-type", "")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    http, payload = _http(block)
                    page, length = _header(http, b"X-Page-Id"), _header(http, b"Content-Length")
                    page_id = int(page) if page.lstrip("-").isdigit() else None
                    if kind == "revisit":
                        n, digest = int(length) if length.isdigit() else None, head.get("warc-payload-digest", "").removeprefix("sha1:").lower()
                    else:
                        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    row = (page_id, head.get("warc-target-uri"), head.get("warc-date"), head["warc-record-id"].strip("<>"), kind, n, digest, head.get("warc-refers-to", "").strip("<>") or None)
                    rows.append((*row, payload if kind != "revisit" else None) if payloads else row)
                    size += len(block)
                    if payloads and size > ARCHIVE_BYTES // 4:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    return archives.mapInPandas(parse, schema)


def through_archives(pages: DataFrame, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ARC of all ``versions``, convert to WARC, read that back.

    Per row page_id, payload_bytes, payload_digest, record_type and refers_to, the page_id of the
    response for revisits. Null html is an empty payload, null urls become ``-``, a null page_id stays
    null and ranks below others; all rows that share the largest page_id of an equal payload are
    responses, so rows that differ in nothing are, too. Html of any length is one record. An empty
    table gives no archive and no row. Other columns are not read. The archives are deleted once their
    index is written.
    """
    spark = pages.sparkSession
    with Scratch(spark, "archives") as at:
        arc, warc = at.folder("arc"), at.folder("warc")
        write_arc(pages, arc, versions)
        convert(read_files(spark, arc), warc)
        back = at.written(warc_pages(read_files(spark, warc), payloads=False).drop("url", "date"), "index")
        referred = back.select(F.col("refers_to_id").alias("record_id")).where("record_id is not null").distinct()
        ids = back.where("record_type <> 'revisit'").join(referred, "record_id", "left_semi").groupBy("record_id").agg(F.max("page_id").alias("refers_to"))
        ids = at.written(ids.withColumnRenamed("record_id", "refers_to_id"), "responses")
        out = join_small(back.drop("record_id"), ids, ["refers_to_id"], F.xxhash64("page_id"))
        return at.result(out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
