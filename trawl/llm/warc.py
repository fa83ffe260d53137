"""WARC archives: written and read with Spark, and captures assembled from their records.

Each page becomes three records: a request, a response (or a revisit, which has no payload) and metadata.  Tasks pack
whole records into archives of about ``archive_bytes``; Spark's text writer stores them, one file each, with the two
line ends that close a record as its separator, compressed as whole files.  Reading takes any WARC 1.x file that fits
a task (plain, or gzip in one or many members): files are read by Spark and cut into records by their lengths.

``assemble`` joins request and metadata records to the response or revisit record that they are concurrent to, in
whichever of the records the link stands, metadata also by way of the request, and emits one nested row per capture.

Results for odd input: a null html is an empty payload; a null url is an empty target.  Equal payloads are found by
SHA-256, so records whose SHA-1 collide stay apart.  Of equal payloads of ``least`` bytes or more the smallest page_id is the response (null
ids come last); rows that agree in page_id and payload are the same capture repeated and get equal results.  A record with a
broken head ends its file's reading as ``damaged``; nothing else is lost.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, arrow_map

LINE, CLOSE = b"\r\n", b"\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # pages carry no time of capture
ARCHIVE_BYTES, PIECE = 1 << 26, 1 << 20
CAPTURES = ("response", "revisit")
RECORDS = "file string, record_id string, type string, concurrent_to string, refers_to string, uri string, date string, digest string, length long, intact boolean, head string, body binary"


# ---- writing


def urn(kind: str, *parts: object) -> str:
    """A record's identifier: the same for the same capture, whichever task or attempt writes it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr((kind, *parts)).encode('utf-8', 'surrogatepass')).digest()[:16], version=4)}>"


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + CLOSE + block


def one_line(text: str) -> str:
    """A header's value: line ends and blanks at its ends as percent codes."""
    out = "".join(f"%{ord(c):02X}" if c in "\r\n\0" else c for c in text)
    return "%20" * (len(out) - len(out.lstrip(" "))) + out.strip(" ") + "%20" * (len(out) - len(out.rstrip(" "))) if out.strip(" ") else "%20" * len(out)


def transaction(page: int | None, url: str, payload: bytes, whole: str, first: tuple[int, str] | None) -> list[bytes]:
    """The records of one page; ``first``: (page, url) of the response that it revisits."""
    of = (page, url, whole)
    uri, response = one_line(url), urn("response", *of)
    host = one_line(url.partition("://")[2].partition("/")[0])
    to = {"WARC-Target-URI": uri, "WARC-Date": DATE}
    request = {"WARC-Record-ID": urn("request", *of), **to, "WARC-Concurrent-To": response, "Content-Type": "application/http; msgtype=request"}
    line = f"GET {uri or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode("utf-8", "surrogatepass")
    got = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    reply = {"WARC-Record-ID": response, **to, "WARC-Payload-Digest": f"sha1:{sha1(payload)}", "Content-Type": "application/http; msgtype=response"}
    if first is not None:
        reply |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": urn("response", *first, whole), "WARC-Refers-To-Target-URI": one_line(first[1]), "WARC-Refers-To-Date": DATE}
    known = {"WARC-Record-ID": urn("metadata", *of), **to, "WARC-Concurrent-To": response, "Content-Type": "application/warc-fields"}
    fields = b"" if page is None else b"page-id: %d\r\n" % page
    return [record("request", request, line), record("response" if first is None else "revisit", reply, got if first is not None else got + payload), record("metadata", known, fields)]


def with_firsts(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, payload, whole (SHA-256) and, for revisits, first (page_id and url of the response)."""
    page = F.col("page_id").cast("long")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(page.alias("page_id"), url.alias("url"), payload.alias("payload")).withColumn("whole", F.sha2("payload", 256))
    place = F.struct(F.isnull("page_id").alias("last"), "page_id", "url")
    # only payloads that occur more than once: most pages find no partner here and their payload stays where it is read if that list is small
    narrow = rows.where(F.octet_length("payload") >= least).select("whole", "page_id", place.alias("place"))
    firsts = narrow.groupBy("whole").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("whole", "first")
    rows = rows.join(firsts, "whole", "left")
    again = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return rows.select("page_id", "url", "payload", "whole", F.when(again, F.col("first.page_id")).alias("first_id"), F.when(again, F.col("first.url")).alias("first_url"))


def archives(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``pages(page_id, url, html)`` → archive: the bytes of a WARC file each, without the last record's close."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, whole, first_id, first_url = (batch.column(c)[k].as_py() for c in range(6))
                for r in transaction(page, url, payload, whole, None if first_url is None else (first_id, first_url)):
                    held.append(r)
                    size += len(r)
                if size >= archive_bytes:
                    yield {"archive": [CLOSE.join(held)]}
                    held, size = [], 0
        if held:
            yield {"archive": [CLOSE.join(held)]}

    return arrow_map(with_firsts(pages, least), pack, "archive binary")


def write(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Stores ``pages`` as gzipped WARC files under ``path``; the writer keeps bytes as they are."""
    out = archives(pages, least, archive_bytes).select(F.col("archive").cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", 1).option("lineSep", CLOSE.decode()).option("compression", "gzip").text(path)


# ---- reading


class Source:
    """The bytes of a file, plain or of gzip members, a piece at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held = memoryview(data), 0, bytearray()
        self.zip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        """Adds a piece to ``held``; False at the file's end or at bytes that are no gzip."""
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + PIECE]
        self.at += len(part)
        if self.zip is None:
            self.held += part
            return True
        try:
            self.held += self.zip.decompress(part)
            while self.zip.eof:
                rest = self.zip.unused_data
                self.zip = zlib.decompressobj(31)
                if not rest:
                    break
                self.held += self.zip.decompress(rest)
        except zlib.error:
            self.at = len(self.data)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``, which is passed over; None where there is none."""
        begin = 0
        while (end := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        out = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return out

    def take(self, size: int) -> bytes | None:
        while len(self.held) < size:
            if not self.more():
                return None
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def fields_of(head: bytes) -> list[tuple[str, str]]:
    """Named fields in order, names in lower case; lines that begin with a blank go on with the one before."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def records_of(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes, bytes]]:
    """(fields, head, block) of each record of a file; a damaged rest comes as one record of type ``damaged``."""
    source = Source(data)
    while True:
        while source.held[:2] == LINE or (len(source.held) < 2 and source.more()):
            del source.held[: 2 if source.held[:2] == LINE else 0]
        if not source.held:
            return
        head = source.until(CLOSE)
        fields = fields_of(head.partition(LINE)[2]) if head and head.startswith(b"WARC/") else []
        size = dict(fields).get("content-length", "")
        block = source.take(int(size)) if size.isascii() and size.isdigit() else None
        if block is None:
            yield [("warc-type", "damaged")], head or b"", bytes(source.held)
            return
        yield fields, head or b"", block


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The payload of a block: what follows the HTTP head, or all of it."""
    return block.partition(CLOSE)[2] if fields.get("content-type", "").startswith("application/http") else block


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all files under ``path`` (``RECORDS``): ``length`` and ``intact`` (fits the stated digest) of the payload;
    body: the payload, null without ``payloads`` where it is a capture's.  Several concurrent-to links stand one after another, parted by blanks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = [part.strip().split(" ")[0] for part in RECORDS.split(",")]
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                file = batch.column("path")[k].as_py()
                for fields, head, block in records_of(batch.column("content")[k].as_py()):
                    f = dict(reversed(fields))
                    kind, body, stated = f.get("warc-type", ""), payload_of(f, block), f.get("warc-payload-digest", "")
                    links = " ".join(v for n, v in fields if n == "warc-concurrent-to") or None
                    intact = None if kind == "revisit" or not stated.startswith("sha1:") else stated == f"sha1:{sha1(body)}"
                    kept = body if payloads or kind not in ("response", "resource") else None
                    rows.append((file, f.get("warc-record-id"), kind, links, f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), stated.partition(":")[2] or None, len(body), intact, head.decode("utf-8", "replace"), kept))
                    size += 2000 + len(kept or b"")
                    if size > 1 << 24:
                        yield dict(zip(names, map(list, zip(*rows))))
                        rows, size = [], 0
        if rows:
            yield dict(zip(names, map(list, zip(*rows))))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return arrow_map(files, cut, RECORDS)


# ---- captures


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit record: capture_id, type, uri, date, digest, length, body, refers_to and, nested,
    request and metadata (record_id, head, body of the one with the smallest record_id; null where there is none), and
    how many of each are concurrent to it.  ``unattached`` has the records that no row holds.  ``records`` are read
    by several joins, so give a written table where there are many."""
    captures = records.where(F.col("type").isin(*CAPTURES))
    attached = attachments(records)
    of = lambda kind: F.min(F.when(F.col("type") == kind, F.struct("record_id", "head", "body"))).alias(kind)
    sides = attached.groupBy("capture_id").agg(of("request"), of("metadata"), F.count_if(F.col("type") == "request").alias("requests"), F.count_if(F.col("type") == "metadata").alias("metadatas"))
    rows = captures.select(F.col("record_id").alias("capture_id"), "type", "uri", "date", "digest", "length", "intact", "refers_to", "body").join(sides, "capture_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("requests", "metadatas")})


def links(records: DataFrame) -> DataFrame:
    """(a, b): record a says that it is concurrent to record b."""
    return records.where("concurrent_to IS NOT NULL AND record_id IS NOT NULL").select(F.col("record_id").alias("a"), F.explode(F.split("concurrent_to", " +")).alias("b"))


def attachments(records: DataFrame) -> DataFrame:
    """capture_id, and record_id, type, head, body of each request and metadata record that is concurrent to it, once."""
    others = records.where(F.col("type").isin("request", "metadata")).select("record_id", "type", "head", "body")
    captures = records.where(F.col("type").isin(*CAPTURES)).select(F.col("record_id").alias("capture_id")).distinct()
    said = links(records)
    both = said.unionByName(said.select(F.col("b").alias("a"), F.col("a").alias("b")))
    direct = both.join(captures.withColumnRenamed("capture_id", "b"), "b", "left_semi").select(F.col("a").alias("record_id"), F.col("b").alias("capture_id"))
    # metadata of a request belong to its captures
    requests = direct.join(others.where("type = 'request'").select("record_id"), "record_id", "left_semi").select(F.col("record_id").alias("b"), "capture_id")
    through = both.join(requests, "b").select(F.col("a").alias("record_id"), "capture_id")
    through = through.join(others.where("type = 'metadata'").select("record_id"), "record_id", "left_semi")
    pairs = direct.unionByName(through).distinct()
    return others.dropDuplicates(["record_id"]).join(pairs, "record_id")


def unattached(records: DataFrame) -> DataFrame:
    """Records that no capture holds: of other types, damaged, or concurrent to none."""
    held = attachments(records).select("record_id").distinct()
    return records.where(~F.col("type").isin(*CAPTURES)).join(held, "record_id", "left_anti")


def page_id(metadata: Column) -> Column:
    return F.regexp_extract(metadata["body"].cast("string"), r"(?:^|\n)page-id: (-?\d+)", 1).try_cast("long")


def capture_table(spark: SparkSession, path: str) -> DataFrame:
    """Captures with their page_id and, for revisits, the page and payload length of the response that they refer to."""
    store = Stored(spark)
    records = store.put(read(spark, path, payloads=False))  # read by several joins
    found = store.put(assemble(records).select("capture_id", "type", "uri", "digest", "length", "refers_to", page_id(F.col("metadata")).alias("page_id")))
    store.drop(records)
    first = found.where("type = 'response'").groupBy(F.col("capture_id").alias("refers_to")).agg(F.min("page_id").alias("first_id"), F.max("length").alias("first_length"))
    again = found.where("type = 'revisit'").join(first, "refers_to", "left")
    return found.where("type = 'response'").unionByName(again, allowMissingColumns=True)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` as archives, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    store = Stored(pages.sparkSession)
    path = f"{store.root}/warc"
    write(pages, path, least)
    rows = capture_table(pages.sparkSession, path)
    again = F.col("type") == "revisit"
    return rows.select("page_id", F.when(again, F.col("first_length")).otherwise(F.col("length")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))
