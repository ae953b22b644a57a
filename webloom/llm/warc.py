"""WARC archives: written from pages, read back, and assembled into captures.

``write_archives`` turns each page into a request, a response (or revisit) and a metadata record with column functions and lets
Spark write them as gzip files of at most ``PAGES_PER_FILE`` pages.  Of equal payloads that with the largest page_id is the response;
the others become revisit records that keep the HTTP headers and refer to it.  Equality is decided on narrow
(page_id, digest) rows; the HTML moves once, to meet its decision.

``read_records`` gives one row per record of any archives (plain or gzip, one member or many); members are expanded piece by piece.
``captures`` joins the records of one transaction: request and metadata records name their response in WARC-Concurrent-To, directly or
through any number of records, or the response names them; one nested row per response, revisit or resource comes out.

Defined cases: null html is the empty payload; null urls are written without a target; a null page_id counts as smaller
than any other and is read back as null; rows equal in page_id and payload are all response when theirs is the largest
page_id; a record that leads to several responses stands in the capture of each; links in a circle end; records whose transaction has no
response are left out of ``captures``.  What cannot be read (a broken gzip member, a record that is cut short, no WARC header, no or a bad
length) ends the reading of its file with one row of type null whose ``error`` says why; a record of whole length whose block digest or
payload digest in the header differs from its bytes is kept with an ``error``.  Zero bytes behind a gzip member are padding.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import textops as X
from webloom.llm.tables import discard
from webloom.session import checkpointed, shared_folder

CRLF = "\r\n"
GZIP = b"\x1f\x8b"
PAGES_PER_FILE = 2000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ANCHORS = ("response", "revisit", "resource")
RECORD_SCHEMA = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date timestamp, http_headers string, payload binary, payload_bytes bigint, payload_digest string"
READ_SCHEMA = RECORD_SCHEMA + ", error string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digits = F.sha1(payload)
    out = []
    for k in range(8):
        value = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def record_id(kind: str, *parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    pieces = [F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def duplicates(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to): pages whose payload of at least ``min_bytes`` stands under a larger page_id too."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.octet_length(payload).alias("n_"), base32_sha1(payload).alias("digest")).where(F.col("n_") >= min_bytes).drop("n_")
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n_")).where("n_ > 1 AND refers_to IS NOT NULL").drop("n_")
    # a written table on one side: the join then splits a payload that a large share of the pages has
    found = rows.join(checkpointed(largest), "digest").where("page_id IS NULL OR page_id < refers_to")
    return found.select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes (page_id, url, html) rows as gzip archives below ``path``."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"))
    known = duplicates(pages, min_bytes).select(F.col("page_id").alias("p_"), F.col("digest").alias("d_"), "refers_to")
    rows = rows.join(known, F.col("page_id").eqNullSafe(F.col("p_")) & (F.col("digest") == F.col("d_")), "left")
    own = record_id("capture", F.col("page_id"), F.col("digest"))
    revisit = F.col("d_").isNotNull()
    uri = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " "), F.lit(CRLF))).otherwise("")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    path_part = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("/")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[\r\n ]+", "%20")
    request = F.concat(F.lit("GET "), path_part, F.lit(f" HTTP/1.1{CRLF * 2}"))
    described = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))

    def record(kind: Column, id_: Column, content: str, block: Column, *more: Column) -> Column:
        fixed = F.concat(F.lit(f"WARC/1.0{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), id_, F.lit(f"{CRLF}WARC-Date: {date}{CRLF}"))
        return F.concat(fixed, uri, *more, F.lit(f"Content-Type: {content}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)

    with_ = F.concat(F.lit("WARC-Concurrent-To: "), own, F.lit(CRLF))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF))
    profile = F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest{CRLF}WARC-Refers-To: ")
    refers = F.when(revisit, F.concat(profile, record_id("capture", F.col("refers_to"), F.col("digest")), F.lit(CRLF))).otherwise("")
    records = [
        record(F.lit("request"), record_id("request", F.col("page_id"), F.col("digest")), "application/http; msgtype=request", request, with_),
        record(F.when(revisit, "revisit").otherwise("response"), own, "application/http; msgtype=response", F.concat(head, F.when(revisit, "").otherwise(F.col("html"))), digest, refers),
        record(F.lit("metadata"), record_id("metadata", F.col("page_id"), F.col("digest")), "application/warc-fields", described, with_),
    ]
    text = F.concat_ws(CRLF * 2, *records)
    rows.select(text.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", PAGES_PER_FILE).text(path)


class Source:
    """The bytes of an archive, expanded as they are asked for."""

    def __init__(self, content: bytes, piece: int = 1 << 16):
        self.gzip = content.startswith(GZIP)
        self.content, self.piece, self.next = content, piece, 0  # next: the first byte not given to a member
        self.member = zlib.decompressobj(31)
        self.held = bytearray() if self.gzip else bytearray(content)
        self.at = 0

    def more(self) -> bool:
        """Expands a further piece; false at the end."""
        if not self.gzip:
            return False
        if self.at > self.piece:
            del self.held[: self.at]
            self.at = 0
        while True:
            if self.member.eof:
                if not self.content.startswith(GZIP, self.next):
                    if self.content.count(0, self.next) == len(self.content) - self.next:
                        return False
                    raise ValueError("no gzip member")
                self.member = zlib.decompressobj(31)
            given = self.member.unconsumed_tail
            if not given:
                given = self.content[self.next : self.next + self.piece]
                self.next += len(given)
            out = self.member.decompress(given, self.piece)
            if self.member.eof:
                self.next -= len(self.member.unused_data)
            elif not given and not out:
                raise ValueError("gzip member cut short")
            if out:
                self.held += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before the next mark, which is passed; null where none comes."""
        seen = self.at
        while (found := self.held.find(mark, seen)) < 0:
            behind = len(self.held) - self.at
            if not self.more():
                return None
            seen = max(self.at, self.at + behind - len(mark) + 1)
        out = bytes(self.held[self.at : found])
        self.at = found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self.more():
            pass
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out

    def blank_lines(self) -> bool:
        """Passes empty lines; false where nothing else comes."""
        while True:
            got = bytes(self.held[self.at : self.at + 2])
            if len(got) < 2 and self.more():
                continue
            if got != b"\r\n":
                return bool(got)
            self.at += 2


def _parsed(content: bytes):
    """(fields, block, error) of every record; fields maps a lower-case name to its values and is null where reading ends."""
    source = Source(content)
    try:
        while source.blank_lines():
            head = source.until(CRLF.encode() * 2)
            first, *lines = (head or b"").decode("utf-8", "replace").split(CRLF)
            if head is None or not first.startswith("WARC/"):
                raise ValueError("no WARC record header")
            fields: dict[str, list[str]] = {}
            for line in lines:
                name, _, value = line.partition(":")
                fields.setdefault(name.strip().lower(), []).append(value.strip())
            size = fields.get("content-length", [""])[0]
            if not (size.isascii() and size.isdigit()):
                raise ValueError("no valid Content-Length")
            if "warc-type" not in fields or "warc-record-id" not in fields:
                raise ValueError("no WARC-Type or WARC-Record-ID")
            block = source.take(int(size))
            if len(block) < int(size):
                raise ValueError(f"record cut short: {len(block)} of {size} bytes")
            yield fields, block, None
    except (ValueError, zlib.error) as broken:
        yield None, b"", str(broken)


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _differs(fields: dict, name: str, digest: str) -> str | None:
    """What is wrong with the SHA-1 that a header names, if it names one."""
    kind, _, value = fields.get(name, [""])[0].partition(":")
    wrong = kind.lower() == "sha1" and len(value) == 32 and value.upper() != digest
    return f"{name} differs" if wrong else None


def _date(text: str | None) -> datetime | None:
    try:
        found = datetime.fromisoformat(text or "")
        return (found if found.tzinfo else found.replace(tzinfo=UTC)).astimezone(UTC)
    except (ValueError, OverflowError):
        return None


def _read(batches, with_payload: bool):
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for k in range(batch.num_rows):
            rows, held = [], 0
            for fields, block, error in _parsed(batch.column("content")[k].as_py()):
                if fields is None:
                    rows.append((None, None, [], None, None, None, None, None, None, None, error))
                    continue
                if "warc-block-digest" in fields:
                    error = _differs(fields, "warc-block-digest", _digest(block))
                kind = fields["warc-type"][0]
                headers, payload = None, block
                if fields.get("content-type", [""])[0].startswith("application/http"):
                    cut = block.find(b"\r\n\r\n")
                    headers, payload = block[:cut].decode("utf-8", "replace"), block[cut + 4 :]
                if kind == "revisit":  # the payload stands in the record it refers to
                    length = next((h.partition(":")[2] for h in (headers or "").split(CRLF) if h.lower().startswith("content-length:")), None)
                    digest = fields.get("warc-payload-digest", [""])[0].rpartition(":")[2] or None
                    length = (length or "").strip()
                    payload, n = None, int(length) if length.isascii() and length.isdigit() else None
                else:
                    digest, n = _digest(payload), len(payload)
                    error = error or _differs(fields, "warc-payload-digest", digest)
                date = _date(fields.get("warc-date", [None])[0])
                if date is None and "warc-date" in fields:
                    error = error or "no valid WARC-Date"
                rows.append((fields["warc-record-id"][0], kind, fields.get("warc-concurrent-to", []), fields.get("warc-refers-to", [None])[0], fields.get("warc-target-uri", [None])[0], date, headers, payload if with_payload or kind == "metadata" else None, n, digest, error))
                held += len(block)
                if held > X.BLOCK:
                    yield _batch(rows, names, kinds)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, names, kinds)


def _batch(rows, names, kinds):
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record below ``path``, broken ones with an ``error``; without ``payload`` only metadata blocks are kept, sizes and digests always."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda batches: _read(batches, payload), READ_SCHEMA)


def _leads(records: DataFrame) -> DataFrame:
    """(id, up): the records that WARC-Concurrent-To leads to from every other record, over any number of steps, not past an anchor; each step moves what the last one found."""
    # narrow rows first: archives are read once for all of this
    sent = checkpointed(records.where("record_id IS NOT NULL").select("record_id", F.col("type").isin(*ANCHORS).alias("is_anchor"), "concurrent_to"))
    # an anchor's link is turned around, unless it names another anchor
    anchors = sent.where("is_anchor").select(F.col("record_id").alias("other"))
    sent = sent.select("record_id", "is_anchor", F.explode("concurrent_to").alias("other")).where("other <> record_id")
    turned = sent.where("is_anchor").join(anchors, "other", "left_anti").select(F.col("other").alias("id"), F.col("record_id").alias("up"))
    links = checkpointed(sent.where("NOT is_anchor").select(F.col("record_id").alias("id"), F.col("other").alias("up")).unionByName(turned).distinct())
    above = links.select(F.col("id").alias("up"), F.col("up").alias("far"))
    seen = new = links
    while True:
        step = new.join(above, "up").select("id", F.col("far").alias("up")).where("id <> up").distinct()
        new = checkpointed(step.join(seen, ["id", "up"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = checkpointed(seen.unionByName(new))


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, requests, metadata).

    A record belongs to every anchor (response, revisit, resource) that WARC-Concurrent-To leads to, over any number of records.
    """
    anchor = F.col("type").isin(*ANCHORS)
    links = _leads(records)
    whole = F.struct(*[c for c in records.columns if c not in ("concurrent_to",)])
    rest = records.where(~anchor).join(links.withColumnRenamed("id", "record_id"), "record_id").select(F.col("up").alias("capture_id"), "type", whole.alias("r"))
    rows = rest.unionByName(records.where(anchor).select(F.col("record_id").alias("capture_id"), "type", whole.alias("r")))

    def of(*kinds: str) -> Column:
        return F.collect_list(F.when(F.col("type").isin(*kinds), F.col("r")))

    grouped = rows.groupBy("capture_id").agg(of(*ANCHORS).alias("anchors"), of("request").alias("requests"), of("metadata").alias("metadata"))
    return grouped.select("capture_id", F.explode("anchors").alias("response"), "requests", "metadata")


def page_captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, n_records: written to the shared folder, read back and assembled."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    page = F.regexp_extract(F.col("metadata")[0]["payload"].cast("string"), r"page-id: (-?\d+)", 1)
    found = captures(read_records(spark, path, payload=False)).select(
        "capture_id",
        F.when(page != "", page.cast(pages.schema["page_id"].dataType)).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers_id"),
        (1 + F.size("requests") + F.size("metadata")).cast("long").alias("n_records"),
    )
    found = checkpointed(found)
    discard(spark.read.format("binaryFile").load(path))
    # revisits are many per response, responses are one row per id
    responses = found.where("record_type = 'response'").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    wanted = checkpointed(responses.groupBy("refers_id").agg(F.min("refers_to").alias("refers_to")))
    revisits = found.where("record_type = 'revisit'").join(wanted, "refers_id", "left")
    rest = found.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_records"]
    return rest.select(*columns).unionByName(revisits.select(*columns))
