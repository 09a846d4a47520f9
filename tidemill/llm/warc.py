"""WARC archives: writing with segmentation and revisits, and reading back.

A page becomes an HTTP response with chunked framing.  A response block over
``segment_bytes`` is cut into a first record and continuation records, which
name the first record's id as their origin and carry a segment number; the
last carries the total length.  The reader finds records by their stated
lengths, groups the continuation records by origin, orders them by segment
number, verifies the total length, and decodes the chunked framing.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_path, materialize, opened, shipped, small_batches, tidy

VERSION = b"WARC/1.1\r\n"
#: Files are split where this stands; what it really is, a record's start or part of a payload, the lengths tell.
MARK = b"WARC/1."
CHUNK_BYTES = 8192
SEGMENT_BYTES = 32768
#: Equal payloads below this size are all kept as responses.
REVISIT_BYTES = 100
#: A record's head is looked for in so many bytes.
HEAD_BYTES = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked framing; the mark never stays whole within a chunk."""
    out, start = [], 0
    while start < len(payload):
        stop = min(len(payload), start + size)
        hit = payload.find(MARK, start, stop + len(MARK) - 1)
        if hit >= 0:
            stop = hit + 4
        out += (b"%x\r\n" % (stop - start), payload[start:stop], b"\r\n")
        start = stop
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def unchunked(body: bytes) -> bytes | None:
    """The payload, or None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: bytes, rid: bytes, date: bytes, block: bytes, *fields: tuple[bytes, bytes]) -> bytes:
    head = [(b"WARC-Type", kind), (b"WARC-Record-ID", b"<%s>" % rid), (b"WARC-Date", date), *fields, (b"Content-Length", b"%d" % len(block))]
    # the writer ends each record with the last of the two closing line ends
    return VERSION + b"".join(b"%s: %s\r\n" % x for x in head) + b"\r\n" + block + b"\r\n"


def _clean(value: str | None) -> bytes:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A").encode().replace(MARK, b"WARC%2F1.")


def _write_batches(segment_bytes: int, date: bytes):
    http = (b"Content-Type", b"application/http; msgtype=response")

    def write(batches):
        for batch in batches:
            rows = batch.to_pydict()
            out = []
            for page, number, url, html, digest, first in zip(*(rows[c] for c in ("page_id", "number", "url", "html", "digest", "first")), strict=True):
                rid = b"urn:page:%s:%d" % (str(page).encode(), number)
                common = [(b"WARC-Target-URI", _clean(url)), (b"WARC-Payload-Digest", b"sha256:" + digest.encode())]
                if first is not None and first["page_id"] != page:
                    out.append(_record(b"revisit", rid, date, b"", *common, http, (b"WARC-Profile", REVISIT_PROFILE), (b"WARC-Refers-To", b"<urn:page:%d:%d>" % (first["page_id"], first["number"]))))
                    continue
                block = HTTP + chunked((html or "").encode())
                if len(block) <= segment_bytes:
                    out.append(_record(b"response", rid, date, block, *common, http))
                    continue
                cuts = list(range(0, len(block), segment_bytes))
                for k in range(1, len(cuts)):  # no cut within a mark
                    hit = block.find(MARK, cuts[k] - len(MARK) + 1, cuts[k] + len(MARK) - 1)
                    cuts[k] = hit + 4 if hit >= 0 else cuts[k]
                for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(block)], strict=True), 1):
                    more = [(b"WARC-Segment-Number", b"%d" % k)]
                    if k > 1:
                        more.append((b"WARC-Segment-Origin-ID", b"<%s>" % rid))
                    if b == len(block):
                        more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
                    out.append(_record(b"response" if k == 1 else b"continuation", rid if k == 1 else b"%s:%d" % (rid, k), date, block[a:b], *([*common, http] if k == 1 else []), *more))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return write


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, date: str | None = None) -> None:
    """Write one record, or one group of segments, for each row of ``pages`` (page_id, url, html).

    A null html is an empty payload, a null url an empty one.  Of records with
    equal payloads of REVISIT_BYTES or more, those of the smallest page_id are
    responses and the others revisits; rows without a page_id are always
    responses.  Rows repeated under one page_id are all written, each with a
    record id of its own.  Other columns aren't read; an empty table gives an
    archive without records.  ``date`` (now, by default) is that of all records.
    """
    small_batches(pages.sparkSession)
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("size"), F.monotonically_increasing_id().alias("number"))
    copies = rows.where((F.col("size") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "number")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = materialize(copies, "warc-copies")
    typed = rows.join(copies, "digest", "left").select("page_id", "number", "url", "html", "digest", F.when(F.col("page_id").isNotNull(), F.col("first")).alias("first"))
    records = typed.mapInArrow(tidy(_write_batches(segment_bytes, date.encode())), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").text(path)
    discard(copies)


PARSED = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("bad", pa.bool_()), ("block", pa.binary())])
PARSED_SQL = "record_id string, record_type string, refers_to string, payload_digest string, origin_id string, segment int, total long, bad boolean, block binary"


def _parsed(head: bytes, block: bytes, bad: bool) -> dict:
    fields: dict[bytes, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    plain = lambda k: fields[k].strip("<>") if k in fields else None
    number = lambda k: int(fields[k]) if fields.get(k, "").isdigit() else None
    return {
        "record_id": plain(b"warc-record-id"), "record_type": fields.get(b"warc-type"), "refers_to": plain(b"warc-refers-to"), "payload_digest": fields.get(b"warc-payload-digest"),
        "origin_id": plain(b"warc-segment-origin-id"), "segment": number(b"warc-segment-number"), "total": number(b"warc-segment-total-length"), "bad": bad, "block": block,
    }


class Walk:
    """Puts the pieces of a file, cut at each mark, together to records by their stated lengths."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size = 0
        self.need: int | None = None
        self.head_size = 0

    def add(self, piece: bytes) -> dict | None:
        """The record that the piece completes, if it does."""
        if not self.parts and piece[:3] not in (b"0\r\n", b"1\r\n"):
            return None  # before the first record, or after a broken one
        self.parts += [MARK, piece] if self.parts else [piece]
        self.size += len(piece) + (len(MARK) if len(self.parts) > 1 else 0)
        if self.need is None:
            seen = b"".join(self.parts)
            cut = seen.find(b"\r\n\r\n")
            if cut < 0:
                return self.end() if self.size > HEAD_BYTES else None
            self.head_size = cut
            stated = [x.partition(b":")[2].strip() for x in seen[:cut].split(b"\r\n") if x[:15].lower() == b"content-length:"]
            if not stated or not stated[0].isdigit():
                return self.end()
            self.need = cut + 4 + int(stated[0])
        return self.end() if self.size >= self.need else None

    def end(self) -> dict | None:
        """What is held as a record, complete or not."""
        if not self.parts:
            return None
        whole = b"".join(self.parts)
        out = _parsed(whole[: self.head_size], whole[self.head_size + 4 : self.need] if self.need else b"", self.need is None or self.size < self.need)
        self.__init__()
        return out


def _pieces(batches) -> Iterator[tuple[tuple, bytes]]:
    for batch in batches:
        for file, start, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "raw")), strict=True):
            yield (file, start), raw


def _open_files(batches):
    """Files of which a record goes on beyond the end of a split."""
    found, walk, last = set(), Walk(), None
    for split, raw in _pieces(batches):
        if last is not None and split != last and walk.end():
            found.add(last[0])
        last = split
        walk.add(raw)
    if last is not None and walk.end():
        found.add(last[0])
    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["file"])


def _parse_batches(shared):
    def parse(batches):
        apart = opened(shared)
        out, held, walk, last = [], 0, Walk(), None
        for split, raw in _pieces(batches):
            if split[0] in apart:
                continue
            records = [walk.end() if last is not None and split != last else None, walk.add(raw)]
            last = split
            for x in filter(None, records):
                out.append(x)
                held += len(x["block"])
            if held > 4 << 20 or len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, PARSED)
                out, held = [], 0
        if x := walk.end():
            out.append(x)
        yield pa.RecordBatch.from_pylist(out, PARSED)

    return parse


def _parse_file(table: pa.Table) -> pa.Table:
    table = table.sort_by([("start", "ascending"), ("number", "ascending")])
    walk = Walk()
    out = [x for raw in table["raw"].to_pylist() if (x := walk.add(raw))]
    if x := walk.end():
        out.append(x)
    return pa.Table.from_pylist(out, PARSED)


def _decode_batches(batches):
    for batch in batches:
        sizes, digests, payloads = [], [], []
        for blocks in batch.column("blocks").to_pylist():
            block = b"".join(blocks)
            payload = block
            if block.startswith(b"HTTP/"):
                head, _, body = block.partition(b"\r\n\r\n")
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            sizes.append(None if payload is None else len(payload))
            digests.append(None if payload is None else hashlib.sha256(payload).hexdigest())
            payloads.append(payload)
        kept = [batch.column(c) for c in ("record_id", "record_type", "refers_to", "payload_digest", "ok")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(payloads, pa.binary())], ["record_id", "record_type", "refers_to", "payload_digest", "ok", "decoded_bytes", "decoded_digest", "payload"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives of version 1.0 or 1.1, plain or gzip: one row for each but continuations.

    Columns: record_id, record_type, refers_to, payload_digest (as stated),
    ok, decoded_bytes, decoded_digest, payload.  The payload is the HTTP body,
    its chunked framing decoded, or the block of a record that is no HTTP
    message.  ``ok`` is false where segments are missing or repeated, the
    total length differs, or a record is cut short or states no length; where
    the framing can't be decoded, the last three are null.  Continuations
    without their first record give a row of type ``continuation``.  An
    archive without records gives no rows.

    Plain files are split at marks, so a large archive is read by many tasks;
    a mark within a payload is told by the record's length.  Only where such a
    record goes on beyond the end of a split is its file read by one task.
    The segments of one origin meet in one task.
    """
    small_batches(spark)

    def pieces(paths) -> DataFrame:
        lines = spark.read.option("lineSep", MARK.decode()).text(paths)
        return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("raw"))

    apart = [r.file for r in pieces(path).mapInArrow(tidy(_open_files), "file string").distinct().collect()]  # names of files, not records
    records = pieces(path).mapInArrow(tidy(_parse_batches(shipped(spark, set(apart)))), PARSED_SQL)
    if apart:
        again = pieces(apart).withColumn("number", F.monotonically_increasing_id())
        records = records.unionByName(again.groupBy("file").applyInArrow(_parse_file, PARSED_SQL))
    single = records.where("segment is null").select("record_id", "record_type", "refers_to", "payload_digest", (~F.col("bad")).alias("ok"), F.array("block").alias("blocks"))
    parts = records.where("segment is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    whole = parts.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"), F.max("bad").alias("bad"), F.sum(F.octet_length("block")).alias("size"), *map(first, ("record_type", "refers_to", "payload_digest")))
    complete = (F.transform("parts", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("parts"))) & (F.col("size") == F.col("total"))
    whole = whole.select(F.col("origin").alias("record_id"), F.coalesce("record_type", F.lit("continuation")).alias("record_type"), "refers_to", "payload_digest", F.coalesce(~F.col("bad") & complete, F.lit(False)).alias("ok"), F.transform("parts", lambda x: x["block"]).alias("blocks"))
    return single.unionByName(whole).mapInArrow(tidy(_decode_batches), "record_id string, record_type string, refers_to string, payload_digest string, ok boolean, decoded_bytes long, decoded_digest string, payload binary")


def warc_round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``pages``, read the archives, and describe each page's record.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to
    (a page_id), ok.  One row for each row of ``pages``, repeated ones and
    those without an id too; null and empty pages have 0 bytes.  A revisit
    takes the payload's size from the response that it names, and ``ok`` says
    that the stated and the decoded digests agree.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, segment_bytes)
    page = lambda c: F.try_element_at(F.split(c, ":"), F.lit(3)).try_cast("long")
    rows = materialize(read_warc(spark, path).select("record_id", "record_type", "refers_to", F.substring("payload_digest", 8, 64).alias("stated"), "ok", "decoded_bytes", "decoded_digest"), "warc-read")
    good = F.col("ok") & F.col("stated").eqNullSafe(F.col("decoded_digest"))
    kept = lambda df: df.select(page("record_id").alias("page_id"), F.col("decoded_bytes").alias("payload_bytes"), F.col("decoded_digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), good.alias("ok"))
    responses = rows.where("record_type = 'response'")
    revisits = rows.where("record_type = 'revisit'").select("record_id", "record_type", "refers_to", "stated")
    named = responses.select(F.col("record_id").alias("refers_to"), F.coalesce(good, F.lit(False)).alias("ok"), "decoded_bytes", "decoded_digest")
    named = materialize(named.join(revisits.select("refers_to").distinct(), "refers_to"), "warc-referred")  # one row for each response that is named
    return kept(responses).unionByName(kept(revisits.join(named, "refers_to", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))))
