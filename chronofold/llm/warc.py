"""WARC archives of pages: written in segments, read back by reassembly.

A page is a response record: an HTTP head that says ``Transfer-Encoding: chunked`` and its payload in chunks.
A block longer than ``SEGMENT_BYTES`` is cut anywhere behind the head's record: the first segment is the
response, the others are continuations that name the origin record and their segment number, and the last
one states the total length. Of equal payloads of ``REVISIT_BYTES`` or more, the one of the largest page_id is the response,
and the others are revisit records that refer to it by record and payload digest and hold the HTTP head only.

Each record is a gzip member of its own. A task writes runs of members of about a megabyte, each begun by a
warcinfo record, and Spark writes at most ``FILE_RUNS`` of them to a file (with a zero byte after each, which
gzip allows as padding), so archives lie wherever Spark can write and none is larger than a task can read.

Reading: a file's members are parsed one by one; unsegmented records are decoded at once, and only segments are shuffled,
to their origin. There they come in order of number and are streamed through the chunk decoder, so a page of any
length takes the memory of a few segments. A gap, a repeated or missing segment, a total length, a block or payload
digest that differs, or a broken chunk is an error. Revisits take sizes from the record that they refer to.

A null html is an empty payload. Rows without a page_id are records without one; such a row is kept as the response only if
no row of that payload has a page_id. Of repeated rows one is the response and the others revisit it. An empty
table gives no records. Null urls are left out, and white space in urls is escaped. Other columns are left aside.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import storage, tokens

#: Payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: Bytes of gzip members in one run, and runs in one file.
RUN_BYTES, FILE_RUNS = 1 << 20, 48
#: When the pages were captured; their table doesn't say.
DATE = "1970-01-01T00:00:00Z"
#: Tables up to this size in memory are broadcast.
BROADCAST_BYTES = 64 << 20
#: A key with more rows than the larger of these (a number, a share of all rows) is dealt to copies.
HOT_ROWS, HOT_SHARE = 10_000, 1e-4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_SPACE = {c: f"%{c:02X}" for c in (*range(33), 127)}


def record_id(row: int, segment: int = 1) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'page-record:{row}:{segment}').urn}>"


def member(kind: str, own_id: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Length", len(block))]
    text = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in head if value is not None) + "\r\n"
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(text.encode() + block + b"\r\n\r\n") + gz.flush()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (min(size, len(payload) - at), payload[at : at + size]) for at in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def page_members(row: int, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int) -> Iterator[bytes]:
    """The records of a page."""
    who = [("WARC-Target-URI", url.translate(_SPACE) if url else None), ("X-Page-ID", page_id)]
    stated = ("WARC-Payload-Digest", f"sha1:{digest}")
    http = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        yield member("revisit", record_id(row), [*who, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), stated, http], _HEAD)
        return
    block = _HEAD + chunked(payload)
    if len(block) <= segment:
        yield member("response", record_id(row), [*who, stated, http], block)
        return
    yield member("response", record_id(row), [*who, stated, ("WARC-Segment-Number", 1), http], block[:segment])
    count = -(-len(block) // segment)
    for k in range(2, count + 1):
        total = ("WARC-Segment-Total-Length", len(block) if k == count else None)
        yield member("continuation", record_id(row, k), [*who[:1], ("WARC-Segment-Origin-ID", record_id(row)), ("WARC-Segment-Number", k), total], block[(k - 1) * segment : k * segment])


class Body:
    """Decodes an HTTP response fed in pieces; hands out the payload and knows when it has ended."""

    def __init__(self) -> None:
        self.buffer, self.state, self.left, self.framed = bytearray(), "head", 0, False

    def _line(self) -> bytes | None:
        at = self.buffer.find(b"\r\n")
        if at < 0:
            return None
        line = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return line

    def feed(self, piece: bytes) -> bytes:
        self.buffer += piece
        out = []
        while True:
            if self.state == "data":
                taken = self.buffer[: self.left] if self.framed else self.buffer[:]
                out.append(bytes(taken))
                del self.buffer[: len(taken)]
                self.left -= len(taken)
                if not self.framed or self.left:
                    break
                self.state = "after"
            if self.state == "after":
                if len(self.buffer) < 2:
                    break
                if self.buffer[:2] != b"\r\n":
                    raise ValueError("a chunk is longer than its size says")
                del self.buffer[:2]
                self.state = "size"
            if self.state == "ended":
                if self.buffer:
                    raise ValueError("bytes behind the last chunk")
                break
            line = self._line()
            if line is None:
                break
            if self.state == "head":
                name, _, value = line.partition(b":")
                self.framed |= name.strip().lower() == b"transfer-encoding" and value.strip().lower() == b"chunked"
                if not line:
                    self.state = "size" if self.framed else "data"
            elif self.state == "size":
                size = line.split(b";")[0].strip()
                if not size or size.strip(b"0123456789abcdefABCDEF"):
                    raise ValueError(f"not a chunk size: {line[:40]!r}")
                self.left = int(size, 16)
                self.state = "data" if self.left else "trailer"
            elif not line:  # a trailer's end
                self.state = "ended"
        return b"".join(out)

    def close(self) -> None:
        if self.state != ("ended" if self.framed else "data"):
            raise ValueError("the body ends early")


def members(archive: bytes, window: int = 1 << 16) -> Iterator[bytes]:
    """The records of a gzip file, each unpacked; zero bytes between members are padding."""
    view, at = memoryview(archive), 0
    while at < len(view):
        if view[at] == 0:
            at += 1
            continue
        gz, out = zlib.decompressobj(31), []
        while not gz.eof:
            if at >= len(view):
                raise ValueError("a gzip member ends early")
            piece = view[at : at + window]
            out.append(gz.decompress(piece))
            at += len(piece) - len(gz.unused_data)
        yield b"".join(out)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (in lower case) and block of a record, its length and digest checked."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a record: {record[:40]!r}")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    block = rest[:-4]
    if len(block) != int(fields["content-length"]) or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"{fields.get('warc-record-id')}: the block's length differs from what is stated")
    stated = fields.get("warc-block-digest")
    if stated and stated != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
        raise ValueError(f"{fields.get('warc-record-id')}: the block's digest differs from what is stated")
    return fields, block


def spread_join(rows: DataFrame, table: DataFrame, path: str, key: str, by: str) -> DataFrame:
    """Each row beside the row of ``table`` (a written table of key, copies and more) that has its ``key``; others get nulls.

    A small table is broadcast. Otherwise hot keys (``copies`` above 1, few by their definition) have copies, which their rows
    are dealt to by a hash of ``by``.
    """
    if storage.fits(table, path, BROADCAST_BYTES):
        return rows.join(F.broadcast(table.drop("copies")), key, "left")
    hot = F.broadcast(table.where("copies > 1").select(key, F.col("copies").alias("_n")))
    dealt = rows.join(hot, key, "left").withColumn("_copy", F.pmod(F.xxhash64(by), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    copies = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return dealt.join(copies, [key, "_copy"], "left").drop("_copy")


def _copies(count: str, total: int) -> F.Column:
    """Copies that a key with ``count`` rows of ``total`` gets: at most 1 / HOT_SHARE keys get more than one."""
    return F.ceil(F.col(count) / F.lit(float(max(HOT_ROWS, int(total * HOT_SHARE))))).cast("int").alias("copies")


def write(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Archive files of all pages below ``path``."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.octet_length("payload").alias("n"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("same")).withColumn("row", F.monotonically_increasing_id())
    staged, staged_path = storage.materialise(rows, "warc-pages")
    long = staged.where(F.col("n") >= REVISIT_BYTES)
    kept = long.groupBy("same").agg(F.max(F.struct("page_id", "row")).alias("kept"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    groups, groups_path = storage.materialise(kept.select("same", F.col("kept.row").alias("kept"), _copies("rows", staged.count())), "warc-groups")
    placed = spread_join(staged, groups, groups_path, "same", "row").select("row", "page_id", "url", "payload", "digest", F.when(F.col("kept") != F.col("row"), F.col("kept")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = member("warcinfo", f"<{uuid.uuid5(uuid.NAMESPACE_OID, 'warcinfo').urn}>", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([info + b"".join(held)], pa.binary())], ["run"])

        for batch in batches:
            for part in tokens.slices(batch, "payload"):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for m in page_members(*row, segment):
                        held.append(m)
                        size += len(m)
                        if size >= RUN_BYTES:
                            yield out()
                            held, size = [], 0
        if held:
            yield out()

    # A binary column goes out byte by byte as a line of text; the line's end is the padding.
    placed.mapInArrow(run, "run binary").select(F.col("run").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RUNS).text(path)
    for p in (staged_path, groups_path):
        storage.remove(spark, p)


_PARSED = pa.schema(
    [("type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]
    + [("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()), ("payload", pa.binary())]
)
_PARSED_SQL = ", ".join(f"{f.name} {({pa.string(): 'string', pa.int64(): 'long'}).get(f.type, 'binary')}" for f in _PARSED)
_DONE = ["type", "record_id", "page_id", "url", "refers_to", "payload_digest", "payload_bytes", "payload"]
_DONE_SQL = "type string, record_id string, page_id long, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def _checked(record: str, digest: str, stated: str | None) -> str:
    if stated is not None and digest != stated:
        raise ValueError(f"{record}: the payload's digest differs from what is stated")
    return digest


def _parsed(fields: dict[str, str], block: bytes, payloads: bool) -> tuple | None:
    kind, own = fields["warc-type"], fields["warc-record-id"]
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    head = (kind, own, _number(fields.get("x-page-id")), fields.get("warc-target-uri"), fields.get("warc-refers-to"))
    if kind == "revisit":
        return (*head, stated, None, None, None, None, None, None)
    if kind == "continuation" or "warc-segment-number" in fields:
        return (*head, stated, None, fields.get("warc-segment-origin-id", own), int(fields["warc-segment-number"]), _number(fields.get("warc-segment-total-length")), block, None)
    if kind != "response":
        return None
    body = Body()
    payload = body.feed(block)
    body.close()
    return (*head, _checked(own, hashlib.sha1(payload).hexdigest(), stated), len(payload), None, None, None, None, payload if payloads else None)


class Assembly:
    """A segmented record that comes piece by piece, in order."""

    def __init__(self, row: dict, payloads: bool) -> None:
        if row["segment"] != 1:
            raise ValueError(f"{row['origin']}: the first segment is missing")
        self.row, self.body, self.digest, self.parts = row, Body(), hashlib.sha1(), [] if payloads else None
        self.segment, self.length, self.size, self.total = 0, 0, 0, None

    def add(self, row: dict) -> None:
        self.segment += 1
        if row["segment"] != self.segment or self.total is not None:
            raise ValueError(f"{row['origin']}: segment {row['segment']} where {self.segment} should come, or behind the last one")
        self.total = row["total"]
        self.length += len(row["block"])
        piece = self.body.feed(row["block"])
        self.size += len(piece)
        self.digest.update(piece)
        if self.parts is not None:
            self.parts.append(piece)

    def done(self) -> tuple:
        r = self.row
        if self.total != self.length:
            raise ValueError(f"{r['origin']}: segments have {self.length} bytes of {self.total}")
        self.body.close()
        digest = _checked(r["origin"], self.digest.hexdigest(), r["payload_digest"])
        return r["type"], r["record_id"], r["page_id"], r["url"], r["refers_to"], digest, self.size, None if self.parts is None else b"".join(self.parts)


def _assembled(segments: DataFrame, payloads: bool) -> DataFrame:
    """Records out of their segments, which are streamed in order within each origin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [_PARSED.field(name).type for name in _DONE]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _DONE)

        now, rows = None, []
        for batch in batches:
            for part in tokens.slices(batch, "block"):
                for row in part.to_pylist():
                    if now is None or now.row["origin"] != row["origin"]:
                        if now:
                            rows.append(now.done())
                        now = Assembly(row, payloads)
                    now.add(row)
                if rows:
                    yield out(rows)
                    rows = []
        if now:
            yield out([now.done()])

    ordered = segments.repartition("origin").sortWithinPartitions("origin", "segment")
    return ordered.select("type", "record_id", "page_id", "url", "refers_to", "payload_digest", "origin", "segment", "total", "block").mapInArrow(run, _DONE_SQL)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every response and revisit of the archives below ``path``: type, record_id, page_id, url, refers_to (a record), payload_digest,
    payload_bytes, and with ``payloads`` the payload (null for revisits, as are their bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARSED, strict=True)], schema=_PARSED)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for record in members(content.as_buffer()):
                    found = _parsed(*parse(record), payloads)
                    if found:
                        rows.append(found)
                        size += len(record)
                    if size >= 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    parsed, _ = storage.materialise(files.mapInArrow(run, _PARSED_SQL), "warc-records")
    whole = parsed.where("segment IS NULL").select(*_DONE)
    return whole.union(_assembled(parsed.where("segment IS NOT NULL"), payloads))


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page_id) of each record; revisits are held against what they refer to."""
    records, _ = storage.materialise(records.drop("payload"), "warc-resolved")
    revisits, responses = records.where("type = 'revisit'"), records.where("type = 'response'")
    targets = revisits.groupBy(F.col("refers_to").alias("target")).agg(F.count(F.lit(1)).alias("rows"))
    joined = targets.join(responses, F.col("target") == F.col("record_id"))
    table = joined.select("target", F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest"), _copies("rows", records.count()))
    table, path = storage.materialise(table, "warc-targets")
    beside = spread_join(revisits.withColumnRenamed("refers_to", "target"), table, path, "target", "record_id")
    wrong = F.raise_error(F.concat(F.col("record_id"), F.lit(": what it refers to is missing or differs"))).cast("string")
    digest = F.when(F.col("payload_digest") == F.col("to_digest"), F.col("to_digest")).otherwise(wrong)
    again = beside.select("page_id", F.col("to_bytes").alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), F.col("to_page").alias("refers_to"))
    return responses.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all pages, written to archives and read back."""
    path = storage.new_path(spark, "warc-archives")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolved(read(spark, path))


SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), kept AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS last FROM payloads
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM kept
"""
