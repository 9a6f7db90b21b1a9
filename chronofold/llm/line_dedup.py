"""Line dedup: which lines of each document stay, as compressed bitmaps.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Only keys of
at least ``min_length`` code points can go. Each becomes a 128-bit hash with its document and position;
the rows are range-partitioned by (hash, document, text hash, position) and sorted so within each partition,
so that one frequent line spreads over as many partitions as its rows need, null doc_ids included. Each partition is streamed:
a run of one hash that lies wholly inside is settled on the spot, from the first occurrence in each
document; runs at a partition's two ends (two hashes a partition, whatever the data) are carried on
as rows and settled by a join with their totals. Each document's answer is a zlib-packed bitmap of the
lines that stay (bit k: line k); lines beyond its bits stay, and so does every line of a document without one.

A row is known by its doc_id and a hash of its text, so repeated rows share one bitmap, and rows with
one doc_id but different texts don't mix. Null and empty texts are one empty line. A null doc_id is
the smallest. Equal hashes of different keys (chance below 1e-20 at 1e9 keys) would be taken as equal.
An empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import storage, tokens

MIN_LENGTH = 40
MIN_DOCS = 5
#: Bitmaps up to this size in memory are sent to every executor; beyond, documents meet them by a shuffle.
BROADCAST_BYTES = 64 << 20
PARTITION_ROWS = 250_000
#: A column that no table is likely to have.
KEEP = "_line_dedup_keep"
_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ROWS = "hi long, lo long, doc_id long, th long, pos int"


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))


def keyed_lines(docs: DataFrame, min_length: int) -> DataFrame:
    """hash (hi, lo), doc_id, text hash and position of every line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                digests, row, pos = [], [], []
                for k, text in enumerate(part.column("text").cast(pa.large_binary()).to_pylist()):
                    for p, line in enumerate(text.split(b"\n")):
                        if len(line) >= min_length:
                            key = line.strip(_SPACE)
                            if len(key) >= min_length and (key.isascii() or len(key.decode()) >= min_length):
                                digests.append(xxhash.xxh3_128_digest(key.translate(_LOWER)))
                                row.append(k)
                                pos.append(p)
                pairs = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                at = pa.array(row, pa.int64())
                columns = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), part.column("doc_id").take(at), part.column("th").take(at), pa.array(pos, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["hi", "lo", "doc_id", "th", "pos"])

    return docs.mapInArrow(run, _ROWS)


def _settle(part: pd.DataFrame, min_docs: int) -> pd.DataFrame:
    """One sorted partition: the lines that go (open false), and all rows of its first and last hash (open true)."""
    hi, lo, doc = (part[c].to_numpy() for c in ("hi", "lo", "doc_id"))
    change = np.ones(len(part), bool)
    change[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    run = np.cumsum(change) - 1
    fresh = change.copy()
    fresh[1:] |= doc[1:] != doc[:-1]  # first occurrence in its document
    largest = doc[np.flatnonzero(np.append(change[1:], True))]  # rows are sorted by doc_id within a run
    is_open = (run == 0) | (run == run[-1])
    goes = (np.bincount(run, weights=fresh)[run] >= min_docs) & (doc != largest[run])
    return part[is_open | goes].assign(open=is_open[is_open | goes])


def keep_bits(gone: np.ndarray) -> bytes:
    """The bitmap of what stays, packed, when the lines at these positions go."""
    stays = np.ones((int(max(gone)) // 8 + 1) * 8, bool)
    stays[gone] = False
    return zlib.compress(np.packbits(stays, bitorder="little").tobytes())


def keep_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, partition_rows: int = PARTITION_ROWS) -> tuple[DataFrame, str]:
    """doc_id, th (hash of the text), n_dropped and ``keep``: a zlib-packed bitmap whose set bits are the lines that stay.

    Only documents that lose lines have a row. Returned with the path of the table that holds it.
    """
    lines, lines_path = storage.materialise(keyed_lines(_documents(docs), min_length), "line-keys")
    parts = max(1, -(-lines.count() // partition_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ``partition_rows`` bounds what is held here, however often a line occurs.
        table = pa.Table.from_batches(list(batches))
        if table.num_rows:
            rows = _settle(table.to_pandas(), min_docs)
            yield pa.RecordBatch.from_pandas(rows, schema=pa.schema([*table.schema, ("open", pa.bool_())]), preserve_index=False)

    # A null doc_id becomes the smallest long, which sorts first as null would.
    filled = lines.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    keys = ["hi", "lo", "doc_id", "th", "pos"]
    ordered = filled.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    settled, settled_path = storage.materialise(ordered.mapInArrow(run, f"{_ROWS}, open boolean"), "line-runs")
    pending = settled.where("open")
    totals = pending.groupBy("hi", "lo", "doc_id").agg(F.count(F.lit(1))).groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("largest"))
    # At most two hashes a partition are open, so this side has at most 2 * parts rows of 32 bytes.
    totals = totals.where(F.col("n") >= min_docs)
    totals = F.broadcast(totals) if parts <= 1 << 18 else totals
    late = pending.join(totals, ["hi", "lo"]).where("doc_id <> largest")
    gone = settled.where("not open").select("doc_id", "th", "pos").unionByName(late.select("doc_id", "th", "pos"))

    @F.pandas_udf("binary")
    def pack(column: pd.Series) -> pd.Series:
        return column.map(keep_bits)

    grouped = gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("p"))
    bitmaps = grouped.select(F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"), "th", F.size("p").cast("long").alias("n_dropped"), pack("p").alias("keep"))
    out, path = storage.materialise(bitmaps, "line-bitmaps", codec="none")
    storage.remove(docs.sparkSession, lines_path)
    storage.remove(docs.sparkSession, settled_path)
    return out, path


def kept_lines(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """The text's lines whose bit is set or that have none; lines before, lines gone."""
    if keep is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    stay = [line for k, line in enumerate(lines) if k >= len(bits) or bits[k]]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def with_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` (text: null as empty) and KEEP, null where every line stays."""
    bitmaps, path = keep_bitmaps(docs, min_length, min_docs)
    small = storage.fits(bitmaps, path, BROADCAST_BYTES)
    right = bitmaps.select(F.col("doc_id").alias("b_doc"), F.col("th").alias("b_th"), F.col("keep").alias("b_keep"))
    left = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    condition = left["doc_id"].cast("long").eqNullSafe(right["b_doc"]) & (F.xxhash64(left["text"]) == right["b_th"])
    joined = left.join(F.broadcast(right) if small else right, condition, "left")
    return joined.select(*(left[c] for c in left.columns), right["b_keep"].alias(KEEP))


def deduplicated(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows with all their columns; ``text`` has the lines that stay, ``n_chars``, if there, its length.

    Rows from whose text nothing goes are passed on without Python.
    """

    @F.pandas_udf("string")
    def kept(text: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([kept_lines(t.encode(), k)[0].decode() for t, k in zip(text, keep, strict=True)])

    marked = with_bitmaps(docs, min_length, min_docs)
    whole = marked.where(F.col(KEEP).isNull())
    changed = marked.where(F.col(KEEP).isNotNull()).withColumn("text", kept("text", KEEP))
    out = whole.unionByName(changed).drop(KEEP)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def digests(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                rows = []
                for text, keep in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column(KEEP).to_pylist(), strict=True):
                    kept, lines, dropped = kept_lines(text, keep)
                    rows.append((lines, dropped, hashlib.sha256(kept).hexdigest()))
                columns = zip(*rows, strict=True) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_bitmaps(narrow, min_length, min_docs).select("doc_id", "text", KEEP).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: line dedup of all documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS largest FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, pos, line, coalesce(keyed.doc_id <> f.largest, FALSE) AS gone
  FROM keyed LEFT JOIN frequent f USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
