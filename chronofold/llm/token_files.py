"""Token-id files: rANS blocks in ascending doc_id order, read back block by block.

A folder holds ``table`` (the shared frequencies, counted over every id of the corpus), ``blocks``
(one row a block: its part, its place in the part, its documents and their lengths, the coded bytes)
and nothing else; both are Parquet, so any store that Spark reads will do. Parts are ranges of
doc_id, each written by one task, and blocks are independent: a reader decodes any of them, or a
segment of one, from the table and its own bytes, and checksums tell whether it got the right ids.

Null text counts as empty; null doc_ids come first; rows that repeat a doc_id stay apart, ordered by
their length and ids; an empty table gives empty files. Other columns are left aside. A document is
never split over blocks, so a block is as large as ``block_tokens`` or its one longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm import rans, storage, tokens

BLOCK_TOKENS = 1 << 20
PART_TOKENS = 1 << 22
_BLOCKS = "part int, block int, doc_ids array<long>, doc_tokens array<long>, n_tokens long, payload binary"


def tokenised(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and ids (uint16, little-endian) of whole texts, end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.coder(vocabulary)
        for batch in batches:
            for part in tokens.slices(batch):
                ids, counts = coder.encode_ended(part.column("text"))
                offsets = np.concatenate(([0], np.cumsum(2 * counts))).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), raw], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def frequencies(coded: DataFrame, size: int, fan_in: int = 32) -> np.ndarray:
    """How often each id occurs: a histogram a task, summed ``fan_in`` at a time until the driver adds the last ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column("ids"):
                total += np.bincount(np.frombuffer(value.as_buffer(), "<u2"), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["ids"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column("ids"):
                total += np.frombuffer(value.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["ids"])

    sums, n = coded.select("ids").mapInArrow(count, "ids binary"), coded.rdd.getNumPartitions()
    while n > fan_in:
        n = -(-n // fan_in)
        sums = sums.repartition(n).mapInArrow(add, "ids binary")
    rows = sums.collect()
    return sum((np.frombuffer(r.ids, np.int64) for r in rows), np.zeros(size, np.int64))


def write(docs: DataFrame, path: str, vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> None:
    """Encode all documents to files below ``path``."""
    spark, vocabulary = docs.sparkSession, vocabulary or tokens.default_path()
    coded, coded_path = storage.materialise(tokenised(docs, vocabulary), "token-ids")
    counts = frequencies(coded, 1 << 16)
    freq = rans.quantise(counts)
    table = [(rans.SCALE_BITS, int(counts.sum()), freq.astype("<u4").tobytes())]
    spark.createDataFrame(table, "scale_bits int, n_tokens long, freq binary").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)  # 65,536 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, block = rans.Table.of(shared.value), TaskContext.get().partitionId(), 0
        doc_ids, raws, size = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raws), "<u2")
            row = {"part": part, "block": block, "doc_ids": doc_ids, "doc_tokens": [len(r) // 2 for r in raws], "n_tokens": len(ids), "payload": rans.encode(ids, coder)}
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                doc_ids.append(doc_id)
                raws.append(raw)
                size += len(raw) // 2
                if size >= block_tokens:
                    yield flush()
                    doc_ids, raws, size, block = [], [], 0, block + 1
        if doc_ids:
            yield flush()

    parts = max(1, -(-int(counts.sum()) // part_tokens))
    # Texts of one doc_id and length are dealt on by how they begin, and copies of a row by their number in the written table.
    begins = F.substring("ids", 1, 16)
    ordered = coded.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, "doc_id", "n_tokens", begins, "row").sortWithinPartitions("doc_id", "n_tokens", "ids")
    ordered.select("doc_id", "ids").mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    storage.remove(spark, coded_path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    freq = np.frombuffer(spark.read.parquet(f"{path}/table").first().freq, "<u4")
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # Two steps, so that the only window over everything has a row a part.
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("part_start"))
    starts = sizes.join(parts, "part").select("part", "block", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0))).alias("block_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Table.of(shared.value)
        for batch in batches:
            for doc_ids, counts, start, payload in zip(batch.column("doc_ids"), batch.column("doc_tokens"), batch.column("block_start"), batch.column("payload"), strict=True):
                raw = memoryview(rans.decode(payload.as_buffer(), coder).astype("<u4").tobytes())
                size = counts.values.to_numpy()
                ends = np.cumsum(size)
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
                columns = [doc_ids.values, pa.array(start.as_py() + ends - size, pa.int64()), pa.array(size, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = blocks.select("part", "block", "doc_ids", "doc_tokens", "payload").join(starts, ["part", "block"])
    return placed.select("doc_ids", "doc_tokens", "block_start", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents written as token-id files, and what the files say of each."""
    path = storage.new_path(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path)
