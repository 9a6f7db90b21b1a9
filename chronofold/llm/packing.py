"""Packing documents into fixed-length token sequences.

Each document's ids (with an end id) are cut at every ``length`` ids, so that only its last piece is
short. Pieces go to randomised groups of about ``group_pieces`` pieces by a hash of their place in
the written piece table, and each group is packed apart by first-fit decreasing: a tournament tree
over the bins' free room finds the leftmost bin that fits in logarithmic time. A group's size doesn't
depend on any document's, source's or key's share of the rows; at most one bin a group is left
badly filled, so padding stays near that of packing everything at once.

Null text counts as empty (a lone end id); null doc_ids and repeated rows are packed like any other,
each row once; equal lengths are taken in the order of doc_id and start; an empty table gives no rows.
Columns other than doc_id and text are left aside.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import storage, tokens

LENGTH = 4096
GROUP_PIECES = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_BINS = 1 << 24


def cut(counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, start and length of every piece of documents of ``counts`` ids."""
    per_doc = -(-counts // length)
    doc = np.repeat(np.arange(len(counts)), per_doc)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)) * length
    return doc, start, np.minimum(length, counts[doc] - start)


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """One row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.coder(vocabulary)
        for batch in batches:
            for part in tokens.slices(batch):
                ids, counts = coder.encode_ended(part.column("text"))
                doc, start, size = cut(counts, length)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = 4 * ((np.cumsum(counts) - counts)[doc] + start)
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * size).tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(doc)), start, size, sums, counts[doc]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, which come in falling order; every size is at most ``capacity``.

    The tree's leaves are bins, each inner node holds the larger room of its two halves. Walking to
    the left whenever the left half has room enough ends at the first bin that fits.
    """
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack_group(rows: pd.DataFrame, length: int = LENGTH) -> pd.DataFrame:
    """The pieces of one group with their sequence and offset."""
    rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
    bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
    rows["sequence_id"] = rows["pack_group"].to_numpy() * _BINS + bins
    rows["offset"] = offsets
    return rows.drop(columns="pack_group")


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``.

    ``group_pieces`` pieces at most, on average, share a group (and so a task's memory).
    """
    written, _ = storage.materialise(pieces(docs, vocabulary or tokens.default_path(), length), "pieces")
    groups = max(1, -(-written.count() // group_pieces))
    grouped = written.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    schema = f"{PIECES}, sequence_id long, offset long"
    return grouped.groupBy("pack_group").applyInPandas(lambda rows: pack_group(rows, length), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents packed into sequences of 4096."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
