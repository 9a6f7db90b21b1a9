"""Media columns: WAV payloads, short-time Fourier transforms and spectral-peak pair fingerprints.

A text's UTF-8 bytes, padded with 255 to a positive multiple of ``FRAME``, become the samples of an
8-bit mono WAV file, stored as a binary column of a Parquet table. Features are computed from the stored
column, read back by Spark and by the wave module. Frames of ``FRAME`` samples every half frame are transformed; the strongest bin of each frequency band is a peak where
it stands above the same band's one frame before and after; each peak is paired with the next
``FAN_OUT`` peaks. A pair is stored as one number: the first peak's frame in the upper 32 bits, both
bins and the distance in frames below, so that a document's array is sorted by time.

Null and empty texts are one frame of padding and have no pairs. Equal texts give equal values. Null
doc_ids and repeated rows are kept; an empty table gives no rows; other columns are left aside. Long
texts are transformed in blocks of ``BLOCK`` frames.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import storage, tokens

FRAME = 576
RATE = 8000
FAN_OUT = 4
REACH = 63
BANDS = ((2, 24), (24, 72), (72, 144), (144, 288))
BLOCK = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    """The bytes as samples of an 8-bit mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of such a file."""
    with wave.open(io.BytesIO(media), "rb") as f:
        if f.getnchannels() != 1 or f.getsampwidth() != 1:
            raise ValueError("expected 8-bit mono samples")
        return f.readframes(f.getnframes())


def pad(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of FRAME."""
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin and its power for each frame and band."""
    hop = FRAME // 2
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::hop]
    bins = np.empty((len(frames), len(BANDS)), np.int64)
    power = np.empty((len(frames), len(BANDS)), np.float32)
    for at in range(0, len(frames), BLOCK):
        spectrum = np.fft.rfft((frames[at : at + BLOCK].astype(np.float32) - 128) * _WINDOW)
        energy = spectrum.real**2 + spectrum.imag**2
        for b, (low, high) in enumerate(BANDS):
            part = energy[:, low:high]
            best = part.argmax(axis=1)
            bins[at : at + BLOCK, b] = best + low
            power[at : at + BLOCK, b] = part[np.arange(len(part)), best]
    return bins, power


def fingerprints(samples: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Time-coded pair codes, number of frames and number of peaks."""
    bins, power = band_peaks(samples)
    edge = np.full((1, len(BANDS)), -1, np.float32)
    before, after = np.concatenate((edge, power[:-1])), np.concatenate((power[1:], edge))
    # A constant signal leaves only rounding noise beside the lowest bins.
    frame, band = np.nonzero((power > 16) & (power >= before) & (power > after))
    at = bins[frame, band]
    codes = []
    for k in range(1, FAN_OUT + 1):
        gap = frame[k:] - frame[:-k]
        near = gap <= REACH
        codes.append(((frame[:-k] << 32) | (at[:-k] << 16) | (at[k:] << 6) | gap)[near])
    out = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    out.sort()
    return out, len(bins), len(frame)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text, unpadded) and ``media``: the text as a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                texts = [value.as_py() or b"" for value in part.column("text").cast(pa.large_binary())]
                columns = [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(pad(t)) for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Of rows (doc_id, n_bytes, media): sizes and sums of payload and file, ``feature``, and ``fingerprints``, the time-coded pairs."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprints array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "media"):
                rows = []
                for value in part.column("media"):
                    stored = value.as_py()
                    payload = from_wav(stored)
                    codes, frames, peaks = fingerprints(np.frombuffer(payload, np.uint8))
                    feature = f"{frames}:{peaks}:{len(codes)}:{hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()[:32]}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, codes))
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def stored_features(docs: DataFrame) -> DataFrame:
    """``media_features`` of the documents' media, which is written as a table first and read back."""
    media, _ = storage.materialise(media_table(docs), "media")
    return media_features(media)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: payload, file and fingerprints of all documents."""
    return stored_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
