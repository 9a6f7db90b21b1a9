"""Static range asymmetric numeral system over token ids, many lanes at a time in numpy.

A block's ids are dealt to lanes in turn: id ``i`` belongs to lane ``i % lanes`` at step
``i // lanes``. Lanes are 64-bit states in [2**31, 2**63) that share one frequency table and one
stream of 32-bit words. A checkpoint holds the lanes' states and the place in the stream at the
start of a segment of steps, so segments decode apart, or all at once side by side.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 1024
SEGMENT_STEPS = 256
_HEAD = np.dtype([("magic", "S4"), ("n", "<u4"), ("lanes", "<u4"), ("steps", "<u4"), ("segments", "<u4"), ("words", "<u4")])
_MAGIC = b"CFA1"


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to 2**SCALE_BITS, and what coding needs of them."""

    freq: np.ndarray
    start: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, freq: np.ndarray) -> "Table":
        freq = freq.astype(np.uint64)
        return cls(freq, np.cumsum(freq) - freq, np.repeat(np.arange(len(freq), dtype=np.uint16), freq.astype(np.int64)))


def quantise(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts as frequencies with sum 2**bits; an id that occurs keeps at least 1."""
    total, scale = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint32)
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts / total * scale)), 0).astype(np.int64)
    while (over := int(freq.sum()) - scale) != 0:
        order = np.argsort(-freq, kind="stable")
        if over < 0:
            freq[order[0]] -= over
        else:
            step = np.minimum(freq[order] // 2, over)
            take = np.minimum(step, np.maximum(0, over - (np.cumsum(step) - step)))
            freq[order] -= take
    return freq.astype(np.uint32)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, segment_steps: int = SEGMENT_STEPS) -> bytes:
    """The block of these ids: head, checkpoints, checksums of the segments, words."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    if n and not freq.all():
        raise ValueError("an id has no frequency in the table")
    limit = freq << np.uint64(63 - SCALE_BITS)
    words, marks = [], []
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        full = x >= limit[a:b]
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> np.uint64(32), x)
        whole, rest = np.divmod(x, f)
        state[: b - a] = (whole << np.uint64(SCALE_BITS)) + rest + start[a:b]
        if step % segment_steps == 0:
            marks.append(state.copy())
    words.reverse()
    marks.reverse()
    sizes = np.array([len(w) for w in words], np.int64)
    places = (np.cumsum(sizes) - sizes)[::segment_steps]
    wide = ids.astype("<u4")
    sums = [zlib.crc32(wide[k * segment_steps * lanes : (k + 1) * segment_steps * lanes].tobytes()) for k in range(len(marks))]
    head = np.array([(_MAGIC, n, lanes, segment_steps, len(marks), int(sizes.sum()))], _HEAD)
    parts = [head.tobytes(), places.astype("<u4").tobytes(), np.array(sums, "<u4").tobytes()]
    return b"".join([*parts, *(m.astype("<u8").tobytes() for m in marks), *(w.astype("<u4").tobytes() for w in words)])


def decode(block: bytes, table: Table, segment: int | None = None) -> np.ndarray:
    """The ids of a block, or of one segment of it; raises if a checksum doesn't hold."""
    head = np.frombuffer(block, _HEAD, 1)[0]
    if head["magic"] != _MAGIC:
        raise ValueError("not a token block")
    n, lanes, per, count, n_words = (int(head[k]) for k in ("n", "lanes", "steps", "segments", "words"))
    at = _HEAD.itemsize
    places = np.frombuffer(block, "<u4", count, at).astype(np.int64)
    sums = np.frombuffer(block, "<u4", count, at + 4 * count)
    states = np.frombuffer(block, "<u8", count * lanes, at + 8 * count).reshape(count, lanes)
    words = np.frombuffer(block, "<u4", n_words, at + 8 * count + 8 * count * lanes)
    chosen = range(count) if segment is None else [segment]
    out = np.zeros((len(chosen), per * lanes), np.uint16)
    left = np.array([min(n - k * per * lanes, per * lanes) for k in chosen], np.int64)
    state, place = states[list(chosen)].copy(), places[list(chosen)].copy()
    mask, bits = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    lane = np.arange(lanes)
    for step in range(-(-int(left.max()) // lanes) if len(left) else 0):
        slot = state & mask
        ids = table.slots[slot]
        x = table.freq[ids] * (state >> bits) + slot - table.start[ids]
        live = lane[None, :] < (left - step * lanes)[:, None]
        short = (x < LOW) & live
        if short.any():
            took = short.sum(axis=1)
            flat = np.repeat(place - (np.cumsum(took) - took), took) + np.arange(int(took.sum()))
            x[short] = (x[short] << np.uint64(32)) | words[flat]
            place += took
        state = np.where(live, x, state)
        out[:, step * lanes : (step + 1) * lanes] = ids
    for k, c in enumerate(chosen):
        if zlib.crc32(out[k, : left[k]].astype("<u4").tobytes()) != sums[c]:
            raise ValueError(f"segment {c} doesn't match its checksum")
    return np.concatenate([out[k, : left[k]] for k in range(len(left))]) if len(left) else np.zeros(0, np.uint16)
