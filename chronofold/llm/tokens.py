"""Token ids of whole texts, through the ``tokenizers`` library, one Arrow batch at a time.

Byte-pair merges never cross white space in the word tokenizer, and its pre-tokenizer keeps letters
apart from the punctuation after them. So a text's ids are the ids of its white-space separated
chunks in order, and a chunk's ids are those of its core and of its trailing punctuation. Each
distinct core of a worker goes to the library once; the rest of the work is Arrow and numpy.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ids one worker remembers at most; further cores are encoded each time they occur.
CACHE_ENTRIES = 600_000
#: Text bytes handled at once inside a task.
SLICE_BYTES = 4 << 20
END_ID = 2
_TAIL = ".,;:!?|"
_coders: dict[str, "ChunkCoder"] = {}
try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def default_path() -> str:
    """Where the public word tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def coder(path: str) -> "ChunkCoder":
    """The worker's coder for a vocabulary file; workers are reused, and so is what it remembers."""
    if path not in _coders:
        _coders[path] = ChunkCoder(path)
    return _coders[path]


class ChunkCoder:
    """Encodes texts to uint16 ids exactly as ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        if self.size > 1 << 16:
            raise ValueError(f"{path} has ids beyond 16 bits")
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        if not self.ends.any():
            raise ValueError(f"{path} does not mark word ends; chunks cannot be encoded apart")
        self.known: dict[str, bytes] = {"": b""}

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, cores: list[str]) -> dict[str, bytes]:
        """Ids of cores that the worker hasn't seen."""
        found: dict[str, bytes] = {}
        joined = [w for w in cores if w.isalpha() and max(w) < "Ā"]
        for at in range(0, len(joined), 1000):
            words = joined[at : at + 1000]
            ids = np.array(self._plain(" ".join(words)), dtype=np.uint16)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(words):
                found.update((w, np.array(self._plain(w), dtype=np.uint16).tobytes()) for w in words)
                continue
            raw, start = ids.tobytes(), 0
            for w, cut in zip(words, cuts.tolist(), strict=True):
                found[w] = raw[2 * start : 2 * cut]
                start = cut
        for w in cores:
            if w not in found:
                found[w] = np.array(self._plain(w), dtype=np.uint16).tobytes()
        room = CACHE_ENTRIES - len(self.known)
        if room >= len(found):
            self.known.update(found)
        elif room > 0:
            self.known.update(list(found.items())[:room])
        return found

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        get = self.known.get
        out = [get(chunk) for chunk in chunks]
        unknown = [k for k, ids in enumerate(out) if ids is None]
        if not unknown:
            return out
        parts, fresh = [], {}
        for k in unknown:
            chunk = chunks[k]
            core = chunk.rstrip(_TAIL)
            last = core[-1:]
            if core != chunk and last and (last.isalpha() or last in "0123456789") and last < "Ā":
                tail = chunk[len(core) :]
            else:
                core, tail = chunk, ""
            parts.append((k, core, tail))
            if get(core) is None:
                fresh[core] = None
            if get(tail) is None:
                fresh[tail] = None
        found = self._learn(list(fresh))
        for k, core, tail in parts:
            ids = found.get(core)
            ids = get(core) if ids is None else ids
            if tail:
                more = found.get(tail)
                ids += get(tail) if more is None else more
                if len(self.known) < CACHE_ENTRIES:
                    self.known[chunks[k]] = ids
            out[k] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) end to end, and the number of ids of each."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(texts) == 0:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat = lists.flatten()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = flat.dictionary_encode()
        where = coded.indices.to_numpy(zero_copy_only=False)
        ids_of = self._chunks(coded.dictionary.to_pylist())
        lens = np.fromiter(map(len, ids_of), dtype=np.int32, count=len(ids_of)) >> 1
        pool = np.frombuffer(b"".join(ids_of), dtype=np.uint16)
        starts = np.cumsum(lens, dtype=np.int32) - lens
        chunk_lens = lens[where]
        ends = np.cumsum(chunk_lens, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(starts[where] - (ends - chunk_lens), chunk_lens)
        shift += np.arange(total, dtype=np.int32)
        sums = np.concatenate((np.zeros(1, np.int64), ends))
        return pool[shift], np.diff(sums[bounds])

    def encode_ended(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` after each text."""
        ids, counts = self.encode(texts)
        if len(counts) == 0:
            return ids, counts
        out = np.empty(len(ids) + len(counts), dtype=np.uint16)
        ends = np.cumsum(counts + 1) - 1
        keep = np.ones(len(out), dtype=bool)
        keep[ends] = False
        out[ends], out[keep] = end_id, ids
        return out, counts + 1


def release_memory() -> None:
    """Give what finished batches took back to the system: workers are reused by later stages, and would keep it else."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text, so that long texts don't add up; memory is given back behind the last."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // most
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)])) if len(sizes) else np.array([0])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = batch.slice(int(a), int(b - a))
        # Copied, as some string kernels misread arrays that begin inside a buffer.
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([c, c.slice(0, 0)]) for c in part.columns], schema=part.schema) if a else part
    release_memory()
