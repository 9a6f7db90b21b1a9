"""Operators on whole texts, against plain Python."""

import hashlib
import io
import random
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from chronofold.llm import line_dedup, media, mixing, packing, rans, sharding, storage, token_counts, token_files, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunks_give_the_tokenizers_ids(tokenizer):
    random.seed(3)
    letters = "aB.,'s1 ́İΣéक़\n☃<|>endoftext"
    texts = ["", None, "İstanbul, x", "don't stop'll", "<|endoftext|> hi", "x́. y", "a\x00b c\x85d", "ΟΔΟΣ Σ."]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    ids, counts = tokens.ChunkCoder(tokens.default_path()).encode_ended(pa.array(texts, pa.string()))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert list(ids[at : at + n]) == ids_of(tokenizer, text), text
        at += n


def test_slices_cover_a_batch_and_begin_at_their_start():
    batch = pa.RecordBatch.from_pydict({"k": list(range(50)), "text": ["x" * (k % 7) for k in range(50)]})
    parts = list(tokens.slices(batch, most=16))
    assert len(parts) > 3 and [k for p in parts for k in p.column("k").to_pylist()] == list(range(50))
    assert all(p.column("text").offset == 0 for p in parts)
    assert list(tokens.slices(batch.slice(0, 0))) == [] or sum(p.num_rows for p in tokens.slices(batch.slice(0, 0))) == 0


def plain_feature(payload):
    """Frames, peaks, pairs and the digest of the pair codes, worked out one frame and band at a time."""
    window = [0.5 - 0.5 * np.cos(2 * np.pi * k / 575) for k in range(576)]
    starts = range(0, len(payload) - 575, 288)
    table = []
    for s in starts:
        spectrum = np.fft.rfft(np.array([(payload[s + k] - 128) * window[k] for k in range(576)]))
        table.append([max(range(low, high), key=lambda k: abs(spectrum[k])) for low, high in ((2, 24), (24, 72), (72, 144), (144, 288))])
        table[-1] = [(k, abs(spectrum[k]) ** 2) for k in table[-1]]
    peaks = []
    for f, row in enumerate(table):
        for band, (k, power) in enumerate(row):
            before = table[f - 1][band][1] if f else -1
            after = table[f + 1][band][1] if f + 1 < len(table) else -1
            if power > 16 and power >= before and power > after:
                peaks.append((f, k))
    codes = sorted((f << 32) | (k << 16) | (k2 << 6) | (f2 - f) for i, (f, k) in enumerate(peaks) for f2, k2 in peaks[i + 1 : i + 5] if f2 - f <= 63)
    return len(table), len(peaks), codes


def test_media_round_trip(make_docs, odd_rows):
    stored = {(r.doc_id, bytes(r.media)) for r in media.media_table(make_docs(odd_rows)).collect()}
    got = media.stored_features(make_docs(odd_rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    texts = defaultdict(list)
    for doc_id, text in odd_rows:
        texts[doc_id].append((text or "").encode())
    for r in got:
        text = texts[r.doc_id][0]
        payload = text + b"\xff" * (-len(text) % 576 if text else 576)
        file = next(m for d, m in stored if d == r.doc_id)
        with wave.open(io.BytesIO(file)) as f:
            assert f.readframes(f.getnframes()) == payload
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(text), len(payload), zlib.crc32(payload[-32:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(file).hexdigest() and r.media_bytes == len(file)
        assert r.feature == f"{r.feature.split(':')[0]}:{r.feature.split(':')[1]}:{len(r.fingerprints)}:{hashlib.sha256(np.array(r.fingerprints, '<i8').tobytes()).hexdigest()[:32]}"
    by_text = defaultdict(set)
    for r in got:
        by_text[r.payload_sha256].add(r.feature)
    assert all(len(v) == 1 for v in by_text.values())


def test_media_features_against_plain_python(make_docs):
    random.seed(6)
    rows = [(k, "".join(chr(random.randint(32, 126)) for _ in range(n))) for k, n in enumerate((0, 10, 576, 3000, 9000))]
    for r in media.stored_features(make_docs(rows)).collect():
        frames, peaks, codes = plain_feature(media.pad(rows[r.doc_id][1].encode()))
        assert r.fingerprints == codes and r.feature.startswith(f"{frames}:{peaks}:{len(codes)}:")


def test_media_peaks_find_a_tone():
    t = np.arange(576 * 6)
    tone = (127 + 100 * np.sin(2 * np.pi * 30 * t / 576)).astype(np.uint8)
    bins, _ = media.band_peaks(tone)
    assert (bins[:, 1] == 30).all()


def test_media_empty_table(make_docs):
    assert media.stored_features(make_docs([])).count() == 0


def check_packing(rows, want):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(want)
    for doc_id, copies in want.items():
        ids = copies[0]
        starts = defaultdict(list)
        for r in by_doc[doc_id]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length]) and 0 < r.length <= 4096
            starts[r.start].append(r.length)
        assert all(len(v) == len(copies) for v in starts.values())
        assert sorted((s, v[0]) for s, v in starts.items()) == [(s, min(4096, len(ids) - s)) for s in range(0, len(ids), 4096)]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return sequences


@pytest.mark.parametrize("group_pieces", [4, 8192])
def test_packing(make_docs, odd_rows, tokenizer, group_pieces):
    want = defaultdict(list)
    for doc_id, text in odd_rows:
        want[doc_id].append(ids_of(tokenizer, text))
    check_packing(packing.pack(make_docs(odd_rows), group_pieces=group_pieces).collect(), want)


def test_packing_empty_table(make_docs):
    assert packing.pack(make_docs([])).count() == 0


def test_first_fit_decreasing_against_a_scan():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 300):
        sizes = np.sort(rng.integers(1, 101, n))[::-1]
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room = []
        for size, b, o in zip(sizes, bins, offsets, strict=True):
            first = next((k for k, r in enumerate(room) if r >= size), len(room))
            if first == len(room):
                room.append(100)
            assert (b, o) == (first, 100 - room[first])
            room[first] -= size


def test_rans_round_trip_segments_and_damage():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000, 700_000):
        ids = np.minimum(rng.geometric(0.01, n), 49_000).astype(np.uint16)
        table = rans.Table.of(rans.quantise(np.bincount(ids, minlength=1 << 16)))
        block = rans.encode(ids, table)
        assert (rans.decode(block, table) == ids).all() and len(rans.decode(block, table)) == n
    span = rans.SEGMENT_STEPS * rans.LANES
    assert (rans.decode(block, table, 1) == ids[span : 2 * span]).all()
    assert len(block) < 2 * n
    broken = bytearray(block)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(broken), table)


def test_quantise_keeps_every_id_and_the_scale():
    counts = np.array([10**12, 0, 1, 1, 5] + [1] * 40_000)
    freq = rans.quantise(counts)
    assert freq.sum() == 1 << rans.SCALE_BITS and (freq[counts > 0] > 0).all() and freq[1] == 0


@pytest.mark.parametrize(("block_tokens", "part_tokens"), [(10, 40), (1 << 20, 1 << 22)])
def test_token_files(spark, make_docs, odd_rows, tokenizer, block_tokens, part_tokens):
    path = storage.new_path(spark, "files")
    token_files.write(make_docs(odd_rows), path, block_tokens=block_tokens, part_tokens=part_tokens)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, path).collect())
    want, at = [], 0
    for doc_id, text in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(tokenizer, text)
        want.append((at, doc_id, len(ids), crc(ids)))
        at += len(ids)
    assert got == want


def test_token_files_empty_table(spark, make_docs):
    path = storage.new_path(spark, "files")
    token_files.write(make_docs([]), path)
    assert token_files.read(spark, path).count() == 0


def brute_lines(rows, min_length=40, min_docs=5):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(space).translate(lower)
    docs = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            docs[key(line)].add(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_length or len(docs[key(x)]) < min_docs or max(docs[key(x)]) == (-1 if doc_id is None else doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def line_rows():
    random.seed(5)
    common = ["A line that very many documents have in common, no doubt", "ééééééééééééééééééééééééééééééééééééééé é", "é" * 39, "only a short one", "Another Line of forty code points or more than that"]
    rows = []
    for k in range(200):
        lines = [random.choice(common) if random.random() < 0.5 else f"own line {random.random()} of document {k} and so on" for _ in range(random.randint(0, 6))]
        if random.random() < 0.5:
            lines.append("  " + common[0].upper() + "\t\r")
        rows.append((k, "\n".join(lines)))
    return [*rows, (None, common[0] + "\n" + common[0]), (300, None), (301, ""), (301, ""), (302, "\n\n" + common[0] + "\n"), (302, "\n\n" + common[0] + "\n")]


@pytest.mark.parametrize("partition_rows", [7, 250_000])
def test_line_dedup(monkeypatch, make_docs, partition_rows):
    rows = line_rows()
    monkeypatch.setattr(line_dedup.keep_bitmaps, "__defaults__", (40, 5, partition_rows))
    got = line_dedup.digests(make_docs(rows)).collect()
    key = lambda r: (r[0] is not None, *r[1:], r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(brute_lines(rows), key=key)


def test_line_dedup_texts(make_docs):
    rows = line_rows()
    docs = make_docs(rows)
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = sorted((r.doc_id if r.doc_id is not None else -1, hashlib.sha256(r.text.encode()).hexdigest(), r.gone) for r in out.collect())
    assert got == sorted((d if d is not None else -1, h, "x") for d, _, _, h in brute_lines(rows))
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_line_dedup_bitmaps_tell_what_stays(make_docs):
    rows = line_rows()
    gone = {(d, len(t or "")): n for (d, t), (_, _, n, _) in zip(rows, brute_lines(rows), strict=True)}
    texts = {d: t or "" for d, t in rows}
    bitmaps, _ = line_dedup.keep_bitmaps(make_docs(rows))
    for r in bitmaps.collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), bitorder="little")
        assert (bits == 0).sum() == r.n_dropped == gone[r.doc_id, len(texts[r.doc_id])] > 0
        assert "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k >= len(bits) or bits[k]) == line_dedup.kept_lines(texts[r.doc_id].encode(), r.keep)[0].decode()


def test_line_dedup_empty_table(make_docs):
    assert line_dedup.digests(make_docs([])).count() == 0


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    held = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in held)
        free = [s for s in names if s not in held]
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in held else level * w[s] for s in names}
        held |= over


@pytest.mark.parametrize("range_rows", [5, None])
def test_mixing(make_docs, range_rows):
    random.seed(7)
    rows = [(k, "w " * random.randint(0, 50), random.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(300)]
    rows += [(400, None, "e"), (401, "", "e"), (None, "no id here", "a"), (402, "x y", "f"), (402, "x y", "f")]
    got = mixing.mix(make_docs(rows), range_rows=range_rows).collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((d, len((t or "").split()), s) for d, t, s in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    for s, target in brute_targets(sizes).items():
        assert taken[s] == int(target + 1e-6) and abs(next(r.target for r in got if r.source == s) - target) < 1e-6
    again = mixing.mix(make_docs(rows[::-1]), range_rows=range_rows).collect()
    assert Counter(again) == Counter(got)


def test_mixing_plan_has_no_python(make_docs):
    plan = mixing.mix(make_docs([(1, "a b", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixed_documents(make_docs):
    docs = make_docs([(k, "w " * 10, "abc"[k % 3]) for k in range(90)])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    n = Counter(r.source for r in out.collect())
    assert n["a"] == pytest.approx(56, abs=1) and n["b"] == pytest.approx(22, abs=1) and n["c"] == pytest.approx(11, abs=1)
    assert mixing.mixed(make_docs([])).count() == 0


def test_sharding(spark, make_docs, odd_rows):
    rows = odd_rows + [(k, "t" * (k % 90)) for k in range(10, 3000)]
    path = storage.new_path(spark, "map")
    got = sharding.shard(make_docs(rows), path).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    loads = Counter()
    for r in got:
        loads[r.shard] += r["size"]
    *rest, heaviest = sorted(loads.values())
    assert heaviest > 60_000 and max(rest) - min(rest) < 0.05 * sum(rest) / 23  # one document is larger than a shard's share
    assert sharding.read_map(spark, path, 0).count() == sharding.read_map(spark, path, 1).count() == 4096
    assert sharding.shard(make_docs([]), storage.new_path(spark, "map")).count() == 0


def test_copies_of_one_record_spread_over_shards(spark, make_docs):
    rows = [(7, "the same text of 25 bytes")] * 2000 + [(k, "t" * 25) for k in range(100, 2100)] + [(None, "n")] * 40
    got = sharding.shard(make_docs(rows), storage.new_path(spark, "map")).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((d, zlib.crc32(t.encode())) for d, t in rows)
    loads, places = Counter(), defaultdict(list)
    for r in got:
        loads[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert len(loads) == 24 and max(loads.values()) - min(loads.values()) < 0.03 * sum(loads.values()) / 24
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    again = sharding.shard(make_docs(rows).repartition(5), storage.new_path(spark, "map")).collect()
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((r.doc_id, r.shard) for r in again)


def test_a_map_version_is_written_once_and_whole(spark):
    path = storage.new_path(spark, "map")
    assert sharding.write_map(spark, path, 0, [1, 0, 2]) and not sharding.write_map(spark, path, 0, [0, 0, 0])
    assert [r.shard for r in sharding.read_map(spark, path, 0).orderBy("virtual_slot").collect()] == [1, 0, 2]


def test_rebalance_is_near_even_and_moves_slots_only():
    random.seed(1)
    weight = [random.randint(0, 1000) for _ in range(4096)]
    out = sharding.rebalance([k % 24 for k in range(4096)], weight, 24)
    load = Counter()
    for k, s in enumerate(out):
        load[s] += weight[k]
    assert max(load.values()) - min(load.values()) < 0.002 * sum(weight) / 24
    assert sum(a == k % 24 for k, a in enumerate(out)) > 3000


def test_token_counts_query_after_deletes_and_revisions(spark, tmp_path, make_docs, odd_rows, tokenizer):
    rows = [*odd_rows, *((k, "some words " * (k % 9), "t") for k in range(10, 80))]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for _, text, *source in rows:
        want[source[0] if source else "s"] += len(ids_of(tokenizer, text)) - 1
    docs = Counter(r[2] if len(r) > 2 else "s" for r in rows)
    assert {(r.source, r.n_docs, r.n_tokens) for r in token_counts.query(spark, str(tmp_path)).collect()} == {(s, docs[s], n) for s, n in want.items()}


def test_token_counts(spark, make_docs, odd_rows, tokenizer):
    docs = make_docs(odd_rows)
    rows = token_counts.counted(docs)
    assert Counter((r.doc_id, r.n_tokens) for r in rows.collect()) == Counter((d, len(ids_of(tokenizer, t)) - 1) for d, t in odd_rows)
    rollup = token_counts.Rollup(spark, storage.new_path(spark, "rollup"))
    total = lambda: [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()]
    assert total() == []
    n = sum(len(ids_of(tokenizer, t)) - 1 for _, t in odd_rows)
    assert rollup.commit("a", token_counts.inserts(rows)) and total() == [(len(odd_rows), n)]
    assert not rollup.commit("a", token_counts.inserts(rows)) and total() == [(len(odd_rows), n)]
    one = rows.where("doc_id = 1")
    k = one.first().n_tokens
    rollup.commit("b", token_counts.revisions(one, one.withColumn("n_tokens", one.n_tokens + 5)))
    assert total() == [(len(odd_rows), n + 5)]
    rollup.commit("c", token_counts.deletes(one.withColumn("n_tokens", one.n_tokens + 5)))
    assert total() == [(len(odd_rows) - 1, n - k)]
    rollup.compact("abc", ["a", "b"])
    assert total() == [(len(odd_rows) - 1, n - k)]
    rollup.sweep()
    assert total() == [(len(odd_rows) - 1, n - k)]
    assert len(storage.read_texts(spark, f"{rollup.path}/batches")) == 3
    assert not rollup.commit("b", token_counts.inserts(rows)) and total() == [(len(odd_rows) - 1, n - k)]
    rollup.commit("empty", token_counts.inserts(rows.limit(0)))
    assert total() == [(len(odd_rows) - 1, n - k)]
    rollup.commit("gone", token_counts.deletes(rows.where("doc_id <> 1 OR doc_id IS NULL")))
    assert total() == []
    with pytest.raises(ValueError):
        rollup.commit("../x", token_counts.inserts(rows))


def test_two_folds_at_once_stand_for_a_batch_once(spark, monkeypatch):
    rollup = token_counts.Rollup(spark, storage.new_path(spark, "rollup"))
    rows = spark.createDataFrame([("s", "en", "v", 10)], "source string, lang string, tokenizer string, n_tokens long")
    for name in ("a", "b"):
        rollup.commit(name, token_counts.inserts(rows))
    total = lambda: [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()]
    other, publish = token_counts.Rollup(spark, rollup.path), rollup._publish

    def late(*args):
        # Another fold of the same batches begins and ends before this one publishes.
        other.compact("second", ["a", "b"])
        return publish(*args)

    monkeypatch.setattr(rollup, "_publish", late)
    rollup.compact("first", ["a", "b"])
    assert total() == [(2, 20)]
    # A fold that died behind its claims goes on under its name, and no other one takes its batches.
    rollup.commit("c", token_counts.inserts(rows))
    storage.publish_text(spark, f"{rollup.path}/claims/c", "third")
    other.compact("fourth", ["c"])
    assert "fourth" not in storage.read_texts(spark, f"{rollup.path}/folds") and total() == [(3, 30)]
    other.compact("third", ["c"])
    assert "third" in storage.read_texts(spark, f"{rollup.path}/folds") and total() == [(3, 30)]
    # A reader that read the folds before one landed counts its batches as they are.
    folds, batches = rollup._state()
    rollup.commit("d", token_counts.inserts(rows))
    other.compact("fifth", ["d"])
    monkeypatch.setattr(rollup, "_state", lambda: (folds, rollup._markers("batches")))
    assert total() == [(4, 40)]
