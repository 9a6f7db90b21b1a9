"""Manifests, prefix tries and archives, against plain Python."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import pytest

from chronofold.llm import merkle, prefix_trie, storage, warc


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(digests):
    """All levels of a tree of fan-out 2."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, at):
    """(side, sibling) by level above leaf ``at``."""
    path = []
    for level in levels[:-1]:
        sibling = at ^ 1
        path.append((at % 2, level[sibling] if sibling < len(level) else None))
        at //= 2
    return path


def plain_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> the sorted result rows."""
    trees = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = h("".join(framed(v) for v in (doc_id, source, lang, n_chars, text)))
        more = n_chars + 1 if n_chars is not None else None
        bad = h("".join(framed(v) for v in (doc_id, source, lang, more, text)))
        chosen = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, bad if chosen else leaf, doc_id))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: plain_tree([r[2] for r in sorted(trees[g])]) for g in order}
    top = plain_tree([built[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, (_, _, leaf, start, doc_id) in enumerate(sorted(trees[g])):
            path = plain_path(built[g], at) + plain_path(top, k)
            digest = start
            for right, sibling in path:
                digest = h((sibling or "") + digest if right else digest + (sibling or ""))
            root = top[-1][0]
            out.append((doc_id, leaf, built[g][-1][0], root, h("".join(s or "" for _, s in path)), digest, digest == root))
    return sorted(out, key=str)


MANIFEST_SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, g string, row long, pos int"


@pytest.mark.parametrize(("count", "levels"), [(1, 2), (2, 1), (70, 2), (64, 3), (65, 12)])
def test_manifest(spark, count, levels):
    langs = ["en", None, "de", "", "é", "zz"]
    rows = [(k // 2 if k % 9 == 0 else k, None if k % 5 == 0 else f"s{k}", langs[0] if k % 3 else langs[k % 6], None if k % 11 == 0 else k, None if k % 7 == 3 else "ü\n" * (k % 4)) for k in range(count)]
    if count > 20:
        rows += [rows[7], rows[7], (None, "s", "en", 3, "x"), (None, "s", "en", 3, "y"), (14, "s", "en", 2**63 - 1, "most"), (5, "s", "en", 1, "long " * 50_000)]
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], MANIFEST_SCHEMA)
    got = [tuple(r) for r in merkle.manifest(docs, levels).collect()]
    assert sorted(got, key=str) == plain_manifest(rows)


def test_manifest_of_one_repeated_row_and_of_none(spark):
    rows = [(7, "s", "en", 1, "same")] * 40
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], MANIFEST_SCHEMA)
    assert sorted((tuple(r) for r in merkle.manifest(docs, 2).collect()), key=str) == plain_manifest(rows)
    assert merkle.manifest(docs.limit(0), 2).collect() == []


def test_manifest_tells_what_was_tampered_with(spark):
    docs = spark.createDataFrame([(k, "s", "en", 5, f"t{k}", "x", "y", 1, 2) for k in range(200)], MANIFEST_SCHEMA)
    got = Counter((zlib.crc32(str(r.doc_id).encode()) % 7 == 0, r.verified) for r in merkle.manifest(docs, 3).collect())
    assert set(got) == {(True, False), (False, True)}


def plain_trie(rows):
    """Rows (conv_id, turn, role, text) -> the sorted node rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        shared = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:shared] + turns[shared:]
    members, below = {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        for d in range(len(node) + 1):
            below.setdefault(node[:d], []).append(node)
    children = Counter(node[:-1] for node in members if node)
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(whole[c]) == len(node))
        saved = sum((len(members[m]) - 1) * len(m[-1][1].split()) for m in below[node] if m)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], sum(not children[m] for m in below[node]), saved, h(",".join(map(str, ends)))))
    return sorted(out, key=str)


TURN_SCHEMA = "conv_id long, turn long, role string, text string, path string, shard long, node long, words long"


def tried(spark, rows, shard_turns):
    table = spark.createDataFrame([(*r, "p", 1, 2, 3) for r in rows], TURN_SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.trie(table, shard_turns).collect()), key=str)


@pytest.mark.parametrize("shard_turns", [1_000_000, 60, 7])
def test_trie(spark, shard_turns):
    rng = random.Random(shard_turns)
    rows = []
    for c in range(150):
        if c % 20 == 0 and c % 40:
            continue
        for turn in range(rng.randint(0, 6)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d e f"])))
    rows += [(c, k, "user", f"same words {k}") for c in range(1000, 1090) for k in range(3)]  # copies
    rows += [(2001, None, "user", "first"), (2001, 0, "user", "second"), (2001, 0, "user", "second"), (2001, 0, None, "tie"), (None, 0, "user", "of none")]
    rows += [(3000, k, "user", "long " * 2000 if k == 5 else "x") for k in range(40)]
    assert tried(spark, rows, shard_turns) == plain_trie(rows)


def test_trie_of_few_rows(spark):
    assert tried(spark, [(1, 0, "u", "a")], 1) == plain_trie([(1, 0, "u", "a")])
    # Conversation 5 takes more turns from its run than it has, and there is none to take from.
    shared = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert tried(spark, [(shared, 0, "u", "a")], 1) == plain_trie([(shared, 0, "u", "a")]) and len(tried(spark, [(shared, 0, "u", "a")], 1)) == 1
    table = spark.createDataFrame([], TURN_SCHEMA)
    assert prefix_trie.trie(table).collect() == []


def test_parts_of_ending_members(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(0, 2000, 20)]
    assert tried(spark, rows, 10) == plain_trie(rows)
    monkeypatch.setattr(prefix_trie, "PART_IDS", 3)
    out = []
    shard = prefix_trie.Shard(0, prefix_trie.Skeleton(["k" * 32]), out)
    for c in range(8):
        shard.add(c, "k" * 32, [1])
    shard.finish()
    assert [r[12] for r in out if r[12]] == ["0,1,2", "3,4,5", "6,7"] and [r[11] for r in out if r[12]] == [0, 1, 2]


def test_common_turns():
    assert prefix_trie.common_turns("a" * 64, "a" * 32 + "b" * 32) == 1 and prefix_trie.common_turns("", "a" * 32) == 0


PAGE_SCHEMA = "page_id long, url string, html string, row long, payload string, kept int, type string, digest string"


def page_rows():
    rng = random.Random(5)
    rows = [(k, f"http://x.y/{k} a", "<p>ü" * rng.choice([0, 1, 40, 249, 250, 3000]) + str(k % 40 if k % 2 else k)) for k in range(120)]
    rows += [(200, None, None), (201, "u", ""), (202, "u", "a" * 999), (203, "u", "a" * 999), (204, "u", "a" * 1000), (205, "u", "a" * 1000), (206, "u", "long\r\n\r\nWARC/1.1\r\n" * 40_000), (207, "u\r\nX: 1", "long\r\n\r\nWARC/1.1\r\n" * 40_000)]
    rows += [(300, "u", "b" * 1200)] * 5 + [(299, "u", "b" * 1200), (None, "u", "b" * 1200), (None, "u", "c" * 1500), (None, "v", "c" * 1500)]
    return rows


def plain_pages(rows):
    last = {}
    for page_id, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if page_id is None else page_id)
    seen, out = set(), []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        to = last[html or ""]
        first = (page_id if page_id is not None else -1) == to and (payload not in seen)
        response = len(payload) < 1000 or first
        if response:
            seen.add(payload)
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "response" if response else "revisit", None if response or to < 0 else to))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [400, 1 << 15])
def test_archives(spark, tmp_path, segment):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, 1, "p", 2, "t", "d") for r in rows], PAGE_SCHEMA)
    path = f"file://{tmp_path}/archives"
    warc.write(pages, path, segment)
    records = warc.read(spark, path, payloads=True)
    stored = Counter((r.page_id, bytes(r.payload)) for r in records.where("type = 'response'").collect())
    got = [tuple(r) for r in warc.resolved(records).collect()]
    assert sorted(got, key=str) == plain_pages(rows)
    assert set(stored) <= {(p, (t or "").encode()) for p, _, t in rows} and sum(stored.values()) == sum(r[3] == "response" for r in got)
    # The files are gzip files of records that any reader finds, segments among them.
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "archives").glob("part-*"))
    assert text.count(b"WARC-Type: continuation") > 10 and text.count(b"WARC-Segment-Total-Length") == text.count(b"WARC-Segment-Number: 1\r")


def test_archives_of_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write(spark.createDataFrame([], PAGE_SCHEMA), path)
    assert warc.resolved(warc.read(spark, path)).collect() == []


def test_joins_of_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(warc.storage, "fits", lambda *_: False)
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(300)], "row long, same string")
    table, path = storage.materialise(spark.createDataFrame([("hot", 9, 4), ("k3", 8, 1)], "same string, kept long, copies int"), "t")
    got = warc.spread_join(rows, table, path, "same", "row").collect()
    assert len(got) == 300 and {(r.same, r.kept) for r in got if r.kept} == {("hot", 9), ("k3", 8)} and sum(r.kept == 9 for r in got) == 200


def segment_row(k, block, total=None):
    return {"type": "response", "record_id": "r", "page_id": 1, "url": None, "refers_to": None, "payload_digest": None, "origin": "r", "segment": k, "total": total, "block": block}


def test_segments_must_be_whole_and_in_order():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"5;ext=1\r\nhello\r\n6\r\n world\r\n0\r\nTrailer: x\r\n\r\n"
    for cut in range(1, len(block)):
        whole = warc.Assembly(segment_row(1, block[:cut]), True)
        whole.add(segment_row(1, block[:cut]))
        whole.add(segment_row(2, block[cut:], len(block)))
        assert whole.done()[-1] == b"hello world"
    with pytest.raises(ValueError, match="first segment"):
        warc.Assembly(segment_row(2, b""), False)
    for second in (segment_row(3, block[9:], len(block)), segment_row(1, block[9:], len(block))):
        part = warc.Assembly(segment_row(1, block[:9]), False)
        part.add(segment_row(1, block[:9]))
        with pytest.raises(ValueError, match="segment"):
            part.add(second)
    for tail, total, message in ((block[9:], len(block) + 1, "bytes of"), (block[9:-2], len(block) - 2, "ends early")):
        part = warc.Assembly(segment_row(1, block[:9]), False)
        part.add(segment_row(1, block[:9]))
        part.add(segment_row(2, tail, total))
        with pytest.raises(ValueError, match=message):
            part.done()
    for bad in (b"\r\n\r\nzz\r\n", b"Transfer-Encoding: chunked\r\n\r\nzz\r\n", b"Transfer-Encoding: chunked\r\n\r\n2\r\nabcd\r\n", b"Transfer-Encoding: chunked\r\n\r\n0\r\n\r\nmore"):
        body = warc.Body()
        if bad.startswith(b"\r\n"):
            assert body.feed(bad) == b"zz\r\n" or body.feed(b"") == b""
            continue
        with pytest.raises(ValueError):
            body.feed(bad)
            body.close()


def test_records_are_checked():
    good = next(warc.members(warc.member("response", "<i>", [("X-Page-ID", 3)], b"block")))
    fields, block = warc.parse(good)
    assert block == b"block" and fields["x-page-id"] == "3"
    for bad in (good.replace(b"block", b"blocK", 1), good[:-5] + b"\r\n\r\n", b"HTTP/1.1 200\r\n\r\n\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.members(warc.member("response", "<i>", [], b"block" * 99)[:-9]))
