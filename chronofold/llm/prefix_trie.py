"""The prefix trie of conversations by splitter-skeleton.

A conversation is a path: one digest of (role, text) for each turn, in order of turn. Paths are dealt to shards by
splitters, paths of a sample that cut the sorted order into about equal numbers of turns; copies of one path
are cut by conv_id. A node that reaches over shards is a prefix of a splitter, so the trie of the splitters'
prefixes (the skeleton) is broadcast, and each shard, sorted, finishes every other node by itself in one
streamed run: a node ends where the next path leaves it, and a finished subtree below the skeleton goes out.
For skeleton nodes a shard yields partial aggregates, which are summed by node. What isn't additive
(turns shared by all members, children that are skeleton nodes, leaves) is added from the lowest skeleton
nodes up to the root; the skeleton has at most (shards x turns of a splitter) nodes, and shards are as many as the turns
need, so it follows the size of the cluster's work and not the number of conversations.

The digest of a node's ending members is one sequence by its definition. Inside a shard it is streamed. For a
skeleton node, shards yield their part of the sequence as texts of about a megabyte, which are streamed in order of shard.

Roles and texts that are null are empty. Turns of one number are in order of (role, text) digest. Rows that
repeat are turns of their own. Rows without a conv_id belong to no conversation and take no part. An empty table
has no conversations and gives no rows. Other columns are left aside. A conversation's path, 36 bytes a turn, is one row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import storage
from chronofold.llm.mixing import words

#: Conversations whose ids lie in one run of this many share the first turns of the run's first one.
RUN = 20
#: Turns from the run's first conversation: a checksum of the id modulo this.
SHARED = 4
#: Turns that one shard is meant to hold, and sampled paths for each shard.
SHARD_TURNS, SAMPLES = 200_000, 16
#: Tables up to this size in memory are broadcast.
BROADCAST_BYTES = 64 << 20
#: Ids that a part of a skeleton node's ending members holds.
PART_IDS = 100_000
#: Characters of a path for one turn.
WIDTH = 32
_BATCH = 8192
_OUT = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("node", pa.int64()), ("parent_node", pa.int64()), ("shard", pa.int64()), ("part", pa.int64()), ("ids", pa.string()), ("words", pa.int64())]
)
_OUT_SQL = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _OUT)
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and ``turns``, its ordered array of (digest, words), one row a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("key"), words(text).alias("words")).alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (the turns' digests end to end) and words (of each turn), with the first turns taken from the run's first conversation."""
    own, _ = storage.materialise(turns_of(conversations), "conversation-turns")
    heads, heads_path = storage.materialise(own.where(F.col("conv_id") % RUN == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, SHARED - 1).alias("first")), "conversation-heads")
    heads = F.broadcast(heads) if storage.fits(heads.select("head"), heads_path, BROADCAST_BYTES // 8) else heads
    joined = own.join(heads, own.conv_id - own.conv_id % RUN == F.col("head"), "left")
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    begin = F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), shared)).otherwise(F.slice("turns", 1, 0))
    turns = F.concat(begin, F.slice("turns", shared + 1, F.size("turns")))
    return joined.select("conv_id", turns.alias("turns")).select("conv_id", F.array_join(F.col("turns.key"), "").alias("path"), F.col("turns.words").alias("words"))


class Skeleton:
    """The trie of splitter paths: a node is a number, the root is 0, and children have greater numbers."""

    def __init__(self, paths: list[str]) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.parent, self.depth = [-1], [0]
        for path in paths:
            node = 0
            for at in range(0, len(path), WIDTH):
                step = (node, path[at : at + WIDTH])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[step]


def splitters(paths: DataFrame, shard_turns: int) -> list[tuple[str, int]]:
    """The (path, conv_id) at which shards begin, but for the first shard's, ascending."""
    convs, total = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()
    shards = -(-total // shard_turns)
    if shards <= 1:
        return []
    # At most about SAMPLES paths a shard, chosen by a hash of their id.
    within = min(convs, SAMPLES * shards)
    sample = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(convs)) < within).select("path", "conv_id", (F.size("words") + 1).alias("turns")).toPandas().sort_values(["path", "conv_id"])
    share, out, passed = sample["turns"].sum() / shards, [], 0
    for path, conv_id, turns in sample.itertuples(index=False):
        if passed >= share * (len(out) + 1) and (not out or out[-1] < (path, conv_id)):
            out.append((path, int(conv_id)))
        passed += turns
    return out


def common_turns(a: str, b: str) -> int:
    """Turns that two paths have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


class _Node:
    """An open node: its number in the skeleton (-1: none), and what is known of it so far."""

    __slots__ = ("node", "words", "low", "convs", "children", "leaves", "saved", "ends", "ids", "place", "parent")

    def __init__(self, node: int, n_words: int, place: int, parent: int) -> None:
        self.node, self.words, self.place, self.parent = node, n_words, place, parent
        self.low, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.ids = None, []


class Shard:
    """The nodes of one sorted shard; ``rows`` are what can go out."""

    def __init__(self, shard: int, skeleton: Skeleton, rows: list[tuple]) -> None:
        self.shard, self.skeleton, self.rows = shard, skeleton, rows
        self.path, self.part = "", 0
        self.stack = [_Node(0, 0, -1, -1)]
        #: The open subtree below the skeleton: finished nodes by place, until its top one ends.
        self.subtree: list[tuple | None] = []
        self.lows: list[int] = []

    def add(self, conv_id: int, path: str, n_words: list[int]) -> None:
        self._leave(common_turns(self.path, path))
        for at in range(len(self.stack) - 1, len(path) // WIDTH):
            above = self.stack[-1]
            node = self.skeleton.child.get((above.node, path[at * WIDTH : (at + 1) * WIDTH]), -1) if above.node >= 0 else -1
            place = -1
            if node < 0:
                place = len(self.subtree)
                self.subtree.append(None)
                self.lows.append(0)
            self.stack.append(_Node(node, n_words[at], place, above.place))
        self.path, last = path, self.stack[-1]
        last.convs += 1
        last.low = conv_id if last.low is None else min(last.low, conv_id)
        if last.node >= 0:
            last.ids.append(str(conv_id))
            if len(last.ids) == PART_IDS:
                self._ids(last)
        elif last.ends is None:
            last.ends = hashlib.sha256(str(conv_id).encode())
        else:
            last.ends.update(f",{conv_id}".encode())

    def _ids(self, n: _Node) -> None:
        self.rows.append((None,) * 8 + (n.node, None, self.shard, self.part, ",".join(n.ids), None))
        self.part, n.ids = self.part + 1, []

    def _leave(self, depth: int) -> None:
        """End the open nodes deeper than ``depth``."""
        while len(self.stack) - 1 > depth:
            n = self.stack.pop()
            above = self.stack[-1]
            if n.node < 0:
                n.saved += (n.convs - 1) * n.words
                n.leaves += not n.children
                above.children += 1
            self._end(n, len(self.stack), above.node)
            above.convs += n.convs
            above.low = n.low if above.low is None else min(above.low, n.low)
            above.leaves += n.leaves
            above.saved += n.saved

    def _end(self, n: _Node, depth: int, above: int) -> None:
        if n.node >= 0:
            if n.ids:
                self._ids(n)
            self.rows.append((n.low, depth, None, n.convs, n.children, n.leaves, n.saved, None, n.node, None, self.shard, None, None, n.words))
            return
        self.lows[n.place] = n.low
        self.subtree[n.place] = (n, depth)
        if above >= 0:
            # The top of a subtree: all its nodes are done, and parents within it are known.
            for m, d in self.subtree:
                parent = None if m is n else self.lows[m.parent]
                self.rows.append((m.low, d, parent, m.convs, m.children, m.leaves, m.saved, m.ends.hexdigest() if m.ends else EMPTY, None, above if m is n else None, None, None, None, None))
            self.subtree, self.lows = [], []

    def finish(self) -> None:
        self._leave(0)
        self._end(self.stack[0], 0, -1)


def swept(paths: DataFrame, cuts: list[tuple[str, int]], skeleton: Skeleton) -> DataFrame:
    """Rows of nodes outside the skeleton, partial rows of skeleton nodes, and parts of their ending members' ids."""
    shared = paths.sparkSession.sparkContext.broadcast((cuts, skeleton))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value[0]
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(cuts, k) for k in keys], pa.int64())], ["conv_id", "path", "words", "shard"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        open_shard = None

        def out(least: int) -> Iterator[pa.RecordBatch]:
            if len(rows) >= least:
                for at in range(0, len(rows), _BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + _BATCH], strict=True), _OUT, strict=True)], schema=_OUT)
                rows.clear()

        for batch in batches:
            for conv_id, path, n_words, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_shard is None or open_shard.shard != shard:
                    if open_shard:
                        open_shard.finish()
                    open_shard = Shard(shard, shared.value[1], rows)
                open_shard.add(conv_id, path, n_words)
                yield from out(_BATCH)
        if open_shard:
            open_shard.finish()
            yield from out(1)

    dealt = paths.mapInArrow(deal, "conv_id long, path string, words array<long>, shard long")
    return dealt.repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(sweep, _OUT_SQL)


def _digests(parts: DataFrame) -> dict[int, str]:
    """The digest of each skeleton node's ending members; the parts of one node are streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []
        for batch in batches:
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if n != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = n, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
        if node is not None:
            done.append((node, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["node", "digest"])

    streamed = parts.repartition("node").sortWithinPartitions("node", "shard", "part").select("node", "ids").mapInArrow(run, "node long, digest string")
    return {r.node: r.digest for r in streamed.collect()}  # at most one row a skeleton node


def _finished(skeleton: Skeleton, sums: dict[int, tuple], digests: dict[int, str]) -> list[tuple]:
    """The skeleton nodes' rows, (node, conv_id, depth, ..): own terms are added upwards, as children have greater numbers."""
    count = len(skeleton.parent)
    children, leaves, saved = ([sums[n][k] for n in range(count)] for k in (2, 3, 4))
    more_leaves, more_saved = [0] * count, [0] * count
    for n in range(1, count):
        children[skeleton.parent[n]] += 1
    for n in range(count - 1, -1, -1):
        more_leaves[n] += not children[n]
        more_saved[n] += (sums[n][1] - 1) * sums[n][5]
        if n:
            more_leaves[skeleton.parent[n]] += more_leaves[n]
            more_saved[skeleton.parent[n]] += more_saved[n]
    return [
        (n, sums[n][0], skeleton.depth[n], sums[skeleton.parent[n]][0] if n else None, sums[n][1], children[n], leaves[n] + more_leaves[n], saved[n] + more_saved[n], digests.get(n, EMPTY))
        for n in range(count)
    ]


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    spark = conversations.sparkSession
    paths, _ = storage.materialise(rebuilt(conversations), "conversation-paths")
    cuts = splitters(paths, shard_turns)
    skeleton = Skeleton([path for path, _ in cuts])
    nodes, _ = storage.materialise(swept(paths, cuts, skeleton), "trie-nodes")
    partial = nodes.where("node IS NOT NULL AND ids IS NULL").groupBy("node").agg(F.min("conv_id"), *(F.sum(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("words"))
    sums = {r[0]: tuple(r)[1:] for r in partial.collect()}  # one row a skeleton node
    kinds = "n long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    done = _finished(skeleton, sums, _digests(nodes.where("ids IS NOT NULL"))) if sums else []
    upper, upper_path = storage.materialise(spark.createDataFrame(done, kinds), "trie-skeleton")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    names = upper.select("n", F.col("conv_id").alias("known"))
    names = F.broadcast(names) if storage.fits(names, upper_path, BROADCAST_BYTES) else names
    lower = nodes.where("node IS NULL").join(names, F.col("parent_node") == F.col("n"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "known"))
    return lower.select(*columns).union(upper.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the trie of all conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

SQL = rf"""
WITH own AS (
  SELECT conv_id AS c, list({{'k': md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')),
                              'w': len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))}} ORDER BY turn NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), whole AS (
  SELECT o.c, list_concat(coalesce(b.t, [])[1:h], o.t[h + 1:]) AS t
  FROM (SELECT *, ({_CRC.format("c")} % 4)::BIGINT AS h FROM own) o LEFT JOIN own b ON b.c = o.c - o.c % 20
), prefixes AS (
  SELECT c, d, len(t) AS n, md5(list_aggregate(list_transform(t[1:d], lambda x: x.k), 'string_agg', '')) AS node, coalesce(t[d].w, 0) AS w
  FROM whole, LATERAL (SELECT unnest(range(len(t) + 1)) AS d)
), placed AS (
  SELECT c, d, n, CASE WHEN d = 0 THEN '' ELSE node END AS node, CASE WHEN d = 0 THEN 0 ELSE w END AS w FROM prefixes
), nodes AS (
  SELECT node, d, min(c) AS c, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends
  FROM placed GROUP BY node, d
), edges AS (
  SELECT DISTINCT a.node AS parent, b.node AS child FROM placed a JOIN placed b ON a.c = b.c AND b.d = a.d + 1
), subtree AS (
  SELECT p.node, q.node AS below FROM nodes m JOIN placed p ON p.c = m.c AND p.d <= m.d JOIN (SELECT node, c, d FROM nodes) q ON q.c = m.c AND q.d = m.d AND q.node = m.node
), fanout AS (
  SELECT parent, count(*) AS n FROM edges GROUP BY parent
)
SELECT n.c AS conv_id, n.d AS depth, u.c AS parent_conv_id, n.n_convs, coalesce(f.n, 0) AS n_children,
       s.n_leaves, s.saved AS saved_tokens, n.ends AS ends_sha256
FROM nodes n
LEFT JOIN edges e ON e.child = n.node LEFT JOIN nodes u ON u.node = e.parent
LEFT JOIN fanout f ON f.parent = n.node
JOIN (SELECT t.node, count(*) FILTER (g.n IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.w)::BIGINT AS saved
      FROM subtree t JOIN nodes b ON b.node = t.below LEFT JOIN fanout g ON g.parent = b.node GROUP BY t.node) s ON s.node = n.node
"""
