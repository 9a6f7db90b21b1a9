"""Merkle manifest of a dataset, built and proven by time-forward processing.

Each row is a leaf, the hash of its columns. The leaves of one ``lang``, in order of doc_id, are a tree of
fan-out 2 whose last run may be short (one node alone is hashed again); subroots in order of lang are the
leaves of the top tree.

A node's label is (the last leaf position that it covers, its level), so children come before their parent and
labels ascend as leaves are read in order. The forward sweep is one pass over sorted leaves: each node sends
its digest to its parent's label, a priority queue orders what is under way, and a node is made when its label
is the least. The reversed sweep reads nodes and leaves by descending label; each node passes on the proof
it got and its other child's digest, and leaves fold what reaches them. Either queue holds what crosses one
place of the order, a few entries a level, whatever the tree's size.

Trees are cut into blocks of ``2 ** LEVELS`` leaves, each swept by one task in one streamed run. Spark's sorted
exchange is the queue's external part: the roots of blocks are the leaves of the next stratum, and the last
stratum of a tree has one block. Then the sweeps go back, stratum by stratum. Positions are counts: leaves are
range-sorted by (lang, doc_id, leaf, row), numbered within their range, and ranges begin where those before
them end. So a language that holds most rows, a doc_id or a row that repeats any number of times, and any
number of languages spread over tasks alike. The driver holds the root alone.

A null column counts as ``-``, an empty text as ``0:``. A null lang is a tree of its own and the first; null doc_ids
come first in their tree and are not tampered with. Rows of one doc_id are ordered by their leaves; equal rows
are leaves of their own side by side, with proofs of their own. An empty table gives no rows. Other columns are left aside.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm import storage

#: Levels of a tree that one block covers.
LEVELS = 12
#: Rows of a range while leaves are put in order, and the most blocks' worth of rows that one partition is meant to get.
RANGE_ROWS = 200_000
#: Tables up to this size in memory are broadcast.
BROADCAST_BYTES = 64 << 20
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: One of this many documents is tampered with in the query.
TAMPER_MODULUS = 7
_BATCH = 8192


def _small(table: DataFrame, path: str) -> DataFrame:
    return F.broadcast(table) if storage.fits(table, path, BROADCAST_BYTES) else table


def framed(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**columns: Column) -> Column:
    """The leaf of a row with these columns."""
    return F.sha2(F.concat(*(framed(columns[c]) for c in COLUMNS)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf, and the leaf after tampering (null where there is none) of each row, with a number of its own."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    of = {c: F.col(c).cast(kinds.get(c, "string")) for c in COLUMNS}
    chosen = F.crc32(of["doc_id"].cast("string").cast("binary")) % TAMPER_MODULUS == 0
    more = of["n_chars"].cast("decimal(20,0)") + 1
    rows = docs.select(of["lang"].alias("g"), of["doc_id"].alias("doc_id"), leaf_hash(**of).alias("digest"), F.when(chosen, leaf_hash(**{**of, "n_chars": more})).alias("tampered"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their position in group ``g`` (in ascending order of ``order``) and the group's size ``n``, as a written table."""
    spark = rows.sparkSession
    parts = max(1, min(rows.count() // RANGE_ROWS + 1, 100_000), int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id()
    ordered, ordered_path = storage.materialise(rows.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order).withColumn("place", place), f"{name}-ordered")
    # The upper bits of a place are its range's number: ranges ascend, and so do the rows of each.
    at = F.shiftright("place", 33)
    runs = ordered.groupBy("g", at.alias("range")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("g").alias("run_g"), "range", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("g")).alias("n"))
    runs, runs_path = storage.materialise(runs, f"{name}-runs")
    joined = ordered.join(_small(runs, runs_path), ordered.g.eqNullSafe(runs.run_g) & (at == runs.range))
    out, _ = storage.materialise(joined.select(*(c for c in ordered.columns if c != "place"), (F.col("place") + F.col("shift")).alias("pos"), "n"), name)
    storage.remove(spark, ordered_path)
    storage.remove(spark, runs_path)
    return out


def height(n: int) -> int:
    """Levels above the leaves of a tree with n leaves."""
    return (n - 1).bit_length()


def _end(level: int, index: int, size: int) -> int:
    return min((index + 1) << level, size) - 1


def _join_hash(first: str, second: str | None) -> str:
    return hashlib.sha256((first + (second or "")).encode()).hexdigest()


@dataclass
class Stratum:
    """One layer of blocks: its leaves (g, pos, n, digest, ..) and the nodes inside its blocks."""

    leaves: DataFrame
    nodes: DataFrame


def _block_size(n: int, block: int, levels: int) -> tuple[int, int]:
    """Leaves of a block and levels above them: all levels if the tree has further blocks."""
    size = min(1 << levels, n - (block << levels))
    return size, levels if n > 1 << levels else height(n)


def _forward(rows: DataFrame, levels: int) -> DataFrame:
    """The nodes of all blocks (g, block, n, end, level, index, a, b); a block's root is marked by ``digest``."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, queue, size, top = None, [], 0, 0
        for batch in batches:
            for g, block, pos, n, digest in zip(*(batch.column(c).to_pylist() for c in ("g", "block", "pos", "n", "digest")), strict=True):
                if (g, block) != key:
                    key, queue = (g, block), []
                    size, top = _block_size(n, block, levels)
                at = pos - (block << levels)
                if top == 0:
                    out.append((g, block, n, 0, 0, 0, None, None, digest))
                else:
                    heapq.heappush(queue, (_end(1, at >> 1, size), 1, at, digest))
                while queue and queue[0][0] == at:
                    end, level, index, a = heapq.heappop(queue)
                    b = heapq.heappop(queue)[3] if queue and queue[0][:2] == (end, level) else None
                    made, index = _join_hash(a, b), index >> 1
                    out.append((g, block, n, end, level, index, a, b, made if level == top else None))
                    if level < top:
                        heapq.heappush(queue, (_end(level + 1, index >> 1, size), level + 1, index, made))
            if len(out) >= _BATCH:
                yield _batch(out, _NODE)
                out = []
        if out:
            yield _batch(out, _NODE)

    return rows.select("g", F.shiftright("pos", levels).alias("block"), "pos", "n", "digest").repartition("g", "block").sortWithinPartitions("g", "block", "pos").mapInArrow(sweep, _sql(_NODE))


_NODE = pa.schema([("g", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("end", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("digest", pa.string())])
_PASSED = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("proof", pa.string()), ("subroot", pa.string())])
_PROVEN = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


#: A proof is a chain (side, sibling, the rest above). As text, each step is its side and its sibling's digest.
_ALONE, _LEFT, _RIGHT = "S", "L", "R"


def proof_text(chain: tuple | None) -> str:
    out = []
    while chain:
        side, sibling, chain = chain
        out.append(side + sibling)
    return "".join(out)


def proof_chain(text: str) -> tuple | None:
    steps, at = [], 0
    while at < len(text):
        wide = 1 if text[at] == _ALONE else 65
        steps.append((text[at], text[at + 1 : at + wide]))
        at += wide
    chain = None
    for side, sibling in reversed(steps):
        chain = (side, sibling, chain)
    return chain


def fold(digest: str, chain: tuple | None) -> tuple[str, str]:
    """The root that a digest and its proof lead to, and the hash of the proof's siblings."""
    siblings = hashlib.sha256()
    while chain:
        side, sibling, chain = chain
        siblings.update(sibling.encode())
        digest = _join_hash(sibling, digest) if side == _LEFT else _join_hash(digest, sibling)
    return digest, siblings.hexdigest()


def _backward(stratum: Stratum, above: DataFrame, levels: int, final: bool) -> DataFrame:
    """What reaches the stratum's leaves, given ``above`` (g, block, proof, subroot) of its blocks: proofs to pass on, or those folded."""
    top = above.select("g", "block", F.lit(None).cast("long").alias("n"), F.lit(1 << 62).alias("end"), F.lit(99).alias("level"), F.lit(0).cast("long").alias("index"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), "proof", "subroot", F.lit(None).cast("long").alias("doc_id"))
    none = [F.lit(None).cast("string").alias(c) for c in ("proof", "subroot")]
    nodes = stratum.nodes.where("level > 0").select("g", "block", "n", "end", "level", "index", "a", "b", *none, F.lit(None).cast("long").alias("doc_id"))
    local = F.col("pos") - F.shiftleft(F.shiftright("pos", levels), levels)
    more = ["tampered", "doc_id"] if final else [F.lit(None).cast("string"), F.lit(None).cast("long")]
    rows = stratum.leaves.select("g", F.shiftright("pos", levels).alias("block"), "n", local.alias("end"), F.lit(0).alias("level"), local.alias("index"), F.col("digest").alias("a"), F.col(more[0]).alias("b") if final else more[0].alias("b"), *none, F.col("doc_id") if final else more[1].alias("doc_id"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        queue: list[tuple] = []
        size, proof, subroot = None, None, None
        for batch in batches:
            for g, block, n, end, level, index, a, b, text, sub, doc_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if level == 99:
                    proof, subroot, size = proof_chain(text), sub, None
                    continue
                if size is None:
                    size, height_above = _block_size(n, block, levels)
                    queue = [(-_end(height_above, 0, size), -height_above, proof)]
                if queue[0][:2] != (-end, -level):
                    raise ValueError(f"no proof reaches node {(g, block, end, level)}")
                mine = heapq.heappop(queue)[2]
                if level:
                    left, right = 2 * index, 2 * index + 1
                    heapq.heappush(queue, (-_end(level - 1, left, size), 1 - level, (_ALONE, "", mine) if b is None else (_RIGHT, b, mine)))
                    if b is not None:
                        heapq.heappush(queue, (-_end(level - 1, right, size), 1 - level, (_LEFT, a, mine)))
                elif final:
                    folded, siblings = fold(a if b is None else b, mine)
                    out.append((doc_id, a, subroot, siblings, folded))
                else:
                    out.append((g, (block << levels) + index, proof_text(mine), a if subroot is None else subroot))
            if len(out) >= _BATCH:
                yield _batch(out, _PROVEN if final else _PASSED)
                out = []
        if out:
            yield _batch(out, _PROVEN if final else _PASSED)

    everything = top.union(nodes).union(rows).repartition("g", "block").sortWithinPartitions("g", "block", F.desc("end"), F.desc("level"))
    return everything.mapInArrow(sweep, _sql(_PROVEN if final else _PASSED))


def _up(rows: DataFrame, levels: int, name: str) -> tuple[list[Stratum], DataFrame]:
    """The strata over leaves (g, pos, n, digest), lowest first, and the root of each g."""
    strata, roots = [], None
    while True:
        nodes, _ = storage.materialise(_forward(rows, levels), f"{name}-nodes")
        strata.append(Stratum(rows, nodes))
        made = nodes.where("digest IS NOT NULL").select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(float(1 << levels))).cast("long").alias("n"), "digest")
        done = made.where("n = 1").select("g", "digest")
        roots = done if roots is None else roots.union(done)
        if not made.where("n > 1").limit(1).count():
            return strata, roots
        rows, _ = storage.materialise(made.where("n > 1"), f"{name}-strata")


def _down(strata: list[Stratum], above: DataFrame, levels: int, final: bool, name: str) -> DataFrame:
    """What reaches the lowest leaves from ``above`` (g, proof, subroot), what each tree's root has above itself."""
    arrived = None
    for k in range(len(strata) - 1, -1, -1):
        stratum = strata[k]
        # A tree whose last stratum this is gets its proof from above; the others' blocks were leaves one stratum up.
        ends = stratum.leaves.where(F.col("n") <= 1 << levels).select("g").distinct().withColumnRenamed("g", "end_g")
        mine = above.join(ends, F.col("g").eqNullSafe(F.col("end_g"))).select("g", F.lit(0).cast("long").alias("block"), "proof", "subroot")
        if arrived is not None:
            mine = mine.union(arrived.select("g", F.col("pos").alias("block"), "proof", "subroot"))
        swept = _backward(stratum, mine, levels, final and k == 0)
        if final and k == 0:
            return swept
        arrived, _ = storage.materialise(swept, f"{name}-passed")
    return arrived


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row."""
    rows, rows_path = storage.materialise(leaves(docs), "merkle-leaves")
    placed = numbered(rows, ["doc_id", "digest", "row"], "merkle-placed")
    storage.remove(docs.sparkSession, rows_path)
    strata, subroots = _up(placed, levels, "merkle")
    # The top tree: one group, whose leaves are the subroots in order of lang.
    langs, _ = storage.materialise(subroots.select(F.lit(None).cast("string").alias("g"), F.col("g").alias("lang"), "digest"), "merkle-subroots")
    top = numbered(langs, ["lang"], "merkle-langs")
    top_strata, roots = _up(top, levels, "merkle-top")
    found = roots.first()
    root = F.lit(found.digest if found else None).cast("string")
    start = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("g"), F.lit("").alias("proof"), F.lit(None).cast("string").alias("subroot"))
    passed = _down(top_strata, start, levels, False, "merkle-top")
    known = top.select("pos", F.col("lang").alias("g"))
    above, _ = storage.materialise(passed.select("pos", "proof", "subroot").join(known, "pos").select("g", "proof", "subroot"), "merkle-above")
    proven = _down(strata, above, levels, True, "merkle")
    return proven.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", F.col("folded_root").eqNullSafe(root).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: leaves, roots and proofs of all documents, one in seven of them tampered with."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_FRAMED = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FRAMED.format(n_chars if c == "n_chars" else c) for c in COLUMNS) + ")"


SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN {_CRC.format("doc_id")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS tampered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM leaves
), low AS (
  SELECT tree, 0 AS level, pos AS i, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, i // 2
), subroots AS (
  SELECT tree, level AS height, digest FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, tree AS i, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY i // 2
), whole AS (
  SELECT digest AS root, level AS height FROM high WHERE n = 1
), steps AS (
  SELECT p.tree, p.pos, l.level AS step, p.pos >> l.level AS i, s.digest AS sibling
  FROM placed p JOIN subroots t USING (tree) JOIN (SELECT DISTINCT tree, level FROM low) l ON l.tree = p.tree AND l.level < t.height
  LEFT JOIN low s ON s.tree = p.tree AND s.level = l.level AND s.i = xor(p.pos >> l.level, 1)
  UNION ALL
  SELECT p.tree, p.pos, t.height + l.level, p.tree >> l.level, s.digest
  FROM placed p JOIN subroots t USING (tree) JOIN (SELECT DISTINCT level FROM high) l ON l.level < (SELECT height FROM whole)
  LEFT JOIN high s ON s.level = l.level AND s.i = xor(p.tree >> l.level, 1)
), folds AS (
  SELECT tree, pos, 0 AS step, coalesce(tampered, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.step + 1, sha256(CASE WHEN s.i % 2 = 1 THEN s.sibling || f.digest ELSE f.digest || coalesce(s.sibling, '') END)
  FROM folds f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.step = f.step
), proofs AS (
  SELECT tree, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY tree, pos
)
SELECT p.doc_id, p.leaf, t.digest AS subroot, w.root, coalesce(o.proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = w.root AS verified
FROM placed p JOIN subroots t USING (tree) CROSS JOIN whole w
JOIN folds f ON f.tree = p.tree AND f.pos = p.pos AND f.step = t.height + w.height
LEFT JOIN proofs o ON o.tree = p.tree AND o.pos = p.pos
"""
