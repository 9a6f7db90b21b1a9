"""N-gram Jaccard join and its components, with index lists that are skipped by position and by set relations.

1. A text is a set of word shingles, each a 64-bit hash. Equal sets are one set from then on.
2. Sets are ordered alike: shingles of the lower ``LOW`` share of hash space that are not frequent, then
   the rest of hash space, then the frequent ones. Two linked sets share a shingle among the first
   ``n - ceil(t n) + 1`` of both, so only those go to the index. Frequencies are counted over all sets;
   frequent shingles (passages that many texts share) come last, the more frequent the later, so they are
   hardly ever indexed.
3. Lists with one entry are left. A list's entries form blocks of one size and position, and whole blocks
   are skipped against each other where sizes, or what is left behind both positions, can't give the
   overlap needed. Long lists lie in cells of about ``CELL`` entries, so that none is one task's work.
4. Answers follow from set relations. Each list's pivot (the set in most lists) is compared with the
   list's other sets; those that link share the pivot's answer (its component, however it came to be),
   so no pair inside one component is compared again, and lists inside one component are dropped. First
   each block has a pivot of its own, then all blocks of a size, then the list as a whole ``PIVOTS``
   times, with pivots removed (they have met their whole list). The few remaining lists yield the pairs
   of blocks between different components. No link between components can be lost, as each pair of a
   list either met through a pivot, or is in one component, or is compared at the end.
5. Every comparison is exact, on whole sets.

Rows are told apart by a number of their own, given in the first written table; a row's text is found again
by doc_id and text hash. Null and empty texts, and texts of white space, have empty sets, which link with
nothing. Rows that share a doc_id count as one document: whatever their texts, they are linked, and each
row is returned. A row without a doc_id is a document of its own; a component is named by its smallest
doc_id, and null only if no row of it has one. An empty table gives no rows. Other columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import storage, tokens
from chronofold.llm.components import connected_components

WORDS = 4
PERCENT = 85
LOW = 0.22
#: From this many sets on, a shingle counts as frequent.
FREQUENT = 4
#: The most frequent shingles that are held apart; where there are more, the bar is raised. Results don't depend on it.
MOST_FREQUENT = 2_000_000
PIVOTS = 3
#: Parts of a list that have pivots of their own, in turn, before the list as a whole has some.
PARTS = (("s", "n", "pos"), ("s", "n"))
#: Entries of a list that lie in one cell, and partners of one set that are compared in one.
CELL, PARTNERS = 64, 256
#: Cells that are one where whole blocks of a list meet.
CELLS_OF_BLOCK = 8
#: Cells that the copies of one set are dealt to.
COPY_CELLS = 64
#: Tables up to this size in memory are broadcast.
BROADCAST_BYTES = 64 << 20
#: A set's row: its number, its doc_id and text hash, and whether that doc_id is null or has several rows.
KEY = ["rid", "k_doc", "k_h", "many"]
_LOW_LIMIT = np.uint64(int(LOW * 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (null: none)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), dtype=np.uint64, count=len(names))
    # Splitting leaves an empty word before leading and after trailing white space.
    real = np.fromiter(map(len, names), dtype=np.int64, count=len(names)) > 0
    where = coded.indices.to_numpy(zero_copy_only=False)
    flat, is_word = hashes[where], real[where]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        w = flat[a:b][is_word[a:b]]
        if not len(w):
            yield w
            continue
        size = min(words, len(w))
        h = np.full(len(w) - size + 1, size, np.uint64)
        for k in range(size):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k])
        h.sort()
        keep = np.ones(len(h), bool)
        keep[1:] = h[1:] != h[:-1]
        yield h[keep]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """uint64 arrays as a column of lists of signed longs."""
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def prefix_size(n: int, percent: int) -> int:
    """How many leading shingles of a set of n are enough to meet every linked set."""
    return n - -(-percent * n // 100) + 1


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def _summaries(docs: DataFrame, words: int) -> DataFrame:
    """rid (the row's number), doc_id, text hash, n, set hash (hi, lo) and the shingles of the lower part of hash space.

    The numbers hold once the table is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                n, digests, low = [], [], []
                for s in shingle_sets(part.column("text"), words):
                    n.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    low.append(s[: np.searchsorted(s, _LOW_LIMIT)])
                pairs = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                columns = [part.column("doc_id"), part.column("h"), pa.array(n, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), _lists(low)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n", "hi", "lo", "low"])

    out = _narrow(docs).mapInArrow(run, "doc_id long, h long, n int, hi long, lo long, low array<long>")
    return out.withColumn("rid", F.monotonically_increasing_id())


@dataclass
class Texts:
    """Where the texts are, and whether some doc_id is null or repeated (so that a row may be found several times)."""

    docs: DataFrame
    words: int
    repeated: bool

    def whole_sets(self, keys: DataFrame) -> DataFrame:
        """rid and the whole set of the rows in ``keys`` (rid, k_doc, k_h, many)."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tokens.slices(batch):
                    yield pa.RecordBatch.from_arrays([part.column("rid"), _lists(list(shingle_sets(part.column("text"), words)))], ["rid", "shingles"])

        narrow = _narrow(self.docs)
        found = narrow.join(keys, narrow.doc_id.eqNullSafe(keys.k_doc) & (narrow.h == keys.k_h)).select("rid", "text", "many")
        if self.repeated:
            found = found.where("NOT many").union(found.where("many").dropDuplicates(["rid"]))
        return found.select("rid", "text").mapInArrow(run, "rid long, shingles array<long>")


def _small(df: DataFrame, path: str) -> DataFrame:
    """The written table, marked for broadcast if it is small."""
    return F.broadcast(df) if storage.fits(df, path, BROADCAST_BYTES) else df


def _frequent(lists: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that FREQUENT or more sets of ``lists`` (a column of arrays) hold, at most MOST_FREQUENT, and each one's level.

    The level is the frequency's logarithm in quarters.
    """
    counts = lists.select(F.explode(lists.columns[0]).alias("s")).groupBy("s").count().where(F.col("count") >= FREQUENT)
    table, path = storage.materialise(counts, "frequent-shingles")
    bar, n = FREQUENT, table.count()
    while n > MOST_FREQUENT:
        bar *= 2
        n = table.where(F.col("count") >= bar).count()
    level = F.least(F.floor(4 * F.log2("count")), F.lit(255)).cast("short").alias("level")
    rows = table.where(F.col("count") >= bar).select("s", level).toPandas()
    storage.remove(lists.sparkSession, path)
    return _sorted(rows["s"].to_numpy(np.int64).view(np.uint64), rows["level"].to_numpy(np.uint8))


def _sorted(values: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    return values[order], levels[order]


def _among(values: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
    return frequent[at] == values


def _index(texts: Texts, unique: DataFrame, percent: int) -> DataFrame:
    """rid, n and the indexed shingles in order, for every distinct set.

    Most sets find theirs among the rare shingles of the lower part of hash space. The others (deep
    sets: small ones, and those made of what many texts share) are made whole, and the frequencies of their
    upper shingles, which only they reach, are counted over them.
    """
    spark = texts.docs.sparkSession
    low_frequent, low_levels = _frequent(unique.select("low"))
    shared = spark.sparkContext.broadcast(low_frequent)  # at most 16 MB

    def from_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            low = batch.column("low")
            flat = low.flatten().to_numpy().view(np.uint64)
            bounds = low.offsets.to_numpy() - low.offsets[0].as_py()
            rare = ~_among(flat, frequent)
            out = []
            for n, a, b in zip(batch.column("n").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                p = prefix_size(n, percent)
                first = flat[a:b][rare[a:b]][:p]
                out.append(first if len(first) == p else flat[:0])  # empty: the lower part isn't enough
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), batch.column("n"), _lists(out)], [*KEY, "n", "prefix"])

    schema = "rid long, n int, prefix array<long>"
    shallow, _ = storage.materialise(unique.select(*KEY, "n", "low").mapInArrow(from_low, "rid long, k_doc long, k_h long, many boolean, n int, prefix array<long>"), "prefixes")
    deep, deep_path = storage.materialise(shallow.where(F.size("prefix") == 0).select(*KEY), "deep-ids")
    whole, _ = storage.materialise(texts.whole_sets(_small(deep, deep_path)), "deep-sets")
    limit = int(_LOW_LIMIT.view(np.int64)) if _LOW_LIMIT < np.uint64(1 << 63) else None
    # As signed numbers, the upper part is what is negative or at least the limit.
    upper = F.filter("shingles", lambda s: (s < 0) | (s >= limit)) if limit is not None else F.filter("shingles", lambda s: s < 0)
    up_frequent, up_levels = _frequent(whole.select(upper.alias("upper")))
    # The two have no shingle in common; at most 36 MB.
    both = spark.sparkContext.broadcast(_sorted(np.concatenate((low_frequent, up_frequent)), np.concatenate((low_levels, up_levels))))

    def from_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, levels = both.value
        for batch in batches:
            n, out = [], []
            for value in batch.column("shingles"):
                s = value.values.to_numpy().view(np.uint64)
                often = _among(s, frequent)
                n.append(len(s))
                late = s[often]
                if len(late):
                    late = late[np.lexsort((late, levels[np.searchsorted(frequent, late)]))]
                out.append(np.concatenate((s[~often], late))[: prefix_size(len(s), percent)])
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(n, pa.int32()), _lists(out)], ["rid", "n", "prefix"])

    return shallow.where(F.size("prefix") > 0).select("rid", "n", "prefix").unionByName(whole.mapInArrow(from_whole, schema))


def _possible(n1: str, p1: str, n2: str, p2: str, percent: int) -> F.Column:
    """Whether sets of these sizes that first meet at these positions can link."""
    need = F.ceil(F.lit(percent) * (F.col(n1) + F.col(n2)) / F.lit(100 + percent) - F.lit(1e-9))
    room = F.lit(1) + F.least(F.col(n1) - F.col(p1) - 1, F.col(n2) - F.col(p2) - 1)
    sizes = (F.lit(100) * F.least(n1, n2)) >= (F.lit(percent) * F.greatest(n1, n2))
    return sizes & (room >= need)


def _verified(texts: Texts, keys: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. Only sets of documents that are in a pair are made."""
    pairs, pairs_path = storage.materialise(pairs, "set-pairs")
    ids, ids_path = storage.materialise(keys.join(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct(), "rid"), "pair-ids")
    sets, sets_path = storage.materialise(texts.whole_sets(_small(ids, ids_path)), "pair-sets")
    # A pivot may have any number of partners; they meet copies of its set, one for each PARTNERS of them.
    copies = F.ceil(F.col("count") / PARTNERS).cast("int").alias("copies")
    fits = storage.fits(pairs, pairs_path, BROADCAST_BYTES)
    hot, hot_path = storage.materialise(pairs.groupBy("b").count().where(F.col("count") > PARTNERS).select("b", copies), "hot-sets")
    hot = _small(hot, hot_path)
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"))
    left = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y")).join(hot, "b", "left")
    right = right.select("b", "y", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    joined = left.join(F.broadcast(dealt) if fits else dealt, "a").join(right, ["b", "copy"])
    found, _ = storage.materialise(joined.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"), "set-links")
    for path in (pairs_path, ids_path, sets_path, hot_path):
        storage.remove(texts.docs.sparkSession, path)
    return found


def links(texts: Texts, unique: DataFrame, percent: int) -> DataFrame:
    """rid and component of every set that links with another one."""
    spark = texts.docs.sparkSession
    indexed, indexed_path = storage.materialise(_index(texts, unique, percent), "index")
    entries = indexed.select("rid", "n", F.posexplode("prefix").alias("pos", "s"))
    cells = F.ceil(F.col("count") / CELL).cast("int").alias("cells")
    lists, lists_path = storage.materialise(entries.groupBy("s").count().where("count > 1").select("s", cells), "index-lists")
    celled = entries.join(_small(lists, lists_path), "s").withColumn("cell", F.pmod(F.xxhash64("rid"), F.col("cells")).cast("int")).drop("cells")
    active, active_path = storage.materialise(celled, "index-entries")
    for path in (indexed_path, lists_path):
        storage.remove(spark, path)
    ids, _ = storage.materialise(unique.select(*KEY).join(active.select("rid").distinct(), "rid"), "index-ids")
    in_lists, in_lists_path = storage.materialise(active.groupBy("rid").agg(F.count(F.lit(1)).alias("lists")), "index-counts")
    active, next_path = storage.materialise(active.join(_small(in_lists, in_lists_path), "rid"), "index-entries")
    for path in (active_path, in_lists_path):
        storage.remove(spark, path)
    active_path = next_path
    component, component_path = storage.materialise(ids.select("rid", F.col("rid").alias("component")), "set-components")
    component = _small(component, component_path)

    def merge(found: DataFrame, component: DataFrame) -> DataFrame:
        """Components after these links."""
        if not found.limit(1).count():
            return component
        c1, c2 = component.select(F.col("rid").alias("a"), F.col("component").alias("ca")), component.select(F.col("rid").alias("b"), F.col("component").alias("cb"))
        contracted = found.join(c1, "a").join(c2, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = connected_components(contracted).select(F.col("v").alias("component"), F.col("component").alias("merged"))
        joined = component.join(merged, "component", "left").select("rid", F.coalesce("merged", "component").alias("component"))
        return _small(*storage.materialise(joined, "set-components"))

    def meetings(parts: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
        """Entries beside the pivot of their part of a list, and the pairs of them that can link."""
        # The set in most lists is nearest to the middle of its group. A cell's best comes first, so that no list is one group.
        in_cells = active.groupBy(*parts, "cell").agg(F.max(F.struct("lists", (-F.col("rid")).alias("order"), "rid", "n", "pos")).alias("p"))
        best = in_cells.groupBy(*parts).agg(F.max("p").alias("p"))
        pivots = in_cells.select(*parts, "cell").join(best, list(parts)).select(*(F.col(k).alias(f"p_{k}") for k in (*parts, "cell")), F.col("p.rid").alias("b"), F.col("p.n").alias("bn"), F.col("p.pos").alias("bpos"))
        same = [F.col(k) == F.col(f"p_{k}") for k in (*parts, "cell")]
        met = active.join(pivots, same).where("rid <> b")
        return met, met.where(_possible("n", "pos", "bn", "bpos", percent)).select(F.col("rid").alias("a"), "b").distinct()

    def unsettled(entries: DataFrame) -> tuple[DataFrame, str]:
        """The entries of lists that still reach over several components."""
        rest = entries.select("s", "cell", "rid", "n", "pos", "lists").join(component, "rid")
        in_cells = rest.groupBy("s", "cell").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
        split = in_cells.groupBy("s").agg(F.min("c1").alias("c1"), F.max("c2").alias("c2")).where("c1 <> c2").select("s")
        out = storage.materialise(rest.join(in_cells.select("s", "cell").join(split, "s"), ["s", "cell"]).drop("component"), "index-entries")
        storage.remove(spark, active_path)
        return out

    # Each part of a list first, then the list as a whole, whose pivots have met all of it and go.
    for parts, again in [*((parts, True) for parts in PARTS), *((("s",), False) for _ in range(PIVOTS))]:
        if not active.limit(1).count():
            return component
        met, pairs = meetings(parts)
        component = merge(_verified(texts, ids, pairs, percent), component)
        active, active_path = unsettled(active if again else met)
    if not active.limit(1).count():
        return component
    return merge(_verified(texts, ids, block_pairs(active.join(component, "rid"), percent), percent), component)


def block_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of entries (s, cell, n, pos, rid, component) of one list and different components that can link.

    Blocks of one size and position meet first, and whole pairs of blocks are skipped.
    """
    block = ["s", "n", "pos", "cell"]
    entries = entries.withColumn("cell", F.floor(F.col("cell") / CELLS_OF_BLOCK).cast("int"))
    entries, _ = storage.materialise(entries.select(*block, "rid", "component"), "block-entries")
    blocks, _ = storage.materialise(entries.groupBy(*block).agg(F.min("component").alias("c1"), F.max("component").alias("c2")), "blocks")
    # The other side of a block comes to each cell of the list.
    other = blocks.select("s", F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("cell").alias("cell2"), F.col("c2").alias("d2")).join(blocks.select("s", "cell").distinct(), "s")
    meeting = blocks.join(other, ["s", "cell"]).where((F.col("c1") < F.col("d2")) & _possible("n", "pos", "n2", "pos2", percent)).select(*block, "n2", "pos2", "cell2")
    partners = entries.select("s", F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("cell").alias("cell2"), F.col("rid").alias("b"), F.col("component").alias("bc"))
    pairs = entries.join(meeting, block).join(partners, ["s", "n2", "pos2", "cell2"]).where(F.col("component") < F.col("bc"))
    return pairs.select(F.col("rid").alias("a"), "b").distinct()


def _grouped(docs: DataFrame, words: int, percent: int, documents: bool) -> tuple[DataFrame, DataFrame]:
    """All rows (rid, doc_id, h, n), and rid and component of those that are in one with other rows.

    With ``documents``, all rows of a doc_id are linked. Without, only those of them that have no words are, so
    that different texts of a doc_id meet through what they say alone.
    """
    summaries, _ = storage.materialise(_summaries(docs, words), "shingle-summaries")
    rows = summaries.select("rid", "doc_id", "h", "n")
    repeated, repeated_path = storage.materialise(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")), "repeated-ids")
    any_repeated = bool(repeated.limit(1).count())
    some = summaries.where("n > 0")
    # Copies of one set lie in cells, so that a large group of them is no one task's work.
    celled = some.select("rid", "hi", "lo", "n", F.pmod(F.xxhash64("rid"), F.lit(COPY_CELLS)).cast("int").alias("cell"))
    in_cells = celled.groupBy("hi", "lo", "n", "cell").agg(F.min("rid").alias("set"), F.count(F.lit(1)).alias("rows"))
    equal = in_cells.groupBy("hi", "lo", "n").agg(F.min("set").alias("set"), F.sum("rows").alias("rows")).where("rows > 1").drop("rows")
    known_cells = in_cells.select("hi", "lo", "n", "cell").join(equal, ["hi", "lo", "n"])
    copies, copies_path = storage.materialise(celled.join(known_cells, ["hi", "lo", "n", "cell"]).where("rid <> set").select("rid", "set"), "equal-sets")
    small_copies = _small(copies.select(F.col("rid").alias("copy")), copies_path)
    unique = some.join(small_copies, F.col("rid") == F.col("copy"), "left_anti").select("rid", F.col("doc_id").alias("k_doc"), F.col("h").alias("k_h"), "n", "low")
    many = F.col("k_doc").isNull()
    if any_repeated:
        unique = unique.join(_small(repeated, repeated_path), F.col("k_doc") == F.col("again"), "left")
        many = many | F.col("again").isNotNull()
    texts = Texts(docs, words, any_repeated or bool(rows.where("doc_id IS NULL").limit(1).count()))
    component = links(texts, unique.select("rid", "k_doc", "k_h", many.alias("many"), "n", "low"), percent)
    of_copies = copies.join(component.select(F.col("rid").alias("set"), F.col("component").alias("c")), "set", "left").select("rid", F.coalesce("c", "set").alias("c"))
    behind, _ = storage.materialise(of_copies.union(component.where("rid <> component").select("rid", F.col("component").alias("c"))), "grouped-rows")
    known = behind.union(behind.select(F.col("c").alias("rid"), "c").distinct())
    if any_repeated:
        mine = rows.join(_small(repeated, repeated_path), F.col("doc_id") == F.col("again"), "left_semi").join(known, "rid", "left")
        mine, _ = storage.materialise(mine.select("rid", "doc_id", "n", F.coalesce("c", "rid").alias("c")), "repeated-rows")
        first = mine.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("n") > 0, F.col("c"))), F.min("c")).alias("b"))
        explicit = mine.where(F.lit(documents) | (F.col("n") == 0)).join(first, "doc_id").select(F.col("c").alias("a"), "b").where("a <> b").distinct()
        merged = connected_components(explicit).select(F.col("v").alias("c"), F.col("component").alias("merged"))
        known = known.union(mine.select("rid", "c")).distinct().join(merged, "c", "left").select("rid", F.coalesce("merged", "c").alias("c"))
    return rows, storage.materialise(known, "row-components")[0]


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, known = _grouped(docs, words, percent, True)
    names = known.join(rows.select("rid", "doc_id"), "rid").groupBy("c").agg(F.min("doc_id").alias("name"))
    named, named_path = storage.materialise(known.join(names, "c").select("rid", "name", F.lit(True).alias("grouped")), "doc-components")
    out = rows.join(_small(named, named_path), "rid", "left")
    component = F.when(F.col("grouped"), F.col("name")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row, with all its columns, of each group of linked texts: that of the smallest doc_id, or without one if all are.

    A doc_id with different texts keeps each that has no group with a smaller doc_id.
    """
    rows, known = _grouped(docs, words, percent, False)
    members = known.join(rows, "rid")
    rank = F.struct(F.col("doc_id").isNull().alias("k0"), "doc_id", (F.col("n") == 0).alias("k1"), "h", "rid")
    best = members.groupBy("c").agg(F.min(rank).alias("best")).select("c", F.col("best.rid").alias("kept"))
    # Rows of one doc_id and text are in one group: all of them go, or one stays.
    keys = members.join(best, "c").groupBy(F.col("doc_id").alias("_key_doc"), F.col("h").alias("_key_hash")).agg(F.max(F.col("rid") == F.col("kept")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    changed, path = storage.materialise(keys.where("NOT stays OR rows > 1"), "changed-keys")
    keys = _small(changed, path).select("_key_doc", "_key_hash")

    def same(keys: DataFrame) -> F.Column:
        return docs["doc_id"].cast("long").eqNullSafe(keys["_key_doc"]) & (F.xxhash64(docs["text"].cast("string")) == keys["_key_hash"])

    out = docs.join(keys, same(keys), "left_anti")
    if changed.where("stays").limit(1).count():
        # Only then is there a shuffle of texts.
        one = _small(changed.where("stays"), path).select("_key_doc", "_key_hash")
        out = out.union(docs.join(one, same(one)).dropDuplicates(["_key_doc", "_key_hash"]).drop("_key_doc", "_key_hash"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: components of all documents, 4-word shingles, similarity 0.85."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                      WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM worded
), sized AS (
  SELECT doc_id, len(s)::BIGINT AS n FROM shingled
), flat AS (
  SELECT doc_id, unnest(s) AS g FROM shingled
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sized na ON na.doc_id = a.doc_id JOIN sized nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, s.n AS n_shingles, r.c AS component_id
FROM sized s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = s.doc_id
"""
