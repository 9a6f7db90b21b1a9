"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Fitting: at most ``SAMPLE`` distinct vectors, those of smallest hash, are clustered on the driver into
coarse centroids and, on the residuals, into a codebook for each group of dimensions. How many lists a
query probes is measured there too: the fewest that hold ``TARGET_RECALL`` of the true neighbours of
``CALIBRATION`` sample vectors within the sample (few on clustered vectors, many on spread ones; nearer
neighbours of the whole table are in nearer lists, so this errs to the safe side). Indexing: every
distinct vector goes to its nearest centroid's list and keeps one byte a group. Searching: a query
probes its nearest lists until it has ``probes`` of them and enough vectors; a list meets its queries
in blocks of ``BLOCK`` vectors, and each block returns its best by asymmetric distance (table
look-ups of the exact query residual against the codebook). The best of all lists are ranked again by
exact distance in double precision on the original vectors. How many is measured on the sample as well,
and grows with the table; ``RERANK`` is the least.

Queries needn't be spread as the table is, and a table's rare parts are hardly in a sample. So at most
``MEASURED`` of the real queries are answered by brute force over all rows, and by the index: while it
finds less than ``LEAST_RECALL`` of their true neighbours, lists probed and shortlist are doubled, at last
to all there are. Centroids and codes see vectors shifted by the sample's median and scaled by its spread,
so that vectors far from 0 lose no digits; exact distances are of the original ones.

Equal vectors are one entry of the index with the smallest ``k + 1`` of their ids, which is all that a
result can show of them; equal queries are searched once. So a vector that a third of all rows share
is one entry and one search, and an uneven list is as many blocks as its size needs.

Vectors that are null, all zero, or hold a null or a non-finite component take no part, nor do those
whose length isn't the most frequent one (the shorter, if two are as frequent). Rows without an id
take no part. Rows that repeat id and vector count once; a query's own id is never its result. With
fewer than k candidates all are returned. Ties go to the smaller id. No valid vectors give no rows.
Other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm import storage

#: The most vectors that centroids and codebooks are fitted on.
SAMPLE = 20_000
#: Vectors a list is meant to hold, and the most lists.
LIST_VECTORS, MOST_LISTS = 256, 4096
GROUPS = 16
CODES = 256
#: Share of a sample vector's true neighbours, within the sample, whose lists are to be probed.
TARGET_RECALL, CALIBRATION = 0.97, 512
#: Lists are probed until they hold this many vectors at least.
LEAST_SEEN = 2048
#: The shortest shortlist for exact distances.
RERANK = 200
BLOCK = 20_000
QUERY_BLOCK = 256
#: Queries of a list that are searched in one group.
QUERY_PART = 20_000
#: Share of a sample vector's true neighbours that the codes' shortlist is to hold.
SHORTLIST_RECALL = 0.99
#: Queries that are answered by brute force too, and the share of their true neighbours that the index must find.
MEASURED, LEAST_RECALL = 128, 0.95
#: Shifted and scaled components beyond this count as it, so that no square is infinite.
FARTHEST = 1e100
K = 10


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of a to each row of b."""
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :])


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """At most k centroids; empty ones move to the points farthest from theirs."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, far = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), 4096):
            d = squared(x[at : at + 4096], centres)
            near[at : at + 4096] = d.argmin(1)
            far[at : at + 4096] = d.min(1)
        size = np.bincount(near, minlength=k)
        sums = np.column_stack([np.bincount(near, weights=c, minlength=k) for c in x.T])
        full = size > 0
        centres[full] = sums[full] / size[full, None]
        if not full.all():
            centres[~full] = x[np.argsort(-far, kind="stable")[: int((~full).sum())]]
    return centres


@dataclass
class Quantiser:
    """Coarse centroids and, for each group of dimensions, a codebook of residuals; ``seen`` makes vectors what these are fitted on."""

    centres: np.ndarray
    bounds: list[tuple[int, int]]
    books: list[np.ndarray]
    shift: np.ndarray | float = 0.0
    scale: float = 1.0

    def seen(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip((x - self.shift) / self.scale, -FARTHEST, FARTHEST)

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, groups: int = GROUPS, seed: int = 11) -> "Quantiser":
        centres = kmeans(x, lists, seed)
        residual = x - centres[squared(x, centres).argmin(1)]
        cuts = np.linspace(0, x.shape[1], min(groups, x.shape[1]) + 1).astype(int)
        bounds = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return cls(centres, bounds, [kmeans(residual[:, a:b], CODES, seed + 1 + g) for g, (a, b) in enumerate(bounds)])

    def probes(self, x: np.ndarray, k: int, target: float = TARGET_RECALL, queries: int = CALIBRATION) -> int:
        """The fewest lists whose probing meets ``target`` of the k nearest, among x, of its first rows."""
        if len(x) <= k:
            return len(self.centres)
        lists, some = self.assign(x), x[:queries]
        d = squared(some, x)
        d[np.arange(len(some)), np.arange(len(some))] = np.inf
        nearest = np.argpartition(d, k - 1, axis=1)[:, :k]
        order = squared(some, self.centres).argsort(1, kind="stable").argsort(1)
        met = np.take_along_axis(order, lists[nearest], axis=1)
        return 1 + int(np.quantile(met, target, method="higher"))

    def shortlist(self, x: np.ndarray, k: int, total: int, target: float = SHORTLIST_RECALL, queries: int = CALIBRATION) -> int:
        """How many of ``total`` vectors, best by codes, hold ``target`` of the k nearest, judged on a sample x of them.

        The k nearest of all are about the k * len(x) / total nearest of the sample, and each vector that
        the codes put before one of those stands for total / len(x) vectors.
        """
        if len(x) <= k:
            return RERANK
        lists, growth = self.assign(x), max(1.0, total / len(x))
        codes = self.encode(x, lists)
        seen = self.centres[lists] + np.column_stack([book[codes[:, g]] for g, book in enumerate(self.books)])
        depth, places = max(1, round(k / growth)), []
        for at in range(0, min(queries, len(x)), 64):
            some = x[at : min(at + 64, queries)]
            own = (np.arange(len(some)), at + np.arange(len(some)))
            d, coded = squared(some, x), squared(some, seen)
            d[own] = coded[own] = np.inf
            nearest = np.argpartition(d, depth - 1, axis=1)[:, :depth]
            places.append((coded[:, None, :] <= np.take_along_axis(coded, nearest, axis=1)[:, :, None]).sum(2).ravel())
        return max(RERANK, int(np.ceil(growth * np.quantile(np.concatenate(places), target, method="higher"))))

    def assign(self, x: np.ndarray) -> np.ndarray:
        return squared(x, self.centres).argmin(1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual = x - self.centres[lists]
        return np.column_stack([squared(residual[:, a:b], book).argmin(1) for (a, b), book in zip(self.bounds, self.books, strict=True)]).astype(np.uint8)

    def tables(self, query: np.ndarray, which: int) -> np.ndarray:
        """Squared distances of each query's residual to every code: queries x groups x codes."""
        residual = query - self.centres[which]
        out = np.full((len(query), len(self.bounds), CODES), np.inf)
        for g, ((a, b), book) in enumerate(zip(self.bounds, self.books, strict=True)):
            out[:, g, : len(book)] = squared(residual[:, a:b], book)
        return out


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (length.n if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, probes: int | None = None, rerank: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest found.

    ``vectors`` and ``queries`` have columns vec_id and embedding.
    """
    spark = vectors.sparkSession
    rows, _ = storage.materialise(_valid(vectors), "vectors")
    # The first k + 1 ids of each distinct vector. Repeated rows go first, before and after a shuffle, so that
    # none takes another id's place; the limit on places works before its shuffle too, so copies don't travel.
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    distinct, distinct_path = storage.materialise(first.groupBy("v").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids")).withColumn("uid", F.col("ids")[0]), "distinct-vectors")
    total = distinct.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    fitted = np.array([r.v for r in distinct.orderBy(F.xxhash64("v"), "uid").limit(sample).select("v").collect()])
    shift = np.median(fitted, axis=0)
    spread = np.abs(fitted - shift).max(1)
    scale = float(np.median(spread)) or float(spread.max()) or 1.0
    fitted = Quantiser(shift, [], [], shift, scale).seen(fitted)
    q = Quantiser.fit(fitted, max(1, min(MOST_LISTS, total // LIST_VECTORS)))
    q.shift, q.scale = shift, scale
    measured = probes is None and rerank is None
    probes = probes or q.probes(fitted, k)
    rerank = rerank or q.shortlist(fitted, k, total)
    shared = spark.sparkContext.broadcast(q)  # at most MOST_LISTS + CODES vectors

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.seen(_matrix(batch.column("v")))
            if len(x):
                lists = shared.value.assign(x)
                codes = shared.value.encode(x, lists)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column("uid"), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "uid", "code"])

    coded, _ = storage.materialise(distinct.select("v", "uid").mapInArrow(index, "list int, uid long, code binary"), "inverted-file")
    sizes = {r.list: r["count"] for r in coded.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    size = np.array([sizes.get(i, 0) for i in range(len(q.centres))])
    blocks = np.maximum(1, -(-size // BLOCK))

    asked = _valid(queries).withColumnRenamed("vec_id", "query_id")
    asked_rows, _ = storage.materialise(asked.distinct(), "queries")
    searched = asked_rows.groupBy("v").agg(F.min("query_id").alias("qid"))
    searched, _ = storage.materialise(searched, "distinct-queries")

    def found(searched: DataFrame, probes: int, rerank: int) -> DataFrame:
        """qid and uid of the shortlist of each row (qid, v) of ``searched``."""

        def lists_of(x: np.ndarray) -> Iterator[tuple[int, list[int]]]:
            """Row and lists to probe, for every row of x."""
            for at in range(0, len(x), 1024):
                order = squared(shared.value.seen(x[at : at + 1024]), shared.value.centres).argsort(1, kind="stable")
                seen = np.cumsum(size[order], axis=1)
                for row, (lists, sums) in enumerate(zip(order, seen, strict=True)):
                    n = max(min(probes, len(lists)), 1 + int(np.searchsorted(sums, min(LEAST_SEEN, total))))
                    yield at + row, [c for c in lists[:n].tolist() if size[c]]

        def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(size), np.int64)
            for batch in batches:
                for _, lists in lists_of(_matrix(batch.column("v"))):
                    n[lists] += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0])], ["list", "n"])

        # At most MOST_LISTS rows.
        asked_of = {r.list: r.n for r in searched.select("v").mapInArrow(asking, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()}
        parts = np.array([max(1, -(-asked_of.get(i, 0) // QUERY_PART)) for i in range(len(size))])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(row, c, b) for row, lists in lists_of(_matrix(batch.column("v"))) for c in lists for b in range(blocks[c])]
                at = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(at), batch.column("v").take(at), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], ["qid", "v", "list", "block"])

        def of_list(numbers: np.ndarray) -> F.Column:
            """A list's number, where most lists have 1."""
            many = F.create_map(*[F.lit(int(x)) for i in np.flatnonzero(numbers > 1) for x in (i, numbers[i])]) if (numbers > 1).any() else None
            return F.coalesce(many[F.col("list")], F.lit(1)) if many is not None else F.lit(1)

        # A list's vectors lie in blocks and its queries in parts, so that neither a much asked nor a long list is one group.
        probed = searched.select("qid", "v").mapInArrow(probe, "qid long, v array<double>, list int, block int").withColumn("part", F.pmod(F.xxhash64("qid"), of_list(parts)).cast("int"))
        dealt = coded.withColumn("block", F.pmod(F.xxhash64("uid"), of_list(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), of_list(parts) - 1)))

        def scan(queries_in: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(queries_in) and len(entries):
                codes = np.frombuffer(b"".join(entries["code"]), np.uint8).reshape(len(entries), -1)
                ids, which = entries["uid"].to_numpy(), int(entries["list"].iloc[0])
                best = min(rerank, len(ids))
                for at in range(0, len(queries_in), QUERY_BLOCK):
                    part = queries_in.iloc[at : at + QUERY_BLOCK]
                    tables = shared.value.tables(shared.value.seen(np.stack(part["v"].to_list())), which)
                    for qid, table in zip(part["qid"], tables, strict=True):
                        d = table[np.arange(codes.shape[1])[:, None], codes.T].sum(0)
                        keep = np.argpartition(d, best - 1)[:best]
                        found.append((qid, ids[keep].astype("<i8").tobytes(), d[keep].astype("<f8").tobytes()))
            return pd.DataFrame(found, columns=["qid", "uids", "ds"])

        def best_of_lists(rows: pd.DataFrame) -> pd.DataFrame:
            ids, d = np.frombuffer(b"".join(rows["uids"]), "<i8"), np.frombuffer(b"".join(rows["ds"]), "<f8")
            return pd.DataFrame({"qid": rows["qid"].iloc[0], "uid": ids[np.lexsort((ids, d))[:rerank]]})

        # A list's best for a query are one packed row, and a query has one such row a block that it probes.
        near = probed.groupBy("list", "block", "part").cogroup(dealt.groupBy("list", "block", "part")).applyInPandas(scan, "qid long, uids binary, ds binary")
        return near.groupBy("qid").applyInPandas(best_of_lists, "qid long, uid long")

    def nearest(candidates: DataFrame, searched: DataFrame) -> DataFrame:
        """qid, score and vec_id of the k + 1 nearest candidates by exact distance; one more than k, as a query's own id goes."""
        exact = candidates.join(distinct.select("uid", "ids", F.col("v").alias("c")), "uid").join(searched.select("qid", "v"), "qid")
        score = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        ranked = exact.select("qid", score.alias("score"), F.explode("ids").alias("vec_id"))
        most = F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))
        return ranked.withColumn("r", most).where(F.col("r") <= k + 1).select("qid", "score", "vec_id")

    if measured:
        # At most MEASURED queries, and k + 1 rows for each.
        some, _ = storage.materialise(searched.orderBy(F.xxhash64("v", F.lit(5)), "qid").limit(MEASURED), "measured-queries")
        truth = _scores(nearest(_brute_force(distinct, some, k), some), k)
        while probes < len(size) or rerank < total:
            got = _scores(nearest(found(some, probes, rerank), some), k)
            met = sum(min(sum(s <= best[-1] for s in got.get(qid, [])), len(best)) for qid, best in truth.items() if best)
            if met >= LEAST_RECALL * sum(map(len, truth.values())):
                break
            probes, rerank = min(2 * probes, len(size)), min(2 * rerank, total)

    who = asked_rows.join(searched, "v").select("query_id", "qid")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = who.join(nearest(found(searched, probes, rerank), searched), "qid").where("query_id <> vec_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scores(nearest: DataFrame, k: int) -> dict[int, list[float]]:
    """The k smallest distances of each query to other ids, ascending."""
    rows = nearest.where("qid <> vec_id").groupBy("qid").agg(F.array_sort(F.collect_list("score")).alias("scores")).collect()
    return {r.qid: r.scores[:k] for r in rows}


def _brute_force(distinct: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid and uid of the k + 1 nearest distinct vectors of a few queries, in each part of ``distinct``."""
    asked = queries.select("qid", "v").collect()
    shared = queries.sparkSession.sparkContext.broadcast((np.array([r.qid for r in asked]), np.array([r.v for r in asked])))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, asked = shared.value
        best, ids = np.full((len(qids), k + 1), np.inf), np.full((len(qids), k + 1), -1, np.int64)
        held = np.zeros((len(qids), k + 1), bool)
        for batch in batches:
            x, uids = _matrix(batch.column("v")), batch.column("uid").to_numpy()
            for at in range(0, len(x), 2048):
                block = x[at : at + 2048]
                for row, q in enumerate(asked):
                    with np.errstate(over="ignore"):
                        d = ((block - q) ** 2).sum(1)
                    d, who = np.concatenate([best[row], d]), np.concatenate([ids[row], uids[at : at + 2048]])
                    is_held = np.concatenate([held[row], np.ones(len(block), bool)])
                    keep = np.lexsort((who, d, ~is_held))[: k + 1]
                    best[row], ids[row], held[row] = d[keep], who[keep], is_held[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, k + 1)[held.ravel()], pa.int64()), pa.array(ids[held])], ["qid", "uid"])

    return distinct.select("v", "uid").mapInArrow(nearest, "qid long, uid long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the 10 nearest of every row whose vec_id is divisible by 100, among all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
