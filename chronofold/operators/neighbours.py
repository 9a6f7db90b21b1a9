"""Exact nearest neighbours within groups, with what can't hold a nearer row skipped.

Rows of one vector come down to one, with their k + 1 smallest keys. Each group has pivots, about as many as the root of
its rows; a row lies in the cell of its nearest pivot, and a cell's rows, in order of their distance from the pivot, form blocks
of about ``BLOCK``. A row first meets its own block, which bounds how far its k-th neighbour can be. By the triangle
inequality no row whose distance from a pivot differs by more than that bound can be nearer, so whole cells, then
blocks of the others, are skipped, and the row meets what is left. Nothing is approximate: the answer is that of comparing all.

Blocks that lie near each other form tiles of about ``TILE`` rows. Whether a block must be met is settled by block, and a
block goes once to each tile that must meet it; there its rows follow the tile's in slices, and each of the tile's rows keeps
the k + 1 nearest so far, ties to the smaller key. Distances are first bounded by a matrix product, and only those that the
bound leaves are computed. So no table has a row for each pair, a vector is sent once for each tile and
not for each row it meets, and no task holds more than a tile and a slice. On rows without any clusters most blocks
are met; then the work is that of all pairs, as it must be, and rows are sent as often as their group has tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators.ranks import places
from chronofold.sources.scratch import written

#: Different vectors of a group up to which it is one block.
WHOLE = 2048
#: Rows of a block, rows that follow one copy of a group's pivots, and the most pivots of a group.
BLOCK, PART, MOST_PIVOTS = 64, 20_000, 2048
#: Rows of a tile, and rows that follow one copy of it.
TILE, FOLLOW = 4096, 200_000
#: Rows of one vector above which its answer has copies.
HOT = 10_000
#: Slack of bounds, as distances are rounded.
SLACK = 1e-9
_SLICE = 1 << 22


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(y)))
    step = max(1, _SLICE // max(1, y.size))
    for at in range(0, len(x), step):
        out[at : at + step] = ((x[at : at + step, None, :] - y[None]) ** 2).sum(2)
    return out


def _followed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict, dict | None]]:
    """The few of each key with each slice of its many (dicts of numpy columns), then once with None."""
    now, held, first = None, None, []
    for batch in batches:
        key = list(zip(*(batch.column(k).to_pylist() for k in keys), batch.column("_kind").to_pylist(), strict=True))
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "a", "b", "c")}
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for at, end in zip(cuts, cuts[1:], strict=False):
            part = {c: x[at:end] for c, x in columns.items()} | {"v": _matrix(batch.column("v").slice(at, end - at))}
            if key[at][:-1] != now:
                if held is not None:
                    yield held, None
                now, held, first = key[at][:-1], None, []
            if key[at][-1] == 0:
                first.append(part)
                continue
            if held is None and first:
                held = {c: np.concatenate([p[c] for p in first]) for c in part}
            if held is not None:
                yield held, part
    if held is not None:
        yield held, None


def _streamed(few: DataFrame, many: DataFrame, keys: list[str]) -> DataFrame:
    rows = few.select(*keys, F.lit(0).alias("_kind"), "uid", "v", "a", "b", "c").union(many.select(*keys, F.lit(1).alias("_kind"), "uid", "v", "a", "b", "c"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "_kind", "uid")


def _beside(few: DataFrame, many: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    """``run(few, many)`` (dicts of numpy columns) over every key's rows of ``few`` and slices of its rows of ``many``.

    Both have the keys, uid, v, and a, b, c (doubles). What ``run`` returns is a dict of columns of ``schema``.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, part in _followed(batches, keys):
            step = max(1, _SLICE // max(1, len(held["uid"]))) if part else 0
            for at in range(0, len(part["uid"]) if part else 0, step or 1):
                out = run(held, {c: x[at : at + step] for c, x in part.items()})
                if len(out[names[0]]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names)

    return _streamed(few, many, keys).mapInArrow(stream, schema)


def unique_vectors(frame: DataFrame, key: str, group: str, vector: str, k: int) -> DataFrame:
    """uid, g, v, n rows and the k + 1 smallest keys of every vector of a group; rows whose vector is null, or holds what isn't a finite number, take no part."""
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = frame.select(F.col(group).alias("g"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("g").isNotNull() & F.col("v").isNotNull()).where(sound)
    # Spark keeps a task's first k + 1 of each vector before it shuffles.
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy("g", "v").orderBy("key"))).where(F.col("_n") <= k + 1)
    keys = placed.groupBy("g", "v").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    counts = rows.groupBy(F.col("g").alias("_g"), F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    both = keys.join(counts, (F.col("g") == F.col("_g")) & (F.col("v") == F.col("_v"))).select("g", "v", "n", "keys")
    # Numbers rise with the smallest key, so that ties between vectors can be settled by them.
    return written(both.orderBy(F.element_at("keys", 1)).withColumn("uid", F.monotonically_increasing_id()))


def blocks_of(unique: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pivots (gid, cell, v), rows (gid, uid, v, cell, block, d: distance from their pivot) and parts of each group (gid, parts)."""
    groups = unique.groupBy("g").agg(F.min("uid").alias("gid"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.select("g", "gid", "n", F.least(F.ceil(F.sqrt("n")), F.lit(MOST_PIVOTS)).alias("pivots"), F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    rows = unique.drop("n").join(groups, "g").select("gid", "uid", "v", "pivots", "parts")
    order = Window.partitionBy("gid").orderBy(F.xxhash64("uid"))
    pivots = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MOST_PIVOTS).where(F.col("_n") <= F.col("pivots"))
    pivots = written(pivots.select("gid", F.col("uid").alias("cell"), "v", "parts"))
    copies = pivots.select("gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("cell").alias("uid"), "v", *_zeros())
    dealt = rows.select("gid", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("part"), "uid", "v", *_zeros())

    def nearest(few: dict, many: dict) -> dict:
        d2 = _squared(many["v"], few["v"])
        best = d2.argmin(1)
        return {"uid": many["uid"], "cell": few["uid"][best], "d": np.sqrt(d2[np.arange(len(best)), best])}

    cells = _beside(copies, dealt, ["gid", "part"], nearest, "uid long, cell long, d double")
    # A cell's rows are counted off in blocks, in order of distance: a block has one stretch of distances.
    placed = places(rows.select("gid", "uid", "v").join(cells, "uid"), ["gid", "cell"], "d", ["uid"], "place")
    block = F.xxhash64("gid", "cell", F.floor((F.col("place") - 1) / BLOCK)).alias("block")
    return pivots, written(placed.select("gid", "uid", "v", "cell", block, "d")), groups


def _zeros() -> list[Column]:
    return [F.lit(0.0).alias(c) for c in ("a", "b", "c")]


def visits(unique: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (uid, v, block, ..), blocks (block, cell, gid, n, tile), and (block, to, rows) of all pairs of blocks that must meet."""
    pivots, rows, groups = blocks_of(unique)
    own = rows.select("block", "uid", "v", *_zeros())

    def bound(few: dict, many: dict) -> dict:
        d2 = _squared(many["v"], few["v"])
        known = np.sqrt(np.partition(d2, k, axis=1)[:, k]) if len(few["uid"]) > k else np.full(len(d2), np.inf)
        return {"uid": many["uid"], "bound": known}

    bounds = written(_beside(own, own, ["block"], bound, "uid long, bound double"))
    rings = written(rows.groupBy("gid", "cell", "block").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n")))
    spans = rings.groupBy("gid", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    known = written(pivots.join(spans, ["gid", "cell"]).join(groups.select("gid", F.col("parts").alias("p")), "gid"))
    few = known.select("gid", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("part"), F.col("cell").alias("uid"), "v", F.col("low").alias("a"), F.col("high").alias("b"), F.col("n").cast("double").alias("c"))
    # Rows come by block, so that a slice's rows of one block are summed up before they leave.
    many = rows.hint("merge").join(bounds, "uid").join(groups.select("gid", "parts"), "gid").select("gid", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int").alias("part"), F.col("block").alias("uid"), "v", F.col("bound").alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))

    def reach(few: dict, many: dict) -> dict:
        d = np.sqrt(_squared(many["v"], few["v"]))
        # Cells that lie wholly within some distance and together hold k + 1 rows bound the k-th neighbour too.
        far = d + few["b"]
        order = np.argsort(far, axis=1)
        enough = (np.cumsum(few["c"][order], axis=1) > k).argmax(1)
        full = np.take_along_axis(far, order, 1)[np.arange(len(d)), enough] if few["c"].sum() > k else np.full(len(d), np.inf)
        limit = np.minimum(many["a"], full)
        limit = (limit + SLACK * (1 + np.where(np.isinf(limit), 0, limit)))[:, None]
        met = (d - few["b"] <= limit) & (few["a"] - d <= limit)
        starts = np.flatnonzero(np.r_[True, many["uid"][1:] != many["uid"][:-1]])
        x, c = np.nonzero(np.logical_or.reduceat(met, starts, axis=0))
        near = np.minimum.reduceat(np.where(met, d - limit, np.inf), starts, axis=0)
        away = np.maximum.reduceat(np.where(met, d + limit, -np.inf), starts, axis=0)
        return {"block": many["uid"][starts][x], "cell": few["uid"][c], "near": near[x, c], "away": away[x, c]}

    cells = _beside(few, many, ["gid", "part"], reach, "block long, cell long, near double, away double")
    cells = cells.groupBy("block", "cell").agg(F.min("near").alias("near"), F.max("away").alias("away"))
    to = rings.select("cell", F.col("block").alias("to"), "low", "high", F.col("n").alias("_n"))
    met = cells.hint("merge").join(to, "cell").where((F.col("low") <= F.col("away")) & (F.col("high") >= F.col("near")))
    blocks = tiles_of(known, rings, groups)
    return rows, blocks, met.hint("merge").join(blocks.select("block", "n"), "block").select("block", "to", (F.col("n") * F.col("_n")).alias("rows"))


def tiles_of(pivots: DataFrame, rings: DataFrame, groups: DataFrame) -> DataFrame:
    """Blocks (block, cell, gid, n) with their tile: cells come together by the nearest of a few pivots, and are counted off."""
    order = Window.partitionBy("gid").orderBy(F.xxhash64("cell"))
    ranked = pivots.select("gid", F.col("cell").alias("uid"), "cell", "v", *_zeros()).join(groups.select("gid", F.ceil(F.col("n") / TILE).alias("_tiles")), "gid").withColumn("_n", F.row_number().over(order))

    def nearest(few: dict, many: dict) -> dict:
        return {"cell": many["uid"], "home": few["uid"][_squared(many["v"], few["v"]).argmin(1)]}

    homes = _beside(ranked.where(F.col("_n") <= F.col("_tiles")), ranked, ["gid"], nearest, "cell long, home long")
    counted = Window.partitionBy("gid", "home").orderBy("cell", "block")
    placed = rings.hint("merge").join(homes, "cell").withColumn("_at", F.sum("n").over(counted) - F.col("n"))
    return written(placed.select("block", "cell", "gid", "n", F.xxhash64("gid", "home", F.floor(F.col("_at") / TILE)).alias("tile")))


class _Nearest:
    """The k + 1 nearest so far of each of a few rows, by exact squared distance and then number; rows are met in slices."""

    def __init__(self, few: dict, k: int) -> None:
        self.few, self.k = few, k
        self.d2 = np.full((len(few["uid"]), k + 1), np.inf)
        self.uid = np.full(self.d2.shape, np.iinfo(np.int64).max)
        self.centre = few["v"].mean(0)
        self.x = few["v"] - self.centre
        self.size = (self.x**2).sum(1)
        # Rounding of a product's sums, of norms and of exact distances, as a share of both norms.
        self.tolerance = 8 * (self.x.shape[1] + 8) * np.finfo(float).eps

    def meet(self, many: dict) -> None:
        y = many["v"] - self.centre
        size = (y**2).sum(1)
        step = max(1, _SLICE // len(y))
        for at in range(0, len(self.x), step):
            here = slice(at, at + step)
            near = self.size[here, None] + size - 2 * (self.x[here] @ y.T)
            error = self.tolerance * (self.size[here] + size.max())
            limit = self.d2[here, self.k]
            if len(y) > self.k and np.isinf(limit).any():
                limit = np.fmin(limit, np.partition(near, self.k, axis=1)[:, self.k] + error)
            # What overflows is no number, and is compared too.
            x, c = np.nonzero(~(near > (limit + error)[:, None]))
            most = max(1, _SLICE // max(1, y.shape[1]))
            for p in range(0, len(x), most):
                self._take(x[p : p + most] + at, c[p : p + most], many)

    def _take(self, x: np.ndarray, c: np.ndarray, many: dict) -> None:
        d2 = ((self.few["v"][x] - many["v"][c]) ** 2).sum(1)
        rows = np.unique(x)
        of = np.concatenate([np.repeat(rows, self.k + 1), x])
        d2, uid = np.concatenate([self.d2[rows].ravel(), d2]), np.concatenate([self.uid[rows].ravel(), many["uid"][c]])
        order = np.lexsort((uid, d2, of))
        of, d2, uid = of[order], d2[order], uid[order]
        first = np.searchsorted(of, rows)
        best = first[:, None] + np.arange(self.k + 1)
        self.d2[rows], self.uid[rows] = d2[best], uid[best]

    def found(self) -> pa.RecordBatch:
        x, c = np.nonzero(self.uid < np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays([pa.array(self.few["uid"][x]), pa.array(self.uid[x, c]), pa.array(self.d2[x, c])], ["uid", "to", "d2"])


def _candidates(few: DataFrame, many: DataFrame, keys: list[str], k: int) -> DataFrame:
    """uid, to and d2 of the k + 1 nearest of a key's ``many`` to each of its ``few``; ties go to the smaller number."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        with np.errstate(all="ignore"):
            for held, part in _followed(batches, keys):
                best = best or _Nearest(held, k)
                if part is not None:
                    best.meet(part)
                else:
                    yield best.found()
                    best = None

    return _streamed(few, many, keys).mapInArrow(stream, "uid long, to long, d2 double")


def _in_small_groups(unique: DataFrame, k: int) -> DataFrame:
    """Candidates where a whole group is one block."""
    rows = unique.select("g", "uid", "v", *_zeros())
    return _candidates(rows, rows, ["g"], k)


def _in_large_groups(unique: DataFrame, k: int) -> DataFrame:
    """Candidates out of the blocks that bounds leave."""
    rows, blocks, met = visits(unique, k)
    tiles = blocks.select("block", "tile")
    meets = met.hint("merge").join(tiles, "block").select("tile", F.col("to").alias("block")).distinct()
    meets = written(meets.hint("merge").join(blocks.select("block", "n"), "block"))
    # A tile may meet any number of rows: they come in parts, each with its own copy of the tile.
    sized = meets.groupBy("tile").agg(F.ceil(F.sum("n") / FOLLOW).cast("int").alias("copies"))
    few = rows.hint("merge").join(tiles, "block").join(sized, "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("tile", "part", "uid", "v", *_zeros())
    many = rows.hint("merge").join(meets, "block").join(sized, "tile").select("tile", F.pmod(F.xxhash64("block"), F.col("copies")).cast("int").alias("part"), "uid", "v", *_zeros())
    return _candidates(few, many, ["tile", "part"], k)


def neighbours(frame: DataFrame, key: str, group: str, vector: str, k: int) -> DataFrame:
    """key, other, place (from 1) and d2 of the k nearest others of each row in its group; ties go to the smaller key."""
    unique = unique_vectors(frame, key, group, vector, k)
    groups = written(unique.groupBy("g").agg(F.count(F.lit(1)).alias("_rows"), F.max("n").alias("_most")).withColumnRenamed("g", "_g"))
    large, most = groups.agg(F.coalesce(F.max("_rows"), F.lit(0)), F.coalesce(F.max("_most"), F.lit(0))).first()
    if large <= WHOLE:
        found = _in_small_groups(unique, k)
    else:
        of = lambda few: written(unique.join(groups.where((F.col("_rows") <= WHOLE) == few), F.col("g") == F.col("_g"), "left_semi"))
        found = _in_small_groups(of(True), k).union(_in_large_groups(of(False), k))
    order = Window.partitionBy("uid").orderBy("d2", "other")
    names = unique.select(F.col("uid").alias("to"), F.explode("keys").alias("other"))
    best = found.join(names, "to").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    answers = best.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("d2", "other"))).alias("found"))
    hot = F.ceil(F.col("n") / HOT).cast("int")
    answered = unique.join(answers, "uid").select("g", "v", "found", hot.alias("copies"))
    often = answered.where("copies > 1").select(F.col("g").alias("_hg"), F.col("v").alias("_hv"), F.col("copies").alias("_c"))
    spread = answered.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    mine = frame.select(F.col(key), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    if most > HOT:
        mine = mine.join(often, (F.col("g") == F.col("_hg")) & (F.col("v") == F.col("_hv")), "left").drop("_hg", "_hv")
    else:
        mine = mine.withColumn("_c", F.lit(1))
    mine = mine.withColumn("_copy", F.pmod(F.xxhash64(key), F.coalesce("_c", F.lit(1))).cast("int"))
    joined = mine.join(spread, ["g", "v", "_copy"])
    others = F.slice(F.filter("found", lambda x: x["other"] != F.col(key)), 1, k)
    return joined.select(F.col(key), F.posexplode(others).alias("_p", "_x")).select(key, "_x.other", (F.col("_p") + 1).alias("place"), "_x.d2")
