"""Feature programs: types, JSON, versions, validation, compilation, folds."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.plans import compile as C
from chronofold.plans import folds, programs
from chronofold.plans import nodes as N

T0 = dt.datetime(2024, 1, 1)
SRC = N.Source("total_points")


@pytest.mark.parametrize(
    "make",
    [
        lambda: N.Rolling(N.Source("x", "entity"), 3),
        lambda: N.Rolling(SRC, 41),
        lambda: N.Rolling(SRC, 3, "std"),
        lambda: N.Rolling(SRC, 3, "percentile"),
        lambda: N.Trend(SRC, 2),
        lambda: N.Arith("add", SRC, N.Lag(SRC)),
        lambda: N.Arith("div", SRC, SRC),
        lambda: N.Unary("clip", SRC),
        lambda: N.Unary("zscore", SRC),
        lambda: N.GroupRel("rank", "team", SRC),
        lambda: N.ClusterRel("gate", N.Lag(SRC), "v"),
        lambda: N.FeatureProgram("p", SRC),
        lambda: N.FeatureProgram("p", N.Arith("add", N.Const(1), N.Const(2))),
        lambda: N.node_from_dict({"kind": "lag", "child": {"kind": "source", "column": "x"}, "more": 1}),
        lambda: N.node_from_dict({"kind": "nope"}),
        lambda: N.node_from_dict({"kind": "lag"}),
    ],
)
def test_refusals(make):
    with pytest.raises(N.ProgramError):
        make()


def test_json_and_versions():
    for p in programs.seeded():
        again = N.parse_program(p.to_json())
        assert again == p and again.version() == p.version() and N.describe(p.root)
        assert N.FeatureProgram("other", p.root).version() == p.version()
    assert len({p.version() for p in programs.seeded()}) == 15
    assert json.loads(programs.seeded()[0].to_json())["root"]["kind"] == "arith"
    assert programs.seeded()[10].max_window == 10


def test_interactions():
    out = N.interactions(programs.seeded(), cap=3)
    assert len(out) == 6 and all("__" in p.name for p in out)


def test_validate_lists_every_issue():
    p = N.FeatureProgram("p", N.Arith("mul", N.Lag(N.Source("label_x")), N.Source("y", "entity")))
    codes = [c for c, _ in C.validate(p, ["a"], ["b"], known=[N.FeatureProgram("q", p.root)])]
    assert sorted(codes) == ["duplicate_semantics", "target_leakage", "unknown_column", "unknown_column"]
    deep = N.Lag(SRC)
    for _ in range(9):
        deep = N.Unary("neg", deep)
    assert [c for c, _ in C.validate(N.FeatureProgram("d", deep), ["total_points"], [])] == ["excessive_depth"]


@pytest.fixture(scope="module")
def data(spark):
    random.seed(4)
    names = ["minutes", "starts", "total_points", "expected_goals", "creativity", "threat", "transfers_balance", "selected", "expected_goal_involvements"]
    rows = [(p, T0 + dt.timedelta(days=7 * w), T0 + dt.timedelta(days=7 * w, hours=3), *(None if random.random() < 0.1 else round(random.random() * 10, 3) for _ in names)) for p in range(6) for w in range(12)]
    history = spark.createDataFrame(rows, "player_code long, kickoff_time timestamp, available_time timestamp, " + ", ".join(f"{n} double" for n in names))
    cut = T0 + dt.timedelta(days=60)
    entities = spark.createDataFrame([(p, cut, "MID" if p % 2 else "DEF", f"t{p % 3}", p % 4, 1.0, 1.2, 0.8) for p in range(7)], "player_code long, prediction_timestamp timestamp, position string, team_name string, opponent_team_id long, is_home double, opponent_conceded_xg_mean_5 double, opponent_conceded_goals_mean_5 double")
    return rows, names, history, entities


def test_seeded_programs_compile_to_one_asof_join_each_kind(data):
    _, _, history, entities = data
    out = C.compile_programs(entities, history, programs.seeded())
    assert out.columns == [*entities.columns, *(p.name for p in programs.seeded())] and out.count() == 7
    with pytest.raises(N.ProgramError):
        C.compile_programs(out, history, programs.seeded())
    with pytest.raises(N.ProgramError):
        C.compile_programs(entities, history.drop("threat"), programs.seeded())


def test_values_with_nulls(data):
    rows, names, history, entities = data
    ps = [N.FeatureProgram("ewm", N.EwmMean(SRC, 6, 2.0)), N.FeatureProgram("trend", N.Trend(SRC, 6)), N.FeatureProgram("lag", N.Lag(SRC, 3)), N.FeatureProgram("p", N.Rolling(SRC, 6, "percentile", quantile=0.25)), N.FeatureProgram("rate", N.ShrunkRate("total_points", "minutes", 4))]
    got = {r.player_code: r for r in C.compile_programs(entities, history, ps).collect()}
    cut, at, mi = T0 + dt.timedelta(days=60), 3 + names.index("total_points"), 3 + names.index("minutes")
    for p in range(6):
        seen = sorted((r for r in rows if r[0] == p and r[2] <= cut), key=lambda r: r[2], reverse=True)
        v = [r[at] for r in seen[:6]]
        w = [0.5 ** (k / 2.0) for k in range(len(v))]
        assert got[p].ewm == pytest.approx(sum(a * b for a, b in zip(v, w, strict=True) if a is not None) / sum(w))
        ty = [(-k, y) for k, y in enumerate(v) if y is not None]
        tm, t2 = sum(-k for k in range(len(v))) / len(v), sum(k * k for k in range(len(v))) / len(v)
        if len(ty) >= 3:
            assert got[p].trend == pytest.approx((sum(t * y for t, y in ty) / len(ty) - tm * sum(y for _, y in ty) / len(ty)) / (t2 - tm * tm))
        assert got[p].lag == v[2]
        ordered = sorted(y for y in v if y is not None)
        assert got[p].p == ordered[int(0.25 * (len(ordered) - 1) + 0.5)]
        assert got[p].rate == pytest.approx(sum(r[at] or 0 for r in seen[:4]) / (sum(r[mi] or 0 for r in seen[:4]) + 270) * 90)
    assert got[6].ewm is None and got[6].rate == 0.0


def test_folds(spark):
    out = folds.walk_forward(list(range(1, 31)), 12, 4, embargo=1)
    assert [(f.train, f.validate) for f in out][:2] == [((1, 12), (14, 17)), ((1, 16), (18, 21))]
    assert all(f.train[1] < f.validate[0] for f in out)
    assert folds.walk_forward(list(range(1, 31)), 12, 4, sliding=True)[1].train == (5, 16)
    with pytest.raises(ValueError):
        folds.walk_forward([1, 1, 2], 1, 1)
    frame = spark.range(1, 31).withColumnRenamed("id", "timeline").withColumn("season", F.lit("a"))
    train, validate = folds.split(frame, out[0])
    assert train.count() == 12 and validate.count() == 4
    assert folds.fold_rows(frame, out).where("fold = 1 AND part = 'train'").count() == 16


def test_groups_of_many_rows_and_nested_relatives(spark):
    from chronofold.plans.compile import compile_programs
    from chronofold.plans.nodes import Arith, FeatureProgram, GroupRel, Source, Unary

    n = 20_000
    day = F.lit("2024-01-05").cast("timestamp_ntz")
    entities = spark.range(n).select(F.col("id").alias("player_code"), day.alias("prediction_timestamp"), F.when(F.col("id") % 10 > 0, (F.col("id") * 7919 % 1000).cast("double")).alias("x"), F.when(F.col("id") % 3 > 0, F.lit("MID")).alias("position"), (F.col("id") % 5).alias("team_name"))
    history = spark.createDataFrame([(1, "2024-01-01", "2024-01-01", 1.0)], "player_code long, a string, k string, y double").select("player_code", F.col("a").cast("timestamp_ntz").alias("available_time"), F.col("k").cast("timestamp_ntz").alias("kickoff_time"), "y")
    x = Source("x", "entity")
    programs = [FeatureProgram("r", GroupRel("rank", "all", x)), FeatureProgram("z", GroupRel("zscore", "position", x)), FeatureProgram("nested", GroupRel("dev_from_mean", "team", Arith("mul", Unary("percentile_rank", x), GroupRel("share", "all", x)))), FeatureProgram("same", Unary("zscore", x))]
    got = {r.player_code: r for r in compile_programs(entities, history, programs).collect()}
    value = {k: float(k * 7919 % 1000) for k in range(n) if k % 10}
    ordered = np.sort(list(value.values()))
    low, high = np.searchsorted(ordered, list(value.values()), "left"), np.searchsorted(ordered, list(value.values()), "right")
    rank = dict(zip(value, ((low + high + 1) / 2 - 1) / (len(value) - 1), strict=True))
    total = sum(value.values())
    product = {k: rank[k] * value[k] / total for k in value}
    team = [np.mean([product[k] for k in value if k % 5 == t]) for t in range(5)]
    mid = [value[k] for k in value if k % 3]
    for k in (1, 2, 3, 4444, 19_999):
        assert got[k].r == pytest.approx(rank[k]) and got[k].nested == pytest.approx(product[k] - team[k % 5], abs=1e-12)
        group = mid if k % 3 else [value[j] for j in value if j % 3 == 0]
        assert got[k].z == pytest.approx((value[k] - np.mean(group)) / np.std(group, ddof=1))
    assert got[10].r is None and got[10].nested is None and got[10].z is None and len(got) == n
