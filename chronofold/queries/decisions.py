"""Pick metrics, percentiles, reachable pools, samples and name lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.operators import decisions, explain, scoring, squads
from chronofold.queries.asof import rounded
from chronofold.queries.domain import SQUAD_SQL, squad_rows
from chronofold.queries.roles import table
from chronofold.queries.statistics import PRED_SQL, predictions
from chronofold.sources import normalise


def pick_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("ownership", F.pmod("player_code", F.lit(10)) / 20.0)
    return rounded(decisions.pick_metrics(p, ["player_code"]), "points", "rank_gain", "downside", "differential", "captaincy")


def positional_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decisions.positional_percentiles(predictions(spark, sf_dir), ["predicted", "actual"]).select("player_code", "predicted_percentile", "actual_percentile")
    return rounded(out, "predicted_percentile", "actual_percentile")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decisions.evidence(predictions(spark, sf_dir), ["predicted", "actual"]).select("player_code", F.explode("evidence").alias("e")).select("player_code", "e.*")
    return rounded(out, "percentile")


def reachable_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("team_id", F.pmod("player_code", F.lit(20)))
    out = decisions.reachable(p, excluded=[9, 10], locked=[10, 11], positions=["A", "N"], most_price=80, full_clubs=[3, 4])
    return out.groupBy("position", "reachable").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"))


def expectation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    u = lambda n: F.pmod(F.col("l_partkey") * n, F.lit(10)) / 10.0
    return t.select("l_orderkey", "l_linenumber", "l_partkey", F.element_at(F.array(*map(F.lit, ("GKP", "DEF", "MID", "FWD"))), (F.pmod("l_suppkey", F.lit(4)) + 1).cast("int")).alias("position"), u(1).alias("p_short"), u(2).alias("p_long"), u(3).alias("expected_goals"), u(4).alias("expected_assists"), u(5).alias("p_clean_sheet"), u(6).alias("expected_conceded"), u(7).alias("expected_saves"), u(8).alias("expected_bonus"), u(9).alias("expected_yellow"), u(11).alias("p_defensive"))


def expected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expectation_rows(spark, sf_dir)
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", scoring.expected_points().alias("points")), "points")


def points_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What expected points of all lines are made of, by position and component, and whether every line's terms come to its total."""
    rows = explain.derivation(expectation_rows(spark, sf_dir), scoring.expected_points())
    each = rows.select("position", "reconciles", F.posexplode("terms").alias("place", "t"))
    out = each.groupBy("position", F.col("t.component").alias("component")).agg(F.count(F.lit(1)).alias("n"), F.sum("t.expectation").alias("expectation"), F.avg("t.rate").alias("rate"), F.sum("t.points").alias("points"), F.count_if(F.col("place") == 0).alias("largest"), F.min("reconciles").alias("reconciles"))
    return rounded(out.where("component <> 'appearing' OR n > 0"), "expectation", "rate", "points").drop("largest")


def lineup_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a plain 4-4-2 of each whole squad differs from its best eleven."""
    rows = squad_rows(spark, sf_dir).withColumn("points", F.col("expected_points").cast("double"))
    best = squads.best_eleven(rows)
    yours = rows.where(F.col("place").isin(1, 3, 4, 5, 6, 8, 9, 10, 11, 13, 14)).join(best.select("squad_id"), "squad_id")
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("squad_id", "position").orderBy(F.desc("points"), "player_code"))).join(best, "squad_id")
    room = F.when(F.col("position") == "GKP", 1).when(F.col("position") == "DEF", F.col("n_def")).when(F.col("position") == "MID", F.col("n_mid")).otherwise(F.col("n_fwd"))
    ours = ranked.where(F.col("_n") <= room)
    captains = yours.where("place = 13").select("squad_id", F.col("player_code").alias("yours")).join(best.select("squad_id", F.col("captain").alias("ours")), "squad_id")
    pick = lambda e: e.select("squad_id", "player_code", "position", "points")
    return rounded(explain.lineup_difference(pick(yours), pick(ours), captains), "yours_points", "ours_points", "swap_delta", "captain_delta", "shape_delta")


def closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    part = lambda n: F.pmod(k * (n + 2), F.lit(n)).cast("double")
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*map(F.lit, ("GKP", "DEF", "MID", "FWD"))), (F.pmod("l_suppkey", F.lit(4)) + 1).cast("int")).alias("position"), F.when(k % 13 > 0, part(91)).alias("minutes_mean_5"), F.when(k % 11 > 0, part(10) / 9).alias("start_rate_5"), (part(17) / 10).alias("xg_per90_shrunk"), (part(19) / 20).alias("xa_per90_shrunk"), (part(23) / 20).alias("bonus_per90_shrunk"), F.when(k % 5 > 0, part(29) / 10).alias("team_xg_for_mean_5"))
    out = scoring.closed_form(t.groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in t.columns[2:])), 1.4)
    return rounded(out.select("l_orderkey", "l_linenumber", "expected_points", "sd"), "expected_points", "sd")


def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player_code"), F.col("p_brand").alias("web_name"), F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")).alias("full_name"))
    return decisions.name_index(players, ["web_name", "full_name"])


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each stratum of a stratified sample of all customers has."""
    out = normalise.stratified_sample(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", F.lit(4), 7)
    return out.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders of each season and club a sample keeps: five of a club and season, then twelve of a club."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.year("o_orderdate").alias("season"), F.pmod("o_custkey", F.lit(20)).alias("club"))
    out = normalise.quota_sample(rows, "key", 7, {("season", "club"): 5, ("club",): 12})
    return out.groupBy("club").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))


def ranked_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.ranked_page(predictions(spark, sf_dir).select("player_code", "predicted", "actual"), "actual", "player_code", 2, 25)


def archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of all customers within their segments; two axes have two levels each, a third one is the same for all."""
    k = F.col("c_custkey")
    level = lambda bit, n: (F.floor(k / bit) % 2) * 10 + F.pmod(k * n, F.lit(7)) / 7.0
    t = table(spark, sf_dir, "customer").select(k.alias("player_code"), F.col("c_mktsegment").alias("position"), level(1, 3).alias("a"), level(2, 5).alias("b"), F.lit(1.0).alias("flat"))
    out = decisions.archetypes(t, ["a", "b", "flat"], words={"a": ("keen", "calm")})
    return out.groupBy("position", "label").agg(F.count(F.lit(1)).alias("n"), F.min("player_code").alias("first"), F.max("player_code").alias("last"))


QUERIES = {f.__name__: f for f in (pick_metrics, positional_percentiles, evidence, reachable_pool, expected_points, points_derivation, lineup_difference, closed_form, name_index, ranked_page, archetypes, quota_sample)} | {"stratified_sample": sample}


def _pct(c: str) -> str:
    w = "PARTITION BY position"
    return f"round((rank() OVER ({w} ORDER BY {c}) + (count({c}) OVER ({w} ORDER BY {c} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0 - 1) / (count({c}) OVER ({w}) - 1), 6)"


_U = {n: f"((l_partkey * {k}) % 10 / 10.0)" for n, k in {"p_short": 1, "p_long": 2, "g": 3, "a": 4, "cs": 5, "con": 6, "sv": 7, "bo": 8, "ye": 9, "de": 11}.items()}
_TERMS = [("goals", "g", "CASE position WHEN 'GKP' THEN 10 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END"), ("assists", "a", "3"), ("clean_sheet", "cs", "CASE position WHEN 'MID' THEN 1 WHEN 'FWD' THEN 0 ELSE 4 END"), ("conceded", "con", "CASE WHEN position IN ('GKP', 'DEF') THEN -0.5 ELSE 0 END"), ("saves", "sv", "1 / 3.0"), ("bonus", "bo", "1"), ("cards", "ye", "-1"), ("defence", "de", "CASE position WHEN 'GKP' THEN 0 ELSE 2 END")]
_STYLE = "(CASE WHEN c_custkey % 2 = 1 THEN 'keen' ELSE 'calm' END)"
ORACLE = {
    "archetypes": f"""WITH c AS (SELECT *, {_STYLE} AS a, CASE WHEN c_custkey // 2 % 2 = 1 THEN 'high b' ELSE 'low b' END AS b, c_mktsegment AS position FROM customer QUALIFY count(*) OVER (PARTITION BY c_mktsegment) >= 24),
 z AS (SELECT position, avg((c_custkey % 2) * 10 + (c_custkey * 3) % 7 / 7.0) AS am, stddev_pop((c_custkey % 2) * 10 + (c_custkey * 3) % 7 / 7.0) AS sa, avg((c_custkey // 2 % 2) * 10 + (c_custkey * 5) % 7 / 7.0) AS bm, stddev_pop((c_custkey // 2 % 2) * 10 + (c_custkey * 5) % 7 / 7.0) AS sb FROM c GROUP BY ALL),
 g AS (SELECT c.position, a, b, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last, abs(avg(((c_custkey % 2) * 10 + (c_custkey * 3) % 7 / 7.0 - am) / sa)) AS fa, abs(avg(((c_custkey // 2 % 2) * 10 + (c_custkey * 5) % 7 / 7.0 - bm) / sb)) AS fb FROM c JOIN z USING (position) GROUP BY ALL)
SELECT position, CASE WHEN round(fa, 6) >= round(fb, 6) THEN a || ', ' || b ELSE b || ', ' || a END || ' ' || position AS label, n, first, last FROM g""",
    "points_derivation": f"""WITH m AS (SELECT ['GKP', 'DEF', 'MID', 'FWD'][l_suppkey % 4 + 1] AS position, {', '.join(f'{e}::DOUBLE AS {n}' for n, e in _U.items())} FROM lineitem),
 t AS (SELECT position, 'appearing' AS component, p_short + p_long AS x, CASE WHEN p_short + p_long > 0 THEN (p_short + 2 * p_long) / (p_short + p_long) ELSE 0 END AS r FROM m {' '.join(f"UNION ALL SELECT position, '{n}', {c}, {r} FROM m" for n, c, r in _TERMS)})
SELECT position, component, count(*) AS n, round(sum(x), 6) AS expectation, round(avg(r), 6) AS rate, round(sum(x * r), 6) AS points, true AS reconciles FROM t WHERE abs(x * r) >= 0.005 GROUP BY position, component""",
    "lineup_difference": f"""WITH {SQUAD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY squad_id, position ORDER BY expected_points DESC, player_code) AS k FROM sq), f AS (SELECT d, m, f FROM range(3, 6) a(d), range(2, 6) b(m), range(1, 4) c(f) WHERE 1 + d + m + f = 11),
 t AS (SELECT squad_id, d, m, f, sum(expected_points) + max(expected_points) AS total, count(*) AS n FROM r, f WHERE k <= CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN d WHEN 'MID' THEN m ELSE f END GROUP BY ALL HAVING n = 11),
 best AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY squad_id ORDER BY total DESC, d DESC, m DESC, f DESC) = 1),
 pairs AS (SELECT r.*, b.d, b.m, b.f, r.place IN (1, 3, 4, 5, 6, 8, 9, 10, 11, 13, 14) AS mine, k <= CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN d WHEN 'MID' THEN m ELSE f END AS theirs FROM r JOIN best b USING (squad_id)),
 s AS (SELECT squad_id, sum(greatest(o, i)) AS swaps FROM (SELECT squad_id, position, count(*) FILTER (WHERE mine AND NOT theirs) AS o, count(*) FILTER (WHERE theirs AND NOT mine) AS i FROM pairs GROUP BY ALL) GROUP BY ALL),
 a AS (SELECT squad_id, any_value(d || '-' || m || '-' || f) AS ours_shape, sum(expected_points) FILTER (WHERE mine) AS y, sum(expected_points) FILTER (WHERE theirs) AS o, max(expected_points) FILTER (WHERE theirs) AS oc, max(expected_points) FILTER (WHERE place = 13) AS yc FROM pairs GROUP BY ALL)
SELECT squad_id, round(y + yc, 6)::DOUBLE AS yours_points, round(o + oc, 6)::DOUBLE AS ours_points, swaps::BIGINT AS swaps, round(o - y, 6)::DOUBLE AS swap_delta, round(oc - yc, 6)::DOUBLE AS captain_delta, 0.0::DOUBLE AS shape_delta, '4-4-2' AS yours_shape, ours_shape FROM a JOIN s USING (squad_id)""",
    "pick_metrics": f"""WITH {PRED_SQL}, q AS (SELECT *, player_code % 10 / 20.0 AS o FROM p), k AS (SELECT * FROM q ORDER BY predicted DESC, player_code LIMIT 20), c AS (SELECT avg(actual) AS c FROM (SELECT actual FROM q QUALIFY row_number() OVER (PARTITION BY gameweek_id ORDER BY predicted DESC, player_code) = 1))
SELECT round(avg(actual), 6) AS points, round(avg(actual * (1 - o)), 6) AS rank_gain, round(quantile_cont(actual, 0.1), 6) AS downside, round(coalesce(avg(actual) FILTER (WHERE o < 0.1), 0), 6) AS differential, round((SELECT c FROM c), 6) AS captaincy FROM k""",
    "positional_percentiles": f"WITH {PRED_SQL} SELECT player_code, {_pct('predicted')} AS predicted_percentile, {_pct('actual')} AS actual_percentile FROM p",
    "evidence": f"WITH {PRED_SQL} SELECT player_code, 'predicted' AS feature, predicted AS value, {_pct('predicted')} AS percentile FROM p UNION ALL SELECT player_code, 'actual', actual, {_pct('actual')} FROM p",
    "reachable_pool": f"""WITH {PRED_SQL}, r AS (SELECT *, (player_code NOT IN (9, 10) AND position IN ('A', 'N') AND price <= 80 AND player_code % 20 NOT IN (3, 4)) OR player_code IN (10, 11) AS reachable FROM p)
SELECT position, reachable, count(*) AS n, sum(price)::BIGINT AS price FROM r GROUP BY ALL""",
    "expected_points": f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, ['GKP', 'DEF', 'MID', 'FWD'][l_suppkey % 4 + 1] AS position, {', '.join(f'{e} AS {n}' for n, e in _U.items())} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(p_short + 2 * p_long + g * CASE position WHEN 'GKP' THEN 10 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END + 3 * a + cs * CASE position WHEN 'MID' THEN 1 WHEN 'FWD' THEN 0 ELSE 4 END
 - con / 2 * (position IN ('GKP', 'DEF'))::INT + sv / 3 + bo - ye + de * CASE position WHEN 'GKP' THEN 0 ELSE 2 END, 6) AS points FROM m""",
    "closed_form": """WITH k AS (SELECT l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber AS k, l_suppkey FROM lineitem),
 f AS (SELECT l_orderkey, l_linenumber, max(['GKP', 'DEF', 'MID', 'FWD'][l_suppkey % 4 + 1]) AS pos, max(CASE WHEN k % 13 > 0 THEN (k * 93 % 91)::DOUBLE END) AS mm, max(CASE WHEN k % 11 > 0 THEN (k * 12 % 10) / 9.0 END) AS sr, max((k * 19 % 17) / 10.0) AS xg, max((k * 21 % 19) / 20.0) AS xa, max((k * 25 % 23) / 20.0) AS bo, max(CASE WHEN k % 5 > 0 THEN (k * 31 % 29) / 10.0 END) AS tx FROM k GROUP BY ALL),
 a AS (SELECT *, least(1, mm / 70) AS ap, least(coalesce(sr, 0), least(1, mm / 70)) AS st, coalesce(greatest(0.8, CASE WHEN tx / 1.4 > 1.25 THEN 1.25 ELSE tx / 1.4 END), 1) AS fx0 FROM f),
 m AS (SELECT *, CASE WHEN tx IS NULL THEN 1.0 ELSE fx0 END AS fx, CASE WHEN mm IS NULL THEN 0.35 ELSE round(ap, 6) END AS pa, CASE WHEN mm IS NULL THEN 0.12 ELSE round(greatest(0, least(ap, st * 0.9 + greatest(0, (mm - 60) / 30) * 0.1)), 6) END AS pl, CASE WHEN mm IS NULL THEN 18.0 ELSE mm END AS em, CASE WHEN mm IS NULL THEN 25.0 ELSE round(30 * (1 - abs(mm - 45) / 45) + 6, 6) END AS ms FROM a),
 e AS (SELECT *, greatest(0, pa - pl) + 2 * pl + xg * em / 90 * fx * CASE pos WHEN 'GKP' THEN 10 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END + 3 * xa * em / 90 * fx + bo * em / 90 + least(1, 0.28 * pl) * CASE pos WHEN 'MID' THEN 1 WHEN 'FWD' THEN 0 ELSE 4 END
  - 1.35 * em / 90 / 2 * (pos IN ('GKP', 'DEF'))::INT + CASE WHEN pos = 'GKP' THEN 2.6 * em / 90 / 3 ELSE 0 END - 0.12 * em / 90 - 0.012 * em / 90 AS ep FROM m)
SELECT l_orderkey, l_linenumber, round(ep, 6) AS expected_points, round(greatest(0.5, abs(ep) * ms / 90 + 0.8), 6) AS sd FROM e""",
    "name_index": "WITH n AS (SELECT p_partkey AS player_code, unnest([lower(trim(p_brand)), lower(trim(concat_ws(' ', p_brand, p_type, p_size::VARCHAR)))]) AS name FROM part) SELECT name, min(player_code) AS player_code FROM n GROUP BY name HAVING count(DISTINCT player_code) = 1",
    "quota_sample": "SELECT club, least(12, sum(least(5, n)))::BIGINT AS n, least(12, sum(least(5, n)))::BIGINT AS keys FROM (SELECT year(o_orderdate) AS season, o_custkey % 20 AS club, count(*) AS n FROM orders GROUP BY ALL) GROUP BY club",
    "stratified_sample": "SELECT c_nationkey, c_mktsegment, least(4, count(*)) AS n FROM customer GROUP BY ALL",
    "ranked_page": f"WITH {PRED_SQL} SELECT player_code, predicted, actual FROM p ORDER BY actual DESC, player_code LIMIT 25 OFFSET 50",
}
