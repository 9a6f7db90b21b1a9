"""Feature programs as DataFrame plans.

A batch of programs becomes one plan: equal subtrees are one column, all windowed nodes are frames over
one sort of the history that meet the entity rows in one as-of join, and ``time_since`` nodes share a
second, strict one. What is relative to a batch or group counts rows of one cutoff (``batch`` names other columns, or none
for the whole table): rows so far are written once for each depth of nesting, means and spreads are aggregates that
are joined back, and ranks are counted by value (``operators/ranks.py``), so a cutoff of any size is no one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronofold.functions import scalars as S
from chronofold.operators.ranks import null_safe_join, unit_ranks
from chronofold.operators.rolling import aggregate, attach, history_frame, last_rows, shrunk
from chronofold.plans import nodes as N
from chronofold.sources.scratch import written


@dataclass(frozen=True)
class Context:
    """Where programs find their columns."""

    entity_keys: tuple[str, ...] = ("player_code",)
    prediction_time: str = "prediction_timestamp"
    available_time: str = "available_time"
    order_col: str = "kickoff_time"
    event_time: str = "kickoff_time"
    position: str = "position"
    team: str = "team_name"
    opponent: str = "opponent_team_id"
    batch: tuple[str, ...] | None = ("prediction_timestamp",)
    memberships: DataFrame | None = None

    def group(self, by: str) -> list[str]:
        batch = list(self.batch or ())
        return batch if by == "all" else [*batch, getattr(self, by)]


def validate(program: N.FeatureProgram, history_columns: Sequence[str], entity_columns: Sequence[str], forbidden: Sequence[str] = (), known: Sequence[N.FeatureProgram] = ()) -> list[tuple[str, str]]:
    """Every issue as (code, text); none if the program can be compiled."""
    out = []
    for scope, have in (("history", history_columns), ("entity", entity_columns)):
        for c in sorted(program.columns(scope)):
            if c not in have:
                out.append(("unknown_column", f"{scope} has no {c}"))
            if c in forbidden or c.startswith("label_"):
                out.append(("target_leakage", f"{c} is known only afterwards"))
    if program.root.depth > N.MAX_DEPTH:
        out.append(("excessive_depth", f"depth {program.root.depth}"))
    if program.node_count > N.MAX_NODES:
        out.append(("excessive_size", f"{program.node_count} nodes"))
    out += [("duplicate_semantics", f"computes what {k.name} does") for k in known if k.version() == program.version() and k.name != program.name]
    return out


def _row(node: N.Node) -> Column:
    """A history-level expression."""
    if isinstance(node, N.Source):
        return S.number(F.col(node.column))
    if isinstance(node, N.Const):
        return F.lit(float(node.value))
    if isinstance(node, N.Arith):
        return _arith(node, _row(node.left), _row(node.right))
    if isinstance(node, N.Unary):
        return _unary(node, _row(node.child))
    raise N.ProgramError(f"{node.kind} has no history-level value")


def _arith(node: N.Arith, left: Column, right: Column) -> Column:
    plain = {"add": lambda: left + right, "sub": lambda: left - right, "mul": lambda: left * right, "safe_div": lambda: S.safe_div(left, right, node.epsilon), "min": lambda: F.least(left, right), "max": lambda: F.greatest(left, right)}
    return plain[node.op]()


def _unary(node: N.Unary, child: Column) -> Column:
    plain = {"log1p": lambda: S.log1p(child), "neg": lambda: -child, "abs": lambda: F.abs(child), "clip": lambda: S.clip(child, node.lower, node.upper)}
    return plain[node.op]()


def _temporal(node: N.Node, history: WindowSpec) -> Column:
    """A windowed node as it stands at a record of the history."""
    if isinstance(node, N.ShrunkRate):
        rate = shrunk(S.number(F.col(node.numerator)), S.number(F.col(node.denominator)), last_rows(history, node.window), node.prior_strength, node.scale)
        return rate
    c = _row(node.child)
    if isinstance(node, N.Lag):
        return F.lag(c, node.periods - 1).over(history)
    frame = last_rows(history, node.window)
    if isinstance(node, N.Rolling):
        if node.agg == "percentile":
            value = S.nearest_rank(F.collect_list(c).over(frame), node.quantile)
            return F.when(F.count(c).over(frame) >= node.min_periods, value)
        return aggregate(c, node.agg, frame, node.min_periods)
    # Rank 0 is the newest record; arrays over the frame are oldest first, nulls kept in structs.
    boxed = F.collect_list(F.struct(c.alias("v"))).over(frame)
    n = F.count(F.lit(1)).over(frame)
    if isinstance(node, N.EwmMean):
        # Weights of records without a value stay in the divisor.
        weights = F.transform(boxed, lambda x, i: F.pow(F.lit(0.5), (n - 1 - i) / F.lit(node.halflife)))
        total = F.aggregate(F.zip_with(boxed, weights, lambda x, w: F.coalesce(x["v"], F.lit(0.0)) * w), F.lit(0.0), lambda s, x: s + x)
        return total / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    if isinstance(node, N.Trend):
        seen = F.filter(F.transform(boxed, lambda x, i: F.struct((i - n + 1).cast("double").alias("t"), x["v"].alias("v"))), lambda x: x["v"].isNotNull())
        k = F.size(seen)
        add = lambda f: F.aggregate(seen, F.lit(0.0), lambda s, x: s + f(x))
        # Times are averaged over all records, values and products over those with a value.
        tm, t2m = -(n - 1) / F.lit(2.0), (n - 1) * (2 * n - 1) / F.lit(6.0)
        variance = t2m - tm * tm
        return F.when((k >= 3) & (F.abs(variance) > S.TINY), (add(lambda x: x["t"] * x["v"]) / k - tm * add(lambda x: x["v"]) / k) / variance)
    raise N.ProgramError(f"{node.kind} isn't windowed")


_TEMPORAL = (N.Rolling, N.Lag, N.EwmMean, N.Trend, N.ShrunkRate)


class Stager(Protocol):
    """How windowed columns of the history reach entity rows: ``attach`` by default, or what a caller brings."""

    def __call__(self, entities: DataFrame, source: DataFrame, features: dict[str, Column], entity_keys: Sequence[str], history: WindowSpec, *, prediction_time: str, available_time: str, strict: bool = False) -> DataFrame: ...


def compile_programs(entities: DataFrame, history: DataFrame, programs: Sequence[N.FeatureProgram], context: Context = Context(), stage: Stager = attach) -> DataFrame:
    """Entity rows with one double column for each program, by its name."""
    names = [p.name for p in programs]
    clash = sorted({n for n in names if n in entities.columns or names.count(n) > 1})
    if clash:
        raise N.ProgramError(f"names are taken: {clash}")
    for p in programs:
        issues = [i for i in validate(p, history.columns, entities.columns) if i[0] == "unknown_column"]
        if issues:
            raise N.ProgramError(str(issues))
    every = {n.key(): n for p in programs for n in p.root.walk()}
    spec = history_frame(context.entity_keys, context.available_time, context.order_col, history.columns)
    temporal = {f"_p_{k}": _temporal(n, spec) for k, n in every.items() if isinstance(n, _TEMPORAL)}
    out = stage(entities, history, temporal, context.entity_keys, spec, prediction_time=context.prediction_time, available_time=context.available_time) if temporal else entities
    # A rate over an empty history is 0 only if there is a history; the rows stay apart from those without one.
    since = {}
    so_far = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k, n in every.items():
        if isinstance(n, N.TimeSince):
            event = F.col(context.event_time)
            counts = S.number(F.col(n.event_column)) > 0 if n.require_positive else F.lit(True)
            since[f"_p_{k}"] = F.max(F.when(counts, event)).over(so_far)
    if since:
        out = stage(out, history, since, context.entity_keys, spec, prediction_time=context.prediction_time, available_time=context.available_time, strict=True)
        out = out.withColumns({c: S.days_between(F.col(context.prediction_time), F.col(c)) for c in since})
    built = dict.fromkeys([*temporal, *since])

    def column(node: N.Node) -> Column:
        """The entity-level value, from columns that are there by now."""
        nonlocal out
        name = f"_p_{node.key()}"
        if name in built:
            return F.coalesce(name, F.lit(0.0)) if isinstance(node, N.ShrunkRate) else F.col(name)
        if isinstance(node, N.Source):
            return S.number(F.col(node.column))
        if isinstance(node, N.Const):
            return F.lit(float(node.value))
        if isinstance(node, N.Arith):
            return _arith(node, column(node.left), column(node.right))
        if isinstance(node, N.Unary) and node.op not in N.BATCH_UNARY:
            return _unary(node, column(node.child))
        if isinstance(node, N.ClusterRel) and node.op == "gate":
            return gate(node)
        raise N.ProgramError(f"{node.kind} was not computed before it is read")

    def scoped(node: N.ClusterRel) -> DataFrame:
        if context.memberships is None:
            raise N.ProgramError("a cluster expression needs memberships")
        return context.memberships.where(F.col("cluster_model_version") == node.cluster_model_version)

    def gate(node: N.ClusterRel) -> Column:
        nonlocal out
        keys, name = list(context.entity_keys), f"_p_{node.key()}"
        wanted = scoped(node).where(F.col("cluster_id") == node.cluster_id).select(*keys, F.col("membership_probability").cast("double").alias(f"_c_{node.key()}"))
        value = column(node.child)
        out = out.join(wanted, keys, "left").withColumn(name, value * F.coalesce(f"_c_{node.key()}", F.lit(0.0)))
        built[name] = None
        return F.col(name)

    def grouping(node: N.Node) -> tuple[str, ...]:
        """The columns whose rows a node is relative to."""
        nonlocal out
        if not isinstance(node, N.ClusterRel):
            return tuple(context.group("all" if isinstance(node, N.Unary) else node.by))
        keys, mark = list(context.entity_keys), f"_c_{node.cluster_model_version}"
        if mark not in built:
            best = scoped(node).groupBy(*keys).agg(F.max_by("cluster_id", F.struct("membership_probability", -F.col("cluster_id"))).alias(mark))
            out = out.join(best, keys, "left").withColumn(mark, F.coalesce(mark, F.lit(-1)))
            built[mark] = None
        return (*context.group("all"), mark)

    def relate(nodes: Sequence[N.Node]) -> None:
        """Compute nodes that are relative to groups, whose own parts are there."""
        nonlocal out
        groups: dict[tuple[str, ...], list[N.Node]] = {}
        for n in nodes:
            groups.setdefault(grouping(n), []).append(n)
        children = {n.child.key(): column(n.child) for n in nodes}
        out = written(out.withColumns({f"_p_{k}_in": c for k, c in children.items()}))
        for group, some in groups.items():
            ranked = {f"_p_{n.child.key()}_in": f"_p_{n.child.key()}_rank" for n in some if n.op in ("rank", "percentile_rank")}
            spread = {f"_p_{n.child.key()}_in" for n in some if n.op not in ("rank", "percentile_rank")}
            if spread:
                totals = out.groupBy(*group).agg(*(f(c).alias(f"{c}_{what}") for c in sorted(spread) for what, f in (("mean", F.avg), ("sd", F.stddev_samp), ("sum", F.sum))))
                out = null_safe_join(out, totals, group, "left")
            for n in some:
                c = F.col(f"_p_{n.child.key()}_in")
                mean, sd, total = (F.col(f"_p_{n.child.key()}_in_{what}") for what in ("mean", "sd", "sum"))
                if n.op not in ("rank", "percentile_rank"):
                    value = {"zscore": F.when(sd > S.TINY, (c - mean) / sd), "share": F.when(F.abs(total) > S.TINY, c / total)}.get(n.op, c - mean)
                    out = out.withColumn(f"_p_{n.key()}", value)
            out = out.drop(*(f"{c}_{what}" for c in spread for what in ("mean", "sd", "sum")))
            if ranked:
                out = unit_ranks(out, group, ranked)
                out = out.withColumns({f"_p_{n.key()}": F.col(f"_p_{n.child.key()}_rank") for n in some if n.op in ("rank", "percentile_rank")}).drop(*ranked.values())
        built.update(dict.fromkeys(f"_p_{n.key()}" for n in nodes))

    relative = {k: n for k, n in every.items() if (isinstance(n, N.Unary) and n.op in N.BATCH_UNARY) or isinstance(n, N.GroupRel) or (isinstance(n, N.ClusterRel) and n.op != "gate")}

    def nesting(node: N.Node) -> int:
        return 1 + max((nesting(m) for m in node.walk() if m is not node and m.key() in relative and m.key() != node.key()), default=0)

    depths = {k: nesting(n) for k, n in relative.items()}
    for depth in sorted(set(depths.values())):
        relate([relative[k] for k, d in depths.items() if d == depth])

    for p in programs:
        value = column(p.root)
        out = out.withColumn(p.name, value.cast("double"))
    return out.select(*entities.columns, *names)
