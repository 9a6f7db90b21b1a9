"""Typed feature programs: frozen expression trees that read and write as JSON.

There are two levels. A ROW expression has a value for each record of a history; an ENTITY expression
has one for each row to predict. Windowed nodes turn ROW into ENTITY, relative nodes stay on
ENTITY, and a program's root is on ENTITY.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any

ROW, ENTITY = "row", "entity"
# Limits of a program, and the names of its operations.
MAX_DEPTH, MAX_NODES, MAX_WINDOW = 8, 40, 40
ROLLING = ("mean", "median", "std", "min", "max", "sum", "count", "percentile")
ARITH = ("add", "sub", "mul", "safe_div", "min", "max")
UNARY = ("log1p", "neg", "abs", "clip", "zscore", "percentile_rank")
BATCH_UNARY = ("zscore", "percentile_rank")
GROUPS = ("position", "team", "opponent", "all")
GROUP_OPS = ("rank", "share", "dev_from_mean", "zscore")
CLUSTER_OPS = ("rank", "dev_from_centroid", "gate")


class ProgramError(ValueError):
    """A program that doesn't fit together."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ProgramError(what)


@dataclass(frozen=True)
class Node:
    """A node; subclasses are registered by their ``kind``."""

    kinds = {}  # noqa: RUF012
    kind = ""

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        Node.kinds[cls.kind] = cls

    def children(self) -> list["Node"]:
        return [v for f in fields(self) if isinstance(v := getattr(self, f.name), Node)]

    @property
    def level(self) -> str:
        return ENTITY

    def walk(self) -> Iterator["Node"]:
        yield self
        for child in self.children():
            yield from child.walk()

    @property
    def depth(self) -> int:
        return 1 + max((c.depth for c in self.children()), default=0)

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"kind": self.kind}
        for f in fields(self):
            v = getattr(self, f.name)
            out[f.name] = v.to_dict() if isinstance(v, Node) else v
        return out

    def canonical(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":"))

    def key(self) -> str:
        """What equal subtrees share."""
        return hashlib.sha256(self.canonical().encode()).hexdigest()[:24]


@dataclass(frozen=True)
class Source(Node):
    kind = "source"
    column: str
    scope: str = "history"

    def __post_init__(self) -> None:
        _need(bool(self.column) and self.scope in ("history", "entity"), f"bad source {self.column!r}, {self.scope!r}")

    @property
    def level(self) -> str:
        return ROW if self.scope == "history" else ENTITY


@dataclass(frozen=True)
class Const(Node):
    kind = "const"
    value: float

    @property
    def level(self) -> str:
        return ROW


def _windowed(node: Any, least: int = 1) -> None:
    _need(isinstance(node.window, int) and least <= node.window <= MAX_WINDOW, f"window {node.window} is not in {least}..{MAX_WINDOW}")


@dataclass(frozen=True)
class Rolling(Node):
    kind = "rolling"
    child: Node
    window: int
    agg: str = "mean"
    min_periods: int = 1
    quantile: float | None = None

    def __post_init__(self) -> None:
        _windowed(self)
        _need(self.child.level == ROW, "a rolling window needs a history expression")
        _need(self.agg in ROLLING and self.min_periods >= 1, f"no aggregate {self.agg!r}")
        _need(self.agg != "std" or self.min_periods >= 2, "std needs two values or more")
        _need((self.agg == "percentile") == (self.quantile is not None), "a quantile goes with percentile")
        _need(self.quantile is None or 0 <= self.quantile <= 1, "a quantile is within 0 and 1")


@dataclass(frozen=True)
class Lag(Node):
    kind = "lag"
    child: Node
    periods: int = 1

    def __post_init__(self) -> None:
        _need(self.child.level == ROW and 1 <= self.periods <= MAX_WINDOW, "a lag needs a history expression and 1 to 40 periods")


@dataclass(frozen=True)
class EwmMean(Node):
    kind = "ewm_mean"
    child: Node
    window: int
    halflife: float

    def __post_init__(self) -> None:
        _windowed(self, 2)
        _need(self.child.level == ROW and self.halflife > 0, "an ewm needs a history expression and a positive half-life")


@dataclass(frozen=True)
class Trend(Node):
    kind = "trend"
    child: Node
    window: int

    def __post_init__(self) -> None:
        _windowed(self, 3)
        _need(self.child.level == ROW, "a trend needs a history expression")


@dataclass(frozen=True)
class ShrunkRate(Node):
    kind = "shrunk_rate"
    numerator: str
    denominator: str
    window: int
    prior_strength: float = 3.0
    scale: float = 90.0

    def __post_init__(self) -> None:
        _windowed(self)
        _need(bool(self.numerator and self.denominator) and self.prior_strength >= 0 and self.scale > 0, "bad rate")


@dataclass(frozen=True)
class TimeSince(Node):
    kind = "time_since"
    event_column: str
    require_positive: bool = True


@dataclass(frozen=True)
class Arith(Node):
    kind = "arith"
    op: str
    left: Node
    right: Node
    epsilon: float = 1e-6

    def __post_init__(self) -> None:
        _need(self.op in ARITH, f"no operation {self.op!r}")
        sides = {c.level for c in (self.left, self.right) if not isinstance(c, Const)}
        _need(len(sides) <= 1, "both sides need one level")

    @property
    def level(self) -> str:
        return next((c.level for c in (self.left, self.right) if not isinstance(c, Const)), ROW)


@dataclass(frozen=True)
class Unary(Node):
    kind = "unary"
    op: str
    child: Node
    lower: float | None = None
    upper: float | None = None

    def __post_init__(self) -> None:
        _need(self.op in UNARY, f"no operation {self.op!r}")
        _need(self.op != "clip" or self.lower is not None or self.upper is not None, "clip needs a bound")
        _need(self.op not in BATCH_UNARY or self.child.level == ENTITY, f"{self.op} needs an entity expression")

    @property
    def level(self) -> str:
        return self.child.level


@dataclass(frozen=True)
class GroupRel(Node):
    kind = "group_rel"
    op: str
    by: str
    child: Node

    def __post_init__(self) -> None:
        _need(self.op in GROUP_OPS and self.by in GROUPS and self.child.level == ENTITY, "bad group expression")


@dataclass(frozen=True)
class ClusterRel(Node):
    kind = "cluster_rel"
    op: str
    child: Node
    cluster_model_version: str
    cluster_id: int | None = None

    def __post_init__(self) -> None:
        _need(self.op in CLUSTER_OPS and bool(self.cluster_model_version) and self.child.level == ENTITY, "bad cluster expression")
        _need((self.op == "gate") == (self.cluster_id is not None), "a cluster id goes with gate")


def node_from_dict(d: dict[str, Any]) -> Node:
    """A node from its JSON form; unknown kinds and keys are refused."""
    kind = Node.kinds.get(d.get("kind"))
    _need(kind is not None and d.get("kind") != "", f"no node kind {d.get('kind')!r}")
    names = {f.name for f in fields(kind)}
    extra = set(d) - names - {"kind"}
    _need(not extra, f"unknown keys {sorted(extra)}")
    try:
        return kind(**{k: node_from_dict(v) if isinstance(v, dict) else v for k, v in d.items() if k != "kind"})
    except TypeError as e:
        raise ProgramError(str(e)) from e


@dataclass(frozen=True)
class FeatureProgram:
    """A named tree; its version is the hash of what it computes, not of its name."""

    name: str
    root: Node

    def __post_init__(self) -> None:
        _need(bool(self.name) and self.root.level == ENTITY, "a program needs a name and an entity root")

    def version(self) -> str:
        return hashlib.sha256(self.root.canonical().encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "root": self.root.to_dict()}, sort_keys=True)

    @property
    def node_count(self) -> int:
        return sum(1 for _ in self.root.walk())

    @property
    def max_window(self) -> int:
        return max((getattr(n, "window", getattr(n, "periods", 0)) for n in self.root.walk()), default=0)

    def columns(self, scope: str) -> set[str]:
        out = set()
        for n in self.root.walk():
            if isinstance(n, Source) and n.scope == scope:
                out.add(n.column)
            if scope == "history" and isinstance(n, ShrunkRate):
                out |= {n.numerator, n.denominator}
            if scope == "history" and isinstance(n, TimeSince):
                out.add(n.event_column)
        return out

    @property
    def cluster_versions(self) -> set[str]:
        return {n.cluster_model_version for n in self.root.walk() if isinstance(n, ClusterRel)}


def parse_program(text: str) -> FeatureProgram:
    d = json.loads(text)
    _need(isinstance(d, dict) and set(d) == {"name", "root"}, "a program has a name and a root")
    return FeatureProgram(d["name"], node_from_dict(d["root"]))


def describe(node: Node) -> str:
    """Readable text of a tree."""
    parts = [describe(v) if isinstance(v, Node) else str(v) for f in fields(node) if (v := getattr(node, f.name)) is not None]
    return f"{node.kind}({', '.join(parts)})"


def interactions(programs: list[FeatureProgram], cap: int = 8, forms: tuple[str, ...] = ("mul", "safe_div")) -> list[FeatureProgram]:
    """Pairs of the first ``cap`` programs, each in every form; a pair is ordered by name."""
    some, out = programs[: max(0, cap)], []
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            first, second = sorted((a, b), key=lambda p: p.name)
            out += [FeatureProgram(f"{first.name}__{form}__{second.name}", Arith(form, first.root, second.root)) for form in forms if first.name != second.name]
    return out
