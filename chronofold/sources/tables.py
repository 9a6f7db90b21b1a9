"""Named tables: Parquet folders, or a catalog with SQL."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def check_identifier(name: str) -> str:
    """Letters, digits and underscores, no leading digit: safe in paths and statements."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a table name: {name!r}")
    return name


_NUMBERS = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def _wider(a: str, b: str) -> str:
    """The type that holds values of both: the wider number, else text."""
    return _NUMBERS[max(_NUMBERS.index(a), _NUMBERS.index(b))] if a in _NUMBERS and b in _NUMBERS else "string"


class TableStore(Protocol):
    """What both stores offer."""

    def write_table(self, name: str, frame: DataFrame) -> None: ...

    def append_table(self, name: str, frame: DataFrame) -> None: ...

    def read_table(self, name: str) -> DataFrame: ...

    def table_exists(self, name: str) -> bool: ...

    def list_tables(self) -> list[str]: ...

    def query(self, sql: str, **params: Any) -> DataFrame: ...

    def execute(self, sql: str) -> None: ...


class ParquetStore:
    """One folder a table below ``root``; appends may bring new columns."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{check_identifier(name)}"

    def _fs(self, path: str):
        hpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hpath

    def write_table(self, name: str, frame: DataFrame) -> None:
        """Replace a table. A frame may read what it replaces.

        The new files are complete and the old ones set aside before the new ones take the name, so that a
        crash at any point leaves one whole table: ``read_table`` and the next write take up what is set aside.
        """
        path, staged, old = (f"{self.root}/{prefix}{check_identifier(name)}" for prefix in ("", "_staged_", "_old_"))
        self._recover(name)
        frame.write.mode("overwrite").parquet(staged)
        fs, target = self._fs(path)
        aside = self._fs(old)[1]
        if fs.exists(target) and not fs.rename(target, aside):
            raise OSError(f"could not set {path} aside")
        if not fs.rename(self._fs(staged)[1], target):
            raise OSError(f"could not name {path}")
        fs.delete(aside, True)

    def _recover(self, name: str) -> None:
        """Undo or finish a replacement that a crash cut short."""
        fs, target = self._fs(self._path(name))
        aside = self._fs(f"{self.root}/_old_{check_identifier(name)}")[1]
        if fs.exists(aside):
            if fs.exists(target):
                fs.delete(aside, True)
            else:
                fs.rename(aside, target)

    def append_table(self, name: str, frame: DataFrame) -> None:
        """Add rows; new columns are null in old rows. Where a column's type changes to a wider one, the old rows are cast."""
        if self.table_exists(name):
            have = self.read_table(name)
            kinds = dict(have.dtypes)
            changed = {c: _wider(kinds[c], k) for c, k in frame.dtypes if c in kinds and kinds[c] != k}
            frame = frame.withColumns({c: F.col(c).cast(k) for c, k in changed.items()})
            if any(kinds[c] != k for c, k in changed.items()):
                self.write_table(name, have.withColumns({c: F.col(c).cast(k) for c, k in changed.items()}))
        frame.write.mode("append").parquet(self._path(name))

    def read_table(self, name: str) -> DataFrame:
        self._recover(name)
        if not self.table_exists(name):
            raise KeyError(name)
        return self.spark.read.option("mergeSchema", "true").parquet(self._path(name))

    def table_exists(self, name: str) -> bool:
        fs, path = self._fs(self._path(name))
        return fs.exists(path)

    def list_tables(self) -> list[str]:
        fs, root = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and not s.getPath().getName().startswith("_")) if fs.exists(root) else []

    def query(self, sql: str, **params: Any) -> DataFrame:
        """SQL over the tables by their names, with named parameters (``:name``)."""
        for name in self.list_tables():
            self.read_table(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=params or None)

    def execute(self, sql: str) -> None:
        self.spark.sql(sql)


class CatalogStore:
    """Tables of the session's catalog."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def write_table(self, name: str, frame: DataFrame) -> None:
        frame.write.mode("overwrite").saveAsTable(check_identifier(name))

    def append_table(self, name: str, frame: DataFrame) -> None:
        frame.write.mode("append").saveAsTable(check_identifier(name))

    def read_table(self, name: str) -> DataFrame:
        if not self.table_exists(name):
            raise KeyError(name)
        return self.spark.table(name)

    def table_exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(check_identifier(name))

    def list_tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if not t.isTemporary)

    def query(self, sql: str, **params: Any) -> DataFrame:
        return self.spark.sql(sql, args=params or None)

    def execute(self, sql: str) -> None:
        self.spark.sql(sql)


def upsert_keep_last(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where keys repeat, the new batch's row stays, and within a batch the largest by its other columns.

    The order is declared, so the row that stays doesn't depend on where rows lie.
    """
    both = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_batch"]
    order = Window.partitionBy(*keys).orderBy(F.desc("_batch"), *(F.desc(c) for c in rest))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_batch")


def training_manifest_hash(frame: DataFrame, season: str = "season", gameweek: str = "gameweek_id", player: str = "player_code", available: str = "available_time") -> str:
    """SHA-256 of what a training table holds: size, types, distinct seasons, gameweeks and players, newest record."""
    row = frame.agg(F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set(season)).alias("seasons"), F.count_distinct(gameweek).alias("gameweeks"), F.count_distinct(player).alias("players"), F.max(available).cast("string").alias("newest")).first()
    return hashlib.sha256(json.dumps({**row.asDict(), "types": frame.dtypes}, sort_keys=True).encode()).hexdigest()


def write_importance(store: ParquetStore, name: str, frame: DataFrame) -> None:
    store.write_table(name, frame)


def read_importance(store: ParquetStore, name: str) -> DataFrame:
    """An importance table; one from before positions were told apart is the pooled slice ("ALL"), with no rows counted."""
    frame = store.read_table(name)
    missing = {c: v for c, v in (("position", F.lit("ALL")), ("rows_measured", F.lit(0).cast("long"))) if c not in frame.columns}
    return frame.withColumns(missing) if missing else frame


class RunStore:
    """Results of an experiment's units, one folder a unit, so that a run can be taken up where it stopped."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, unit: str) -> str:
        return f"{self.root}/unit={check_identifier(unit)}"

    def write_run(self, unit: str, frame: DataFrame) -> None:
        """Keep a unit's rows. Spark marks a folder when all of it is written; without the mark it doesn't count."""
        frame.write.mode("overwrite").parquet(self._path(unit))

    def _done(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        marks = jvm.org.apache.hadoop.fs.Path(f"{self.root}/unit=*/_SUCCESS")
        found = marks.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
        return sorted(s.getPath().getParent().getName().removeprefix("unit=") for s in found or [])

    def read_run(self, unit: str, schema: str) -> DataFrame | None:
        """A unit's rows, or nothing where it isn't complete."""
        return self.spark.read.schema(schema).parquet(self._path(unit)) if unit in self._done() else None

    def completed_units(self) -> DataFrame:
        return self.spark.createDataFrame([(u,) for u in self._done()], "unit string")


def plan_units(policies: DataFrame, squads: DataFrame, windows: DataFrame, seeds: DataFrame) -> DataFrame:
    """The grid of an experiment's units: policy (with ``stochastic``) x squad x window, and x seed only where chance is in it."""
    grid = policies.crossJoin(squads).crossJoin(windows)
    drawn = grid.where("stochastic").crossJoin(seeds)
    fixed = grid.where("NOT stochastic").withColumn("seed", F.lit(None).cast(seeds.schema["seed"].dataType))
    both = fixed.unionByName(drawn)
    return both.withColumn("unit", F.concat_ws("_", F.lit("u"), "policy", F.col("squad").cast("string"), "window", F.coalesce(F.col("seed").cast("string"), F.lit("any"))))


def open_units(units: DataFrame, completed: DataFrame) -> DataFrame:
    """The units that are still to be run."""
    return units.join(completed.select("unit"), "unit", "left_anti")


def coverage(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: share of rows with a value, and whether it is constant."""
    aggregates = [a for c in columns for a in (F.count(c).alias(f"n_{c}"), F.count_distinct(c).alias(f"d_{c}"))]
    one = frame.agg(F.count(F.lit(1)).alias("n"), *aggregates)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.try_divide(F.col(f"n_{c}"), F.col("n")).alias("coverage"), (F.col(f"d_{c}") <= 1).alias("constant")) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def preseason_hazards(frame: DataFrame, columns: list[str], small: float = 5.0, nulls: float = 0.5) -> DataFrame:
    """One row a column: all zero, never above ``small``, or mostly null."""
    aggregates = [a for c in columns for a in (F.bool_and(F.coalesce(F.col(c), F.lit(0)) == 0).alias(f"z_{c}"), F.max(c).cast("double").alias(f"m_{c}"), F.avg(F.col(c).isNull().cast("int")).alias(f"u_{c}"))]
    one = frame.agg(*aggregates)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"z_{c}").alias("all_zero"), (F.col(f"m_{c}") <= small).alias("never_large"), (F.col(f"u_{c}") > nulls).alias("mostly_null")) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")
