"""Where the operators of this package keep intermediate tables.

Every cut of lineage is a Parquet table below the folder named by ``spark.checkpoint.dir``, which
driver and executors share, so a lost executor costs a re-read and never a recomputation from text.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import tokens
from chronofold.sources import files

_created: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder; where the session names none and runs on one machine (as in tests), a local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chronofold-")
        spark.conf.set("spark.checkpoint.dir", root)
        _created.append((spark, root))
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table; it is removed when the program ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _created.append((spark, path))
    return path


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that is no longer read."""
    fs, hpath = _filesystem(spark, path)
    fs.delete(hpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _filesystem(spark, path)
    return fs.exists(hpath)


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """A small file with this content, complete before it gets its name; False if the name is taken."""
    return files.publish(spark, path, text.encode())


def read_texts(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name and content of the files that ``publish_text`` put in a folder."""
    fs, hpath = _filesystem(spark, folder)
    if not fs.exists(hpath):
        return {}
    out = {}
    for status in fs.listStatus(hpath):
        name = status.getPath().getName()
        if not name.startswith("."):
            stream = fs.open(status.getPath())
            out[name] = bytes(stream.readAllBytes()).decode()
            stream.close()
    return out


def size_bytes(spark: SparkSession, path: str) -> int:
    """Bytes that a written table takes in its files."""
    fs, hpath = _filesystem(spark, path)
    return fs.getContentSummary(hpath).getLength()


def fits(table: DataFrame, path: str, most: int) -> bool:
    """Whether a written table takes at most ``most`` bytes in memory: what a broadcast is judged by.

    A row costs 48 bytes and 8 a column; texts, binaries and arrays (of longs) come to that by their lengths.
    """
    if size_bytes(table.sparkSession, path) > most:
        return False
    widths = [F.octet_length(c) if kind in ("string", "binary") else 8 * F.size(c) for c, kind in table.dtypes if kind in ("string", "binary") or kind.startswith("array")]
    row = table.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(w), F.lit(0)).alias(f"w{k}") for k, w in enumerate(widths))).first()
    return row[0] * (48 + 8 * len(table.columns)) + sum(row[1:]) <= most


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder once and read it back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    tokens.release_memory()
    return spark.read.schema(df.schema).parquet(path), path


@atexit.register
def _clean() -> None:
    for spark, path in _created:
        try:
            remove(spark, path)
        except Exception:  # the session may be stopped by now; what is local can still go
            if path.startswith("file://"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
