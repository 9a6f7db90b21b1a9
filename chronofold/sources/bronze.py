"""Immutable raw snapshots by content, and their manifest, on any store that Spark reaches.

A snapshot is one gzip file named by the SHA-256 of its payload. Its manifest entry is a small file of its own, named by source and
content, that is published when the snapshot is complete and never put over another one; so any number of writers
may share a store, and each snapshot counts once. ``fold`` gathers entries into one file; entries that a fold holds count once
as well, and stay until ``sweep``, for readers that began before the fold. The manifest is a table that Spark reads
from all of these, and ``verify`` holds every stored file against it. Payloads are single API responses, which the driver hands over.
"""

from __future__ import annotations

import gzip
import hashlib
import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.sources import files

MANIFEST = "source string, path string, content_hash string, stored_hash string, byte_size long, event_time timestamp, observed_time timestamp, available_time timestamp, processed_time timestamp, run_id string, http_status int"


class BronzeStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _entries(self) -> str:
        return f"{self.root}/_manifest/entries"

    def _folds(self) -> str:
        return f"{self.root}/_manifest/folds"

    def write(self, source: str, payload: bytes, *, observed: datetime, available: datetime, event: datetime | None = None, run_id: str = "", status: int = 200) -> str:
        """Keep a payload once a source and content; gives its path."""
        for t in (observed, available, event):
            if t is not None and t.tzinfo is None:
                raise ValueError("times need a zone")
        if not source or source.startswith(("_", ".")) or "/" in source:
            raise ValueError(f"not a source's name: {source!r}")
        digest = hashlib.sha256(payload).hexdigest()
        path = f"{self.root}/{source}/{digest}.json.gz"
        stored = gzip.compress(payload, mtime=0)
        # The payload first: an entry never names what isn't there, and a rerun of a writer that died adds what is missing.
        if not files.exists(self.spark, path):
            files.publish(self.spark, path, stored)
        if not files.exists(self.spark, f"{self._entries()}/{source}-{digest}.json"):
            row = {"source": source, "path": path, "content_hash": digest, "stored_hash": hashlib.sha256(stored).hexdigest(), "byte_size": len(payload), "event_time": (event or available).isoformat(), "observed_time": observed.isoformat(), "available_time": available.isoformat(), "processed_time": datetime.now(observed.tzinfo).isoformat(), "run_id": run_id, "http_status": status}
            if not self._folded(source, digest):
                files.publish(self.spark, f"{self._entries()}/{source}-{digest}.json", (json.dumps(row) + "\n").encode())
        return path

    def _folded(self, source: str, digest: str) -> bool:
        """Whether a fold holds a snapshot whose entry was swept."""
        if not files.names(self.spark, self._folds()):
            return False
        return bool(self.manifest().where((F.col("source") == source) & (F.col("content_hash") == digest)).limit(1).count())

    def read(self, path: str) -> bytes:
        """The payload; raises if it isn't what was written."""
        payload = gzip.decompress(files.read(self.spark, path))
        if hashlib.sha256(payload).hexdigest() != path.rsplit("/", 1)[-1].split(".")[0]:
            raise ValueError(f"{path} was changed")
        return payload

    def manifest(self) -> DataFrame:
        """One row a snapshot."""
        parts = [p for p in (self._folds(), self._entries()) if files.names(self.spark, p)]
        if not parts:
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).json(parts)
        # An entry and the fold that holds it are one row; of two writers' entries there is one only.
        return rows.dropDuplicates(["source", "content_hash"])

    def fold(self) -> bool:
        """Gather the entries that are there into one file; False if there are none that a fold doesn't hold already."""
        entries = files.names(self.spark, self._entries())
        held = {name for fold in files.names(self.spark, self._folds()) for name in self._held(fold)}
        new = [n for n in entries if n not in held]
        if not new:
            return False
        text = b"".join(files.read(self.spark, f"{self._entries()}/{n}") for n in new)
        return files.publish(self.spark, f"{self._folds()}/{hashlib.sha256(text).hexdigest()}.json", text)

    def _held(self, fold: str) -> list[str]:
        lines = files.read(self.spark, f"{self._folds()}/{fold}").decode().splitlines()
        return [f"{row['source']}-{row['content_hash']}.json" for row in map(json.loads, lines)]

    def sweep(self) -> None:
        """Remove entries that folds hold; for when no reader is left that began before those folds."""
        for fold in files.names(self.spark, self._folds()):
            for name in self._held(fold):
                files.remove(self.spark, f"{self._entries()}/{name}")

    def verify(self) -> DataFrame:
        """path and problem (missing, changed, unlisted) of every stored file that isn't as the manifest says; the files are hashed where Spark reads them."""
        short = lambda c: F.element_at(F.split(c, "/"), -1)
        key = lambda c: F.concat_ws("/", F.element_at(F.split(c, "/"), -2), short(c))
        listed = self.manifest().select(key(F.col("path")).alias("key"), F.col("path").alias("listed"), "stored_hash")
        folders = [f"{self.root}/{n}" for n in files.names(self.spark, self.root)]
        if folders:
            stored = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json.gz").load(folders)
            stored = stored.select(key(F.col("path")).alias("key"), F.col("path").alias("stored"), F.sha2("content", 256).alias("found"))
        else:
            stored = self.spark.createDataFrame([], "key string, stored string, found string")
        both = listed.join(stored, "key", "full")
        problem = F.when(F.col("stored").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("found") != F.col("stored_hash"), "changed")
        return both.select(F.coalesce("listed", "stored").alias("path"), problem.alias("problem")).where("problem IS NOT NULL")

    def payloads(self, rows: DataFrame) -> DataFrame:
        """source, content_hash and text of manifest rows, read and unpacked by Spark."""
        folders = [f"{self.root}/{n}" for n in files.names(self.spark, self.root)]
        if not folders:
            return rows.select("source", "content_hash", F.lit(None).cast("string").alias("text")).limit(0)
        texts = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json.gz").text(folders, wholetext=True)
        at = F.split(F.col("_metadata.file_path"), "/")
        named = texts.select(F.col("value").alias("text"), F.element_at(at, -2).alias("source"), F.split(F.element_at(at, -1), r"\.")[0].alias("content_hash"))
        return rows.select("source", "content_hash").join(named, ["source", "content_hash"])

    def latest(self, as_of: datetime | None = None) -> DataFrame:
        """Each source's newest snapshot that was available at ``as_of``."""
        rows = self.manifest()
        if as_of is not None:
            rows = rows.where(F.col("available_time") <= F.lit(as_of))
        newest = F.max_by(F.struct(*rows.columns), F.struct("available_time", "content_hash")).alias("r")
        return rows.groupBy("source").agg(newest).select("r.*")

    def snapshots(self, source: str) -> DataFrame:
        return self.manifest().where(F.col("source") == source).orderBy("observed_time", "content_hash")
