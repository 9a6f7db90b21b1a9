"""Token counts as delta-maintained rollups by source, language and tokenizer version.

The state is a folder of committed batches. A batch is a table of signed changes (an insert counts
+1, a delete -1, a revised count is the delete of the old one and the insert of the new one), summed to
one row a group before anything is stored. Sums of signed rows add up in any order, so totals are the
sum over committed batches, and ``compact`` may fold any of them into one. A batch counts from the moment
its marker is there: a file named by the batch's id that says which attempt's table holds the sums, complete
before it gets that name and never put over another one. So a batch counts once or not at all: a rerun of
one that is there, or of one whose writer died, or two writers of one id at once, change nothing that was counted.
A fold first claims each batch by a marker that only one fold can put there, and sums only what it claimed, so
two folds at once never stand for the same batch; a fold that died goes on under its own name. Folded tables
stay until ``sweep``, so that readers that began before a fold can end.

Null source or language is a group of its own. Null text counts as no tokens (its document counts).
Repeated rows count each time, as each is a change. Empty batches commit and add nothing. Groups whose
documents and tokens come to zero are left out of the totals. Other columns are left aside.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import storage, tokens

VERSION = "word_bpe_49k"
KEYS = ["source", "lang", "tokenizer"]
_CHANGES = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def counted(docs: DataFrame, vocabulary: str | None = None, version: str = VERSION) -> DataFrame:
    """doc_id, source, lang, tokenizer and n_tokens of whole texts."""
    vocabulary = vocabulary or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.coder(vocabulary)
        for batch in batches:
            for part in tokens.slices(batch):
                _, counts = coder.encode(part.column("text"))
                columns = [part.column("doc_id"), part.column("source"), part.column("lang"), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "lang", "n_tokens"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long").withColumn("tokenizer", F.lit(version))


def inserts(rows: DataFrame) -> DataFrame:
    """Changes that add counted rows."""
    return rows.select(*KEYS, F.lit(1).alias("sign"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Changes that take counted rows back."""
    return rows.select(*KEYS, F.lit(-1).alias("sign"), F.col("n_tokens").cast("long").alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes from old counted rows to new ones."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals below ``path``, kept by committed batches of changes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _marker(self, kind: str, name: str) -> str:
        if not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"id {name!r} may hold letters, digits, - and _ only")
        return f"{self.path}/{kind}/{name}"

    def committed(self, batch_id: str) -> bool:
        return storage.exists(self.spark, self._marker("batches", batch_id))

    def _publish(self, kind: str, name: str, sums: DataFrame, also: list[str]) -> bool:
        """Write the sums and name them; False, and nothing left, if the name is taken."""
        data = f"sums/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{data}")
        if storage.publish_text(self.spark, self._marker(kind, name), json.dumps({"data": data, "stands_for": also})):
            return True
        storage.remove(self.spark, f"{self.path}/{data}")
        return False

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Count a batch; False if it was counted before."""
        if self.committed(batch_id):
            return False
        summed = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.coalesce(F.sum(F.col("sign") * F.col("n_tokens")), F.lit(0)).cast("long").alias("n_tokens"))
        return self._publish("batches", batch_id, summed, [])

    def compact(self, into: str, batch_ids: list[str]) -> None:
        """Fold committed batches into one; their ids stay known and add nothing from then on.

        Batches that another fold has claimed are left to it.
        """
        folds, batches = self._state()
        folded = {b for fold in folds.values() for b in fold["stands_for"]}
        if into in folds:
            return
        mine = {}
        for b in sorted(set(batch_ids) & set(batches) - folded):
            claim = self._marker("claims", b)
            if storage.publish_text(self.spark, claim, into) or storage.read_texts(self.spark, f"{self.path}/claims")[b] == into:
                mine[b] = batches[b]["data"]
        if mine:
            sums = self._read(list(mine.values())).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            # One name makes the fold visible: it lists what it stands for.
            self._publish("folds", into, sums, list(mine))

    def sweep(self) -> None:
        """Delete the tables of batches that folds stand for; for when no reader is left that began before those folds."""
        folds, batches = self._state()
        for fold in folds.values():
            for b in fold["stands_for"]:
                storage.remove(self.spark, f"{self.path}/{batches[b]['data']}")

    def _markers(self, kind: str) -> dict[str, dict]:
        return {name: json.loads(text) for name, text in storage.read_texts(self.spark, f"{self.path}/{kind}").items()}

    def _read(self, tables: list[str]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], _CHANGES)
        return self.spark.read.schema(_CHANGES).parquet(*(f"{self.path}/{t}" for t in tables))

    def _state(self) -> tuple[dict[str, dict], dict[str, dict]]:
        """The markers of folds, then of batches, each read once: a fold that lands in between is not seen, and its batches count as they are."""
        folds = self._markers("folds")
        return folds, self._markers("batches")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens over all committed batches."""
        folds, batches = self._state()
        folded = {b for fold in folds.values() for b in fold["stands_for"]}
        live = [m["data"] for name, m in sorted(batches.items()) if name not in folded]
        rows = self._read(live + [fold["data"] for _, fold in sorted(folds.items())])
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: totals after all documents went through inserts, deletes and revised counts, in idempotent batches.

    Two quarters are inserted as they are, one of them sent twice. One quarter comes again under another id
    and is taken back by a batch of deletes. The last is registered before it is counted and then revised.
    """
    rows, _ = storage.materialise(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")), "token-counts")
    rollup = Rollup(spark, storage.new_path(spark, "token-rollup"))
    quarter = lambda k: rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k)
    registered = quarter(3).withColumn("n_tokens", F.lit(0).cast("long"))
    batches = [("load-0", inserts(quarter(0))), ("load-1", inserts(quarter(1))), ("load-0", inserts(quarter(0))), ("load-2", inserts(quarter(2))), ("again-2", inserts(quarter(2))), ("register-3", inserts(registered)), ("undo-2", deletes(quarter(2))), ("count-3", revisions(registered, quarter(3)))]
    for batch_id, changes in batches:
        rollup.commit(batch_id, changes)
    rollup.compact("fold-0", ["load-0", "load-1"])
    rollup.sweep()
    return rollup.totals()
