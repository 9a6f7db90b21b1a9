"""Raw snapshots on a shared store."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest

from chronofold.sources import bronze, files

NOON = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)


def at(hours):
    t = NOON + dt.timedelta(hours=hours)
    return {"observed": t, "available": t}


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/bronze"

    def run(writer):
        store = bronze.BronzeStore(spark, root)
        return [store.write(f"s{k % 3}", f'{{"k": {k}}}'.encode(), **at(k), run_id=str(writer)) for k in range(18)] + [store.write("own", f'{{"w": {writer}}}'.encode(), **at(writer))]

    with ThreadPoolExecutor(4) as pool:
        paths = list(pool.map(run, range(4)))
    store = bronze.BronzeStore(spark, root)
    assert all(p[:18] == paths[0][:18] for p in paths)
    rows = store.manifest().collect()
    assert len(rows) == 18 + 4 and len({(r.source, r.content_hash) for r in rows}) == 22
    assert store.verify().count() == 0


def test_folds_count_each_snapshot_once(spark, tmp_path):
    store = bronze.BronzeStore(spark, f"file://{tmp_path}/b")
    assert store.manifest().count() == 0 and not store.fold() and store.latest().count() == 0
    for k in range(6):
        store.write("a", f"[{k}]".encode(), **at(k))
    assert store.fold() and not store.fold() and store.manifest().count() == 6
    store.write("a", b"[9]", **at(9))
    assert store.manifest().count() == 7
    store.sweep()
    assert store.manifest().count() == 7 and len(files.names(spark, store._entries())) == 1
    # What was folded and swept isn't entered again.
    store.write("a", b"[3]", **at(99))
    assert store.manifest().count() == 7 and store.latest().first().available_time == (NOON + dt.timedelta(hours=9)).replace(tzinfo=None)
    assert store.fold() and len(files.names(spark, store._folds())) == 2
    assert [r.text for r in store.payloads(store.latest(NOON + dt.timedelta(hours=4))).collect()] == ["[4]"]


def test_what_is_missing_changed_or_unlisted_is_found(spark, tmp_path):
    store = bronze.BronzeStore(spark, f"file://{tmp_path}/b")
    paths = [store.write("a", f"[{k}]".encode(), **at(k)) for k in range(3)]
    files.remove(spark, paths[0])
    files.remove(spark, paths[1])
    files.publish(spark, paths[1], b"other")
    files.publish(spark, f"{store.root}/a/{'0' * 64}.json.gz", b"stray")
    assert {r.problem: r.path.rsplit("/", 1)[-1] for r in store.verify().collect()} == {"missing": paths[0].rsplit("/", 1)[-1], "changed": paths[1].rsplit("/", 1)[-1], "unlisted": f"{'0' * 64}.json.gz"}
    for bad in ("", "_x", "a/b"):
        with pytest.raises(ValueError):
            store.write(bad, b"x", **at(0))


def test_a_writer_that_died_is_made_good(spark, tmp_path):
    store = bronze.BronzeStore(spark, f"file://{tmp_path}/b")
    path = store.write("a", b"[1]", **at(0))
    entry = f"{store._entries()}/{files.names(spark, store._entries())[0]}"
    files.remove(spark, entry)  # it died between payload and entry
    assert store.verify().first().problem == "unlisted"
    assert store.write("a", b"[1]", **at(0)) == path and store.manifest().count() == 1


def test_names_are_taken_once(spark, tmp_path):
    path = f"file://{tmp_path}/x/one"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: files.publish(spark, path, str(k).encode()), range(8)))
    assert sum(won) == 1 and files.read(spark, path) == str(won.index(True)).encode() and files.names(spark, f"file://{tmp_path}/x") == ["one"]
    spark.range(3).write.parquet(f"file://{tmp_path}/y/a")
    spark.range(5).write.parquet(f"file://{tmp_path}/y/b")
    assert files.publish_folder(spark, f"file://{tmp_path}/y/a", f"file://{tmp_path}/z/t") and not files.publish_folder(spark, f"file://{tmp_path}/y/b", f"file://{tmp_path}/z/t")
    assert spark.read.parquet(f"file://{tmp_path}/z/t").count() == 3 and not files.exists(spark, f"file://{tmp_path}/y/b")
