"""Rules read from a file, and samples by quotas."""

import hashlib
import json

import pytest

from chronofold.operators.scoring import Rules
from chronofold.sources import files, normalise


def test_rules_are_read_and_pinned(spark, tmp_path):
    path = f"file://{tmp_path}/rules.json"
    payload = json.dumps({"goals": {"FWD": 7}, "per_event": {"assists": 4}}).encode()
    files.publish(spark, path, payload)
    rules = normalise.read_rules(spark, path, hashlib.sha256(payload).hexdigest())
    assert rules.goals == {**Rules().goals, "FWD": 7} and rules.per_event["assists"] == 4 and rules.conceded == Rules().conceded
    with pytest.raises(ValueError, match="sum"):
        normalise.read_rules(spark, path, "0" * 64)
    files.publish(spark, f"file://{tmp_path}/bad.json", b'{"golas": {}}')
    with pytest.raises(ValueError, match="golas"):
        normalise.read_rules(spark, f"file://{tmp_path}/bad.json")


def test_quotas_are_applied_in_order(spark):
    rows = spark.createDataFrame([(k, k % 3, k % 2) for k in range(120)], "key long, season int, club int")
    kept = normalise.quota_sample(rows, "key", 5, {("season", "club"): 4, ("club",): 7}).collect()
    assert sorted(sum(r.club == c for r in kept) for c in (0, 1)) == [7, 7] and max(sum((r.season, r.club) == (s, c) for r in kept) for s in range(3) for c in range(2)) <= 4
    assert {r.key for r in kept} == {r.key for r in normalise.quota_sample(rows.repartition(6), "key", 5, {("season", "club"): 4, ("club",): 7}).collect()}
