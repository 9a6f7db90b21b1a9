"""Resampled intervals."""

import hashlib
import math

import numpy as np
import pytest

from chronofold.operators import bootstrap


def draws(*key):
    text = hashlib.md5(":".join(map(str, key)).encode()).hexdigest()
    return [int(text[8 * k : 8 * k + 8], 16) / 2**32 for k in range(4)]


def frame(spark, blocks, values=5):
    rng = np.random.default_rng(2)
    rows = [(f"b{k:04d}", k % 3, float(rng.normal(k % 7, 2)) if v else None) for k in range(blocks) for v in range(values)]
    return spark.createDataFrame(rows, "block string, part int, y double"), rows


def test_few_blocks_are_drawn(spark):
    df, rows = frame(spark, 9)
    sums = [(sum(r[2] for r in rows if r[0] == b and r[2] is not None), sum(r[0] == b and r[2] is not None for r in rows)) for b in sorted({r[0] for r in rows})]
    means = []
    for r in range(200):
        u = [x for q in range(3) for x in draws(7, r, q)][:9]
        some = [sums[int(x * 9)] for x in u]
        means.append(sum(s for s, _ in some) / sum(n for _, n in some))
    got = bootstrap.block_bootstrap(df, "block", "y", 200, 7).first()
    assert (got.low, got.mean, got.high) == pytest.approx((np.quantile(means, 0.025), np.mean(means), np.quantile(means, 0.975)))
    assert (got.blocks, got.how) == (9, "drawn")


def test_many_blocks_are_weighed(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "FEW", 20)
    df, rows = frame(spark, 60)
    means = []
    for r in range(101):
        s = n = 0
        for b in sorted({r[0] for r in rows}):
            u = draws(7, b, r // 4)[r % 4]
            w = sum(u >= p for p in bootstrap.POISSON)
            own = [x[2] for x in rows if x[0] == b and x[2] is not None]
            s, n = s + w * sum(own), n + w * len(own)
        means.append(s / n)
    got = bootstrap.block_bootstrap(df.repartition(5), "block", "y", 101, 7).first()
    assert (got.low, got.mean, got.high) == pytest.approx((np.quantile(means, 0.025), np.mean(means), np.quantile(means, 0.975))) and got.how == "weighed"
    # Both ways tell about the same spread.
    monkeypatch.setattr(bootstrap, "FEW", 512)
    other = bootstrap.block_bootstrap(df, "block", "y", 2000, 7).first()
    assert (got.high - got.low) == pytest.approx(other.high - other.low, rel=0.35)


def test_conditions_stand_in_for_too_few_blocks(spark):
    df, _ = frame(spark, 2)
    assert bootstrap.block_bootstrap(df, "block", "y", 50, condition=["block", "part"]).first().blocks == 2
    assert bootstrap.block_bootstrap(df.withColumn("one", df.part * 0), "one", "y", 50, condition=["part"]).first().blocks == 2
    empty = bootstrap.block_bootstrap(df.limit(0), "block", "y", 50).first()
    assert tuple(empty) == (None, None, None, 0, "none")


def test_poisson_weights(spark):
    shares = np.diff([0, *bootstrap.POISSON])
    assert shares[:4] == pytest.approx([math.exp(-1), math.exp(-1), math.exp(-1) / 2, math.exp(-1) / 6])
