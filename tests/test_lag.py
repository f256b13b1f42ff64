"""The blocked correlation against all products of two series."""

import random

import pytest
from pyspark.sql import functions as F

from framewarden.operators import lag


def plain(steps, window, tail=False, max_lag=None, scale=False):
    out = {}
    for name in {s[0] for s in steps}:
        own = {}
        for f, i, a, v in steps:
            if f == name:
                x, y = own.get(i, (0.0, 0.0))
                own[i] = (x + (a or 0), y + (v or 0))
        last = max(own)
        own = {i: s for i, s in own.items() if (last + 1 > 2 * window and i > last - window if tail else 0 <= i < window)}
        if not own:
            continue
        lo, n = min(own), max(own) - min(own) + 1
        series = [[own.get(lo + k, (0.0, 0.0))[c] for k in range(n)] for c in (0, 1)]
        if scale:
            series = [[x / m for x in s] if (m := max(own[i][c] for i in own)) > 0 else s for c, s in enumerate(series)]
        a, v = series
        reach = n - 1 if max_lag is None else min(n - 1, max_lag)
        corr = {d: sum(a[k] * v[k + d] for k in range(max(0, -d), min(n, n - d))) for d in range(-reach, reach + 1)}
        best = max(corr.values())
        out[name] = (min(d for d, c in corr.items() if c == best), best)
    return out


@pytest.mark.parametrize("block", [4, 128])
def test_blocked_correlation(spark, monkeypatch, block):
    monkeypatch.setattr(lag, "BLOCK_STEPS", block)
    pick = random.Random(block)
    steps = [("shifted", i + s, 9 * (i % 17 == 0) if s == 0 else None, 9 * (i % 17 == 0) if s else 0) for i in range(60) for s in (0, 5)]
    steps += [("noise", i, pick.randint(0, 9), pick.randint(0, 9)) for i in range(90) if i % 7]
    steps += [("negative", i, -pick.randint(1, 9), pick.randint(1, 9)) for i in range(40)]
    steps += [("silent", i, 0, 0) for i in (3, 30)] + [("one", 7, 2, 3), ("holes", 0, 5, 0), ("holes", 50, 0, 4), ("before", -3, 9, 9), ("before", 2, 1, 1)]
    series = spark.createDataFrame([(f, i, None if a is None else float(a), float(v)) for f, i, a, v in steps], "file_id string, i long, a double, v double")
    for options in ({"window": 64}, {"window": 30, "tail": True}, {"window": 1000, "max_lag": 6}, {"window": 25, "max_lag": 3, "tail": True}):
        got = {r.file_id: (r.lag, r.corr) for r in lag.xcorr_lag(series, **options).collect()}
        assert got == plain(steps, **options), options
    scaled = {r.file_id: (r.lag, r.corr) for r in lag.xcorr_lag(series, 64, scale=True).collect()}
    want = plain(steps, 64, scale=True)
    assert {k: x[0] for k, x in scaled.items()} == {k: x[0] for k, x in want.items()}
    assert {k: x[1] for k, x in scaled.items()} == pytest.approx({k: x[1] for k, x in want.items()})
    assert lag.xcorr_lag(series.limit(0), 64).collect() == []


def test_the_work_of_one_file_is_dealt_out(spark):
    n = lag.WINDOW_STEPS
    series = spark.range(n).select(
        F.lit(1).alias("file_id"), F.col("id").alias("i"), (F.col("id") * 7 % 31).cast("double").alias("a"), ((F.col("id") - 90) * 7 % 31 * (F.col("id") >= 90).cast("int")).cast("double").alias("v")
    )
    best = lag.xcorr_lag(series, n).first()
    assert best.lag % 31 == 90 % 31
