"""Mergeable validators against folding each segment by itself."""

import random

import pytest
from pyspark.sql import functions as F

from framewarden.operators.folding import Validator, map_segments


def validators():
    """Functions of a function travel to the workers by value."""

    def _longest(state, batch):
        """Longest run of bad rows: (rows, leading, trailing, longest)."""
        n, lead, trail, best = state
        for bad in batch["bad"]:
            trail = trail + 1 if bad else 0
            lead = lead + 1 if bad and lead == n else lead
            n, best = n + 1, max(best, trail)
        return n, lead, trail, best

    def _join(a, b):
        lead = a[0] + b[1] if a[1] == a[0] else a[1]
        trail = a[2] + b[0] if b[2] == b[0] else b[2]
        return a[0] + b[0], lead, trail, max(a[3], b[3], a[2] + b[1])

    def _raise(*_):
        raise RuntimeError("boom")

    RUNS = Validator(lambda: (0, 0, 0, 0), _longest, _join, lambda s: f"{s[0]} rows, {s[3]} in a row")
    VALIDATORS = {
        "runs": RUNS,
        "rows": Validator(lambda: 0, lambda n, b: n + len(b), lambda a, b: a + b, lambda n: "PASSED" if n > 3 else "WARNING"),
        "init": Validator(_raise, RUNS.update, RUNS.merge, RUNS.finish),
        "update": Validator(RUNS.init, _raise, RUNS.merge, RUNS.finish),
        "finish": Validator(RUNS.init, RUNS.update, RUNS.merge, _raise),
    }
    return RUNS, VALIDATORS, _raise


RUNS, VALIDATORS, _raise = validators()


@pytest.fixture(autouse=True)
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_every_validator_of_every_segment(spark, parts):
    pick = random.Random(parts)
    # One segment holds half of all rows; names of segments may be null.
    rows = [(pick.choice([1, None]), i % 9, i, pick.random() < 0.7) for i in range(700)] + [(2, 0, i, pick.random() < 0.95) for i in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame(rows, "file_id long, segment_id int, at long, bad boolean").repartition(5)
        got = {(r.file_id, r.segment_id, r.module): (r.status, r.error) for r in map_segments(frame, VALIDATORS, order="at").collect()}
        spread = map_segments(frame, {"rows": VALIDATORS["rows"]}).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = {}
    for key in {r[:2] for r in rows}:
        flags = [bad for *own, _, bad in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2]) if tuple(own) == key]
        best = max(map(len, "".join("x" if b else " " for b in flags).split()), default=0)
        want[*key, "runs"] = (f"{len(flags)} rows, {best} in a row", None)
        want[*key, "rows"] = ("PASSED" if len(flags) > 3 else "WARNING", None)
        want |= {(*key, m): ("CRASHED", "boom") for m in ("init", "update", "finish")}
    assert got == want and spread == len({r[:2] for r in rows})


def test_a_failing_merge_and_no_rows(spark):
    frame = spark.range(4000).select(F.lit(1).alias("file_id"), F.lit(0).alias("segment_id"), F.col("id").alias("at"), F.lit(True).alias("bad"))
    broken = {"merge": Validator(RUNS.init, RUNS.update, _raise, RUNS.finish), "runs": RUNS}
    got = {r.module: (r.status, r.error) for r in map_segments(frame, broken, order="at").collect()}
    assert got == {"merge": ("CRASHED", "boom"), "runs": ("4000 rows, 4000 in a row", None)}
    assert map_segments(frame.limit(0), broken).collect() == []
