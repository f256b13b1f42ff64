"""Chunked sequence operators against plain loops over random small inputs."""

import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from framewarden.operators.chunks import index_chunk, numbered, running, with_previous
from framewarden.operators.density import broadcast_bursts
from framewarden.operators.intervals import (
    overlap_anti_join,
    pair_start_end,
    severity_heatmap,
    stitch_events,
)
from framewarden.operators.islands import consecutive_runs, gap_islands

EVENT = (
    "file_id long, ord long, type string, start_time double, end_time double, severity string, details string"
)


def loop_stitch(events, tol=0.1):
    out = []
    groups = defaultdict(list)
    for e in events:
        groups[(e[0], e[2])].append(e)
    for (f, t), rows in groups.items():
        rows = sorted(rows, key=lambda e: (e[3] or 0.0, e[1]))
        cur = None
        for e in rows:
            s, en, d = e[3] or 0.0, e[4] or 0.0, e[6] or ""
            if cur and s <= cur[3] + tol:
                cur[3] = max(cur[3], en)
                if d not in cur[5]:
                    cur[5] += " | " + d
                cur[6] += 1
                continue
            if cur:
                out.append(tuple(cur))
            cur = [f, t, s, en, e[5], d, 1, e[1]]
        out.append(tuple(cur))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,width", [(1, 0.5), (2, 3.0), (3, 600.0)])
def test_stitch_events_matches_loop(spark, seed, width):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        s = rnd.choice([None, round(rnd.random() * 20, 1), round(rnd.random() * 60, 1)])
        length = rnd.choice([0.0, 0.1, 0.3, 1.0, 9.0])
        e = rnd.choice([None, (s or 0.0) + length, (s or 0.0) + length, (s or 0.0) - 0.5])
        rows.append(
            (rnd.randrange(3), i, rnd.choice(["a", "b", "c", None]), s, e, rnd.choice(["X", None]),
             rnd.choice(["p", "pq", "r", None]))
        )
    got = stitch_events(spark.createDataFrame(rows, EVENT), width=width).collect()
    cols = ("file_id", "type", "start_time", "end_time", "severity", "details", "n_events", "ord")
    assert sorted([tuple(r[c] for c in cols) for r in got], key=str) == loop_stitch(rows)


def test_consecutive_runs_cross_chunks(spark):
    rnd = random.Random(5)
    rows = [(f, i, rnd.random() < 0.8, rnd.randrange(100)) for f in range(3) for i in range(200)]
    rows += [(9, i, True, i) for i in range(64)]
    want = []
    for f in {r[0] for r in rows}:
        run = []
        for r in [r for r in rows if r[0] == f] + [(f, None, False, 0)]:
            if r[2]:
                run.append(r)
            elif run:
                want.append((f, run[0][1], run[-1][1], len(run), max(x[3] for x in run), run[0][3], run[-1][3]))
                run = []
    df = spark.createDataFrame(rows, "file_id int, i long, hit boolean, v int").withColumn("one", F.lit(1))
    got = consecutive_runs(
        df, ["file_id"], "i", F.col("hit"),
        {"n": ("sum", "one"), "peak": ("max", "v"), "a": ("first", "v"), "z": ("last", "v")}, chunk_rows=8,
    ).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_gap_islands_cross_chunks(spark):
    rnd = random.Random(6)
    times = sorted({(f, round(rnd.random() * 300, 1)) for f in range(3) for _ in range(150)})
    want = []
    for f in range(3):
        cur = None
        for _, t in [x for x in times if x[0] == f]:
            if cur and t - cur[2] <= 1.5:
                cur[2] = t
                cur[3] += 1
            else:
                if cur:
                    want.append(tuple(cur))
                cur = [f, t, t, 1]
        want.append(tuple(cur))
    df = spark.createDataFrame(times, "file_id int, ts double").withColumn("one", F.lit(1))
    got = gap_islands(df, ["file_id"], "ts", 1.5, {"n": ("sum", "one")}, width=7.0).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_overlap_anti_join(spark):
    rnd = random.Random(7)

    def some(n):
        out = []
        for i in range(n):
            s = rnd.randrange(600) / 10
            out.append((rnd.randrange(2), i, s, s + rnd.choice([0.0, 0.1, 0.5, 8.0])))
        return out

    left, right = some(150), some(40)
    want = [x for x in left if not any(x[0] == r[0] and x[2] < r[3] and x[3] > r[2] for r in right)]
    schema = "file_id int, n int, start double, end double"
    got = overlap_anti_join(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["file_id"], width=2.0
    ).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pair_start_end(spark):
    rnd = random.Random(8)
    rows = [(f, i, rnd.choice(["start", "end"]), float(i)) for f in range(3) for i in range(120) if rnd.random() < 0.9]
    want = []
    for f in range(3):
        stack = []
        for r in [r for r in rows if r[0] == f]:
            if r[2] == "start":
                stack.append(r)
            elif stack:
                s = stack.pop()
                want.append((f, r[1], s[3], r[3]))
    df = spark.createDataFrame(rows, "file_id int, line_no long, kind string, at double")
    for chunk_rows in (4, 16, 1000):
        got = pair_start_end(df, ["file_id"], chunk_rows=chunk_rows).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def loop_bursts(frames, mode="strict"):
    out = []
    window, events = [], []
    for ts, ymin, ymax, sat in frames:
        if ymin < 16:
            window.append((ts, "u", ymin, round(min(abs(ymin - 16) / 20, 1), 2) * 100))
        if ymax > 235:
            window.append((ts, "o", ymax, round(min(abs(ymax - 235) / 20, 1), 2) * 100))
        if sat > 110:
            window.append((ts, "s", sat, round(min(abs(sat - 110) / 20, 1), 2) * 100))
        window = [w for w in window if w[0] > ts - 2_000_000]
        high = [w for w in window if w[3] >= 80 and w[1] != "s"]
        if len(high) > 10:
            if not events or events[-1][1] < ts - 500_000:
                events.append([window[0][0], ts, high[-1][2], max(h[3] for h in high)])
            else:
                events[-1][1] = ts
    return [(s / 1e6, e / 1e6, w, c) for s, e, w, c in events]


def test_broadcast_bursts(spark):
    rnd = random.Random(9)
    rows, want = [], []
    for f in range(2):
        frames, level = [], 0
        for i in range(1500):
            if i % 50 == 0:
                level = rnd.choice([0.0, 0.1, 0.5])
            bad = rnd.random() < level
            frames.append(
                (i * 40_000, 0 if bad and rnd.random() < 0.5 else 20, 255 if bad else rnd.choice([200, 240]),
                 rnd.choice([50, 120]))
            )
        rows += [(f, i, *fr) for i, fr in enumerate(frames)]
        want += [(f, *b) for b in loop_bursts(frames)]
    df = spark.createDataFrame(rows, "file_id int, frame_idx long, pts_us long, ymin int, ymax int, satmax int")
    got = broadcast_bursts(df, width=3_000_000).collect()
    assert len(want) > 3
    assert sorted((r.file_id, r.start_time, r.end_time, int(r.details.split()[-1]), r.confidence) for r in got) == sorted(want)


def test_severity_heatmap(spark):
    rnd = random.Random(10)
    rows, want = [], []
    for f in range(3):
        evs = []
        for _ in range(30):
            s = rnd.random() * 90 - 5
            evs.append((s, s + rnd.choice([-3.0, 0.0, 0.5, 4.0, 30.0]), rnd.choice([0, 1, 2, 3, 5])))
        if f == 2:
            evs = [(0.0, 0.0, 2)]
        if f == 1:  # one long event over chunks in which nothing starts
            evs = [(3.0, 70.0, 3), (1.0, 2.0, 5), (90.0, 70.5, 5), (95.0, 20.0, 5)]
        last = max(e for _, e, _ in evs)
        n = int(10 if last <= 0 else last) + 1
        bins = [0] * n
        for s, e, score in evs:
            a, b = max(0, min(int(s), n - 1)), max(0, min(int(e), n - 1))
            for t in range(a, b + 1):
                bins[t] = max(bins[t], max(1, score))
        rows += [(f, *e) for e in evs]
        want += [(f, i, v) for i, v in enumerate(bins)]
    df = spark.createDataFrame(rows, "file_id int, start_time double, end_time double, severity_score int")
    got = severity_heatmap(df, bins_per_chunk=7).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_counting_and_previous(spark):
    rows = [(f, t) for f in range(3) for t in range(0, 500, 7)]
    df = spark.createDataFrame(rows, "file_id int, t long")
    got = numbered(df, ["file_id"], index_chunk("t", 20), ["t"], "n")
    assert all(r.n == r.t // 7 for r in got.collect())
    prev = with_previous(got, ["file_id"], "n", {"p": "t"}, chunk_rows=5).collect()
    assert len(prev) == len(rows)
    assert all(r.p == (r.t - 7 if r.n else None) for r in prev)


def test_running_last_skips_nulls(spark):
    rows = [(1, i, i if i % 5 == 0 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i long, v long").withColumn("c", index_chunk("i", 4))
    got = {r.i: r.last for r in running(df, ["k"], "c", ["i"], {"last": ("last", "v")}).collect()}
    assert got == {i: (None if i == 0 else (i - 1) // 5 * 5) for i in range(40)}
