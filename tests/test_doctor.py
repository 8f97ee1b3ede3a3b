"""Planted defects and delays are found, each once."""

import random

from armada.operators import changelog as L
from armada.operators import checks as C
from armada.operators import doctor as D
from armada.operators import trajectory as T


def test_each_defect_is_named_once(spark):
    sound = [(e, f, f / 30, e % 2) for e in range(9) for f in range(10)]
    frames = [r for r in sound if not (r[0] == 2 and r[1] == 4)]  # 2: a gap, and so another length
    frames += [(3, 9, 0.31, 1)]  # 3: a repeat, later than its like
    frames = [(e, f, 0.1 if (e, f) == (4, 8) else t, 5 if (e, f) == (5, 1) else k) for e, f, t, k in frames]  # 4: time; 5: task
    frames = [(e, f + 1 if e == 6 else f, t, k) for e, f, t, k in frames]  # 6: start
    frames += [(7, None, None, None), (None, 0, 0.0, 0)]  # 7: one without a number or task
    said = [(e, 11 if e in (3, 7) else 10) for e in range(9) if e != 8] + [(20, 4), (1, 9), (None, 3)]  # 8: no metadata; 20: no frames
    run = lambda **k: sorted((r["episode"], r["check"], r["severity"], r["n"]) for r in D.diagnose(spark.createDataFrame(frames, "episode long, frame long, timestamp double, task_index long"), spark.createDataFrame(said, "episode long, length long"), spark.createDataFrame([(0,), (1,), (1,), (None,)], "task_index long"), **k).collect())
    want = [(2, "gaps", "fail", 1), (2, "length", "fail", 1), (3, "repeats", "fail", 1), (4, "time", "warn", 1), (5, "tasks", "fail", 1), (6, "start", "warn", 1), (7, "tasks", "fail", 1), (8, "metadata", "fail", 10), (20, "metadata", "fail", 4)]
    assert run() == want
    assert run(first=3) == want[:2] and run(between=(3, 5)) == want[2:5] and run(first=50) == want
    findings = spark.createDataFrame([(e, c, s, n) for e, c, s, n in want], "episode long, check string, severity string, n long")
    assert {r["check"]: (r["severity"], r["episodes"]) for r in D.summary(findings).collect()} == {"metadata": ("fail", 2), "length": ("fail", 1), "start": ("warn", 1), "gaps": ("fail", 1), "repeats": ("fail", 1), "time": ("warn", 1), "tasks": ("fail", 2)}
    assert {r["severity"] for r in D.summary(findings.limit(0)).collect()} == {"pass"}


def test_planted_delays(spark):
    rng = random.Random(3)
    rows = []
    for e, delay in enumerate((0, 3, -2, 8, 1)):
        a = {f: rng.gauss(0, 1) for f in range(-20, 80)}
        rows += [(e, f, a[f], a[f - delay] + rng.gauss(0, 0.05)) for f in range(60) if f % 13 != 5]
    rows += [(9, f, 1.0, 1.0) for f in range(30)] + [(10, f, float(f), float(f)) for f in range(5)] + [(11, f, None, 1.0) for f in range(30)]
    got = {r["episode"]: (r["delay"], r["causal"], r["r"] > 0.95) for r in T.control_delay(spark.createDataFrame(rows, "episode long, frame long, a double, b double")).collect()}
    # constant series, short ones and ones without values have no delay
    assert got == {0: (0, True, True), 1: (3, True, True), 2: (-2, False, True), 3: (8, True, True), 4: (1, True, True)}


def test_one_failure_does_not_lose_the_others(spark):
    cached = spark.createDataFrame([("a", "t1", 1), ("a", "t1", 2), ("b", "t1", 3), ("c", "t1", 4)], "dataset string, last_modified string, n long")
    current = spark.createDataFrame([("a", "t2"), ("b", "t2"), ("c", "t1"), ("d", "t2")], "dataset string, last_modified string")
    fetched = spark.createDataFrame([("b", "t2", 30)], "dataset string, last_modified string, n long")
    failed = spark.createDataFrame([("a", "down"), ("d", "gone"), ("c", "not asked")], "dataset string, error string")
    got = {tuple(r) for r in L.refresh(cached, current, fetched, failed).collect()}
    assert got == {("a", "t1", 1, "down"), ("a", "t1", 2, "down"), ("b", "t2", 30, None), ("c", "t1", 4, None), ("d", None, None, "gone")}
    assert L.refresh(cached, current, fetched).columns == cached.columns


def test_edit_filter_keeps_what_is_there(spark):
    rows = spark.createDataFrame([("own/pick-a", "u"), ("own/pick-b", "u"), ("own/place", "pick")], "dataset string, uploader string")
    there = spark.createDataFrame([("pick-a",), ("place",), ("place",)], "leaf string")
    names = lambda df: sorted(r["dataset"] for r in df.collect())
    assert names(C.edit_filter(rows, ["dataset", "uploader"], "PICK")) == ["own/pick-a", "own/pick-b", "own/place"]
    assert names(C.edit_filter(rows, ["dataset", "uploader"], "PICK", there)) == ["own/pick-a", "own/place"]


def test_length_statistics(spark):
    stats = lambda xs: tuple(T.length_stats(spark.createDataFrame([(x,) for x in xs], "length_seconds double")).first())
    assert stats([1.0, 2.0, 4.0, None, 9.0]) == (1.0, 9.0, 4.0, 3.0, 3.082207) and stats([5.0]) == (5.0, 5.0, 5.0, 5.0, 0.0) and stats([]) == (None,) * 5
