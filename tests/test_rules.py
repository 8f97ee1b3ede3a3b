"""Small cases of rules whose queries run on the driver tables: isolation, coverage, order, bounds."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from armada.operators import changelog as L
from armada.operators import checks as C
from armada.operators import fleet as A
from armada.operators import trajectory as T


def test_a_failing_check_is_skipped_alone(spark):
    rows = spark.createDataFrame([(1, "own/pick-0001", 30.0)], "id long, name string, avg_seconds double")  # no prompts
    got = {r["id_"]: (r["status"], r["message"]) for r in C.run_checks(rows.withColumnRenamed("id", "key"), "key").withColumnRenamed("id", "id_").collect()}
    assert got["name"][0] == got["duration"][0] == "ok" and got["prompt"][0] == "skip" and "prompt" in got["prompt"][1]
    got = {r["id"]: r["status"] for r in C.run_checks(rows.withColumnRenamed("id", "key").withColumn("prompt", F.lit("x")), "key", cfg={"min_seconds": object()}).collect()}
    assert got["duration"] == "skip" and got["name"] == "ok"


def test_days_after_bare_reports_are_left_out(spark):
    rows = [(d, "a", "g", n, Decimal(n)) for d, n in (("d1", 5), ("d3", 9), ("d4", 12), ("d6", 20))]
    details = spark.createDataFrame(rows, "date string, dataset string, group string, episodes long, hours decimal(18,2)")
    grown = lambda *bare: [(r["date"], r["episodes"]) for r in A.daily_group_growth(details, spark.createDataFrame([(b,) for b in bare], "date string")).collect()]
    assert grown() == [("d1", 5), ("d3", 4), ("d4", 3), ("d6", 8)]
    assert grown("d2", "d4") == [("d1", 5), ("d4", 3), ("d6", 8)]  # d4 has details too; d3 can't be attributed
    assert grown("d0", "d5") == [("d3", 4), ("d4", 3)]
    assert [(r["date"], r["episodes"]) for r in A.daily_group_growth(details).collect()] == grown()


def test_series_come_in_order(spark):
    rows = spark.createDataFrame([("d2", "x", Decimal(1), 1), ("d1", "x", Decimal(1), 1), ("d1", None, Decimal(5), 1), ("d1", "b", Decimal(1), 0)], "date string, group string, hours decimal(18,2), episodes long")
    assert [(r["date"], r["group"]) for r in A.group_growth(rows).collect()] == [("d1", "—"), ("d1", "b"), ("d1", "x"), ("d2", "x")]
    events = spark.createDataFrame([(2, 1, "left"), (1, 9, "right"), (1, 9, "left"), (1, 2, "right")], "episode long, frame long, hand string")
    assert [tuple(r) for r in T.first_events(events, 3).collect()] == [(1, 2, "right"), (1, 9, "left"), (1, 9, "right")]


def test_what_an_old_history_adds(spark):
    schema = "org string, date string, pulled_at string, seq long, detailed boolean"
    legacy = spark.createDataFrame([("o", "d1", "t5", 1, True), ("o", "d2", "t5", 2, True), ("o", "d3", "t5", 3, False), ("o", "d4", "t5", 4, True), (None, "d1", "t1", 5, False), ("o", "d2", "t9", 6, False)], schema)
    log = spark.createDataFrame([("o", "d1", "t5", 1, True), ("o", "d2", "t5", 2, True), ("o", "d3", "t9", 3, False), ("o", "d4", "t9", 4, False), ("o", "d1", "t1", 5, False)], schema)
    days = lambda a, b: sorted((r["org"] or "", r["date"]) for r in L.uncovered(a, b).collect())
    assert days(legacy, log) == [("", "d1"), ("o", "d4")] and days(legacy.limit(0), log) == [] and len(days(legacy, log.limit(0))) == 5


def test_commits_name_their_fields_differently(spark):
    rows = spark.createDataFrame([("r", None, "2026-01-02", None, "c1"), ("r", "", None, "c2", "x")], "repo string, createdAt string, date string, commitId string, id string")
    assert [tuple(r) for r in L.commit_rows(rows).orderBy("commit_id").collect()] == [("r", "2026-01-02", "c1"), ("r", "", "c2")]
    assert [tuple(r) for r in L.commit_rows(spark.createDataFrame([("r",)], "repo string")).collect()] == [("r", "", "")]
    meta = spark.createDataFrame([("a", "u", "arm", 3, "t", 9)], "dataset_name string, uploader string, robot_type string, total_tasks long, last_modified string, fps long")
    assert L.change_metadata(meta).columns == ["dataset", "uploader", "robot_type", "total_tasks", "last_modified"]


@pytest.mark.parametrize(("new", "total", "dual"), [((1, 2), (3, 8), True), ((1, 3), (3, 8), False), ((0, 0), (5, 9), False), ((1, 2), (0, 0), False)])
def test_axes_of_a_trend(spark, new, total, dual):
    rows = spark.createDataFrame([(f"d{i}", n, t) for i, (n, t) in enumerate(zip(new, total, strict=True))] + [("", 0, 0)], "date string, new_hours long, total_hours long")
    assert tuple(A.trend_axis(rows).first()) == ("d0", "d1", dual) and tuple(A.trend_axis(rows, "d9", "").first())[:2] == ("d9", "d1")
    assert tuple(A.trend_axis(rows.limit(0), "a").first()) == ("a", None, False) and tuple(A.date_bounds(rows, rows.limit(0)).first()) == ("d0", "d1")


def test_styles_in_their_order(spark):
    atoms = spark.createDataFrame([(1, "vqa"), (1, None), (2, "zz"), (2, "task_aug"), (3, "vqa"), (3, "aa")], "episode long, style string")
    assert [(r["style"], r["label"], r["event"], r["atoms"]) for r in C.style_groups(atoms).collect()] == [("task_aug", "任务改写", False, 1), ("vqa", "视觉问答", True, 2), (None, "语音", True, 1), ("aa", "aa", False, 1), ("zz", "zz", False, 1)]


def test_smooth_and_jerky_episodes(spark):
    rows = [(1, f, [float(f)]) for f in range(9)] + [(2, f, [float(f % 4 // 2 * 5 + f % 2)]) for f in range(9)] + [(3, f, [0.0]) for f in range(5)] + [(4, 0, [0.0]), (4, 1, [1.0])]
    got = {r["episode"]: (r["verdict"], r["low"]) for r in T.smoothness(spark.createDataFrame(rows, "episode long, frame long, vec array<double>")).collect()}
    assert got == {1: ("smooth", False), 2: ("jerky", False), 3: ("smooth", True)}
