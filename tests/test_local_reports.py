"""What is on disk: summaries of folders, the newest report by priority, logs, boundary windows, manual snapshots."""

import datetime as dt
import json
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from armada.operators import checks as C
from armada.operators import trajectory as T
from armada.sources import datasets as S
from armada.sources import local_reports as LR
from armada.streaming import snapshot_log as SL


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))


def test_folders_are_summed_up(spark, tmp_path):
    put(tmp_path / "a/meta/info.json", {"total_episodes": 3, "total_frames": 108000, "fps": 0, "robot_type": "arm", "total_tasks": 2})
    pq.write_table(pa.table({"task": ["pick", None, "place"], "task_index": [4, 5, 1]}), tmp_path / "a/meta/tasks.parquet")
    put(tmp_path / "b/meta/info.json", {"total_episodes": 1})
    put(tmp_path / "c/meta/info.json", "{ broken")
    put(tmp_path / "d/other.json", {})
    rows = {r["dataset_name"]: r for r in LR.summaries(spark, str(tmp_path), "own").collect()}
    assert set(rows) == {"own/a", "own/b", "own/c"}
    assert (rows["own/a"]["duration_hours"], [tuple(t) for t in rows["own/a"]["tasks"]]) == (1.0, [(1, "place"), (4, "pick")])
    assert (rows["own/b"]["total_episodes"], rows["own/b"]["total_frames"], rows["own/b"]["duration_hours"], rows["own/b"]["tasks"]) == (1, None, None, None)
    assert rows["own/c"]["total_episodes"] is None
    r = LR.report_of(LR.summaries(spark, str(tmp_path), "own"), "2026-03-01T08:00:00", "own", "folders").first()
    assert (r["total_datasets"], r["total_episodes"], r["total_frames"], r["total_hours"], r["date"]) == (3, 4, 108000, 1.0, "260301")
    assert LR.summaries(spark, str(tmp_path / "none"), "own").count() == 0


def test_three_sources_by_priority(spark, tmp_path):
    out, log = tmp_path / "out", tmp_path / "log.json"
    ask = lambda: [(r["origin"], r["pulled_at"] and r["pulled_at"][:10], r["total_episodes"], [x["dataset_name"] for x in r["datasets"]]) for r in LR.local_report(spark, str(out), "own", str(log)).collect()]
    assert ask() == []
    put(out / "a/meta/info.json", {"total_episodes": 3, "total_frames": 10})
    assert [(x[0], x[2], x[3]) for x in ask()] == [("folders", 3, ["own/a"])]
    change = lambda at, n: {"date": at[2:4] + at[5:7] + at[8:10], "pulled_at": at, "total_episodes": n, "total_frames": n, "duration_hours": n / 10}
    put(log, {"dataset_index": ["own/a", "own/b", "p/c"], "daily_totals": [{"pulled_at": "2026-01-01", "date": "260101", "org": "own", "total_episodes": 4, "present": [0, 1]}, {"pulled_at": "2026-01-03", "date": "260103", "org": "own", "total_episodes": 6, "present": [0]}, {"pulled_at": "2026-01-09", "date": "260109", "org": "p", "present": [2]}], "datasets": {"own/a": {"fps": 30, "changes": [change("2026-01-01", 4), change("2026-01-02", 6), change("2026-01-04", 8)]}, "own/b": {"changes": [change("2026-01-01", 1)]}, "p/c": {"changes": [change("2026-01-09", 1)]}}})
    assert ask() == [("log", "2026-01-03", 6, ["own/a"])]
    assert LR.logged_report(spark, str(log), "own").first()["datasets"][0]["total_episodes"] == 6
    put(out / "x/pull_result_260105_1.json", {"pulled_at": "2026-01-05", "org": "own", "total_episodes": 7, "datasets": [{"dataset_name": "own/z"}]})
    assert ask() == [("file", "2026-01-05", 7, ["own/z"])]
    put(out / "pull_result_260101_1.json", {"pulled_at": "2026-01-01", "org": "own", "total_episodes": 5, "datasets": [{"dataset_name": "own/y"}]})
    assert ask() == [("file", "2026-01-01", 5, ["own/y"])]  # files in the folder itself come first
    put(out / "pull_result_260102_1.json", {"pulled_at": "2026-01-02", "org": "own", "datasets": []})
    assert ask()[0][0] == "log"  # the newest one lists nothing


def test_report_files_and_caches_round_trip(spark, tmp_path):
    put(tmp_path / "a/meta/info.json", {"total_episodes": 3, "total_frames": 10, "fps": 10})
    report = LR.report_of(LR.summaries(spark, str(tmp_path), "own"), "2026-03-01T08:00:00", "own", "folders")
    path = tmp_path / "pulls/pull_result_260301_080000.json"
    path.parent.mkdir()
    LR.write_report_file(spark, report, spark.createDataFrame([("own/x", "down")], "dataset_name string, error string"), 2, str(path))
    doc = json.loads(path.read_text())
    assert (doc["requested"], doc["count"], doc["failures"], doc["total_episodes"]) == (2, 1, [{"dataset_name": "own/x", "error": "down"}], 3)
    assert LR.newest_snapshot(spark, str(path.parent)).first()["datasets"][0]["dataset_name"] == "own/a"
    LR.write_report_file(spark, report, spark.createDataFrame([], "dataset_name string, error string"), 1, str(path))
    assert "failures" not in json.loads(path.read_text())
    rows = spark.createDataFrame([("own/a", "t1", "c2", "260301", "c1", "2026-03-01", 1.5, 2, 30), ("own/a", "t1", "c2", "260302", "c2", "2026-03-02", 0.5, 1, None), ("own/b", "t9", None, "260301", "k", None, None, 1, 1)], "dataset string, last_modified string, head_commit string, date string, commit_id string, created_at string, hours double, episodes long, frames long")
    LR.write_change_cache(spark, rows, str(tmp_path / "cache.json"))
    assert sorted(map(repr, S.change_cache(spark, str(tmp_path / "cache.json")).select(rows.columns).collect())) == sorted(map(repr, rows.collect()))


def test_log_issues(spark, tmp_path):
    put(tmp_path / "logs/b/run.log", "fine\nepisode 3 frame=60 bad JPEG of left_wrist\nEP_3 bad jpg left_wrist frame 90\nBad JPEG timestamp: 0.25 right_tactile_left ep 4\n")
    put(tmp_path / "logs/a/run.log", "x\ny\nepisode 3 jpeg left_wrist\n")
    put(tmp_path / "logs/.cache/run.log", "episode 9 jpeg\n")
    put(tmp_path / "logs/log1.txt", "jpeg somewhere\n")
    put(tmp_path / "logs/other.txt", "jpeg episode 8\n")
    rows = sorted(((r["episode"], r["frame"], r["field"], r["start_sec"], r["end_sec"], r["message"].split(": ", 1)[1]) for r in C.log_issues(S.log_lines(spark, str(tmp_path / "logs")), 30.0).collect()), key=repr)
    # of episode 3's lines in two files of one name the one in folder a counts
    assert rows == [(3, None, "left_wrist", None, None, "run.log:3 episode 3 jpeg left_wrist"), (4, None, "right_tactile_left", 0.0, 1.25, "run.log:4 Bad JPEG timestamp: 0.25 right_tactile_left ep 4"), (None, None, None, None, None, "log1.txt:1 jpeg somewhere")]


def test_boundary_windows_and_hands(spark):
    rows = [("d", e, f, [9.0 if e == 3 and f < 4 else 1.0 if e == 2 and f > 55 else 0.0]) for e in range(6) for f in range(60)]
    out = [tuple(r) for r in T.boundary_issues(spark.createDataFrame(rows, "dataset string, episode long, frame long, vec array<double>"), fps=30.0, longest=1.0, window=4, k=3.0, floor=0.1).orderBy("episode").collect()]
    assert out == [("d", 2, "boundary_end", 1.0, 59, 0.967, 1.967), ("d", 3, "boundary_start", 9.0, 0, 0.0, 0.133)]
    names = ["grip", "right_tcp.z", "right_tcp.x", "right_tcp.y"]
    vecs = spark.createDataFrame([(1, 0, [9.0, 3.0, 1.0, 2.0])], "episode long, frame long, state array<float>")
    assert [tuple(r) for r in T.hand_frames(vecs, "state", names, ["right"]).collect()] == [(1, 0, "right", 1.0, 2.0, 3.0)]
    with pytest.raises(ValueError, match="left_tcp.x"):
        T.hand_frames(vecs, "state", names, ["left"])


def test_manual_snapshots_are_checked_and_stand(spark, tmp_path):
    today = dt.date(2026, 2, 1)
    make = lambda *x: SL.manual_snapshot(spark, *x, today=today)
    for wrong in (("2026-01-01", "o", 1, 1, 1, 1.0), ("260301", "o", 1, 1, 1, 1.0), ("260101", " ", 1, 1, 1, 1.0), ("260101", "o", True, 1, 1, 1.0), ("260101", "o", 1, -1, 1, 1.0), ("260101", "o", 1, 1, 1.5, 1.0), ("260101", "o", 1, 1, 1, -0.5), ("260101", "o", 1, 1, 1, float("nan"))):
        with pytest.raises(ValueError):
            make(*wrong)
    log = str(tmp_path / "log")
    SL.merge(make("260101", " o ", 2, 9, 90, 1.23456), log)
    r = SL.table(spark, log, "totals").first()
    assert (r["org"], r["pulled_at"], r["total_hours"], r["source"], r["total_episodes"]) == ("o", "2026-01-01T23:59:59", 1.235, "manual", 9)
    SL.merge(make("260101", "o", 2, 8, 90, 1.0), log)  # entered again
    assert [r["total_episodes"] for r in SL.table(spark, log, "totals").collect()] == [8]


def test_totals_of_a_manual_day(spark):
    schema = "org string, date string, pulled_at string, ord long, source string, datasets long, episodes long, hours decimal(18,2)"
    snaps = spark.createDataFrame([("o", "260101", "t1", 1, None, 5, 10, Decimal(2)), ("o", "260103", "t3", 2, "manual", 4, 35, Decimal("4.5")), ("p", "260103", "t3", 3, "manual", 2, 3, Decimal(1)), ("o", "260102", "t2", 4, None, 6, 11, Decimal(3))], schema)
    grown = spark.createDataFrame([("o", "260102", Decimal(1), 1, 1), ("o", "260102", Decimal(2), 4, 2), ("q", "260102", Decimal(9), 9, 9)], "org string, date string, hours decimal(18,2), episodes long, datasets long")
    got = {(r["org"], r["date"]): (float(r["hours"]), r["episodes"], r["datasets"]) for r in SL.totals_of_day(snaps, snaps, grown).collect()}
    # fewer datasets than before count as none that came; without a baseline all are new
    assert got == {("o", "260103"): (1.5, 24, 0), ("p", "260103"): (1.0, 3, 2), ("o", "260102"): (3.0, 5, 3), ("o", "260101"): (0.0, 0, 0)}
