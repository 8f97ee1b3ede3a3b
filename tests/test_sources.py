import json
import os

from armada.sources import datasets as S
from armada.streaming.incremental import current_log, fold_snapshots


def test_readers(spark, tmp_path):
    root = str(tmp_path / "set")
    spark.createDataFrame([(0, 60), (1, None)], "episode_index long, length long").coalesce(1).write.parquet(f"{root}/meta/episodes/chunk-000/file-000.parquet")
    assert [r["length_seconds"] for r in S.episode_lengths(spark, root, 30.0).collect()] == [2.0]
    spark.createDataFrame([(0, "pick"), (1, None)], "task_index long, task string").write.parquet(f"{root}/meta/tasks.parquet")
    assert S.tasks(spark, root).count() == 1
    (tmp_path / "info.json").write_text(json.dumps({"fps": 30, "features": {"cam": {"dtype": "video", "shape": [1]}, "state": {"dtype": "float32", "shape": [6]}}}))
    assert [r["name"] for r in S.camera_features(S.info(spark, str(tmp_path / "info.json"))).collect()] == ["cam"]
    (tmp_path / "notes.json").write_text(json.dumps({"version": "1", "episodes": {"3": {"atoms": [{"role": "user", "content": "x"}]}}}, indent=1))
    assert [(r["episode"], r["role"]) for r in S.annotations(spark, str(tmp_path / "notes.json")).collect()] == [("3", "user")]
    (tmp_path / "bad.json").write_text("{")
    assert S.annotations(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("ok\nbad JPEG at 3\n")
    assert S.log_lines(spark, str(tmp_path / "logs")).count() == 1


def test_snapshots_fold_as_they_arrive(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, (at, n) in enumerate((("t1", 5), ("t3", 15), ("t2", 10))):
        (folder / f"pull_result_{i}.json").write_text(json.dumps({"org": "o", "date": "260101", "pulled_at": at, "total_episodes": n}))
        fold_snapshots(spark, str(folder), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert [r["total_episodes"] for r in current_log(spark, str(tmp_path / "log")).collect()] == [15]


def test_change_log_round_trip(spark, tmp_path):
    change = {"date": "260301", "pulled_at": "2026-03-01T08:00:00", "total_episodes": 4, "total_frames": 900, "duration_hours": 0.5, "d_episodes": 4, "d_frames": 900, "d_hours": 0.5}
    log = {"dataset_index": ["own/b", "own/a"], "daily_totals": [{"pulled_at": "2026-03-01T08:00:00", "date": "260301", "org": "own", "total_datasets": 2, "total_episodes": 4, "present": [1, 0]}], "datasets": {"own/a": {"fps": 30, "uploader": "u1", "changes": [change]}, "own/b": {}}}
    (tmp_path / "log.json").write_text(json.dumps(log, indent=1))
    read = lambda path: {k: sorted(map(repr, df.collect())) for k, df in S.change_log(spark, path).items()}
    first = read(str(tmp_path / "log.json"))
    assert {k: len(v) for k, v in first.items()} == {"index": 2, "daily": 1, "datasets": 2, "changes": 1}
    S.write_change_log(S.change_log(spark, str(tmp_path / "log.json")), str(tmp_path / "again.json"))
    assert read(str(tmp_path / "again.json")) == first
    for path in ("bad.json", "none.json", "no/folder.json"):
        (tmp_path / "bad.json").write_text("[1")
        assert all(not v for v in read(str(tmp_path / path)).values())


def test_cache_history_and_events(spark, tmp_path):
    (tmp_path / "cache.json").write_text(json.dumps({"version": 1, "repos": {"own/a": {"last_modified": "t", "head_commit": "c1", "changes": [{"date": "260301", "hours": 1.5, "episodes": 2}]}}}))
    assert [(r["dataset"], r["hours"], r["frames"]) for r in S.change_cache(spark, str(tmp_path / "cache.json")).collect()] == [("own/a", 1.5, None)]
    assert S.change_cache(spark, str(tmp_path / "none.json")).count() == 0
    rows = [{"pulled_at": f"2026-03-0{i}", "date": f"26030{i}", "total_episodes": i} for i in (1, 2)]
    for name, content in (("list.json", rows), ("held.json", {"pull_history": rows}), ("other.json", {"x": 1})):
        (tmp_path / name).write_text(json.dumps(content))
    got = lambda name: sorted((r["ord"], r["total_episodes"]) for r in S.legacy_history(spark, str(tmp_path / name)).collect())
    assert got("list.json") == got("held.json") == [(0, 1), (1, 2)] and got("other.json") == got("none.json") == []
    events = tmp_path / "events"
    events.mkdir()
    for name, lines in (("a", ['{"type": "progress"}', "", '{"type": "result", "result": {"ok": 1}}']), ("b", ['{"type": "error", "error": "broken"}', '{"type": "result", "result": 2}']), ("c", ['{"type": "progress"}'])):
        (events / f"{name}.ndjson").write_text("\n".join(lines))
    out = {r["file"][-8]: (r["result"], r["error"]) for r in S.doctor_stream(spark, str(events)).collect()}
    assert out == {"a": ('{"ok":1}', None), "b": (None, "broken"), "c": (None, "the stream ended without a result")}


def test_videos_of_issues(spark, tmp_path):
    root = tmp_path / "set"
    files = ("videos/observation.images.right_wrist/chunk-001/file-002.mp4", "videos/left_wrist/take_4.mp4", "videos/left_wrist/take_5.mp4", "videos/other/take_4.mp4")
    for name in files:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    assert {(r["field"], r["path"]) for r in S.stream_videos(spark, str(root)).collect()} == {("right_wrist", files[0]), ("left_wrist", files[1]), ("left_wrist", files[2])}
    by_name = {(r["episode"], r["field"]): (r["path"], r["offset"]) for r in S.episode_videos(spark, str(root)).collect()}
    assert by_name == {(2, "right_wrist"): (files[0], 0.0), (4, "left_wrist"): (files[1], 0.0), (5, "left_wrist"): (files[2], 0.0)}
    asked = spark.createDataFrame([(4, "left_wrist"), (2, "arm"), (9, "arm"), (None, "arm")], "episode long, field string")
    found = {(r["episode"], r["field"]): r["video"] and r["video"]["path"] for r in S.choose_videos(asked, S.episode_videos(spark, str(root))).collect()}
    assert found == {(4, "left_wrist"): files[1], (2, "arm"): files[0], (9, "arm"): None, (None, "arm"): None}
    columns = ", ".join(["episode_index long"] + [f"`videos/observation.images.right_wrist/{c}` {t}" for c, t in (("chunk_index", "long"), ("file_index", "long"), ("from_timestamp", "double"))])
    spark.createDataFrame([(7, 1, 2, 3.5), (8, 1, 3, 0.0), (9, None, 2, 0.0), (None, 1, 2, 0.0)], columns).coalesce(1).write.parquet(str(root / "meta/episodes/chunk-000"))
    assert [tuple(r) for r in S.episode_videos(spark, str(root)).collect()] == [(7, "right_wrist", files[0], 3.5)]


def test_reviews_and_reports(spark, tmp_path):
    schema = "issue_id string, episode long, rule string, field string, start_sec double, end_sec double, review_status string, review_note string"
    issues = spark.createDataFrame([("a", 1, "jump", "arm", 0.5, None, "confirmed", "seen"), ("b", None, None, None, None, None, None, None)], schema)
    S.write_review_status(spark, issues, str(tmp_path / "reviews.json"), "open")
    assert sorted(map(tuple, S.review_status(spark, str(tmp_path / "reviews.json")).collect())) == [("a", "confirmed", "seen"), ("b", "open", "")]
    assert json.loads((tmp_path / "reviews.json").read_text())["a"]["end_sec"] is None
    S.write_review_status(spark, issues.limit(0), str(tmp_path / "empty.json"), "open")
    assert S.review_status(spark, str(tmp_path / "empty.json")).count() == S.review_status(spark, str(tmp_path / "none.json")).count() == 0
    assert S.latest_reports(spark, str(tmp_path / "reports")).count() == 0
    for at, (name, head) in enumerate((("x/1", "# Quality report: own/x"), ("x/2", "# Quality report: own/x\nmore"), ("y/1", "# Other"))):
        (tmp_path / "reports" / name).mkdir(parents=True)
        (tmp_path / "reports" / name / "index.md").write_text(head)
        os.utime(tmp_path / "reports" / name / "index.md", (1_000_000 - at, 1_000_000 - at))
    assert [(r["dataset"], r["path"][-4:]) for r in S.latest_reports(spark, str(tmp_path / "reports")).collect()] == [("own/x", "/x/1")]
