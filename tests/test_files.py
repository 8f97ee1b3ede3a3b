"""Report sets and rewritten tables, by the files they leave."""

import csv
import io
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from armada.functions import exprs as X
from armada.sources import files as W
from armada.sources import reports as R
from armada.sources.datasets import latest_reports, write_review_status

ISSUES = "dataset string, position long, episode long, rule string, severity string, field string, start_sec double, end_sec double, frame long, message string, source string, clips map<string,string>, plot string"
ROWS = [
    ("own/a", 1, 7, "jump", "fail", "arm", 1.5, 2.25, 45, 'far, "very" far', "data/x.parquet", {"left": "ep_000007/c1.mp4"}, None),
    ("own/a", 2, None, "log", "warn", None, None, None, None, "no <b> episode", None, None, None),
    ("own/a", 3, 2, "idle", "warn", "arm", None, None, 9, "line one\nline two", None, {}, "ep_000002/p.svg"),
    ("own/a", 4, 7, "jump", "warn", "leg é", 0.0, 1.0, 0, "near", None, None, None),
    ("own/a", 5, 7, "jump", "skip", "leg", 0.0, 1.0, 0, "not counted", None, None, None),
    ("own/b", 1, 1, "jump", "skip", None, None, None, None, "nothing to do", None, None, None),
]


def test_a_report_set(spark, tmp_path):
    issues, root = spark.createDataFrame(ROWS, ISSUES), tmp_path / "reports"
    R.write_reports(issues, str(root), "20260101_000000")
    found = {str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not p.name.startswith(".")}
    top = {"index.md", "issues.json", "overview.json", "issues.csv", "summary.html", "review_status.json"}
    assert found == {f"{leaf}/20260101_000000/{name}" for leaf in ("a", "b") for name in top} | {f"a/20260101_000000/{ep}/{name}" for ep in ("ep_000002", "ep_000007", "ep_unknown") for name in ("report.md", "issues.json")}
    own = root / "a/20260101_000000"
    ids = ["0001_000002_idle_arm_frame", "0002_000007_jump_arm_1.500", "0003_000007_jump_leg_0.000", "0004_unknown_log_all_frame"]
    assert [r["issue_id"] for r in json.loads((own / "issues.json").read_text())] == ids
    assert (own / "index.md").read_text() == "# Quality report: own/a\n\n- generated_at: 20260101_000000\n- total_issues: 4\n\n- [ep_000002](ep_000002/report.md): 1 issues\n- [ep_000007](ep_000007/report.md): 2 issues\n- [ep_unknown](ep_unknown/report.md): 1 issues\n"
    assert "No actionable issues found." in (root / "b/20260101_000000/index.md").read_text()
    text = (own / "ep_000007/report.md").read_text()
    assert text.startswith("# own/a / ep_000007\n\n## 1. jump\n\n- issue_id: 0002_000007_jump_arm_1.500\n- severity: fail\n- field: arm\n- time: 1.500s-2.250s\n- detail: far, \"very\" far\n- clip: c1.mp4\n- source: data/x.parquet\n\n## 2. jump\n")
    assert "- frame: 9\n" in (own / "ep_000002/report.md").read_text() and "- dof_plot: p.svg\n" in (own / "ep_000002/report.md").read_text()
    raw = (own / "issues.csv").read_bytes().decode("utf-8")
    rows = list(csv.DictReader(io.StringIO(raw.removeprefix("﻿"), newline="")))
    assert raw.startswith("﻿") and len(rows[0]) == 13 and [r["issue_id"] for r in rows] == ids
    assert [r["message"] for r in rows] == ["line one\nline two", 'far, "very" far', "near", "no <b> episode"] and json.loads(rows[1]["clips"]) == {"left": "ep_000007/c1.mp4"}
    assert json.loads((own / "overview.json").read_text()) == {"total_issues": 4, "episode_count": 3, "by_rule": {"idle": 1, "jump": 2, "log": 1}, "by_field": {"arm": 2, "leg é": 1, "unknown": 1}, "by_episode": {"2": 1, "7": 2, "unknown": 1}, "unconfirmed": 4}
    assert "no &lt;b&gt; episode" in (own / "summary.html").read_text()
    assert {r["dataset"]: r["path"].rsplit("/", 2)[1] for r in latest_reports(spark, str(root)).collect()} == {"own/a": "a", "own/b": "b"}
    # read back, with reviews that came since: one under its id, one under its place
    reviews = json.loads((own / "review_status.json").read_text())
    assert {v["status"] for v in reviews.values()} == {"未确认"} and set(reviews) == set(ids)
    (own / "review_status.json").write_text(json.dumps({ids[1]: {"status": "confirmed", "note": "seen"}, "3": {"status": "dismissed", "note": ""}}))
    got = {r["issue_id"]: (r["position"], r["review_status"], r["review_note"]) for r in R.report_records(spark, str(root)).collect()}
    assert got == {ids[0]: (1, "未确认", ""), ids[1]: (2, "confirmed", "seen"), ids[2]: (3, "dismissed", ""), ids[3]: (4, "未确认", "")}
    # a second report of the same stamp replaces the first one's files
    R.write_reports(issues.where("position = 1"), str(root), "20260101_000000")
    assert len(json.loads((own / "issues.json").read_text())) == 1
    assert R.report_records(spark, str(tmp_path / "none")).count() == 0
    R.write_reports(issues.limit(0), str(tmp_path / "empty"), "s")


def test_a_status_is_made_good(spark):
    stored = spark.createDataFrame([("a", R.CHECKED, "/r/a", "t1"), ("b", R.CHECKED, "/r/gone", "t2"), ("c", "open", "/r/c", "t3"), ("d", R.CHECKED, "/r/x", "t4"), ("d", R.CHECKED, "/r/old", "t0"), ("e", None, None, None)], "dataset string, status string, report_dir string, checked_at string")
    reports = spark.createDataFrame([("a", "/r/a2"), ("c", "/r/c"), ("new", "/r/new"), ("new", "/r/new2"), ("other", "/r/x")], "dataset string, path string")
    got = {tuple(r) for r in R.reconciled_status(stored, reports).collect()}
    # d's report is there, though under another name; b's is gone
    assert got == {("a", R.CHECKED, "/r/a2", "t1"), ("c", R.CHECKED, "/r/c", "t3"), ("new", R.CHECKED, "/r/new2", None), ("other", R.CHECKED, "/r/x", None), ("d", R.CHECKED, "/r/x", "t4")}
    assert R.reconciled_status(stored, reports.limit(0)).count() == 0


def put(path, **columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path)


def test_prompts_are_rewritten_file_by_file(spark, tmp_path):
    source, target = tmp_path / "set", tmp_path / "copy"
    put(source / "meta/tasks.parquet", task_index=pa.array([0, 1, 2], pa.int32()), task=["pick", "place", None], weight=pa.array([0.5, 1.5, 2.5], pa.float32()))
    for chunk in range(2):
        for i in range(3):
            put(source / f"meta/episodes/chunk {chunk:03d}+/file-{i:03d}.parquet", episode_index=pa.array([9 - i, 3, 5], pa.int64()), tasks=pa.array([["pick", "place"], None, ["other", None]], pa.list_(pa.string())), length=pa.array([1, None, 3], pa.int16()), stats=pa.array([{"mean": [1.0]}] * 3, pa.struct([("mean", pa.list_(pa.float64()))])))
    assert W.set_prompts(spark, str(source), str(target), {"pick": "take", "place": "", "same": "same"}) == 1
    names = lambda root: sorted(str(p.relative_to(root)) for p in root.rglob("*.parquet"))
    assert names(source) == names(target) and len(names(target)) == 7
    for name in names(source):
        old, new = pq.read_table(source / name), pq.read_table(target / name)
        assert old.schema.remove_metadata() == new.schema.remove_metadata()
        want = old.to_pylist()
        for r in want:
            if "tasks" in r:
                r["tasks"] = ["take" if t == "pick" else t for t in r["tasks"] or []]
            elif r["task"] == "pick":
                r["task"] = "take"
        assert new.to_pylist() == want
    assert not list(target.rglob("_staged*"))
    # in place, and nothing to do
    assert W.set_prompts(spark, str(target), str(target), {"take": "grasp"}) == 1
    assert pq.read_table(target / "meta/tasks.parquet")["task"].to_pylist() == ["grasp", "place", None]
    assert W.set_prompts(spark, str(target), str(target), {"a": "a"}) == 0
    with pytest.raises(FileNotFoundError):
        W.set_prompts(spark, str(tmp_path / "none"), str(target), {"a": "b"})


def test_issue_ids(spark):
    ids = lambda *x: spark.range(1).select(X.issue_id(*[F.lit(v).cast(t) for v, t in zip(x, ("int", "long", "string", "string", "double"), strict=True)])).first()[0]
    assert ids(12345, 7, "a b", "x/y", 0.5) == "12345_000007_a_b_x_y_0.500" and ids(3, None, "r", None, None) == "0003_unknown_r_all_frame"
