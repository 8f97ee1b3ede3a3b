"""The queries that cover whole tables, on small tables whose rows lie past the cuts of the others."""

import re
from datetime import datetime, timedelta

from armada.operators import edit as E
from armada.operators.order import numbered
from armada.plans import catalog
from armada.plans.catalog import QUERIES


def test_prompts_are_whole_texts(spark, tmp_path):
    long = "Pick the red cube " * 20
    rows = [(0, long + "and stop_ at once", "en", "src1"), (60, 'Say "yes" & \'no\' to <all>', "en", "src1"), (61, None, "en", "src1"), (62, long, "de", "src2")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["status"], r["message"]) for r in run("check_prompt")} == {0: ("fail", "too many words; illegal characters"), 60: ("warn", "too few words"), 61: ("skip", "no prompt"), 62: ("warn", "too many words")}
    assert {r["doc_id"]: r["status"] for r in run("run_checks") if r["id"] == "prompt"} == {0: "fail", 60: "warn", 61: "skip", 62: "warn"}
    assert {r["doc_id"]: (r["n_fail"], r["n_warn"]) for r in run("check_aggregate")} == {0: (1, 0), 60: (0, 1), 61: (0, 0), 62: (0, 1)}
    strings = {r["doc_id"]: (r["escaped"], r["safe"]) for r in run("scalar_strings")}
    assert strings[60] == ("Say &quot;yes&quot; &amp; &#x27;no&#x27; to &lt;all&gt;", "Say_yes_no_to_all") and strings[61] == (None, "unknown")
    assert strings[0][0] == long + "and stop_ at once" and strings[62][1] == "_".join(long.split())


def test_merge_offsets_after_a_lone_episode(spark):
    frames = lambda episodes: spark.createDataFrame([(e, f, 0) for e in episodes for f in (0, 1)], "episode long, frame long, task_index long")
    tasks = spark.createDataFrame([(0, "pick")], "task_index long, task string")
    merged, _ = E.merge([(frames([0]), tasks), (frames([]), tasks), (frames([0]), tasks), (frames([0, 1]), tasks)])
    assert sorted((r["episode"], r["frame"]) for r in merged.collect()) == [(e, f) for e in range(4) for f in (0, 1)]


def test_merge_covers_every_row(spark, tmp_path):
    keys = [0, 1, 95, 4000, 9000]
    spark.createDataFrame([(k, n, float(n), 7) for k in keys for n in (1, 2)], "l_orderkey long, l_linenumber int, l_quantity double, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = [(r["episode"], r["frame"], r["task_index"]) for r in QUERIES["merge_datasets"](spark, str(tmp_path)).collect()]
    # below 4500, then from there, after 4000; the second dataset's tasks are place (1) and pull (3)
    assert sorted(rows) == [(k, n, n) for k in keys[:4] for n in (1, 2)] + [(13001, 1, 3), (13001, 2, 1)]


def test_every_line_is_an_issue(spark, tmp_path):
    lines = [(k, n, float(q)) for k in range(400) for n, q in ((1, 2), (3, 3), (7, 9))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    start = datetime(2026, 1, 1)
    events = [(u * 100 + f, start + timedelta(seconds=f), u, float(f)) for u in (0, 7, 199) for f in range(64)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = [(r["issue"], r["episode"], r["frame"]) for r in QUERIES["range_join_window"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((f"i{k}", k % 200, f) for k, n, q in lines if k % 200 in (0, 7, 199) for f in range(64) if abs(f - n * q) <= 2)


def test_places_without_a_window_over_all(spark):
    rows = [(f"2026-01-{i * 7 % 28 + 1:02}" if i % 9 else None, f"d{i * 37 % 500:03}") for i in range(500)]
    table = spark.createDataFrame(rows, "day string, name string")
    ascending = sorted(rows, key=lambda r: (r[0] or "", r[1]))
    descending = sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: r[0] or "", reverse=True)
    for want, down in ((ascending, False), (descending, True)):
        got = numbered(table, "day", "name", descending=down).collect()
        assert sorted((r["place"], r["day"], r["name"]) for r in got) == [(i, *r) for i, r in enumerate(want)]
    assert numbered(table.limit(0), "day").count() == 0
    assert sorted(r["place"] for r in numbered(table.where("day is null"), "day", "name").collect()) == list(range(56))


def test_every_dataset_has_a_place(spark):
    small = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{small}/orders.parquet").select("o_custkey").distinct().count()
    assert n > 50 and sorted(r["place"] for r in QUERIES["table_order"](spark, small).collect()) == list(range(1, n + 1))


def test_episodes_are_numbered_by_ranges(spark):
    ids = [i * 13 % 700 for i in range(700)]
    frames = spark.createDataFrame([(e, 0) for e in ids], "episode long, frame long")
    gone = spark.createDataFrame([(e,) for e in ids if e % 3 == 0], "episode long")
    rest, parts = E.delete_episodes(frames, gone), E.split_fraction(frames, {"a": 0.25, "b": 0.75})
    for out in (rest, parts):
        specs = re.findall(r"row_number\(\) windowspecdefinition\(([^,]*)", out._jdf.queryExecution().analyzed().toString())
        assert specs and all(x.startswith("_range") for x in specs)
    assert sorted(r["episode"] for r in rest.collect()) == list(range(466))
    assert sorted((r["split"], r["episode"]) for r in parts.collect()) == [("a", i) for i in range(175)] + [("b", i) for i in range(525)]


def test_logs_are_fewer_than_users(spark, tmp_path, monkeypatch):
    """Logs grow in number with the lines, not with the users; every user's streams are found, also without a user or a time."""
    start = datetime(2026, 1, 1)
    events = [(i, start + timedelta(seconds=i * 37 % 101) if i % 11 else None, i % 40 if i % 41 else None, float(i * 29 % 97)) for i in range(900)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(catalog, "fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    got = {(r["episode"], r["field"]): (r["frame"], r["start_sec"], r["end_sec"]) for r in QUERIES["jpeg_log_issues"](spark, str(tmp_path)).collect()}
    want = {}
    for i, _, user, value in sorted(events, key=lambda e: (e[1] is None, e[1] or start, e[0])):
        if value > 40:
            at = i % 90 / (8.0 if i % 4 == 0 else 30.0)
            want.setdefault((user, ("left_wrist", "right_wrist", None)[i % 3]), (i % 90, max(0.0, at - 1), at + 1))
    assert got == want and len(want) > 100
    logs = list((tmp_path / "logs").rglob("*.log"))
    assert len(logs) <= 4 and sum(len(p.read_text().splitlines()) for p in logs) == 900
