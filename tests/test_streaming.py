"""Streams cut anywhere give what the whole table gives."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from armada.operators import trajectory as T
from armada.streaming import snapshot_log as SL
from armada.streaming.incremental import counts_by_window
from armada.streaming.tracker import advance, track

FRAMES = "episode long, frame long, hand string, x double, y double"
LIMITS = {"x": 1.0, "y": 2.0}


def run(stream, out, checkpoint):
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)


def test_jumps_of_a_stream_cut_anywhere(spark, tmp_path):
    rng = random.Random(5)
    rows = [(e, f, h, rng.gauss(0, 1), rng.gauss(0, 1)) for e in range(3) for h in ("left", "right") for f in range(40) if rng.random() < 0.9]
    want = sorted((r["episode"], r["hand"], r["frame"], r["hits"], round(r["xyz_step"], 9), r["xyz_hit"]) for r in T.tracker_jumps(spark.createDataFrame(rows, FRAMES), LIMITS, 2.0).collect())
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 4))
    out, folder = str(tmp_path / "out"), str(tmp_path / "in")
    for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True):  # every part is another run of the query on one checkpoint
        part = rows[i:j] + ([rows[0], (9, None, "left", 0.0, 0.0), (9, 1, "left", None, 0.0)] if i else [])
        spark.createDataFrame(part, FRAMES).write.mode("append").parquet(folder)
        run(track(spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 3).parquet(folder), LIMITS, 2.0), out, str(tmp_path / "ck"))
    got = sorted((r["episode"], r["hand"], r["frame"], r["hits"], round(r["xyz_step"], 9), r["xyz_hit"]) for r in spark.read.parquet(out).collect())
    assert got == want and len(want) > 50


def test_trackers_share_the_keys_of_the_state(spark, tmp_path):
    """Calls and state rows follow the keys, not the trackers, of which a fleet has many; names may be null or quoted."""
    rng = random.Random(6)
    names = [(e, h) for e in (*range(1500), None) for h in ("left", 'a "b"\\', None)]
    rows = [(e, f * 2**61 if e == 7 else f, h, rng.gauss(0, 1), rng.gauss(0, 1)) for e, h in names for f in range(-3, 4) if rng.random() < 0.8]
    want = sorted(map(repr, T.tracker_jumps(spark.createDataFrame(rows, FRAMES), LIMITS, 2.0).selectExpr("episode", "hand", "frame", "hits", "round(xyz_step, 9)", "xyz_hit").collect()))
    rng.shuffle(rows)
    out, folder = str(tmp_path / "out"), str(tmp_path / "in")
    spark.createDataFrame(rows, FRAMES).repartition(3).write.parquet(folder)
    jumps = track(spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(folder), LIMITS, 2.0)
    stream = jumps.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert 0 < stream.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024 < len(names)
    got = spark.read.schema(jumps.schema).parquet(out).selectExpr("episode", "hand", "frame", "hits", "round(xyz_step, 9)", "xyz_hit")
    assert sorted(map(repr, got.collect())) == want and len(want) > 5000


def test_trackers_are_forgotten(spark, tmp_path):
    """Events need both frames within the time of expiry; a tracker that is silent for longer starts anew."""
    t = datetime(2026, 1, 1)
    schema = FRAMES + ", at timestamp"
    batches = [[(1, 0, "left", 0.0, 0.0, t), (2, 0, "left", 0.0, 0.0, t)], [(1, 1, "left", 9.0, 0.0, t + timedelta(minutes=5))], [(3, 0, "left", 0.0, 0.0, t + timedelta(hours=5))], [(2, 1, "left", 9.0, 0.0, t + timedelta(hours=5)), (3, 1, "left", 9.0, 0.0, t + timedelta(hours=6))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(track(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), LIMITS, 2.0, "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted((r["episode"], r["frame"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (3, 1)]


@pytest.mark.parametrize("seed", range(30))
def test_state_is_the_ends_of_runs(seed):
    rng = np.random.default_rng(seed)
    frames = np.flatnonzero(rng.random(60) < 0.8)
    values = rng.normal(size=(60, 2))
    order, runs, steps = rng.permutation(frames), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2)), np.empty((0, 2))), {}
    for part in np.array_split(order, 9):
        seen = order[: np.flatnonzero(order == part[-1])[0] + 1]
        again = np.concatenate([part, rng.choice(seen, 3)])
        runs, at, moved = advance(runs, again, values[again])
        assert not set(at.tolist()) & set(steps)
        steps |= dict(zip(at.tolist(), moved.tolist(), strict=True))
    near = [f for f in frames if f - 1 in set(frames.tolist())]
    assert sorted(steps) == near and all(np.allclose(steps[f], abs(values[f] - values[f - 1])) for f in near)
    breaks = np.flatnonzero(np.diff(frames) > 1)
    assert runs[0].tolist() == frames[np.concatenate([[0], breaks + 1])].tolist() and runs[1].tolist() == frames[np.concatenate([breaks, [len(frames) - 1]])].tolist()
    assert np.allclose(runs[2], values[runs[0]]) and np.allclose(runs[3], values[runs[1]])


SNAPS = "pulled_at string, date string, org string, source string, total_datasets long, total_episodes long, total_frames long, total_hours double, datasets array<struct<dataset_name:string,uploader:string,robot_type:string,total_episodes:long,total_frames:long,fps:double,total_tasks:long,duration_hours:double,last_modified:string>>, seq string"


def snap(seq, day, at, sets, org="o", source=None):
    return (f"2026-01-{day:02}T{at}", f"2601{day:02}", org, source, len(sets), sum(s[1] for s in sets), sum(s[2] for s in sets), 1.0, [(n, f"u{at}", None, e, f, 30.0, 1, h, at) for n, e, f, h in sets], seq)


def test_snapshots_merge_once(spark, tmp_path):
    log = str(tmp_path / "log")
    add = lambda *rows: SL.merge(spark.createDataFrame(list(rows), SNAPS), log)
    state = lambda: sorted((r["dataset"], r["date"], r["episodes"], r["frames"], r["d_episodes"], r["d_frames"]) for r in SL.changes(spark, log).collect())
    assert SL.changes(spark, log).count() == SL.metadata(spark, log).count() == 0
    first = snap("1", 1, "08", [("o/a", 4, 100, 1.0), ("o/b", 2, 20, 0.5)])
    add(first, snap("2", 1, "07", [("o/a", 9, 900, 9.0)]))  # the older of a day doesn't count
    add(snap("3", 2, "08", [("o/a", 4, 130, 1.0), ("o/b", 2, 20, 0.5)]), snap("p", 2, "08", [("p/c", 1, 10, 0.1)], org=None))
    want = [("o/a", "260101", 4, 100, 4, 100), ("o/a", "260102", 4, 130, 0, 30), ("o/b", "260101", 2, 20, 2, 20), ("p/c", "260102", 1, 10, 1, 10)]
    assert state() == want
    files = lambda: sorted(str(p) for p in (tmp_path / "log").rglob("part-*"))
    before = [f for f in files() if "date=260102" in f]
    add(first)  # a replay
    add(snap("4", 1, "06", [("o/a", 1, 1, 1.0)]))  # late
    assert state() == want and [f for f in files() if "date=260102" in f] == before  # other days' files weren't touched
    add(snap("5", 2, "09", [("o/a", 6, 150, 2.0)]))  # a newer one of the day replaces it, o/b isn't listed any more
    assert state() == [want[0], ("o/a", "260102", 6, 150, 2, 50), want[2], want[3]]
    assert {r["dataset"]: r["uploader"] for r in SL.metadata(spark, log).collect()} == {"o/a": "u09", "o/b": "u08", "p/c": "u08"}
    add(snap("6", 2, "23:59:59", [], source="manual"))  # a manual one takes the day's details away
    assert state() == [want[0], want[2], want[3]]
    add(snap("7", 2, "10", [("o/a", 7, 160, 2.0)]))  # a real one replaces it although its time is earlier
    assert state() == [want[0], ("o/a", "260102", 7, 160, 3, 60), want[2], want[3]]


def test_events_by_window(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [(t + timedelta(minutes=m), kind) for m, kind in ((0, "a"), (30, "a"), (61, "b"), (62, "a"), (200, "b"))]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(folder)
    counted = counts_by_window(spark.readStream.schema("ts timestamp, event_type string").parquet(folder))
    out = str(tmp_path / "out")
    run(counted.selectExpr("window.start start", "event_type", "count"), out, str(tmp_path / "ck"))
    # hours that the watermark has passed: up to 200 - 10 minutes
    assert sorted((r["start"].hour, r["event_type"], r["count"]) for r in spark.read.parquet(out).collect()) == [(0, "a", 2), (1, "a", 1), (1, "b", 1)]
