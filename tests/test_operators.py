"""Small cases with known results."""

import random
import statistics
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from armada.functions import exprs as X
from armada.operators import changelog as L
from armada.operators import checks as C
from armada.operators import edit as E
from armada.operators import fleet as A
from armada.operators import trajectory as T
from armada.operators.order import medians


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def episodes(spark, rows):
    return spark.createDataFrame(rows, "dataset string, episode long, frame long, vec array<double>")


def test_scalars(spark):
    assert one(spark, X.duration_hours(F.lit(108000), F.lit(0))) == 1.0
    assert one(spark, X.duration_hours(F.lit(None).cast("int"), F.lit(30))) is None
    assert one(spark, X.task_prefix(F.lit("org/pick-cube-0012"))) == "pick-cube"
    assert one(spark, X.yymmdd(F.lit("2026-07-02T23:30:00-05:00"))) == "260702"
    assert one(spark, X.last_number(F.lit("ep_003_cam12"))) == 12
    assert one(spark, X.safe_name(F.lit("__ä b__"))) == "b"
    assert one(spark, X.safe_name(F.lit(""))) == "unknown"
    assert one(spark, X.floor_round(F.lit(2.675), 2)) == 2.68
    assert one(spark, X.index_list(F.lit("0-3，7"))) == [0, 1, 2, 3, 7]
    assert one(spark, X.url_base64(F.lit("a" * 90))) == __import__("base64").urlsafe_b64encode(b"a" * 90).decode().rstrip("=")


def test_finite_components_move_up(spark):
    a = F.array(F.lit(float("nan")), F.lit(1.0), F.lit(2.0))
    assert one(spark, X.finite(a)) == [1.0, 2.0]
    assert one(spark, X.l2(X.finite(a), F.array(F.lit(5.0), F.lit(1.0), F.lit(2.0)))) == pytest.approx(17**0.5)
    assert one(spark, X.l2(F.array().cast("array<double>"), a)) is None


def test_boundary_outlier_is_the_far_start(spark):
    rows = [("d", e, f, [x + f, -x]) for e, x in ((10, 1.0), (11, 1.1), (12, 0.9), (13, 1.0), (14, 9.0)) for f in range(3)]
    out = T.boundary_outliers(episodes(spark, rows), window=2, k=4.0, floor=0.25).collect()
    # the means of the first two frames are (x + 0.5, -x); the others lie at most 0.1 * sqrt(2) from the median
    assert [(r["episode"], round(r["distance"], 6)) for r in out] == [(14, round(8 * 2**0.5, 6))]


def test_jumps_do_not_cross_episodes(spark):
    rows = [("d", e, f, [10.0 * e]) for e in range(2) for f in range(8)]
    assert T.jumps(episodes(spark, rows)).count() == 0


def test_tracker(spark):
    schema = "episode long, frame long, hand string, x double, y double, z double"
    limits = {"x": 1.0, "y": 2.0, "z": 2.0}
    rows = [(4, 10, "left", 5.0, 1.0, 0.0), (4, 11, "left", 3.5, 1.0, 2.0), (4, 12, "left", 3.5, 1.5, 2.5), (4, 10, "right", 0.0, 0.0, 0.0)]
    out = T.tracker_jumps(spark.createDataFrame(rows, schema), limits, 3.0).collect()
    assert [(r["frame"], r["hand"], r["hits"], r["xyz_step"], r["xyz_hit"]) for r in out] == [(11, "left", ["x", "z"], 2.5, False)]
    far = [(1, 0, "left", 0.0, 0.0, 0.0), (1, 1, "left", 0.9, 1.9, 1.9)]
    assert [(r["hits"], r["xyz_hit"]) for r in T.tracker_jumps(spark.createDataFrame(far, schema), limits, 2.8).collect()] == [([], True)]
    gaps = [(1, 0, "left", 0.0, 0.0, 0.0), (1, 2, "left", 50.0, 0.0, 0.0), (2, 3, "left", 0.0, 0.0, 0.0)]
    assert T.tracker_jumps(spark.createDataFrame(gaps, schema), limits, 3.0).count() == 0


def histogram(spark, lengths):
    rows = T.length_histogram(spark.createDataFrame(list(enumerate(lengths)), "episode long, length_seconds double")).collect()
    return sorted((round(r["lo"], 6), round(r["hi"], 6), r["n"]) for r in rows)


def test_histogram(spark):
    # 40 lengths from 10 to 49: 1st percentile 10, 99th 49, at least 10 bins, so a width of 5, and the last bin ends at 50
    assert histogram(spark, [10.0 + i for i in range(40)]) == [(10.0 + 5 * i, 15.0 + 5 * i, 5) for i in range(8)]
    # an end on a bin's edge opens no further bin; its value falls into the last one
    assert histogram(spark, [0.0] * 50 + [10.0] * 50) == [(float(i), i + 1.0, 50 if i in (0, 9) else 0) for i in range(10)]
    assert histogram(spark, [7.5] * 3) == [(7.5, 7.5, 3)] and histogram(spark, []) == [] and histogram(spark, [None, 7.5]) == [(7.5, 7.5, 1)]
    # percentiles that are equal count as a range of 1; what lies outside is in the edge bins
    out = histogram(spark, [3.0] * 198 + [0.0, 90.0])
    assert len(out) == 1 and out[0][2] == 200


def test_ragged_vectors_count_to_the_least_width(spark):
    rows = [("d", e, 0, v) for e, v in enumerate(([0.0, 0.0, 9.0], [0.0, 0.1, -9.0], [0.0, 0.0], [5.0, 0.0, 1.0], [0.1, 0.0, 2.0]))]
    out = T.boundary_outliers(episodes(spark, rows), window=1, k=3.0, floor=0.5).collect()
    assert [r["episode"] for r in out] == [3] and out[0]["distance"] == pytest.approx(5.0)


def test_medians_of_hot_groups_and_ties(spark):
    draw = random.Random(5)
    groups = {"hot": [draw.gauss(0, 1) for _ in range(20_001)], "even": [draw.random() for _ in range(6000)], "ties": [1.0] * 3000 + [2.0] * 3000, "one": [7.0], "two": [3.0, 4.0], "four": [1.0, 5.0, 6.0, 9.0], "same": [0.25] * 5000}
    rows = [(g, 1, x) for g, values in groups.items() for x in values] + [("hot", 1, None), ("none", 1, None), ("hot", 2, 8.0)]
    draw.shuffle(rows)
    out = medians(spark.createDataFrame(rows, "g string, part int, x double").repartition(8), ["g", "part"], "x", "m").collect()
    want = {(g, 1): (len(values), statistics.median(values)) for g, values in groups.items()} | {("hot", 2): (1, 8.0)}
    assert {(r["g"], r["part"]): (r["n"], r["m"]) for r in out} == want


def test_growth_counts_what_grew(spark):
    rows = spark.createDataFrame([("d", "g", Decimal(2), 1, 0), ("d", "g", Decimal(-5), 0, 0), ("d", "g", Decimal(0), 0, 7)], "date string, group string, hours decimal(18,2), episodes long, frames long")
    r = A.group_growth(rows).first()
    assert (float(r["hours"]), r["episodes"], r["datasets"]) == (2.0, 1, 2)


def test_without_a_baseline_all_is_new(spark):
    snaps = spark.createDataFrame([("o", "260101", "t1", 1, 4, Decimal(2)), (None, "260102", "t2", 2, 5, Decimal(3)), ("o", "260103", "t3", 3, 9, Decimal(7)), ("p", "260103", "t4", 4, 6, Decimal(1))], "org string, date string, pulled_at string, ord long, episodes long, hours decimal(18,2)")
    out = {(r["org"], r["date"]): (r["d_episodes"], float(r["d_hours"])) for r in A.aggregate_deltas(snaps, snaps).collect()}
    # a row without org is in every org's history, and its own baseline is any row before
    assert out == {("o", "260101"): (4, 2.0), (None, "260102"): (1, 1.0), ("o", "260103"): (4, 4.0), ("p", "260103"): (1, -2.0)}


def test_streams(spark):
    assert one(spark, X.infer_stream(F.lit("observation.images.right_tactile_left broke"))) == "right_tactile_left"
    assert one(spark, X.infer_stream(F.lit("no stream"))) is None


def test_fold_takes_the_last_of_a_day(spark):
    arrivals = spark.createDataFrame([("o", "260101", "t1", 1, False), ("o", "260102", "t2", 2, False), ("o", "260102", "t3", 3, False), ("o", "260102", "t2", 4, False)], "org string, date string, pulled_at string, seq long, manual boolean")
    details = spark.createDataFrame([("o", "260101", 1, "a", 5, 50, Decimal(1)), ("o", "260102", 2, "a", 10, 90, Decimal(2)), ("o", "260102", 3, "a", 15, 140, Decimal(3)), ("o", "260102", 4, "a", 10, 90, Decimal(2))], "org string, date string, seq long, dataset string, episodes long, frames long, hours decimal(18,2)")
    out = {r["date"]: (r["episodes"], r["d_episodes"], r["d_frames"]) for r in L.fold(arrivals, details).collect()}
    assert out == {"260101": (5, 5, 50), "260102": (15, 10, 90)}


def test_changes_in_frames_alone_stay(spark):
    days = [("d1", 4, 100, Decimal(1)), ("d2", 4, 130, Decimal(1)), ("d3", 4, 130, Decimal(1)), ("d4", 4, None, Decimal(1)), ("d5", None, None, Decimal(3)), ("d6", None, None, Decimal(3))]
    rows = spark.createDataFrame([("a", *r) for r in days], "dataset string, date string, episodes long, frames long, hours decimal(18,2)")
    got = [(r["date"], r["d_episodes"], r["d_frames"], int(r["d_hours"])) for r in L.changes_of(rows).orderBy("date").collect()]
    assert got == [("d1", 4, 100, 1), ("d2", 0, 30, 0), ("d4", 0, -130, 0), ("d5", -4, 0, 2)]
    # compaction keeps a day that changes nothing, and of a day's changes the last
    log = rows.withColumns({"pulled_at": F.col("date"), "ord": F.lit(1)}).unionByName(rows.where("date = 'd2'").withColumns({"frames": F.lit(7).cast("long"), "pulled_at": F.lit("d1"), "ord": F.lit(2)}))
    assert [(r["date"], r["frames"], r["d_frames"]) for r in L.compact(log).orderBy("date").collect()] == [("d1", 100, 100), ("d2", 130, 30), ("d3", 130, 0), ("d4", None, -130), ("d5", None, 0), ("d6", None, 0)]


def test_manual_row_that_arrives_later_stands(spark):
    rows = spark.createDataFrame([("o", "d", "t9", 1, False), ("o", "d", "t1", 2, True)], "org string, date string, pulled_at string, seq long, manual boolean")
    assert L.effective(rows).first()["manual"]


def test_deltas_without_details(spark):
    cur = spark.createDataFrame([("a", 3, 70, Decimal(2))], "dataset string, episodes long, frames long, hours decimal(18,2)")
    r = A.dataset_deltas(cur, cur.limit(0)).first()
    assert (r["d_episodes"], r["d_frames"], r["is_new"]) == (3, 70, True)
    r = A.dataset_deltas(cur, cur.limit(0), has_details=False).first()
    assert (r["d_episodes"], r["d_frames"], r["is_new"]) == (0, 0, False)


def test_range_groups(spark):
    rows = [(f"2603{day:02}", group, Decimal(day), day, 1) for day in range(1, 11) for group in ("north", "south") if (day % 3 == 0) == (group == "south")]
    days = spark.createDataFrame(rows, "date string, group string, hours decimal(18,2), episodes long, datasets long")
    # ends are swapped and closed: 4, 5, 7, 8 are of the north, 6 and 9 of the south
    assert {r["group"]: (float(r["hours"]), r["datasets"]) for r in A.range_group_totals(days, "260309", "260304").collect()} == {"north": (24.0, 4), "south": (15.0, 2)}
    assert {r["group"]: r["episodes"] for r in A.range_group_totals(days, None, "260303").collect()} == {"north": 3, "south": 3}


def test_prompt_findings(spark):
    assert [x["message"] for x in one(spark, C.prompt_findings(F.lit("pull-out the tray")))] == ["too few words", "illegal characters"]
    assert [x["message"] for x in one(spark, C.prompt_findings(F.lit("\n fold @ the towel")))] == ["too few words"]
    tasks = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(t).alias("task")) for i, t in enumerate(("lift the lid of the pot and set it down left of it", "9 a", None))])
    found = one(spark, C.check_tasks(tasks))
    assert found["status"] == "warn" and found["details"] == ["[1] too few words", "[1] not a sentence", "[2] too few words", "[2] not a sentence"]
    assert one(spark, C.prompt_findings(F.lit("pick the red cube and put it into the blue box"))) == []


def test_editing(spark):
    frames = spark.createDataFrame([(e, f, 0) for e in (2, 5, 9) for f in (0, 1)], "episode long, frame long, task_index long")
    gone = spark.createDataFrame([(5,)], "episode long")
    assert sorted({r["episode"] for r in E.delete_episodes(frames, gone).collect()}) == [0, 1]
    with pytest.raises(ValueError):
        E.remove_features(frames, ["episode"])
    with pytest.raises(ValueError):
        E.merge([(frames, frames)])
    assert E.add_feature(frames, "grip", "float32", (2, 3)).schema["grip"].dataType.simpleString() == "array<array<float>>"


def test_empty_frames(spark):
    none = episodes(spark, [])
    for out in (T.jumps(none), T.idle_periods(none), T.length_outliers(none), T.boundary_outliers(none)):
        assert out.count() == 0


def test_windows_and_vectors(spark):
    window = F.struct(*X.issue_window(F.lit(15), F.lit(30.0), F.lit(None).cast("double"), F.lit(None).cast("double")))
    assert tuple(one(spark, window)) == (0.0, 1.5)
    assert tuple(one(spark, F.struct(*X.issue_window(F.lit(15), F.lit(30.0), F.lit(2.00049), F.lit(3.0))))) == (2.0, 3.0)
    nested = F.array(F.array(F.lit(1.0), F.lit(None).cast("double")), F.lit(None).cast("array<double>"), F.array(F.lit(2.0)))
    flat = one(spark, X.flat_vector(nested, 2))
    assert flat[0] == 1.0 and flat[3] == 2.0 and flat[1] != flat[1] and flat[2] != flat[2]
    assert one(spark, X.flat_vector(F.lit(3))) == [3.0] and one(spark, X.flat_vector(F.array().cast("array<double>"), 1)) is None
    names = [f"{hand}_tcp.{axis}" for hand in ("right", "left") for axis in "zyx"]
    assert X.component_ordinals(names, ["left"]) == {"left": [5, 4, 3]}
    with pytest.raises(ValueError):
        X.component_ordinals(names[:-1], ["left"])


def test_names_and_splits(spark):
    assert X.leaf_name("  fold-towel_01 ") == "fold-towel_01"
    for bad in ("", None, "a/b", "a b"):
        with pytest.raises(ValueError):
            X.leaf_name(bad)
    assert X.split_parts("a:0.75， b:0.25") == {"a": 0.75, "b": 0.25} and X.split_parts("a:2-4,b:7-7") == {"a": [2, 3, 4], "b": [7]}
    for bad in ("a", "a:0.5,b:1-2", "a:x"):
        with pytest.raises(ValueError):
            X.split_parts(bad)
    assert one(spark, X.completion(F.lit(1), F.lit(3))) == 33.3 and one(spark, X.completion(F.lit(1), F.lit(0))) is None
    calls = F.lit('[{"function": {"name": "grasp"}}, {"x": 1}, {"function": {"name": "lift"}}]')
    assert one(spark, X.atom_text(F.lit(""), calls)) == "· grasp, lift"
    assert one(spark, X.atom_text(F.lit("hold"), calls)) == "hold" and one(spark, X.atom_text(F.lit(None).cast("string"), F.lit("nothing"))) == "(空)"


def test_local_quality_and_integrity(spark):
    issue = "array<struct<severity:string,message:string,episode:long,start_sec:double,end_sec:double,frame:long,field:string>>"
    rows = spark.createDataFrame([(1, [("warn", "far", 3, 1.0, 2.5, None, "arm"), ("skip", "s", None, None, None, None, None)]), (2, [("skip", "no data", None, None, None, 7, None)]), (3, [])], f"id long, issues {issue}")
    out = {r["id"]: tuple(r["x"]) for r in rows.select("id", C.check_local_quality({}).alias("x")).collect()}
    assert out == {1: ("warn", "1 episode issues"), 2: ("skip", "no data"), 3: ("ok", "")}
    lines = {r["id"]: r["l"] for r in rows.select("id", F.transform("issues", C.issue_line).alias("l")).collect()}
    assert lines[1] == ["episode 3 / 1.000s-2.500s / arm: far", "s"] and lines[2] == ["frame 7: no data"]
    info = spark.createDataFrame([(5, 100, 30.0, True), (0, None, 30.0, False)], "total_episodes long, total_frames long, fps double, has_stats boolean")
    assert [r["integrity"] for r in C.integrity_issues(info).collect()] == [[], ["info lacks total_episodes", "info lacks total_frames", "no statistics"]]


def test_days_styles_and_clip_names(spark):
    text = lambda f, x: one(spark, f(F.lit(x).cast("string")))
    assert [text(X.day_text, x) for x in ("260228", "700101", "260230", "soon", "", None)] == ["2026-02-28", "1970-01-01", "260230", "soon", "—", "—"]
    assert [text(X.day_weekday, x) for x in ("260301", "260302", "26", None)] == ["03-01\n周日", "03-02\n周一", "26", "—"]
    assert one(spark, X.days_between(F.lit("260228"), F.lit("260301"))) == 1 and one(spark, X.days_between(F.lit("x"), F.lit("260301"))) is None
    assert [text(X.style_label, x) for x in ("plan", "sketch", "", None)] == ["计划", "sketch", "语音", "语音"]
    assert [text(X.style_place, x) for x in ("task_aug", "vqa", None, "sketch")] == [1, 6, 7, 8]
    assert [text(X.is_event_style, x) for x in ("vqa", "plan", None)] == [True, False, True]
    clip = lambda path, field: one(spark, X.clip_camera(F.lit(path).cast("string"), F.lit(field).cast("string")))
    assert [clip("v/right_wrist/1.mp4", "left_wrist"), clip(None, "left_wrist"), clip("v", "arm 1"), clip(None, None)] == ["right_wrist", "left_wrist", "arm_1", "clip"]


def test_issue_counts(spark):
    issues = spark.createDataFrame([(10, "b", "f", None), (2, "a", None, "confirmed"), (None, "b", "f", "未确认")], "episode long, rule string, field string, review_status string")
    assert tuple(C.issue_totals(issues).first()) == (3, 3, 2) and tuple(C.issue_totals(issues.limit(0)).first()) == (0, 0, 0)
    assert [(r["kind"], r["value"]) for r in C.issue_summary(issues).collect()] == [("episode", "10"), ("episode", "2"), ("episode", "unknown"), ("field", "f"), ("field", "unknown"), ("rule", "b"), ("rule", "a")]


def test_chunk_length_skips_gaps(spark):
    rows = [(1, f, float((f // 3) % 2)) for f in range(40) if f != 20] + [(2, f, float(f)) for f in range(9)] + [(3, None, 1.0)]
    got = {r["episode"]: r["lag"] for r in T.autocorrelation_lag(spark.createDataFrame(rows, "episode long, frame long, v double"), 0.0, 8).collect()}
    v = {f: x for e, f, x in rows if e == 1}

    def r(k):
        a, b = np.array([(v[f], v[f + k]) for f in v if f + k in v]).T
        return np.corrcoef(a, b)[0, 1]

    assert got == {1: next(k for k in range(1, 9) if r(k) < 0.0)}
