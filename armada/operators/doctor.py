"""Consistency of a dataset: frames, episodes and tasks held against each other in one pass over the frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHECKS = ("metadata", "length", "start", "gaps", "repeats", "time", "tasks")


def diagnose(frames: DataFrame, episodes: DataFrame, tasks: DataFrame, first: int | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """episode, check, severity, n and message: what is wrong with each episode, a row a check.

    frames: episode, frame, timestamp, task_index.  episodes: episode, length.  tasks: task_index.  The scope is every episode,
    the first ones by number, or those between two numbers.  metadata: frames without a row in episodes, or a row without
    frames.  length: another number of frames than episodes say.  start: the first frame isn't 0.  gaps: frame numbers that are
    left out.  repeats: frames whose number occurs before.  time: frames whose timestamp isn't after that of the frame before.
    tasks: frames whose task_index tasks lack.  Missing numbers and times don't count, a missing task_index is one that tasks
    lack; a repeated row of episodes counts once, with its greatest length.
    """
    if between is not None:
        frames, episodes = (x.where(F.col("episode").between(*between)) for x in (frames, episodes))
    frames, episodes = (x.where("episode is not null") for x in (frames, episodes))
    if first is not None:
        # the ids of a scope reach the driver: its last one bounds it
        ids = [r[0] for r in frames.select("episode").union(episodes.select("episode")).distinct().orderBy("episode").limit(first).collect()]
        frames, episodes = (x.where(F.col("episode") <= F.lit(ids[-1] if ids else None)) for x in (frames, episodes))
    line = Window.partitionBy("episode").orderBy("frame", "timestamp")
    known = tasks.select("task_index").dropna().distinct().withColumn("_known", F.lit(True))
    # tasks are joined by value before the rows are dealt by episode, so window and aggregate share one shuffle
    rows = frames.select("episode", "frame", "timestamp", "task_index").join(known, "task_index", "left")
    rows = rows.withColumns({"late": F.col("timestamp") <= F.lag("timestamp").over(line), "again": F.col("frame") == F.lag("frame").over(line)})
    seen = rows.groupBy("episode").agg(F.count(F.lit(1)).alias("frames"), F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.count("frame").alias("numbered"), F.count_if(F.coalesce("again", F.lit(False))).alias("again"), F.count_if(F.coalesce("late", F.lit(False))).alias("late"), F.count_if(F.col("_known").isNull()).alias("unknown"))
    said = episodes.groupBy("episode").agg(F.max("length").alias("length"), F.lit(True).alias("listed"))
    both = seen.join(said, "episode", "full_outer")
    frames_, length = F.coalesce("frames", F.lit(0)), F.col("length")
    missing = F.col("hi") - F.col("lo") + 1 - (F.col("numbered") - F.col("again"))

    def finding(check: str, severity: str, when: Column, n: Column, message: str) -> Column:
        return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), n.cast("long").alias("n"), F.lit(message).alias("message")))

    found = [
        finding("metadata", "fail", F.col("listed").isNull(), frames_, "frames without metadata"),
        finding("metadata", "fail", frames_ == 0, F.coalesce(length, F.lit(0)), "metadata without frames"),
        finding("length", "fail", (frames_ > 0) & (length != frames_), F.abs(length - frames_), "another number of frames than the metadata say"),
        finding("start", "warn", F.col("lo") != 0, F.col("lo"), "the first frame is not 0"),
        finding("gaps", "fail", missing > 0, missing, "frame numbers are left out"),
        finding("repeats", "fail", F.col("again") > 0, F.col("again"), "frame numbers occur again"),
        finding("time", "warn", F.col("late") > 0, F.col("late"), "times do not rise"),
        finding("tasks", "fail", F.col("unknown") > 0, F.col("unknown"), "tasks are unknown"),
    ]
    return both.select("episode", F.explode(F.array_compact(F.array(*found))).alias("x")).select("episode", "x.*")


def summary(findings: DataFrame) -> DataFrame:
    """check, severity and episodes: one row a check, pass where no episode fails it."""
    spine = findings.sparkSession.createDataFrame([(c,) for c in CHECKS], "check string")
    counted = findings.groupBy("check").agg(F.countDistinct("episode").alias("episodes"), F.max(F.when(F.col("severity") == "fail", 2).otherwise(1)).alias("_worst"))
    worst = F.when(F.col("_worst") == 2, "fail").when(F.col("_worst") == 1, "warn").otherwise("pass")
    return spine.join(counted, "check", "left").select("check", worst.alias("severity"), F.coalesce("episodes", F.lit(0)).alias("episodes"))
