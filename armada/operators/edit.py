"""Editing of datasets: frames are (episode, frame, ...) rows, tasks are (task_index, task).

What is not settled elsewhere is settled here: fractions are contiguous in episode order, episodes are renumbered densely from
0, tasks are merged by their text.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armada.functions.exprs import replaced_text
from armada.operators.order import numbered

REQUIRED = ("episode", "frame", "timestamp", "index", "task_index")


def rewrite_prompts(tasks: DataFrame, replacements: dict[str, str], column: str = "task") -> DataFrame:
    """Tasks with exact matches replaced, and changed."""
    new = replaced_text(F.col(column), replacements)
    return tasks.withColumn("_new", new).withColumn("changed", ~F.col("_new").eqNullSafe(F.col(column))).withColumn(column, F.col("_new")).drop("_new")


def renumber(frames: DataFrame, keep: DataFrame) -> DataFrame:
    """frames of the episodes in keep, renumbered densely from 0 in their order.

    The numbers come from one row an episode: ordered ranges give each episode its place in its range, and the ranges' counts
    give each range its start.
    """
    places = numbered(keep.select("episode").distinct(), "episode").withColumnRenamed("place", "new")
    return frames.join(places, "episode").withColumn("episode", F.col("new").cast("long")).drop("new")


def delete_episodes(frames: DataFrame, gone: DataFrame) -> DataFrame:
    return renumber(frames, frames.select("episode").distinct().join(gone, "episode", "left_anti"))


def split_fraction(frames: DataFrame, parts: dict[str, float]) -> DataFrame:
    """split and frames: episodes dealt to the parts in order, by cumulative fractions of their number; each part renumbered."""
    ids = frames.select("episode").distinct()
    n = ids.count()
    ends = [0] + [int(n * min(1.0, s) + 1e-9) for s in itertools.accumulate(parts.values())]
    placed = numbered(ids, "episode")
    label: Column = F.lit(None).cast("string")
    start: Column = F.lit(None).cast("long")
    for (name, _), a, b in zip(parts.items(), ends[:-1], ends[1:], strict=True):
        inside = (F.col("place") >= a) & (F.col("place") < b)
        label, start = F.when(inside, name).otherwise(label), F.when(inside, F.lit(a).cast("long")).otherwise(start)
    placed = placed.withColumn("split", label).withColumn("new", F.col("place") - start).where("split is not null")
    return frames.join(placed, "episode").withColumn("episode", F.col("new").cast("long")).drop("new", "place")


def split_ranges(frames: DataFrame, parts: dict[str, list[int]]) -> DataFrame:
    rows = [(n, e, i) for n, episodes in parts.items() for i, e in enumerate(sorted(set(episodes)))]
    placed = frames.sparkSession.createDataFrame(rows, "split string, episode long, new long")
    return frames.join(F.broadcast(placed), "episode").withColumn("episode", F.col("new")).drop("new")


def merge(datasets: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Frames and tasks of several datasets in one: episode numbers are offset, tasks with the same text are one task."""
    if len(datasets) < 2:
        raise ValueError("a merge takes at least two datasets")
    frames, tasks, offset = None, None, 0
    for i, (f, t) in enumerate(datasets):
        f = f.withColumns({"episode": F.col("episode") + offset, "_d": F.lit(i)})
        t = t.withColumn("_d", F.lit(i))
        frames, tasks = (f, t) if frames is None else (frames.unionByName(f, allowMissingColumns=True), tasks.unionByName(t))
        last = datasets[i][0].agg(F.max("episode")).first()[0]
        offset += 0 if last is None else last + 1
    merged = tasks.groupBy("task").agg(F.min(F.struct("_d", "task_index")).alias("o")).withColumn("new", (F.row_number().over(Window.orderBy("o")) - 1).cast("long"))
    keys = tasks.join(merged, "task").select("_d", "task_index", "new")
    frames = frames.join(keys, ["_d", "task_index"], "left").withColumn("task_index", F.col("new")).drop("new", "_d")
    return frames, merged.select(F.col("new").alias("task_index"), "task")


def add_feature(frames: DataFrame, name: str, dtype: str, shape: tuple[int, ...] = (1,), fill: float = 0) -> DataFrame:
    kind = {"float32": "float", "float64": "double", "int64": "bigint"}[dtype]
    value = F.lit(fill).cast(kind)
    for size in reversed(shape if shape != (1,) else ()):
        value = F.array_repeat(value, size)
    return frames.withColumn(name, value)


def remove_features(frames: DataFrame, names: list[str]) -> DataFrame:
    if kept := [n for n in names if n in REQUIRED]:
        raise ValueError(f"required features can't be removed: {kept}")
    return frames.drop(*names)
