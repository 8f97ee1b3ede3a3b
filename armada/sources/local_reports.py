"""Summaries of dataset folders on disk, and the newest report that is there: a pull's file, else the log, else the folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.functions.exprs import duration_hours, file_path
from armada.sources.datasets import CACHE, INFO, SNAPSHOT, change_log, write_document
from armada.sources.scratch import written

SUMMARY = "dataset_name string, local_dir string, total_episodes long, total_frames long, fps double, robot_type string, total_tasks long, duration_hours double, tasks array<struct<task_index:long,task:string>>, modified timestamp"
REPORT = "total_datasets long, total_episodes long, total_frames long, total_hours double, pulled_at string, date string, org string, origin string, datasets array<struct<dataset_name:string,uploader:string,robot_type:string,total_episodes:long,total_frames:long,fps:double,total_tasks:long,duration_hours:double,last_modified:string>>"


def found(spark: SparkSession, pattern: str, schema: str, kind: str = "json") -> DataFrame:
    """The files of a pattern as rows with file and modified; none if there are no files."""
    try:
        df = spark.read.format("parquet").option("mergeSchema", True).load(pattern) if kind == "parquet" else spark.read.schema(schema).option("multiLine", True).json(pattern)
    except AnalysisException:  # no such file
        df = spark.createDataFrame([], schema).withColumn("_metadata", F.struct(F.lit("").alias("file_path"), F.lit(None).cast("timestamp").alias("file_modification_time"), F.lit(0).cast("long").alias("row_index")))
    return df.withColumns({"file": file_path(F.col("_metadata.file_path")), "modified": F.col("_metadata.file_modification_time")})


def summaries(spark: SparkSession, folder: str, org: str) -> DataFrame:
    """One row (see SUMMARY) for each dataset folder below folder that has meta/info.json: what the info says, hours by frames
    and frame rate, and the tasks of meta/tasks.parquet in their order.

    All folders are read at once, as two tables joined by folder.  An info that can't be parsed gives a row with its name alone;
    tasks without a text are left out, without a whole-numbered index they have their place in the file; a dataset without tasks
    has null.
    """
    place = lambda c: F.regexp_extract(c, r"^(.*)/meta/(?:info\.json|tasks\.parquet)(?:/[^/]*)?$", 1)
    info = found(spark, f"{folder}/*/meta/info.json", INFO).withColumn("local_dir", place("file"))
    rows = found(spark, f"{folder}/*/meta/tasks.parquet", "task_index long, task string", "parquet").withColumn("at", F.col("_metadata.row_index"))
    index = F.col("task_index").try_cast("long") if "task_index" in rows.columns else F.lit(None).cast("long")
    text = F.col("task") if "task" in rows.columns else F.lit(None).cast("string")
    tasks = rows.select(place("file").alias("local_dir"), F.coalesce(index, F.col("at")).alias("task_index"), text.alias("task")).where("task is not null")
    tasks = tasks.groupBy("local_dir").agg(F.array_sort(F.collect_list(F.struct("task_index", "task"))).alias("tasks"))  # a dataset has few tasks
    name = F.concat(F.lit(f"{org}/"), F.element_at(F.split("local_dir", "/"), -1))
    hours = duration_hours(F.col("total_frames"), F.col("fps")).cast("double")
    return info.join(tasks, "local_dir", "left").select(name.alias("dataset_name"), "local_dir", "total_episodes", "total_frames", "fps", "robot_type", "total_tasks", hours.alias("duration_hours"), "tasks", "modified")


def report_of(summaries_: DataFrame, pulled_at: str | None, org: str, origin: str) -> DataFrame:
    """One row (see REPORT): totals over summaries and the summaries themselves; pulled_at is the newest folder's time where none
    is given.  No summaries give totals of 0 and an empty list."""
    known = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = F.struct("dataset_name", F.lit(None).cast("string").alias("uploader"), "robot_type", "total_episodes", "total_frames", "fps", "total_tasks", "duration_hours", F.lit(None).cast("string").alias("last_modified"))
    at = F.lit(pulled_at) if pulled_at is not None else F.date_format(F.max("modified"), "yyyy-MM-dd'T'HH:mm:ss")
    out = summaries_.agg(F.count(F.lit(1)).alias("total_datasets"), known("total_episodes").alias("total_episodes"), known("total_frames").alias("total_frames"), F.round(known("duration_hours"), 3).cast("double").alias("total_hours"), at.alias("pulled_at"), F.array_sort(F.collect_list(one)).alias("datasets"))
    day = F.concat(F.substring("pulled_at", 3, 2), F.substring("pulled_at", 6, 2), F.substring("pulled_at", 9, 2))
    return out.select("total_datasets", "total_episodes", "total_frames", "total_hours", "pulled_at", day.alias("date"), F.lit(org).alias("org"), F.lit(origin).alias("origin"), "datasets")


def newest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot of the file pull_result_* with the greatest path, of those in folder itself or, where it has none, in its
    folders; no row without any, or if it can't be parsed or lists no datasets."""
    for pattern in (f"{folder}/pull_result_*.json", f"{folder}/*/pull_result_*.json"):
        rows = found(spark, pattern, SNAPSHOT)
        if not rows.select("file").isEmpty():
            last = rows.orderBy(F.col("file").desc()).limit(1)
            return last.where("size(datasets) > 0").drop("file", "modified")
    return spark.createDataFrame([], SNAPSHOT)


def logged_report(spark: SparkSession, log: str, org: str) -> DataFrame:
    """The newest snapshot of org in a change log, with its datasets as they stood: of each the last change up to then, and its
    newest metadata."""
    tables = change_log(spark, log)
    last = tables["daily"].where(F.col("org") == org).orderBy(F.col("pulled_at").desc_nulls_last(), F.col("ord").desc()).limit(1)
    present = last.select(F.col("pulled_at").alias("at"), F.explode("present").alias("pos")).join(tables["index"], "pos")
    stood = tables["changes"].join(present, "dataset").where(F.coalesce("pulled_at", F.lit("")) <= F.coalesce("at", F.lit("")))
    stood = stood.groupBy("dataset").agg(F.max_by(F.struct("total_episodes", "total_frames", "duration_hours"), F.struct("pulled_at", "date")).alias("x"))
    one = F.struct(F.col("dataset").alias("dataset_name"), "uploader", "robot_type", "x.total_episodes", "x.total_frames", "fps", "total_tasks", "x.duration_hours", "last_modified")
    listed = stood.join(tables["datasets"], "dataset").agg(F.array_sort(F.collect_list(one)).alias("datasets"))
    return last.crossJoin(listed).where("size(datasets) > 0").select("total_datasets", "total_episodes", "total_frames", "total_hours", "pulled_at", "date", "org", F.lit("log").alias("origin"), "datasets")


def local_report(spark: SparkSession, folder: str, org: str, log: str) -> DataFrame:
    """The newest report that is on disk, one row (see REPORT) or none: a snapshot file that lists datasets (origin file), else
    the last snapshot of org in the log (log), else what the dataset folders say (folders)."""
    columns = [c.split()[0] for c in REPORT.replace(", ", ",").split(",") if " " in c]
    file = written(newest_snapshot(spark, folder).withColumn("origin", F.lit("file")).select(*columns), "report")
    if not file.isEmpty():
        return file
    logged = written(logged_report(spark, log, org).select(*columns), "report")
    if not logged.isEmpty():
        return logged
    return report_of(summaries(spark, folder, org), None, org, "folders").where("total_datasets > 0").select(*columns)


def write_report_file(spark: SparkSession, report: DataFrame, failures: DataFrame, requested: int, path: str) -> None:
    """One report (one row, see REPORT) as a JSON document with how many datasets were asked for and, where there are any, the
    failures (dataset_name, error); newest_snapshot reads it.  A pull lists one organisation's datasets, in one row."""
    wrong = failures.agg(F.array_sort(F.collect_list(F.struct("dataset_name", "error"))).alias("failures"))
    whole = report.drop("origin").crossJoin(wrong).withColumns({"requested": F.lit(requested), "count": F.col("total_datasets"), "failures": F.when(F.size("failures") > 0, F.col("failures"))})
    fields = F.struct(*[c for c in whole.columns if c != "failures"]), F.struct(*whole.columns)
    text = F.when(F.col("failures").isNull(), F.to_json(fields[0], {"ignoreNullFields": "false", "pretty": "true"})).otherwise(F.to_json(fields[1], {"ignoreNullFields": "false", "pretty": "true"}))
    write_document(spark, whole.select(text.alias("value")), path)


def write_change_cache(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """The commit-diff cache (rows as datasets.change_cache gives them) as the JSON document that it reads back."""
    change = F.struct("date", "commit_id", "created_at", "hours", "episodes", "frames")
    repos = rows.groupBy("dataset").agg(F.max("last_modified").alias("last_modified"), F.max("head_commit").alias("head_commit"), F.array_sort(F.collect_list(F.struct("created_at", "commit_id", change.alias("c")))).alias("all"))
    one = F.struct("last_modified", "head_commit", F.lit(None).cast("string").alias("updated_at"), F.transform("all", lambda x: x["c"]).alias("changes"))
    whole = repos.agg(F.struct(F.lit(1).cast("long").alias("version"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("dataset").alias("key"), one.alias("value"))), lambda x, y: F.when(x["key"] < y["key"], -1).otherwise(1))).alias("repos")).cast(CACHE).alias("doc"))
    write_document(spark, whole.select(F.to_json("doc", {"ignoreNullFields": "false", "pretty": "true"}).alias("value")), path)
