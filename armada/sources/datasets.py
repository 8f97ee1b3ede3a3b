"""Readers and writers of dataset folders: episodes, tasks, info, annotations, snapshots, logs; scan.py has the frames."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armada.functions.exprs import STREAMS, file_path, last_number

FEATURES = "map<string,struct<dtype:string,shape:array<int>,names:array<string>>>"
INFO = f"total_episodes long, total_frames long, fps double, robot_type string, total_tasks long, video_path string, features {FEATURES}"
ATOMS = "struct<version:string,episodes:map<string,struct<atoms:array<struct<role:string,content:string,style:string,timestamp:double,camera:string,tool_calls:string>>>>>"
SNAPSHOT = "pulled_at string, date string, org string, total_datasets long, total_episodes long, total_frames long, total_hours double, source string, datasets array<struct<dataset_name:string,uploader:string,robot_type:string,total_episodes:long,total_frames:long,fps:double,total_tasks:long,duration_hours:double,last_modified:string>>"


def episode_lengths(spark: SparkSession, root: str, fps: float) -> DataFrame:
    """episode_index and length_seconds; in the order of episodes; only two columns are read, rows with nulls are left out."""
    if not fps > 0:
        raise ValueError(f"frame rate {fps} is not positive")
    df = spark.read.parquet(f"{root}/meta/episodes/chunk-*/file-*.parquet").select("episode_index", "length").dropna()
    return df.select("episode_index", (F.col("length") / fps).alias("length_seconds")).orderBy("episode_index")


def tasks(spark: SparkSession, root: str) -> DataFrame:
    """task_index and task without null texts; a table without the task column is empty, one without whole-numbered task_index
    has the places of its rows."""
    df = spark.read.parquet(f"{root}/meta/tasks.parquet")
    if "task" not in df.columns:
        return spark.createDataFrame([], "task_index long, task string")
    if dict(df.dtypes).get("task_index") not in ("bigint", "int", "smallint", "tinyint"):
        # one small file: the place of a row in it
        df = df.withColumn("task_index", F.col("_metadata.row_index"))
    return df.where("task is not null").select(F.col("task_index").cast("long").alias("task_index"), "task").orderBy("task_index")


def info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INFO).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def camera_features(info_rows: DataFrame) -> DataFrame:
    """Names of the features that are videos or named as images or cameras."""
    rows = info_rows.select("file", F.explode("features").alias("name", "feature"))
    return rows.where((F.col("feature.dtype") == "video") | F.lower("name").rlike("image|camera")).select("file", "name")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row an atom: episode and the atom's fields.  A document that can't be parsed has none."""
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", ATOMS).alias("d"))
    each = doc.select(F.explode("d.episodes").alias("episode", "e")).select("episode", F.explode("e.atoms").alias("a"))
    return each.select("episode", "a.*")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).option("multiLine", True).json(f"{folder}/pull_result_*.json")


CHANGE = "date:string,pulled_at:string,total_episodes:long,total_frames:long,duration_hours:double,d_episodes:long,d_frames:long,d_hours:double"
LOG = f"struct<dataset_index:array<string>,daily_totals:array<struct<pulled_at:string,date:string,org:string,total_datasets:long,total_episodes:long,total_frames:long,total_hours:double,present:array<long>,source:string>>,datasets:map<string,struct<fps:double,robot_type:string,total_tasks:long,uploader:string,last_modified:string,changes:array<struct<{CHANGE}>>>>>"
CACHE = "struct<version:long,repos:map<string,struct<last_modified:string,head_commit:string,updated_at:string,changes:array<struct<date:string,commit_id:string,created_at:string,hours:double,episodes:long,frames:long>>>>>"


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row, doc: a JSON document of this schema.  A missing file, or one that can't be parsed, gives a null doc."""
    folder, _, name = path.rpartition("/")
    try:
        text = spark.read.option("pathGlobFilter", name).text(folder, wholetext=True).select(F.from_json("value", schema).alias("doc"))
    except AnalysisException:  # no such folder
        return spark.createDataFrame([(None,)], f"doc {schema}")
    return text.unionByName(spark.createDataFrame([(None,)], f"doc {schema}")).orderBy(F.col("doc").isNull()).limit(1)


def change_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The change log as tables: index (pos, dataset), daily (one row a snapshot, with present), datasets (dataset and its
    metadata) and changes (dataset and one row a change).  Missing parts, and missing or broken files, are empty tables."""
    doc = document(spark, path, LOG)
    each = doc.select(F.explode("doc.datasets").alias("dataset", "x"))
    return {
        "index": doc.select(F.posexplode("doc.dataset_index").alias("pos", "dataset")).select(F.col("pos").cast("long").alias("pos"), "dataset"),
        "daily": doc.select(F.posexplode("doc.daily_totals").alias("ord", "x")).select(F.col("ord").cast("long").alias("ord"), "x.*"),
        "datasets": each.select("dataset", "x.fps", "x.robot_type", "x.total_tasks", "x.uploader", "x.last_modified"),
        "changes": each.select("dataset", F.explode("x.changes").alias("c")).select("dataset", "c.*"),
    }


def write_change_log(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of change_log as one JSON document, which change_log reads back; a log has one row a dataset and change."""
    columns = [c.split(":")[0] for c in CHANGE.split(",")]
    line = F.array_sort(F.collect_list(F.struct("date", "pulled_at", *columns[2:])))
    changes = tables["changes"].groupBy("dataset").agg(line.alias("changes"))
    meta = tables["datasets"].join(changes, "dataset", "left").withColumn("changes", F.coalesce("changes", F.array().cast(f"array<struct<{CHANGE}>>")))
    spark = meta.sparkSession
    names = tables["index"].agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dataset"))), lambda x: x["dataset"]).alias("dataset_index"))
    daily = tables["daily"].agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*[c for c in tables["daily"].columns if c != "ord"]).alias("x")))), lambda x: x["x"]).alias("daily_totals"))
    of = meta.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset", F.struct(*[c for c in meta.columns if c != "dataset"]).alias("x"))))).alias("datasets"))
    whole = names.crossJoin(daily).crossJoin(of)  # one row each
    text = whole.select(F.to_json(F.struct("dataset_index", "daily_totals", "datasets"), {"ignoreNullFields": "false"}).alias("value"))
    write_document(spark, text, path)


def write_document(spark: SparkSession, text: DataFrame, path: str) -> None:
    """One row of text as one file at path, replacing what is there, through the file system that the path names."""
    jvm, value = spark.sparkContext._jvm, text.first()[0]
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(value.encode() + b"\n"))
    finally:
        out.close()


def change_cache(spark: SparkSession, path: str) -> DataFrame:
    """The commit-diff cache, one row a change: dataset, last_modified, head_commit and the change's fields.  Missing or broken
    files are empty."""
    each = document(spark, path, CACHE).select(F.explode("doc.repos").alias("dataset", "x"))
    return each.select("dataset", "x.last_modified", "x.head_commit", F.explode("x.changes").alias("c")).select("dataset", "last_modified", "head_commit", "c.*")


def legacy_history(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of the old history file: a list of them, or an object with the list under pull_history; else none."""
    row = "array<struct<" + SNAPSHOT.replace(" array", ":array").replace(", ", ",").replace(" ", ":") + ">>"
    plain, held = document(spark, path, row), document(spark, path, f"struct<pull_history:{row}>").select("doc.pull_history")
    rows = plain.select(F.filter("doc", lambda x: x["pulled_at"].isNotNull() | x["date"].isNotNull()).alias("rows")).unionByName(held.toDF("rows"))
    return rows.select(F.posexplode("rows").alias("ord", "x")).select(F.col("ord").cast("long").alias("ord"), "x.*").distinct()


def doctor_stream(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of line-delimited events: file, result (JSON) and error.  The first error ends a stream; of results the
    last counts; without either the stream ended early.  Blank lines and unknown kinds are passed over."""
    events = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value").where(F.trim("value") != "")
    kind, text = F.get_json_object("value", "$.type"), lambda name: F.get_json_object("value", f"$.{name}")
    events = events.select("file", "at", kind.alias("kind"), text("result").alias("result"), text("error").alias("error"))
    first = events.groupBy("file").agg(F.min(F.when(F.col("kind") == "error", F.struct("at", F.coalesce("error", F.lit("failed")).alias("error")))).alias("e"), F.max(F.when(F.col("kind") == "result", F.struct("at", "result"))).alias("r"))
    ended = F.when(F.col("e").isNotNull(), F.col("e.error")).when(F.col("r.result").isNull(), "the stream ended without a result")
    return first.select("file", F.when(F.col("e").isNull(), F.col("r.result")).alias("result"), ended.alias("error"))


def video_files(spark: SparkSession, root: str) -> DataFrame:
    """Videos below root that hold anything: path, relative to it.  Only names are listed, no content is read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp4").load(root)
    return files.select(F.substring("path", len(base) + 2, 1 << 30).alias("path"))


def stream_videos(spark: SparkSession, root: str) -> DataFrame:
    """field and path of every video below root/videos that names a stream, once a stream that it names."""
    files = video_files(spark, root).where(F.col("path").startswith("videos/"))
    return files.select(F.explode(F.filter(F.array(*[F.lit(s) for s in STREAMS]), lambda s: F.contains("path", s))).alias("field"), "path")


#: Fixed value: where the videos of a dataset are unless its info says otherwise.
VIDEO_PATH = "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template's text with its named places, plain or zero-padded numbers such as {n:03d}, taken from columns."""
    parts = re.split(r"\{(\w+)(?::0?(\d*)d)?\}", template)
    out = [F.lit(parts[0])]
    for name, width, text in zip(parts[1::3], parts[2::3], parts[3::3], strict=True):
        out += [F.format_string(f"%0{width}d", values[name]) if width else values[name].cast("string"), F.lit(text)]
    return F.concat(*out)


def episode_videos(spark: SparkSession, root: str, template: str | None = None) -> DataFrame:
    """episode, field, path and offset (seconds into the file) of each stream's video, one row an episode and stream.

    The episodes' metadata name the files by template (video_path of the info); of these the ones that exist count.  Where the
    metadata name none, the last number of a file's name is its episode, and of several files the last counts.
    """
    named = None
    try:
        meta = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).option("pathGlobFilter", "*.parquet").parquet(f"{root}/meta/episodes")
    except AnalysisException:  # no metadata
        meta = None
    streams = [(s, f"observation.images.{s}") for s in STREAMS if meta is not None and {f"videos/observation.images.{s}/{c}" for c in ("chunk_index", "file_index")} <= set(meta.columns)]
    if streams and "episode_index" in meta.columns:
        each = []
        for field, key in streams:
            chunk, file = (F.col(f"`videos/{key}/{c}`").cast("long") for c in ("chunk_index", "file_index"))
            start = F.col(f"`videos/{key}/from_timestamp`").cast("double") if f"videos/{key}/from_timestamp" in meta.columns else F.lit(0.0)
            path = filled(template or VIDEO_PATH, {"video_key": F.lit(key), "chunk_index": chunk, "file_index": file})
            each.append(F.struct(F.lit(field).alias("field"), F.when(chunk.isNotNull() & file.isNotNull(), path).alias("path"), F.coalesce(start, F.lit(0.0)).alias("offset")))
        rows = meta.where("episode_index is not null").select(F.col("episode_index").cast("long").alias("episode"), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at"), F.explode(F.array(*each)).alias("x"))
        rows = rows.select("episode", "x.*", "at").join(video_files(spark, root), "path", "left_semi")
        named = rows.groupBy("episode", "field").agg(F.max_by(F.struct("path", "offset"), "at").alias("x")).select("episode", "field", "x.*")
        if not named.isEmpty():
            return named
    files = stream_videos(spark, root).withColumn("episode", last_number(F.regexp_extract("path", r"([^/]+)\.mp4$", 1))).where("episode is not null")
    return files.groupBy("episode", "field").agg(F.max("path").alias("path"), F.lit(0.0).alias("offset"))


def choose_videos(issues: DataFrame, videos: DataFrame) -> DataFrame:
    """issues (episode, field) with video (field, path, offset): that of the issue's own stream, else the first stream that the
    episode has; null for an episode without videos or an issue without an episode.  videos is what episode_videos gives."""
    held = videos.groupBy("episode").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("field", "path", "offset")))).alias("_held"))  # six streams at most
    met = issues.join(held, "episode", "left")
    return met.withColumn("video", F.coalesce(*[F.try_element_at("_held", s) for s in (F.col("field"), *map(F.lit, STREAMS))], F.array_min(F.map_values("_held")))).drop("_held")


REVIEWS = "map<string,struct<episode:long,rule:string,field:string,start_sec:double,end_sec:double,status:string,note:string>>"


def review_status(spark: SparkSession, path: str) -> DataFrame:
    """Reviews by issue id or position: key, status, note.  A missing or broken file has none."""
    return document(spark, path, REVIEWS).select(F.explode("doc").alias("key", "x")).select("key", "x.status", "x.note")


def write_review_status(spark: SparkSession, issues: DataFrame, path: str, status: str) -> None:
    """The reviews of one report's issues (issue_id, episode, rule, field, start_sec, end_sec, review_status, review_note) as one
    JSON object by issue id, which review_status reads back; issues without a review get status and an empty note.  A report
    is capped where it is made, so its reviews are one row."""
    kept = ("episode", "rule", "field", "start_sec", "end_sec")
    review = F.struct(*kept, F.coalesce("review_status", F.lit(status)).alias("status"), F.coalesce("review_note", F.lit("")).alias("note"))
    latest = issues.groupBy("issue_id").agg(F.max(review).alias("review"))
    text = latest.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue_id", "review")))), {"ignoreNullFields": "false"}).alias("value"))
    write_document(spark, text, path)


def latest_reports(spark: SparkSession, folder: str) -> DataFrame:
    """dataset and path of its newest report below folder, by the first line of each report's index.  Other files don't count."""
    try:
        index = spark.read.text(f"{folder}/*/*/index.md", wholetext=True)
    except AnalysisException:  # no report yet
        return spark.createDataFrame([], "dataset string, path string")
    name = F.trim(F.regexp_extract("value", r"\A# Quality report: ([^\n\r]*)", 1))
    rows = index.select(name.alias("dataset"), F.regexp_replace(file_path(F.col("_metadata.file_path")), "/index\\.md$", "").alias("path"), F.col("_metadata.file_modification_time").alias("at"))
    return rows.where("dataset <> ''").groupBy("dataset").agg(F.max_by("path", F.struct("at", "path")).alias("path"))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """file, line_no (from 1) and line of all logs below a folder that mention JPEG; hidden caches are left out."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*{.log,log*.txt,log*.json}").text(folder)
    # a file's lines come in splits, which know where they begin
    df = df.select(file_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    line = Window.partitionBy("file").orderBy("_from", "_id")
    df = df.where(~F.col("file").contains("/.cache/")).withColumn("line_no", F.row_number().over(line).cast("long"))
    return df.where(F.col("line").rlike("(?i)jpe?g")).select("file", "line_no", "line")
