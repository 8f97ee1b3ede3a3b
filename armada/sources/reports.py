"""Quality reports as files: one folder a report, in it one an episode, written by executors and put in place by renaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armada.functions.exprs import file_path, html_escape, issue_id, safe_name
from armada.operators.checks import UNCONFIRMED, actionable
from armada.sources.files import write_files

#: The columns of a report's CSV, in order.
COLUMNS = ("issue_id", "episode", "rule", "severity", "field", "start_sec", "end_sec", "frame", "message", "source", "clips", "plot", "review_status")
RECORD = "struct<issue_id:string,episode:long,rule:string,severity:string,field:string,start_sec:double,end_sec:double,frame:long,message:string,source:string,clips:map<string,string>,plot:string,review_status:string,review_note:string>"
REVIEW = "map<string,struct<status:string,note:string>>"


def text_lines(*lines: Column | str) -> Column:
    """Array of the lines that aren't null."""
    return F.array_compact(F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines]))


def seconds(x: Column) -> Column:
    return F.format_string("%.3f", x)


def csv_field(x: Column) -> Column:
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def records(issues: DataFrame) -> DataFrame:
    """The actionable issues (warn and fail) of issues (dataset, position, episode, rule, severity, field, start_sec, end_sec,
    frame, message, source, clips, plot) with number, their place in the dataset's report by episode (unknown ones last) and
    position, place, that in the episode's, folder, the episode's name, issue_id and review_status."""
    by = [F.col("episode").asc_nulls_last(), "position"]
    rows = actionable(issues)
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("dataset").orderBy(*by)))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("dataset", "episode").orderBy("position")))
    folder = F.when(F.col("episode").isNull(), "ep_unknown").otherwise(F.format_string("ep_%06d", F.col("episode")))
    ident = issue_id(F.col("number"), F.col("episode"), F.col("rule"), F.col("field"), F.col("start_sec"))
    clips = F.coalesce(F.col("clips"), F.create_map().cast("map<string,string>"))
    return rows.withColumns({"folder": folder, "issue_id": ident, "clips": clips, "review_status": F.lit(UNCONFIRMED)})


def issue_text(x: Column) -> Column:
    """An issue's lines in its episode's report."""
    timed = x["start_sec"].isNotNull() & x["end_sec"].isNotNull()
    when = F.when(timed, F.concat(F.lit("- time: "), seconds(x["start_sec"]), F.lit("s-"), seconds(x["end_sec"]), F.lit("s"))).otherwise(F.concat(F.lit("- frame: "), F.coalesce(x["frame"].cast("string"), F.lit("-"))))
    said = lambda name, value: F.concat(F.lit(f"- {name}: "), value)
    head = text_lines(F.concat(F.lit("## "), x["place"].cast("string"), F.lit(". "), x["rule"]), "", said("issue_id", x["issue_id"]), said("severity", x["severity"]), said("field", F.coalesce(x["field"], F.lit("-"))), when, said("detail", x["message"]))
    clips = F.transform(F.array_sort(F.map_values(x["clips"])), lambda c: said("clip", F.element_at(F.split(c, "/"), -1)))
    return F.array_join(F.concat(head, clips, text_lines(said("dof_plot", F.element_at(F.split(x["plot"], "/"), -1)), said("source", x["source"]), "")), "\n")


def counted(all_: Column, name: str) -> Column:
    """Map from a field's values (missing ones: unknown) to how many issues have them."""
    values = F.transform(all_, lambda x: F.coalesce(x[name].cast("string"), F.lit("unknown")))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(v.alias("key"), F.size(F.filter(values, lambda w: w == v)).alias("value"))))


def write_reports(issues: DataFrame, root: str, stamp: str) -> None:
    """The reports of all datasets of issues (see records) below root, each at leaf/stamp, leaf being the last part of the
    dataset's name: index.md, issues.json, overview.json, issues.csv, summary.html and review_status.json, and for each episode
    a folder with report.md and issues.json.

    A dataset without actionable issues has a report that says so.  A report is one file of each kind, so a dataset's issues are
    gathered: they are capped where they are found.  Datasets are reported independently of each other, by as many tasks.
    """
    own = F.struct("number", "place", "folder", *COLUMNS)
    rows = records(issues)
    stored = F.struct(*COLUMNS)
    ahead = lambda x, y: x["number"] - y["number"]
    each = rows.groupBy("dataset", "folder").agg(F.array_sort(F.collect_list(own), ahead).alias("all"), F.array_sort(F.collect_list(F.struct("number", stored.alias("r"))), ahead).alias("stored"))
    leaf = F.concat(safe_name(F.element_at(F.split("dataset", "/"), -1)), F.lit(f"/{stamp}/"))
    as_json = lambda x: F.concat(F.to_json(x, {"ignoreNullFields": "false", "pretty": "true"}), F.lit("\n"))
    stored_of = F.transform("stored", lambda x: x["r"])
    title = F.concat(F.lit("# "), "dataset", F.lit(" / "), "folder", F.lit("\n"))
    report = F.concat(title, F.lit("\n"), F.array_join(F.transform("all", issue_text), "\n"), F.lit("\n"))
    in_episode = each.select(F.explode(F.array(F.struct(F.concat(leaf, "folder", F.lit("/report.md")).alias("path"), report.alias("text")), F.struct(F.concat(leaf, "folder", F.lit("/issues.json")).alias("path"), as_json(stored_of).alias("text")))).alias("f")).select("f.*")

    listed = rows.groupBy("dataset").agg(F.array_sort(F.collect_list(own), ahead).alias("all"), F.array_sort(F.collect_list(F.struct("number", stored.alias("r"))), ahead).alias("stored"))
    none = F.array().cast(listed.schema["all"].dataType), F.array().cast(listed.schema["stored"].dataType)
    whole = issues.select("dataset").distinct().join(listed, "dataset", "left").withColumns({"all": F.coalesce("all", none[0]), "stored": F.coalesce("stored", none[1])})
    folders = F.array_sort(F.array_distinct(F.transform("all", lambda x: F.struct(x["episode"].isNull().alias("last"), x["folder"].alias("folder")))))
    of = lambda f: F.size(F.filter("all", lambda x: x["folder"] == f)).cast("string")
    links = F.transform(folders, lambda f: F.concat(F.lit("- ["), f["folder"], F.lit("]("), f["folder"], F.lit("/report.md): "), of(f["folder"]), F.lit(" issues")))
    total = F.size("all").cast("string")
    index = F.concat(F.array_join(F.concat(text_lines(F.concat(F.lit("# Quality report: "), "dataset"), "", f"- generated_at: {stamp}", F.concat(F.lit("- total_issues: "), total), ""), F.when(F.size("all") == 0, F.array(F.lit("No actionable issues found."))).otherwise(links)), "\n"), F.lit("\n"))
    overview = F.struct(F.size("all").alias("total_issues"), F.size(folders).alias("episode_count"), counted(F.col("all"), "rule").alias("by_rule"), counted(F.col("all"), "field").alias("by_field"), counted(F.col("all"), "episode").alias("by_episode"), F.size(F.filter("all", lambda x: x["review_status"] == UNCONFIRMED)).alias("unconfirmed"))
    line = lambda x: F.concat_ws(",", *[csv_field(F.to_json(x[c]) if c == "clips" else x[c]) for c in COLUMNS])
    csv = F.concat(F.lit("﻿"), F.array_join(F.concat(F.array(F.lit(",".join(COLUMNS))), F.transform("all", line)), "\r\n"), F.lit("\r\n"))
    cell = lambda x: F.concat(F.lit("<td>"), html_escape(F.coalesce(x.cast("string"), F.lit("-"))), F.lit("</td>"))
    cells = lambda x: F.concat(F.lit("<tr>"), *[cell(x[c]) for c in ("number", "episode", "rule", "severity", "field", "start_sec", "end_sec", "message", "review_status")], F.lit("</tr>"))
    page = F.concat(F.lit('<!doctype html>\n<meta charset="utf-8">\n<h1>'), html_escape(F.col("dataset")), F.lit("</h1>\n<p>"), total, F.lit(' issues</p>\n<p><a href="index.md">index</a> <a href="issues.csv">CSV</a> <a href="issues.json">JSON</a></p>\n<table>\n<tr><th>#</th><th>episode</th><th>rule</th><th>severity</th><th>field</th><th>start</th><th>end</th><th>detail</th><th>review</th></tr>\n'), F.array_join(F.transform("all", cells), "\n"), F.lit("\n</table>\n"))
    review = F.map_from_entries(F.transform("all", lambda x: F.struct(x["issue_id"].alias("key"), F.struct(x["episode"], x["rule"], x["field"], x["start_sec"], x["end_sec"], x["review_status"].alias("status"), F.lit("").alias("note")).alias("value"))))
    texts = {"index.md": index, "issues.json": as_json(stored_of), "overview.json": as_json(overview), "issues.csv": csv, "summary.html": page, "review_status.json": as_json(review)}
    at_top = whole.select(F.explode(F.array(*[F.struct(F.concat(leaf, F.lit(name)).alias("path"), text.alias("text")) for name, text in texts.items()])).alias("f")).select("f.*")
    write_files(in_episode.unionByName(at_top), root)


def report_records(spark: SparkSession, folder: str) -> DataFrame:
    """The issues of all reports below folder, with report (its path) and position (from 1): the fields of RECORD, with the
    review status and note stored under their id, else under their position, else their own.  Broken files have none."""
    try:
        text = spark.read.text(f"{folder}/*/*/issues.json", wholetext=True)
    except AnalysisException:  # no report yet
        return spark.createDataFrame([], "report string, position int").select("*", F.from_json(F.lit("{}"), RECORD).alias("x")).select("report", "position", "x.*")
    report = lambda: F.regexp_replace(file_path(F.col("_metadata.file_path")), "/[^/]*$", "")
    rows = text.select(report().alias("report"), F.posexplode(F.from_json("value", f"array<{RECORD}>")).alias("place", "x")).select("report", (F.col("place") + 1).alias("position"), "x.*")
    try:
        found = spark.read.text(f"{folder}/*/*/review_status.json", wholetext=True).select(report().alias("report"), F.explode(F.from_json("value", REVIEW)).alias("key", "s"))
    except AnalysisException:
        return rows
    by_id, by_place = (found.select("report", F.col("key").alias(k), F.col("s").alias(s)) for k, s in (("issue_id", "_a"), ("_place", "_b")))
    met = rows.withColumn("_place", F.col("position").cast("string")).join(by_id, ["report", "issue_id"], "left").join(by_place, ["report", "_place"], "left")
    said = lambda name, own: F.coalesce(F.col(f"_a.{name}"), F.col(f"_b.{name}"), own)
    return met.withColumns({"review_status": said("status", F.coalesce("review_status", F.lit(UNCONFIRMED))), "review_note": said("note", F.coalesce("review_note", F.lit("")))}).select(rows.columns)


def reconciled_status(stored: DataFrame, reports: DataFrame) -> DataFrame:
    """dataset, status, report_dir, checked_at: the stored state (these columns) made good from the reports that exist (dataset,
    path), each of which makes its dataset a checked one.  A stored row stays only if it is of a checked dataset whose report
    exists; its time is kept.  Repeated rows of a dataset count once, the one checked last; repeated reports, the greatest path."""
    last = stored.groupBy("dataset").agg(F.max_by(F.struct("status", "report_dir", "checked_at"), F.struct("checked_at", "report_dir")).alias("old"))
    newest = reports.groupBy("dataset").agg(F.max("path").alias("new"))
    known = reports.select(F.col("path").alias("_path")).distinct()
    both = last.join(newest, "dataset", "full_outer").join(known, F.col("old.report_dir") == F.col("_path"), "left")
    kept = F.col("new").isNotNull() | ((F.col("old.status") == CHECKED) & F.col("_path").isNotNull())
    return both.where(kept).select("dataset", F.lit(CHECKED).alias("status"), F.coalesce("new", "old.report_dir").alias("report_dir"), F.col("old.checked_at").alias("checked_at"))


#: Fixed value: the status of a dataset that has been checked.
CHECKED = "已检查"
