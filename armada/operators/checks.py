"""Rule checks over dataset names, durations and prompts, and summaries of issues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armada.functions.exprs import first_number, infer_stream, is_event_style, style_label, style_place

#: Fixed value: the status of an issue that nobody has reviewed.
UNCONFIRMED = "未确认"

#: id -> (title, provider, expression); an expression gives a struct of status and message.
REGISTRY: dict[str, tuple[str, str, Callable[[dict], Column]]] = {}


def register(id_: str, title: str, provider: str):
    def add(make: Callable[[dict], Column]):
        REGISTRY[id_] = (title, provider, make)
        return make

    return add


def verdict(status: Column, message: Column) -> Column:
    return F.struct(status.alias("status"), message.alias("message"))


@register("name", "Name format", "metadata")
def check_name(cfg: dict) -> Column:
    """owner/prefix, verb and nouns joined by hyphens, and four digits; a fleet's own owner and prefix are settings."""
    name, fine = F.col("name"), F.col("name").rlike(cfg.get("name_pattern", r"^[A-Za-z0-9._-]+/[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*-[0-9]{4}$"))
    empty = name.isNull() | (name == "")
    return verdict(F.when(empty, "skip").when(fine, "ok").otherwise("fail"), F.when(empty, "no name").when(fine, "").otherwise("name does not match"))


@register("duration", "Average duration", "metadata")
def check_duration(cfg: dict) -> Column:
    x, lo, hi = F.col("avg_seconds"), cfg.get("min_seconds", 20.0), cfg.get("max_seconds", 600.0)
    return verdict(F.when(x.isNull(), "skip").when(x.between(lo, hi), "ok").otherwise("fail"), F.when(x.isNull(), "no episodes").when(x < lo, "too short").when(x > hi, "too long").otherwise(""))


#: The characters that a prompt must not hold.
ILLEGAL = "_-，。、；：？！（）“”‘’《》—·"


def prompt_findings(text: Column, least: int = 10, most: int = 50, illegal: str = ILLEGAL) -> Column:
    """Findings over one prompt: array of (severity, message)."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    bad = F.array(*[F.lit(c) for c in illegal])
    rules = [
        (words < least, "warn", "too few words"),
        (words > most, "warn", "too many words"),
        (F.exists(bad, lambda c: F.contains(text, c)), "fail", "illegal characters"),
        (~text.rlike(r"(?U)^\s*\p{L}") | (words < 3), "warn", "not a sentence"),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for rule, s, m in rules]))


def worst(statuses: Column) -> Column:
    return F.when(F.array_contains(statuses, "fail"), "fail").when(F.array_contains(statuses, "warn"), "warn").otherwise("ok")


@register("prompt", "Prompt", "metadata")
def check_prompt(cfg: dict) -> Column:
    found = prompt_findings(F.coalesce("prompt", F.lit("")))
    empty = F.col("prompt").isNull()
    return verdict(F.when(empty, "skip").otherwise(worst(F.transform(found, lambda x: x["severity"]))), F.when(empty, "no prompt").otherwise(F.array_join(F.transform(found, lambda x: x["message"]), "; ")))


def check_tasks(tasks: Column) -> Column:
    """The prompt check of a dataset over all its tasks, an array of (index, task): struct of status, message and details, one
    line a finding with the task's index.  A null task counts as empty; no tasks at all: skipped."""
    lines = F.flatten(F.transform(tasks, lambda t: F.transform(prompt_findings(F.coalesce(t["task"], F.lit(""))), lambda x: F.struct(x["severity"].alias("severity"), F.concat(F.lit("["), F.coalesce(t["index"].cast("string"), F.lit("?")), F.lit("] "), x["message"]).alias("line")))))
    none = tasks.isNull() | (F.size(tasks) == 0)
    status = F.when(none, "skip").otherwise(worst(F.transform(lines, lambda x: x["severity"])))
    message = F.when(none, "no prompt").when(F.size(lines) == 0, "").otherwise(F.concat(F.size(lines).cast("string"), F.lit(" to improve")))
    return F.struct(status.alias("status"), message.alias("message"), F.when(none, F.array().cast("array<string>")).otherwise(F.transform(lines, lambda x: x["line"])).alias("details"))


@register("local_quality", "Episodes", "local_quality")
def check_local_quality(cfg: dict) -> Column:
    """Verdict over a dataset's issues, an array of (severity, message, episode, start_sec, end_sec, frame, field): actionable
    ones decide; with only skipped ones the first says why; none is fine."""
    issues = F.col("issues")
    live = F.filter(issues, lambda x: x["severity"].isin("warn", "fail"))
    skipped = F.filter(issues, lambda x: x["severity"] == "skip")
    status = F.when(F.size(live) > 0, worst(F.transform(live, lambda x: x["severity"]))).when(F.size(skipped) > 0, "skip").otherwise("ok")
    message = F.when(F.size(live) > 0, F.concat(F.size(live).cast("string"), F.lit(" episode issues"))).when(F.size(skipped) > 0, F.get(skipped, 0)["message"]).otherwise("")
    return verdict(status, message)


def issue_line(x: Column) -> Column:
    """One line for an issue: episode, window (else frame) and field that are known, then its message."""
    window = F.format_string("%.3fs-%.3fs", x["start_sec"], x["end_sec"])
    place = F.when(x["start_sec"].isNotNull() & x["end_sec"].isNotNull(), window).otherwise(F.concat(F.lit("frame "), x["frame"].cast("string")))
    head = F.concat_ws(" / ", F.concat(F.lit("episode "), x["episode"].cast("string")), place, x["field"])
    return F.when(head == "", x["message"]).otherwise(F.concat(head, F.lit(": "), x["message"]))


def integrity_issues(info: DataFrame) -> DataFrame:
    """Rows of info (total_episodes, total_frames, fps, has_stats) with integrity: what the metadata lack, as an array."""
    lacks = [(F.coalesce(F.col(c), F.lit(0)) == 0, f"info lacks {c}") for c in ("total_episodes", "total_frames", "fps")] + [(~F.coalesce("has_stats", F.lit(False)), "no statistics")]
    return info.withColumn("integrity", F.array_compact(F.array(*[F.when(rule, F.lit(m)) for rule, m in lacks])))


def run_checks(rows: DataFrame, key: str, providers: tuple[str, ...] = ("metadata",), cfg: dict | None = None) -> DataFrame:
    """Long form of all checks of the providers: key, id, status, message.  One pass; a check that a row's data can't answer
    is skipped by its own expression, and one that fails as such, by its settings or for want of a column, is skipped for all
    rows with what is wrong."""
    chosen = []
    for i, (_, provider, make) in REGISTRY.items():
        if provider not in providers:
            continue
        try:
            found = make(cfg or {})
            rows.select(found["status"], found["message"])  # only analysed
        except Exception as e:  # whatever a check does wrong, the others go on
            found = verdict(F.lit("skip"), F.lit(str(e).split("\n")[0]))
        chosen.append((i, found))
    every = F.array(*[F.struct(F.lit(i).alias("id"), x["status"].alias("status"), x["message"].alias("message")) for i, x in chosen])
    return rows.select(key, F.explode(every).alias("x")).select(key, "x.*")


def aggregate_checks(results: DataFrame, key: str) -> DataFrame:
    """Per key: n_fail, n_warn, worst and the sort key of a badge."""
    out = results.groupBy(key).agg(F.count_if(F.col("status") == "fail").alias("n_fail"), F.count_if(F.col("status") == "warn").alias("n_warn"))
    return out.withColumns({"worst": F.when(F.col("n_fail") > 0, "fail").when(F.col("n_warn") > 0, "warn").otherwise("ok"), "sort_key": F.when(F.col("n_fail") > 0, 200 + F.col("n_fail")).when(F.col("n_warn") > 0, 100 + F.col("n_warn")).otherwise(F.lit(0).cast("long"))})


def issue_summary(issues: DataFrame) -> DataFrame:
    """Counts of issues by rule, by field and by episode in one pass: kind, value, n.  Rules and fields come by falling count,
    episodes by their text, unknown ones last."""
    rows = issues.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias("value")) for k in ("rule", "field", "episode")])).alias("x"))
    counted = rows.groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))
    by_text = F.col("kind") == "episode"
    return counted.orderBy("kind", F.when(by_text, 0).otherwise(-F.col("n")), by_text & (F.col("value") == "unknown"), "value")


def issue_totals(issues: DataFrame) -> DataFrame:
    """One row over issues with review_status: total_issues, episode_count (issues without an episode share one) and
    unconfirmed (a missing status is unconfirmed).  No issues give zeros."""
    episode = F.coalesce(F.col("episode").cast("string"), F.lit("unknown"))
    return issues.agg(F.count(F.lit(1)).alias("total_issues"), F.countDistinct(episode).alias("episode_count"), F.count_if(F.coalesce("review_status", F.lit(UNCONFIRMED)) == UNCONFIRMED).alias("unconfirmed"))


def review_overlay(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """Issues with the review status stored under their id, else under their position, else the unconfirmed status."""
    by_id = reviews.select(F.col("key").alias("issue_id"), F.col("status").alias("_s1"))
    by_pos = reviews.select(F.col("key").alias("_pos"), F.col("status").alias("_s2"))
    out = issues.withColumn("_pos", F.col("position").cast("string")).join(by_id, "issue_id", "left").join(by_pos, "_pos", "left")
    return out.withColumn("review_status", F.coalesce("_s1", "_s2", F.lit(UNCONFIRMED))).drop("_pos", "_s1", "_s2")


#: How a log names an episode, a frame and a time; the first pattern that matches counts.
LOG_PATTERNS = {
    "episode": (r"\bepisode[_\s:=#-]*(\d+)", r"\bep[_\s:=#-]*(\d+)"),
    "frame": (r"\bframe[_\s:=#-]*(\d+)", r"\bframe_index[_\s:=#-]*(\d+)"),
    "time": (r"\btime(?:stamp)?[_\s:=#-]*([0-9]+(?:\.[0-9]+)?)", r"\bt[_\s:=#-]*([0-9]+(?:\.[0-9]+)?)"),
}


def log_issues(lines: DataFrame, fps: float, margin: float = 1.0) -> DataFrame:
    """Issues of log lines (file, line_no, line) that mention JPEG: episode, frame, field, start_sec, end_sec, message and file,
    the first line of each episode, field and file name.

    Path and line together name episode, frame, time and stream, whatever their case.  Without a time, the frame's counts; the
    window reaches margin seconds to both sides, but not before 0.  Files of the same name in several folders are one, in the
    order of their paths."""
    text = F.concat_ws(" ", "file", "line")
    number = {k: first_number(text, [f"(?i){p}" for p in patterns]) for k, patterns in LOG_PATTERNS.items()}
    rows = lines.select("file", "line_no", "line", number["episode"].cast("long").alias("episode"), number["frame"].cast("long").alias("frame"), number["time"].alias("_time"), infer_stream(text).alias("field"), F.element_at(F.split("file", "/"), -1).alias("_name"))
    first = rows.groupBy("episode", "field", "_name").agg(F.min_by(F.struct("file", "line_no", "line", "frame", "_time"), F.struct("file", "line_no")).alias("x")).select("episode", "field", "_name", "x.*")
    at = F.coalesce("_time", F.col("frame") / fps)
    said = F.concat(F.lit("JPEG error in the log: "), "_name", F.lit(":"), F.col("line_no").cast("string"), F.lit(" "), F.left(F.trim("line"), F.lit(180)))
    return first.select("episode", "frame", "field", F.when(at.isNotNull(), F.greatest(F.lit(0.0), at - margin)).alias("start_sec"), (at + margin).alias("end_sec"), said.alias("message"), "file")


def actionable(issues: DataFrame) -> DataFrame:
    """Issues that someone has to look at: warnings and failures."""
    return issues.where(F.col("severity").isin("warn", "fail"))


def text_filter(rows: DataFrame, columns: list[str], query: str, issues: str | None = None) -> DataFrame:
    """Rows whose columns together contain the query, whatever its case; with issues, a column that counts them, only rows that
    have any."""
    out = rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))
    return out if issues is None else out.where(F.col(issues) > 0)


def edit_filter(rows: DataFrame, columns: list[str], query: str, downloaded: DataFrame | None = None, key: str = "dataset") -> DataFrame:
    """Rows that the text filter keeps and, where downloaded (a column leaf) is given, whose name ends in a downloaded leaf."""
    out = text_filter(rows, columns, query)
    if downloaded is None:
        return out
    leaf = F.element_at(F.split(F.col(key), "/"), -1)
    return out.withColumn("_leaf", leaf).join(downloaded.select(F.col("leaf").alias("_leaf")), "_leaf", "left_semi").drop("_leaf")


def style_groups(atoms: DataFrame) -> DataFrame:
    """style, label, place, event, atoms and episodes: annotation atoms (episode, style) by style, in the order of the styles,
    speech (atoms without one) after the known and before unknown ones, these by name."""
    counted = atoms.groupBy("style").agg(F.count(F.lit(1)).alias("atoms"), F.countDistinct("episode").alias("episodes"))
    return counted.select("style", style_label(F.col("style")).alias("label"), style_place(F.col("style")).alias("place"), is_event_style(F.col("style")).alias("event"), "atoms", "episodes").orderBy("place", "style")
