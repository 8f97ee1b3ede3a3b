"""Scalar and array expressions over Columns; all stay in the JVM."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six camera streams, of which the last four are tactile.
STREAMS = ("left_wrist", "right_wrist", "left_tactile_left", "left_tactile_right", "right_tactile_left", "right_tactile_right")


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def or_dash(x: Column) -> Column:
    """Null and empty group keys become a dash."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("—"))


def duration_hours(frames: Column, fps: Column) -> Column:
    """Hours of a dataset to 3 places; a missing or zero frame rate counts as 30, missing frames give null."""
    rate = F.coalesce(F.nullif(fps, F.lit(0)), F.lit(30))
    return F.when(frames.isNotNull(), F.bround(frames / rate / 3600, 3))


def average_seconds(hours: Column, episodes: Column) -> Column:
    return F.try_divide(hours * 3600, F.nullif(episodes, F.lit(0)))


def task_prefix(name: Column) -> Column:
    """The leaf of a dataset name without a trailing -dddd."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"^(.*)-\d{4}$", "$1")


def yymmdd(iso: Column) -> Column:
    """The literal local date of an ISO timestamp string; the offset is not applied."""
    return F.concat(F.substring(iso, 3, 2), F.substring(iso, 6, 2), F.substring(iso, 9, 2))


def last_number(name: Column) -> Column:
    """The last run of digits as a number, or null."""
    return F.try_element_at(F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("bigint")


def safe_name(text: Column) -> Column:
    clean = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def finite(vector: Column) -> Column:
    """A vector without its null, NaN and infinite components (the others move up); null if none is left."""
    kept = F.filter(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.size(kept) > 0, kept)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance over the common prefix of two vectors; null if either is null or empty."""
    n = F.least(F.size(a), F.size(b))
    squares = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y))
    return F.when(n > 0, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def file_path(uri: Column) -> Column:
    """The path of a file that Spark gives as a URI (as _metadata.file_path does), as it is written: not encoded, and with one
    slash after a local scheme."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def first_number(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches, as a number."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("double") for p in patterns])


def infer_stream(text: Column) -> Column:
    """The first of the streams that a text names, or null."""
    found = F.lit(None).cast("string")
    for name in reversed(STREAMS):
        found = F.when(F.contains(text, F.lit(name)), name).otherwise(found)
    return found


def issue_id(number: Column, episode: Column, rule: Column, field: Column, start: Column) -> Column:
    """Number, episode, rule, field and start of an issue as one name: NNNN_EEEEEE_rule_field_s.sss, with words for what is
    missing."""
    text = lambda pattern, x, without: F.when(x.isNull(), without).otherwise(F.format_string(pattern, x))
    named = safe_name(F.coalesce(F.nullif(field, F.lit("")), F.lit("all")))
    return F.concat_ws("_", F.format_string("%04d", number), text("%06d", episode, "unknown"), safe_name(F.coalesce(rule, F.lit(""))), named, text("%.3f", start, "frame"))


def floor_round(x: Column, digits: int) -> Column:
    """Round half up by flooring."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def url_base64(text: Column) -> Column:
    """URL-safe base64 without padding."""
    plain = F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("\r\n"), F.lit(""))
    return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def replaced_text(text: Column, replacements: dict[str, str]) -> Column:
    """text, or what replaces it if it is one of the replacements' keys; empty replacements don't count."""
    pairs = [(F.lit(k), F.lit(v)) for k, v in replacements.items() if v and v != k]
    return F.coalesce(F.try_element_at(F.create_map(*itertools.chain(*pairs)), text), text) if pairs else text


def compact_number(x: Column) -> Column:
    """Number with thousands separators, without decimals where there are none."""
    return F.when(x == F.floor(x), F.format_number(x, 0)).otherwise(F.format_number(x, 2))


def index_list(text: Column) -> Column:
    """Array of the whole numbers of a list such as 0-3,7; a full-width comma counts as a comma."""
    parts = F.filter(F.transform(F.split(F.translate(text, "，", ","), ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = F.transform(parts, lambda p: F.transform(F.split(p, "-"), lambda e: e.try_cast("int")))
    return F.flatten(F.transform(ends, lambda e: F.sequence(F.element_at(e, 1), F.element_at(e, -1))))


def clip_window(start: Column, end: Column, lead: float, longest: float) -> tuple[Column, Column]:
    """A clip around an issue: lead seconds before it, shortened from the front to at most longest seconds."""
    begin = F.greatest(F.lit(0.0), start - lead)
    return F.greatest(begin, F.least(start, end - longest)), F.least(end, F.greatest(begin, F.least(start, end - longest)) + longest)


def issue_window(frame: Column, fps: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """An issue's window to 3 places: its own, or where it has no start one second around its frame."""
    centre = frame / F.nullif(fps, F.lit(0))
    around = start.isNull() & centre.isNotNull()
    return F.bround(F.when(around, F.greatest(F.lit(0.0), centre - 1.0)).otherwise(start), 3), F.bround(F.when(around, centre + 1.0).otherwise(end), 3)


def flat_vector(value: Column, depth: int = 0) -> Column:
    """A scalar (depth 0), vector (1) or nested vector (2 and more) as one array of doubles: nulls inside count as NaN, an empty
    or null value is null."""
    out = F.array(value) if depth == 0 else value
    for _ in range(depth - 1):
        out = F.flatten(F.transform(out, lambda x: F.coalesce(x, F.array(F.lit(None)))))
    out = F.transform(out, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))
    return F.when(value.isNotNull() & (F.size(out) > 0), out)


def component_ordinals(names: list[str], hands: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> dict[str, list[int]]:
    """Where each hand's axes stand in a feature's vector, from the names of its components; a missing one is an error."""
    at = {name: i for i, name in enumerate(names)}
    wanted = {hand: [f"{hand}_tcp.{axis}" for axis in axes] for hand in hands}
    if missing := [name for parts in wanted.values() for name in parts if name not in at]:
        raise ValueError(f"the feature lacks {missing}")
    return {hand: [at[name] for name in parts] for hand, parts in wanted.items()}


def leaf_name(name: str | None) -> str:
    """A dataset's folder name without white space around it; separators, other characters and nothing at all are errors."""
    clean = (name or "").strip()
    if not re.fullmatch("[A-Za-z0-9._-]+", clean):
        raise ValueError(f"{clean!r} is no folder name of letters, digits, dots, underscores and hyphens")
    return clean


def split_parts(text: str) -> dict[str, float] | dict[str, list[int]]:
    """Parts of a split: all by share (train:0.8,val:0.2) or all by ranges of episodes (train:0-4,val:5-6); a full-width comma
    counts as a comma."""
    parts: dict = {}
    for chunk in filter(None, map(str.strip, text.replace("，", ",").split(","))):
        name, colon, value = (x.strip() for x in chunk.partition(":"))
        if not colon:
            raise ValueError(f"{chunk!r} is not name:value")
        span = re.fullmatch(r"(\d+)\s*-\s*(\d+)", value)
        parts[name] = list(range(int(span[1]), int(span[2]) + 1)) if span else float(value)
    if len({type(v) for v in parts.values()}) > 1:
        raise ValueError("shares and ranges can't be mixed")
    return parts


def completion(done: Column, target: Column) -> Column:
    """Share of a target in percent to one place; null without a positive target."""
    return F.when(target > 0, F.round(100 * done / target, 1))


def atom_text(content: Column, calls: Column) -> Column:
    """What an annotation atom says: its content, else the names of the functions it calls, else a mark for nothing.  calls is
    a JSON list of objects with function.name."""
    names = F.filter(F.transform(F.from_json(calls, "array<struct<function:struct<name:string>>>"), lambda c: c["function"]["name"]), lambda n: n.isNotNull() & (n != ""))
    return F.when(F.coalesce(content, F.lit("")) != "", content).when(F.size(names) > 0, F.concat(F.lit("· "), F.array_join(names, ", "))).otherwise("(空)")


#: The styles of annotation atoms in their order, with their labels; the label of a missing style comes last.
STYLES = {"task_aug": "任务改写", "subtask": "子任务", "plan": "计划", "memory": "记忆", "interjection": "插话", "vqa": "视觉问答"}
NO_STYLE = "语音"


def style_label(style: Column) -> Column:
    """Label of a style; an unknown style is its own label, a missing or empty one is speech."""
    labels = F.create_map(*[F.lit(x) for pair in STYLES.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, style), F.nullif(style, F.lit("")), F.lit(NO_STYLE))


def style_place(style: Column) -> Column:
    """Place of a style among the groups: the known ones in their order, speech, then unknown ones."""
    found = F.array_position(F.array(*[F.lit(s) for s in STYLES]), style)
    return F.when(style.isNull(), len(STYLES) + 1).when(found > 0, found).otherwise(len(STYLES) + 2).cast("int")


def is_event_style(style: Column) -> Column:
    """Whether atoms of a style belong to a moment."""
    return style.isNull() | style.isin("interjection", "vqa")


def to_day(yymmdd_: Column) -> Column:
    """The date of six digits (years from 69 are of the last century), or null."""
    century = F.when(F.substring(yymmdd_, 1, 2) >= "69", "19").otherwise("20")
    iso = F.concat(century, F.substring(yymmdd_, 1, 2), F.lit("-"), F.substring(yymmdd_, 3, 2), F.lit("-"), F.substring(yymmdd_, 5, 2))
    return F.when(yymmdd_.rlike("^[0-9]{6}$"), iso).try_cast("date")


def day_text(yymmdd_: Column) -> Column:
    """yyyy-mm-dd; what is no date stays as it is, nothing becomes a dash."""
    return F.coalesce(F.date_format(to_day(yymmdd_), "yyyy-MM-dd"), or_dash(yymmdd_))


def day_weekday(yymmdd_: Column) -> Column:
    """mm-dd and on a second line the weekday; what is no date stays as it is, nothing becomes a dash."""
    day = to_day(yymmdd_)
    return F.coalesce(F.concat(F.date_format(day, "MM-dd"), F.lit("\n周"), F.substring(F.lit("一二三四五六日"), F.weekday(day) + 1, F.lit(1))), or_dash(yymmdd_))


def days_between(first: Column, last: Column) -> Column:
    """Whole days from one six-digit date to another; null where either is no date."""
    return F.datediff(to_day(last), to_day(first))


def clip_camera(path: Column, field: Column) -> Column:
    """Camera in the name of an issue's clip: the stream its path names, else its field made safe, else clip."""
    return F.coalesce(infer_stream(path), safe_name(F.coalesce(F.nullif(field, F.lit("")), F.lit("clip"))))


def mad_thresholds(rows: DataFrame, value: str, by: list[str], k: float, floor: float, least: int = 1) -> DataFrame:
    """by, n, med, mad, threshold: median plus k times the median absolute deviation of value, at least floor.

    Without spread it is three medians; groups of under least values give no row.  Null values don't count.
    """
    known = rows.where(F.col(value).isNotNull())
    centre = known.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("med"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    off = (known.join(centre, by) if by else known.crossJoin(F.broadcast(centre))).withColumn("off", F.abs(F.col(value) - F.col("med")))
    out = off.groupBy(*by).agg(F.max("n").alias("n"), F.max("med").alias("med"), F.percentile("off", F.lit(0.5)).alias("mad"))
    spread = F.when(F.coalesce(F.col("mad"), F.lit(0.0)) == 0, 3 * F.col("med")).otherwise(F.col("med") + k * F.col("mad"))
    return out.withColumn("threshold", F.greatest(F.lit(float(floor)), spread))
