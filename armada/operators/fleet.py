"""Fleet analytics over dataset summaries, snapshots and the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armada.functions.exprs import or_dash, or_zero, yymmdd

HOURS = "decimal(18,2)"


def totals(datasets: DataFrame) -> DataFrame:
    return datasets.agg(F.count(F.lit(1)).alias("datasets"), F.sum(or_zero(F.col("episodes"))).alias("episodes"), F.sum(or_zero(F.col("frames"))).alias("frames"), F.sum(F.col("hours")).cast(HOURS).alias("hours"))


def rollup(datasets: DataFrame, key: Column) -> DataFrame:
    """Per group: datasets, episodes, hours and the share of all hours in percent."""
    groups = datasets.groupBy(or_dash(key).alias("group")).agg(F.count(F.lit(1)).alias("datasets"), F.sum("episodes").alias("episodes"), F.sum("hours").cast(HOURS).alias("hours"))
    whole = groups.agg(F.sum("hours").cast("double").alias("whole"))  # one row
    share = F.round(100 * F.col("hours").cast("double") / F.coalesce(F.nullif("whole", F.lit(0.0)), F.lit(1.0)), 4)
    return groups.crossJoin(F.broadcast(whole)).withColumn("pct", share).drop("whole")


def update_day_groups(datasets: DataFrame, key: Column) -> DataFrame:
    return datasets.where("last_modified is not null").groupBy(yymmdd(F.col("last_modified")).alias("date"), or_dash(key).alias("group")).agg(F.sum("hours").cast(HOURS).alias("hours"), F.sum("episodes").alias("episodes"), F.count(F.lit(1)).alias("datasets"))


def on_latest_day(days: DataFrame) -> DataFrame:
    """The rows of the newest date of a day series."""
    last = days.agg(F.max("date").alias("last"))  # one row
    return days.join(F.broadcast(last), F.col("date") == F.col("last")).drop("last")


def in_range(days: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    """Closed range of date strings with optional ends; ends in the wrong order are swapped."""
    if lo and hi and lo > hi:
        lo, hi = hi, lo
    out = days.where(F.col("date") >= lo) if lo else days
    return out.where(F.col("date") <= hi) if hi else out


def range_group_totals(days: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    return in_range(days, lo, hi).groupBy("group").agg(F.sum("hours").cast(HOURS).alias("hours"), F.sum("episodes").alias("episodes"), F.sum("datasets").alias("datasets"))


def latest_per(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the order columns: one partial aggregate, no sort."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def daily_series(snapshots: DataFrame) -> DataFrame:
    """Last snapshot of each org and day with the growth against the day before; the first day grows by its total."""
    days = latest_per(snapshots, ["org", "date"], "pulled_at", "ord")
    line = Window.partitionBy("org").orderBy("date")
    return days.select("org", "date", "episodes", "hours", (F.col("hours") - F.coalesce(F.lag("hours").over(line), F.lit(0).cast(HOURS))).cast(HOURS).alias("new_hours"), (F.col("episodes") - F.coalesce(F.lag("episodes").over(line), F.lit(0))).alias("new_episodes"))


def baseline(snapshots: DataFrame, current: DataFrame) -> DataFrame:
    """For each current snapshot (org, date) the last row of the history with an earlier date of the same org, if any.
    A null org in current matches any, a null org in the history is matched by all."""
    kept = [c for c in ("pulled_at", "date", "episodes", "hours", "datasets") if c in snapshots.columns]
    days = snapshots.groupBy("org", "date").agg(F.max(F.struct("ord", *kept)).alias("_last"))
    none = F.lit(None).cast(days.schema["_last"].dataType)
    asked = current.select("org", "date").distinct()

    def before(history: DataFrame, keys: list[str], name: str) -> DataFrame:
        """The last row of the days before each day: an as-of window over one row a key and day."""
        line = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
        every = history.select(*keys, "date", "_last").unionByName(asked.select(*keys, "date", none.alias("_last"))).groupBy(*keys, "date").agg(F.max("_last").alias("_last"))
        return every.select(*keys, "date", F.max("_last").over(line).alias(name))

    own = before(days.where("org is not null"), ["org"], "_own")
    free, every = before(days.where("org is null"), [], "_free"), before(days, [], "_every")  # one row a day
    out = asked.join(own, ["org", "date"], "left").join(free, "date", "left").join(every, "date", "left")
    base = F.when(F.col("org").isNull(), F.col("_every")).otherwise(F.greatest("_own", "_free"))
    return out.withColumn("_x", base).select("org", "date", *[F.col(f"_x.{c}").alias(f"base_{c}") for c in kept])


def aggregate_deltas(current: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Growth of each current snapshot (org, date, hours, episodes) against its baseline; without one its whole totals."""
    base = baseline(snapshots, current).select(F.col("org").alias("_org"), F.col("date").alias("_date"), "base_hours", "base_episodes")
    out = current.join(base, F.col("org").eqNullSafe(F.col("_org")) & F.col("date").eqNullSafe(F.col("_date")), "left")
    return out.select("org", "date", (or_zero(F.col("hours")) - or_zero(F.col("base_hours"))).cast(HOURS).alias("d_hours"), (or_zero(F.col("episodes")) - or_zero(F.col("base_episodes"))).alias("d_episodes"))


def dataset_deltas(current: DataFrame, previous: DataFrame, has_details: bool = True) -> DataFrame:
    """current (dataset, episodes, frames, hours) against previous: deltas and is_new.  Where an earlier snapshot has totals but no
    details, nothing can be attributed: all deltas are 0 and nothing is new."""
    before = previous.select("dataset", F.col("episodes").alias("_e"), F.col("frames").alias("_f"), F.col("hours").alias("_h"), F.lit(True).alias("_known"))
    out = current.join(before, "dataset", "left")
    zero = F.lit(0)
    delta = lambda c, p: or_zero(F.col(c)) - or_zero(F.col(p)) if has_details else zero
    return out.select("dataset", delta("episodes", "_e").cast("long").alias("d_episodes"), delta("frames", "_f").cast("long").alias("d_frames"), delta("hours", "_h").cast(HOURS).alias("d_hours"), (F.col("_known").isNull() if has_details else F.lit(False)).alias("is_new"))


def deltas_since(changes: DataFrame, cut: str) -> DataFrame:
    """What dataset_deltas gives for a log of running totals (dataset, changed_at, episodes, frames, hours): its state now against the
    one before cut, in one aggregate without a join.  A change without a date counts as new."""
    old = F.col("changed_at") < cut
    totals = ("episodes", "frames", "hours")
    each = changes.groupBy("dataset").agg(*[F.max(c).alias(c) for c in totals], *[F.max(F.when(old, F.col(c))).alias(f"_{c}") for c in totals], F.coalesce(F.bool_or(old), F.lit(False)).alias("_known"))
    return each.select("dataset", (F.col("episodes") - or_zero(F.col("_episodes"))).cast("long").alias("d_episodes"), (F.col("frames") - or_zero(F.col("_frames"))).cast("long").alias("d_frames"), (F.col("hours") - or_zero(F.col("_hours"))).cast(HOURS).alias("d_hours"), (~F.col("_known")).alias("is_new"))


def deltas_with_cache(datasets: DataFrame, deltas: DataFrame, cache: DataFrame) -> DataFrame:
    """Deltas from the matching rows of the change cache (same dataset, same last_modified, same day), else the local ones
    clamped at zero."""
    known = cache.groupBy("dataset", "last_modified", "date").agg(F.sum("episodes").alias("c_episodes"), F.sum("frames").alias("c_frames"), F.sum("hours").cast(HOURS).alias("c_hours"), F.count(F.lit(1)).alias("c_n"))
    rows = datasets.withColumn("date", yymmdd(F.col("last_modified"))).join(known, ["dataset", "last_modified", "date"], "left").join(deltas, "dataset", "left")
    hit = or_zero(F.col("c_n")) > 0
    return rows.select("dataset", "date", "group", F.when(hit, F.col("c_episodes")).otherwise(F.greatest(F.lit(0), or_zero(F.col("d_episodes")))).alias("episodes"), F.when(hit, or_zero(F.col("c_frames"))).otherwise(F.greatest(F.lit(0), or_zero(F.col("d_frames")))).alias("frames"), F.when(hit, F.col("c_hours")).otherwise(F.greatest(F.lit(0).cast(HOURS), or_zero(F.col("d_hours")))).cast(HOURS).alias("hours"), hit.alias("cached"))


def group_growth(rows: DataFrame) -> DataFrame:
    """Positive growth by date and group with the count of datasets that grew, in hours, episodes or, where rows have them,
    frames; what shrank counts as 0."""
    rows = rows.withColumns({"hours": F.greatest(F.lit(0).cast(HOURS), F.col("hours")), "episodes": F.greatest(F.lit(0), F.col("episodes"))})
    grew = (F.col("hours") > 0) | (F.col("episodes") > 0)
    rows = rows.where((grew | (F.col("frames") > 0)) if "frames" in rows.columns else grew)
    grown = rows.groupBy("date", or_dash(F.col("group")).alias("group")).agg(F.sum("hours").cast(HOURS).alias("hours"), F.sum("episodes").alias("episodes"), F.count(F.lit(1)).alias("datasets"))
    return grown.orderBy("date", F.col("hours").desc(), "group")


def daily_group_growth(details: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Growth by day and group from per-day details (date, dataset, group, episodes, hours), each day against the recorded
    day before it; on the first day everything is growth.

    reports (date) names further days that were recorded, without details: the day after one of them is left out, as its growth
    can't be attributed."""
    detailed = details.select("date", F.lit(True).alias("_detailed"))
    days = detailed if reports is None else detailed.unionByName(reports.select("date", F.lit(False).alias("_detailed")))
    line = Window.orderBy("date")
    order = days.where("date is not null").groupBy("date").agg(F.bool_or("_detailed").alias("_detailed"))  # one row a day
    order = order.withColumns({"day": F.row_number().over(line), "_after": F.coalesce(F.lag("_detailed").over(line), F.lit(True))})
    now = details.join(F.broadcast(order.where("_after").select("date", "day")), "date")
    before = details.join(F.broadcast(order.select("date", "day")), "date").select("dataset", (F.col("day") + 1).alias("day"), F.col("episodes").alias("_e"), F.col("hours").alias("_h"))
    grown = now.join(before, ["dataset", "day"], "left")
    grown = grown.withColumns({"episodes": F.greatest(F.lit(0), F.col("episodes") - or_zero(F.col("_e"))), "hours": F.greatest(F.lit(0).cast(HOURS), F.col("hours") - or_zero(F.col("_h")))})
    return group_growth(grown)


def change_groups(changes: DataFrame, key: Column) -> DataFrame:
    """Growth by day and group from commit rows, counting distinct datasets."""
    who = F.coalesce(F.nullif("dataset", F.lit("")), F.col("commit_id").cast("string"))
    return changes.groupBy("date", or_dash(key).alias("group")).agg(F.sum("hours").cast(HOURS).alias("hours"), F.sum("episodes").alias("episodes"), F.countDistinct(who).alias("datasets"))


def as_of(changes: DataFrame, targets: DataFrame) -> DataFrame:
    """State of each target (dataset, at): the last change at or before it, by a union and one ordered window."""
    left = targets.select("dataset", F.col("at").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("episodes"), F.lit(None).cast("string").alias("changed_at"))
    right = changes.select("dataset", F.col("changed_at").alias("t"), F.lit(0).alias("side"), F.col("episodes").cast("long").alias("episodes"), "changed_at")
    line = Window.partitionBy("dataset").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right)
    seen = both.withColumns({"last_episodes": F.last("episodes", ignorenulls=True).over(line), "last_at": F.last("changed_at", ignorenulls=True).over(line)})
    return seen.where("side = 1").select("dataset", F.col("t").alias("at"), F.col("last_episodes").alias("episodes"), F.col("last_at").alias("changed_at"))


def with_metadata(states: DataFrame, metadata: DataFrame) -> DataFrame:
    """States as as_of gives them with the datasets' metadata (dataset and what is known of it now, not then)."""
    return states.join(metadata, "dataset", "left")


def date_bounds(*sources: DataFrame) -> DataFrame:
    """One row, lo and hi: the first and last date of all sources (date); empty dates don't count, without any both are null."""
    every = None
    for s in sources:
        dates = s.select("date").where("date <> ''")
        every = dates if every is None else every.unionByName(dates)
    return every.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))


def trend_axis(series: DataFrame, lo: str = "", hi: str = "") -> DataFrame:
    """One row for a chart of series (date, new_hours, total_hours): lo and hi, the bounds asked for or else those of the dates,
    and dual, whether totals need an axis of their own, being at least four times the new hours where both are above 0."""
    known = lambda asked, found: F.coalesce(F.nullif(F.lit(asked), F.lit("")), found)
    most = lambda c: F.coalesce(F.max(c).cast("double"), F.lit(0.0))
    dated = F.nullif("date", F.lit(""))
    dual = (most("new_hours") > 0) & (most("total_hours") > 0) & (most("total_hours") >= 4 * most("new_hours"))
    return series.agg(known(lo, F.min(dated)).alias("lo"), known(hi, F.max(dated)).alias("hi"), dual.alias("dual"))


def trend_spine(days: DataFrame, lo: str, hi: str) -> DataFrame:
    """Every calendar day from lo to hi (yyyy-MM-dd) with its hours (0 where there are none) and their running sum."""
    spine = days.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(lo)), F.to_date(F.lit(hi)))).alias("day"))
    summed = days.groupBy("day").agg(F.sum("hours").cast(HOURS).alias("hours"))
    filled = spine.join(summed, "day", "left").withColumn("hours", F.coalesce("hours", F.lit(0).cast(HOURS)))
    return filled.withColumn("total", F.sum("hours").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("decimal(28,2)"))


def first_seen_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the ordinal of their first appearance."""
    return rows.groupBy(key).agg(F.min(order).alias("ord"))
