"""A log of snapshots as tables that a stream of snapshots is merged into.

Two tables, both in folders by organisation and day: totals, one row a snapshot that stands, and details, its datasets.  What
else the log says follows from them: changes are differences between days, metadata are those of the newest snapshot.  A merge
rewrites the folders of the days it changes and no others, and gives the same folders however often it is run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from armada.operators.changelog import changes_of, effective
from armada.operators.fleet import HOURS, aggregate_deltas, baseline
from armada.sources.datasets import SNAPSHOT
from armada.sources.scratch import written

TOTALS = "pulled_at string, source string, total_datasets long, total_episodes long, total_frames long, total_hours double, org string, date string"
DETAILS = "dataset string, episodes long, frames long, hours decimal(18,2), fps double, robot_type string, total_tasks long, uploader string, last_modified string, pulled_at string, org string, date string"
META = ("fps", "robot_type", "total_tasks", "uploader", "last_modified")


def table(spark: SparkSession, log: str, name: str) -> DataFrame:
    """One of the two tables, typed; empty where the log has none yet."""
    schema = TOTALS if name == "totals" else DETAILS
    try:
        return spark.read.schema(schema).parquet(f"{log}/{name}")
    except AnalysisException:  # nothing was merged yet
        return spark.createDataFrame([], schema)


def merge(snapshots: DataFrame, log: str) -> None:
    """Merge snapshots (pulled_at, date, org, source, totals and datasets as sources.datasets.SNAPSHOT has them, and seq, what
    orders their arrival) into the log.

    Of an organisation's day one snapshot stands: a real one replaces a manual one, else the newer or, of equals, the later one
    to arrive.  Older ones and replays change nothing.  Snapshots without a day don't count; a missing organisation is one of its
    own.  Each day's totals are written after its details, so a merge that was cut short is made good by running it again.
    """
    spark = snapshots.sparkSession
    come = snapshots.where("date is not null").withColumn("manual", F.coalesce(F.col("source") == "manual", F.lit(False)))
    # the days that come are few and only their folders of the log are read
    days = written(come.select("org", "date").distinct(), "days")
    same = (F.col("o.org").eqNullSafe(F.col("d.org"))) & (F.col("o.date") == F.col("d.date"))
    old = table(spark, log, "totals").alias("o").join(F.broadcast(days.alias("d")), same, "left_semi")
    before = old.select("org", "date", "pulled_at", F.coalesce(F.col("source") == "manual", F.lit(False)).alias("manual"), F.struct(F.lit(0).alias("come"), F.lit(None).cast("string").alias("seq")).alias("seq"))
    arrivals = come.select("org", "date", "pulled_at", "manual", F.struct(F.lit(1).alias("come"), F.col("seq").cast("string").alias("seq")).alias("seq"))
    stand = effective(before.unionByName(arrivals)).where("seq.come = 1").select("org", "date", F.col("seq.seq").alias("seq"))
    won = come.withColumn("seq", F.col("seq").cast("string")).alias("c").join(F.broadcast(stand.alias("s")), F.col("c.org").eqNullSafe(F.col("s.org")) & (F.col("c.date") == F.col("s.date")) & (F.col("c.seq") == F.col("s.seq")), "left_semi")
    won = written(won, "standing")
    each = won.select("pulled_at", "org", "date", F.explode("datasets").alias("x")).where("x.dataset_name <> ''")
    details = each.select(F.col("x.dataset_name").alias("dataset"), F.col("x.total_episodes").alias("episodes"), F.col("x.total_frames").alias("frames"), F.col("x.duration_hours").cast("decimal(18,2)").alias("hours"), *[f"x.{c}" for c in META], "pulled_at", "org", "date")
    for name, rows in (("details", details), ("totals", won)):
        columns = [c.split()[0] for c in (DETAILS if name == "details" else TOTALS).replace("(18,2)", "").split(", ")]
        # a day's rows in one file
        rows.select(*columns).repartition("org", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("org", "date").parquet(f"{log}/{name}")


def manual_snapshot(spark: SparkSession, date: str, org: str, datasets: int, episodes: int, frames: int, hours: float, today: dt.date | None = None) -> DataFrame:
    """A snapshot of totals alone that was entered by hand, for merge: it stands from the end of its day, until a real one of the
    same day comes.  A day that isn't YYMMDD or lies in the future, an empty organisation, and totals that aren't whole (hours:
    any) numbers from 0 are errors."""
    try:
        day = dt.datetime.strptime(date, "%y%m%d").date()
    except (TypeError, ValueError) as e:
        raise ValueError(f"{date!r} is no day in the form YYMMDD") from e
    if day > (today or dt.date.today()):
        raise ValueError(f"{date} is in the future")
    if not isinstance(org, str) or not org.strip():
        raise ValueError("the organisation is empty")
    for name, value in (("datasets", datasets), ("episodes", episodes), ("frames", frames)):
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise ValueError(f"{name} is no whole number from 0: {value!r}")
    if isinstance(hours, bool) or not isinstance(hours, (int, float)) or not hours >= 0:
        raise ValueError(f"hours is no number from 0: {hours!r}")
    at = f"{day:%Y-%m-%d}T23:59:59"
    return spark.createDataFrame([(at, date, org.strip(), datasets, episodes, frames, round(float(hours), 3), "manual", [], "manual")], f"{SNAPSHOT}, seq string")


def totals_of_day(current: DataFrame, snapshots: DataFrame, grown: DataFrame) -> DataFrame:
    """hours, episodes and datasets that came on each current snapshot's day (org, date, source and totals hours, episodes,
    datasets): of a manual one the difference to its baseline among snapshots, datasets not below 0; of a real one the sums of
    grown (org, date, hours, episodes, datasets), what its datasets grew by, 0 without any."""
    manual = F.coalesce(F.col("source") == "manual", F.lit(False))
    base = aggregate_deltas(current.where(manual), snapshots).select("org", "date", F.col("d_hours").alias("hours"), F.col("d_episodes").alias("episodes"))
    sets = baseline(snapshots.select("org", "date", "pulled_at", "ord", "datasets"), current.where(manual).select("org", "date")).select(F.col("org").alias("_org"), F.col("date").alias("_date"), "base_datasets")
    now = current.where(manual).select(F.col("org").alias("_o"), F.col("date").alias("_d"), F.col("datasets").alias("_n"))
    by_hand = base.join(sets, F.col("org").eqNullSafe(F.col("_org")) & (F.col("date") == F.col("_date"))).join(now, F.col("org").eqNullSafe(F.col("_o")) & (F.col("date") == F.col("_d")))
    by_hand = by_hand.select("org", "date", "hours", "episodes", F.greatest(F.lit(0), F.coalesce("_n", F.lit(0)) - F.coalesce("base_datasets", F.lit(0))).cast("long").alias("datasets"))
    summed = grown.groupBy("org", "date").agg(F.sum("hours").cast(HOURS).alias("hours"), F.sum("episodes").alias("episodes"), F.sum("datasets").alias("datasets"))
    real = current.where(~manual).select("org", "date").join(summed, ["org", "date"], "left").select("org", "date", F.coalesce("hours", F.lit(0).cast(HOURS)).cast(HOURS).alias("hours"), F.coalesce("episodes", F.lit(0)).alias("episodes"), F.coalesce("datasets", F.lit(0)).alias("datasets"))
    return by_hand.unionByName(real)


def merge_stream(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """merge for every batch of a stream of snapshots, until all that is there has been read."""
    return stream.writeStream.foreachBatch(lambda batch, _: merge(batch, log)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing_details(spark: SparkSession, log: str) -> DataFrame:
    """Details of the snapshots that stand; those that a snapshot without details, such as a manual one, has replaced are left
    out."""
    totals = table(spark, log, "totals").select(F.col("org").alias("_org"), F.col("date").alias("_date"), F.col("pulled_at").alias("_at"), F.coalesce(F.col("source") == "manual", F.lit(False)).alias("_manual"))
    rows = table(spark, log, "details")
    on = F.col("org").eqNullSafe(F.col("_org")) & (F.col("date") == F.col("_date")) & F.col("pulled_at").eqNullSafe(F.col("_at")) & ~F.col("_manual")
    return rows.join(totals, on, "left_semi")


def changes(spark: SparkSession, log: str) -> DataFrame:
    """dataset, date, episodes, frames, hours and their differences to the day before, of the days on which a total moved.  Of
    a day's snapshots by several organisations the newest counts."""
    each = standing_details(spark, log).groupBy("dataset", "date").agg(F.max_by(F.struct("episodes", "frames", "hours"), F.struct("pulled_at", "org")).alias("x"))
    return changes_of(each.select("dataset", "date", "x.*"))


def metadata(spark: SparkSession, log: str) -> DataFrame:
    """dataset with its metadata by the newest snapshot that lists it."""
    return standing_details(spark, log).groupBy("dataset").agg(F.max_by(F.struct(*META), F.struct("pulled_at", "org")).alias("x")).select("dataset", "x.*")
