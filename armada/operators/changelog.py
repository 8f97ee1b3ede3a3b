"""The change log of dataset snapshots: folding, compaction, history union, incremental refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armada.operators.fleet import HOURS, latest_per


def effective(arrivals: DataFrame) -> DataFrame:
    """Snapshots (org, date, pulled_at, seq, manual, ...) that stand after all arrivals.

    Of each org and day the rows after the last switch between manual and real count; of those the newest pulled_at, and
    among equals the last arrival.
    """
    line = Window.partitionBy("org", "date").orderBy("seq")
    rest = line.rowsBetween(1, Window.unboundedFollowing)
    switched = F.max(F.when(F.col("_switch"), 1).otherwise(0)).over(rest)
    rows = arrivals.withColumn("_switch", F.coalesce(F.col("manual") != F.lag("manual").over(line), F.lit(False)))
    kept = rows.where(F.lit(True)).withColumn("_later", F.coalesce(switched, F.lit(0))).where("_later = 0").drop("_switch", "_later")
    return latest_per(kept, ["org", "date"], "pulled_at", "seq")


def with_deltas(details: DataFrame, stays: Column | None = None) -> DataFrame:
    """details (dataset, date, episodes, frames, hours) with the difference of each total to the day before; a missing total
    counts as 0.  Rows for which stays, a condition over the same window, fails are left out after that."""
    line = Window.partitionBy("dataset").orderBy("date")
    kinds = {"episodes": "bigint", "frames": "bigint", "hours": HOURS}
    own = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind)
    deltas = [(own(c, kind) - F.coalesce(F.lag(own(c, kind)).over(line), F.lit(0).cast(kind))).cast(kind).alias(f"d_{c}") for c, kind in kinds.items()]
    return details.select("dataset", "date", *kinds, *deltas, (F.lit(True) if stays is None else stays).alias("_stays")).where("_stays").drop("_stays")


def changes_of(details: DataFrame) -> DataFrame:
    """Rebuild each dataset's changes (dataset, date, episodes, frames, hours) over the retained days: deltas to the day before;
    a day stays if any of the three totals, null or not, differs from the day before, and so does the first."""
    line = Window.partitionBy("dataset").orderBy("date")
    totals = F.struct("episodes", "frames", "hours")
    # a day without a change has the totals of the day before it, so deltas to the day before are those to the last one kept
    return with_deltas(details.withColumn("_before", F.lag(totals).over(line)), ~totals.eqNullSafe(F.col("_before")) | (F.row_number().over(line) == 1))


def fold(arrivals: DataFrame, details: DataFrame) -> DataFrame:
    """Changes after all snapshots have been folded in: those of details whose snapshot still stands."""
    stands = effective(arrivals).where("not manual").select("org", "date", "seq")
    return changes_of(details.join(stands, ["org", "date", "seq"], "left_semi").select("dataset", "date", "episodes", "frames", "hours"))


def compact(changes: DataFrame) -> DataFrame:
    """One change a dataset and day, the last one, with deltas anew; a day that changes nothing stays."""
    return with_deltas(latest_per(changes, ["dataset", "date"], "pulled_at", "ord"))


def union_history(sources: list[DataFrame]) -> DataFrame:
    """Union of histories, one row for each (pulled_at, org); earlier sources win."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("_rank", F.lit(i))
        every = s if every is None else every.unionByName(s)
    keys = ["pulled_at", "org"]
    return every.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in every.columns if c not in (*keys, "_rank")]), "_rank").alias("_x")).select(*keys, "_x.*")


def migrate(legacy: DataFrame, log: DataFrame) -> DataFrame:
    """One row an org and day out of a legacy history and the log: detailed before manual, then the newest pulled_at."""
    every = legacy.unionByName(log)
    return latest_per(every, ["org", "date"], "detailed", "pulled_at", "seq")


#: The names under which commits carry their time and id; the first that is there counts.
COMMIT_TIME = ("created_at", "createdAt", "date")
COMMIT_ID = ("commit_id", "commitId", "oid", "id")


def commit_rows(commits: DataFrame) -> DataFrame:
    """commits with created_at and commit_id as text, from the first of their names that a row has a value under; nothing is an
    empty text.  The columns they come from are gone."""
    first = lambda names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in commits.columns], F.lit(""))
    own = {"created_at": first(COMMIT_TIME), "commit_id": first(COMMIT_ID)}
    rest = [c for c in commits.columns if c not in (*COMMIT_TIME, *COMMIT_ID)]
    return commits.select(*rest, *[v.alias(k) for k, v in own.items()])


def change_metadata(datasets: DataFrame) -> DataFrame:
    """What a change keeps of its dataset's snapshot: dataset, uploader, robot_type, total_tasks and last_modified."""
    return datasets.select(F.col("dataset_name").alias("dataset"), "uploader", "robot_type", "total_tasks", "last_modified")


def uncovered(legacy: DataFrame, log: DataFrame) -> DataFrame:
    """The days (org, date) of an old history that the log doesn't cover: it lacks them, has an older snapshot, or a manual one
    where the history has details.  Both have org, date, pulled_at, seq and detailed; without such days there is nothing to
    migrate."""
    newest = latest_per(log, ["org", "date"], "pulled_at", "seq").select(F.col("org").alias("_org"), F.col("date").alias("_date"), F.col("pulled_at").alias("_at"), F.col("detailed").alias("_detailed"))
    best = latest_per(legacy, ["org", "date"], "detailed", "pulled_at", "seq")
    same = F.col("org").eqNullSafe(F.col("_org")) & F.col("date").eqNullSafe(F.col("_date"))
    older = F.coalesce("_at", F.lit("")) < F.coalesce("pulled_at", F.lit(""))
    met = best.join(newest, same, "left")
    return met.where(F.col("_detailed").isNull() | (F.col("detailed") & ~F.col("_detailed")) | older).select("org", "date")


def commit_growth(commits: DataFrame) -> DataFrame:
    """Growth of each repository between consecutive commits (dataset, created_at, commit_id, episodes, hours): rows with a
    positive delta, negative parts clamped at zero."""
    line = Window.partitionBy("dataset").orderBy("created_at", "commit_id")
    moved = commits.withColumns({"d_episodes": F.greatest(F.lit(0), F.col("episodes") - F.coalesce(F.lag("episodes").over(line), F.lit(0))), "d_hours": F.greatest(F.lit(0).cast(HOURS), F.col("hours") - F.coalesce(F.lag("hours").over(line), F.lit(0).cast(HOURS))).cast(HOURS)})
    return moved.where("d_episodes > 0 or d_hours > 0").select("dataset", "commit_id", "created_at", "d_episodes", "d_hours")


def refresh(cached: DataFrame, current: DataFrame, fetched: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Cache rows after a refresh: repositories whose last_modified is unchanged keep theirs, the others take the fetched.

    failed (dataset, error): repositories that couldn't be fetched keep their old rows, each with the error; one without any
    has a row with nothing but its name and the error.  The result then has a column error, null for all others.
    """
    same = current.join(cached.select("dataset", "last_modified").distinct(), ["dataset", "last_modified"], "left_semi").select("dataset")
    out = cached.join(same, "dataset", "left_semi").unionByName(fetched.join(same, "dataset", "left_anti"))
    if failed is None:
        return out
    wrong = failed.groupBy("dataset").agg(F.max("error").alias("error")).join(same, "dataset", "left_anti")
    fine = out.join(wrong, "dataset", "left_anti").withColumn("error", F.lit(None).cast("string"))
    return fine.unionByName(wrong.join(cached, "dataset", "left").select(*out.columns, "error"))


def decode_present(snapshots: DataFrame, index: DataFrame) -> DataFrame:
    """Names of the datasets present in each snapshot; index (pos, dataset); positions out of range are dropped."""
    return snapshots.select("pulled_at", F.explode("present").alias("pos")).join(index, "pos").select("pulled_at", "pos", "dataset")
