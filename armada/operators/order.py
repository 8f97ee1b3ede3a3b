"""Places of rows in an order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys sampled for each range; they reach the driver.
SAMPLED = 64


def ranges(rows: DataFrame, key: str) -> Column:
    """The index of a row's range of key, ascending; equal keys share a range, nulls are in the first.

    The cut points come from a sample.  They only balance the ranges: any points order the ranges rightly.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(key).dropna()
    share = min(1.0, SAMPLED * n / max(1, keys.count()))
    sample = sorted(r[0] for r in keys.sample(share, seed=1).collect())
    bounds = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))) if bounds else F.lit(0)


def numbered(rows: DataFrame, key: str, *then: str, descending: bool = False) -> DataFrame:
    """rows with place, from 0, in the order of key (nulls first, in descending order last), then of the other columns.

    Each range of key is numbered by itself and starts after the rows of the ranges before it: one row a range.
    """
    rows = rows.withColumn("_range", ranges(rows, key))
    rank = -F.col("_of") if descending else F.col("_of")
    before = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    first = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(first, *then)) - 1
    return rows.withColumn("_inside", inside).join(F.broadcast(starts), F.col("_range") == F.col("_of")).withColumn("place", F.col("_start") + F.col("_inside")).drop("_range", "_of", "_start", "_inside")


def picked(rows: DataFrame, key: str, places: list[int]) -> list:
    """The values of key at some places of its order (from 0), exactly; one value a place reaches the driver."""
    found = {r["place"]: r[key] for r in numbered(rows.select(key), key).where(F.col("place").isin(*map(int, places))).collect()}
    return [found[p] for p in places]


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys, n and name of each combination of keys: how many values it has and their median, exactly; nulls don't count.

    A sketch of each group, which is small and merged from parts, brackets its middle places.  Only the distinct values inside the
    bracket, about a five-hundredth of a large group, are ordered; those below count as one.  So no task holds a hot group's values.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    # the sketch errs by a ten-thousandth of a group's places, the bracket reaches ten times as far
    near = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", [0.499, 0.501], 10_000).alias("_near"))
    kept = known.join(near, keys).where(F.col("_v") <= F.col("_near")[1])
    kept = kept.groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_near")[0], F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = kept.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())))
    at = [F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place), F.col("_v"))) for place in (F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))]
    return placed.groupBy(*keys).agg(F.max("_n").alias("n"), ((at[0] + at[1]) / 2).alias(name))
