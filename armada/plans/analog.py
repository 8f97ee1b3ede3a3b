"""Views over the driver tables that stand for the fleet's own tables, for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armada.operators.fleet import HOURS

#: Common table expressions in SQL, equal to the functions below.
CTE = {
    "frames": "frames AS (SELECT user_id AS episode, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame, value AS v, event_id FROM events)",
    "steps": "steps AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY episode ORDER BY frame)) AS step FROM frames)",
    "orders2": "orders2 AS (SELECT o_orderkey, o_custkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS hours, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)",
    "datasets": "datasets AS (SELECT c_name AS dataset, n_name AS uploader, c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS episodes, CAST(sum(hours) AS DECIMAL(18,2)) AS hours, CAST(sum(o_orderkey) AS BIGINT) AS frames, max(day) AS last_modified FROM orders2 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)",
    "changes": "changes AS (SELECT c_name AS dataset, c_mktsegment AS segment, n_name AS uploader, o_orderkey AS commit_id, day AS changed_at, hours AS h, CAST(count(*) OVER w AS BIGINT) AS episodes, CAST(sum(o_orderkey % 500) OVER w AS BIGINT) AS frames, CAST(sum(hours) OVER w AS DECIMAL(18,2)) AS hours FROM orders2 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WINDOW w AS (PARTITION BY c_custkey ORDER BY day, o_orderkey ROWS UNBOUNDED PRECEDING))",
    "snapshots": "snapshots AS (SELECT c_mktsegment AS org, substr(day, 1, 7) AS date, max(day) AS pulled_at, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey % 500) AS BIGINT) AS f, CAST(sum(hours) AS DECIMAL(18,2)) AS h FROM orders2 JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), snaps AS (SELECT org, date, pulled_at, CAST(sum(n) OVER (PARTITION BY org ORDER BY date) AS BIGINT) AS episodes, CAST(sum(f) OVER (PARTITION BY org ORDER BY date) AS BIGINT) AS frames, CAST(sum(h) OVER (PARTITION BY org ORDER BY date) AS DECIMAL(18,2)) AS hours, CAST(row_number() OVER (ORDER BY date, org) AS BIGINT) AS ord FROM snapshots)",
    "prompts": "prompts AS (SELECT doc_id, text AS prompt, concat(source, '/', lang, '-', lpad(CAST(doc_id % 9000 AS VARCHAR), 4, '0')) AS name FROM documents)",
}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, d: str) -> DataFrame:
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select(F.col("user_id").alias("episode"), (F.row_number().over(line) - 1).cast("long").alias("frame"), F.col("value").alias("v"), "event_id")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """One-component vectors of frames."""
    return frames(spark, d).withColumn("vec", F.array("v"))


def orders2(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast(HOURS).alias("hours"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def owners(spark: SparkSession, d: str) -> DataFrame:
    customers = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("uploader"))  # 25 rows
    return customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_name").alias("dataset"), "uploader", F.col("c_mktsegment").alias("segment"))


def datasets(spark: SparkSession, d: str) -> DataFrame:
    each = orders2(spark, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("episodes"), F.sum("hours").cast(HOURS).alias("hours"), F.sum("o_orderkey").alias("frames"), F.max("day").alias("last_modified"))
    return each.join(owners(spark, d), F.col("o_custkey") == F.col("c_custkey")).select("dataset", "uploader", "segment", "episodes", "hours", "frames", "last_modified")


def changes(spark: SparkSession, d: str) -> DataFrame:
    line = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = orders2(spark, d).withColumns({"h": F.col("hours"), "episodes": F.count(F.lit(1)).over(line), "frames": F.sum(F.col("o_orderkey") % 500).over(line).cast("long")}).withColumn("hours", F.sum("h").over(line).cast(HOURS))
    return rows.join(owners(spark, d), F.col("o_custkey") == F.col("c_custkey")).select("dataset", "segment", "uploader", F.col("o_orderkey").alias("commit_id"), F.col("day").alias("changed_at"), "h", "episodes", "frames", "hours")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    months = orders2(spark, d).join(owners(spark, d), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("segment").alias("org"), F.substring("day", 1, 7).alias("date")).agg(F.max("day").alias("pulled_at"), F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey") % 500).cast("long").alias("f"), F.sum("hours").cast(HOURS).alias("h"))
    line = Window.partitionBy("org").orderBy("date")
    # one row an org and month from here on
    return months.select("org", "date", "pulled_at", F.sum("n").over(line).alias("episodes"), F.sum("f").over(line).alias("frames"), F.sum("h").over(line).cast(HOURS).alias("hours"), F.row_number().over(Window.orderBy("date", "org")).cast("long").alias("ord"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Texts as prompts, with made-up names of datasets; null texts stay null."""
    name = F.concat("source", F.lit("/"), "lang", F.lit("-"), F.lpad((F.col("doc_id") % 9000).cast("string"), 4, "0"))
    return t(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"), name.alias("name"))
