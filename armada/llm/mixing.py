"""Mixing of sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Method: the mix is cut into blocks of block_words words.  Blocks go to sources by highest quotients target / (2k + 1),
then a source's blocks to its shards likewise by the shards' sizes, which gives integer quotas a shard.  A shard's
documents stand in a seeded order and its words are cut into blocks along it; the shard gives its quota of blocks in that
order, over again if the quota has more.  What a document gives follows from its place, so no block is ever made a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armada.llm.common import WORD, stash, table


def seeded(seed: str, *columns):
    """A non-negative 60-bit number drawn from the seed and the columns; SQL engines with md5 compute the same."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Add target to sources (source, source_size): its share by weight of all sizes, at most cap times its size, the
    excess reshared.  Sources in ascending order of cap / weight: the capped ones are a prefix of it, so one running sum
    replaces the rounds.  The windows run over one row a source."""
    order, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    rows = sources.withColumns({"source_no": F.row_number().over(order), "weight": weight, "most": F.lit(float(cap)) * F.col("source_size")})
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before, onwards = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(every).cast("double"))
    rows = rows.withColumn("rate", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onwards))
    rows = rows.withColumn("capped", F.col("most") <= F.col("weight") * F.col("rate")).withColumn("rank", F.row_number().over(by_cap))
    rate = F.min_by(F.when(~F.col("capped"), F.col("rate")), F.when(~F.col("capped"), F.col("rank"))).over(every)
    return rows.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * rate)).drop("rate", "capped", "rank", "most", "weight")


def apportion(rows: DataFrame, group: list[str], key: str, weight: str, seats: str, name: str) -> DataFrame:
    """Add the column name: the seats of each row's group shared among its rows by Sainte-Lague; ties to the lower key.

    Only quotients near the threshold are ranked: with n rows sharing s seats a row's result lies within quota *
    (1 +- n / 2s), so about 4 candidates a row are made in all, whatever s is.
    """
    of = Window.partitionBy(*group)
    live = rows.where((F.col(weight) > 0) & (F.col(seats) > 0))
    slack = F.least(F.lit(1.0), F.count(F.lit(1)).over(of) / (2.0 * F.col(seats)))
    quota = F.col(seats) * (F.col(weight) / F.sum(weight).over(of))
    live = live.withColumns({"_least": F.greatest(F.lit(0), F.floor(quota * (1 - slack)) - 1), "_most": F.ceil(quota * (1 + slack)) + 1})
    live = live.withColumn("_open", F.col(seats) - F.sum("_least").over(of))
    tried = live.select(*group, key, "_open", F.col(weight).cast("double").alias("_w"), "_least", F.explode(F.sequence("_least", "_most")).alias("_k"))
    ranked = tried.withColumn("_rank", F.row_number().over(of.orderBy((F.col("_w") / (2 * F.col("_k") + 1)).desc(), key, "_k")))
    won = ranked.groupBy(*group, key).agg((F.first("_least") + F.sum(F.when(F.col("_rank") <= F.col("_open"), 1).otherwise(0))).alias(name))
    return rows.join(won, [*group, key], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, block_words: int = 64, shard_words: int = 1 << 17, max_shards: int = 4096, seed: str = "mix", carry: str | None = None) -> DataFrame:
    """Per document of docs (doc_id, text, source): doc_id, size, source_size, target, taken; also the column carry, if named.

    A null text has size 0; a null source is a source of its own, last in order.  Repeated rows count each; no rows give
    none; other columns are ignored.  A block has block_words words, but at most a 64th of the smallest target (one word at
    least), so that small sources come near theirs too.  A hot source is spread over its shards (at most max_shards, which
    bounds the rows of one window; a shard's documents are numbers here, not texts).  Same rows and seed: same result,
    whatever the partitioning.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = [F.col(carry).alias("carried")] if carry else []
    sized = stash(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("of_text"), *own), "mix-sizes")  # texts are read once
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())  # one row a source
    sources = sources.withColumn("block", F.coalesce(F.least(F.lit(block_words), F.greatest(F.lit(1), F.floor(least / 64))), F.lit(1)).cast("long"))
    sources = sources.withColumns({"all": F.lit(0), "seats": F.round(F.col("total") / F.col("block")).cast("long")})
    sources = apportion(sources, ["all"], "source_no", "target", "seats", "blocks").withColumn("shards", F.least(F.lit(max_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))))
    sources = stash(sources.select("source", "source_no", "source_size", "target", "block", "blocks", "shards"), "mix-sources")

    rows = sized.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("place", seeded(seed, F.col("doc_id"))).withColumn("shard", F.pmod("place", "shards"))
    cells = rows.groupBy("source_no", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("seats"), F.first("block").alias("block"))
    cells = apportion(cells, ["source_no"], "shard", "words", "seats", "quota")
    given = F.least(F.col("quota") * F.col("block"), F.lit(cap) * F.col("words"))
    cells = cells.select("source_no", "shard", F.try_divide(given - F.try_mod(given, F.col("words")), "words").cast("long").alias("passes"), F.try_mod(given, F.col("words")).alias("rest"))

    line = Window.partitionBy("source_no", "shard").orderBy("place", "doc_id", "size", "of_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0))).join(cells, ["source_no", "shard"], "left")
    part = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("rest")) - F.col("start"))
    taken = F.when(F.col("size") > 0, F.col("passes") * F.col("size") + part).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *([F.col("carried").alias(carry)] if carry else []))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
