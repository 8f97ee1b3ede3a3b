"""Helpers shared by the training-data operators: shared scratch space, word hashes, table readers."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset, a local session gets one of its own; on a
    cluster, where no local folder is shared, that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no recomputation.  Row groups
    are small, as a task holds one in memory.  The files stay with the folder, which belongs to the run."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending cut points that deal the integer key into about equal ranges.

    Only n numbers reach the driver.  Rows below the first bound have range 0; nulls also.
    """
    if n <= 1:
        return []
    found = df.select(F.col(key).cast("double")).dropna().approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n)
    return sorted({int(x) for x in found})


def range_index(key: str, bounds: list[int]):
    """Column: how many of the ascending bounds are at or below the key.  Its group of bounds is found first, so a row meets
    about twice the root of their number."""
    if not bounds:
        return F.lit(0)
    size = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    below = lambda bound: bound <= F.col(key)
    full = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), below))
    inside = F.size(F.filter(F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), full - 1), below))
    return F.when(full > 0, (full - 1) * size + inside).otherwise(0)


def under(key: str, share) -> Column:
    """Whether a row is among about this share of all keys, those with the smallest hashes."""
    return F.xxhash64(key) / F.lit(2.0**64) + 0.5 < share


def first_by_hash(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows with the smallest hashes of key, in this order; all if they are fewer.

    An order with a limit sends k rows from every task to one.  So only rows under a hash bound, about 4 k of them, are ordered;
    if fewer than k keys pass it, as where most rows share one, all are."""
    n = rows.count()
    some = rows.where(under(key, (4 * k + 64) / n)) if n > 8 * k else rows
    if n > 8 * k and some.count() < k:
        some = rows
    return some.orderBy(F.xxhash64(key), key).limit(k)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's body is evaluated for every element it is given."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, join) -> Column:
    """Array: join over the values up to each one, join(x, y) being associative, with y null where nothing is before.

    Each step joins twice as many as the one before; an array that grew by one value a step would be copied every time."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(steps, values, lambda acc, k: F.transform(acc, lambda x, i: join(x, F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)))))


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets all once it holds too many words, so memory is bounded."""

    LIMIT = 50_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, in order.  bytes.split() splits at exactly the bytes that WORD excludes."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (multiply and xor-shift), so that every bit depends on all."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(words: np.ndarray, k: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of k consecutive words: a polynomial in their hashes, mixed."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(factor) + words[j : j + n]
    return mix(total)
