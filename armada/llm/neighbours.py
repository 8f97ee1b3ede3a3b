"""Approximate nearest neighbours by an inverted multi-index.

Method: each half of a vector is quantised to CENTROIDS centroids of its own, so an entry lies in the cell of a centroid pair.
A query walks the pairs by descending sum of its two inner products, with a heap (the multi-sequence algorithm), until the
cells hold enough entries; the entries of those cells are ranked anew by the exact inner product.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armada.llm.common import first_by_hash, stash, table


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    k = min(k, len(np.unique(x, axis=0)))
    c = np.unique(x, axis=0)[np.random.default_rng(seed).choice(len(np.unique(x, axis=0)), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1)


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, enough: float) -> np.ndarray:
    """Mask (left, right) of the cells a query visits: best pairs first, until they hold enough entries."""
    li, ri = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    seen, visited, held = {(0, 0)}, np.zeros(counts.shape, bool), 0
    heap = [(-(left[li[0]] + right[ri[0]]), 0, 0)]
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        visited[li[i], ri[j]] = True
        held += counts[li[i], ri[j]]
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(li) and b < len(ri) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-(left[li[a]] + right[ri[b]]), a, b))
    return visited


def best(ids: np.ndarray, vectors: np.ndarray, open_: np.ndarray, query: np.ndarray, rough: np.ndarray, k: int, repeated: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k open ids with the largest inner product, ties to smaller ids.  Sums run in the same order for every row, so
    equal vectors score equally; rough scores only preselect, with a margin beyond rounding.  Where ids are repeated all open
    entries are scored, and each id is listed with its best."""
    at = np.flatnonzero(open_)
    if len(at) > k and not repeated:
        floor = np.partition(rough[at], len(at) - k)[len(at) - k]
        at = at[rough[at] >= floor - 1e-9 * (1 + abs(floor))]
    score = (vectors[at] * query).sum(axis=1)
    order = np.lexsort((ids[at], -score))
    if repeated:
        order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])]
    order = order[:k]
    return ids[at][order], score[order]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id long, embedding array<double>) that take part: not null, not zero, all components finite."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, centroids: int = 32, share: float = 0.62, least: int = 200, sample: int = 8000, block: int = 4096, ask: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors by inner product for each row of queries.

    Both have vec_id and embedding; a query's own vec_id is no candidate.  Vectors that are null, zero or not finite, and
    those of another length than most of the sample have, take no part.  A walk ends once its cells hold share of all entries
    and at least least of them; share is what a recall of 0.9 takes on vectors without clusters (measured in the tests), and
    may be far lower where there are some.  The codebooks are fitted on sample rows in the order of a hash of their id;
    every row is indexed.  Cells are grouped by their left centroid and cut into blocks, and the queries that visit one into
    groups of about ask, so a hot cell is many tasks.  Repeated rows, and repeated queries, count once; equal vec_ids with
    other vectors count as entries of their own, but a vec_id is listed once, with its best score, and of queries that share
    a vec_id each adds to its list.  Empty tables give no rows.
    """
    good = usable(vectors)
    picked = [r[0] for r in first_by_hash(good.select("embedding", "vec_id"), "vec_id", sample).select("embedding").collect()]
    spark, out = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    lengths = Counter(map(len, picked))
    if not lengths:
        return spark.createDataFrame([], out)
    size = max(lengths, key=lambda n: (lengths[n], n))
    x = np.array([p for p in picked if len(p) == size], float)
    half = size // 2
    books = [kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)] if half else [np.zeros((1, 0)), kmeans(x, centroids)]

    def quantise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            e = np.array(list(pdf["embedding"]), float).reshape(-1, size)
            yield pdf.assign(left=nearest(e[:, :half], books[0]), right=nearest(e[:, half:], books[1]))

    entries = stash(good.where(F.size("embedding") == size).distinct().mapInPandas(quantise, "vec_id long, embedding array<double>, left int, right int"), "entries")
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in entries.groupBy("left", "right").count().collect():  # at most centroids squared rows
        counts[r["left"], r["right"]] = r["count"]
    enough, blocks = max(least, share * counts.sum()), np.maximum(1, -(-counts.sum(axis=1) // block))
    asking = usable(queries).where(F.size("embedding") == size).distinct()
    parts = max(1, -(-asking.count() // ask))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                rows = []
                for q, e, part in pdf.iloc[at : at + 256][["vec_id", "embedding", "part"]].itertuples(index=False):
                    e = np.asarray(e, float)
                    visited = walk(books[0] @ e[:half], books[1] @ e[half:], counts, enough)
                    for left in np.flatnonzero((visited & (counts > 0)).any(axis=1)):
                        rows.append((int(left), part, q, e, np.packbits(visited[left]).tobytes()))
                yield pd.DataFrame(rows, columns=["left", "part", "query_id", "embedding", "cells"])

    def rank(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, e, right = held["vec_id"].to_numpy(), np.array(list(held["embedding"]), float), held["right"].to_numpy()
        found, repeated = [], len(np.unique(ids)) < len(ids)
        for s in range(0, len(asked), 256):
            some = asked.iloc[s : s + 256]
            rough = np.array(list(some["embedding"]), float) @ e.T
            for row, (q, v, cells) in enumerate(zip(some["query_id"], some["embedding"], some["cells"], strict=True)):
                open_ = np.unpackbits(np.frombuffer(cells, np.uint8)).astype(bool)[right] & (ids != q)
                near, score = best(ids, e, open_, np.asarray(v, float), rough[row], k, repeated)
                found.append(pd.DataFrame({"query_id": q, "vec_id": near, "score": score}))
        return pd.concat(found)

    of_left = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("left") + 1)
    number = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(parts)).cast("int")
    asked = asking.withColumn("part", number).mapInPandas(route, "left int, part int, query_id long, embedding array<double>, cells binary")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), of_left - 1)))
    held = entries.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), of_left).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["left", "block", "part"]
    met = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
