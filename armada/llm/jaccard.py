"""Self-join of texts by the Jaccard similarity of their word shingles: a chosen-path join.

Method: a text is the set of its hashed five-word shingles, and its minima under SIGNATURE hash functions sample tokens of
it.  Sets are split recursively on sampled shared tokens: a run puts each set into the bucket of one sampled token; buckets
over bucket_limit sets split again on further sampled tokens, chosen by the bucket's path; small buckets are searched by
brute force on sketches.  Runs are repeated until a pair at the threshold shares a bucket with the target recall.  What the
buckets connect is then compared exactly, whole component by whole component, in blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm.common import stash, table, window_hashes, word_hashes
from armada.llm.components import components

SIGNATURE = 32
FACTORS = np.random.default_rng(20).integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; a shorter text is one shingle of all its words, an empty one has none."""
    words = word_hashes(text)
    return np.unique(window_hashes(words, min(k, len(words)), 0x9E3779B97F4A7C15 + 2 * min(k, len(words)))) if len(words) else np.empty(0, np.uint64)


def minima(tokens: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each function; long sets in runs of 4096 tokens, so memory is bounded."""
    low = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(tokens), 4096):
        low = np.minimum(low, (tokens[s : s + 4096] * FACTORS[:, None]).min(axis=1))
    return low


def text_key(text: str | None) -> bytes:
    """128-bit digest of the words of a text; texts with the same words in the same order are copies."""
    return hashlib.blake2b(b" ".join((text or "").encode("utf-8", "surrogatepass").split()), digest_size=16).digest()


def spread(links: np.ndarray) -> np.ndarray:
    """Component number (smallest member) of each row of a symmetric boolean matrix."""
    label = np.arange(len(links))
    while True:
        least = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def same_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from incidence matrices of 4096 shared tokens at a time."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    of, token = of[shared[token]], number[token[shared[token]]]
    order = np.argsort(token, kind="stable")
    of, token = of[order], token[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(token, [start, start + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[of[a:b], token[a:b] - start] = 1
        out += m @ m.T
    return out.astype(np.int64)


def candidate_edges(sets: DataFrame, threshold: float, recall: float, bucket_limit: int, levels: int = 4, branches: int = 2) -> DataFrame:
    """Edges (a, b) that connect all sets (node binary, tokens array<long>, sketch binary) likely above the threshold.

    A pair at the threshold meets in a run's first bucket with that probability, and below each split in one of branches
    tokens, so the runs follow from the target recall.  A set has at most branches ** level rows a run, however large the
    buckets it is in.  A large bucket isn't split where half of its sets look similar to its first one, so that most pairs are
    links, nor at the last level, whose sets agree in a token at every level: each of its sets gets an edge to the bucket
    itself, a node of 8 bytes, so all are connected without a search or a join, and compared exactly later.  What is joined
    to a bucket's rows is written first, so that Spark can split the rows of a hot bucket.
    """
    kept = threshold * (1 - (1 - threshold) ** branches) ** levels
    runs = math.ceil(math.log(1 - recall) / math.log(1 - kept))
    if not 1 <= runs <= SIGNATURE // 2:
        raise ValueError(f"recall {recall} at similarity {threshold} takes {runs} runs; {SIGNATURE} tokens are sampled")
    rows = sets.select("node", "sketch", F.posexplode(F.slice("tokens", 1, runs)).alias("run", "token")).select("node", "sketch", F.xxhash64("run", "token").alias("path"))
    # A pair at the threshold shares 32 * 0.8 sketch tokens on average; below least it is about 1e-6 likely.
    least = int(SIGNATURE * threshold - 4.9 * math.sqrt(SIGNATURE * threshold * (1 - threshold)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = [], []
            for nodes, sketches in zip(pdf["nodes"], pdf["sketches"], strict=True):
                s = np.frombuffer(b"".join(sketches), "<u2").reshape(-1, SIGNATURE)
                label = spread((s[:, None, :] == s[None, :, :]).sum(axis=2) >= least)
                for i in np.flatnonzero(label != np.arange(len(label))):
                    a.append(nodes[i])
                    b.append(nodes[label[i]])
            yield pd.DataFrame({"a": a, "b": b}, dtype=object)

    def agree(a: Column, b: Column) -> Column:
        """In how many of the sampled tokens two sketches agree."""
        at = F.sequence(F.lit(1), F.lit(2 * SIGNATURE - 1), F.lit(2))
        return F.size(F.filter(at, lambda i: F.substring(a, i, F.lit(2)) == F.substring(b, i, F.lit(2))))

    found = []
    for level in range(levels + 1):
        sizes = stash(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        live = stash(rows.join(sizes, "path"), "paths")
        small = live.where(F.col("n") <= bucket_limit).groupBy("path").agg(F.collect_list(F.struct("node", "sketch")).alias("all")).select(F.col("all.node").alias("nodes"), F.col("all.sketch").alias("sketches"))
        found.append(small.mapInPandas(search, "a binary, b binary"))
        large = live.where(F.col("n") > bucket_limit).drop("n")
        if large.isEmpty():
            break
        if level < levels:
            leaders = stash(large.groupBy("path").agg(F.min(F.struct("node", "sketch")).alias("leader")), "leaders")
            near = large.join(leaders, "path").select("path", (agree(F.col("sketch"), F.col("leader.sketch")) >= least).cast("int").alias("near"))
            alike = stash(near.groupBy("path").agg((F.avg("near") >= 0.5).alias("alike")), "alike")
            large = stash(large.join(alike, "path"), "large")
        else:
            large = large.withColumn("alike", F.lit(True))
        found.append(large.where("alike").select(F.col("node").alias("a"), F.unhex(F.lpad(F.hex("path"), 16, "0")).alias("b")))
        if level == levels:
            break
        tries = F.array(*[F.pmod(F.xxhash64("path", F.lit(j)), F.lit(SIGNATURE)).cast("int") for j in range(branches)])
        token = F.substring(F.col("sketch"), F.col("at") * 2 + 1, F.lit(2))
        rows = large.where("not alike").select("node", "sketch", "path", F.explode(F.array_distinct(tries)).alias("at")).select("node", "sketch", F.xxhash64("path", "at", token).alias("path"))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def similar_texts(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.99999, bucket_limit: int = 128, block: int = 256, block_tokens: int = 1 << 20) -> DataFrame:
    """Per document of docs (doc_id long, text string): doc_id, class_id, n_links, n_copies.

    Texts with the same words are copies (n_copies, itself included); n_links counts the different texts whose shingle sets
    are at least threshold similar; class_id is the smallest doc_id reachable over copies and links.  Null and empty texts
    are copies of each other and link to nothing.  Texts under k words are one shingle.  Repeated rows count as copies; a
    null doc_id is kept and never is a class_id unless alone; no rows give none; other columns are ignored.  Every pair in a
    connected group is compared exactly, in blocks of about block texts and at most about block_tokens shingles, counted
    where it is found and never emitted: the work is that of the links there are to count.
    """
    percent = round(threshold * 10_000)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(x, k) for x in pdf["text"]]
            low = [minima(s) for s in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "row_key": pdf["row_key"], "size": [len(s) for s in sets], "node": [text_key(x) for x in pdf["text"]], "tokens": [list(v.astype(np.int64)[:16]) if len(s) else [] for v, s in zip(low, sets, strict=True)], "sketch": [v.astype("<u2").tobytes() for v in low]})

    # the key of a row finds its text again, whether its doc_id is null, repeated or neither
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    rows = stash(keyed.mapInPandas(features, "doc_id long, row_key long, size long, node binary, tokens array<long>, sketch binary"), "shingles")
    texts = stash(rows.groupBy("node").agg(F.min("doc_id").alias("doc"), F.min("row_key").alias("row_key"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n_copies"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "texts")
    groups = components(candidate_edges(texts.where("size > 0"), threshold, recall, bucket_limit))
    groups = stash(groups.join(texts.select("node", "row_key", "size"), "node"), "groups")

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()  # repeated rows come to the same task; a group's text is needed once
        for pdf in batches:
            for part in (pdf.iloc[at : at + 64] for at in range(0, len(pdf), 64)):
                keep = []
                for n, t in zip(part["node"], part["text"], strict=True):
                    keep.append(bytes(n) not in seen and bytes(n) == text_key(t))
                    if keep[-1]:
                        seen.add(bytes(n))
                part = part[np.array(keep, bool)]
                yield pd.DataFrame({"node": part["node"], "root": part["root"], "own": part["own"], "blocks": part["blocks"], "tokens": [shingles(t, k).tobytes() for t in part["text"]]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """One pair of blocks of a group: how many links each text has in the other block, and what they connect."""
        pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
        sets = [np.frombuffer(t, np.uint64) for t in pdf["tokens"]]
        n = np.array([len(s) for s in sets])
        both = same_tokens(sets)
        linked = both * (10_000 + percent) >= percent * (n[:, None] + n[None, :])
        np.fill_diagonal(linked, False)
        counted = linked & ((pdf["own"].to_numpy()[:, None] != pdf["own"].to_numpy()[None, :]) | (pdf["left"].iloc[0] == pdf["right"].iloc[0]))
        return pd.DataFrame({"node": pdf["node"], "links": counted.sum(axis=1), "b": pdf["node"].to_numpy()[spread(linked)]})

    sizes = stash(groups.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / block_tokens)).alias("blocks")), "blocks")
    placed = stash(groups.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).select("node", "row_key", "root", "own", "blocks"), "placed")
    sets = keyed.select("text", "row_key").join(placed.hint("merge"), "row_key").select("node", "root", "own", "blocks", "text").mapInPandas(sets_of, "node binary, root binary, own long, blocks long, tokens binary")
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("root", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "node", "tokens")
    links = stash(met.groupBy("root", "left", "right").applyInPandas(compare, "node binary, links long, b binary"), "links")
    classes = components(links.select(F.col("node").alias("a"), "b"))
    known = texts.select("node", "doc", "n_copies").join(links.groupBy("node").agg(F.sum("links").alias("n_links")), "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = stash(known, "classes")
    first = stash(known.groupBy("root").agg(F.min("doc").alias("class_id")), "class-ids")
    known = known.join(first, "root").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return rows.select("doc_id", "node").join(known, "node").select("doc_id", "class_id", "n_links", "n_copies")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents"))
