"""Toxicity by a factorization machine over hashed terms.

Method: a text is the set of its hashed terms.  The machine scores w0 + sum w_i + sum over pairs <v_i, v_j>, so that a pair
of terms, such as an insult with the mention of a group, weighs more or less than its two terms alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm.common import first_by_hash, table

BITS = 20
EDGES = ".,;:!?\"'()[]{}<>-_*"


def terms(text: str | None) -> set[str]:
    """Lower-case words of a whole text without punctuation at their edges; null: none."""
    return {w.strip(EDGES) for w in set((text or "").lower().split())} - {""}


def hashed(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


@dataclass
class FactorizationMachine:
    index: dict[int, int]
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        xv = x @ self.v
        return self.w0 + x @ self.w + 0.5 * ((xv**2).sum(axis=1) - (x**2) @ (self.v**2).sum(axis=1))

    def score(self, features: list[int]) -> float:
        at = [i for f in features if (i := self.index.get(f)) is not None]
        s = self.v[at].sum(axis=0)
        return float(1 / (1 + np.exp(-(self.w0 + self.w[at].sum() + 0.5 * ((s**2).sum() - (self.v[at] ** 2).sum())))))


def alone(counts: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """By how many standard errors the share of each term (documents with it by label, in rows) differs between the labels."""
    share = (counts.sum(axis=1) + 1) / (n0 + n1 + 2)
    return np.abs(counts[:, 1] / n1 - counts[:, 0] / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)


def together(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For all pairs of terms (columns of the 0/1 matrix x), by how many standard errors the share of label 1 with both departs
    from what each adds alone: p11 - p10 - p01 + p00 over the four cells of documents with and without either."""
    n11, k11 = x.T @ x, x.T @ (x * y[:, None])
    n, k = np.diag(n11), np.diag(k11)
    cells = [(n11, k11), (n[:, None] - n11, k[:, None] - k11), (n[None, :] - n11, k[None, :] - k11), (len(x) - n[:, None] - n[None, :] + n11, y.sum() - k[:, None] - k[None, :] + k11)]
    total, variance = 0.0, 0.0
    for (m, hits), sign in zip(cells, (1, -1, -1, 1), strict=True):
        p = (hits + 0.5) / (m + 1)
        total, variance = total + sign * p, variance + p * (1 - p) / (m + 1)
    z = np.abs(total) / np.sqrt(variance)
    np.fill_diagonal(z, 0)
    return z


def fit(samples: list[list[int]], labels: np.ndarray, weights: np.ndarray, factors: int = 6, most_terms: int = 512, least_docs: int = 4, least_z: float = 4.5, pair_terms: int = 1024, most_pairs: int = 64, least_pair_z: float = 6.5, steps: int = 250, decay: float = 5e-5, seed: int = 7) -> FactorizationMachine:
    """Train on lists of hashed terms; full-batch Adam on the weighted log loss.

    The machine has the terms that tell the labels apart alone (by least_z standard errors, at most most_terms) and, of the
    pair_terms most frequent ones, those of the most_pairs pairs that do so only together (by least_pair_z).  Terms that do
    neither are noise to it.  Without samples: a machine that scores all near 0."""
    counts: dict[int, list[int]] = {}
    for features, y in zip(samples, labels, strict=True):
        for f in features:
            counts.setdefault(f, [0, 0])[int(y)] += 1
    n1 = max(1, int(labels.sum()))
    n0 = max(1, len(labels) - int(labels.sum()))

    def matrix(of: dict[int, int]) -> np.ndarray:
        x = np.zeros((len(samples), len(of)), np.float32)
        for row, features in enumerate(samples):
            x[row, [of[f] for f in features if f in of]] = 1
        return x

    keys = np.array([f for f, c in counts.items() if sum(c) >= least_docs], np.int64)
    c = np.array([counts[f] for f in keys], float).reshape(-1, 2)
    z = alone(c, n0, n1)
    best = np.argsort(-z, kind="stable")[:most_terms]
    chosen = dict.fromkeys(int(f) for f in keys[best[z[best] >= least_z]])
    usual = keys[np.lexsort((keys, -c.sum(axis=1)))[:pair_terms]]
    if len(usual) > 1:
        pairs = np.triu(together(matrix({int(f): i for i, f in enumerate(usual)}), labels.astype(np.float32)))
        for at in np.argsort(-pairs, axis=None, kind="stable")[:most_pairs]:
            i, j = np.unravel_index(at, pairs.shape)
            if pairs[i, j] >= least_pair_z:
                chosen |= {int(usual[i]): None, int(usual[j]): None}
    index = {f: i for i, f in enumerate(chosen)}
    rng = np.random.default_rng(seed)
    machine = FactorizationMachine(index, -4.0, np.zeros(len(index)), rng.normal(0, 0.01, (len(index), factors)))
    if not len(index):
        return machine
    x = matrix(index).astype(float)
    y, weights = labels.astype(float), weights / weights.sum()
    params = [np.array([machine.w0]), machine.w, machine.v]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        machine.w0 = float(params[0][0])
        xv = x @ machine.v
        p = 1 / (1 + np.exp(-(machine.w0 + x @ machine.w + 0.5 * ((xv**2).sum(axis=1) - x @ (machine.v**2).sum(axis=1)))))
        g = (p - y) * weights
        grads = [np.array([g.sum()]), x.T @ g + decay * machine.w, x.T @ (g[:, None] * xv) - (x.T @ g)[:, None] * machine.v + decay * machine.v]
        for p_, g_, m, s in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g_ - m)
            s += 0.01 * (g_**2 - s)
            p_ -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    machine.w0 = float(params[0][0])
    return machine


def held_out(modulus: int, value: int):
    """Column: crc32 of doc_id as text, mod modulus, is value; a null doc_id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == value, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2500) -> FactorizationMachine:
    """Learn from labels.toxic of documents that aren't held out (crc32 mod 5 is not 0).

    The bounded sample: at most per_label documents of each label, in the order of a hash of their id; the label's count in
    the whole table weighs them.  Only term hashes of the sample reach the driver.
    """
    usable = labels.where("toxic in (0, 1)").where(~held_out(5, 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [first_by_hash(usable.where(F.col("toxic") == y), "doc_id", per_label) for y in (0, 1)]
    sample = picked[0].unionByName(picked[1])  # at most 2 * per_label rows of two numbers

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "features": [sorted({hashed(t) for t in terms(x)}) for x in pdf["text"]]})

    # of rows that share a doc_id the smallest text is the example, so what reaches the driver stays bounded
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = joined.mapInPandas(features, "doc_id long, toxic int, features array<int>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["features"]))
    y = np.array([r["toxic"] for r in rows], np.int64)
    had = np.bincount(y, minlength=2)
    weights = np.array([counts.get(int(v), 1) / max(1, had[v]) for v in y], float)
    return fit([r["features"] for r in rows], y, weights)


class Scorer:
    """Scores of whole texts by a machine; remembers which words are terms of it (for a bounded number of words)."""

    def __init__(self, machine: FactorizationMachine):
        self.machine, self.known = machine, {}

    def score(self, text: str | None) -> float:
        found, known = set(), self.known
        for word in set((text or "").lower().split()):
            hit = known.get(word)
            if hit is None:
                if len(known) > 100_000:
                    known.clear()
                f = hashed(t) if (t := word.strip(EDGES)) else -1
                hit = known[word] = f if f in self.machine.index else -1
            if hit >= 0:
                found.add(hit)
        return self.machine.score(sorted(found))


def score_documents(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, from its whole text alone.

    Null and empty texts score as the machine's intercept.  Repeated rows score alike; no rows give none; other columns are
    ignored.  The machine holds at most most_terms and twice most_pairs terms, which bounds what each task is sent.
    """

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(machine)
        for pdf in batches:
            scores = [scorer.score(x) for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]})

    return docs.select("doc_id", "text", held_out(5, 0).alias("held_out")).mapInPandas(scored, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """The rows of docs, all columns, whose text scores under 0.5."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([scorer.score(x.as_py()) < 0.5 for x in texts], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
