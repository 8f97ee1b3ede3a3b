"""Document quality by random Fourier features of document statistics.

Method: a text is a short vector of statistics, standardised over all documents.  Random Fourier features approximate a Gaussian
kernel over these vectors.  Ridge scores follow from normal equations, which are sums over documents: every partition sums its
own, for each of a few folds, and the sums are added.  What the sums without a fold predict for that fold is calibrated against
its labels by isotonic regression, which turns scores into probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm.common import stash, table
from armada.llm.toxicity import held_out

#: What is measured of a text, in the order of statistics().
NAMES = ("chars", "words", "lines", "word_chars", "word_spread", "line_words", "upper", "digits", "marks", "space", "beyond_ascii", "distinct_words", "distinct_pairs", "top_word", "top_mark", "distinct_lines", "word_entropy", "long_words", "wordless", "short_words")
UPPER, DIGITS, MARKS, SPACE, LETTERS = (np.zeros(256, bool) for _ in range(5))
UPPER[65:91] = DIGITS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[192:] = True
SPACE[[9, 10, 11, 12, 13, 32]] = True
MARKS[33:127] = True
MARKS &= ~(DIGITS | LETTERS)
FOLDS = 3
#: Labelled rows that share one sum, and steps of the score between which calibration doesn't tell apart.
ROWS, BINS = 20_000, 4096


def share(part: float, whole: float) -> float:
    return float(part) / whole if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; null and empty: all 0."""
    if not text:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "surrogatepass")
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, counts, pairs = len(words), Counter(words), len(set(zip(words, words[1:])))  # noqa: B905
    sizes = np.fromiter(map(len, words), np.float64, n)
    often = np.fromiter(counts.values(), np.float64, len(counts))
    marks = bytes_[MARKS]
    return [
        math.log1p(len(text)),
        math.log1p(n),
        math.log1p(len(lines)),
        math.log1p(sizes.mean()) if n else 0.0,
        math.log1p(sizes.std()) if n else 0.0,
        math.log1p(share(n, len(lines))),
        share(bytes_[UPPER].sum(), len(raw)),
        share(bytes_[DIGITS].sum(), len(raw)),
        math.sqrt(share(marks.sum(), len(raw))),
        share(bytes_[SPACE].sum(), len(raw)),
        share(bytes_[192:].sum(), len(raw)),
        share(len(counts), n),
        share(pairs, n - 1) if n > 1 else 1.0,
        math.sqrt(share(often.max(initial=0), n)),
        math.sqrt(share(marks.max(), len(raw))),
        share(len(set(lines)), len(lines)),
        share(math.log(n) - float((often * np.log(often)).sum()) / n, math.log(n)) if n > 1 else 1.0,
        share((sizes > 15).sum(), n),
        share(sum(not w.isalpha() for w in words), n),
        share((sizes < 3).sum(), n),
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and stats of every document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, stats array<double>")


@dataclass
class KernelRidge:
    """Standardisation, random features, and the calibrated ridge scores on them."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant; what lies far out counts as five deviations."""
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        z = math.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        # rounded, as the last digits of a product depend on how many rows are multiplied at once
        return np.round(np.interp(self.features(stats) @ self.weights, self.knots, self.levels), 12)


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (ascending scores) and their levels (never falling shares of label 1): neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for x, y, m in zip(at, ones, n, strict=True):
        blocks.append([x * m, y, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([x / m for x, _, m in blocks]), np.array([y / m for _, y, m in blocks])


def stacked(column) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.zeros((0, len(NAMES)))


def train(stats: DataFrame, labels: DataFrame, features: int = 256, width: float = 4.0, seed: int = 12) -> KernelRidge:
    """Learn from labels.quality (0 or 1) of all documents that aren't held out (crc32 mod 3 is not 1).

    stats is what described gives.  Of several labels of a doc_id the mean counts; rows that share a doc_id are examples each.
    What reaches the driver are FOLDS sums of (features + 2) ** 2 / 2 numbers and at most BINS counts, whatever the corpus.
    width is the kernel's, in standard deviations; features is the number of random ones.  Without labels: a model that says
    0.5 of every text.
    """
    known = labels.where("quality in (0, 1)").where(~held_out(3, 1)).where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")
    examples = stash(stats.join(known, "doc_id").select("stats", "y", fold.alias("fold")), "quality-examples")
    moments = [f(F.get("stats", i)) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]
    found = stats.agg(F.count(F.lit(1)), *moments).first()
    values = np.array([v or 0.0 for v in found[1:]]).reshape(-1, 2)
    rng = np.random.default_rng(seed)
    model = KernelRidge(values[:, 0], np.maximum(values[:, 1], 1e-6), rng.normal(0, 1 / width, (len(NAMES), features)), rng.uniform(0, 2 * np.pi, features))
    n = examples.count()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, features + 2, features + 2))
        for pdf in batches:
            z = np.hstack([model.features(stacked(pdf["stats"])), pdf["y"].to_numpy()[:, None]])
            for k in range(FOLDS):
                own = z[pdf["fold"].to_numpy() == k]
                total[k] += own.T @ own
        yield pd.DataFrame([(k, i, total[k, i, i:]) for k in range(FOLDS) for i in range(features + 2)], columns=["fold", "i", "line"])

    def added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, stacked(pdf["line"]).sum(axis=0))], columns=["fold", "i", "line"])

    # a sum for every ROWS examples, so that what is added up stays smaller than the examples
    partial = examples.repartition(max(1, -(-n // ROWS))).mapInPandas(sums, "fold int, i int, line array<double>")
    gram = np.zeros((FOLDS, features + 2, features + 2))
    for r in partial.groupBy("fold", "i").applyInPandas(added, "fold int, i int, line array<double>").collect():
        gram[r["fold"], r["i"], r["i"] :] = gram[r["fold"], r["i"] :, r["i"]] = r["line"]
    if not n:
        model.weights, model.knots, model.levels = np.zeros(features + 1), np.zeros(1), np.full(1, 0.5)
        return model

    def solve(g: np.ndarray, ridge: float) -> np.ndarray:
        penalty = ridge * g[-2, -2] * np.diag([1.0] * features + [0.0])
        return np.linalg.lstsq(g[:-1, :-1] + penalty, g[:-1, -1], rcond=None)[0]

    def missed(g: np.ndarray, w: np.ndarray) -> float:
        return float(w @ g[:-1, :-1] @ w - 2 * w @ g[:-1, -1] + g[-1, -1])

    whole, others = gram.sum(axis=0), [gram.sum(axis=0) - g for g in gram]
    # the penalty under which the sums without a fold predict that fold best
    ridge = min((10.0**-e for e in range(2, 8)), key=lambda x: sum(missed(g, solve(o, x)) for g, o in zip(gram, others, strict=True)))
    model.weights, apart = solve(whole, ridge), [solve(o, ridge) for o in others]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = (model.features(stacked(pdf["stats"])) * np.array(apart)[pdf["fold"].to_numpy()]).sum(axis=1)
            yield pd.DataFrame({"bin": np.clip(np.floor((s + 1) / 3 * BINS), 0, BINS - 1).astype(np.int64), "s": s, "y": pdf["y"]})

    bins = examples.mapInPandas(place, "bin long, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    model.knots, model.levels = isotonic(*(np.array([r[c] for r in bins], float) for c in ("s", "y", "n")))
    return model


def score_documents(stats: DataFrame, model: KernelRidge) -> DataFrame:
    """Per row of described documents: doc_id, held_out, score, predicted, from its statistics alone.  Repeated rows score
    alike; null and empty texts are scored by their statistics, all 0; no rows give none."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.array(batch.column("stats").to_pylist(), float).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", held_out(3, 1).alias("held_out"), "stats").mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stash(described(table(spark, sf_dir, "documents")), "quality-statistics")
    return score_documents(stats, train(stats, table(spark, sf_dir, "labels")))
