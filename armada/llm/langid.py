"""Language identification by a bidirectional gated recurrent network over bytes.

Method: texts are cut into segments of SEGMENT bytes.  A light gated recurrent unit (update gate, no reset gate) reads each segment forwards, another backwards,
both states together give language probabilities at every byte, and a document's are the mean over all its bytes.  The
network is trained in numpy by backpropagation through time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armada.llm.common import first_by_hash, table, under
from armada.llm.toxicity import held_out

SEGMENT, WIDTH, BLOCK = 64, 8, 1024
LETTER = re.compile(r"[^\W\d_]")


#: Bounds of a unit's two halves: its gate lies in [0, 1], its candidate in [-1, 1] (piecewise linear activations).
LOW = np.array([0.0] * WIDTH + [-1.0] * WIDTH, np.float32)
HIGH = np.ones(2 * WIDTH, np.float32)


def read(x: np.ndarray, table_: np.ndarray, u: np.ndarray, keep: bool = False):
    """States (steps, segments, width) of one direction over bytes x (steps, segments), first to last.

    Gate and candidate come from the byte's row of the table plus the state times u; the gate decides how far the state
    moves to the candidate.  With keep, also what backpropagation needs.
    """
    h, kept = np.zeros((x.shape[1], WIDTH), np.float32), []
    states, s, move = np.empty((len(x), x.shape[1], WIDTH), np.float32), np.empty((x.shape[1], 2 * WIDTH), np.float32), np.empty_like(h)
    for t in range(len(x)):
        np.take(table_, x[t], axis=0, out=s, mode="clip")
        s += h @ u
        if keep:
            open_ = (s > LOW) & (s < HIGH)
        np.maximum(s, LOW, out=s)
        np.minimum(s, HIGH, out=s)
        if keep:
            kept.append((h, s.copy(), open_))
        np.subtract(s[:, WIDTH:], h, out=move)
        move *= s[:, :WIDTH]
        h = np.add(h, move, out=states[t])
    return states, kept


def unread(x: np.ndarray, u: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and of u, by backpropagation through time."""
    d_u, d_h, d_all = np.zeros_like(u), np.zeros((x.shape[1], WIDTH), np.float32), np.empty((*x.shape, 2 * WIDTH), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, s, open_ = kept[t]
        z, n = s[:, :WIDTH], s[:, WIDTH:]
        d = d_h + d_states[t]
        d_s = np.concatenate([d * (n - h), d * z], axis=1) * open_
        d_u += h.T @ d_s
        d_h = d * (1 - z) + d_s @ u.T
        d_all[t] = d_s
    flat, at = d_all.reshape(-1, 2 * WIDTH), x.reshape(-1)
    return np.stack([np.bincount(at, flat[:, j], 256) for j in range(2 * WIDTH)], axis=1).astype(np.float32), d_u


@dataclass
class Network:
    """params: input table and recurrent matrix of each direction, output matrix, output bias."""

    languages: list[str]
    params: list[np.ndarray]

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities at every byte: (steps, segments, languages)."""
        tf, uf, tb, ub, out, bias = self.params
        forth, _ = read(x, tf, uf)
        back, _ = read(x[::-1], tb, ub)
        p = forth @ out[:WIDTH]
        p += (back @ out[WIDTH:])[::-1]
        p += bias
        np.exp(p, out=p)  # states are in [-1, 1], so nothing overflows
        p /= p @ np.ones((p.shape[-1], 1), np.float32)
        return p

    def documents(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities over all bytes of each text, none left out; NaN for an empty text."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        of, rows, lengths = [], [], []
        for i, b in enumerate(raw):
            n = -(-len(b) // SEGMENT)
            rows.append(b.ljust(n * SEGMENT, b"\0"))
            of += [i] * n
            lengths += [SEGMENT] * (n - 1) + [len(b) - (n - 1) * SEGMENT] * (n > 0)
        x = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, SEGMENT)
        total, of, lengths = np.zeros((len(texts), len(self.languages))), np.array(of, np.int64), np.array(lengths, np.int64)
        for s in range(0, len(x), BLOCK):
            p = self.labels(np.ascontiguousarray(x[s : s + BLOCK].T))
            if (lengths[s : s + BLOCK] < SEGMENT).any():
                p *= (np.arange(SEGMENT)[:, None] < lengths[s : s + BLOCK])[:, :, None]
            np.add.at(total, of[s : s + BLOCK], p.sum(axis=0))
        with np.errstate(invalid="ignore", divide="ignore"):
            return total / np.array([len(b) for b in raw], float)[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean log loss of byte segments x (steps, segments) with labels y over all positions, and its gradients by
    backpropagation through time."""
    tf, uf, tb, ub, out, bias = params
    forth, kept_f = read(x, tf, uf, keep=True)
    back, kept_b = read(x[::-1], tb, ub, keep=True)
    both = np.concatenate([forth, back[::-1]], axis=2)
    d = softmax(both @ out + bias)
    at = np.arange(x.shape[1])
    loss = float(-np.log(d[:, at, y] + 1e-30).mean())
    d[:, at, y] -= 1
    d /= d.shape[0] * d.shape[1]
    d_both = d @ out.T
    return loss, [*unread(x, uf, kept_f, d_both[:, :, :WIDTH]), *unread(x[::-1], ub, kept_b, d_both[::-1, :, WIDTH:]), np.einsum("tbi,tbj->ij", both, d), d.sum(axis=(0, 1))]


def fit(segments: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 260, batch: int = 192, rate: float = 0.02, seed: int = 3) -> Network:
    """Train on byte segments (n, SEGMENT) with a language number each; every position carries the segment's label."""
    rng, k = np.random.default_rng(seed), len(languages)
    shapes = [(256, 2 * WIDTH), (WIDTH, 2 * WIDTH)] * 2 + [(2 * WIDTH, k), (k,)]
    params = [rng.normal(0, 0.3 if len(s) > 1 else 0, s).astype(np.float32) for s in shapes]
    for i in (0, 2):
        params[i][:, :WIDTH] = 0.25 * params[i][:, :WIDTH] + 0.4
    net = Network(languages, params)
    if not len(segments) or k < 2:
        return net
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(segments), batch)
        x, y = np.ascontiguousarray(segments[pick].T), labels[pick]
        grads = gradients(params, x, y)[1]
        now = rate * (1 - step / (steps + 1))
        for p, g, m, s in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g**2 - s)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def train(docs: DataFrame, sample_docs: int = 2400, segments_per_doc: int = 4, per_language: int = 200) -> Network:
    """Learn from text and non-null lang of documents whose crc32(doc_id) mod 4 is not 2.

    The bounded sample: sample_docs documents in the order of a hash of their id, besides the first per_language of each of
    the (at most 64) most frequent languages, so that rare ones are learned; of each segments_per_doc evenly spaced segments,
    cut at character starts.  Of rows that share a doc_id and a language the smallest text is taken.  Only those bytes reach
    the driver.  A language absent from the sample isn't learned.
    """
    usable = docs.where("lang is not null and length(text) > 0").where(~held_out(4, 2))
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = first_by_hash(usable.select("doc_id", "lang"), "doc_id", sample_docs)
    usual = usable.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(64)
    # of a frequent language only ids under a hash bound, several times per_language, are ordered
    some = usable.select("doc_id", "lang").join(F.broadcast(usual), "lang").where(under("doc_id", (4 * per_language + 64) / F.col("count")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    each = some.withColumn("place", place).where(F.col("place") <= per_language)
    ids = ids.unionByName(each.select("doc_id", "lang"))
    ids = ids.distinct()  # at most sample_docs + 64 * per_language rows of an id and a language

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                n = min(segments_per_doc, max(1, len(raw) // SEGMENT))
                for i in range(n):
                    s = max(0, len(raw) - SEGMENT) * i // max(1, n - 1)
                    while s > 0 and raw[s] & 0xC0 == 0x80:
                        s -= 1
                    rows.append((doc, lang, raw[s : s + SEGMENT].ljust(SEGMENT, b"\0")))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "raw"])

    sampled = usable.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sampled.mapInPandas(cut, "doc_id long, lang string, raw binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["raw"])))
    languages = sorted({r["lang"] for r in rows})
    x = np.frombuffer(b"".join(bytes(r["raw"]) for r in rows), np.uint8).reshape(-1, SEGMENT)
    return fit(x, np.array([languages.index(r["lang"]) for r in rows], np.int64), languages)


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, from every byte of its text.

    Null texts and texts without a letter are `und` with score 0; so are all where nothing was learned.  Repeated rows are
    labelled alike; no rows give none; other columns are ignored.  The network has a fixed size.
    """

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                texts = [t or "" for t in part["text"]]
                known = np.array([bool(net.languages) and LETTER.search(t) is not None for t in texts])
                p = net.documents([t if k else "" for t, k in zip(texts, known, strict=True)]) if known.any() else np.zeros((len(texts), 1))
                best = np.where(known, np.nan_to_num(p).argmax(axis=1), 0)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "lang_pred": [net.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], "score": np.where(known, np.clip(np.nan_to_num(p)[np.arange(len(texts)), best], 0, 1), 0.0)})

    return docs.select("doc_id", "text", held_out(4, 2).alias("held_out")).mapInPandas(label, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
