"""Removal of repeated passages by a log-structured index of window fingerprints.

Method: every window of 13 words has a 64-bit fingerprint.  The index is a set of immutable runs in the shared folder; a run
holds sorted fingerprints by bucket (a range of fingerprints).  A new batch of documents is brought to the buckets as sorted
blocks, merge-joined there with the runs and with its own earlier documents, verified by a code from a second hash, and what
was new becomes another run.  Once there are more than fan_out runs they are merged into one (compaction).  Buckets and the
chunks of documents grow in number with the corpus, so that what a task holds of either doesn't grow.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm.common import fresh_path, partitions, range_bounds, range_index, stash, table, window_hashes, word_hashes

WINDOW = 13
SECOND = 0xD6E8FEB86659FD93
#: Windows a mapper gathers before it sends sorted blocks to the buckets.
GATHER = 1 << 20
#: To how many buckets a gathering is dealt at once, and the most cut points between doc_ids that the driver holds.
FAN = 1 << 14
#: Likelihood of any false match in the whole corpus that the width of the verification codes is chosen for.
FALSE_MATCH = 1e-3
BLOCK = "bucket int, chunk int, n int, prints binary, codes binary, docs binary, ids binary"
RUN = "bucket int, n int, prints binary, codes binary"


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers as compressed bytes, by byte plane; ascending ones as differences."""
    if ascending and len(values):
        values = np.diff(values, prepend=values[:1] * 0)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def unpack(blob: bytes, dtype, ascending: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(blob)), np.uint8)
    values = np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if ascending else values


class Prints:
    """Fingerprints of windows, with a verification code of code_bytes bytes (0, 1, 2, 4 or 8)."""

    def __init__(self, code_bytes: int):
        self.dtype = np.dtype(f"u{code_bytes}") if code_bytes else None

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = window_hashes(words, WINDOW)
        return h, window_hashes(words, WINDOW, SECOND).astype(self.dtype) if self.dtype else np.zeros(len(h), np.uint8)

    def pack(self, codes: np.ndarray) -> bytes:
        return pack(codes) if self.dtype else b""

    def unpack(self, blob: bytes, n: int) -> np.ndarray:
        return unpack(blob, self.dtype) if self.dtype else np.zeros(n, np.uint8)


def member(h: np.ndarray, c: np.ndarray, of_h: np.ndarray, of_c: np.ndarray) -> np.ndarray:
    """Which (h, c) occur in the sorted (of_h, of_c); a fingerprint may stand there with several codes."""
    out, at = np.zeros(len(h), bool), np.searchsorted(of_h, h)
    while True:
        near = np.minimum(at, max(0, len(of_h) - 1))
        same = (at < len(of_h)) & (of_h[near] == h if len(of_h) else False)
        out |= same & (of_c[near] == c if len(of_c) else False)
        if not (same & ~out).any():
            return out
        at = at + 1


def code_width(windows: float) -> int:
    """Bytes of a verification code that keep any false match among so many windows less likely than FALSE_MATCH, at most 8."""
    return next((c for c in (1, 2, 4) if windows**2 / 2 ** (65 + 8 * c) < FALSE_MATCH), 8)


def tasks(spark: SparkSession, groups: int) -> int:
    """A task for each group; very many groups share tasks, whose number still grows with theirs."""
    return max(partitions(spark), min(groups, FAN), groups >> 8)


class Chunks:
    """Numbered ranges of doc_ids with about equal numbers of rows: cut points bound ranges, each of so many equally wide parts."""

    def __init__(self, bounds: list[int], low: int, high: int, parts: int):
        self.bounds, self.parts, self.count = bounds, parts, (len(bounds) + 1) * parts
        edges = [float(x) for x in (low, *bounds, high + 1)]
        self.lows, self.widths = edges[:-1], [max(1.0, b - a) for a, b in itertools.pairwise(edges)]

    def of(self, d: np.ndarray) -> np.ndarray:
        at = np.searchsorted(np.array(self.bounds, np.int64), d, side="right")
        part = np.floor((d.astype(float) - np.array(self.lows)[at]) / np.array(self.widths)[at] * self.parts)
        return at * self.parts + np.clip(part, 0, self.parts - 1).astype(np.int64)

    def column(self, key: str) -> Column:
        at = range_index(key, self.bounds)
        if self.parts == 1:
            return at
        low, width = (F.get(F.array(*map(F.lit, x)), at) for x in (self.lows, self.widths))
        part = F.floor((F.col(key).cast("double") - low) / width * self.parts)
        return (at * self.parts + F.least(F.greatest(part, F.lit(0)), F.lit(self.parts - 1))).cast("int")


def by_chunk(h: np.ndarray, c: np.ndarray, d: np.ndarray, chunks: Chunks, prints: Prints) -> Iterator[tuple]:
    """Hits (fingerprint, code, document) as rows (chunk, chunk, n, prints, codes, docs, ids): a chunk is a range of doc_ids."""
    chunk = chunks.of(d)
    order = np.lexsort((h, chunk))
    h, c, d, chunk = h[order], c[order], d[order], chunk[order]
    for k in np.unique(chunk):
        i, j = np.searchsorted(chunk, k), np.searchsorted(chunk, k, side="right")
        ids, number = np.unique(d[i:j], return_inverse=True)
        yield int(k), int(k), int(j - i), pack(h[i:j], True), prints.pack(c[i:j]), pack(number.astype(np.uint32)), ids.astype("<i8").tobytes()


class FingerprintIndex:
    """The runs below one path.  Buckets are fixed for the life of an index."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, code_bytes: int = 1, fan_out: int = 4, fan: int = FAN):
        self.spark, self.path, self.buckets, self.prints, self.fan_out, self.fan = spark, path, buckets, Prints(code_bytes), fan_out, fan
        self.tasks = tasks(spark, buckets)
        self.runs: list[str] = []
        self.batches = 0

    def blocks(self, docs: DataFrame, chunks: Chunks) -> DataFrame:
        """Sorted blocks of the windows of docs (doc_id, text): a window once for each gathering, with its smallest doc_id.

        Of a window in several documents of a gathering the later ones are hits already.  They travel as such, by chunk, so
        that a passage which very many documents share meets in its bucket once for each gathering only.  A gathering is dealt
        to at most fan buckets, as blocks of a few windows would cost more than their windows: where there are more buckets,
        blocks are gathered again within these wide ones, and dealt to fan times as many, until there are enough."""
        prints, buckets = self.prints, self.buckets

        def sends(parts: Iterator[tuple], wide: int) -> Iterator[pd.DataFrame]:
            """Blocks and hits of windows (h, c, d), in gatherings of about GATHER windows."""
            held, size = [], 0

            def send() -> pd.DataFrame:
                h, c, d = (np.concatenate([x[i] for x in held]) for i in range(3))
                order = np.lexsort((d, c, h))
                h, c, d = h[order], c[order], d[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                later = ~first & np.concatenate([[False], d[1:] != d[:-1]])
                rows = [(int(k) % buckets, *hit) for k, *hit in by_chunk(h[later], c[later], d[later], chunks, prints)]
                h, c, d = h[first], c[first], d[first]
                bucket = ((h >> np.uint64(33)) * np.uint64(wide) >> np.uint64(31)).astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                for i, j in zip(cut, [*cut[1:], len(h)], strict=True):
                    ids, number = np.unique(d[i:j], return_inverse=True)
                    rows.append((int(bucket[i]), -1, int(j - i), pack(h[i:j], True), prints.pack(c[i:j]), pack(number.astype(np.uint32)), ids.astype("<i8").tobytes()))
                return pd.DataFrame(rows, columns=["bucket", "chunk", "n", "prints", "codes", "docs", "ids"])

            for part in parts:
                held.append(part)
                size += len(part[0])
                if size >= GATHER or len(held) >= 1 << 15:
                    yield send()
                    held, size = [], 0
            if held:
                yield send()

        def gather(batches: Iterator[pd.DataFrame], wide: int) -> Iterator[pd.DataFrame]:
            def parts() -> Iterator[tuple]:
                for pdf in batches:
                    for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                        h, c = prints.of(word_hashes(text))
                        if len(h):
                            yield h, c, np.full(len(h), doc, np.int64)

            return sends(parts(), wide)

        def again(batches: Iterator[pd.DataFrame], wide: int) -> Iterator[pd.DataFrame]:
            blocks = (r for pdf in batches for r in pdf.itertuples())
            return sends(((unpack(r.prints, np.uint64, True), prints.unpack(r.codes, r.n), np.frombuffer(r.ids, "<i8")[unpack(r.docs, np.uint32)]) for r in blocks), wide)

        wide = min(buckets, self.fan)
        rows = docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(partial(gather, wide=wide), BLOCK)
        while wide < buckets:
            dealt, near, wide = stash(rows, "blocks"), tasks(self.spark, wide), min(buckets, wide * self.fan)
            finer = dealt.where("chunk < 0").repartition(near, "bucket").sortWithinPartitions("bucket").mapInPandas(partial(again, wide=wide), BLOCK)
            rows = dealt.where("chunk >= 0").unionByName(finer)
        return rows

    def join(self, docs: DataFrame, chunks: Chunks, keep: bool) -> DataFrame:
        """Hits of a batch: (chunk, doc_id, prints, codes) - for a document the windows that start in a smaller doc_id, in the
        runs or in the batch.  All documents of earlier batches must have smaller doc_ids.  keep: what is new becomes a run."""
        prints = self.prints

        def merge(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            runs = [(unpack(p, np.uint64, True), prints.unpack(c, n)) for p, c, n in zip(old["prints"], old["codes"], old["n"], strict=True)]
            old_h, old_c = (np.concatenate([r[i] for r in runs]) if runs else np.empty(0, np.uint64) for i in range(2))
            order = np.lexsort((old_c, old_h))
            old_h, old_c = old_h[order], old_c[order]
            columns = ["bucket", "chunk", "n", "prints", "codes", "docs", "ids"]
            passed = new.loc[new["chunk"] >= 0, columns].assign(bucket=int(key[0]))  # hits already
            new = new[new["chunk"] < 0]
            parts = [(unpack(r.prints, np.uint64, True), prints.unpack(r.codes, r.n), np.frombuffer(r.ids, "<i8")[unpack(r.docs, np.uint32)]) for r in new.itertuples()]
            h, c, d = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint64) for i in range(3))
            del parts
            order = np.lexsort((d.astype(np.int64), c, h))
            h, c, d = h[order], c[order], d[order].astype(np.int64)
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            least = d[first][np.cumsum(first) - 1] if len(h) else d
            known = member(h[first], c[first], old_h, old_c)
            hit = (known[np.cumsum(first) - 1] if len(h) else first) | (d > least)
            rows = [(int(key[0]), *row[1:]) for row in by_chunk(h[hit], c[hit], d[hit], chunks, prints)]
            fresh = np.flatnonzero(first)[~known]
            if keep and len(fresh):
                rows.append((int(key[0]), -1, len(fresh), pack(h[fresh], True), prints.pack(c[fresh]), None, None))
            return pd.concat([pd.DataFrame(rows, columns=columns), passed], ignore_index=True)

        blocks, runs, n = self.blocks(docs, chunks), self.read_runs(), self.tasks
        found = blocks.repartition(n, "bucket").groupBy("bucket").cogroup(runs.repartition(n, "bucket").groupBy("bucket")).applyInPandas(merge, BLOCK)
        path = f"{self.path}/run-{self.batches}"
        self.batches += 1
        found.write.option("compression", "none").parquet(path)
        if keep:
            self.runs.append(path)
            self.compact()
        return self.spark.read.parquet(path).where("chunk >= 0")

    def read_runs(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.parquet(*self.runs).where("chunk = -1").select("bucket", "n", "prints", "codes")

    def compact(self) -> None:
        """Merge all runs into one once there are more than fan_out; the files of the old ones stay, for readers of their hits."""
        if len(self.runs) <= self.fan_out:
            return
        prints = self.prints

        def merge(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
            parts = [(unpack(r.prints, np.uint64, True), prints.unpack(r.codes, r.n)) for r in runs.itertuples()]
            h, c = (np.concatenate([p[i] for p in parts]) for i in range(2))
            order = np.lexsort((c, h))
            return pd.DataFrame([(int(key[0]), -1, len(h), pack(h[order], True), prints.pack(c[order]))], columns=["bucket", "chunk", "n", "prints", "codes"])

        path = f"{self.path}/compacted-{self.batches}"
        self.read_runs().repartition(self.tasks, "bucket").groupBy("bucket").applyInPandas(merge, "bucket int, chunk int, n int, prints binary, codes binary").write.option("compression", "none").parquet(path)
        self.runs = [path]


def remove_repeats(docs: DataFrame, batches: int = 2, chunk_rows: int = 1500, code_bytes: int | None = None, path: str | None = None, fan: int = FAN) -> DataFrame:
    """Per document of docs (doc_id long, text string): doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window of 13 words over it also starts, word for word, in a document with a smaller doc_id; windows are
    judged on the input.  batches: the documents are deduplicated in that many batches of ascending doc_id against the runs
    of the batches before.  Null text: no words.  Texts under 13 words and rows without doc_id keep all; rows with the same
    doc_id don't count against each other; no rows give none; other columns are ignored.  code_bytes: the width of the
    verification codes (0, 1, 2, 4 or 8); by default it follows from the bytes of all texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = docs.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(F.octet_length("text")).alias("size")).first()
    wanted = max(1, -(-seen["n"] // chunk_rows))
    bounds = range_bounds(docs, "doc_id", min(wanted, fan))
    chunks = Chunks(bounds, seen["low"] or 0, seen["high"] or 0, -(-wanted // fan))
    # a word takes two bytes with what separates it
    width = code_bytes if code_bytes is not None else code_width((seen["size"] or 0) / 2)
    index = FingerprintIndex(spark, path or fresh_path(spark, "window-index"), max(partitions(spark), chunks.count), width, fan=fan)
    prints, steps = index.prints, max(1, min(batches, len(bounds) + 1))
    edges = [(len(bounds) + 1) * i // steps for i in range(steps + 1)]
    hits = None
    for i in range(steps):
        own = docs
        if edges[i] > 0:
            own = own.where(F.col("doc_id") >= bounds[edges[i] - 1])
        if edges[i + 1] <= len(bounds):
            own = own.where(F.col("doc_id") < bounds[edges[i + 1] - 1])
        found = index.join(own, chunks, keep=i + 1 < steps).select("chunk", "n", "prints", "codes", "docs", "ids")
        hits = found if hits is None else hits.unionByName(found)

    def remove(key: tuple, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.frombuffer(r.ids, "<i8")[unpack(r.docs, np.uint32)], unpack(r.prints, np.uint64, True), prints.unpack(r.codes, r.n)) for r in found.itertuples()]
        d, h, c = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(3))
        order = np.lexsort((c, h, d))
        d, h, c = d[order], h[order], c[order]
        rows = []
        for doc, text in zip(texts["doc_id"], texts["text"], strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            drop = np.zeros(len(words), bool)
            a, b = (np.searchsorted(d, doc, side) for side in ("left", "right")) if not pd.isna(doc) else (0, 0)
            if b > a and len(words) >= WINDOW:
                hit = member(*prints.of(word_hashes(text)), h[a:b], c[a:b])
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, np.flatnonzero(hit), 1)
                np.add.at(cover, np.flatnonzero(hit) + WINDOW, -1)
                drop = np.cumsum(cover[:-1]) > 0
            kept = b" ".join(itertools.compress(words, ~drop) if drop.any() else words)
            rows.append((doc, len(words), int(drop.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    n = tasks(spark, chunks.count)
    # rows without doc_id have no hits; they are spread by their text
    placed = docs.withColumn("chunk", F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(chunks.count)).cast("int")).otherwise(chunks.column("doc_id")))
    return placed.repartition(n, "chunk").groupBy("chunk").cogroup(hits.repartition(n, "chunk").groupBy("chunk")).applyInPandas(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
