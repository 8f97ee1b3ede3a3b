"""Fill-in-the-middle by a parallel automaton scan.

Method: one automaton reads a text; its state says whether a line begins here and how much of a sentinel stands before.  A
chunk of a giant text doesn't know the state it is entered in, so it emits a transition function (from every state the one it
is left in) and, for every state, how many lines begin in it.  Both compose associatively, which resolves the state and the
number of lines before each chunk; only the chunks that hold a cut are then searched for its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm.common import partitions, stash, table

#: What marks prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Kinds of characters: any other, end of line, the three of a sentinel.  Only where a sentinel may continue are the last two
#: told from others.
OTHER, NEWLINE, OPEN, LETTER, CLOSE = range(5)
KIND = np.full(128, OTHER, np.int8)
KIND[ord("\n")], KIND[ord("<")], KIND[ord(">")] = NEWLINE, OPEN, CLOSE
KIND[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = LETTER
#: State: 4 inside a line, 0 where one begins, plus how much of a sentinel was read (0 to 2; 3: a whole one, for good).
STATES, INSIDE, FOUND = 8, 4, 3
#: Code points of a chunk; longer texts are giants.
CHUNK = 1 << 16
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string"


def step(state: int, kind: int) -> int:
    read = state % INSIDE
    if read != FOUND:
        read = 1 if kind == OPEN else read + 1 if (read, kind) in ((1, LETTER), (2, CLOSE)) else 0
    return read + (0 if kind == NEWLINE else INSIDE)


NEXT = np.array([[step(s, k) for s in range(STATES)] for k in range(5)], np.int64)
BEGINS = np.array([int(s < INSIDE) for s in range(STATES)], np.int64)


def symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and places (code points) of a text's characters, of each run of others only the first: the rest change nothing."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = KIND[np.minimum(points, 127)]
    before = np.concatenate([[OPEN], kind[:-1]]) if len(kind) else kind
    lone = (kind == LETTER) & (before != OPEN)
    # at its start a chunk may continue what the chunk before has begun
    lone |= (kind == CLOSE) & (before != LETTER) & (np.arange(len(kind)) > 0)
    kind = np.where(lone, OTHER, kind)
    kept = np.flatnonzero((kind != OTHER) | (np.concatenate([[NEWLINE], kind[:-1]]) != OTHER)) if len(kind) else np.empty(0, np.int64)
    return kind[kept], kept


def composed(ends: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition functions (rows of ends) with the lines that begin (rows of begins) composed into one, in pairs."""
    while len(ends) > 1:
        if len(ends) % 2:
            ends, begins = np.vstack([ends, np.arange(STATES)]), np.vstack([begins, np.zeros(STATES, np.int64)])
        first = ends[0::2]
        begins = begins[0::2] + np.take_along_axis(begins[1::2], first, 1)
        ends = np.take_along_axis(ends[1::2], first, 1)
    return (ends[0], begins[0]) if len(ends) else (np.arange(STATES), np.zeros(STATES, np.int64))


def function_of(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return composed(NEXT[kinds], np.broadcast_to(BEGINS, (len(kinds), STATES)))


def line_start(kinds: np.ndarray, places: np.ndarray, state: int, rank: int) -> int:
    """Where, in a chunk entered in a state, the line with this rank (from 0) of those that begin in it begins."""
    at = np.flatnonzero(np.concatenate([[state < INSIDE], kinds[:-1] == NEWLINE]))
    return int(places[at[rank]])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers from the document's id; a missing id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut_ranks(doc_id: int | None, n: int, seed: int) -> tuple[int, int]:
    """After how many of n lines prefix and middle end."""
    first, second = sorted(h % (n + 1) for h in draws(doc_id, seed)[:2])
    return first, second


def form_of(doc_id: int | None, plain: bool, seed: int, rate: int, spm: int) -> str:
    _, _, h3, h4 = draws(doc_id, seed)
    return "plain" if plain or h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"


def assemble(text: str, form: str, a: int, b: int) -> str:
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "plain":
        return text
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    one, _, two = head[len(PREFIX) :].partition(SUFFIX if form == "psm" else PREFIX)
    return one + middle + two if form == "psm" else two + middle + one


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def row_of(doc_id: int | None, text: str, n: int, form: str, a: int, b: int) -> dict:
    out = assemble(text, form, a, b)
    plain = form == "plain"
    return {"doc_id": doc_id, "n": n, "form": form, "prefix_chars": None if plain else a, "middle_chars": None if plain else b - a, "output_sha256": sha(out), "restored_sha256": sha(restore(out, form)), "output": out}


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("output", pa.string())])


def batched(batch: pa.RecordBatch, make) -> Iterator[pa.RecordBatch]:
    """The rows that make gives for the batch's rows, in batches of about 32 MB of text."""
    held, size = [], 0
    for row in batch.to_pylist():
        held.append(make(row))
        size += len(held[-1]["output"])
        if size > 32 << 20:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, SCHEMA)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, chunk: int = CHUNK) -> DataFrame:
    """Per document of docs (doc_id long, text string): doc_id, n, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256 and output, the rearranged text.

    A text has n lines; the cuts are line ends chosen by doc_id and seed, as is the form: plain where the text is empty or
    holds a sentinel, or for all but rate percent; else spm for spm percent, psm for the rest.  Null text: empty.  A null
    doc_id counts as no digits; repeated rows give repeated rows; no rows give none; other columns are ignored.

    Texts of at most chunk code points are read where they are.  Longer ones are written aside and their chunks dealt to all
    tasks; what is gathered for a text is one function a chunk, which Spark's limit of 2 GB a value bounds.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(row: dict) -> dict:
            text = row["text"] or ""
            kinds, places = symbols(text)
            ends, begins = function_of(kinds)
            n = int(begins[0])
            form = form_of(row["doc_id"], not text or ends[0] % INSIDE == FOUND, seed, rate, spm)
            a, b = (0 if r == 0 else len(text) if r == n else line_start(kinds, places, 0, r) for r in cut_ranks(row["doc_id"], n, seed))
            return row_of(row["doc_id"], text, n, form, a, b)

        for batch in batches:
            yield from batched(batch, make)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    return rows.where(~long).mapInArrow(whole, OUT).unionByName(giants(rows.where(long), seed, rate, spm, chunk))


def giants(rows: DataFrame, seed: int, rate: int, spm: int, chunk: int) -> DataFrame:
    """fill_in_middle for texts of several chunks."""
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text"), 256)
    keyed = stash(rows.withColumn("key", key), "giants")
    pieces = keyed.select("key", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{chunk}}}"), F.lit(0))).alias("chunk", "piece"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ends, begins = function_of(symbols(row.pop("piece"))[0])
                out.append(row | {"ends": ends.tolist(), "begins": begins.tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("ends", pa.list_(pa.int64())), ("begins", pa.list_(pa.int64()))]))

    functions = pieces.repartition(partitions(rows.sparkSession), "key", "chunk").mapInArrow(scan, "key string, doc_id long, chunk int, ends array<long>, begins array<long>")
    # repeated rows have one key; of their equal functions one is kept
    lines = functions.groupBy("key", "doc_id").agg(F.array_sort(F.collect_set(F.struct("chunk", "ends", "begins"))).alias("parts"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text: n, form, and for each cut the chunk that holds it, the state that chunk is entered in and the rank there."""
        ask = pa.struct([("cut", pa.int32()), ("chunk", pa.int32()), ("state", pa.int64()), ("rank", pa.int64())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ends, begins = (np.array([p[name] for p in row["parts"]], np.int64) for name in ("ends", "begins"))
                state, before, states, firsts = 0, 0, [], []
                for f, c in zip(ends, begins, strict=True):
                    states.append(state)
                    firsts.append(before)
                    state, before = int(f[state]), before + int(c[state])
                asks = []
                for cut, r in enumerate(cut_ranks(row["doc_id"], before, seed)):
                    if 0 < r < before:
                        # the last chunk before which at most r lines begin; chunks without a line begin are passed over
                        at = int(np.searchsorted(np.array(firsts), r, side="right")) - 1
                        asks.append({"cut": cut, "chunk": at, "state": states[at], "rank": r - firsts[at]})
                    else:
                        asks.append({"cut": cut, "chunk": -1, "state": 0, "rank": r})
                out.append({"key": row["key"], "n": before, "form": form_of(row["doc_id"], state % INSIDE == FOUND, seed, rate, spm), "asks": asks})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("asks", pa.list_(ask))]))

    resolved = stash(lines.mapInArrow(resolve, "key string, n long, form string, asks array<struct<cut:int,chunk:int,state:long,rank:long>>"), "giant-lines")
    asked = resolved.select("key", F.explode("asks").alias("ask")).select("key", "ask.*").where("chunk >= 0")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"key": r["key"], "cut": r["cut"], "place": r["chunk"] * chunk + line_start(*symbols(r["piece"]), r["state"], r["rank"])} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("cut", pa.int32()), ("place", pa.int64())]))

    found = pieces.drop("doc_id").join(asked, ["key", "chunk"]).mapInArrow(select, "key string, cut int, place long")
    places = found.groupBy("key").agg(F.min(F.when(F.col("cut") == 0, F.col("place"))).alias("first"), F.min(F.when(F.col("cut") == 1, F.col("place"))).alias("second"))
    cuts = stash(resolved.select("key", "n", "form", F.expr("filter(asks, x -> x.chunk < 0)").alias("ends")).join(places, "key", "left"), "giant-cuts")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(row: dict) -> dict:
            at = {0: row["first"], 1: row["second"]} | {x["cut"]: 0 if x["rank"] == 0 else len(row["text"]) for x in row["ends"]}
            return row_of(row["doc_id"], row["text"], row["n"], row["form"], at[0], at[1])

        for batch in batches:
            yield from batched(batch, make)

    return keyed.join(cuts, "key").mapInArrow(finish, OUT)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents")).drop("output")
