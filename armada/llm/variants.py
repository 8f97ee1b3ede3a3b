"""Spelling variants grouped without pairs.

Method: a word with one place left open, (position, prefix, suffix), is the key of a wildcard group; its words differ from each
other in exactly that place.  A group keeps its size and its two most frequent words, from which each of its words takes how
many others there are and the best of them.  Words that differ by an insertion meet where the longer one's deletions are joined
to the vocabulary.  What groups and joins say of a word is summed up, so no group's pairs are ever made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm.common import stash, table

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Distinct words a task holds before it sends their counts.
HELD = 200_000
#: Stands for the open place; no word holds it.
OPEN = "*"


def vocabulary(docs: DataFrame, least_chars: int = 6, least_n: int = 5, damage: int = 199) -> DataFrame:
    """word and n: how often each word occurs in all texts of docs (doc_id long, text string).

    Words are the maximal runs of Latin letters, in lower case; of every damage-th run by a checksum of its document's id and
    itself a letter goes.  Words of fewer than least_chars code points or least_n occurrences don't count.  Null text: no
    words; a null doc_id counts as no digits; repeated rows count each; no rows give none; other columns are ignored.
    """
    run = re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(run.findall((text.as_py() or "").translate(LOWER))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_chars:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield send()
                    held.clear()
        if held:
            yield send()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def without(i):
    """Column: the word without its code point at i (from 1)."""
    return F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word")))


def near(words: DataFrame) -> DataFrame:
    """Per word of words (word, n) that has any: n_near, how many differ from it by one inserted, deleted or replaced code
    point, and best, the most frequent of them as (-n, word).

    A wildcard group has at most one word a letter of the alphabet, so its two best are taken from a short sorted list.  A
    longer word's deletions count once each, also where a letter repeats.
    """
    places = F.sequence(F.lit(1), F.length("word"))
    holes = F.transform(places, lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.lit(OPEN), F.substring(F.col("word"), i + 1, F.length("word"))))
    own = F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"))
    groups = words.select(F.explode(holes).alias("hole"), own.alias("own")).groupBy("hole").agg(F.array_sort(F.collect_list("own")).alias("all")).where(F.size("all") > 1)
    groups = groups.select(F.size("all").alias("size"), F.get("all", 0).alias("top"), F.get("all", 1).alias("next"), F.explode("all").alias("own"))
    replaced = groups.select(F.col("own.form").alias("word"), (F.col("size") - 1).cast("long").alias("near"), F.when(F.col("own") == F.col("top"), F.col("next")).otherwise(F.col("top")).alias("best"))
    deletions = words.select(own.alias("long"), F.explode(F.array_distinct(F.transform(places, without))).alias("word"))
    met = deletions.join(words, "word").select("long", own.alias("short"))
    ends = F.array(F.struct(F.col("long.form").alias("word"), F.col("short").alias("best")), F.struct(F.col("short.form").alias("word"), F.col("long").alias("best")))
    moved = met.select(F.explode(ends).alias("x")).select("x.word", F.lit(1).cast("long").alias("near"), "x.best")
    return replaced.unionByName(moved).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for forms (word, form), form never null: where following forms ends, by steps that double.  A form is
    several times as frequent as its word, so there are no circles and few steps."""
    found = stash(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = stash(found.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if found.where("moved").isEmpty():
            return found.select("word", "root")
        found = found.drop("moved")


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Per word of words (word, n; each word once): word, form, root, n, n_near, form_n.

    form is the most frequent near word (ties: the smallest) if it is at least ratio times as frequent, else null; root is
    where forms lead to, the word itself without one.  No words give no rows.
    """
    words = stash(words.select("word", "n"), "vocabulary")
    best = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    known = stash(words.join(near(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best.alias("best")), "near-words")
    led = roots(known.where("best is not null").select("word", F.col("best.form").alias("form")))
    return known.join(led, "word", "left").select("word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.less")).alias("form_n"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(table(spark, sf_dir, "documents")))
