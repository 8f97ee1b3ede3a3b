"""Training-data pipeline over documents: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm.common import WORD, stash, table
from armada.llm.jaccard import similar_texts
from armada.llm.mixing import mix_sources
from armada.llm.packing import pack_documents
from armada.llm.pii import redact
from armada.llm.toxicity import keep_clean, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go.  Null and empty texts stay unless labels say that
    texts without any term are toxic; no documents give none."""
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of copies and near copies the document with the smallest doc_id stays.  Rows that share a doc_id and a
    text count once, whichever of them; rows without doc_id stay."""
    kept = stash(similar_texts(docs).where("doc_id = class_id").select("doc_id").distinct(), "kept")
    named = docs.where("doc_id is not null").join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to the name of their kind.  Every row stays, null and empty texts as they are."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the amount the mix takes of each: left out, whole, repeated, or, at the end of a shard's quota, cut to
    their first words.  Every row is numbered and written first, so rows that share a doc_id or have none are taken each by
    its own amount, and no column name clashes.  Rows without words are left out; no rows give none."""
    number = F.monotonically_increasing_id()
    rows = stash(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), number.alias("number")), "mix-rows")
    taken = mix_sources(rows.select("row.doc_id", "row.text", "row.source", "number"), carry="number").where("taken > 0").select("number", "size", "taken")
    met = rows.join(taken, "number").withColumn("rest", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1, "size"), lambda before: F.col("taken") - before)))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), 1, F.col("rest").cast("int")), " ")
    met = met.select("row", F.when(F.col("rest") < F.col("size"), cut).otherwise(F.col("row.text")).alias("clean"))
    own = {"text": F.col("clean"), **({"n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return met.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, one row a piece; a null or empty text is its end id alone, no documents give none."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", redact_personal_data), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each on the written rows of the one before.  Extra columns of documents pass
    through all stages but the last; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither the trained model nor the tokenizer can be written in SQL; the mixing stage's rows are tested against brute force.
ORACLE_SQL = None
