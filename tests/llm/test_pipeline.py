"""The pipeline's stages on a small corpus."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from armada.llm.common import WORD
from armada.llm.jaccard import similar_texts
from armada.llm.mixing import mix_sources
from tests.llm.test_operators import SCHEMA, cases


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(cases(), SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(c[0], 1, 0) for c in cases()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == docs.count()
    single = pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    kept = {r["doc_id"] for r in single.collect()}
    assert single.columns == docs.columns and 0 in kept and not kept & {72, 75}
    redacted = pipeline.redact_personal_data(spark, docs, str(tmp_path))
    assert redacted.columns == docs.columns and redacted.count() == docs.count()
    mixed = pipeline.mix(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    out = pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_mixed_rows_equal_brute_force(spark):
    docs = spark.createDataFrame(cases(), SCHEMA)
    amounts = {r["doc_id"]: r["taken"] for r in mix_sources(docs).collect()}
    want = []
    for row in cases():
        words, rest = re.findall(WORD, row[1] or ""), amounts[row[0]]
        while rest > 0:
            text = row[1] if rest >= len(words) else " ".join(words[:rest])
            want.append((row[0], text, *row[2:4], len(text), *row[5:]))
            rest -= len(words)
    assert len(want) > 0 and Counter(map(tuple, pipeline.mix(spark, docs, "").collect())) == Counter(want)


def test_repeated_and_missing_ids(spark):
    """Rows that share a doc_id or have none, repeated rows, and columns with the names used inside."""
    text = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(1, text(1, 30)), (1, text(2, 50)), (1, text(2, 50)), (None, text(3, 40)), (None, text(3, 40) + " more"), (None, None), (2, text(3, 40) + " end mail a.b@c.org")]
    docs = spark.createDataFrame([(*r, "s", i, i, i, i, i, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, row int, number int, rest int, clean int, found int, spans int")
    amounts = Counter()
    for r in mix_sources(docs, carry="number").collect():
        amounts[r["number"]] += r["taken"]
    got = Counter()
    for r in pipeline.mix(spark, docs, "").collect():
        assert r["number"] == r["row"] == r["rest"] == r["clean"] and r["text"].split() == rows[r["number"]][1].split()[: len(r["text"].split())]
        got[r["number"]] += len(r["text"].split())
    assert got == +amounts
    clean = {r["row"]: r["text"] for r in pipeline.redact_personal_data(spark, docs, "").collect()}
    assert len(clean) == len(rows) and clean[6].endswith("<email>") and clean[5] is None and clean[0] == rows[0][1]
    classes = similar_texts(docs).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["n_links"], r["n_copies"]) for r in classes if r["class_id"] is not None) == [(0, 2, 2, 1), (0, 2, 2, 1), (1, 1, 0, 1), (1, 1, 0, 2), (1, 1, 0, 2), (2, 2, 2, 1)]
    kept = pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 0, 0, 1, 1, 2]


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
