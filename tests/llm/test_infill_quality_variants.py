"""Cuts for infilling, quality and spelling variants against brute force, with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from armada.llm import infill, quality, variants
from tests.llm.test_operators import SCHEMA, cases, sentence


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lined(doc, text):
    """What the contract says of one document, by regular expressions over the whole text."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or re.search("<[PSM]>", text):
        form, out = "plain", text
    elif h4 % 100 < 50:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, n, form, None if form == "plain" else len(prefix), None if form == "plain" else len(middle), sha(out), sha(text))


def texts_with_marks():
    rng = random.Random(21)
    parts = ["a", "é漢", "\n", "\n", "\n\n", "<", "P", "S>", "M", ">", "<P", "<", "<S", "word 12", "𝄞"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(160)] + ["<P>", "x<M>", "<<S>", "<P\n>", "\n", "a\n", "a\nb", "<S" * 30, "\n" * 50, "x" * 77]


@pytest.mark.parametrize("chunk", [1 << 16, 7, 3, 1])
def test_cuts_equal_brute_force(spark, chunk):
    """Chunks of a few characters split lines and sentinels everywhere."""
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts_with_marks())] + [(1, None), (2, "twice\nover\n"), (2, "twice\nover\n"), (2, "other\nlines")]
    got = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).drop("output").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(lined(*r)) for r in rows)


def test_cuts_of_the_shared_cases(docs, none):
    got = infill.fill_in_middle(docs, chunk=4096).collect()
    assert sorted(tuple(r)[:-1] for r in got) == sorted(lined(c[0], c[1]) for c in cases())
    assert all(hashlib.sha256(r["output"].encode()).hexdigest() == r["output_sha256"] for r in got)
    assert infill.fill_in_middle(none).count() == 0


def test_every_form_is_undone():
    for form in ("plain", "psm", "spm"):
        for text, a, b in (("one\ntwo\nthree", 4, 8), ("x\n<", 2, 2), ("\n\n", 0, 2), ("a<\n>b", 0, 5)):
            assert infill.restore(infill.assemble(text, form, a, b), form) == text


def test_functions_compose_as_one_scan():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 64, 301):
        kinds = rng.integers(0, 5, n)
        ends, begins = infill.function_of(kinds)
        for s in range(infill.STATES):
            state, count = s, 0
            for k in kinds:
                count += infill.BEGINS[state]
                state = infill.step(state, k)
            assert (ends[s], begins[s]) == (state, count)


def test_rates_of_forms(spark):
    rows = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(400)], "doc_id long, text string")
    forms = lambda **k: [r["form"] for r in infill.fill_in_middle(rows, **k).select("form").collect()]
    assert set(forms(rate=0)) == {"plain"} and set(forms(spm=100)) == {"spm"} and 100 < forms(rate=50).count("plain") < 300


# --- quality ---------------------------------------------------------------------------------------------------------


def test_quality_learns_shapes_of_text(spark, none):
    rng = random.Random(31)
    rows, labels = [], []
    for i in range(900):
        text, good = sentence(rng, rng.randrange(20, 200)), i % 4 != 0
        if not good:
            text = [text.upper() + "!!!", " ".join(w + "$$$" for w in text.split()), " ".join(text.split()[:1] * 60)][i // 4 % 3]
        rows.append((i, text, 1, 2, 3))
        labels.append((i, int(good), 0))
    d = spark.createDataFrame(rows, "doc_id long, text string, stats int, y int, fold int")
    stats = quality.described(d)
    model = quality.train(stats, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r["doc_id"]: r for r in quality.score_documents(stats, model).collect()}
    assert len(out) == 900 and all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in out)
    held = [r for r in out.values() if r["held_out"]]
    assert np.mean([r["predicted"] == labels[r["doc_id"]][1] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    # held-out labels are no part of the model
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 0) for i, q, _ in labels]
    again = quality.train(stats, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert np.allclose(model.weights, again.weights) and np.allclose(model.levels, again.levels)


def test_quality_of_odd_rows(spark, docs, none):
    lab = spark.createDataFrame([(c[0], i % 2, 0) for i, c in enumerate(cases())] + [(0, 1, 0), (0, 0, 0), (None, 1, 0), (3, 7, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    rows = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 3").selectExpr("cast(null as long) doc_id", *[c for c in docs.columns if c != "doc_id"]))
    stats = quality.described(rows)
    out = quality.score_documents(stats, quality.train(stats, lab)).collect()
    assert len(out) == len(cases()) + 2 and all(0 <= r["score"] <= 1 for r in out)
    same = {r["score"] for r in out if r["doc_id"] == 0}
    assert len(same) == 1 and [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    empty = quality.described(none)
    model = quality.train(empty, lab.limit(0))
    assert quality.score_documents(empty, model).count() == 0
    assert {r["score"] for r in quality.score_documents(quality.described(docs), model).collect()} == {0.5}


def test_sums_over_partitions_are_the_normal_equations(spark):
    rng = np.random.default_rng(5)
    stats = rng.normal(size=(300, len(quality.NAMES)))
    y = (stats[:, 0] * stats[:, 1] > 0).astype(int)
    rows = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(stats)], "doc_id long, stats array<double>").repartition(7)
    lab = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality.train(rows, lab, features=40)
    used = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in range(300)])
    z = model.features(stats)[used]
    fits = [np.linalg.solve(z.T @ z + 10.0**-e * used.sum() * np.diag([1.0] * 40 + [0.0]), z.T @ y[used]) for e in range(2, 8)]
    assert any(np.allclose(model.weights, w, atol=1e-6) for w in fits)


def test_isotonic_levels_never_fall():
    rng = np.random.default_rng(6)
    n = rng.integers(1, 20, 200).astype(float)
    ones = np.minimum(n, np.floor(n * np.clip(np.linspace(0, 1, 200) + rng.normal(0, 0.3, 200), 0, 1)))
    knots, levels = quality.isotonic(np.arange(200.0), ones, n)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    # the defining property: a level is the largest over starts of the least mean over ends
    at = np.searchsorted(knots, 100.0)
    mean = lambda i, j: ones[i : j + 1].sum() / n[i : j + 1].sum()
    want = max(min(mean(i, j) for j in range(100, 200)) for i in range(101))
    assert min(abs(levels[max(0, at - 1) : at + 1] - want)) < 1e-12


# --- spelling variants -----------------------------------------------------------------------------------------------


def brute_words(rows):
    counts = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_variants(n):
    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if close(w, v)] for w in n}
    form = {w: v if vs and n[v := min(vs, key=lambda v: (-n[v], v))] >= 5 * n[w] else None for w, vs in near.items()}
    root = {}
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return {w: (form[w], root[w], n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def misspelt(rng, word):
    i, c = rng.randrange(len(word)), rng.choice("abeé")
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]])


def test_variants_equal_brute_force(spark, none):
    rng = random.Random(41)
    base = ["aabbccd", "station", "mountain", "übergröße", "ÀÉÎõüÿ", "lettter"]
    rows = []
    for i in range(120):
        words = []
        for w in rng.choices(base, k=40):
            while rng.random() < 0.35:
                w = misspelt(rng, w)
            words.append(rng.choice([w, w.title(), w.upper()]) if w.isascii() else w)
        rows.append((i if i % 7 else None, " ".join(words) + ", short x1longer_words" * 3))
    rows += [(5, None), (6, ""), (7, "station"), (7, "station"), (8, "a" * 3000 + " " + "mountain " * 500)]
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, word int, n int, hole int").repartition(3)
    counted = {r["word"]: r["n"] for r in variants.vocabulary(d).collect()}
    want = brute_words(rows)
    assert counted == want and len(want) > 40
    got = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in variants.group_variants(variants.vocabulary(d)).collect()}
    assert got == brute_variants(want)
    assert variants.group_variants(variants.vocabulary(none)).count() == 0


def test_forms_lead_on_and_ties_fall_to_the_smaller(spark):
    n = {"abcdef": 10, "abcdefg": 60, "abcdefgh": 400, "abcdxf": 10, "zzzzzz": 50, "zzzzza": 300, "zzzzzb": 300, "aaaaaa": 7, "aaaaaaa": 35}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == brute_variants(n)
    assert got["abcdef"][:2] == ("abcdefg", "abcdefgh") and got["zzzzzz"][0] == "zzzzza" and got["aaaaaa"][:2] == ("aaaaaaa", "aaaaaaa")


def test_long_chains_of_forms(spark):
    word, n = "a" * 6, {}
    for i in range(12):
        n[word] = 5 * 6**i
        word += "b"
    got = {r["word"]: r["root"] for r in variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 6 + "b" * 11}
