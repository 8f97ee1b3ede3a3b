"""Personal data by weak supervision, in DataFrame expressions only.

Method: patterns propose candidate spans.  Four labelers (pattern checks, gazetteers, words of the context, word boundaries)
each vote for or against a span or abstain.  Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is, without labels, and gives soft labels; on these a naive Bayes span classifier is trained, which decides over
the candidates beyond the base rules.  Spans of the base rules always stay.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm.common import let, running, stash, table

#: Base kinds, in the order of their contract, with patterns equal to the plain ones but free of backtracking: a run is only
#: entered at its start or where the match before ended (\G), and repeats are possessive.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates beyond the base rules.
MORE = {
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z])",
    "id_number": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
KINDS = [*BASE, *MORE]
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Gazetteers (fixed values): top-level domains, issuer prefixes, reserved address blocks.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|it|nl|ch|at)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
RESERVED = r"^0*(?:0|127|255)\."
FOR_CUES = r"(?i)(?:mail|contact|phone|tel|call|fax|card|visa|account|address|host|server|token|secret|key|password|ssn|social|write to)[^A-Za-z0-9]{0,4}(?:is|at|to|no|number)?[^A-Za-z0-9]{0,4}$"
AGAINST_CUES = r"(?i)(?:version|isbn|issn|figure|section|chapter|page|total|order|item|part|serial|build)[^A-Za-z0-9]{0,4}$"
LABELERS = ("check", "gazetteer", "context", "edges")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) + 1 - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def passes(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.length(digits(s)).between(13, 19) & luhn(digits(s))
    if kind == "phone":
        return F.length(digits(s)).between(9, 15)
    return F.lit(True)


def gazetteer(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.when(s.rlike(DOMAINS), 1).otherwise(0)
    if kind == "ip":
        return F.when(s.rlike(RESERVED), -1).otherwise(1)
    if kind == "card":
        return F.when(digits(s).rlike(ISSUERS), 1).otherwise(-1)
    if kind == "id_number":
        return F.when(s.rlike(r"^(?:000|666|9)"), -1).otherwise(1)
    return F.lit(0)


def spans_of(text: Column, kind: str) -> Column:
    """All candidate spans of a kind in a text, with their votes.  Running sums over matches and the text between them give
    their places; their context is cut from these pieces, as a search from the text's start for each would take quadratic time."""
    pattern = (BASE | MORE)[kind]
    matches, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def votes(zipped: Column, ends: Column, x: Column, i: Column) -> Column:
        s, end = x["matches"], F.get(ends, i)
        last, next_ = F.get(zipped, i - 1), F.get(zipped, i + 1)
        before = F.concat(F.coalesce(F.right(last["parts"], F.lit(32)), F.lit("")), F.coalesce(F.right(last["matches"], F.lit(32)), F.lit("")), F.right(x["parts"], F.lit(32)))
        before = F.right(before, F.lit(32))
        # the part after the last match has no match of its own
        after = F.left(F.concat(F.left(next_["parts"], F.lit(1)), F.coalesce(F.left(next_["matches"], F.lit(1)), F.lit(""))), F.lit(1))
        fine = passes(kind, s)
        check = F.when(fine, 1).otherwise(-1)
        context = F.when(before.rlike(FOR_CUES), 1).when(before.rlike(AGAINST_CUES), -1).otherwise(0)
        edges = F.when(before.rlike("[A-Za-z0-9]$") | after.rlike("[A-Za-z0-9]"), -1).otherwise(1)
        start, size = end - F.length(s), F.length(s)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), (fine & F.lit(kind in BASE)).alias("base"), check.alias("check"), gazetteer(kind, s).alias("gazetteer"), context.alias("context"), edges.alias("edges"), F.least(F.lit(7), F.floor(size / 8)).cast("int").alias("length"))

    def placed(zipped: Column) -> Column:
        sizes = F.transform(zipped, lambda x: F.length(x["parts"]) + F.coalesce(F.length(x["matches"]), F.lit(0)))
        # digits alone are dropped before they are judged where only long numbers count
        wanted = (lambda x: x["matches"].isNotNull() & F.length(digits(x["matches"])).between(13, 19)) if kind == "card" else (lambda x: x["matches"].isNotNull())
        return let(running(sizes, lambda x, y: x + F.coalesce(y, F.lit(0))), lambda ends: F.filter(F.transform(zipped, lambda x, i: F.when(wanted(x), votes(zipped, ends, x, i))), lambda x: x.isNotNull()))

    found = let(F.arrays_zip(parts.alias("parts"), matches.alias("matches")), placed)
    sure = {"email": "@", "phone": "+"}.get(kind)
    none = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,check:int,gazetteer:int,context:int,edges:int,length:int>>")
    # a cheap test that no match of the pattern fails: each form of a secret has its own
    has = F.contains(text, F.lit(sure)) if sure else text.rlike("[0-9a-fA-F]{32}|AKIA|gh[pousr]_" if kind == "secret" else "[0-9]")
    return F.when(has, found).otherwise(none)


def candidates(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[spans_of(text, kind) for kind in KINDS])


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = 40) -> tuple[dict[tuple[int, ...], float], list[dict]]:
    """Expectation-maximisation over vote patterns (one vote a labeler) with their counts: the probability that a pattern is
    personal data, and for each labeler the probability of each vote given no and yes.  At most 3 ** labelers patterns."""
    post = {p: 0.95 if sum(p) > 0 else 0.05 if sum(p) < 0 else 0.5 for p in counts}
    rates: list[dict] = []
    for _ in range(rounds):
        yes = {p: counts[p] * post[p] for p in counts}
        n1, n = sum(yes.values()), sum(counts.values())
        rates = []
        for j in range(len(LABELERS)):
            rate = {}
            for vote in (-1, 0, 1):
                # one made-up candidate of each class a labeler, who leans to the right vote: rates sum to 1
                one = sum(v for p, v in yes.items() if p[j] == vote)
                every = sum(v for p, v in counts.items() if p[j] == vote)
                lean = {1: 0.4, 0: 0.35, -1: 0.25}
                rate[vote] = ((every - one + lean[-vote]) / (n - n1 + 1), (one + lean[vote]) / (n1 + 1))
            rates.append(rate)
        for p in counts:
            odds = math.log((n1 + 1) / (n - n1 + 1)) + sum(math.log(rates[j][v][1] / rates[j][v][0]) for j, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return post, rates


def classifier(spans: DataFrame) -> dict[str, dict[int, float]]:
    """Log odds of each value of each feature, from the soft labels; the key bias holds the prior's.

    spans has one row a candidate.  What reaches the driver is a count for each combination of votes, kind and length class:
    at most 3 ** 4 * 7 * 8 rows, whatever the corpus.
    """
    features = (*LABELERS, "kind", "length")
    rows = [(tuple(r[f] for f in features), r["n"]) for r in spans.groupBy(*features).agg(F.count(F.lit(1)).alias("n")).collect()]
    counts: dict[tuple[int, ...], float] = {}
    for values, n in rows:
        counts[values[:4]] = counts.get(values[:4], 0) + n
    post, _ = reliabilities(counts)
    total = [sum(n * (1 - post[v[:4]]) for v, n in rows) + 1, sum(n * post[v[:4]] for v, n in rows) + 1]
    odds: dict[str, dict[int, float]] = {"bias": {0: math.log(total[1] / total[0])}}
    for i, f in enumerate(features):
        values = range(len(KINDS)) if f == "kind" else range(8) if f == "length" else (-1, 0, 1)
        odds[f] = {}
        for value in values:
            yes = sum(n * post[v[:4]] for v, n in rows if v[i] == value) + 0.5
            no = sum(n * (1 - post[v[:4]]) for v, n in rows if v[i] == value) + 0.5
            odds[f][value] = math.log(yes / total[1]) - math.log(no / total[0])
    return odds


def decide(found: Column, odds: dict[str, dict[int, float]]) -> Column:
    """The spans that stay: the base ones, and candidates the classifier accepts that overlap none of them; in order of
    kind, then start."""
    maps = {f: F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) for f, values in odds.items() if f != "bias"}
    base = F.filter(found, lambda x: x["base"])

    def accepted(x: Column) -> Column:
        score = F.lit(odds["bias"][0])
        for f, m in maps.items():
            score = score + F.element_at(m, x[f])
        return score > 0

    more = F.filter(found, lambda x: (x["kind"] >= len(BASE)) & accepted(x))

    def apart(line: Column) -> Column:
        """Of spans in order of start the candidates that no base span overlaps: none before reaches in, none after begins in."""
        reach = running(F.transform(line, lambda x: F.when(x["base"], x["end"])), lambda x, y: F.greatest(x, y))
        begin = F.reverse(running(F.reverse(F.transform(line, lambda x: F.when(x["base"], x["start"]))), lambda x, y: F.least(x, y)))
        free = lambda r, b: F.filter(F.transform(line, lambda x, i: F.when(~x["base"] & (F.coalesce(F.get(r, i), F.lit(0)) <= x["start"]) & (F.coalesce(F.get(b, i), x["end"]) >= x["end"]), x["x"])), lambda x: x.isNotNull())
        return let(reach, lambda r: let(begin, lambda b: free(r, b)))

    def clear(more: Column) -> Column:
        line = F.array_sort(F.transform(F.concat(base, more), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), x.alias("x"))))
        return F.when((F.size(more) == 0) | (F.size(base) == 0), more).otherwise(let(line, apart))

    return F.array_sort(F.concat(base, let(more, clear)))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """Per document of docs (doc_id, text): doc_id, found (array of kind, start, end and more; code points, end exclusive).

    Null text: no spans.  Repeated rows are labelled alike; no rows give none; other columns are ignored.  Texts are read
    once; their candidates are written to the shared folder, where the classifier is trained and applied.
    """
    seen = stash(docs.select("doc_id", candidates(F.col("text")).alias("found")), "pii-candidates")
    odds = classifier(seen.select(F.explode("found").alias("x")).select("x.*"))
    return seen.select("doc_id", decide(F.col("found"), odds).alias("found"))


def without_spans(text: Column, spans: Column) -> Column:
    """text with spans (start, end, kind; in order of start) replaced by their kind; of spans that overlap the first one names
    them all.  The text is cut into blocks, so that a span is found without reading all before it."""
    size = 256
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def between(blocks: Column, a: Column, b: Column) -> Column:
        """The text from a to b."""
        i, j = F.floor(a / size).cast("int"), F.floor(b / size).cast("int")
        at = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
        far = F.concat(F.substring(at(i), a - i * size + 1, F.lit(size)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(at(j), F.lit(1), b - j * size))
        return F.when(i == j, F.substring(at(i), a - i * size + 1, b - a)).otherwise(far)

    def cut(blocks: Column, ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        out = F.transform(spans, lambda x, i: F.when(x["start"] >= before(i), F.concat(between(blocks, before(i), x["start"]), F.element_at(names, x["kind"] + 1))).otherwise(""))
        return F.concat(F.array_join(out, ""), between(blocks, F.element_at(ends, -1), F.length(text)))

    ends = running(F.transform(spans, lambda x: x["end"]), lambda x, y: F.greatest(x, y))
    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)), lambda blocks: let(ends, lambda e: cut(blocks, e)))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span found in text replaced by its kind in angle brackets; all columns stay, n_chars if there is one
    follows the text.  Null texts stay null.  Rows are written to the shared folder with their candidates, which are found
    once, in a struct of their own, so no column name clashes."""
    seen = stash(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), candidates(F.col("text")).alias("found")), "pii-rows")
    odds = classifier(seen.select(F.explode("found").alias("x")).select("x.*"))
    spans = F.array_sort(F.transform(decide(F.col("found"), odds), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = F.col("row.text")
    out = seen.select("row", F.when(F.size("found") > 0, let(spans, lambda s: F.when(F.size(s) > 0, without_spans(text, s)).otherwise(text))).otherwise(text).alias("clean"))
    own = {"text": F.col("clean"), **({"n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return out.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
