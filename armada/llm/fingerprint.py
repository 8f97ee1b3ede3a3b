"""Document fingerprints by invertible Bloom lookup tables, in DataFrame expressions only.

Method: a text is a set of paragraph digests.  Each digest is added to one cell in each of three subtables; a cell keeps how
many digests it holds and the xor of them and of their check values.  Subtracting the tables of two versions cancels what they
share; cells that hold one digest are peeled, which frees others, until all differing digests are recovered.  If peeling
stops early, tables of twice the size are tried, until it succeeds.

A table is kept as the ascending array of its cells in use, so sums and differences of tables are one sort and one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armada.llm.common import let, partitions, range_bounds, range_index, table

#: What separates paragraphs: the end of a line.
SEPARATOR = r"\n"
#: Cells of a subtable for each digest, as bits: cells that aren't in use take no space, and few that are shared mean few
#: rounds of peeling.  Doublings tried after a failure, and rounds of peeling.
SPARE_BITS, DOUBLINGS, ROUNDS = 3, 20, 40
CELL = "struct<p:int,n:int,k:bigint,c:bigint>"
DIGEST = "struct<n:int,k:bigint>"


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, SEPARATOR), lambda p: F.length(p) > 0), lambda p: F.xxhash64(p)))


def signed(keys: Column, sign: int) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(sign).alias("n"), k.alias("k")))


def check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(7)).bitwiseAND(F.lit(0xFFFFFFFF))


def cells(keys: Column, bits: Column) -> Column:
    """The three cells of each signed digest in subtables of 2 ** bits cells; a table of half the size is this one folded."""

    def three(x: Column) -> Column:
        size = F.expr("cast(1 as int)")
        size = F.call_function("shiftleft", size, bits)
        own = lambda t: (F.xxhash64(x["k"], F.lit(t)).bitwiseAND((size - 1).cast("long")).cast("int") * 3 + t).alias("p")
        return let(check(x["k"]), lambda c: F.array(*[F.struct(own(t), x["n"].alias("n"), x["k"].alias("k"), c.alias("c")) for t in range(3)]))

    return F.flatten(F.transform(keys, three))


def negative(table_: Column) -> Column:
    return F.transform(table_, lambda e: F.struct(e["p"].alias("p"), (-e["n"]).alias("n"), e["k"].alias("k"), e["c"].alias("c")))


def combined(entries: Column) -> Column:
    """The table that entries and cells add up to, without its empty cells: entries are sorted, and those of one cell, which
    then stand together, are cut out and added up."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))

    def added(run: Column) -> Column:
        total = lambda acc, e: F.struct((acc["n"] + e["n"]).alias("n"), acc["k"].bitwiseXOR(e["k"]).alias("k"), acc["c"].bitwiseXOR(e["c"]).alias("c"))
        lone = F.get(run, 0)
        of = F.when(F.size(run) == 1, F.struct(lone["n"].alias("n"), lone["k"].alias("k"), lone["c"].alias("c"))).otherwise(F.aggregate(run, zero, total))
        return let(of, lambda x: F.struct(lone["p"].alias("p"), x["n"].alias("n"), x["k"].alias("k"), x["c"].alias("c")))

    def cut(line: Column) -> Column:
        places = F.transform(line, lambda e, i: F.when((i == 0) | (e["p"] != F.get(line, i - 1)["p"]), i))
        first = F.filter(places, lambda i: i.isNotNull())
        return let(first, lambda at: F.transform(at, lambda i, j: let(F.slice(line, i + 1, F.coalesce(F.get(at, j + 1), F.size(line)) - i), added)))

    cells_ = let(F.sort_array(entries.cast(f"array<{CELL}>")), cut)
    return F.filter(cells_, lambda e: (e["n"] != 0) | (e["k"] != 0) | (e["c"] != 0)).cast(f"array<{CELL}>")


def sketch(keys: Column, bits: Column) -> Column:
    """The lookup table of a set of digests."""
    return combined(cells(signed(keys, 1), bits))


def capacity(n: Column) -> Column:
    """Bits of subtables for n digests."""
    return F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int") + SPARE_BITS


def peel(difference: Column, bits: Column) -> Column:
    """The recovered digests with sign (1: only in the first version), or null if cells remain."""

    def step(acc: Column, _: Column) -> Column:
        pure = F.filter(acc["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == check(c["k"])))

        def sure(pure: Column) -> Column:
            # a digest may be pure in several of its cells, but is taken out once
            own = lambda sign: signed(F.array_distinct(F.transform(F.filter(pure, lambda c: c["n"] == sign), lambda c: c["k"])), sign)
            return F.concat(own(1), own(-1))

        freed = let(pure, sure)
        without = lambda x: F.struct(combined(F.concat(acc["cells"], negative(cells(x, bits)))).alias("cells"), F.concat(acc["found"], x).alias("found"), (F.size(x) == 0).alias("over"))
        return F.when(acc["over"], acc).otherwise(let(freed, without))

    start = F.struct(difference.alias("cells"), F.array().cast(f"array<{DIGEST}>").alias("found"), (F.size(difference) == 0).alias("over"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.when(F.size(acc["cells"]) == 0, acc["found"]))


def difference(a: Column, b: Column, table_a: Column, table_b: Column, bits_a: Column, bits_b: Column) -> Column:
    """The digests in which two sets differ, with sign, from their tables: both in the size of the larger, subtracted and
    peeled; on failure in twice that size, and so on.

    A table of another size than a set's own is sketched from its digests, which its own table gives up by peeling too.
    Two sets of digests fit in the larger table, which has spare cells for each digest of the larger set, so a retry is rare;
    digests that share all cells in one size part in a larger one, so one of the doublings succeeds.
    """
    bits = F.greatest(bits_a, bits_b)
    own_a = F.when(bits_a == bits, table_a).otherwise(sketch(a, bits))
    own_b = F.when(bits_b == bits, table_b).otherwise(sketch(b, bits))
    first = let(combined(F.concat(own_a, negative(own_b))), lambda left: peel(left, bits))

    def larger(acc: Column, more: Column) -> Column:
        again = let(combined(F.concat(cells(signed(a, 1), bits + more), cells(signed(b, -1), bits + more))), lambda left: peel(left, bits + more))
        return F.when(acc.isNotNull(), acc).otherwise(again)

    return F.aggregate(F.sequence(F.lit(1), F.lit(DOUBLINGS)), first, larger)


def likeness(a: Column, b: Column, table_a: Column, table_b: Column, bits_a: Column, bits_b: Column) -> Column:
    """1 less the share of both sets' digests that differ (two empty sets: 1)."""
    all_ = F.size(a) + F.size(b)
    return F.when(all_ == 0, 1.0).otherwise(1.0 - F.size(difference(a, b, table_a, table_b, bits_a, bits_b)) / all_)


def written(keys: Column, bits: Column, table_: Column) -> Column:
    """A fingerprint as a string: size of the set and bits of its table, then for each cell in use its place, count, digests
    and checks in hexadecimal."""
    cell = lambda c: F.concat_ws(".", F.hex(c["p"].cast("long")), F.hex(c["n"].cast("long")), F.hex(c["k"]), F.hex(c["c"]))
    return F.concat(F.size(keys).cast("string"), F.lit(":"), bits.cast("string"), F.lit(":"), F.array_join(F.transform(table_, cell), ","))


def sketched(rows: DataFrame, **texts: Column) -> DataFrame:
    """rows with d_<name>, b_<name> and t_<name>, the digests of each text, the bits of its table and the table."""
    rows = rows.withColumns({f"d_{name}": digests(text) for name, text in texts.items()})
    rows = rows.withColumns({f"b_{name}": capacity(F.size(f"d_{name}")) for name in texts})
    return rows.withColumns({f"t_{name}": sketch(F.col(f"d_{name}"), F.col(f"b_{name}")) for name in texts})


def of(a: str, b: str) -> list[Column]:
    return [F.col(f"{kind}_{name}") for kind in "dtb" for name in (a, b)]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by doc_id, after the last that of the first.

    Documents are dealt to ranges of doc_id, so texts cross the network once and no window sees the whole table.  The first
    document of each range is also sent, as a guest, to the end of the range before.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(d, "doc_id", 2 * partitions(d.sparkSession))
    d = d.withColumn("part", range_index("doc_id", bounds))
    heads = d.groupBy("part").agg(F.min_by(F.struct("doc_id", "text"), F.struct(F.col("doc_id").isNotNull(), "doc_id", "text")).alias("head"))
    # one row a range: the range before it, for the first range the last
    ring = heads.select("part").withColumn("to", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))).withColumnRenamed("part", "of")
    guests = heads.join(F.broadcast(ring), F.col("part") == F.col("of")).select("head.doc_id", "head.text", F.col("to").alias("part"), F.lit(1).alias("guest"))
    line = Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    every = d.withColumn("guest", F.lit(0)).unionByName(guests)
    return every.withColumn("next_text", F.lead("text").over(line)).where("guest = 0").drop("guest", "part")


def compare_next(docs: DataFrame) -> DataFrame:
    """Per document of docs (doc_id long, text string): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text ends in the head of the next document's instead of its last quarter.  near_edited and near_next are
    likenesses of the text's fingerprint to those of the edited and of the next text.  Null text: empty.  Null doc_id comes
    first, equal doc_ids in order of text; a lone document is its own next; no rows give none; other columns are ignored.
    """
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = with_next(docs).withColumn("edited", F.when(quarter > 0, edited).otherwise(F.col("text")))
    rows = sketched(rows, own=F.col("text"), edit=F.col("edited"), next=F.col("next_text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), written(F.col("d_own"), F.col("b_own"), F.col("t_own")).alias("fingerprint"), written(F.col("d_edit"), F.col("b_edit"), F.col("t_edit")).alias("edited_fingerprint"), likeness(*of("own", "edit")).alias("near_edited"), likeness(*of("own", "next")).alias("near_next"))


def changed_paragraphs(versions: DataFrame) -> DataFrame:
    """For rows (doc_id, old_text, new_text): doc_id, removed and added, the digests of paragraphs only in one version.  Null
    text: empty; repeated rows stay; no rows give none; other columns are ignored."""
    rows = versions.select("doc_id", F.coalesce("old_text", F.lit("")).alias("old_text"), F.coalesce("new_text", F.lit("")).alias("new_text"))
    rows = sketched(rows, old=F.col("old_text"), new=F.col("new_text")).withColumn("changed", difference(*of("old", "new")))

    def only(sign: int) -> Column:
        return F.array_sort(F.transform(F.filter("changed", lambda x: x["n"] == sign), lambda x: x["k"]))

    return rows.select("doc_id", only(1).alias("removed"), only(-1).alias("added"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_next(table(spark, sf_dir, "documents"))
