"""How filters interact: what each removes under every order, and its Shapley value.

Every document has a mask of the filters it fails. Per part of the corpus and label, signed
sums over the documents, one for each set of filters and with the parity of the failures in
it as the sign, are the Walsh-Hadamard transform of the counts by mask. The transform is
its own inverse but for a factor, so the counts come back exactly; and from them what any
order of the filters keeps and removes. A document that fails k filters is removed by each
of them in orders! / k of the orders, which sums to the Shapley value without a look at
the orders.

Scale: masks are found in one pass. Copies are told by digests, never by texts: rows are
first counted by all they have, doc_id included, so that a text with very many copies is
counted by many tasks, and then by text. A part's sums are aggregated before they are
shuffled; all later work is on a few hundred rows a part.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: The label that all documents have, and those that labelled ones add.
ALL, GOOD, TOXIC = "all", "good", "toxic"
COPY = "E"


def failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at nothing but the text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask, rows: documents of a part by their labels and failures, copies included.

    The bit of the i-th filter is 1 << i; that of copies is the last.
    """
    failed = failures(F.col("text"))
    mask = sum((F.shiftleft(f.cast("int"), i) for i, f in enumerate(failed.values())), F.lit(0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = texts.select("doc_id", "part", mask.alias("mask"), F.sha2("text", 256).alias("digest"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    own = ["part", "mask", "good", "toxic"]
    named = marked.where("doc_id is not null").join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    # Of rows with one text those with its smallest doc_id pass, wherever they are.
    single = named.groupBy("doc_id", "digest", *own).agg(F.count("*").alias("rows"))
    groups = single.groupBy("digest", *own).agg(F.min(F.struct("doc_id", "rows")).alias("first"), F.sum("rows").alias("rows"))
    smallest = groups.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"))
    passing = F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.rows")).otherwise(F.lit(0))
    groups = groups.join(smallest, "digest").select(*own, passing.alias("passing"), (F.col("rows") - passing).alias("copies"))
    copies = F.col("mask") + F.lit(1 << len(failed))
    either = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("rows")), F.struct(copies.alias("mask"), F.col("copies").alias("rows")))
    named = groups.select("part", "good", "toxic", F.explode(either).alias("x")).select("part", "good", "toxic", "x.mask", "x.rows")
    # No doc_id is smaller than none, and none is smaller than any.
    nameless = marked.where("doc_id is null").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask", F.lit(1).cast("long").alias("rows"))
    return named.unionByName(nameless)


def sign(a: Column, b: Column | int) -> Column:
    """1 or -1 as a and b share an even or odd number of bits."""
    return 1 - 2 * F.bit_count(a.bitwiseAND(b)).bitwiseAND(1)


def parity_sums(counted: DataFrame, filters: int) -> DataFrame:
    """part, label, sums: the transform of the rows by mask, an entry for each set of filters."""
    labelled = F.array_compact(F.array(F.lit(ALL), F.when(F.col("good"), F.lit(GOOD)), F.when(F.col("toxic"), F.lit(TOXIC))))
    rows = counted.select("part", "mask", "rows", F.explode(labelled).alias("label"))
    sums = [F.sum(sign(F.col("mask"), s) * F.col("rows")).alias(f"s{s}") for s in range(1 << filters)]
    return rows.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*[f"s{s}" for s in range(1 << filters)]).alias("sums"))


def cells(sums: Column, filters: int) -> Column:
    """The counts by mask that have such parity sums."""
    n = 1 << filters
    one = lambda m: F.aggregate(F.transform(sums, lambda x, s: x * sign(s, m)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda m: F.shiftright(one(m), filters))


def chosen(counts: Column, which) -> Column:
    """The sum of the counts whose mask fits."""
    return F.aggregate(F.transform(counts, lambda x, m: F.when(which(m), x).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters ABCDE and step in it; see the columns below.

    docs has doc_id, text, source, labels has doc_id, quality, toxic. A part is a source, a
    null one the empty string. A fails under 200 words, B under half of the words distinct,
    C over 2 % capital letters, D any of #$%&*|, E a text that a row of smaller doc_id has
    too, in whatever part. Per step: kept after it, removed by it, redundant (failing its
    filter, removed before), unique_fails (failing no other), good_lost and toxic_lost (of
    the removed those labelled so), shapley (removed by its filter in all orders together).

    Null texts are empty. Rows that repeat a doc_id are documents of their own; a text's
    rows of the smallest doc_id all pass E, and so does a row without a doc_id, which makes
    no other one fail. Of labels that repeat a doc_id one that says 1 counts. Other
    columns are ignored. No documents give no rows.
    """
    names = [*failures(F.lit("")), COPY]
    n = len(names)
    sums = parity_sums(masks(docs, labels), n)
    of = lambda label: F.max(F.when(F.col("label") == label, F.col("counts")))
    empty = F.array_repeat(F.lit(0).cast("long"), 1 << n)
    parts = sums.withColumn("counts", cells(F.col("sums"), n)).groupBy("part").agg(of(ALL).alias(ALL), F.coalesce(of(GOOD), empty).alias(GOOD), F.coalesce(of(TOXIC), empty).alias(TOXIC))
    letters = "".join(names)
    orders = F.array(*[F.lit("".join(x)) for x in itertools.permutations(names)])
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    earlier = F.expr("substring(filter_order, 1, step - 1)")
    rows = rows.withColumns({
        "own": F.expr(f"shiftleft(1, instr('{letters}', substring(filter_order, step, 1)) - 1)"),
        "done": sum((F.when(F.instr(earlier, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(names)), F.lit(0)),
    })
    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    passed = lambda m: m.bitwiseAND(F.col("done")) == 0
    removed = lambda c: chosen(F.col(c), lambda m: fails(m) & passed(m))
    # Of all orders those remove a document of k failures here in which this filter comes first of the k.
    share = F.transform(F.col(ALL), lambda x, m: F.when(fails(m), x * (F.lit(math.factorial(n)) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part",
        "filter_order",
        "step",
        chosen(F.col(ALL), lambda m: ~fails(m) & passed(m)).alias("kept"),
        removed(ALL).alias("removed"),
        chosen(F.col(ALL), lambda m: fails(m) & ~passed(m)).alias("redundant"),
        chosen(F.col(ALL), lambda m: m == F.col("own")).alias("unique_fails"),
        removed(GOOD).alias("good_lost"),
        removed(TOXIC).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )
