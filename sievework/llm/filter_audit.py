"""Audit of how filters interact: how many documents fail each set of filters at once, and from that, by inclusion and exclusion, what any order of the filters keeps, removes and duplicates.

FILTERS has five failure conditions; `joint` sums the products of their flags for all 32 intersections, for all documents, good ones and toxic ones. Everything else is arithmetic on those 96 numbers of a part: what passes the filters of a set S is the alternating sum of the intersections within S, the documents that fail exactly one filter that of the intersections above it, and the union game (a coalition's worth is what it removes) has the Harsanyi dividend (-1)^(|T|+1) times the intersection T, of which each member's Shapley value takes 1/|T|."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import WS_RE, Scratch, columns, with_small

#: SQL over n_words, n_distinct, n_upper, n_chars, n_marks and repeated.
FILTERS = {"A": "n_words < 50", "B": "100 * n_distinct < 65 * n_words", "C": "100 * n_upper > 5 * n_chars", "D": "n_marks > 0", "E": "repeated"}
MARKS, UPPER = "#$%&*|", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "".join(FILTERS)
SETS = range(1 << len(LETTERS))  # bit k of a set: the k-th filter is in it
KINDS = {"n": "n", "g": "n * good", "t": "n * toxic"}  # all documents, good ones, toxic ones
_inside = lambda s: [t for t in SETS if t & s == t]
_sign = lambda t: "-" if t.bit_count() % 2 else "+"


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part (the source), the text's digest and the flags A to D as 0 or 1, for each row of docs."""
    own = columns(docs, "doc_id", "text", *(["source"] if "source" in docs.columns else []))
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.select("doc_id", "part", "text", F.filter(F.split("text", f"{WS_RE}+"), lambda w: w != "").alias("words"))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    own = own.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), without(UPPER).cast("long").alias("n_upper"), F.length("text").cast("long").alias("n_chars"), without(MARKS).alias("n_marks"))
    return own.select("doc_id", "part", "digest", *(F.expr(f"if({FILTERS[x]}, 1L, 0L)").alias(x) for x in LETTERS[:-1]))


def labelled(rows: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with good and toxic as 0 or 1; of several labels of a document any counts. Rows without an id are no label's and are dealt by their digest."""
    own = columns(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_of"), F.lit("").cast("binary").alias("spread"))
    own = own.agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(name) for c, name in (("quality", "good"), ("toxic", "toxic")))).where("good + toxic > 0")
    rows = rows.withColumn("label_of", F.coalesce("doc_id", F.lit(0))).withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise(F.lit("").cast("binary")))
    return with_small(rows, scratch.save(own, "labels"), ["label_of", "spread"], "left").fillna(0, ["good", "toxic"]).drop("label_of", "spread")


def joint(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a part: for each set s of filters n_s, g_s and t_s, the documents, good and toxic documents that fail all of them.

    Equal texts meet under their digest as counts, never as rows: the first shuffle has a row for each document and different text of it, the second one for each text, part and label, and of each text only the smallest id goes back to those."""
    same = [*LETTERS[:-1], "part", "digest"]
    own = flags(docs).groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    own = labelled(own, labels, scratch)
    own = own.groupBy(*same, "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"))
    own = scratch.save(own, "texts")
    first = own.groupBy("digest").agg(F.min("least.doc_id").alias("first"), F.sum("n").alias("all")).where("all > 1").drop("all")
    own = own.join(first, "digest", "left").withColumn("kept_here", F.expr("CASE WHEN first IS NULL THEN n ELSE unnamed + if(least.doc_id = first, least.n, 0) END"))
    halves = F.explode(F.expr("array(struct(kept_here AS n, 0L AS E), struct(n - kept_here AS n, 1L AS E))")).alias("half")
    own = own.select("part", *LETTERS[:-1], "good", "toxic", halves).select("part", *LETTERS[:-1], "good", "toxic", "half.*").where("n > 0")
    product = lambda s, kind: " * ".join([kind, *(LETTERS[k] for k in range(len(LETTERS)) if s >> k & 1)])
    return own.groupBy("part").agg(*(F.sum(F.expr(product(s, by))).alias(f"{k}_{s}") for k, by in KINDS.items() for s in SETS))


def orders(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from `joint`."""
    passing = lambda k: "array(" + ", ".join(" ".join(f"{_sign(t)} {k}_{t}" for t in _inside(s)) for s in SETS) + ")"
    exactly = lambda f: " ".join(f"{'-' if (s.bit_count() - 1) % 2 else '+'} n_{s}" for s in SETS if s >> f & 1)
    dividends = lambda f: " ".join(f"{'+' if s.bit_count() % 2 else '-'} {120 // s.bit_count()} * n_{s}" for s in SETS if s >> f & 1)
    each = lambda make: "array(" + ", ".join(make(f) for f in range(len(LETTERS))) + ")"
    held = counts.select("part", *(F.expr(passing(k)).alias(k) for k in KINDS), F.expr(each(lambda f: f"n_{1 << f}")).alias("fails"), F.expr(each(exactly)).alias("alone"), F.expr(each(dividends)).alias("values"))
    bits = {x: 1 << k for k, x in enumerate(LETTERS)}
    steps = [(order, at + 1, LETTERS.index(order[at]), sum(bits[x] for x in order[:at]), sum(bits[x] for x in order[: at + 1])) for order in map("".join, permutations(LETTERS)) for at in range(len(LETTERS))]
    table = F.explode(F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"f":{f},"b":{b},"a":{a}}}' for o, s, f, b, a in steps) + "]"), "array<struct<o:string,s:int,f:int,b:int,a:int>>"))
    lost = lambda k: F.expr(f"{k}[x.b] - {k}[x.a]")
    out = held.select("*", table.alias("x"))
    return out.select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"), F.expr("n[x.a]").alias("kept"), lost("n").alias("removed"), F.expr("fails[x.f] - (n[x.b] - n[x.a])").alias("redundant"),
        F.expr("alone[x.f]").alias("unique_fails"), lost("g").alias("good_lost"), lost("t").alias("toxic_lost"), F.expr("`values`[x.f]").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per part (source), order of the five filters and step: kept, removed, redundant (fails the step's filter, removed before), unique_fails (fails no other filter), good_lost, toxic_lost, and shapley, the filter's removed added up over all orders.

    A null text is an empty one and a null source the part ''. E compares ids: a document fails it if a smaller id has the same text anywhere; rows without an id neither fail it nor make others fail, and repeated rows of one id don't make each other fail. Each row counts as a document. Of several labels of a document any with 1 counts; labels without a document, or null ones, don't. Texts of any length are read whole. Further columns are ignored, whatever their names. No rows give no rows."""
    scratch = scratch or Scratch(docs.sparkSession, "audit")
    return orders(scratch.save(joint(docs, labels, scratch), "joint"))
