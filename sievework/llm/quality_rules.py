"""Quality rules whose cutoffs limit false rejection, in DataFrame and SQL functions only.

Each rule rejects a document whose measure is above a cutoff. For every stratum, rule and cutoff of a fixed grid, the labelled good documents of the stratum that the rule would reject are counted. The exact binomial tail says how likely so few are if the true rate were at the limit; a cutoff counts as safe if that is at most RISK divided by the number of all tests (Bonferroni). The strictest safe cutoff of each rule holds; a rule without one doesn't apply in that stratum. A stratum's limits add up to FALSE_REJECTION over the rules, so with probability 1 - RISK no stratum loses more than that share of its good documents to the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import WS, WS_RE, Scratch, columns

FALSE_REJECTION, RISK = 0.05, 0.05
MIN_WORDS, MAX_REPEAT = 20, 30  # base rule: fewer words, or more per cent of words in repeated windows
SYMBOLS = "#*$%&|<>"
#: Measures (SQL over the features) and their cutoffs from lax to strict. All reject what is above.
RULES = {
    "symbols": ("n_symbols / n_words", [2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02]),
    "dup_lines": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    "repeats": ("n_repeat_words / n_words", [0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.05]),
    "long_words": ("word_chars / n_words", [15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.75, 6.5, 6.25, 6.0]),
    "few_words": ("1 - n_distinct / n_words", [0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35]),
}
TESTS = sum(len(cuts) for _, cuts in RULES.values())

_HASHES = "transform(words, w -> xxhash64(w))"
#: Words in 8-word windows that are in the text twice or more: windows as hashes, sorted with their places, and the places' cover added up. Each array is bound once, as the variable of a transform over an array of one.
_REPEATED = f"""CASE WHEN size(words) < 9 THEN 0L ELSE
transform(array({_HASHES}), h -> transform(array(transform(sequence(1, size(h) - 7), i -> xxhash64(slice(h, i, 8)))), k ->
  CASE WHEN size(array_distinct(k)) = size(k) THEN 0L ELSE
  transform(array(array_sort(transform(k, (x, i) -> struct(x AS x, i AS i)))), s ->
    transform(array(array_sort(transform(filter(sequence(0, size(s) - 1), j -> (j > 0 AND s[greatest(j - 1, 0)].x = s[j].x) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].x = s[j].x)), j -> s[j].i))), p ->
      aggregate(sequence(0, size(p) - 1), 0L, (a, q) -> a + CASE WHEN q < size(p) - 1 THEN least(8, p[q + 1] - p[q]) ELSE 8 END))[0])[0]
  END)[0])[0] END"""


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts for each row of docs (doc_id, text and the stratum's column)."""
    own = columns(docs, "doc_id", "text", *([stratum] if stratum in docs.columns else []))
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    bare = F.translate("text", WS, "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WS, "")) > 0)
    own = own.select("doc_id", "stratum", "text", F.filter(F.split("text", f"{WS_RE}+"), lambda w: w != "").alias("words"), lines.alias("lines"))
    long = lambda x: x.cast("long")
    return own.select(
        "doc_id",
        "stratum",
        long(F.size("words")).alias("n_words"),
        long(F.length(bare)).alias("word_chars"),
        long(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.expr(_REPEATED).cast("long").alias("n_repeat_words"),
        long(F.size(F.array_distinct("words"))).alias("n_distinct"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def _log_gamma(x: str) -> str:
    """SQL: logarithm of the gamma function for x >= 1, by Stirling's series at x + 7."""
    y = f"(({x}) + 7)"
    return f"(({y} - 0.5) * ln({y}) - {y} + 0.9189385332046727 + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) - ln({' * '.join(f'(({x}) + {i})' for i in range(7))}))"


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL: probability of at most k of n at rate p; 1 where k isn't below the mean."""
    top = f"exp({_log_gamma(f'{n} + 1D')} - {_log_gamma(f'{k} + 1D')} - {_log_gamma(f'{n} - {k} + 1D')} + {k} * ln({p}D) + ({n} - {k}) * ln({1 - p}D))"
    falling = f"aggregate(if({k} > 0, sequence({k}, 1L, -1L), array()), struct(1D AS term, 1D AS total), (a, j) -> struct(a.term * j * {1 - p}D / (({n} - j + 1) * {p}D) AS term, a.total + a.term * j * {1 - p}D / (({n} - j + 1) * {p}D) AS total), a -> a.total)"
    return f"CASE WHEN {k} >= {n} * {p}D THEN 1D ELSE {top} * {falling} END"


def cutoffs(seen: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """stratum and one cutoff column a rule (null: the rule has no safe one) from features and labels (doc_id, quality). Of several labels of a document the least counts; null ones don't."""
    good = columns(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    held = seen.where("not base_failed").join(good, "doc_id", "left_semi")
    counts = [F.sum(F.expr(f"if({measure} > {cut}D, 1L, 0L)")).alias(f"{rule}_{i}") for rule, (measure, cuts) in RULES.items() for i, cut in enumerate(cuts)]
    counted = scratch.save(held.groupBy("stratum").agg(F.count("*").alias("n"), *counts), "counted")
    risk = RISK / (max(1, counted.count()) * TESTS)
    each = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(cut).alias("cut"), F.col(f"{rule}_{i}").alias("k")) for rule, (_, cuts) in RULES.items() for i, cut in enumerate(cuts)))
    tests = counted.select("stratum", "n", F.explode(each).alias("t")).select("stratum", "n", "t.*")
    safe = tests.where(f"{binomial_tail('k', 'n', FALSE_REJECTION / len(RULES))} <= {risk!r}D")
    return scratch.save(safe.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == rule, F.col("cut"))).alias(rule) for rule in RULES)), "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, rejected_by (the first rule that rejects, or null) and kept.

    A null text is an empty one: no words, so the base rule fails it. A null stratum is the stratum ''. Repeated rows are judged alike; a null doc_id has no label and is judged like any other. Texts of any length are measured whole. Further columns of docs and labels are ignored, whatever their names; a measure that equals a cutoff passes. Without labels no rule applies beyond the base. No rows give no rows."""
    scratch = scratch or Scratch(docs.sparkSession, "rules")
    seen = scratch.save(features(docs, stratum), "features")
    judged = seen.join(cutoffs(seen, labels, scratch), "stratum", "left")
    failing = F.coalesce(*(F.expr(f"if(not base_failed and {measure} > {rule}, '{rule}', null)") for rule, (measure, _) in RULES.items()))
    judged = judged.withColumn("rejected_by", F.when(F.col("n_words") > 0, failing))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"), "rejected_by")
