"""Queries over what the nine layers report: evidence, hits of rules and their nearness, the comparison of six scanners and the fact table. The SQL that checks them is written apart, with other means: strings are found by splitting and counting, nearest places by all pairs, evidence by a union of selections."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.dialect import DUCKDB as D
from sievework.functions.dialect import SPARK
from sievework.functions.rules import RULES, matched_sql
from sievework.functions.tables import CO_LOCATED, DATA_URIS, DECLARED_BY_EXTENSION, FOREIGN_TEXT, HOST, LAYERS, SCANNERS, SCHEMES, SEVERITIES, SIGNATURES, URL
from sievework.operators import hits as H
from sievework.operators import layers as L
from sievework.operators.cascade import comparators
from sievework.operators.engine_output import parse_lines, render
from sievework.operators.ordering import ranked
from sievework.plans.comparison import by_scanner, fact_rows, kept_name, seen_before
from sievework.plans.scan import layered, submissions, untrusted_links
from sievework.sources.cases import cases_sql
from sievework.sources.submissions import submissions_sql
from sievework.streaming.cache import shown_layer

ALLOWED = ["example.org", "m.example.net"]  # domains that the queries take as allowed
PUBLISHED = (5298, 251, 4067, 396)  # tp, fn, tn, fp
CACHED = ["SignatureScanning", "PdfFlateDecode"]
FINGERPRINT = hashlib.sha256(repr(RULES).encode()).hexdigest()
COLUMNS = "id, truth, category, declared_type, file_name, payload"


# what Spark runs


def of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and the fired rules (rule_no, hits, near) of all submissions and rule cases that any rule matches.

    Files without a match go by an outer explode and a filter of what it gives: a filter of the rules, which a plain explode implies too, would be pushed below the text's measures and take them again for each place where they are used."""
    files = submissions(spark, sf_dir).select("id", F.col("content").alias("raw")).union(spark.sql(f"SELECT id, encode(payload, 'UTF-8') FROM ({cases_sql(SPARK)}) AS c"))
    files = files.select("id", "raw", F.decode("raw", "ISO-8859-1").alias("t")).select("id", "raw", "t", F.lower("t").alias("low")).selectExpr("id", "t", f"{matched_sql(SPARK)} AS rules")
    return files.select("id", "t", F.explode_outer(F.filter(F.array("rules"), lambda r: F.size(r) > 0)).alias("rules")).where("rules IS NOT NULL").selectExpr("id", f"{H.fired('rules')} AS fired")


def _each(df: DataFrame, part: str) -> DataFrame:
    """A row for each of the fired rules' hits or near pairs, with their number within the rule."""
    return df.select("id", F.explode("fired").alias("f")).select("id", "f.rule_no", F.posexplode(f"f.{part}").alias("k", "x")).select("id", "rule_no", "k", "x.*")


def src_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, and how many submissions each matches."""
    rows = [(r.number, r.name, r.category, r.severity, len(r.strings), r.condition) for r in RULES]
    rules = spark.createDataFrame(rows, "rule_no int, rule string, category string, severity string, strings long, condition string")
    return rules.join(yara_counts(spark, sf_dir), "rule", "left").fillna(0, ["files"])


def yara_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(of_rules(spark, sf_dir), "hits").select("id", "rule_no", "string", "place", "text")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched rules of each submission."""
    files = submissions(spark, sf_dir).select(F.col("content").alias("raw")).select("raw", F.decode("raw", "ISO-8859-1").alias("t"))
    return files.select("raw", "t", F.lower("t").alias("low")).selectExpr(f"{matched_sql(SPARK)} AS rules")


def yara_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each rule matches."""
    names = F.array(*(F.lit(r.name) for r in RULES))
    return _matched(spark, sf_dir).select(F.explode_outer("rules").alias("rule_no")).where("rule_no IS NOT NULL").groupBy("rule_no").agg(F.count("*").alias("files")).select(F.element_at(names, F.col("rule_no")).alias("rule"), "files")


def yara_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and matched files by severity and category."""
    kinds = F.array(*(F.struct(F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category")) for r in RULES))
    each = F.transform("rules", lambda r: F.element_at(kinds, r))
    counts = F.transform(F.array_distinct(each), lambda k: F.struct(k.alias("kind"), F.size(F.filter(each, lambda x: x == k)).alias("matches")))
    rows = _matched(spark, sf_dir).select(F.explode_outer(counts).alias("c")).where("c IS NOT NULL")
    return rows.groupBy("c.kind").agg(F.sum("c.matches").alias("matches"), F.count("*").alias("files")).select("kind.severity", "kind.category", "matches", "files")


def agg_group_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(of_rules(spark, sf_dir), "hits").groupBy("id", "rule_no", "grp").agg(F.count("*").alias("hits"), F.count_distinct("string").alias("strings"), F.min("place").alias("first_at"))


def join_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(of_rules(spark, sf_dir), "near").selectExpr("id", "rule_no", "group_a", "group_b", "distance", "at", f"distance <= {CO_LOCATED} AS co_located")


def topk_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(of_rules(spark, sf_dir), "hits").where("k < 8").selectExpr("id", "rule_no", "cast(k as bigint) AS k", "string", "place")


def topk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(of_rules(spark, sf_dir), "near").where("k < 3").selectExpr("id", "rule_no", "cast(k as bigint) AS k", "group_a", "group_b", "distance")


def yara_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_rules(spark, sf_dir).select("id", F.explode(F.expr(H.of_rules("fired", 5, "yara"))).alias("e"))
    return rows.select("id", "e.kind", "e.label", "e.detail", "e.place", "e.severity")


def yara_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_rules(spark, sf_dir).selectExpr("id", f"{H.described('fired')} AS reason")


def yara_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine prints of each file, read back: a row for each matched rule and for each of its hits."""
    name, severity, category = (x.format(r="f.rule_no") for x in (H.NAME, H.SEVERITY, H.CATEGORY))
    lines = of_rules(spark, sf_dir).select("id", F.posexplode(F.expr(render("fired", name, severity, category))).alias("line_no", "line"))
    return parse_lines(lines).select("id", "rule", F.col("metadata").getItem("severity").alias("severity"), F.col("metadata").getItem("category").alias("category"), "place", "string", "text")


def scan_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).select("id", "decision", "stopped_at", "reason_code", "top_severity", "layers_run", "content_rewritten", "is_scanner_error", "is_test_only", "is_neutralized", "stored_size")


def scan_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).select("id", "decision", "stopped_at", "reason_code", "top_severity", "layers_run")


def prj_unwrap_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers as the cache names them, Cached(X) for a verdict that it gave, and as they are shown, X."""
    rows = layered(spark, sf_dir).select("id", "truth", "sha256", "stopped_at")
    rows = rows.select("id", "stopped_at").join(seen_before(submissions_of(spark, sf_dir)), "id")
    rows = rows.withColumn("wrapped", F.expr("if(from_cache, 'Cached(' || stopped_at || ')', stopped_at)"))
    return rows.select("id", "wrapped", shown_layer("wrapped").alias("layer"))


def scan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir, detail=True).select("id", F.explode("evidence").alias("e")).select("id", "e.layer_no", "e.kind", "e.label", "e.place", "e.severity")


def prj_notable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir, detail=True).selectExpr("id", "cast(size(filter(evidence, e -> e.severity IN ('high', 'medium'))) as bigint) AS notable")


def agg_top_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).groupBy("top_severity").agg(F.count("*").alias("files"))


def agg_quantifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).selectExpr("id", "exists(evidence, e -> e.severity = 'high') AS any_high", "size(evidence) > 0 AND forall(evidence, e -> e.severity IN ('info', 'low')) AS only_slight", "array_contains(transform(evidence, e -> e.kind), 'yara-rule') AS has_rule")


def agg_reason_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).groupBy("reason_code", "decision").agg(F.count("*").alias("files"))


def agg_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that reach each layer, and how many it refuses."""
    names = "array(" + ", ".join(f"'{x}'" for x in LAYERS) + ")"
    runs = layered(spark, sf_dir).groupBy("layers_run", (F.col("decision") == "rejected").alias("refused")).agg(F.count("*").alias("n"))
    each = runs.select("*", F.explode(F.sequence(F.lit(1), "layers_run")).alias("layer_no"))
    return each.groupBy("layer_no").agg(F.sum("n").alias("reached"), F.sum(F.expr("if(refused AND layers_run = layer_no, n, 0L)")).alias("refused")).selectExpr("layer_no", f"element_at({names}, layer_no) AS layer", "reached", "refused")


def src_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).where("decision = 'accepted'").select("category", F.col("file_name").alias("stored_name"), F.col("stored_size").alias("size"))


def prj_outcome3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).selectExpr("id", "CASE WHEN decision = 'rejected' THEN 'Rejected' WHEN content_rewritten THEN 'Neutralized' ELSE 'Accepted' END AS outcome")


def reason_code(reason: str, kind: str) -> str:
    """SQL: the short cause of a refusal: the mark before the reason's first colon, if it is 4 to 16 capitals, digits and hyphens; else the kind of the layer's first evidence; else UNCODED if there is a reason."""
    mark = f"regexp_extract({reason}, r'^([\\p{{Lu}}\\p{{Nd}}-]{{4,16}}):', 1)"
    return f"CASE WHEN {mark} <> '' THEN {mark} WHEN {kind} IS NOT NULL THEN {kind} WHEN {reason} <> '' THEN 'UNCODED' ELSE '' END"


def fn_reason_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cause of each refusal, from what the layer says in words and its first evidence."""
    told = "CASE WHEN decision = 'accepted' THEN '' WHEN layers_run IN (3, 4, 7, 9) THEN reason_code || ': refused by ' || stopped_at ELSE 'Refused by: ' || stopped_at END"
    rows = layered(spark, sf_dir).selectExpr("id", f"{told} AS reason", "CASE WHEN decision = 'rejected' THEN get(filter(evidence, e -> e.layer_no = layers_run), 0).kind END AS kind")
    return rows.selectExpr("id", f"{reason_code('reason', 'kind')} AS code")


def join_lookup_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content type that each name's extension stands for, and how many names have it: a join with the lookup table, which is small and fixed."""
    table = spark.createDataFrame(list(DECLARED_BY_EXTENSION.items()), "ext string, content_type string")
    names = submissions(spark, sf_dir).select(F.lower(F.regexp_extract("file_name", r"(\.[^./\\]+)$", 1)).alias("ext"))
    rows = names.join(F.broadcast(table), "ext", "left").withColumn("content_type", F.coalesce("content_type", F.lit("application/octet-stream")))
    return rows.groupBy("content_type").agg(F.count("*").alias("files"))


def snk_json_response(spark: SparkSession, sf_dir: str, demo: bool = True) -> DataFrame:
    """A response a file; what the layers said is in it only in demonstration mode."""
    traces = F.expr("transform(sequence(1, layers_run), k -> named_struct('layer', element_at(array(" + ", ".join(f"'{x}'" for x in LAYERS) + "), k), 'evidence', cast(size(filter(evidence, e -> e.layer_no = k)) as bigint)))")
    own = layered(spark, sf_dir, detail=True).select("id", F.struct("id", (F.col("decision") == "accepted").alias("accepted"), "stopped_at", F.when(F.lit(demo), traces).alias("traces")).alias("r"))
    return own.select("id", F.to_json("r").alias("response"))


def flt_demo_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is answered with demonstration mode on and off: status of the comparison, and layers traced."""
    return layered(spark, sf_dir).selectExpr("id", "explode(array(true, false)) AS demo", "layers_run").selectExpr("id", "demo", "if(demo, 200, 404) AS compare_status", "if(demo, layers_run, 0) AS traced")


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a file and scanner, from one scan of the files."""
    return by_scanner(layered(spark, sf_dir).drop("content", "rebuilt", "evidence"))


def compare_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("id", "scanner", "accepted", "content_rewritten", "reason_code", "stored_size")


def join_files_x_scanners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).groupBy("scanner").agg(F.count("*").alias("files"), F.count_if("accepted").alias("accepted"))


def agg_accept_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).groupBy("id").agg(F.count_if("accepted").alias("accepted"), F.count("*").alias("scanners"))


def snk_compare_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which each accepting scanner's output is kept."""
    return compared(spark, sf_dir).where("accepted").select("id", "scanner", kept_name().alias("stored_name"), "stored_size")


def corpus_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).selectExpr("id", "scanner", *(f"cast({c} as int) AS {c}" for c in ("accepted", "is_scanner_error", "is_test_only", "is_neutralized")))


def confusion(rows: DataFrame, refused: str) -> DataFrame:
    """Counts by scanner of labelled files that are refused or not."""
    count = lambda x: F.count_if(F.expr(x))
    rows = rows.where("truth IS NOT NULL").withColumn("refused", F.expr(refused))
    return rows.groupBy("scanner").agg(*(count(f"truth = '{t}' AND {'' if r else 'NOT '}refused").alias(n) for n, t, r in (("tp", "malicious", 1), ("fn", "malicious", 0), ("tn", "clean", 0), ("fp", "clean", 1))))


def agg_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(compared(spark, sf_dir), "NOT accepted")


def agg_severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(compared(spark, sf_dir).where(f"scanner = '{SCANNERS[-1]}'"), "NOT accepted AND top_severity IN ('high', 'critical')")


def measured(counts: DataFrame) -> DataFrame:
    """Recall, precision, accuracy, f1, specificity and fpr, null where nothing is counted, from rows with scanner, tp, fn, tn, fp."""
    r = lambda a, b: f"round(cast({a} as double) / nullif({b}, 0), 6)"
    return counts.selectExpr("scanner", f"{r('tp', 'tp + fn')} AS recall", f"{r('tp', 'tp + fp')} AS precision", f"{r('tp + tn', 'tp + tn + fp + fn')} AS accuracy", f"{r('2 * tp', '2 * tp + fp + fn')} AS f1", f"{r('tn', 'tn + fp')} AS specificity", f"{r('fp', 'tn + fp')} AS fpr")


def agg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(agg_confusion(spark, sf_dir))


def agg_metrics_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios where only grave findings refuse: those of the published counts beside our own over the labelled submissions."""
    published = spark.createDataFrame([("gated", *PUBLISHED)], "scanner string, tp long, fn long, tn long, fp long")
    return measured(published.unionByName(agg_severity_gate(spark, sf_dir)))


def agg_severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of severities, and the submissions for which each is the gravest."""
    order = spark.createDataFrame([(s, k) for k, s in enumerate(SEVERITIES)], "severity string, rank_no int")
    files = layered(spark, sf_dir).groupBy(F.col("top_severity").alias("severity")).agg(F.count("*").alias("files"))
    return order.join(files, "severity", "left").fillna(0, ["files"])


def corpus_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table of labelled files."""
    cached = seen_before(submissions_of(spark, sf_dir).where("truth IS NOT NULL"))
    return fact_rows(compared(spark, sf_dir).where("truth IS NOT NULL"), cached, "truth || '/' || file_name")


def submissions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submissions(spark, sf_dir).select("id", "truth", "file_name", F.sha2("content", 256).alias("sha256"))


def win_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_before(submissions_of(spark, sf_dir))


def agg_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(spark, sf_dir).where("truth IS NOT NULL")
    one = f"scanner = '{SCANNERS[-1]}'"
    return rows.agg(*(F.count_if(F.expr(x)).alias(n) for n, x in (("processed", one), ("malicious", f"{one} AND truth = 'malicious'"), ("clean", f"{one} AND truth = 'clean'"), ("scanner_errors", "is_scanner_error"))), F.count("*").alias("result_rows"))


def sort_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each labelled file in its group, by path."""
    files = submissions_of(spark, sf_dir).where("truth IS NOT NULL")
    return ranked(files.select("id", "truth", "file_name"), "truth", "file_name", "id").select("id", F.col("place").cast("int").alias("place"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each http(s) link of the linkable submissions: id, ord, url, host, place in bytes."""
    rows = submissions(spark, sf_dir).select("id", F.decode("content", "ISO-8859-1").alias("t")).select("id", "t", F.lower("t").alias("low")).where(L.linkable(SPARK))
    rx = SPARK.text("(?i)" + URL)
    rows = rows.selectExpr("id", f"posexplode({H.matches('t', rx)}) AS (ord, x)").selectExpr("id", "ord", "x.text AS url", "x.place")
    return rows.withColumn("host", F.expr(f"lower({SPARK.rx_extract('url', HOST)})")).where("host <> ''")


def kind_of_host() -> str:
    return L.trust_of("host", ALLOWED)


def fn_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).selectExpr("id", "cast(ord as bigint) AS ord", "url", "host", "place")


def agg_link_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = links(spark, sf_dir).withColumn("kind", F.expr(kind_of_host()))
    counts = (F.count_if(F.col("kind") == k).alias(n) for n, k in (("namespaces", "namespace"), ("allow_listed", "allowed"), ("untrusted", "untrusted")))
    return rows.groupBy("id").agg(F.count("*").alias("links"), F.count_distinct("host").alias("hosts"), *counts, F.min("place").alias("first_at"))


def agg_links_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = links(spark, sf_dir).where(f"{kind_of_host()} = 'untrusted'")
    first = F.min(F.struct("id", "ord", "place", "url")).alias("f")
    return rows.groupBy("host").agg(F.count("*").alias("links"), F.count_distinct("id").alias("files"), first).select("host", "links", "files", "f.id", F.col("f.place").alias("first_at"), "f.url")


def _hosts_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).where(f"{kind_of_host()} = 'untrusted'").groupBy("id").agg(F.array_sort(F.collect_set("host")).alias("hosts"))  # a file's own


def agg_distinct_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hosts_of_files(spark, sf_dir).select("id", F.array_join("hosts", ", ").alias("hosts"))


def topk_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5 untrusted hosts of a file, and how many more."""
    return _hosts_of_files(spark, sf_dir).selectExpr("id", "array_join(slice(hosts, 1, 5), ', ') || if(size(hosts) > 5, ', +' || (size(hosts) - 5) || ' more', '') AS hosts")


def l5c_links_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links layer where links to untrusted hosts are refused too: its verdict, and those links, their hosts by name and the first one's place."""
    files = submissions(spark, sf_dir).select("id", F.decode("content", "ISO-8859-1").alias("t")).select("id", "t", F.lower("t").alias("low"))
    files = files.selectExpr("id", "t", "low", f"CASE WHEN {L.linkable(SPARK)} AND contains(low, '://') THEN {untrusted_links('t', ALLOWED)} END AS far")
    hosts = "array_sort(array_distinct(transform(far, z -> z.host)))"
    named = f"transform(array({hosts}), h -> array_join(slice(h, 1, 5), ', ') || if(size(h) > 5, ', +' || (size(h) - 5) || ' more', ''))[0]"
    return files.selectExpr("id", f"{L.links(SPARK, 'size(far)')} AS l5c", "cast(coalesce(size(far), 0) as bigint) AS links", f"CASE WHEN size(far) > 0 THEN {named} END AS hosts", "CASE WHEN size(far) > 0 THEN far[0].place END AS first_at")


def agg_confusion_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without files whose scanner failed and those refused by test rules alone."""
    return confusion(compared(spark, sf_dir).where("NOT is_scanner_error AND NOT is_test_only"), "NOT accepted")


def join_verdict_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the cached layers, whether labelled files have left a verdict for a file's bytes under the same rules."""
    files = submissions_of(spark, sf_dir)
    layer = F.explode(F.array(*(F.lit(x) for x in CACHED))).alias("layer")
    key = ["layer", "sha256", "rules"]
    kept = files.where("truth IS NOT NULL").select(layer, "sha256", F.lit(FINGERPRINT).alias("rules")).distinct().withColumn("hit", F.lit(True))
    return files.select("id", layer, "sha256", F.lit(FINGERPRINT).alias("rules")).join(kept, key, "left").select("id", "layer", F.coalesce("hit", F.lit(False)).alias("hit"))


_LINKED = (agg_metrics_published, agg_severity_order, join_lookup_types, l5c_links_blocking, agg_confusion_strict, fn_urls, agg_link_inventory, agg_links_per_host, agg_distinct_hosts, topk_hosts, join_verdict_cache)
_TABLES = (src_rules, yara_counts, yara_by_severity, yara_hits, agg_group_hits, join_proximity, topk_strings, topk_pairs, yara_evidence, yara_describe, yara_parse, scan_layered, scan_cascade, prj_unwrap_layer, scan_evidence, prj_notable, agg_top_severity, agg_quantifiers, agg_reason_breakdown, agg_funnel, src_list_files, prj_outcome3, fn_reason_code, snk_json_response, flt_demo_gate)
_COMPARED = (compare_run, join_files_x_scanners, agg_accept_ratio, snk_compare_store, corpus_flags, agg_confusion, agg_severity_gate, agg_metrics, corpus_run, win_from_cache, agg_corpus_summary, sort_paths)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*_TABLES, *_COMPARED, *_LINKED)}


# what it is checked against

_BOTH = f"SELECT *, {matched_sql(D)} AS rules FROM ({L.view(D, f'SELECT {COLUMNS} FROM ({submissions_sql(D)}) AS a UNION ALL SELECT {COLUMNS} FROM ({cases_sql(D)}) AS b')}) AS v"


def _strings() -> str:
    rows = []
    for r in RULES:
        for n, (k, (kind, p)) in enumerate(r.strings.items()):
            lit = {"=": D.text(p), "~": D.text(p.lower())}.get(kind) or ("NULL" if kind[0] == "/" else " || ".join(f"chr({int(p[i : i + 2], 16)})" for i in range(0, len(p), 2)))
            rx = D.text(("(?i)" if kind == "/i" else "") + p) if kind[0] == "/" else "CAST(NULL AS VARCHAR)"
            rows.append(f"({r.number}, {n}, '{k}', '{H.group_of(k)}', {str(kind == '~').lower()}, {str(kind == 'x0').lower()}, {lit}, {rx})")
    return "strings(rule_no, ord, string, grp, nocase, at_start, lit, rx) AS (VALUES " + ", ".join(rows) + ")"


def _hits_sql(source: str) -> str:
    """CTEs hits and pairs of the rows (id, t, low, rules) of source."""
    return f"""{_strings()}, rule(rule_no, name, severity, category) AS (VALUES {_META}), fires AS MATERIALIZED (SELECT id, t, low, unnest(rules) AS rule_no FROM ({source}) AS q),
literal AS (SELECT f.*, ord, string, grp, string_split(CASE WHEN nocase THEN low ELSE t END, lit) AS p, length(lit) AS n FROM fires f JOIN strings s ON s.rule_no = f.rule_no WHERE lit IS NOT NULL AND NOT at_start),
pattern AS (SELECT f.*, ord, string, grp, regexp_split_to_array(t, rx) AS p, regexp_extract_all(t, rx) AS m FROM fires f JOIN strings s ON s.rule_no = f.rule_no WHERE rx IS NOT NULL),
hits AS MATERIALIZED (
  SELECT id, rule_no, ord, string, grp, CAST(place AS BIGINT) AS place, substr(t, place + 1, n) AS text FROM (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY id, rule_no, ord ORDER BY k) + (k - 1) * n AS BIGINT) AS place FROM (SELECT *, unnest(p) AS piece, generate_subscripts(p, 1) AS k, len(p) AS pieces FROM literal)) WHERE k < pieces
  UNION ALL
  SELECT id, rule_no, ord, string, grp, CAST(place AS BIGINT), m[k] FROM (SELECT *, sum(length(piece) + CASE WHEN k > 1 THEN length(m[k - 1]) ELSE 0 END) OVER (PARTITION BY id, rule_no, ord ORDER BY k) AS place FROM (SELECT *, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM pattern)) WHERE k <= len(m)
  UNION ALL
  SELECT id, f.rule_no, ord, string, grp, CAST(0 AS BIGINT), lit FROM fires f JOIN strings s ON s.rule_no = f.rule_no WHERE at_start AND starts_with(t, lit)
),
pairs AS MATERIALIZED (
  SELECT id, rule_no, group_a, group_b, distance, at_place FROM (
    SELECT a.id, a.rule_no, a.grp AS group_a, b.grp AS group_b, abs(a.place - b.place) AS distance, least(a.place, b.place) AS at_place,
      row_number() OVER (PARTITION BY a.id, a.rule_no, a.grp, b.grp ORDER BY abs(a.place - b.place), a.ord, a.place, b.ord, b.place) AS k
    FROM hits a JOIN hits b ON a.id = b.id AND a.rule_no = b.rule_no AND a.grp < b.grp) WHERE k = 1
),
evidence5 AS (
  SELECT f.id, 0 AS part, 'yara-rule' AS kind, name AS label, category AS detail, CAST(NULL AS BIGINT) AS place, severity FROM fires f JOIN rule USING (rule_no)
  UNION ALL SELECT id, 1, 'yara-string', name || '/$' || string, CASE WHEN length(flat) > 40 THEN left(flat, 40) || '...' ELSE flat END, place, severity FROM (SELECT *, trim(regexp_replace(text, '[\\r\\n\\t ]+', ' ', 'g')) AS flat FROM hits) JOIN rule USING (rule_no)
  UNION ALL SELECT id, 2, 'yara-proximity', name || '/' || group_a || '~' || group_b, distance || ' bytes apart, ' || CASE WHEN distance <= {CO_LOCATED} THEN 'co-located' ELSE 'distant' END, at_place, severity FROM pairs JOIN rule USING (rule_no)
)"""


_META = ", ".join(f"({r.number}, '{r.name}', '{r.severity}', '{r.category}')" for r in RULES)
_MATCHED = f"WITH rule(rule_no, name, severity, category) AS (VALUES {_META}), m AS (SELECT id, unnest({matched_sql(D)}) AS rule_no FROM ({L.view(D, submissions_sql(D))}) AS v)"
_HITS = f"WITH src AS MATERIALIZED (SELECT id, t, low, rules FROM ({_BOTH}) AS b WHERE len(rules) > 0), {_hits_sql('SELECT * FROM src')} "
_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY id, rule_no ORDER BY ord, place) - 1 AS k FROM hits"
_RANKED = "SELECT *, row_number() OVER (PARTITION BY id, rule_no ORDER BY distance, group_a, group_b) - 1 AS k FROM pairs"


def _scan_sql() -> str:
    """CTEs of the nine layers over the submissions. Their payloads are texts: no stream of theirs inflates, none is an image, and a drawing among them is never well-formed."""
    small = "len(rules) > 0"
    layer = f"CASE WHEN l1 IS NOT NULL THEN 1 WHEN detected IS NULL THEN 2 WHEN l3 IS NOT NULL THEN 3 WHEN l4 IS NOT NULL THEN 4 WHEN {small} THEN 5 WHEN l5c IS NOT NULL THEN 7 WHEN detected = 'svg' THEN 9 ELSE 10 END"
    source = f"SELECT *, sha256(payload) AS sha256 FROM ({L.inspected(D, submissions_sql(D))}) AS i"
    matches = " UNION ALL ".join(f"SELECT id, 2 AS layer_no, 'magic-match' AS kind, '{kind} @{off}' AS label, CAST({off} AS BIGINT) AS place, 'info' AS severity FROM c WHERE detected = '{kind}'" for kind, parts in SIGNATURES.items() for off, _ in parts)
    near = " UNION ALL ".join(
        f"SELECT id, 2, 'magic-near-miss', '{kind} @{off}', CAST({off + k} AS BIGINT), 'low' FROM c WHERE layer_no = 2 AND length(head) >= 8 AND substr(head, {2 * off + 1}, {2 * k}) = '{sig[: 2 * k]}' AND substr(head, {2 * off + 1}, {2 * k + 2}) <> '{sig[: 2 * k + 2]}'"
        for kind, parts in SIGNATURES.items()
        for off, sig in parts
        for k in range(1, len(sig) // 2)
    )
    text_at = "CASE " + " ".join(f"WHEN contains(probe, '{m}') THEN strpos(ltrim(probe, chr(65279) || ' ' || chr(9) || chr(13) || chr(10)), '{m}') - 1" for _, m in FOREIGN_TEXT) + " END"
    binary = "(" + " OR ".join(f"starts_with(head, '{sig}')" for _, sig in L.FOREIGN) + ")"
    schemes = " UNION ALL ".join(f"SELECT id, 7, 'link-scheme', '{s}:', CAST(length(regexp_extract(low, '(?s)^((?:.*?[^A-Za-z0-9+.\\-])??){s}\\s*:', 1)) AS BIGINT), 'high' FROM c WHERE layer_no >= 7 AND {L.linkable(D)} AND {L.scheme(D)} = '{s}'" for s in SCHEMES)
    uris = " UNION ALL ".join(f"SELECT id, 7, 'link-datauri', '{s}', CAST(strpos(low, '{s}') - 1 AS BIGINT), 'high' FROM c WHERE layer_no >= 7 AND {L.linkable(D)} AND {L.scheme(D)} IS NULL AND {L.data_uri(D)} = '{s}'" for s in DATA_URIS)
    linked = f"layer_no >= 7 AND {L.linkable(D)}"
    pdf = "strpos(t, '%PDF') BETWEEN 1 AND 1021"
    last = "lower(regexp_extract(file_name, '^.+[.]([^.]+)$', 1))"
    ranks = "CASE severity " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(SEVERITIES)) + " END"
    return f"""WITH i AS MATERIALIZED ({source}), c AS MATERIALIZED (SELECT *, {layer} AS layer_no FROM i), {_hits_sql("SELECT id, t, low, rules FROM c WHERE layer_no = 5")},
ev AS MATERIALIZED (
  SELECT id, 2 AS layer_no, 'magic-size' AS kind, 'bytes-available' AS label, CAST(0 AS BIGINT) AS place, 'low' AS severity FROM c WHERE layer_no = 2 AND length(head) < 8
  UNION ALL SELECT id, 2, 'magic-observed', 'header', 0, 'info' FROM c WHERE layer_no = 2 AND length(head) >= 8
  UNION ALL SELECT id, 2, 'magic-foreign', found, CASE WHEN {binary} THEN 0 ELSE {text_at} END, 'medium' FROM c WHERE layer_no = 2 AND length(head) >= 8 AND found IS NOT NULL
  UNION ALL {near}
  UNION ALL SELECT * FROM ({matches}) AS m WHERE id IN (SELECT id FROM c WHERE layer_no > 1)
  UNION ALL SELECT id, 2, 'magic-match', 'svg marker', strpos(probe, '<svg') - 1, CASE WHEN {L.svg_root(D)} THEN 'info' ELSE 'low' END FROM c WHERE layer_no > 1 AND detected = 'svg'
  UNION ALL SELECT id, 3, unnest(['hcm-detected', 'hcm-declared']), unnest(['content', 'declared']), NULL, 'info' FROM c WHERE layer_no >= 3
  UNION ALL SELECT id, 3, CASE WHEN l3 IS NULL THEN 'hcm-match' ELSE 'hcm-mismatch' END, detected || ' policy', NULL, CASE WHEN l3 IS NOT NULL THEN 'medium' WHEN declared_as = 'alias' THEN 'low' ELSE 'info' END FROM c WHERE layer_no >= 3 AND coalesce(l3, '') <> 'HCM-MISSING'
  UNION ALL SELECT id, 3, CASE WHEN extension_says = 'disagrees' THEN 'hcm-extension-mismatch' ELSE 'hcm-extension' END, CASE extension_says WHEN 'none' THEN 'extension' WHEN 'disagrees' THEN '.' || {last} || ' vs ' || detected ELSE '.' || {last} END, NULL, CASE WHEN extension_says = 'disagrees' THEN 'medium' ELSE 'info' END FROM c WHERE layer_no >= 3
  UNION ALL SELECT id, 5, kind, label, place, severity FROM evidence5
  UNION ALL SELECT id, 6, 'pdfflate-survey', unnest(['streams', 'max-nesting-depth']), NULL, 'info' FROM c WHERE layer_no >= 6 AND {pdf}
  UNION ALL SELECT id, 7, 'link-scope', 'not-linkable', NULL, 'info' FROM c WHERE layer_no >= 7 AND NOT {L.linkable(D)}
  UNION ALL SELECT id, 7, 'link-scope', CASE WHEN {pdf} THEN 'pdf raw-bytes only' ELSE 'svg literal text' END, NULL, CASE WHEN contains(t, CASE WHEN {pdf} THEN '/FlateDecode' ELSE '&#' END) THEN 'low' ELSE 'info' END FROM c WHERE {linked}
  UNION ALL SELECT id, 7, 'link-policy', 'external-links', NULL, 'info' FROM c WHERE {linked}
  UNION ALL {schemes}
  UNION ALL {uris}
  UNION ALL SELECT id, 7, 'link-inventory', 'http(s) links', CASE WHEN regexp_matches(t, {D.text('(?i)' + URL)}) THEN length(regexp_extract(t, {D.text('(?is)^(.*?)' + URL)}, 1)) END, 'info' FROM c WHERE {linked} AND {L.scheme(D)} IS NULL AND {L.data_uri(D)} IS NULL
  UNION ALL SELECT id, 8, 'reencode-scope', 'not-raster', NULL, 'info' FROM c WHERE layer_no >= 8
  UNION ALL SELECT id, 9, CASE WHEN detected = 'svg' THEN 'svg-parse-error' ELSE 'svg-scope' END, CASE WHEN detected = 'svg' THEN 'xml' ELSE 'not-svg' END, NULL, CASE WHEN detected = 'svg' THEN 'unknown' ELSE 'info' END FROM c WHERE layer_no >= 9
),
tops AS (SELECT id, min({ranks}) AS top, bool_or(severity = 'unknown') AS lost, bool_or(severity = 'high') AS any_high, bool_and(severity IN ('info', 'low')) AS only_slight, bool_or(kind = 'yara-rule') AS has_rule, count_if(severity IN ('high', 'medium')) AS notable, count_if(severity IN ('critical', 'high', 'medium', 'test')) AS told, count_if(severity = 'test') AS tests FROM ev GROUP BY id),
done AS MATERIALIZED (
  SELECT c.*, CASE WHEN layer_no = 10 THEN 'accepted' ELSE 'rejected' END AS decision, least(layer_no, 9) AS layers_run,
    CASE WHEN layer_no = 10 THEN '' ELSE ([{', '.join(f"'{x}'" for x in LAYERS)}])[layer_no] END AS stopped_at,
    CASE layer_no WHEN 10 THEN '' WHEN 1 THEN 'UNCODED' WHEN 2 THEN CASE WHEN length(head) < 8 THEN 'magic-size' ELSE 'magic-observed' END WHEN 3 THEN l3 WHEN 4 THEN l4 WHEN 5 THEN 'yara-rule' WHEN 7 THEN l5c ELSE 'SVG-PARSE' END AS reason_code,
    coalesce(([{', '.join(f"'{s}'" for s in SEVERITIES)}])[top + 1], '') AS top_severity,
    coalesce(lost, false) AS is_scanner_error, coalesce(told > 0 AND told = tests, false) AS is_test_only, false AS is_neutralized, false AS content_rewritten, CASE WHEN layer_no = 10 THEN size_bytes ELSE 0 END AS stored_size,
    coalesce(any_high, false) AS any_high, coalesce(only_slight, false) AS only_slight, coalesce(has_rule, false) AS has_rule, coalesce(notable, 0) AS notable
  FROM c LEFT JOIN tops ON tops.id = c.id
)"""


def _compared_sql() -> str:
    flat = " UNION ALL ".join(f"SELECT *, '{name}' AS scanner, coalesce({test}, false) AS ok FROM done" for name, test in {**comparators(D), "DVWA-Impossible": "false"}.items())
    own = f"scanner = '{SCANNERS[-1]}'"
    return f"""{_scan_sql()}, results AS (
  SELECT id, truth, category, file_name, ext, sha256, size_bytes, scanner, ok AS accepted, false AS content_rewritten, CASE WHEN ok THEN '' WHEN {own} THEN reason_code ELSE 'UNCODED' END AS reason_code,
    CASE WHEN NOT ok THEN 0 ELSE size_bytes END AS stored_size, CASE WHEN {own} THEN stopped_at ELSE '' END AS stopped_at, CASE WHEN {own} THEN top_severity ELSE '' END AS top_severity, CASE WHEN {own} THEN layers_run ELSE 0 END AS layers_run,
    {own} AND is_scanner_error AS is_scanner_error, {own} AND is_test_only AS is_test_only, false AS is_neutralized
  FROM ({flat} UNION ALL SELECT *, '{SCANNERS[-1]}', decision = 'accepted' FROM done) AS r
)"""


_COUNTS = "count_if(truth = 'malicious' AND refused) AS tp, count_if(truth = 'malicious' AND NOT refused) AS fn, count_if(truth = 'clean' AND NOT refused) AS tn, count_if(truth = 'clean' AND refused) AS fp"
_CACHED = f"SELECT id, truth, row_number() OVER (PARTITION BY sha256(payload) ORDER BY CASE truth WHEN 'malicious' THEN 0 WHEN 'clean' THEN 1 ELSE 2 END, id) > 1 AS from_cache FROM ({submissions_sql(D)}) AS s"
_CONFUSED = f"SELECT scanner, {_COUNTS} FROM (SELECT *, NOT accepted AS refused FROM results WHERE truth IS NOT NULL) AS q GROUP BY scanner"
_ratio = lambda a, b: f"round(CAST({a} AS DOUBLE) / nullif({b}, 0), 6)"
_RATIOS = f"{_ratio('tp', 'tp + fn')} AS recall, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {_ratio('tn', 'tn + fp')} AS specificity, {_ratio('fp', 'tn + fp')} AS fpr"
_flag = lambda c: f"CAST({c} AS INTEGER) AS {c}"


def _json_sql() -> str:
    traces = "'[' || array_to_string(list_transform(range(1, layers_run + 1), lambda k: '{\"layer\":\"' || (names)[k] || '\",\"evidence\":' || len(list_filter(layers, lambda x: x = k)) || '}'), ',') || ']'"
    names = "[" + ", ".join(f"'{x}'" for x in LAYERS) + "]"
    return f"""SELECT id, '{{"id":' || id || ',"accepted":' || CASE WHEN decision = 'accepted' THEN 'true' ELSE 'false' END || ',"stopped_at":"' || stopped_at || '","traces":' || {traces} || '}}' AS response
FROM (SELECT d.id, decision, stopped_at, layers_run, {names} AS names, coalesce(l.layers, []) AS layers FROM done d LEFT JOIN (SELECT id, list(layer_no) AS layers FROM ev GROUP BY id) l ON l.id = d.id) AS j"""


_SCANNED = {
    "scan_cascade": "SELECT id, decision, stopped_at, reason_code, top_severity, layers_run FROM done",
    "prj_unwrap_layer": f"SELECT d.id, CASE WHEN from_cache THEN 'Cached(' || stopped_at || ')' ELSE stopped_at END AS wrapped, stopped_at AS layer FROM done d JOIN ({_CACHED}) k ON k.id = d.id",
    "scan_layered": "SELECT id, decision, stopped_at, reason_code, top_severity, layers_run, content_rewritten, is_scanner_error, is_test_only, is_neutralized, CAST(stored_size AS BIGINT) AS stored_size FROM done",
    "scan_evidence": "SELECT id, layer_no, kind, label, CAST(place AS BIGINT) AS place, severity FROM ev",
    "prj_notable": "SELECT id, notable FROM done",
    "agg_severity_order": "SELECT severity, rank_no, coalesce(files, 0) AS files FROM (VALUES " + ", ".join(f"('{s}', {k})" for k, s in enumerate(SEVERITIES)) + ") AS o(severity, rank_no) LEFT JOIN (SELECT top_severity, count(*) AS files FROM done GROUP BY 1) AS t ON t.top_severity = o.severity",
    "agg_top_severity": "SELECT top_severity, count(*) AS files FROM done GROUP BY 1",
    "agg_quantifiers": "SELECT id, any_high, only_slight, has_rule FROM done",
    "agg_reason_breakdown": "SELECT reason_code, decision, count(*) AS files FROM done GROUP BY 1, 2",
    "agg_funnel": f"SELECT l.k AS layer_no, ([{', '.join(repr(x) for x in LAYERS)}])[l.k] AS layer, count(*) AS reached, count_if(decision = 'rejected' AND layers_run = l.k) AS refused FROM done, (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS k) AS l WHERE layers_run >= l.k GROUP BY l.k",
    "src_list_files": "SELECT category, file_name AS stored_name, CAST(size_bytes AS BIGINT) AS size FROM done WHERE decision = 'accepted'",
    "prj_outcome3": "SELECT id, CASE WHEN decision = 'rejected' THEN 'Rejected' ELSE 'Accepted' END AS outcome FROM done",
    "fn_reason_code": "SELECT id, reason_code AS code FROM done",
    "snk_json_response": _json_sql(),
    "flt_demo_gate": "SELECT id, true AS demo, 200 AS compare_status, layers_run AS traced FROM done UNION ALL SELECT id, false, 404, 0 FROM done",
}
_RESULTS = {
    "compare_run": "SELECT id, scanner, accepted, content_rewritten, reason_code, CAST(stored_size AS BIGINT) AS stored_size FROM results",
    "join_files_x_scanners": "SELECT scanner, count(*) AS files, count_if(accepted) AS accepted FROM results GROUP BY scanner",
    "agg_accept_ratio": "SELECT id, count_if(accepted) AS accepted, count(*) AS scanners FROM results GROUP BY id",
    "snk_compare_store": "SELECT id, scanner, lower(scanner) || CASE WHEN ext = '' OR length(ext) > 10 THEN '.bin' ELSE ext END AS stored_name, CAST(stored_size AS BIGINT) AS stored_size FROM results WHERE accepted",
    "corpus_flags": f"SELECT id, scanner, {', '.join(map(_flag, ('accepted', 'is_scanner_error', 'is_test_only', 'is_neutralized')))} FROM results",
    "agg_confusion": _CONFUSED,
    "agg_confusion_strict": _CONFUSED.replace("truth IS NOT NULL", "truth IS NOT NULL AND NOT is_scanner_error AND NOT is_test_only"),
    "agg_severity_gate": f"SELECT scanner, {_COUNTS} FROM (SELECT *, NOT accepted AND top_severity IN ('high', 'critical') AS refused FROM results WHERE truth IS NOT NULL AND scanner = '{SCANNERS[-1]}') AS q GROUP BY scanner",
    "agg_metrics_published": f"SELECT scanner, {_RATIOS} FROM (SELECT 'gated' AS scanner, {', '.join(f'CAST({n} AS BIGINT) AS {c}' for n, c in zip(PUBLISHED, ('tp', 'fn', 'tn', 'fp'), strict=True))} UNION ALL SELECT scanner, {_COUNTS} FROM (SELECT *, NOT accepted AND top_severity IN ('high', 'critical') AS refused FROM results WHERE truth IS NOT NULL AND scanner = '{SCANNERS[-1]}') AS q GROUP BY scanner) AS p",
    "agg_metrics": f"SELECT scanner, {_RATIOS} FROM ({_CONFUSED}) AS m",
    "agg_corpus_summary": f"SELECT count_if(scanner = '{SCANNERS[-1]}') AS processed, count_if(scanner = '{SCANNERS[-1]}' AND truth = 'malicious') AS malicious, count_if(scanner = '{SCANNERS[-1]}' AND truth = 'clean') AS clean, count_if(is_scanner_error) AS scanner_errors, count(*) AS result_rows FROM results WHERE truth IS NOT NULL",
    "corpus_run": f"SELECT file_name AS file, r.truth || '/' || file_name AS relative_path, sha256, CAST(size_bytes AS BIGINT) AS size_bytes, r.truth, category, scanner, {', '.join(map(_flag, ('accepted', 'content_rewritten', 'is_scanner_error', 'is_test_only', 'is_neutralized')))}, stopped_at AS stopped_at_layer, reason_code, top_severity, layers_run, CAST(from_cache AND scanner = '{SCANNERS[-1]}' AS INTEGER) AS from_cache, CAST(stored_size AS BIGINT) AS stored_size, CASE WHEN accepted THEN '' WHEN stopped_at = '' THEN 'refused' ELSE reason_code || ': refused by ' || stopped_at END AS reason FROM results r JOIN ({_CACHED} WHERE truth IS NOT NULL) AS k ON k.id = r.id",
}
_LINKS = f"""WITH src AS (SELECT id, t, lower(t) AS low FROM (SELECT id, {D.latin('payload')} AS t FROM ({submissions_sql(D)}) AS s) AS u),
cut AS (SELECT id, regexp_extract_all(t, {D.text('(?i)' + URL)}) AS m, regexp_split_to_array(t, {D.text('(?i)' + URL)}) AS p FROM src WHERE {L.linkable(D)}),
links AS MATERIALIZED (SELECT id, k - 1 AS ord, m[k] AS url, lower(regexp_extract(m[k], {D.text('(?i)' + HOST.replace('(?i)', ''))}, 1)) AS host, CAST(before AS BIGINT) AS place
  FROM (SELECT *, sum(length(piece) + CASE WHEN k > 1 THEN length(m[k - 1]) ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS before FROM (SELECT *, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM cut)) WHERE k <= len(m)) """
_FAR = f"SELECT * FROM links WHERE {kind_of_host()} = 'untrusted'"
SQL = {
    "src_rules": f"{_MATCHED} SELECT r.*, coalesce(c.files, 0) AS files FROM (VALUES " + ", ".join(f"({r.number}, '{r.name}', '{r.category}', '{r.severity}', CAST({len(r.strings)} AS BIGINT), '{r.condition}')" for r in RULES) + ") AS r(rule_no, rule, category, severity, strings, condition) LEFT JOIN (SELECT rule_no, count(*) AS files FROM m GROUP BY rule_no) AS c ON c.rule_no = r.rule_no",
    "yara_counts": f"{_MATCHED} SELECT name AS rule, count(*) AS files FROM m JOIN rule USING (rule_no) GROUP BY name",
    "yara_by_severity": f"{_MATCHED} SELECT severity, category, count(*) AS matches, count(DISTINCT id) AS files FROM m JOIN rule USING (rule_no) GROUP BY severity, category",
    "yara_hits": _HITS + "SELECT id, rule_no, string, place, text FROM hits",
    "agg_group_hits": _HITS + "SELECT id, rule_no, grp, count(*) AS hits, count(DISTINCT string) AS strings, min(place) AS first_at FROM hits GROUP BY id, rule_no, grp",
    "join_proximity": _HITS + f"SELECT id, rule_no, group_a, group_b, distance, at_place AS at, distance <= {CO_LOCATED} AS co_located FROM pairs",
    "topk_strings": _HITS + f"SELECT id, rule_no, k, string, place FROM ({_NUMBERED}) AS n WHERE k < 8",
    "topk_pairs": _HITS + f"SELECT id, rule_no, k, group_a, group_b, distance FROM ({_RANKED}) AS n WHERE k < 3",
    "yara_evidence": _HITS + "SELECT id, kind, label, detail, place, severity FROM evidence5",
    "yara_parse": _HITS + "SELECT id, name AS rule, severity, category, CAST(NULL AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS string, CAST(NULL AS VARCHAR) AS text FROM fires JOIN rule USING (rule_no) UNION ALL SELECT id, name, severity, category, place, '$' || string, regexp_replace(text, '[^\\x20-\\x7e]', '.', 'g') FROM hits JOIN rule USING (rule_no)",
    "yara_describe": _HITS
    + f""", told AS (SELECT id, rule_no, string_agg('"' || CASE WHEN length(flat) > 40 THEN left(flat, 40) || '...' ELSE flat END || '" at 0x' || printf('%x', place), ', ' ORDER BY k) FILTER (k < 8) AS strings, count(*) AS n FROM (SELECT *, trim(regexp_replace(text, '[\\r\\n\\t ]+', ' ', 'g')) AS flat FROM ({_NUMBERED}) AS a) AS b GROUP BY id, rule_no),
close AS (SELECT id, rule_no, string_agg(group_a || '~' || group_b || ' ' || distance || 'B ' || CASE WHEN distance <= {CO_LOCATED} THEN 'co-located' ELSE 'distant' END, ', ' ORDER BY k) AS pairs FROM ({_RANKED}) AS a WHERE k < 3 GROUP BY id, rule_no)
SELECT f.id, string_agg(name || ' [severity=' || severity || ', category=' || category || ']' || coalesce(' | strings: ' || strings || CASE WHEN n > 8 THEN ', +' || (n - 8) || ' more' ELSE '' END, '') || coalesce(' | proximity: ' || pairs, ''), '  ||  ' ORDER BY f.rule_no) AS reason
FROM fires f JOIN rule USING (rule_no) LEFT JOIN told ON told.id = f.id AND told.rule_no = f.rule_no LEFT JOIN close ON close.id = f.id AND close.rule_no = f.rule_no GROUP BY f.id""",
    "fn_urls": _LINKS + "SELECT id, ord, url, host, place FROM links",
    "join_lookup_types": "SELECT CASE " + " ".join(f"WHEN lower(file_name) LIKE '%{k}' THEN '{v}'" for k, v in DECLARED_BY_EXTENSION.items()) + f" ELSE 'application/octet-stream' END AS content_type, count(*) AS files FROM ({submissions_sql(D)}) AS s GROUP BY 1",
    "l5c_links_blocking": _LINKS
    + f""", far AS ({_FAR}), named AS (SELECT id, string_agg(host, ', ' ORDER BY host) FILTER (k <= 5) || CASE WHEN count(*) > 5 THEN ', +' || (count(*) - 5) || ' more' ELSE '' END AS hosts FROM (SELECT id, host, row_number() OVER (PARTITION BY id ORDER BY host) AS k FROM (SELECT DISTINCT id, host FROM far) AS h) AS r GROUP BY id),
counted AS (SELECT id, count(*) AS links, min(place) AS first_at FROM far GROUP BY id)
SELECT s.id, coalesce(s.l5c, CASE WHEN links > 0 THEN 'EL-EXTERNAL' END) AS l5c, coalesce(links, 0) AS links, hosts, first_at FROM (SELECT id, {L.links(D)} AS l5c FROM ({L.view(D, submissions_sql(D))}) AS v) AS s LEFT JOIN counted c ON c.id = s.id LEFT JOIN named n ON n.id = s.id""",
    "agg_link_inventory": _LINKS + f"SELECT id, count(*) AS links, count(DISTINCT host) AS hosts, count_if(kind = 'namespace') AS namespaces, count_if(kind = 'allowed') AS allow_listed, count_if(kind = 'untrusted') AS untrusted, min(place) AS first_at FROM (SELECT *, {kind_of_host()} AS kind FROM links) AS l GROUP BY id",
    "agg_links_per_host": _LINKS + f"SELECT host, links, files, id, place AS first_at, url FROM (SELECT *, count(*) OVER (PARTITION BY host) AS links, row_number() OVER (PARTITION BY host ORDER BY id, ord) AS k FROM ({_FAR}) AS f) JOIN (SELECT host, count(DISTINCT id) AS files FROM ({_FAR}) AS g GROUP BY host) USING (host) WHERE k = 1",
    "agg_distinct_hosts": _LINKS + f"SELECT id, string_agg(host, ', ' ORDER BY host) AS hosts FROM (SELECT DISTINCT id, host FROM ({_FAR}) AS f) AS h GROUP BY id",
    "topk_hosts": _LINKS + f"SELECT id, string_agg(host, ', ' ORDER BY host) FILTER (k <= 5) || CASE WHEN count(*) > 5 THEN ', +' || (count(*) - 5) || ' more' ELSE '' END AS hosts FROM (SELECT id, host, row_number() OVER (PARTITION BY id ORDER BY host) AS k FROM (SELECT DISTINCT id, host FROM ({_FAR}) AS f) AS h) AS r GROUP BY id",
    "join_verdict_cache": f"SELECT id, unnest({CACHED}) AS layer, sha256(payload) IN (SELECT sha256(payload) FROM ({submissions_sql(D)}) AS k WHERE truth IS NOT NULL) AS hit FROM ({submissions_sql(D)}) AS s",
    "win_from_cache": f"SELECT id, from_cache FROM ({_CACHED}) AS c",
    "sort_paths": f"SELECT id, CAST(row_number() OVER (PARTITION BY truth ORDER BY file_name, id) AS INTEGER) AS place FROM ({submissions_sql(D)}) AS s WHERE truth IS NOT NULL",
    **{k: f"{_scan_sql()} {v}" for k, v in _SCANNED.items()},
    **{k: f"{_compared_sql()} {v}" for k, v in _RESULTS.items()},
}
