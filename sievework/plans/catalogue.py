"""The registered queries of the file-inspection engine. Those of this module are one statement each, rendered for Spark and for DuckDB; bytes_queries and reports have SQL of their own."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.functions.dialect import DUCKDB, SPARK, Spark
from sievework.functions.rules import RULES, rule_sql
from sievework.functions.tables import DECLARED_BY_EXTENSION, HOST, NAMESPACE_HOSTS
from sievework.operators import images
from sievework.operators.cascade import comparators
from sievework.operators.layers import data_uri, inspected, linkable, listed, near_misses, scheme, svg_root, view
from sievework.plans import bytes_queries, reports
from sievework.sources.cases import cases_sql
from sievework.sources.submissions import submissions_sql

TABLES = ("documents", "labels", "pages")
STATEMENTS: dict[str, Callable[[Spark], str]] = {}


def subs(d: Spark) -> str:
    return submissions_sql(d)


def seen(d: Spark) -> str:
    return f"({inspected(d, subs(d))}) AS i"


def both(d: Spark) -> str:
    """Submissions and rule cases, with their measures."""
    cols = "id, truth, category, declared_type, file_name, payload"
    return f"({view(d, f'SELECT {cols} FROM ({subs(d)}) AS a UNION ALL SELECT {cols} FROM ({cases_sql(d)}) AS b')}) AS v"


def octets(d: Spark, x: str = "payload") -> str:
    return f"cast(octet_length(encode({x}{', ' + repr('UTF-8') if d.name == 'spark' else ''})) as bigint)"


# layers
STATEMENTS["l1_extension"] = lambda d: f"SELECT id, l1 FROM {seen(d)}"
STATEMENTS["l2_magic"] = lambda d: f"SELECT id, detected, CASE WHEN length(head) < 8 THEN 'magic-size' WHEN detected IS NULL THEN 'magic-observed' END AS l2 FROM {seen(d)}"
STATEMENTS["l2_svg"] = lambda d: f"SELECT id, cast({'instr' if d.name == 'spark' else 'strpos'}(probe, '<svg') - 1 as bigint) AS at, {svg_root(d)} AS is_root FROM {seen(d)}"
STATEMENTS["l2_foreign"] = lambda d: f"SELECT id, found FROM {seen(d)} WHERE detected IS NULL"
STATEMENTS["l2_near_miss"] = lambda d: f"SELECT id, {near_misses(d)} AS near FROM {seen(d)}"
STATEMENTS["l3_header"] = lambda d: f"SELECT id, l3 FROM {seen(d)}"
STATEMENTS["l3_alias"] = lambda d: f"SELECT id, declared_as FROM {seen(d)} WHERE l3 IS NULL"
STATEMENTS["l3_ext_vs_content"] = lambda d: f"SELECT id, extension_says FROM {seen(d)} WHERE detected IS NOT NULL"
STATEMENTS["l4_double_ext"] = lambda d: f"SELECT id, l4 FROM {seen(d)}"
STATEMENTS["l4_lenient_delta"] = lambda d: f"SELECT id, l4, l4_lenient FROM {seen(d)} WHERE coalesce(l4, '') <> coalesce(l4_lenient, '')"
STATEMENTS["l5_signature"] = lambda d: f"SELECT id, {d.join(d.each('rules', 'r', 'cast(r as string)'), ',')} AS matched FROM {seen(d)}"
STATEMENTS["l5c_links"] = lambda d: f"SELECT id, l5c, CASE WHEN {linkable(d)} THEN {scheme(d)} END AS scheme, CASE WHEN {linkable(d)} THEN {data_uri(d)} END AS data_uri FROM {seen(d)}"



# rules
def _rule(k: int) -> Callable[[Spark], str]:
    return lambda d: f"SELECT id FROM {both(d)} WHERE {rule_sql(RULES[k], d)}"


for _k, _r in enumerate(RULES):
    STATEMENTS[f"yara_{_r.number}"] = _rule(_k)
STATEMENTS["yara_16_pages"] = lambda d: f"SELECT page_id AS id, {rule_sql(RULES[15], d)} AS matched FROM (SELECT page_id, html AS t, lower(html) AS low, html AS raw FROM pages) AS p"


# links
STATEMENTS["fn_host"] = lambda d: f"SELECT page_id, lower({d.rx_extract('url', HOST if d.name == 'spark' else '(?i)' + HOST.replace('(?i)', ''))}) AS host FROM pages"
STATEMENTS["join_semi_allow"] = lambda d: f"SELECT page_id, host FROM (SELECT page_id, lower({d.rx_extract('url', HOST if d.name == 'spark' else '(?i)' + HOST.replace('(?i)', ''))}) AS host FROM pages) AS p WHERE " + d.any_of(d.array("'example.com', 'm.example.net'"), "a", f"host = a OR {'endswith' if d.name == 'spark' else 'ends_with'}(host, '.' || a)")

# scalar functions
STATEMENTS["fn_sha256"] = lambda d: f"SELECT doc_id, {d.sha256('text')} AS sha256 FROM documents"
STATEMENTS["fn_hex_upper"] = lambda d: f"SELECT id, trim({d.rx_replace('head', '(..)', '$1 ')}) AS hex FROM {seen(d)}"
STATEMENTS["fn_hex_offset"] = lambda d: f"SELECT doc_id, '0x' || {d.hex_number('n_chars')} AS hex FROM documents"
STATEMENTS["fn_excerpt"] = lambda d: f"SELECT id, {d.rx_replace(d.rx_extract('payload', r'((?s:.{0,12})(?:javascript:|onload)(?s:.{0,12}))'), r'[^\x20-\x7e]', '.')} AS excerpt FROM ({subs(d)}) AS s WHERE contains(payload, 'javascript:') OR contains(payload, 'onload')"
STATEMENTS["fn_truncate80"] = lambda d: "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS short FROM documents"
STATEMENTS["yara_preview"] = lambda d: "SELECT doc_id, CASE WHEN length(p) > 40 THEN left(p, 40) || '...' ELSE p END AS preview FROM (SELECT doc_id, trim(" + d.rx_replace("text", r"[\r\n\t ]+", " ") + ") AS p FROM documents) AS q"
STATEMENTS["fn_printable_preview"] = lambda d: f"SELECT doc_id, {d.rx_replace('right(t, 48)', '[^\\x20-\\x7e]', '.')} AS preview FROM (SELECT doc_id, {d.latin('text')} AS t FROM documents) AS b"
STATEMENTS["fn_count_ci"] = lambda d: f"SELECT page_id, {d.rx_count('html', '(?i)<script')} AS scripts, {d.rx_count('html', '(?i)</p>')} AS paragraphs FROM pages"
STATEMENTS["fn_index_of_bytes"] = lambda d: f"SELECT page_id, cast({'instr' if d.name == 'spark' else 'strpos'}(t, '<body') - 1 as bigint) AS body_at, cast({'instr' if d.name == 'spark' else 'strpos'}(left(t, 1024), '<p') - 1 as bigint) AS early_at FROM (SELECT page_id, {d.latin('html')} AS t FROM pages) AS b"
STATEMENTS["fn_csv_quote"] = lambda d: "SELECT doc_id, CASE WHEN " + d.rx("text", r"[,\x22\r\n]") + r""" THEN '"' || replace(""" + d.rx_replace("text", r"[\r\n]", " ") + r""", '"', '""') || '"' ELSE text END AS field FROM documents"""
STATEMENTS["fn_dvwa_ext"] = lambda d: f"SELECT id, CASE WHEN contains(file_name, '.') THEN lower({d.rx_extract('file_name', r'[.]([^.]*)$')}) ELSE '' END AS ext FROM ({subs(d)}) AS s"
STATEMENTS["fn_ratio"] = lambda d: f"SELECT doc_id, {d.div('n_chars', 'nullif(doc_id % 7, 0)')} AS ratio FROM documents"
STATEMENTS["src_sample_suffix"] = lambda d: f"SELECT id, {d.rx_replace('file_name', '(?i)([.]sample)+$', '')} AS name FROM ({subs(d)}) AS s"
STATEMENTS["src_guess_type"] = lambda d: "SELECT id, CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DECLARED_BY_EXTENSION.items()) + f" ELSE 'application/octet-stream' END AS guessed FROM {seen(d)}"
STATEMENTS["src_get_file"] = lambda d: f"SELECT id, CASE WHEN lower(category) NOT IN ('profile', 'id') THEN 404 WHEN contains(file_name, '..') OR contains(file_name, '/') OR contains(file_name, '{chr(92) * (2 if d.name == 'spark' else 1)}') THEN 400 ELSE 200 END AS status FROM {seen(d)}"
STATEMENTS["flt_category"] = lambda d: f"SELECT id, lower(trim(category)) IN ('profile', 'id') AND {octets(d)} > 0 AS passes FROM ({subs(d)}) AS s"


# scanners
for _name, _key in (("BasicValidation", "scan_baseline"), ("DVWA-Low", "scan_dvwa_low"), ("DVWA-Medium", "scan_dvwa_medium"), ("DVWA-High", "scan_dvwa_high")):
    STATEMENTS[_key] = lambda d, name=_name: f"SELECT id, {comparators(d)[name]} AS accepted FROM {seen(d)}"
STATEMENTS["flt_size_ext_type"] = lambda d: f"SELECT id, CASE WHEN {octets(d)} = 0 THEN 'empty' WHEN {octets(d)} > 5242880 THEN 'size' WHEN NOT ext IN {listed(['.jpg', '.jpeg', '.png', '.webp', '.svg', '.pdf'])} THEN 'extension' WHEN NOT ({comparators(d)['BasicValidation']}) THEN 'type' END AS refused FROM {seen(d)}"


# evaluation
STATEMENTS["src_corpus_status"] = lambda d: f"WITH s AS (SELECT truth FROM ({subs(d)}) AS f WHERE truth IS NOT NULL) SELECT g.grp, count(s.truth) AS files FROM (SELECT 'malicious' AS grp UNION ALL SELECT 'clean') AS g LEFT JOIN s ON s.truth = g.grp GROUP BY g.grp UNION ALL SELECT 'total', count(*) FROM s"
STATEMENTS["agg_ablation"] = lambda d: f"SELECT count_if(l4 IS NOT NULL) AS strict_refused, count_if(l4_lenient IS NOT NULL) AS lenient_refused, count_if({d.size('rules')} > 0 AND l5c IS NULL) AS rules_only, count_if({d.size('rules')} = 0 AND l5c IS NOT NULL) AS links_only FROM {seen(d)}"
# sets
STATEMENTS["set_union_groups"] = lambda d: f"SELECT 0 AS group_rank, id, file_name FROM ({subs(d)}) AS s WHERE truth = 'malicious' UNION ALL SELECT 1, id, file_name FROM ({subs(d)}) AS s WHERE truth = 'clean'"
STATEMENTS["join_lookup_hosts"] = lambda d: "SELECT h.host, count(p.page_id) AS pages FROM (" + " UNION ALL ".join(f"SELECT '{h}' AS host" for h in NAMESPACE_HOSTS) + f") AS h LEFT JOIN (SELECT page_id, lower({d.rx_extract('url', HOST if d.name == 'spark' else '(?i)' + HOST.replace('(?i)', ''))}) AS host FROM pages) AS p ON p.host = h.host GROUP BY h.host"


# what reports list
STATEMENTS["fn_last_index_bytes"] = lambda d: f"SELECT page_id, CASE WHEN contains(t, '</p>') THEN cast(length(t) - {'instr' if d.name == 'spark' else 'strpos'}(reverse(t), '>p/<') + 1 as bigint) END AS end_at FROM (SELECT page_id, {d.latin('html')} AS t FROM pages) AS b"
def riff_end(source: str) -> str:
    """Spark SQL: id and the end that a RIFF header states."""
    return f"SELECT id, {images.riff_end('content')} AS end_at FROM ({source}) AS c"


def _riff_sql() -> str:
    byte = lambda k: f"CAST('0x' || substr(raw, {2 * k + 1}, 2) AS BIGINT)"
    end = "8 + " + " + ".join(f"{256**k} * {byte(4 + k)}" for k in range(4))
    return f"SELECT id, CASE WHEN end_at BETWEEN 12 AND length(raw) // 2 THEN end_at END AS end_at FROM (SELECT id, raw, CASE WHEN length(raw) >= 16 THEN {end} END AS end_at FROM (SELECT id, hex(encode(payload)) AS raw FROM ({submissions_sql(DUCKDB)}) AS s) AS h) AS r"


STATEMENTS["fn_riff_end"] = lambda d: riff_end(f"SELECT id, encode(payload, 'UTF-8') AS content FROM ({subs(d)}) AS s") if d.name == "spark" else _riff_sql()


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]  # views of a folder's own, so that two folders' don't replace one another
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", rf"\1 \2_{at}", STATEMENTS[name](SPARK))
        for t in TABLES:
            if f"{t}_{at}" in text:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"{t}_{at}")
        return spark.sql(text)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(name) for name in STATEMENTS} | bytes_queries.QUERIES | reports.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: f(DUCKDB) for name, f in STATEMENTS.items()} | bytes_queries.SQL | reports.SQL
