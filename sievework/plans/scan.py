"""The whole inspection of files with binary content: all nine layers with what each reports, the rewritten bytes, and the comparison scanners.

One pass: the layers up to the rules and the links are JVM expressions; then one Python stage opens or rewrites the files that are still alive and carries no bytes of the others; the rules over inflated streams and the verdict are expressions again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.dialect import SPARK
from sievework.functions.rules import matched_sql
from sievework.functions.tables import DATA_URIS, HOST, LAYERS, SCHEMES, SEVERITIES, URL
from sievework.operators import hits as H
from sievework.operators import layers as L
from sievework.operators.cascade import comparators, reencodable
from sievework.operators.rewriting import OPENED, opened, per_file
from sievework.sources.submissions import submissions_sql

_IS_PDF = "instr(t, '%PDF') BETWEEN 1 AND 1021"
_none = "cast(array() as array<struct<layer_no:int,kind:string,label:string,detail:string,place:bigint,severity:string>>)"
_names = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"


def measured(files: DataFrame) -> DataFrame:
    """Files with what several layers use: ext, head, t (a character a byte), low, raw and probe."""
    ext = SPARK.rx_extract("file_name", r"(\.[^./\\]+)$")
    out = files.withColumn("content", F.coalesce("content", F.lit(b"")))
    out = out.selectExpr("*", f"lower({ext}) AS ext", "hex(substring(content, 1, 16)) AS head", "decode(content, 'ISO-8859-1') AS t", "content AS raw", "lower(make_valid_utf8(cast(substring(content, 1, 1024) as string))) AS probe", "cast(octet_length(content) as bigint) AS size_bytes", "sha2(content, 256) AS sha256")
    return out.selectExpr("*", "lower(t) AS low")


def _magic() -> str:
    """What the second layer reports."""
    svg_at = "instr(probe, '<svg') - 1"
    types = " ".join(f"WHEN '{t}' THEN array({', '.join(H.item(2, repr('magic-match'), repr(f'{t} @{off}'), str(off), repr('info')) for off, _ in parts)})" for t, parts in L.SIGNATURES.items())
    near = f"transform(filter(split({L.near_misses(SPARK)}, ','), x -> x <> ''), x -> {H.item(2, repr('magic-near-miss'), 'replace(split_part(x, ' + repr(':') + ', 1), ' + repr('@') + ', ' + repr(' @') + ')', 'cast(split_part(split_part(x, ' + repr('@') + ', 2), ' + repr(':') + ', 1) as bigint) + cast(split_part(x, ' + repr(':') + ', 2) as bigint)', repr('low'))})"
    foreign = f"CASE WHEN {L.foreign(SPARK)} IS NULL THEN {_none} ELSE array({H.item(2, repr('magic-foreign'), L.foreign(SPARK), L.foreign_at(SPARK), repr('medium'))}) END"
    observed = f"concat(array({H.item(2, repr('magic-observed'), repr('header'), '0', repr('info'), 'head')}), {foreign}, {near})"
    marker = H.item(2, "'magic-match'", "'svg marker'", svg_at, f"if({L.svg_root(SPARK)}, 'info', 'low')")
    return f"CASE WHEN length(head) < 8 THEN array({H.item(2, repr('magic-size'), repr('bytes-available'), '0', repr('low'))}) ELSE CASE detected {types} WHEN 'svg' THEN array({marker}) ELSE {observed} END END"


def _header() -> str:
    declared = f"array({H.item(3, repr('hcm-detected'), repr('content'), 'NULL', repr('info'), 'detected')}, {H.item(3, repr('hcm-declared'), repr('declared'), 'NULL', repr('info'))})"
    policy = H.item(3, "if(l3 IS NULL, 'hcm-match', 'hcm-mismatch')", "detected || ' policy'", "NULL", f"CASE WHEN l3 IS NOT NULL THEN 'medium' WHEN {L.alias(SPARK)} = 'alias' THEN 'low' ELSE 'info' END")
    says, last = L.extension_says(SPARK), f"lower({SPARK.rx_extract('file_name', r'^.+[.]([^.]+)$')})"
    label = f"CASE {says} WHEN 'none' THEN 'extension' WHEN 'disagrees' THEN '.' || {last} || ' vs ' || detected ELSE '.' || {last} END"
    extension = H.item(3, f"if({says} = 'disagrees', 'hcm-extension-mismatch', 'hcm-extension')", label, "NULL", f"if({says} = 'disagrees', 'medium', 'info')")
    return f"concat({declared}, CASE WHEN l3 = 'HCM-MISSING' THEN {_none} ELSE array({policy}) END, array({extension}))"


def untrusted_links(t: str, allowed: list[str]) -> str:
    """Links to hosts that are neither namespaces nor allowed: an array of (host, place) in the order of places."""
    host = f"lower({SPARK.rx_extract('z.text', HOST)})"
    named = f"transform({H.matches(t, SPARK.text('(?i)' + URL))}, z -> named_struct('host', {host}, 'place', z.place))"
    return f"filter({named}, z -> z.host <> '' AND {L.trust_of('z.host', allowed)} = 'untrusted')"


def _links(blocking: bool) -> str:
    scheme, uri = L.scheme(SPARK), L.data_uri(SPARK)
    scheme_at = f"CASE {scheme} " + " ".join(f"WHEN '{s}' THEN regexp_instr(low, {SPARK.text(chr(40) + '?<![A-Za-z0-9+.' + chr(92) + '-])' + s + chr(92) + 's*:')}) - 1" for s in SCHEMES) + " END"
    uri_at = f"CASE {uri} " + " ".join(f"WHEN '{s}' THEN instr(low, '{s}') - 1" for s in DATA_URIS) + " END"
    scope = H.item(7, "'link-scope'", f"if({_IS_PDF}, 'pdf raw-bytes only', 'svg literal text')", "NULL", f"if(contains(t, if({_IS_PDF}, '/FlateDecode', '&#')), 'low', 'info')")
    policy = H.item(7, "'link-policy'", "'external-links'", "NULL", "'info'")
    first = f"nullif(regexp_instr(t, {SPARK.text('(?i)' + URL)}), 0) - 1"
    found = f"CASE WHEN {scheme} IS NOT NULL THEN {H.item(7, repr('link-scheme'), scheme + ' || ' + repr(':'), scheme_at, repr('high'))} WHEN {uri} IS NOT NULL THEN {H.item(7, repr('link-datauri'), uri, uri_at, repr('high'))} ELSE {H.item(7, repr('link-inventory'), repr('http(s) links'), first, repr('info'))} END"
    hosts, of_host = "array_sort(array_distinct(transform(far, z -> z.host)))", "filter(far, z -> z.host = h)"
    external = H.item(7, "'link-external'", "h", f"{of_host}[0].place", "'medium'", f"size({of_host}) || ' link(s)'")
    far = f"CASE WHEN size(far) > 0 AND {scheme} IS NULL AND {uri} IS NULL THEN transform(slice({hosts}, 1, 5), h -> {external}) ELSE {_none} END" if blocking else _none
    return f"CASE WHEN NOT {L.linkable(SPARK)} THEN array({H.item(7, repr('link-scope'), repr('not-linkable'), 'NULL', repr('info'))}) ELSE concat(array({scope}, {policy}, {found}), {far}) END"


def _pdf() -> str:
    survey = f"array({H.item(6, repr('pdfflate-survey'), repr('streams'), 'NULL', repr('info'), 'cast(streams as string)')}, {H.item(6, repr('pdfflate-survey'), repr('max-nesting-depth'), 'NULL', 'if(depth > 1, ' + repr('low') + ', ' + repr('info') + ')', 'cast(depth as string)')})"
    return f"CASE WHEN NOT is_pdf THEN {_none} WHEN pdf_error IS NOT NULL THEN array({H.item(6, repr('scanner-error'), 'pdf_error', 'NULL', repr('unknown'))}) WHEN bomb THEN array({H.item(6, repr('pdfflate-bomb'), repr('expansion'), 'NULL', repr('high'))}) ELSE concat({survey}, {H.of_rules('inner_fired', 6, 'pdfflate-yara')}) END"


def _image() -> str:
    trailing = H.item(8, "'reencode-trailing'", "'appended-data'", "CASE WHEN trailing_bytes IS NOT NULL THEN size_bytes - trailing_bytes END", "CASE WHEN trailing_bytes IS NULL THEN 'low' WHEN trailing_bytes > 0 THEN 'high' ELSE 'info' END")
    failed = H.item(8, "'scanner-error'", "refused", "NULL", "'unknown'")
    done = f"array({trailing}, {H.item(8, repr('reencode-decode'), repr('pixels'), 'NULL', repr('info'), 'width || ' + repr('x') + ' || height')}, {H.item(8, repr('reencode-lsb'), repr('pixel-domain'), 'NULL', repr('medium'))}, {H.item(8, repr('reencode-rewrite'), repr('before/after'), 'NULL', 'if(trailing_bytes > 0, ' + repr('high') + ', ' + repr('info') + ')', 'sha2(rewritten, 256)')})"
    raster = "coalesce(detected, '') IN ('jpeg', 'png', 'webp')"
    return f"CASE WHEN NOT {raster} THEN array({H.item(8, repr('reencode-scope'), repr('not-raster'), 'NULL', repr('info'))}) WHEN refused = 'dimensions' THEN array({H.item(8, repr('reencode-bomb'), repr('dimensions'), 'NULL', repr('high'))}) WHEN refused = 'no image header' THEN array({failed}) WHEN refused IS NOT NULL THEN array({trailing}, {failed}) ELSE {done} END"


def _svg() -> str:
    n = lambda m: f"aggregate(map_values({m}), 0L, (a, x) -> a + x)"
    on = "map_filter(removed_attributes, (k, v) -> startswith(lower(k), 'on'))"
    elements = H.item(9, "'svg-elements'", "'removed'", "NULL", f"if({n('removed_elements')} > 0, 'medium', 'info')", f"cast({n('removed_elements')} as string)")
    notable = f"transform(filter(map_keys(removed_elements), x -> lower(x) IN {L.listed([x.lower() for x in L.SVG_NOTABLE])}), x -> {H.item(9, repr('svg-notable'), repr('<') + ' || x || ' + repr('>'), 'NULL', repr('high'))})"
    attributes = H.item(9, "'svg-attributes'", "'removed'", "NULL", f"CASE WHEN size({on}) > 0 THEN 'high' WHEN {n('removed_attributes')} > 0 THEN 'medium' ELSE 'info' END", f"cast({n('removed_attributes')} as string)")
    handlers = f"CASE WHEN size({on}) > 0 THEN array({H.item(9, repr('svg-notable'), repr('event handlers'), 'NULL', repr('high'))}) ELSE {_none} END"
    kept = f"CASE WHEN comments + instructions > 0 THEN array({H.item(9, repr('svg-preserved'), repr('comments / instructions'), 'NULL', repr('low'))}) ELSE {_none} END"
    rewrite = H.item(9, "'svg-rewrite'", "'before/after'", "NULL", f"if({n('removed_elements')} + {n('removed_attributes')} > 0, 'high', 'info')")
    return f"CASE WHEN coalesce(detected, '') <> 'svg' THEN array({H.item(9, repr('svg-scope'), repr('not-svg'), 'NULL', repr('info'))}) WHEN startswith(svg_refused, 'SVG-PARSE') THEN array({H.item(9, repr('svg-parse-error'), repr('xml'), 'NULL', repr('unknown'))}) WHEN svg_refused IS NOT NULL THEN array({H.item(9, repr('svg-badroot'), repr('root'), 'NULL', repr('high'))}) ELSE concat(array({elements}), {notable}, array({attributes}), {handlers}, {kept}, array({rewrite})) END"


def scan(files: DataFrame, detail: bool = True, trusted: list[str] | None = None) -> DataFrame:
    """files (id, file_name, declared_type, category, content; further columns are carried) with the outcome: decision, stopped_at, layer_no, layers_run, reason_code, top_severity, evidence (layer_no, kind, label, detail, place, severity), content_rewritten, is_scanner_error, is_test_only, is_neutralized, stored_size, and content, rewritten where it was accepted so and null where it was refused.

    trusted: where given, links to hosts other than namespaces and these domains are refused too (EL-EXTERNAL). Layers decide in order and the first refusal ends a file. Without detail the evidence of a matched rule is one row, without its strings' places and distances; nothing else differs, and texts aren't searched for them. Null content counts as empty. Columns in_<scanner> say what the comparison scanners accept; rebuilt is what the one of them that rebuilds images keeps."""
    fired = H.fired if detail else H.named
    base = measured(files).selectExpr("*", f"{L.extension(SPARK)} AS l1", f"{L.detected(SPARK)} AS detected", f"{L.double_extension(SPARK)} AS l4")
    base = base.selectExpr("*", f"{L.header(SPARK)} AS l3")
    base = base.withColumn("early", F.expr("CASE WHEN l1 IS NOT NULL THEN 1 WHEN detected IS NULL THEN 2 WHEN l3 IS NOT NULL THEN 3 WHEN l4 IS NOT NULL THEN 4 ELSE 10 END"))
    base = base.withColumn("rules", F.expr(f"CASE WHEN early < 10 THEN cast(array() as array<int>) ELSE {matched_sql(SPARK)} END"))
    base = base.withColumn("fired", F.expr(f"CASE WHEN size(rules) > 0 THEN {fired('rules')} END"))
    early = F.expr("if(early = 10 AND size(rules) > 0, 5, early)")
    report = f"concat(CASE WHEN early = 1 THEN {_none} ELSE {_magic()} END, CASE WHEN early < 3 THEN {_none} ELSE {_header()} END, CASE WHEN fired IS NULL THEN {_none} ELSE {H.of_rules('fired', 5, 'yara')} END)"
    scanners = {f"in_{k}": F.expr(v) for k, v in comparators(SPARK).items()}
    base = base.withColumns({"report": F.expr(report), "at": early, "is_pdf": F.expr(_IS_PDF), **scanners, "redo": F.expr(reencodable(SPARK))})
    alive = F.col("at") == 10
    if trusted is not None:
        base = base.withColumn("far", F.expr(f"CASE WHEN at = 10 AND {L.linkable(SPARK)} THEN {untrusted_links('t', trusted)} END"))
    base = base.withColumns({"l5c": F.when(alive, F.expr(L.links(SPARK, "0" if trusted is None else "coalesce(size(far), 0)"))), "links": F.when(alive, F.expr(_links(trusted is not None))), "is_pdf": alive & F.col("is_pdf"), "kind": F.when(alive, F.col("detected")), "content": F.when(alive | F.col("redo"), F.col("content"))})
    own = [c for c in files.columns if c != "content"]
    own += [c for c in ("ext", "size_bytes", "sha256", "head", "detected", "l3", "l4", "early", "rules", "report", "at", "l5c", "links", "is_pdf", "kind", "redo", *scanners) if c not in own]
    out = per_file(base.select(*own, "content"), opened, OPENED, "content", "is_pdf", "kind", "redo")
    inflated = "decode(coalesce(inflated, X''), 'ISO-8859-1')"
    out = out.withColumns({"t": F.expr(inflated), "low": F.expr(f"lower({inflated})"), "raw": F.expr("coalesce(inflated, X'')")})
    out = out.withColumn("inner_rules", F.expr(f"CASE WHEN octet_length(inflated) > 0 THEN {matched_sql(SPARK)} ELSE cast(array() as array<int>) END"))
    out = out.withColumn("inner_fired", F.expr(f"CASE WHEN size(inner_rules) > 0 THEN {fired('inner_rules')} ELSE {SPARK.empty_fired()} END"))
    out = out.withColumn("layer_no", F.expr("CASE WHEN at < 10 THEN at WHEN pdf_error IS NOT NULL OR bomb OR size(inner_rules) > 0 THEN 6 WHEN l5c IS NOT NULL THEN 7 WHEN refused IS NOT NULL THEN 8 WHEN svg_refused IS NOT NULL THEN 9 ELSE 10 END"))
    ran = lambda k, x: f"CASE WHEN layer_no >= {k} THEN {x} ELSE {_none} END"
    out = out.withColumn("evidence", F.expr(f"concat(report, {ran(6, _pdf())}, {ran(7, 'links')}, {ran(8, _image())}, {ran(9, _svg())})"))
    first = "get(filter(evidence, e -> e.layer_no = layer_no), 0).kind"
    reason = f"CASE layer_no WHEN 10 THEN '' WHEN 1 THEN 'UNCODED' WHEN 3 THEN l3 WHEN 4 THEN l4 WHEN 7 THEN l5c WHEN 9 THEN split_part(svg_refused, ':', 1) ELSE coalesce({first}, 'UNCODED') END"
    severities = "transform(evidence, e -> e.severity)"
    ranks = _names(SEVERITIES)
    told = "filter(evidence, e -> e.severity IN ('critical', 'high', 'medium', 'test'))"
    out = out.withColumns(
        {
            "decision": F.expr("if(layer_no = 10, 'accepted', 'rejected')"),
            "stopped_at": F.expr(f"element_at({_names([*LAYERS, ''])}, layer_no)"),
            "layers_run": F.expr("least(layer_no, 9)"),
            "reason_code": F.expr(reason),
            "top_severity": F.expr(f"CASE WHEN size(evidence) = 0 THEN '' ELSE coalesce(element_at({ranks}, cast(nullif(array_min(transform({severities}, x -> array_position({ranks}, x))), 0) as int)), '') END"),
            "content_rewritten": F.expr("layer_no = 10 AND (rewritten IS NOT NULL OR sanitised IS NOT NULL)"),
            "is_test_only": F.expr(f"size({told}) > 0 AND forall({told}, e -> e.severity = 'test')"),
            "content": F.expr("CASE WHEN layer_no = 10 THEN coalesce(rewritten, sanitised, content) END"),
        }
    )
    unknown = "exists(evidence, e -> e.severity = 'unknown') OR reason_code IN ('EL-ERROR', 'HCM-PIPELINE', 'SVG-PARSE')"
    out = out.withColumns({"is_scanner_error": F.expr(unknown), "is_neutralized": F.expr("content_rewritten AND exists(evidence, e -> e.kind LIKE '%-rewrite' AND e.severity = 'high')"), "stored_size": F.expr("coalesce(cast(octet_length(content) as bigint), 0L)")})
    gone = {"report", "at", "early", "links", "kind", "redo", "t", "low", "raw", "inner_rules", "inner_fired", *(f.name for f in OPENED)} - {"removed_elements", "removed_attributes", "rebuilt"}
    return out.withColumn("in_DVWA-Impossible", F.col("rebuilt").isNotNull()).select(*(F.col(f"`{c}`") for c in [*out.columns, "in_DVWA-Impossible"] if c not in gone))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived submissions with their payload's bytes as content."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels")}
    return spark.sql(f"SELECT id, truth, category, declared_type, file_name, encode(payload, 'UTF-8') AS content FROM ({submissions_sql(SPARK, '{documents}', '{labels}')}) AS s", **tables)


def layered(spark: SparkSession, sf_dir: str, detail: bool = False) -> DataFrame:
    """The nine-layer scan of the submissions."""
    return scan(submissions(spark, sf_dir), detail)
