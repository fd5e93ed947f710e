"""The JVM-side inspection layers, each as the SQL of its verdict over a submission (id, file_name, declared_type, category, payload)."""

from __future__ import annotations

from sievework.functions.dialect import Spark
from sievework.functions.rules import matched_sql
from sievework.functions.tables import CATEGORIES, CONTENT_TYPES, DANGEROUS_EXTENSIONS, DATA_URIS, EXTENSION_TYPES, FOREIGN, FOREIGN_TEXT, NAMESPACE_HOSTS, SCHEMES, SIGNATURES, SVG_NOTABLE

listed = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
NOT_BEFORE = r"(^|[^A-Za-z0-9+.\-])"


def view(d: Spark, source: str) -> str:
    """Measures that several layers use, from a source with a payload: ext, head, t (its UTF-8, one character a byte), low, raw, size_bytes, and probe, the characters that begin in the first 1024 bytes."""
    ext = d.rx_extract("file_name", r"(\.[^./\\]+)$")
    begun = d.rx_replace("left(t, 1024)", "[\x80-\xBF]", "")
    return f"""SELECT *, lower({ext}) AS ext, {d.head('payload', 16)} AS head, lower(t) AS low, {"encode(payload, 'UTF-8')" if d.name == 'spark' else 'hex(encode(payload))'} AS raw,
  lower(left(payload, length({begun}))) AS probe, cast({"octet_length(encode(payload, 'UTF-8'))" if d.name == 'spark' else 'octet_length(encode(payload))'} as bigint) AS size_bytes FROM (SELECT *, {d.latin('payload')} AS t FROM ({source}) AS p) AS s"""


def extension(d: Spark) -> str:
    """l1: why the extension layer rejects, or null."""
    known = " ".join(f"WHEN '{k}' THEN ext IN {listed(v)}" for k, v in CATEGORIES.items())
    return f"CASE WHEN lower(category) NOT IN {listed(CATEGORIES)} THEN 'unknown category' WHEN trim(file_name) = '' THEN 'blank name' WHEN ext = '' THEN 'no extension' WHEN NOT (CASE lower(category) {known} END) THEN 'not listed' END"


def detected(d: Spark) -> str:
    """l2: the type by signature, else svg by its marker, else null."""
    one = lambda off, sig: f"substr(head, {2 * off + 1}, {len(sig)}) = '{sig}'"
    types = " ".join(f"WHEN {' AND '.join(one(*p) for p in ps)} THEN '{t}'" for t, ps in SIGNATURES.items())
    return f"CASE WHEN length(head) < 8 THEN NULL {types} WHEN contains(probe, '<svg') THEN 'svg' END"


def svg_root(d: Spark) -> str:
    """l2: whether the svg marker is the first element that isn't a declaration or comment."""
    before = d.rx_extract("probe", r"^((?s:.*?))<svg")
    return f"CASE WHEN contains(probe, '<svg') THEN NOT {d.rx(before, '<[^?!]|<$')} END"


def foreign(d: Spark) -> str:
    """l2: what a file of no accepted type is, or null."""
    binary = " ".join(f"WHEN starts_with(head, '{sig}') THEN '{name}'" if d.name == "duckdb" else f"WHEN startswith(head, '{sig}') THEN '{name}'" for name, sig in FOREIGN)
    text = " ".join(f"WHEN contains(probe, '{mark}') THEN '{name}'" for name, mark in FOREIGN_TEXT)
    return f"CASE {binary} {text} END"


def foreign_at(d: Spark) -> str:
    """l2: where that shows, 0 for signatures, else in the probe without leading space."""
    binary = " ".join(f"WHEN starts_with(head, '{sig}') THEN 0" if d.name == "duckdb" else f"WHEN startswith(head, '{sig}') THEN 0" for _, sig in FOREIGN)
    trimmed = d.rx_replace("probe", r"^[\uFEFF \t\r\n]+" if d.name == "spark" else r"^[\x{FEFF} \t\r\n]+", "")
    text = " ".join(f"WHEN contains(probe, '{mark}') THEN {'instr' if d.name == 'spark' else 'strpos'}({trimmed}, '{mark}') - 1" for _, mark in FOREIGN_TEXT)
    return f"CASE {binary} {text} END"


def near_misses(d: Spark) -> str:
    """l2: for each signature the matched prefix length in bytes, where it is at least one and not all: 'type@offset:length' joined by commas."""
    found = []
    for kind, parts in SIGNATURES.items():
        for off, sig in parts:
            n = len(sig) // 2
            steps = " ".join(f"WHEN substr(head, {2 * off + 1}, {2 * k}) = '{sig[: 2 * k]}' THEN '{kind}@{off}:{k}'" for k in range(n - 1, 0, -1))
            found.append(f"CASE WHEN substr(head, {2 * off + 1}, {len(sig)}) = '{sig}' THEN NULL WHEN length(head) <= {2 * off} THEN NULL {steps} END")
    return d.join(d.kept(d.array(", ".join(found)), "x", "x IS NOT NULL"), ",")


def _declared() -> str:
    return "lower(trim(split_part(coalesce(declared_type, ''), ';', 1)))"


def header(d: Spark) -> str:
    """l3: why the declared type doesn't fit the detected one, or null."""
    fits = " ".join(f"WHEN '{k}' THEN {_declared()} IN {listed(v)}" for k, v in CONTENT_TYPES.items())
    return f"CASE WHEN detected IS NULL THEN 'HCM-PIPELINE' WHEN trim(coalesce(declared_type, '')) = '' THEN 'HCM-MISSING' WHEN NOT (CASE detected {fits} ELSE false END) THEN 'HCM-MISMATCH' END"


def alias(d: Spark) -> str:
    """l3: canonical, alias or null for a declared type that fits."""
    first = " ".join(f"WHEN detected = '{k}' AND {_declared()} = '{v[0]}' THEN 'canonical'" for k, v in CONTENT_TYPES.items())
    more = " ".join(f"WHEN detected = '{k}' AND {_declared()} IN {listed(v[1:])} THEN 'alias'" for k, v in CONTENT_TYPES.items() if len(v) > 1)
    return f"CASE {first} {more} END"


def extension_says(d: Spark) -> str:
    """l3: what the last extension says of the detected type."""
    last = f"lower({d.rx_extract('file_name', r'^.+[.]([^.]+)$')})"
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSION_TYPES.items())
    return f"CASE WHEN {last} = '' THEN 'none' WHEN (CASE {last} {known} END) IS NULL THEN 'unknown' WHEN (CASE {last} {known} END) = detected THEN 'agrees' ELSE 'disagrees' END"


def double_extension(d: Spark, strict: bool = True) -> str:
    """l4: why the shape of the name is refused, or null."""
    parts = d.split("file_name", ".")
    padded = d.any_of(parts, "x", "x <> '' AND x <> trim(x)")
    second = f"lower(split_part(file_name, '.', 2)) IN {listed(DANGEROUS_EXTENSIONS)}"
    inner = d.any_of(d.middle(parts), "x", f"lower(x) IN {listed(DANGEROUS_EXTENSIONS)}")
    n = d.size(parts)
    end = "'DE-PATTERN'" if strict else "NULL"
    return f"CASE WHEN trim(file_name) = '' THEN 'DE-EVASION' WHEN {d.rx('file_name', r'[\x00-\x1f\x7f-\x9f]')} OR {padded} THEN 'DE-EVASION' WHEN left(file_name, 1) = '.' AND {second} THEN 'DE-DANGEROUS' WHEN {n} <= 2 THEN NULL WHEN {inner} THEN 'DE-DANGEROUS' ELSE {end} END"


def linkable(d: Spark) -> str:
    """l5c: whether the file is one that links are looked for in: a PDF by a mark that stands in the first 1024 bytes, which is all that Spark searches, or a drawing."""
    marked = "contains(left(t, 1024), '%PDF')" if d.name == "spark" else "(strpos(t, '%PDF') BETWEEN 1 AND 1021)"
    return f"({marked} OR contains(left(low, 2048), '<svg'))"


def scheme(d: Spark) -> str:
    """l5c: the first dangerous scheme in table order, or null. Spark looks for its regular expression only in texts that hold the scheme's name."""
    named = lambda s: f"contains(low, '{s}') AND " if d.name == "spark" else ""
    return "CASE " + " ".join(f"WHEN {named(s)}{d.rx('low', NOT_BEFORE + s + r'\s*:')} THEN '{s}'" for s in SCHEMES) + " END"


def data_uri(d: Spark) -> str:
    return "CASE " + " ".join(f"WHEN contains(low, '{s}') THEN '{s}'" for s in DATA_URIS) + " END"


def links(d: Spark, untrusted: str = "0") -> str:
    """l5c: why embedded links are refused, or null. untrusted: SQL of how many links go to hosts that aren't trusted, where those are refused too."""
    external = f" WHEN {untrusted} > 0 THEN 'EL-EXTERNAL'" if untrusted != "0" else ""
    return f"CASE WHEN NOT {linkable(d)} THEN NULL WHEN {scheme(d)} IS NOT NULL THEN 'EL-SCHEME' WHEN {data_uri(d)} IS NOT NULL THEN 'EL-DATAURI'{external} END"


def trust_of(host: str, allowed: list[str]) -> str:
    """SQL: namespace, allowed (the list's domains and what is below them) or untrusted."""
    listed_ = " OR ".join(f"{host} = '{a}' OR {host} LIKE '%.{a}'" for a in allowed) or "false"
    return f"CASE WHEN {namespace(host)} THEN 'namespace' WHEN {listed_} THEN 'allowed' ELSE 'untrusted' END"


def namespace(host: str) -> str:
    return f"{host} IN {listed(NAMESPACE_HOSTS)}"


def inspected(d: Spark, source: str) -> str:
    """A submission with the outcome of every JVM-side layer."""
    return f"""SELECT *, {header(d)} AS l3, {alias(d)} AS declared_as, {extension_says(d)} AS extension_says FROM (
  SELECT *, {extension(d)} AS l1, {detected(d)} AS detected, {foreign(d)} AS found, {double_extension(d)} AS l4, {double_extension(d, False)} AS l4_lenient, {matched_sql(d)} AS rules, {links(d)} AS l5c FROM ({view(d, source)}) AS v) AS w"""
