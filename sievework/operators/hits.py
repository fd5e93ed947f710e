"""Every place where the strings of a matched rule occur, the nearest places of its groups, and what layers report, as Spark SQL over one row's arrays."""

from __future__ import annotations

import re

from sievework.functions.dialect import SPARK
from sievework.functions.rules import RULES
from sievework.functions.tables import CO_LOCATED

_at = lambda array, k: f"element_at({array}, {k})"
_names = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"
NAME = _at(_names(r.name for r in RULES), "{r}")
SEVERITY = _at(_names(r.severity for r in RULES), "{r}")
CATEGORY = _at(_names(r.category for r in RULES), "{r}")


def group_of(string: str) -> str:
    """A string's group: its name without the digits at its end; all digits stay."""
    return string.rstrip("0123456789") or string


def regex_of(kind: str, pattern: str) -> str:
    """A string of a rule as a Java regular expression over text with one character a byte."""
    escaped = lambda text: re.sub(r"([^A-Za-z0-9 ])", lambda m: f"\\x{ord(m[1]):02X}", text)
    of_bytes = lambda text: "".join(f"\\x{text[i : i + 2]}" for i in range(0, len(text), 2))
    return {"=": escaped, "~": lambda x: "(?i)" + escaped(x), "/": str, "/i": lambda x: "(?i)" + x, "x": of_bytes, "x0": lambda x: "^" + of_bytes(x)}[kind](pattern)


RUN = 256  # numbers of an array that are added up one after the other


def running(numbers: str) -> str:
    """What stands before each number of an array of bigints, added up: in runs of RUN numbers, then over the runs, so that no array is copied for each number."""
    sums = lambda xs, y: f"aggregate({xs}, array(0L), (a, y) -> concat(a, array(element_at(a, -1) + {y})))"
    runs = f"transform(sequence(0, (size(l) - 1) div {RUN}), k -> {sums(f'slice(l, cast(k as int) * {RUN} + 1, {RUN})', 'y')})"
    shifted = f"flatten(transform(r, (x, k) -> transform(slice(x, 1, size(x) - 1), y -> y + b[k])))"
    return f"transform(array({numbers}), l -> if(size(l) = 0, cast(array() as array<bigint>), transform(array({runs}), r -> transform(array({sums('r', 'element_at(y, -1)')}), b -> {shifted})[0])[0]))[0]"


def _cut(t: str, ord_: int, string: str, rx: str) -> str:
    """One string's pieces of the text, which is cut before each place where the pattern begins, so that overlapping hits count too: the pieces' lengths, and what matches where each begins (empty if nothing does)."""
    here = f"regexp_extract(concat(x, coalesce(get(p, i + 1), '')), {SPARK.text(f'^(?:{rx})')}, 0)"
    return f"named_struct('ord', {ord_}, 'string', '{string}', 'grp', '{group_of(string)}', 'cut', transform(array(split({t}, {SPARK.text(f'(?={rx})')}, -1)), p -> named_struct('sizes', transform(p, x -> cast(length(x) as bigint)), 'texts', transform(p, (x, i) -> {here})))[0])"


def hits(r: str, t: str = "t") -> str:
    """All hits of the strings of rule r, in the order of strings and places: an array of (ord, place, string, grp, text). Only the patterns of that rule are looked for."""
    each = " ".join(f"WHEN {x.number} THEN array({', '.join(_cut(t, n, k, regex_of(*p)) for n, (k, p) in enumerate(x.strings.items()))})" for x in RULES)
    hit = "named_struct('ord', c.ord, 'place', s[i], 'string', c.string, 'grp', c.grp, 'text', c.cut.texts[i])"
    found = f"transform(filter(sequence(0, size(s) - 1), i -> c.cut.texts[i] <> ''), i -> {hit})"
    return f"flatten(transform(CASE {r} {each} END, c -> transform(array({running('c.cut.sizes')}), s -> {found})[0]))"


def matches(t: str, rx: str) -> str:
    """Every match of a pattern (a literal of SQL), none within another, with its place: an array of (text, place)."""
    gaps = f"transform(array(split({t}, {rx}, -1)), p -> transform(m, (x, k) -> cast(length(p[k]) + if(k > 0, length(m[greatest(k - 1, 0)]), 0) as bigint)))[0]"
    return f"transform(array(regexp_extract_all({t}, {rx}, 0)), m -> transform(array({gaps}), g -> transform(array({running('g')}), s -> transform(m, (x, k) -> named_struct('text', x, 'place', s[k] + g[k])))[0])[0])[0]"


def near(found: str) -> str:
    """For each two groups of hits their least distance: an array of (distance, group_a, group_b, at), nearest first. In the order of places the nearest two are neighbours."""
    groups = f"array_sort(array_distinct(transform({found}, h -> h.grp)))"
    pairs = "filter(flatten(transform(g, x -> transform(g, y -> named_struct('a', x, 'b', y)))), q -> q.a < q.b)"
    own = f"array_sort(transform(filter({found}, h -> h.grp = q.a OR h.grp = q.b), h -> named_struct('place', h.place, 'grp', h.grp, 'ord', h.ord)))"
    side = lambda x, f: f"if(m[k - 1].grp = q.{x}, m[k - 1].{f}, m[k].{f})"
    best = "array_min(transform(filter(sequence(1, size(m) - 1), k -> m[k - 1].grp <> m[k].grp), k -> named_struct('d', m[k].place - m[k - 1].place, " + ", ".join(f"'{x}{f}', {side(x, f)}" for x in "ab" for f in ("ord", "place")) + ", 'at', m[k - 1].place)))"
    each = f"transform(array({own}), m -> transform(array({best}), z -> named_struct('distance', z.d, 'group_a', q.a, 'group_b', q.b, 'at', z.at))[0])[0]"
    return f"array_sort(transform(array({groups}), g -> transform({pairs}, q -> {each}))[0])"


def fired(rules: str, t: str = "t") -> str:
    """For each matched rule its number, hits and near groups."""
    return f"transform(transform({rules}, r -> named_struct('rule_no', r, 'hits', {hits('r', t)})), f -> named_struct('rule_no', f.rule_no, 'hits', f.hits, 'near', {near('f.hits')}))"


def named(rules: str) -> str:
    """As `fired`, without hits and distances, which take a text several passes for each rule."""
    return f"transform({rules}, r -> {SPARK.fired_struct('r')})"


def item(layer: int, kind: str, label: str, place: str, severity: str, detail: str = "''") -> str:
    """A row of evidence; label, place, severity and detail are SQL."""
    return f"named_struct('layer_no', {layer}, 'kind', {kind}, 'label', {label}, 'detail', {detail}, 'place', cast({place} as bigint), 'severity', {severity})"


def preview(x: str) -> str:
    """A matched text on one line, 40 characters of it."""
    flat = f"trim(regexp_replace({x}, r'[\r\n\t ]+', ' '))"
    return f"CASE WHEN length({flat}) > 40 THEN left({flat}, 40) || '...' ELSE {flat} END"


def of_rules(found: str, layer: int, prefix: str) -> str:
    """Evidence of the fired rules: the rule, its hits, and the distances of its groups."""
    name, severity = NAME.format(r="f.rule_no"), SEVERITY.format(r="f.rule_no")
    rule = item(layer, f"'{prefix}-rule'", name, "NULL", severity, CATEGORY.format(r="f.rule_no"))
    string = item(layer, f"'{prefix}-string'", f"{name} || '/$' || h.string", "h.place", severity, preview("h.text"))
    pair = item(layer, f"'{prefix}-proximity'", f"{name} || '/' || q.group_a || '~' || q.group_b", "q.at", severity, f"q.distance || ' bytes apart, ' || if(q.distance <= {CO_LOCATED}, 'co-located', 'distant')")
    return f"flatten(transform({found}, f -> concat(array({rule}), transform(f.hits, h -> {string}), transform(f.near, q -> {pair}))))"


def described(found: str) -> str:
    """One line on the fired rules: the first 8 hits and the 3 nearest pairs of each."""
    shown = f"array_join(transform(slice(f.hits, 1, 8), h -> '\"' || {preview('h.text')} || '\" at 0x' || lower(hex(h.place))), ', ')"
    more = "if(size(f.hits) > 8, ', +' || (size(f.hits) - 8) || ' more', '')"
    pairs = f"if(size(f.near) > 0, ' | proximity: ' || array_join(transform(slice(f.near, 1, 3), q -> q.group_a || '~' || q.group_b || ' ' || q.distance || 'B ' || if(q.distance <= {CO_LOCATED}, 'co-located', 'distant')), ', '), '')"
    one = f"{NAME.format(r='f.rule_no')} || ' [severity=' || {SEVERITY.format(r='f.rule_no')} || ', category=' || {CATEGORY.format(r='f.rule_no')} || ']' || if(size(f.hits) > 0, ' | strings: ' || {shown} || {more}, '') || {pairs}"
    return f"array_join(transform({found}, f -> {one}), '  ||  ')"
