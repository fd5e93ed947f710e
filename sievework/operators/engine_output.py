"""A signature engine's text output: lines of files to rows of hits with their rule, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HEAD = r"^(\w+) \[(.*)\] "
_HIT = r"^0x([0-9a-fA-F]+):(\$[^:]*): ?(.*)"
_PAIR = r'(\w+)="((?:[^"\\]|\\.)*)"'


def parse_lines(lines: DataFrame, key: str = "id", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """key, line_no, rule, metadata (a map, keys in lower case, of a repeated key the last), and for a hit's line place, string and text; null for the line that names the rule.

    A rule's line holds for the hits below it up to the next one of the same file; hits before any rule, empty lines and others are left out. Ends of lines by CR, LF or both are cut. Quoted values may hold commas, brackets and quotes after a backslash."""
    text = F.regexp_replace(line, "[\r\n]+$", "")
    seen = lines.select(key, line_no, text.alias("_line")).select("*", F.regexp_extract("_line", _HEAD, 1).alias("_rule"), F.regexp_extract("_line", _HIT, 2).alias("_string"))
    seen = seen.where("_rule <> '' OR _string <> ''")
    head = F.when((F.col("_string") == "") & (F.col("_rule") != ""), F.struct(F.col("_rule").alias("rule"), F.regexp_extract("_line", _HEAD, 2).alias("given")))
    above = Window.partitionBy(key).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    held = seen.withColumn("_head", F.last(head, ignorenulls=True).over(above)).where("_head IS NOT NULL")
    pairs = F.transform(F.regexp_extract_all("_head.given", F.lit(_PAIR), F.lit(0)), lambda x: F.struct(F.lower(F.regexp_extract(x, _PAIR, 1)).alias("key"), F.regexp_replace(F.regexp_extract(x, _PAIR, 2), r'\\"', '"').alias("value")))
    last = "filter(pairs, (x, i) -> NOT exists(slice(pairs, i + 2, size(pairs)), y -> y.key = x.key))"
    hit = lambda x: F.when(F.col("_string") != "", x)
    return held.withColumn("pairs", pairs).select(key, line_no, F.col("_head.rule").alias("rule"), F.expr(f"map_from_entries({last})").alias("metadata"), hit(F.conv(F.regexp_extract("_line", _HIT, 1), 16, 10).cast("long")).alias("place"), hit(F.col("_string")).alias("string"), hit(F.regexp_extract("_line", _HIT, 3)).alias("text"))


def render(fired: str, named: str, severity: str, category: str) -> str:
    """Spark SQL: the lines that the engine would print of an array of fired rules; the others are SQL over a rule f. What isn't printable is a dot."""
    head = f"concat({named}, ' [severity=\"', {severity}, '\",category=\"', {category}, '\"] file')"
    line = "concat('0x', lower(hex(h.place)), ':$', h.string, ': ', regexp_replace(h.text, r'[^\\x20-\\x7e]', '.'))"
    return f"flatten(transform({fired}, f -> concat(array({head}), transform(f.hits, h -> {line}))))"
