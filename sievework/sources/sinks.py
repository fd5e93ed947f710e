"""Result sinks: the fact table as CSV, stored files, and verdicts as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The header of the fact table.
COLUMNS = ["file", "relative_path", "sha256", "size_bytes", "truth", "category", "scanner", "accepted", "content_rewritten", "is_scanner_error", "is_test_only", "is_neutralized", "stopped_at_layer", "reason_code", "top_severity", "layers_run", "from_cache", "elapsed_ms", "stored_size", "reason"]


def csv_field(c: str) -> F.Column:
    """A value as a field: quoted only if it has a comma, a quote or a line break; quotes doubled and line breaks as spaces inside; null and empty are both empty."""
    value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.translate(F.replace(value, F.lit('"'), F.lit('""')), "\r\n", "  "), F.lit('"'))
    return F.when(value.rlike('[,"\r\n]'), quoted).otherwise(value)


def write_csv(results: DataFrame, path: str) -> None:
    """The fact table with its header in each file, blanks kept as they are."""
    own = [c for c in COLUMNS if c in results.columns]
    lines = results.select(F.concat_ws(",", *(csv_field(c) for c in own)).alias(",".join(own)))
    # the fields are quoted already; the writer adds nothing
    writer = lines.write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\x01")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)


def stored(scanned: DataFrame, extension: str = "ext") -> DataFrame:
    """Accepted content with its place in a store: folder (its category), stored_name (32 hex digits of its id and bytes, so that a task that runs again gives the same, and the submitted extension) and content. `corpus.store` writes them."""
    folder = F.lower(F.trim("category")) if "category" in scanned.columns else F.lit("")
    name = F.left(F.sha2(F.concat_ws("|", F.col("id").cast("string"), "sha256"), 256), F.lit(32))
    return scanned.where("decision = 'accepted'").select(folder.alias("folder"), F.concat(name, F.coalesce(F.col(extension), F.lit(""))).alias("stored_name"), "content")


def as_json(scanned: DataFrame, demo: bool = False) -> DataFrame:
    """A response a file; what the layers said is in it only in demonstration mode."""
    parts = [F.col("id"), (F.col("decision") == "accepted").alias("accepted"), F.when(F.lit(demo), F.struct("stopped_at", "reason_code")).alias("trace")]
    return scanned.select("id", F.to_json(F.struct(*parts)).alias("response"))
