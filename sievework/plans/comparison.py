"""What each of six scanners makes of each file, the fact table of a run over labelled files, and a run from a folder to that table."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sievework.functions.tables import LAYERS, SCANNERS
from sievework.plans.scan import scan
from sievework.sources.corpus import corpus_files, store
from sievework.sources.sinks import write_csv
from sievework.sources.written import written_once

WHOLE, REBUILDS = SCANNERS[-1], "DVWA-Impossible"  # the scanner of all nine layers; the one that rebuilds images


def by_scanner(scanned: DataFrame) -> DataFrame:
    """A row a file and scanner from scanned files; further columns are carried."""
    flat = ", ".join(f"named_struct('scanner', '{name}', 'accepted', coalesce(`in_{name}`, false), 'content_rewritten', {str(name == REBUILDS).lower()} AND coalesce(`in_{name}`, false))" for name in SCANNERS[:-1])
    own = f"named_struct('scanner', '{WHOLE}', 'accepted', decision = 'accepted', 'content_rewritten', content_rewritten)"
    out = scanned.withColumn("s", F.explode(F.expr(f"array({flat}, {own})"))).drop("content_rewritten")
    whole = F.expr(f"s.scanner = '{WHOLE}'")
    only = {c: F.when(whole, F.col(c)).otherwise(F.lit(none)) for c, none in (("stopped_at", ""), ("top_severity", ""), ("layers_run", 0), ("is_scanner_error", False), ("is_test_only", False), ("is_neutralized", False))}
    reason = F.expr(f"CASE WHEN s.accepted THEN '' WHEN s.scanner = '{WHOLE}' THEN reason_code ELSE 'UNCODED' END")
    size = F.expr(f"CASE WHEN NOT s.accepted THEN 0L WHEN s.scanner = '{WHOLE}' THEN stored_size ELSE size_bytes END")
    out = out.withColumns({**only, "reason_code": reason, "stored_size": size})
    return out.select(*(F.col(f"`{c}`") for c in scanned.columns if not c.startswith("in_") and c not in ("decision", "content_rewritten")), "s.*")


def kept_name() -> F.Column:
    """The name under which a scanner's output is kept: the scanner's, with the file's extension if that is short."""
    slug = r"trim(BOTH '-' FROM regexp_replace(lower(scanner), r'[^\p{L}\p{Nd}]+', '-'))"
    return F.expr(f"{slug} || CASE WHEN ext = '' OR ext IS NULL OR length(ext) > 10 THEN '.bin' ELSE ext END")


def seen_before(files: DataFrame, *order: str) -> DataFrame:
    """id and whether an earlier file (malicious ones first, then by the columns of the order, id by default) has the same bytes and so its verdict from the cache. One partial minimum a digest; the join's hot digests can be split."""
    place = F.struct(F.expr("CASE truth WHEN 'malicious' THEN 0 WHEN 'clean' THEN 1 ELSE 2 END").alias("grp"), *(order or ("id",)))
    files = files.select("id", "sha256", place.alias("place"))
    return files.join(files.groupBy("sha256").agg(F.min("place").alias("first")), "sha256").select("id", (F.col("place") > F.col("first")).alias("from_cache"))


def fact_rows(rows: DataFrame, cached: DataFrame, relative_path: str) -> DataFrame:
    """The fact table, sinks.COLUMNS without elapsed_ms, which no two runs share."""
    flags = ("accepted", "content_rewritten", "is_scanner_error", "is_test_only", "is_neutralized")
    reason = "CASE WHEN accepted THEN '' WHEN stopped_at = '' THEN 'refused' ELSE reason_code || ': refused by ' || stopped_at END AS reason"
    return rows.join(cached, "id").selectExpr("file_name AS file", f"{relative_path} AS relative_path", "sha256", "size_bytes", "truth", "category", "scanner", *(f"cast({c} as int) AS {c}" for c in flags), "stopped_at AS stopped_at_layer", "reason_code", "top_severity", "layers_run", f"cast(from_cache AND scanner = '{WHOLE}' as int) AS from_cache", "stored_size", reason)


@dataclass(frozen=True)
class Summary:
    """What a run did. layers: of each layer its name, the files that reached it and those that it refused."""

    csv: str
    processed: int
    malicious: int
    clean: int
    rows: int
    failed: int
    seconds: float
    layers: tuple[tuple[str, int, int], ...]


def observed(scanned: DataFrame, read: str = "true") -> tuple[DataFrame, Observation]:
    """scanned files, whose next action also counts by the way the files (those for which `read` holds) that reach each layer and that it refuses: r1, x1, r2 ... of the observation. No further pass; the counts are metrics, of which tasks that run again may add to."""
    seen = Observation("layers")
    counts = [F.count_if(F.expr(f"{read} AND {x}")).alias(f"{name}{k}") for k in range(1, len(LAYERS) + 1) for name, x in (("r", f"layers_run >= {k}"), ("x", f"layers_run = {k} AND decision = 'rejected'"))]
    return scanned.observe(seen, *counts), seen


def run_corpus(spark: SparkSession, root: str, out: str, category: str = "id") -> Summary:
    """Scans the files of a labelled folder with all scanners and writes the fact table as CSV to `out`.

    One pass reads and scans the files; what is left of each, without its bytes, is written once. A file that can't be read counts as failed and has no fact row. A root without groups gives an empty table."""
    began = time.time()
    outcome = scan(corpus_files(spark, root, category), detail=False).drop("content", "evidence", "fired", "rules", "removed_elements", "removed_attributes")
    outcome, layers = observed(outcome, "error IS NULL")
    outcome = written_once(outcome, "corpus")
    told = layers.get
    read = outcome.where("error IS NULL")
    facts = written_once(fact_rows(by_scanner(read), seen_before(read, "place"), "relative_path"), "facts")
    write_csv(facts, out)
    counts = outcome.agg(*(F.count_if(F.expr(x)).alias(n) for n, x in (("processed", "error IS NULL"), ("malicious", "error IS NULL AND truth = 'malicious'"), ("clean", "error IS NULL AND truth = 'clean'"), ("failed", "error IS NOT NULL")))).first()
    return Summary(out, counts["processed"], counts["malicious"], counts["clean"], facts.count(), counts["failed"], round(time.time() - began, 1), tuple((name, told[f"r{k}"], told[f"x{k}"]) for k, name in enumerate(LAYERS, 1)))


def store_compared(files: DataFrame, root: str, run: str | None = None) -> str:
    """Stores what each accepting scanner would keep of each file (id, file_name, declared_type, category, content), in a folder a file, named by its id's digest; returns the run's folder."""
    rows = by_scanner(scan(files.withColumn("submitted", F.coalesce("content", F.lit(b""))), detail=False)).where("accepted")
    kept = F.when(F.col("scanner") == WHOLE, F.col("content")).when(F.col("scanner") == REBUILDS, F.col("rebuilt")).otherwise(F.col("submitted"))
    return store(rows.select(F.left(F.sha2(F.col("id").cast("string"), 256), F.lit(32)).alias("folder"), kept_name().alias("stored_name"), kept.alias("content")), root, run)
