"""The corpus pipeline: documents through five operators, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.classifier import classify
from sievework.llm.common import Scratch, table, with_small
from sievework.llm.decontaminate import decontaminate
from sievework.llm.line_dedup import dedup_lines
from sievework.llm.near_dedup import near_duplicates
from sievework.llm.packing import pack

NO_ID = -(1 << 63)  # stands for a null doc_id among keys


def _unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as keep it apart from the columns of docs."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _restored(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs, in its order, from doc_id, text and the struct `carried`."""
    return changed.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"carried.`{c}`").alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier calls junk or toxic, row by row, with an id or without.

    A null or empty text is judged by the scorer's bias; repeated rows get one verdict, since it depends on the text alone; there are no ties but the threshold, which is a refusal. Long texts count whole. Further columns, whatever their names, stay. No rows give no rows."""
    scratch, key = Scratch(spark, "rejected"), [_unused(docs, "_id"), _unused(docs, "_text")]
    verdict = classify(docs, table(spark, sf_dir, "labels")).where("not kept")
    gone = scratch.save(verdict.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(key[0]), F.col("text_hash").alias(key[1])).distinct(), "gone")
    keyed = docs.withColumns({key[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), key[1]: F.xxhash64(F.col("text").cast("string"))})
    return with_small(keyed, gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that at least three documents hold, except from the largest doc_id; all documents stay, in the columns that they had. n_chars, where there is one, follows the text.

    A null or empty text stays as an empty one. Repeated rows of one doc_id are one document and are rewritten alike; a row without doc_id loses all its repeated lines. Long texts and lines count whole. Further columns, whatever their names, stay. No rows give no rows."""
    out = _restored(docs, dedup_lines(docs, carry=True))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest doc_id.

    Texts without words, null ones and rows without doc_id are near nothing and stay. Rows of one doc_id are one document and stay or go together. Long texts count whole. Further columns, whatever their names, stay. No rows give no rows."""
    scratch, key = Scratch(spark, "copies"), _unused(docs, "_id")
    gone = scratch.save(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(key)).distinct(), "gone")
    kept = with_small(docs.withColumn(key, F.col("doc_id").cast("long")), gone, key, "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, row by row, with an id or without.

    A null or empty text is clean; so is everything if the benchmark is empty. Repeated rows get one verdict. Long texts are searched whole. Further columns, whatever their names, stay. No rows give no rows."""
    return _restored(docs, decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True).where("not contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; a row per piece, with the columns of op7.

    A null or empty text is its end id alone. Repeated rows, and rows without doc_id, are packed one by one; pieces of equal length rank by block, doc_id and piece. Long texts are cut into pieces. Further columns are left behind. No rows give no rows."""
    return pack(docs)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express the trained classifier, nor token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
    return docs
