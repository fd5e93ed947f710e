"""Files that arrive in a folder, inspected as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.plans.scan import scan
from sievework.sources.corpus import CATEGORIES
from sievework.sources.submissions import declared_type

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, category: str = "") -> DataFrame:
    """A stream of the files of a folder as submissions; id is the path. The category is the given one, or else the folder that a file lies in right below `path`, trimmed and in lower case; files of no category of stored files, and empty ones, are no submissions (Spark's file source passes over empty ones by itself)."""
    files = spark.readStream.format("binaryFile").schema(_SCHEMA).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    below = F.split_part(F.split_part("path", F.lit(f"{path.rstrip('/').split('://')[-1].split(':', 1)[-1]}/"), F.lit(2)), F.lit("/"), F.lit(1))
    own = files.select(F.col("path").alias("id"), "modificationTime", name.alias("file_name"), declared_type(name).alias("declared_type"), (F.lit(category) if category else F.lower(F.trim(below))).alias("category"), "content")
    return own.where(F.col("category").isin(*CATEGORIES) & (F.octet_length("content") > 0))


def first_of_content(files: DataFrame, late: str = "60 minutes") -> DataFrame:
    """One file of each content within the time that verdicts are kept."""
    return files.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"])


def verdicts(spark: SparkSession, path: str, out: str, checkpoint: str, category: str = ""):
    """Starts a query that appends each file's verdict and stored content to a parquet table; ends once what is there is done."""
    columns = ["id", "file_name", "declared_type", "category", "content"]
    return scan(arriving(spark, path, category).select(*columns)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
