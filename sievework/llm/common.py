"""Tables, scratch tables in the shared folder, and small DataFrame helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every operator here splits words: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
WS_RE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between the JVM and a Python worker, about; a longer row stands alone.
ARROW_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session. Only where that is unset and all runs on one machine (tests), a temporary folder of our own."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), "sievework-checkpoints")
    return where.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches hold at most ARROW_BYTES, so that neither side of a Python stage holds more, however long the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


class Scratch:
    """Written tables in the shared folder. They cut lineage and survive lost executors; drop() deletes them, and what is left goes when the driver ends."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.names = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}", set()
        bounded_batches(spark)
        atexit.register(self._leave)

    def _leave(self) -> None:
        if self.names and self.spark.sparkContext._jsc is not None:
            self.drop()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        self.names = self.names - {name} if name else set()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def retain(self, *names: str) -> None:
        """Drops all tables but these."""
        for name in self.names - set(names):
            self.drop(name)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that further ones can't clash with an operator's own."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def digest_of(column: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8."""
    return F.sha2(column.cast("binary"), 256)


#: Ids up to this many are broadcast (16 bytes each or so); more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def with_small(df: DataFrame, small: DataFrame, on: str | list[str], how: str, most: int = BROADCAST_IDS) -> DataFrame:
    """df joined with a written table, which is broadcast only if it has at most `most` rows and merged by shuffle beyond that, whatever its compressed size says."""
    return df.join(F.broadcast(small) if small.count() <= most else small.hint("merge"), on, how)


def with_ids(df: DataFrame, ids: DataFrame, keep: bool = True, on: str = "doc_id") -> DataFrame:
    """Rows of df whose id is among `ids` (a written table with that one column), or is not. The ids are broadcast only if there are at most BROADCAST_IDS of them."""
    return with_small(df, ids, on, "left_semi" if keep else "left_anti")
