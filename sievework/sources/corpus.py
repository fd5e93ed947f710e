"""Files of a labelled folder as rows, read file by file, and a store that puts content back into files: two Python data sources. Bytes are read and written by tasks; the driver lists paths and renames one folder.

Paths are of any file system that pyarrow knows; the store needs one whose folders can be renamed."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sievework.sources.submissions import declared_type

CATEGORIES = ("profile", "id")  # of stored files
GROUPS = ("malicious", "clean")  # folders right below the root, in the order of a run
RUN_FILES, RUN_BYTES, BATCH_BYTES = 256, 32 << 20, 4 << 20  # files and bytes that one task reads; bytes that it hands over together
READ = pa.schema([("path", pa.string()), ("relative_path", pa.string()), ("truth", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
STORE = "folder string, stored_name string, content binary"


@dataclass
class Run(InputPartition):
    """Files that one task reads: path, path below the root, group, place in the group and bytes."""

    files: list[tuple[str, str, str, int, int]]


def _listed(system: fs.FileSystem, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, none if there is no such folder; on a local disk links to nothing too, as they are files that can't be read."""
    if isinstance(system, fs.LocalFileSystem):
        paths = [os.path.join(at, name) for at, _, names in os.walk(folder) for name in names]
        return [(p, os.path.getsize(p) if os.path.exists(p) else 0) for p in paths]
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
    return [(x.path, max(x.size or 0, 0)) for x in found if x.type != fs.FileType.Directory]


class CorpusReader(DataSourceReader):
    def __init__(self, root: str, groups: tuple[str, ...], opened: bool):
        self.root, self.groups, self.opened = root, groups, opened

    def partitions(self) -> list[Run]:
        """Runs of paths, in the order of their UTF-16 units within each group; a group without a folder has none."""
        system, root = fs.FileSystem.from_uri(self.root)
        runs: list[Run] = [Run([])]
        size = 0
        for group in self.groups:
            for place, (path, length) in enumerate(sorted(_listed(system, f"{root}/{group}"), key=lambda x: x[0].encode("utf-16-be", "surrogatepass"))):
                if len(runs[-1].files) >= RUN_FILES or size >= RUN_BYTES:
                    runs.append(Run([]))
                    size = 0
                runs[-1].files.append((path, posixpath.relpath(path, root), group, place, length))
                size += length if self.opened else 0
        return runs

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        """A row a file; one that can't be read has its error in place of its content."""
        system, _ = fs.FileSystem.from_uri(self.root)
        rows: list[tuple] = []
        size = 0
        for path, *rest in partition.files:
            if not self.opened:
                rows.append((path, *rest, None, None))
                continue
            try:
                with system.open_input_stream(path) as stream:
                    rows.append((path, *rest, stream.read(), None))
                size += len(rows[-1][-2])
            except OSError as broken:
                rows.append((path, *rest, None, f"{type(broken).__name__}: {broken}"))
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)


class CorpusSource(DataSource):
    """Options: `root`, the folder that holds the groups; `groups`, the folders right below it, by commas; `opened`, false to list files without opening them."""

    @classmethod
    def name(cls) -> str:
        return "labelled_corpus"

    def schema(self) -> str:
        return "path string, relative_path string, truth string, place long, size long, content binary, error string"

    def reader(self, schema) -> CorpusReader:
        groups = tuple(self.options.get("groups", ",".join(GROUPS)).split(","))
        return CorpusReader(self.options["root"], groups, self.options.get("opened", "true") == "true")


class StoreWriter(DataSourceArrowWriter):
    """Files under <root>/<run>/<folder>/<name>. Tasks write each to a name of their own and then rename it to its final one in a folder beside; a task that runs again puts the same bytes in the same place. The commit renames that folder to the run's, so that all of a run is to be seen or nothing; an abort deletes it."""

    def __init__(self, root: str, run: str):
        self.root, self.run = root.rstrip("/"), run

    def _folder(self, name: str) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.root)
        return system, f"{root}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, pending = self._folder(f".pending-{self.run}")
        for batch in iterator:
            folder, name, content = (batch.column(batch.schema.get_field_index(c)) for c in ("folder", "stored_name", "content"))
            for row in range(batch.num_rows):
                where, what = folder[row].as_py() or "", name[row].as_py()
                if not what or "/" in what or ".." in where.split("/"):
                    raise ValueError("a stored name is one name, in a folder below the run's")
                target = posixpath.join(pending, where)
                system.create_dir(target, recursive=True)
                part = f"{target}/.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(content[row].as_py() or b"")
                system.move(part, f"{target}/{what}")
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        system, pending = self._folder(f".pending-{self.run}")
        system.create_dir(pending, recursive=True)
        for left in system.get_file_info(fs.FileSelector(pending, recursive=True)):
            if left.base_name.endswith(".part"):  # of a task that was lost while it wrote
                system.delete_file(left.path)
        system.move(pending, self._folder(self.run)[1])

    def abort(self, messages: list) -> None:
        system, pending = self._folder(f".pending-{self.run}")
        if system.get_file_info(pending).type == fs.FileType.Directory:
            system.delete_dir(pending)


class StoreSink(DataSource):
    """Options `root` and `run`."""

    @classmethod
    def name(cls) -> str:
        return "file_store"

    def schema(self) -> str:
        return STORE

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options["root"], self.options["run"])


def _files(spark: SparkSession, root: str, groups: tuple[str, ...], opened: bool) -> DataFrame:
    spark.dataSource.register(CorpusSource)
    return spark.read.format("labelled_corpus").option("root", root).option("groups", ",".join(groups)).option("opened", str(opened).lower()).load()


def corpus_files(spark: SparkSession, root: str, category: str = "id") -> DataFrame:
    """A row for each file below <root>/malicious and <root>/clean: id (its path), relative_path, truth, place (its number in its group by path), file_name without the suffix that keeps samples from being opened, declared_type, category, content and error (null if it was read)."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)(\.sample)+$", "")
    return _files(spark, root, GROUPS, True).select(F.col("path").alias("id"), "relative_path", "truth", "place", name.alias("file_name"), declared_type(name).alias("declared_type"), F.lit(category).alias("category"), "content", "error")


def store(rows: DataFrame, root: str, run: str | None = None) -> str:
    """Puts content (rows: folder, stored_name, content) into files; returns the run's folder. Names must differ within a folder, and an existing run isn't written again."""
    run = run or uuid.uuid4().hex
    system, below = fs.FileSystem.from_uri(root)
    if system.get_file_info(f"{below.rstrip('/')}/{run}").type != fs.FileType.NotFound:
        raise ValueError(f"run {run} is stored already")
    rows.sparkSession.dataSource.register(StoreSink)
    rows.select("folder", "stored_name", "content").write.format("file_store").option("root", root).option("run", run).mode("append").save()
    return f"{root.rstrip('/')}/{run}"


def corpus_status(spark: SparkSession, root: str) -> DataFrame:
    """grp, exists and files of each group of a labelled folder, and their total; nothing is opened."""
    system, below = fs.FileSystem.from_uri(root)
    there = [(g, system.get_file_info(f"{below.rstrip('/')}/{g}").type == fs.FileType.Directory) for g in GROUPS]
    counted = _files(spark, root, GROUPS, False).groupBy(F.col("truth").alias("grp")).agg(F.count("*").alias("files"))
    groups = spark.createDataFrame(there, "grp string, exists boolean").join(counted, "grp", "left").fillna(0, ["files"])
    return groups.unionByName(groups.agg(F.lit("total").alias("grp"), F.bool_or("exists").alias("exists"), F.sum("files").alias("files")))


def listing(spark: SparkSession, root: str, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Stored files by category, without reading their content: category, stored_name, size, url. Only files right below a category's folder."""
    files = _files(spark, root, categories, False).select(F.col("truth").alias("category"), F.split("relative_path", "/").alias("parts"), "size").where("size(parts) = 2")
    return files.select("category", F.col("parts")[1].alias("stored_name"), "size", F.concat(F.lit("/api/files/"), "category", F.lit("/"), F.col("parts")[1]).alias("url"))


def stored_file(spark: SparkSession, root: str, category: str, name: str) -> DataFrame:
    """One stored file: stored_name, content_type and content; no row where there is none, or the category isn't one. A name that isn't a plain file name is an error."""
    if not name.strip() or ".." in name or "/" in name or "\\" in name:
        raise ValueError("not a plain file name")
    system, below = fs.FileSystem.from_uri(root)
    path = f"{below.rstrip('/')}/{category.lower()}/{name}"
    if category.lower() not in CATEGORIES or system.get_file_info(path).type != fs.FileType.File:
        return spark.createDataFrame([], "stored_name string, content_type string, content binary")
    with system.open_input_stream(path) as stream:
        return spark.createDataFrame([(name, stream.read())], "stored_name string, content binary").select("stored_name", declared_type(F.col("stored_name")).alias("content_type"), "content")
