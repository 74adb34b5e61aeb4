"""A Spark data source that lists file trees: hidden files, empty directories and links included.

Read with ``spark.read.format("fs_tree").option("paths", "a\\nb").option("exclude", "*.tmp\\n.git")``. Each input path
is a partition; excluded directories are not entered. The paths must be visible to every executor.
"""

from __future__ import annotations

import os
import re
import stat as modes

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairnstore.functions.scalars import glob_regex

SCHEMA = (
    "full string, rel string, kind string, size bigint, mtime_ns bigint, mode int, dev bigint, ino bigint, nlink bigint, link string"
)


class Tree(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class FileTreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fs_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(self.options)


class FileTreeReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", "").split("\n") if p]
        self.globs = [g for g in options.get("exclude", "").split("\n") if g]

    def partitions(self):
        clean = dict.fromkeys(os.path.normpath(p) for p in self.paths)  # `./a`, `a` and `a/` are one
        return [Tree(i, p) for i, p in enumerate(clean)] or [Tree(0, "")]

    def read(self, partition):
        if not partition.path:
            return
        rules = [re.compile(glob_regex(g)) for g in self.globs]
        top = os.lstat(partition.path)  # an input that is not there is an error
        parent = os.path.dirname(partition.path)
        stack = [(partition.path, top)]
        while stack:
            full, info = stack.pop()
            rel = os.path.relpath(full, parent or ".")
            segments = full.split("/")
            if any(r.match(full) or r.match(rel) or any(r.match(s) for s in segments) for r in rules):
                continue
            kind = "symlink" if modes.S_ISLNK(info.st_mode) else "dir" if modes.S_ISDIR(info.st_mode) else "file" if modes.S_ISREG(info.st_mode) else "other"
            link = os.readlink(full) if kind == "symlink" else None
            size = info.st_size if kind == "file" else 0
            yield (full, rel, kind, size, info.st_mtime_ns, modes.S_IMODE(info.st_mode), info.st_dev, info.st_ino, info.st_nlink, link)
            if kind == "dir":
                try:
                    with os.scandir(full) as entries:
                        below = sorted(entries, key=lambda e: os.fsencode(e.name), reverse=True)
                    stack.extend((e.path, e.stat(follow_symlinks=False)) for e in below)
                except OSError:  # what can't be entered is listed itself, without what is below
                    continue


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTreeSource)


def tree(spark: SparkSession, paths: list[str], exclude: list[str] | None = None) -> DataFrame:
    """The listing of ``paths``."""
    register(spark)
    read = spark.read.format("fs_tree").option("paths", "\n".join(paths))
    return read.option("exclude", "\n".join(exclude or [])).load()


def with_content(files: DataFrame, full: str = "full", per_task: int = 256) -> DataFrame:
    """``files`` with ``content`` and ``error``, read by the executors; a file that can't be read has an error."""
    n = max(1, -(-files.count() // per_task))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):  # one file at a time is held
                content = error = None
                try:
                    with open(b.column(full)[k].as_py(), "rb") as f:
                        content = f.read()
                except OSError as e:
                    error = str(e)
                row = [c.slice(k, 1) for c in b.columns] + [pa.array([content], pa.binary()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(row, names=[*b.schema.names, "content", "error"])

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
    return files.repartition(n).mapInArrow(run, schema)


def tree_entries(spark: SparkSession, paths: list[str], exclude: list[str] | None = None) -> DataFrame:
    """Entries for `store.pack`: files with contents, folders, symbolic links, and hard links to the first name.

    Files that can't be read and what is neither file, folder nor link are left out, as is the input folder itself.
    """
    rows = tree(spark, paths, exclude).where(F.col("kind").isin("file", "dir", "symlink"))
    first = F.first_value("rel").over(Window.partitionBy("dev", "ino").orderBy("rel"))
    files = rows.where("kind = 'file'")
    # Names of one file share an inode; only those with more than one name are compared.
    many = files.where("nlink > 1").withColumn("first", first)
    linked = many.where("first <> rel").withColumn("kind", F.lit("hardlink")).withColumn("link", F.col("first")).drop("first")
    plain = files.where("nlink <= 1").unionByName(many.where("first = rel").drop("first"))
    columns = ["rel", "kind", "size", "mtime_ns", "mode", "link", "content"]
    read = with_content(plain).where(F.col("error").isNull()).select(*columns)
    rest = rows.where("kind <> 'file'").unionByName(linked).withColumn("content", F.lit(None).cast("binary")).select(*columns)
    return read.unionByName(rest).withColumn("entry_id", F.xxhash64("rel")).withColumnRenamed("rel", "name")
