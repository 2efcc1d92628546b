"""A source tree as a data source: directories that are skipped are never opened, and contents are read by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftline import fixed

#: Bytes of contents that leave a reading task at once; one file is never split.
BATCH_BYTES = 16 << 20


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path within it, and what precedes such paths in the names that Spark gives files.
    ValueError for file systems that Arrow doesn't know."""
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    system, inner = fs.FileSystem.from_uri(path)
    inner = inner.rstrip("/") or "/"
    whole = path.rstrip("/")
    return system, inner, "file:" if isinstance(system, fs.LocalFileSystem) else whole.removesuffix(inner) if whole.endswith(inner) else ""


def entries(system: fs.FileSystem, directory: str, extensions: frozenset[str]) -> tuple[list[str], list[fs.FileInfo]]:
    """The directories of a directory that are entered, and the files whose extension is asked for; links to directories count as such."""
    found = system.get_file_info(fs.FileSelector(directory))
    below = sorted(x.path for x in found if x.type == fs.FileType.Directory and x.base_name not in fixed.SKIPPED_DIRECTORIES)
    return below, sorted((x for x in found if x.type == fs.FileType.File and x.extension.lower() in extensions), key=lambda x: x.path)


class Subtree(InputPartition):
    """A directory, with all below it or alone."""

    def __init__(self, directory: str, deep: bool):
        super().__init__(directory)
        self.directory, self.deep = directory, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.tasks = options["path"], int(options.get("tasks", "64"))
        self.extensions = frozenset(options["extensions"].split(","))

    def partitions(self) -> list[Subtree]:
        """Directories, level by level until there are `tasks` of them; the last level's are walked by the tasks that read them."""
        system, inner, _ = opened(self.root)
        above, level = [], [inner]
        while level and len(level) < self.tasks:
            above += level
            level = [d for x in level for d in entries(system, x, frozenset())[0]]
        return [Subtree(d, False) for d in above] + [Subtree(d, True) for d in level]

    def read(self, partition: Subtree) -> Iterator[tuple[str, int]]:
        system, _, prefix = opened(self.root)
        waiting = [partition.directory]
        while waiting:
            below, files = entries(system, waiting.pop(), self.extensions)
            for x in files:
                yield prefix + x.path, x.size
            if partition.deep:
                waiting += below


class SourceTree(DataSource):
    """(path, length) of the files below `path` whose extension is one of `extensions` (comma-separated), outside skipped directories."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def listed(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """(path, length) of the files that SourceTree finds."""
    spark.dataSource.register(SourceTree)
    tasks = 4 * spark.sparkContext.defaultParallelism
    return spark.read.format("source_tree").option("extensions", ",".join(x.lstrip(".").lower() for x in extensions)).option("tasks", tasks).load(path)


def contents(files: DataFrame, root: str) -> DataFrame:
    """files(path, ...) -> (path, content). Paths are dealt out by hash first, so that a directory which holds most files is read by all tasks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _, prefix = opened(root)
        paths, held, size = [], [], 0
        for b in batches:
            for path in b["path"]:
                with system.open_input_stream(path.removeprefix(prefix)) as stream:
                    held.append(stream.read())
                paths.append(path)
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    yield pd.DataFrame({"path": paths, "content": held})
                    paths, held, size = [], [], 0
        if paths:
            yield pd.DataFrame({"path": paths, "content": held})

    return files.select("path").repartition("path").mapInPandas(read, "path string, content binary")
