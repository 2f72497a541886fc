"""Folders of many small files, listed and read by tasks that take many files each.

Spark's file readers list all files on the driver and give a task 32 small files, as each counts as 4 MB at least. Here tasks list
the folders and bundle the files, so the driver meets no list of files and the number of tasks follows files and bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scratch import cut

#: Files and bytes after which a bundle ends, and bytes after which a batch of contents does.
FILES, BYTES, BATCH = 2_000, 64 << 20, 4 << 20


def arrow_folder(spark: SparkSession, path: str) -> str | None:
    """The URI of a local or HDFS folder that Arrow can open; None for patterns, single files and other stores."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    if uri.getScheme() not in ("file", "hdfs"):
        return None
    try:
        store, root = fs.FileSystem.from_uri(uri.toASCIIString())
        return uri.toASCIIString() if store.get_file_info(root).type == fs.FileType.Directory else None
    except (OSError, ValueError):  # no client of the store here
        return None


def read_small_files(spark: SparkSession, uri: str, suffix: str = "", depth: int = 0) -> DataFrame:
    """(file_name, content) of the files that lie ``depth`` folders below a folder of arrow_folder; empty and hidden ones give no row.

    A folder's list is held by one task, so very many files are best spread over folders.
    """
    shown = lambda name: not name.startswith(".") and (not name.startswith("_") or "=" in name)  # noqa: E731  the rule of Spark's readers

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                below = [f"{folder}/{i.base_name}" for i in store.get_file_info(fs.FileSelector(root + folder)) if i.type == fs.FileType.Directory and shown(i.base_name)]
                yield pa.RecordBatch.from_arrays([pa.array(below, pa.string())], ["folder"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        ready = lambda: pa.RecordBatch.from_arrays([pa.array([files], pa.list_(pa.string()))], ["files"])
        files, size = [], 0
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for i in store.get_file_info(fs.FileSelector(root + folder)):
                    if i.type == fs.FileType.File and i.size and i.base_name.endswith(suffix) and shown(i.base_name):
                        files.append(f"{folder}/{i.base_name}")
                        size += i.size
                        if len(files) >= FILES or size >= BYTES:
                            yield ready()
                            files, size = [], 0
        if files:
            yield ready()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        ready = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["file_name", "content"])
        names, contents, size = [], [], 0
        for batch in batches:
            for name in batch.column(0).flatten().to_pylist():
                with store.open_input_file(root + name) as f:
                    contents.append(f.read())
                names.append(name.rpartition("/")[2])
                size += len(contents[-1])
                if size >= BATCH:
                    yield ready()
                    names, contents, size = [], [], 0
        if names:
            yield ready()

    folders = spark.createDataFrame([("",)], "folder string").coalesce(1)
    for _ in range(depth):
        folders = folders.mapInArrow(inner, "folder string").repartition(spark.sparkContext.defaultParallelism)
    bundles = cut(folders.mapInArrow(bundle, "files array<string>"))
    return bundles.repartition(max(1, bundles.count())).mapInArrow(read, "file_name string, content binary")
