"""Text files below a folder of a local or mounted disk, listed, read and written by the tasks.

Spark's own reader lists every file in the driver and opens 32 of them in a task; its writer starts a process for each file
to set its mode where Hadoop has no native libraries.  With a file for each answer both cost more than the texts do.
"""

from __future__ import annotations

import os
import re
import sys
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from answerlens.operators.scale import materialize

# The functions go to the tasks themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILES_PER_TASK = 4096
_FOLDERS = 8  # folders for each core, at least, by which the listing is dealt out
_MOST_FOLDERS = 100_000  # a folder that holds more is left whole, so that the driver never holds all
_BATCH_FILES, _BATCH_BYTES = 10_000, 1 << 20

_GLOB = re.compile(r"[\[\]{}*?\\]")
_PACKED = r"(?s)\.(bz2|deflate|gz|lz4|passthrough|snappy|zst)$"  # endings that Hadoop unpacks
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on the local disk; None if it is on another file system."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _seen(entry: os.DirEntry) -> bool:
    """Whether Spark's listing looks at the file or folder."""
    name, folder = entry.name, entry.is_dir()
    if name.startswith(("_common_metadata", "_metadata")) and folder:
        return True
    hidden = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
    return not hidden and (folder or entry.is_file())


def _entries(folder: str) -> Iterator[os.DirEntry]:
    with os.scandir(folder) as entries:
        yield from filter(_seen, entries)


def _folders(root: str, wanted: int) -> list[tuple[str, bool]]:
    """Folders that hold all files below ``root`` between them, each with or without what its own folders hold."""
    found, left = [], deque([root])
    while left and len(found) + len(left) < wanted:
        folder = left.popleft()
        below = list(islice((e.path for e in _entries(folder) if e.is_dir()), _MOST_FOLDERS + 1))
        found.append((folder, len(below) > _MOST_FOLDERS))
        if len(below) <= _MOST_FOLDERS:
            left.extend(below)
    return found + [(folder, True) for folder in left]


def _listed(pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Paths of the files, of a name that ``pattern`` matches, in folders (folder, deep)."""

    def files(batches):
        fits, paths = re.compile(pattern, re.DOTALL).fullmatch, []
        for batch in batches:
            for folder, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left = [folder]
                while left:
                    for entry in _entries(left.pop()):
                        if entry.is_dir():
                            if deep:
                                left.append(entry.path)
                        elif fits(entry.name):
                            paths.append(os.fsencode(entry.path))
                            if len(paths) == _BATCH_FILES:
                                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary())], ["path"])
                                paths = []
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary())], ["path"])

    return files


def list_files(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """Written table (path) of the files of a name pattern below ``path``, those that Spark's readers would take.

    None if they are left to Spark's own reader: on another file system, below a path that is no folder or holds a
    pattern, with names by more than ``*`` and ``?``, or if some are packed.
    """
    root = local_path(spark, path)
    if root is None or _GLOB.search(path) or set(name) & set("[]{}\\") or not os.path.isdir(root):
        return None
    cores = spark.sparkContext.defaultParallelism
    folders = _folders(root, _FOLDERS * cores)
    dealt = spark.createDataFrame(folders, "folder string, deep boolean").repartition(min(len(folders), 2 * cores), "folder")
    pattern = "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in name)
    paths = materialize(dealt.mapInArrow(_listed(pattern), "path binary"))
    return paths if paths.filter(F.col("path").cast("string").rlike(_PACKED)).isEmpty() else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, texts, size = [], [], 0

        def out():
            columns = batch.take(pa.array(rows, pa.int32())).columns
            return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], [*batch.schema.names, "text"])

        for k, path in enumerate(batch.column("path").to_pylist()):
            with open(path, "rb", buffering=0) as file:
                text = file.readall()
            if not text:  # Spark's readers leave empty files out
                continue
            rows.append(k)
            texts.append(text)
            size += len(text)
            if size >= _BATCH_BYTES:
                yield out()
                rows, texts, size = [], [], 0
        if rows:
            yield out()


def read_texts(files: DataFrame, count: int) -> DataFrame:
    """``text`` of each file in place of its ``path``, in tasks of about FILES_PER_TASK of ``count`` files."""
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-count // FILES_PER_TASK))
    kinds = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    read = files.repartition(tasks, "path").mapInArrow(_read, f"{kinds}, text binary")
    return read.withColumn("text", F.col("text").cast("string")).drop("path")


def _folder(names: list[str], values: list[str | None]) -> str:
    """Folders that Spark's writers make of a row's partition columns."""
    escape = lambda s: _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", s)
    return "/".join(f"{escape(n)}={escape(v) if v else _NO_VALUE}" for n, v in zip(names, values))


def _written(root: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write each row's text, which is the last column, to its own file; the number of files."""

    def files(batches):
        task, made, n = TaskContext.get(), set(), 0
        for batch in batches:
            *keys, texts = batch.columns
            for *values, text in zip(*(c.to_pylist() for c in keys), texts):
                folder = f"{root}/{_folder(names, values)}"
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                file = f"part-{task.partitionId():05d}-{n:09d}.txt"
                part = f"{folder}/.{file}.{task.taskAttemptId()}"
                with open(part, "wb") as out:
                    out.write(text.as_buffer() or b"")
                    out.write(b"\n")
                os.replace(part, f"{folder}/{file}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    return files


def write_files(df: DataFrame, path: str, keys: list[str]) -> None:
    """A file for each row below ``path``, in folders by ``keys``: its ``text`` and a line end, as Spark's text writer has it.

    On a local disk the tasks write the files themselves, each under its final name once it is whole.  A file is named by its
    place in its partition, so a task that runs again writes the same ones; the rows must come in a fixed order, as from a scan.
    """
    root = local_path(df.sparkSession, path)
    if root is None:
        rows = df.select(*keys, "text").repartition(*keys)
        rows.write.option("maxRecordsPerFile", 1).partitionBy(*keys).text(path)
        return
    os.makedirs(root, exist_ok=True)
    rows = df.select(*[F.col(k).cast("string") for k in keys], F.col("text").cast("binary"))
    rows.mapInArrow(_written(root, keys), "files long").agg(F.sum("files")).collect()
