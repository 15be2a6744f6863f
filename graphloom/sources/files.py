"""Scans of file trees."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalars as S
from ..operators.graph import Steps, in_order, new_folder

#: entries that a task lists before it hands the folders left over to the next round, and files of a reading task
LISTED, READ_FILES = 20_000, 2_000
_ENTRY = "path string, size long, mtime timestamp, folder boolean"


class Store:
    """The files below a root, for tasks: a local or shared folder, or a store that Arrow's file systems open (s3, gs, hdfs)."""

    def __init__(self, root: str) -> None:
        scheme, _, rest = root.partition("://") if "://" in root else ("file", "", root.removeprefix("file:"))
        self.fs, self.root = None, rest if scheme == "file" else root
        if scheme != "file":
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(root)
        self.root = self.root.rstrip("/")

    def entries(self, folder: str) -> Iterator[tuple[str, int, int, bool]]:
        """(name, bytes, modified in microseconds, is a folder) of a folder's entries; links are left out, and so is a folder that cannot be read."""
        at = f"{self.root}/{folder}" if folder else self.root
        if self.fs:
            from pyarrow import fs

            for e in self.fs.get_file_info(fs.FileSelector(at)):
                yield e.base_name, e.size or 0, (e.mtime_ns or 0) // 1000, e.type == fs.FileType.Directory
            return
        try:
            found = list(os.scandir(at))
        except OSError:
            return
        for e in found:
            if e.is_dir(follow_symlinks=False):
                yield e.name, 0, 0, True
            elif e.is_file(follow_symlinks=False):
                about = e.stat()
                yield e.name, about.st_size, about.st_mtime_ns // 1000, False

    def read(self, path: str) -> bytes | None:
        """A file's bytes; none if it cannot be read."""
        try:
            if self.fs:
                with self.fs.open_input_file(f"{self.root}/{path}") as f:
                    return f.read()
            with open(f"{self.root}/{path}", "rb") as f:
                return f.read()
        except OSError:
            return None

    def write(self, path: str, content: bytes) -> None:
        at = f"{self.root}/{path}"
        if self.fs:
            self.fs.create_dir(at.rpartition("/")[0], recursive=True)
            with self.fs.open_output_stream(at) as f:
                f.write(content)
            return
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(content)


def _lister(root: str, most: int):
    """Lists folders and what is below them, ignored ones never; after ``most`` entries folders are passed on unlisted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for batch in batches:
            todo, rows = batch.column("path").to_pylist(), []
            while todo and len(rows) < most:
                folder = todo.pop()
                for name, size, changed, inside in store.entries(folder):
                    path = f"{folder}/{name}" if folder else name
                    if not inside:
                        rows.append((path, size, changed, False))
                    elif not name.startswith(".") and name not in V.IGNORED_DIRS:
                        todo.append(path)
            rows += [(path, None, None, True) for path in todo]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()), strict=True)], ["path", "size", "mtime", "folder"])

    return run


def listing(spark: SparkSession, root: str, most: int = LISTED) -> DataFrame:
    """path, size, mtime of all files below root that no ignored folder holds, whatever their names.

    Round by round: a task walks the folders it is given up to ``most`` entries, and those
    it leaves are dealt anew, so neither one task nor the driver lists a large tree.  Each
    round is written once.
    """
    steps = Steps(spark)
    front, tasks = spark.createDataFrame([("",)], "path string"), 1
    while True:
        found = steps.add(front.repartition(tasks, "path").mapInArrow(_lister(root, most), _ENTRY))
        front = found.where("folder").select("path")
        left = front.count()
        if not left:
            return steps.all().where("not folder").select("path", "size", "mtime")
        tasks = min(left, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def scan(spark: SparkSession, root: str, content: bool = True, most: int = LISTED) -> DataFrame:
    """Path, name, extension, language, size, depth, mtime, reason, content of all files below root.

    Ignored folders are pruned before they are listed, links are left out; files whose names
    begin with a dot or an underscore are files like any other.  ``reason`` is null for
    files to keep.  Content is that of kept files in valid UTF-8, else null, read by tasks
    that are dealt equal numbers of files; without ``content`` no file is opened.
    """
    base = root.rstrip("/")
    f = listing(spark, base, most).withColumn("reason", S.skip_reason(F.col("path"), F.col("size")))
    p = F.col("path")
    out = f.select(p, S.basename(p).alias("name"), F.lower(S.extension(p)).alias("extension"), S.language(p).alias("language"), "size", S.depth(p).alias("depth"), "mtime", "reason")
    if not content:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(base)
        for batch in batches:
            for row in range(0, batch.num_rows, 64):  # a few files of bounded size at a time
                part = batch.slice(row, 64)
                held = [store.read(p) if r is None else None for p, r in zip(part.column("path").to_pylist(), part.column("reason").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*part.schema.names, "content"])

    tasks = max(1, -(-f.count() // READ_FILES))
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in out.schema)
    return out.repartition(tasks, "path").mapInArrow(run, f"{kinds}, content binary").withColumn("content", F.try_validate_utf8(F.col("content").cast("string")))


def write_tree(files: DataFrame, root: str) -> int:
    """Writes each row's ``content`` as a file at ``root``/``path``, in tasks; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                store.write(path, content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors see."""
    return new_folder(spark)


def preload(files: DataFrame, scan: str, largest: int = V.PRELOAD_FILE, most: int = V.PRELOAD_ALL) -> DataFrame:
    """In order of the scan, files under ``largest`` bytes while their sum stays within ``most``.

    The sum counts every file that is small enough; it runs over ranges of the scan.
    """
    small = files.withColumn("__counted", F.when(F.col("size") < largest, F.col("size")).otherwise(0))
    return in_order(small, [scan], upto="__counted").where((F.col("size") < largest) & (F.col("upto") <= most)).drop("__counted", "upto", "place")


def within_limits(files: DataFrame) -> DataFrame:
    """S1 guard: one row: files, bytes and whether a repository of that size is accepted."""
    t = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return t.withColumn("accepted", (F.col("files") <= V.MAX_REPO_FILES) & (F.col("bytes") <= V.MAX_REPO_BYTES))
