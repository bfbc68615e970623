"""CSV files with names of their own, one for each document, written and put in place by the executors.

``save`` takes rows of (target, place, cells): the file a row belongs to, which of
several documents of that name it is from, and its fields as texts.  Rows of one
(target, place) must lie together, in order, in one partition.

Two phases.  A Python data source writes whole files into a folder of each task
attempt below ``staged-<run>``, and a list of them; its commit, on the driver,
writes down which attempts count (a line a task).  Then a second job reads those
lists, keeps of each target the document with the greatest place, and moves files
into place, in as many tasks as there are.  So a failed or repeated attempt leaves
nothing that is ever read, a target appears whole or not at all, and the driver
makes no call for a document.  A move that is tried again finds its file in place.

The folder must be one that all workers can write: a shared path, or a store that
pyarrow reaches (hdfs, s3, gs).

Edge cases: no rows write no file; a null field is empty; fields are quoted only
where they must be; the last place of equal targets stays; targets may lie in
folders that aren't there yet.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .storage import ship

SCHEMA = "target string, place string, cells array<string>"
LISTED = "target string, place string, staged string"
LIST, DONE = "files.jsonl", "attempts.txt"


def reach(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def line(fields: list[str | None]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(["" if f is None else f for f in fields])
    return out.getvalue()


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    n: int


class NamedCsvWriter(DataSourceArrowWriter):
    def __init__(self, staging: str, header: list[str]):
        self.staging, self.header = staging, header

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        fs, root = reach(self.staging)
        context = TaskContext.get()
        folder = f"{context.partitionId() if context else 0}-{uuid.uuid4().hex}"
        fs.create_dir(f"{root}/{folder}", recursive=True)
        listed, now, file = [], None, None
        try:
            for b in iterator:
                for target, place, cells in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    if (target, place) != now:
                        if file is not None:
                            file.close()
                        now, staged = (target, place), f"{root}/{folder}/{len(listed)}.csv"
                        file = fs.open_output_stream(staged)
                        file.write(line(self.header).encode())
                        listed.append({"target": target, "place": place, "staged": staged})
                    file.write(line(cells).encode())
        finally:
            if file is not None:
                file.close()
        with fs.open_output_stream(f"{root}/{folder}/{LIST}") as f:
            f.write("".join(json.dumps(x) + "\n" for x in listed).encode())
        return Attempt(folder, len(listed))

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, root = reach(self.staging)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{DONE}") as f:
            f.write("".join(f"{m.folder}\n" for m in messages if m is not None and m.n).encode())

    def abort(self, messages: list[Attempt | None]) -> None:
        fs, root = reach(self.staging)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)


class NamedCsv(DataSource):
    """``rows.write.format("ledgerloom_named_csv").mode("append").options(staging=..., header=<JSON list>).save()``"""

    @classmethod
    def name(cls) -> str:
        return "ledgerloom_named_csv"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> NamedCsvWriter:
        return NamedCsvWriter(self.options["staging"], json.loads(self.options["header"]))


def _move(fs: pafs.FileSystem, staged: str, target: str) -> None:
    """Into place, over an older file; nothing to do if an earlier attempt did it."""
    if fs.get_file_info(staged).type == pafs.FileType.NotFound:
        if fs.get_file_info(target).type != pafs.FileType.File:
            raise FileNotFoundError(f"{staged} is gone and {target} isn't there")
        return
    fs.create_dir(posixpath.dirname(target), recursive=True)
    try:
        fs.move(staged, target)
    except OSError:
        if fs.get_file_info(target).type != pafs.FileType.File:
            raise
        fs.delete_file(target)
        fs.move(staged, target)


def publish(spark: SparkSession, staging: str) -> int:
    """Move what the committed attempts staged into place; how many files there are now."""
    fs, root = reach(staging)
    with fs.open_input_stream(f"{root}/{DONE}") as f:
        attempts = f.read().decode().split()
    if not attempts:
        return 0
    base = staging.rstrip("/")
    listed = spark.read.schema(LISTED).json([f"{base}/{a}/{LIST}" for a in attempts])
    last = listed.groupBy("target").agg(F.max_by("staged", "place").alias("staged"))

    def run(batches):
        for b in batches:
            for target, staged in zip(b.column("target").to_pylist(), b.column("staged").to_pylist(), strict=True):
                there, path = reach(target)
                _move(there, staged, path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    moved = last.repartition(F.xxhash64("target")).mapInArrow(run, "n long")
    return moved.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def save(rows: DataFrame, folder: str, header: list[str]) -> int:
    """Write the files of ``rows`` (``SCHEMA``), staged below ``folder``; how many there are."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(NamedCsv)
    staging = f"{folder.rstrip('/')}/staged-{uuid.uuid4().hex}"
    try:
        rows.select("target", "place", "cells").write.format(NamedCsv.name()).mode("append").options(staging=staging, header=json.dumps(header)).save()
        return publish(spark, staging)
    finally:
        fs, root = reach(staging)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)
