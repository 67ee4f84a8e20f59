"""Which stored version of each table is the current one.

A refresh adds one small file to `<folder>/manifest`, numbered one higher than the last, with an entry for every
table: those it wrote, and those it left alone as they were. The file appears whole and only where there is none
of that number yet. So of two writers one is first, and the other reads what that one did and tries the next
number. Nothing that a reader may hold is overwritten.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest"


@dataclass(frozen=True)
class Entry:
    """A stored table: its path, rows, rows without a date, and first and last date (of those that have one)."""

    path: str
    rows: int
    undated: int | None = None
    first: str | None = None
    last: str | None = None


@dataclass(frozen=True)
class Manifest:
    number: int
    entries: Mapping[str, Entry]


def _opened(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, time of the last change in milliseconds) of what is in a folder; nothing if there is none."""
    files, place = _opened(spark, folder)
    if not files.exists(place):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(place)]


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    names = [n.removesuffix(".json") for n, _ in _names(spark, f"{folder}/{MANIFEST}")]
    return sorted(int(n) for n in names if n.isdigit())


def _path(folder: str, number: int) -> str:
    return f"{folder}/{MANIFEST}/{number:012d}.json"


def publish(spark: SparkSession, text: str, path: str) -> bool:
    """Write a small file that appears whole, or not at all where there is one already (then False)."""
    folder, name = path.rsplit("/", 1)
    files, draft = _opened(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    _, place = _opened(spark, path)
    stream = files.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if files.getScheme() != "file":
            return bool(files.rename(draft, place))  # does not replace a file
        local = [spark._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (place, draft)]
        try:
            spark._jvm.java.nio.file.Files.createLink(*local)  # a local rename would replace it
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True
    finally:
        files.delete(draft, False)


def read_manifest(spark: SparkSession, folder: str, number: int | None = None) -> Manifest:
    """The newest manifest below a folder, or that of a number; empty with number 0 if there is none."""
    folder = folder.rstrip("/")
    numbers = _numbers(spark, folder)
    if number is None and not numbers:
        return Manifest(0, {})
    if number is not None and number not in numbers:
        raise ValueError(f"{folder} has no version {number}; there are {numbers}")
    number = numbers[-1] if number is None else number
    files, place = _opened(spark, _path(folder, number))
    stream = files.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(number, {name: Entry(**entry) for name, entry in json.loads(text).items()})


def commit(spark: SparkSession, folder: str, changes: Mapping[str, Entry]) -> Manifest:
    """Make complete tables the current ones, next to all others as they are by then."""
    folder = folder.rstrip("/")
    while True:
        last = read_manifest(spark, folder)
        entries = {**last.entries, **changes}
        text = json.dumps({name: asdict(entry) for name, entry in sorted(entries.items())}, indent=1)
        if publish(spark, text, _path(folder, last.number + 1)):
            return Manifest(last.number + 1, entries)


def remove_unused(spark: SparkSession, folder: str, keep: int = 1, hours: float = 24.0) -> list[str]:
    """Delete what only manifests before the last `keep` name, if it was not touched for some hours; the paths deleted.

    Younger versions may belong to a refresh that has not published yet.
    """
    folder = folder.rstrip("/")
    numbers = _numbers(spark, folder)
    kept, dropped = numbers[-keep:], numbers[:-keep]
    paths = {e.path.rstrip("/") for n in kept for e in read_manifest(spark, folder, n).entries.values()}
    before, gone = (time.time() - hours * 3600) * 1000, []
    for version, _ in _names(spark, folder):
        if not version.startswith("version-"):
            continue
        left = []
        for table, changed in _names(spark, f"{folder}/{version}"):
            path = f"{folder}/{version}/{table}"
            (left if path in paths or changed > before else gone).append(path)
        if not left and any(p.startswith(f"{folder}/{version}/") for p in gone):
            gone = [p for p in gone if not p.startswith(f"{folder}/{version}/")] + [f"{folder}/{version}"]
    # First the manifests, so that no one opens a version that is about to go.
    for path in [*(_path(folder, n) for n in dropped), *gone]:
        files, place = _opened(spark, path)
        files.delete(place, True)
    return gone


def register(spark: SparkSession, tables: Mapping[str, DataFrame], paths: Mapping[str, str], database: str) -> None:
    """Show stored tables under their names in a database, each a view of its current version."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, path in paths.items():
        columns = ", ".join(f"`{c}`" for c in tables[name].columns)
        spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{name}` AS SELECT {columns} FROM parquet.`{path}`")
