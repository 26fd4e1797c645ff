"""Snapshots of a log: which folders it consists of, switched by one atomic rename.

A log's folder holds ``build=...`` folders of rows, ``_keys`` folders of their key indices, and
``_snapshots``, numbered files that name the folders of each state of the log. Writers prepare new
folders and publish the next number; a number that is there already is a conflict, so of two
writers one starts again. Readers take the highest number and never see folders in the making.
Publishing needs a file system whose rename without overwriting is atomic.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from turnlake.sources.folders import _location, names_in, path_exists, remove

SNAPSHOTS = "_snapshots"
KEYS = "_keys"
BUILD = "build="
# Folders of logs that were written without snapshots.
LOAD = "load_id="


class Conflict(Exception):
    """Another writer has published this number."""


@dataclass(frozen=True)
class Entry:
    """One folder of a log: the load that wrote it, and its key index if it has one."""

    load_id: str | None
    folder: str
    keys: str | None = None
    buckets: int = 0


@dataclass(frozen=True)
class Snapshot:
    version: int
    entries: list[Entry]
    # Folders of another log that this one is derived from.
    derived_from: list[str] = field(default_factory=list)

    def next(self, entries: list[Entry], derived_from: list[str] | None = None) -> Snapshot:
        kept = self.derived_from if derived_from is None else derived_from
        return replace(self, version=self.version + 1, entries=entries, derived_from=kept)


def _versions(spark: SparkSession, path: str) -> list[int]:
    names = names_in(spark, f"{path}/{SNAPSHOTS}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def _file(path: str, version: int) -> str:
    return f"{path}/{SNAPSHOTS}/{version:012d}.json"


def read(spark: SparkSession, path: str, version: int) -> Snapshot:
    location, files = _location(spark, _file(path, version))
    stream = files.open(location)
    try:
        told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Snapshot(version, [Entry(**e) for e in told["entries"]], told["derived_from"])


def latest(spark: SparkSession, path: str) -> Snapshot:
    """The present state. A log without snapshots consists of its load folders, or of itself."""
    versions = _versions(spark, path)
    if versions:
        return read(spark, path, versions[-1])
    names = names_in(spark, path)
    loads = sorted(n for n in names if n.startswith(LOAD))
    if loads:
        return Snapshot(0, [Entry(n.removeprefix(LOAD), n) for n in loads])
    rows = [n for n in names if not n.startswith(("_", ".", BUILD))]
    return Snapshot(0, [Entry(None, "")] if rows else [])


def publish(spark: SparkSession, path: str, snapshot: Snapshot) -> None:
    """Make this the state of the log, or raise ``Conflict``; then drop what no reader needs."""
    text = json.dumps(
        {"entries": [asdict(e) for e in snapshot.entries], "derived_from": snapshot.derived_from}
    )
    fs = spark._jvm.org.apache.hadoop.fs
    draft, files = _location(spark, f"{path}/{SNAPSHOTS}/.{uuid.uuid4().hex}")
    target = files.makeQualified(fs.Path(_file(path, snapshot.version)))
    stream = files.create(draft)
    stream.write(text.encode())
    stream.close()
    context = fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    keep = getattr(fs, "Options$Rename").NONE
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    options[0] = keep
    try:
        context.rename(files.makeQualified(draft), target, options)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        raise Conflict(f"{path}, state {snapshot.version}") from None
    _vacuum(spark, path, snapshot)


def _vacuum(spark: SparkSession, path: str, snapshot: Snapshot) -> None:
    """Drop states before the last two, and folders that only they name.

    So a reader of the state before this one is not disturbed.
    """
    versions = [v for v in _versions(spark, path) if v < snapshot.version]
    live = [*snapshot.entries, *(read(spark, path, versions[-1]).entries if versions else [])]
    used = {e.folder for e in live} | {e.keys for e in live}
    for version in versions[:-1]:
        for entry in read(spark, path, version).entries:
            for folder in (entry.folder, entry.keys):
                if folder and folder not in used:
                    remove(spark, f"{path}/{folder}")
        remove(spark, _file(path, version))


def has_snapshot(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/{SNAPSHOTS}") and bool(_versions(spark, path))


def live_folders(spark: SparkSession, path: str) -> list[str]:
    return [f"{path}/{e.folder}".rstrip("/") for e in latest(spark, path).entries]


def new_folder() -> str:
    return f"{BUILD}b{uuid.uuid4().hex}"
