"""Sets of result tables that appear as a whole.

An output folder holds ``versions/<number>-<id>/``, the tables of one job, and
``manifests/<number>.json``, which names every table of a set with its place. A job writes
all tables of its version first and its manifest last, under another name that is then
changed; the manifest of the highest number is the current set. A job that dies midway
leaves a version without a manifest, which no reader sees. A set may take over tables of the
one before; their files stay where they are.

Two jobs that end at once get different numbers. A set that takes over tables is refused
if another was published since it began, as it would mix tables of the two.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFESTS, VERSIONS = "manifests", "versions"
_NUMBER = re.compile(r"(\d{8})\.json")


class Conflict(RuntimeError):
    """Another job published a set in the meantime."""


@dataclass
class Manifest:
    number: int
    #: The set whose tables were taken over, if any.
    based_on: int | None = None
    #: name: {"path": below the output folder, "format": ...}
    tables: dict[str, dict] = field(default_factory=dict)


def _hadoop(spark: SparkSession):
    return spark._jvm.org.apache.hadoop.fs


def _fs(spark: SparkSession, folder: str):
    path = _hadoop(spark).Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _fs(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def _numbers(spark: SparkSession, out: str) -> list[int]:
    found = map(_NUMBER.fullmatch, _names(spark, f"{out}/{MANIFESTS}"))
    return sorted(int(m[1]) for m in found if m)


def manifest(spark: SparkSession, out: str, number: int) -> Manifest:
    path = f"{out}/{MANIFESTS}/{number:08d}.json"
    return Manifest(**json.loads(spark.read.text(path, wholetext=True).first()[0]))


def current(spark: SparkSession, out: str) -> Manifest | None:
    """The set that readers see; None if nothing was published."""
    numbers = _numbers(spark, out)
    return manifest(spark, out, numbers[-1]) if numbers else None


def table_path(spark: SparkSession, out: str, name: str) -> tuple[str, str]:
    """Path and format of a table of the current set."""
    now = current(spark, out)
    if now is None or name not in now.tables:
        raise FileNotFoundError(f"no published table {name} in {out}")
    entry = now.tables[name]
    return f"{out}/{entry['path']}", entry["format"]


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Gives a file another name; False if the target exists."""
    jvm, hadoop = spark._jvm, _hadoop(spark)
    context = hadoop.FileContext.getFileContext(
        hadoop.Path(target).toUri(), spark._jsc.hadoopConfiguration()
    )
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(hadoop.Path(source), hadoop.Path(target), options)
    except Py4JJavaError as problem:
        if "FileAlreadyExists" in problem.java_exception.getClass().getName():
            return False
        raise
    return True


class Publication:
    """Tables that a job writes, and then publishes together."""

    def __init__(self, spark: SparkSession, out: str, take_over: bool = False) -> None:
        self.spark, self.out = spark, out.rstrip("/")
        numbers = _numbers(spark, self.out)
        self.seen = numbers[-1] if numbers else 0
        self.base = manifest(spark, self.out, self.seen) if take_over and numbers else None
        self.version = f"{VERSIONS}/{self.seen + 1:08d}-{uuid.uuid4().hex[:12]}"
        self.tables: dict[str, dict] = {}

    def path(self, name: str, fmt: str = "parquet") -> str:
        """Where the job writes a table of that name, which then belongs to the set."""
        self.tables[name] = {"path": f"{self.version}/{name}", "format": fmt}
        return f"{self.out}/{self.version}/{name}"

    def read(self, name: str) -> DataFrame:
        """A Parquet table that this job has written, or took over."""
        entry = self.tables.get(name) or (self.base and self.base.tables.get(name))
        if not entry:
            raise FileNotFoundError(f"no published table {name} in {self.out}")
        return self.spark.read.format(entry["format"]).load(f"{self.out}/{entry['path']}")

    def publish(self) -> Manifest:
        """Makes the tables the current set."""
        hadoop = _hadoop(self.spark)
        fs, folder = _fs(self.spark, f"{self.out}/{MANIFESTS}")
        fs.mkdirs(folder)
        taken = self.base.tables if self.base else {}
        number = self.seen + 1
        while True:
            done = Manifest(number, self.base.number if self.base else None, taken | self.tables)
            draft = f"{self.out}/{MANIFESTS}/_{uuid.uuid4().hex}"
            stream = fs.create(hadoop.Path(draft), False)
            stream.write(bytearray(json.dumps(done.__dict__, indent=1, sort_keys=True).encode()))
            stream.close()
            if rename(self.spark, draft, f"{self.out}/{MANIFESTS}/{number:08d}.json"):
                return done
            fs.delete(hadoop.Path(draft), False)
            if self.base:
                raise Conflict(f"{self.out} has a newer set than the one this job took over")
            number += 1


def published(spark: SparkSession, out: str, name: str, **options) -> DataFrame:
    """A table of the current set as it was written."""
    path, fmt = table_path(spark, out, name)
    return spark.read.options(**options).format(fmt).load(path)


def expire(spark: SparkSession, out: str, keep: int = 2) -> list[str]:
    """Removes all but the newest ``keep`` sets, the versions that only older ones name,
    and those of the same age that were never published; returns the versions removed."""
    if keep < 1:
        raise ValueError("keep at least the current set")
    fs, root = _fs(spark, out)
    numbers = _numbers(spark, out)
    kept = [manifest(spark, out, n) for n in numbers[-keep:]]
    if not kept:
        return []
    named = {entry["path"].split("/")[1] for m in kept for entry in m.tables.values()}
    old = [
        v for v in _names(spark, f"{out}/{VERSIONS}") if v not in named and int(v.split("-")[0]) < kept[0].number
    ]
    for number in numbers[:-keep]:
        fs.delete(_hadoop(spark).Path(f"{out}/{MANIFESTS}/{number:08d}.json"), False)
    for version in old:
        fs.delete(_hadoop(spark).Path(f"{out}/{VERSIONS}/{version}"), True)
    return sorted(old)
