"""Versions of a target: written whole beside the current one, then made current by one pointer.

A version is a folder of its own below ``<target>/versions`` with its datasets and a manifest: number,
parent, tag, and per dataset its parts with their lengths and the number of rows. ``<target>/CURRENT.json``
names the current version and is put in place last, by a rename, so a reader sees the former version
or the new one, and a run that is ended before leaves the former. One writer at a time: a version
whose parent is no longer current is refused.

Files are reached through Spark's own file systems, so a target may be in any store that Spark reads.
"""

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT.json"


class VersionConflict(RuntimeError):
    """Another version became current while this one was written."""


@dataclass(frozen=True)
class Version:
    target: str
    name: str
    number: int
    parent: str | None
    tag: int | None
    datasets: dict[str, dict]

    @property
    def folder(self) -> str:
        return f"{self.target}/versions/{self.name}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def rows(self, name: str) -> int:
        return self.datasets[name]["rows"]


@dataclass
class Draft:
    """A version while it is written. Nothing of it is visible before ``commit``."""

    spark: SparkSession
    target: str
    parent: Version | None
    name: str
    datasets: dict[str, dict] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.target}/versions/{self.name}/{name}"

    def add(self, name: str, rows: int) -> None:
        """Take the written dataset ``name`` into the manifest."""
        self.datasets[name] = {"rows": rows, "parts": _parts(self.spark, self.path(name))}

    def write_table(self, name: str, df: DataFrame) -> None:
        df.write.parquet(self.path(name))
        self.add(name, self.spark.read.schema(df.schema).parquet(self.path(name)).count())

    def commit(self, tag: int | None = None) -> Version:
        """Make the version current. ``tag`` is the caller's mark, such as the batch that it comes from."""
        now = current(self.spark, self.target)
        if (now and now.name) != (self.parent and self.parent.name):
            raise VersionConflict(f"{self.target} has a newer version: {now and now.name}")
        version = Version(
            self.target, self.name, self.parent.number + 1 if self.parent else 1,
            self.parent.name if self.parent else None, tag, self.datasets)
        manifest = {key: value for key, value in asdict(version).items() if key != "target"}  # a target may be moved
        _put(self.spark, f"{version.folder}/MANIFEST.json", json.dumps(manifest))
        _put(self.spark, f"{self.target}/{POINTER}", json.dumps({"version": self.name}))
        return version


def begin(spark: SparkSession, target: str) -> Draft:
    """A draft whose parent is the current version."""
    return Draft(spark, target, current(spark, target), uuid.uuid4().hex)


def current(spark: SparkSession, target: str) -> Version | None:
    """The current version, or nothing if the target has none. A version that lacks a part is an error."""
    pointer = _get(spark, f"{target}/{POINTER}")
    return _load(spark, target, json.loads(pointer)["version"]) if pointer else None


def history(spark: SparkSession, target: str) -> list[Version]:
    """The current version, its parent, and so on, as far as they are kept."""
    out = []
    version = current(spark, target)
    while version:
        out.append(version)
        kept = version.parent and _get(spark, f"{target}/versions/{version.parent}/MANIFEST.json")
        version = _load(spark, target, version.parent) if kept else None
    return out


def drop_versions(spark: SparkSession, target: str, keep: int = 2) -> int:
    """Delete all but the current version and its next ``keep`` - 1 ancestors, drafts that were given up included.

    To be called by the writer, which has no draft open. Returns how many were deleted.
    """
    kept = {version.name for version in history(spark, target)[:keep]}
    system, path = _system(spark, f"{target}/versions")
    if not system.exists(path):
        return 0
    old = [status.getPath() for status in system.listStatus(path) if status.getPath().getName() not in kept]
    for folder in old:
        system.delete(folder, True)
    return len(old)


def _load(spark: SparkSession, target: str, name: str) -> Version:
    version = Version(target, **json.loads(_get(spark, f"{target}/versions/{name}/MANIFEST.json")))
    for name, dataset in version.datasets.items():
        found = {part["name"]: part["bytes"] for part in _parts(spark, version.path(name))}
        for part in dataset["parts"]:
            if found.get(part["name"]) != part["bytes"]:
                raise FileNotFoundError(f"{version.path(name)}/{part['name']} is not as the manifest has it")
    return version


def _system(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def _parts(spark: SparkSession, folder: str) -> list[dict]:
    system, path = _system(spark, folder)
    files = system.listFiles(path, True)
    parts, top = [], system.getFileStatus(path).getPath().toString()
    while files.hasNext():
        status = files.next()
        name = status.getPath().toString()[len(top) + 1 :]
        if not any(piece.startswith(("_", ".")) for piece in name.split("/")):
            parts.append({"name": name, "bytes": status.getLen()})
    return sorted(parts, key=lambda part: part["name"])


def _get(spark: SparkSession, file: str) -> str | None:
    system, path = _system(spark, file)
    if not system.exists(path):
        return None
    return spark.read.text(file, wholetext=True).first()[0]


def _put(spark: SparkSession, file: str, text: str) -> None:
    """Write a small file under a passing name and rename it over the old one."""
    hidden = file.rsplit("/", 1)
    system, path = _system(spark, f"{hidden[0]}/.{hidden[1]}-{uuid.uuid4().hex}")
    out = system.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, (_, final) = spark._jvm, _system(spark, file)
    options = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    whole = system.makeQualified(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        whole.toUri(), spark._jsc.hadoopConfiguration()).rename(whole, system.makeQualified(final), options)
