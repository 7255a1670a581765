"""Scan a source tree again at the cost of what changed.

A scan leaves a version of its target with two tables: ``files``, the manifest (path, length, modified, hash), and
``states``, what each file says of each key. The next scan lists the tree without reading it, compares the
list with the manifest, reads the files that are new or whose length or time differ, and takes the
states of all others from the version before. Merged, the states give the strings of a full scan.
"""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.extract import file_states, finish_states, merge_states, scannable
from ..sinks import versions
from ..sources.files import decode_utf8
from .staging import owned_tables, stage

# Up to so many changed files are read by name; beyond it the tree is read and the others are dropped undecoded.
MOST_PATHS = 10_000
_FILES = "path string, length bigint, modified timestamp, hash string"
Reader = Callable[[DataFrame], DataFrame]


def list_files(spark: SparkSession, folder: str, suffix: str = ".dart") -> DataFrame:
    """path, length, modified of the source files worth scanning; no content is read."""
    found = _tree(spark, folder, suffix)
    return found.select("path", "length", F.col("modificationTime").alias("modified")).where(scannable(suffix=suffix))


def read_changed(spark: SparkSession, folder: str, suffix: str = ".dart") -> Reader:
    """A reader of (path, data) for the paths of a table."""

    def read(changed: DataFrame) -> DataFrame:
        paths = [r["path"] for r in changed.select("path").limit(MOST_PATHS + 1).collect()]
        if 0 < len(paths) <= MOST_PATHS and not any(re.search(r"[*?\[\]{}\\,]", path) for path in paths):
            found = spark.read.format("binaryFile").load(paths)
        else:
            found = _tree(spark, folder, suffix).join(changed.select("path"), "path", "left_semi")
        return found.select("path", F.col("content").alias("data"))

    return read


def _tree(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
    return reader.load(folder)


def compare(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, length, modified, state of the files that are ``new``, ``changed`` or ``gone``."""
    old = manifest.select("path", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    both = listing.select("path", "length", "modified").join(old, "path", "full_outer")
    same = F.col("length").eqNullSafe(F.col("_length")) & F.col("modified").eqNullSafe(F.col("_modified"))
    state = F.when(F.col("_length").isNull(), "new").when(F.col("length").isNull(), "gone").when(~same, "changed")
    return both.withColumn("state", state).where("state is not null").select("path", "length", "modified", "state")


def scan(spark: SparkSession, listing: DataFrame, read: Reader, target: str, localized_rule: str = "line") -> versions.Version:
    """Bring the target up to the listing (path, length, modified) and make the result its current version.

    ``read`` gives (path, data) of the files of a table with their paths. Files that are not UTF-8 stay in
    the manifest and say nothing.
    """
    former = versions.current(spark, target)
    with owned_tables(spark):
        draft = versions.begin(spark, target)
        manifest = _table(spark, former, "files") if former else spark.createDataFrame([], _FILES)
        difference = stage(compare(listing, manifest), "difference")
        files = read(difference.where("state <> 'gone'"))
        text = F.coalesce(decode_utf8(F.col("data")), F.lit(""))
        read_files = files.select("path", text.alias("content"), F.sha2("data", 256).alias("hash"))
        found = stage(_file_states(read_files, localized_rule), "found")
        hashes = found.groupBy("path").agg(F.max("hash").alias("hash"))
        kept = manifest.join(difference.select("path"), "path", "left_anti")
        arrived = difference.where("state <> 'gone'").join(hashes, "path").select("path", "length", "modified", "hash")
        draft.write_table("files", kept.unionByName(arrived))
        states = found.where("key is not null").drop("hash")
        if former:
            old = _table(spark, former, "states")
            states = old.join(difference.select("path"), "path", "left_anti").unionByName(states)
        draft.write_table("states", states)
        draft.write_table("difference", difference)
        return draft.commit()


def rescan(spark: SparkSession, folder: str, target: str, suffix: str = ".dart") -> versions.Version:
    """Scan a source tree into a target, for the first time or again."""
    return scan(spark, list_files(spark, folder, suffix), read_changed(spark, folder, suffix), target)


def read_strings(spark: SparkSession, target: str) -> DataFrame:
    """The strings of the last scan, as ``extract.unique_strings`` gives them."""
    states = _table(spark, versions.current(spark, target), "states")
    return finish_states(merge_states(states.drop("path")))


def read_difference(spark: SparkSession, target: str) -> DataFrame:
    """What the last scan found changed: path, length, modified, state."""
    return _table(spark, versions.current(spark, target), "difference")


def _file_states(files: DataFrame, localized_rule: str) -> DataFrame:
    """path, hash, key, last, first, uses: one row per file and key, and one without a key for a file without any."""
    return file_states(files, localized_rule, keep=("path", "hash"))


def _table(spark: SparkSession, version: versions.Version, name: str) -> DataFrame:
    return spark.read.parquet(version.path(name))
