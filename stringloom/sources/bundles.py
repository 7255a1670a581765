"""Localization bundles as rows (path, ord, key, value)."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.text import WS, utrim

_SUFFIX = {"arb": ".arb", "json": ".json", "getx": ".dart"}
_ENTRY = rf"'([^']+)':[{WS}]*'([^']*)'"


def load_json(files: DataFrame) -> DataFrame:
    """Entries of JSON objects. A file that is not a JSON object has no entries."""
    entries = F.from_json("content", "map<string,string>")
    return files.select("path", F.posexplode(entries).alias("ord", "key", "value")).withColumn(
        "value", F.coalesce("value", F.lit("null"))
    )


def load_arb(files: DataFrame) -> DataFrame:
    """Entries of ARB files without metadata (keys that start ``@@``)."""
    return load_json(files).where(~F.col("key").startswith("@@"))


def load_getx(files: DataFrame) -> DataFrame:
    """``'key': 'value'`` entries of Dart map files."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("content", F.lit(_ENTRY), 1).alias("key"),
        F.regexp_extract_all("content", F.lit(_ENTRY), 2).alias("value"),
    )
    return files.select("path", F.posexplode(pairs).alias("ord", "_p")).select(
        "path", "ord", "_p.key", "_p.value"
    )


def load_format(files: DataFrame, fmt: str) -> DataFrame:
    """Entries of the files that carry the suffix of a format."""
    loaders = {"arb": load_arb, "json": load_json, "getx": load_getx}
    return loaders[fmt](files.where(F.col("path").endswith(_SUFFIX[fmt])))


def bundle_problems(files: DataFrame) -> DataFrame:
    """Bundles that give no entries, with the reason: path, problem. Loading leaves them out."""
    path, content = F.col("path"), F.col("content")
    json = path.endswith(_SUFFIX["arb"]) | path.endswith(_SUFFIX["json"])
    entries = F.from_json("content", "map<string,string>")
    problem = (
        F.when(content.isNull() | (utrim("content") == ""), F.lit("empty"))
        .when(json & entries.isNull(), F.lit("not a JSON object"))
        .when(path.endswith(_SUFFIX["getx"]) & (F.regexp_count("content", F.lit(_ENTRY)) == 0), F.lit("no entries"))
    )
    known = json | path.endswith(_SUFFIX["getx"])
    return files.where(known).select("path", F.explode(F.array_compact(F.array(problem))).alias("problem"))


def load_bundles(files: DataFrame, formats: tuple[str, ...] = ("arb", "json", "getx")) -> DataFrame:
    """One row per key over all files: last value, first position (path and place in the file)."""
    entries = reduce(DataFrame.unionByName, [load_format(files, f) for f in formats])
    place = F.struct("path", "ord")
    return entries.groupBy("key").agg(
        F.max_by("value", place).alias("value"), F.min(place).alias("_first")
    ).select("key", "value", F.col("_first.path").alias("path"), F.col("_first.ord").alias("ord"))
