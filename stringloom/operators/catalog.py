"""The string catalog: merge of new strings with stored translations, and its summaries.

Strings come from ``extract.unique_strings`` (key, value, first_path, first_pattern, first_match);
a catalog is (key, english, translations, ord). Both hold one row per key, so every join here is
one to one and no key can be hot.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import CATALOG_SKIP_FOLDERS
from ..functions.text import TRIM_CHARS, readable_key

_NO_TEXTS = "map<string,string>"
FIRST = ("first_path", "first_pattern", "first_match")


def smart_merge(strings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Scan result merged with the stored catalog; nothing stored is lost.

    A key in both keeps its stored English (unless that is empty) and its translations; ``updated``
    means the scanned text differs from the stored one, and both are given. Keys no longer found are
    ``removed`` and kept. Row order: scanned keys by first occurrence, then removed keys by ``ord``.
    """
    new = strings.select("key", F.col("value").alias("new_english"), *FIRST, F.lit(True).alias("_new"))
    old = catalog.select(
        "key", F.col("english").alias("old_english"), "translations", "ord", F.lit(True).alias("_old")
    )
    joined = new.join(old, "key", "full_outer")
    status = (
        F.when(F.col("_old").isNull(), F.lit("new"))
        .when(F.col("_new").isNull(), F.lit("removed"))
        .when(F.col("old_english") != F.col("new_english"), F.lit("updated"))
        .otherwise(F.lit("preserved"))
    )
    stored = F.when(F.col("old_english") != "", F.col("old_english"))
    return joined.select(
        "key", F.coalesce(stored, "new_english", "old_english").alias("english"),
        F.coalesce("translations", F.create_map().cast(_NO_TEXTS)).alias("translations"),
        status.alias("status"), "old_english", "new_english", *FIRST, "ord",
    )


def start_fresh(strings: DataFrame) -> DataFrame:
    """A merge result without a stored catalog: every key is new."""
    return strings.select(
        "key", F.col("value").alias("english"), F.create_map().cast(_NO_TEXTS).alias("translations"),
        F.lit("new").alias("status"), F.lit(None).cast("string").alias("old_english"),
        F.col("value").alias("new_english"), *FIRST, F.lit(None).cast("int").alias("ord"),
    )


def resolve_mode(
    strings: DataFrame, catalog: DataFrame | None, mode: str, path: str, version: str = "v2"
) -> tuple[DataFrame, str]:
    """Rows to write and where: ``merge`` and ``overwrite`` keep the path, ``version`` adds a suffix.

    Only ``merge`` reads the stored catalog.
    """
    if mode == "merge":
        return (start_fresh(strings) if catalog is None else smart_merge(strings, catalog)), path
    if mode == "version":
        return start_fresh(strings), f"{path}_{version.strip() or 'v2'}"
    if mode == "overwrite":
        return start_fresh(strings), path
    raise ValueError(f"unknown mode: {mode}")


def extra_languages(merged: DataFrame, langs: list[str]) -> list[str]:
    """Codes of a merge result that ``langs`` lacks, in order: columns of its header, so few."""
    others = F.array_except(F.map_keys("translations"), F.array(*[F.lit(lang) for lang in langs]).cast("array<string>"))
    codes = merged.select(F.explode(others).alias("lang")).distinct()
    return [r["lang"] for r in codes.orderBy("lang").collect()]


def merge_stats(merged: DataFrame) -> DataFrame:
    """Counts of a merge; removed rows are kept and count as preserved."""
    status = F.col("status")
    return merged.agg(
        F.count_if(status == "new").alias("new_strings"),
        F.count_if(status == "updated").alias("updated_strings"),
        F.count_if(status.isin("preserved", "removed")).alias("preserved_strings"),
        F.count(F.lit(1)).alias("total_strings"),
    )


def removed_strings(strings: DataFrame, catalog: DataFrame) -> DataFrame:
    return catalog.join(strings.select("key"), "key", "left_anti")


def catalog_cells(langs: list[str], snake_case_keys: bool = True) -> Column:
    """Cells of a catalog row: key, English, then the other languages ('' where missing)."""
    key = F.col("key") if snake_case_keys else readable_key("key")
    others = F.array(*[F.lit(lang) for lang in langs[1:]])
    # Blank texts leave the map first (once, inside an array of one): each language is looked for in what is left.
    filled = F.array(F.map_filter("translations", lambda _, text: text != ""))
    texts = F.transform(filled, lambda some: F.transform(
        others, lambda lang: F.coalesce(F.try_element_at(some, lang), F.lit(""))))
    return F.concat(F.array(key, F.col("english")), F.get(texts, F.lit(0)))


def catalog_summary(files: DataFrame) -> DataFrame:
    """Folders with string files, newest first: folder, base_name, n_strings, modified.

    ``files`` has path, content and modified. The string count is that of ``<base>.csv`` without its
    three header rows; counting happens inside the file's row.
    """
    parts = F.split("path", "/")
    listed = files.where(
        F.col("path").endswith(".csv") | F.col("path").endswith(".json")
    ).select(
        F.regexp_replace("path", "/?[^/]*$", "").alias("folder_path"),
        F.get(parts, F.size(parts) - 2).alias("folder"), F.get(parts, F.size(parts) - 1).alias("_name"),
        "content", "modified",
    ).where(~F.col("folder").startswith(".") & ~F.col("folder").isin(CATALOG_SKIP_FOLDERS))
    base = F.when(
        F.col("folder").endswith("_strings"), F.replace("folder", F.lit("_strings"), F.lit(""))
    ).otherwise(F.col("folder"))
    lines = F.size(F.filter(F.split("content", "\n"), lambda x: F.trim(x, F.lit(TRIM_CHARS)) != ""))
    count = F.when(F.col("_name") == F.concat("base_name", F.lit(".csv")), F.greatest(lines - 3, F.lit(0)))
    return (
        listed.withColumn("base_name", base)
        .groupBy("folder_path", "folder", "base_name")
        .agg(F.coalesce(F.max(count), F.lit(0)).alias("n_strings"), F.max("modified").alias("modified"))
        .orderBy(F.col("modified").desc(), "folder_path")
    )
