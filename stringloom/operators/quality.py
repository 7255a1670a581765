"""Duplicate keys, missing translations and generation counts.

They all start from ``key_table``, which shrinks the long table to one row per sheet and key. Stage
it (``plans.staging.stage``) when several of them are wanted, so that the long table is read once.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.text import fix_key
from .skew import HOT_ROWS, count_keys, hot_keys, spread_join
from .translations import has_text, language_list


def key_table(long: DataFrame) -> DataFrame:
    """sheet, key, n_rows, first_row, last_row, present (languages with a text, as (ord, lang))."""
    return long.groupBy("sheet", "key").agg(
        F.count_if(F.col("ord") == 1).alias("n_rows"),
        F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"),
        F.collect_set(F.when(has_text(), F.struct("ord", "lang"))).alias("present"),
    )


def duplicate_keys(keys: DataFrame) -> DataFrame:
    """Keys on several rows, and the row whose value is said to be used (the last)."""
    return keys.where(F.col("n_rows") > 1).select("sheet", "key", "n_rows", "first_row", "last_row")


def duplicate_rows(long: DataFrame, keys: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row of every duplicate key, one row each, so no key's rows are gathered in one place."""
    repeated = keys.where(F.col("n_rows") > 1).select("sheet", "key", "n_rows")
    rows = long.where(F.col("ord") == 1).select("sheet", "key", "row_no")
    hot = hot_keys(repeated, ["sheet", "key"], hot_rows)
    return spread_join(rows, repeated.drop("n_rows"), ["sheet", "key"], ["row_no"], hot, "left_semi")


def duplicate_lines(rows: DataFrame, block: int = 1000) -> DataFrame:
    """Row numbers of ``duplicate_rows`` as text, in blocks of ``block`` sheet rows."""
    return rows.groupBy("sheet", "key", F.floor(F.col("row_no") / block).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("row_no")), ", ").alias("rows")
    )


def active_table(keys: DataFrame) -> DataFrame:
    """One row per sheet: its active languages. At most one entry per language column."""
    pairs = keys.select("sheet", F.explode("present").alias("_p"))
    return pairs.groupBy("sheet").agg(F.collect_set("_p").alias("active"))


def missing_by_key(
    keys: DataFrame, skip_untranslated: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """sheet, key, first_row, missing: active languages of the sheet without a text for the key.

    ``skip_untranslated`` leaves out keys without a text in any language. A sheet's languages come
    to its keys by a join on the sheet; the keys of a large sheet are split. Keys × languages is
    never built: each key keeps only the difference of two short arrays.
    """
    if skip_untranslated:
        keys = keys.where(F.size("present") > 0)
    hot = hot_keys(count_keys(keys, ["sheet"]), ["sheet"], hot_rows)
    joined = spread_join(keys, active_table(keys), ["sheet"], ["key"], hot)
    # As the input of a generator the difference is worked out once, not again in the join.
    gaps = F.filter(F.array(F.array_except("active", "present")), lambda gap: F.size(gap) > 0)
    return joined.select("sheet", "key", "first_row", F.explode(gaps).alias("missing"))


def missing_pairs(missing: DataFrame) -> DataFrame:
    return missing.select("sheet", "key", F.explode("missing").alias("_p")).select(
        "sheet", "key", "_p.lang", "_p.ord"
    )


def generation_stats(keys: DataFrame, fmt: str) -> DataFrame:
    """Counts of one generation run per sheet. Total rows count duplicates, unique keys do not.

    A key misses a language exactly when it has fewer than the sheet has, so keys are first counted
    by their number of languages; the join to the sheet then has one row per sheet and number.
    """
    by_size = keys.groupBy("sheet", F.size("present").alias("_langs")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("rows"),
        F.count_if(F.col("n_rows") > 1).alias("dups"),
        F.sum(F.when(F.col("key").rlike("^[0-9]"), F.col("n_rows")).otherwise(0)).alias("fixed"),
    )
    active = keys.select("sheet", F.explode("present").alias("_p")).groupBy("sheet").agg(
        F.count_distinct("_p.lang").alias("_active")
    )
    joined = by_size.join(active, "sheet", "left").withColumn("_active", F.coalesce("_active", F.lit(0)))
    index_file = 1 if fmt == "getx" else 0
    return joined.groupBy("sheet").agg(
        (F.max("_active") + index_file).alias("files_created"),
        F.sum("rows").alias("total_rows"), F.sum("n").alias("unique_keys"),
        F.sum(F.when(F.col("_langs") < F.col("_active"), F.col("n")).otherwise(0)).alias("missing_keys"),
        F.sum("dups").alias("duplicate_keys"), F.sum("fixed").alias("fixed_keys"),
    )


def missing_report(missing: DataFrame, fmt: str) -> DataFrame:
    """Report blocks in key order: sheet, first_row, key, text."""
    shown = fix_key("key") if fmt == "arb" else F.col("key")
    return missing.select("sheet", "first_row", "key", F.concat(
        F.lit("["), shown, F.lit("]\n  Missing in: "), language_list(F.col("missing")), F.lit("\n")
    ).alias("text"))


def report_header(stats: DataFrame, fmt: str, generated: str) -> DataFrame:
    """Head of a sheet's report, for sheets with something missing: sheet, text."""
    name = {"arb": "ARB", "getx": "GetX", "json": "JSON"}[fmt]
    bar = "━" * 50
    return stats.where(F.col("missing_keys") > 0).select("sheet", F.concat(
        F.lit(f"📊 {name} Generation Report\nGenerated: {generated}\nTotal keys: "),
        F.col("total_rows").cast("string"), F.lit(f"\n{name} files created: "),
        F.col("files_created").cast("string"), F.lit("\nKeys with missing translations: "),
        F.col("missing_keys").cast("string"),
        F.lit(f"\n\n{bar}\nMissing Translations (by key):\n{bar}\n"),
    ).alias("text"))
