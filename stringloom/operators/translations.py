"""The long translation table and what is computed from it.

Long table: sheet, row_no, raw_key, key, ord, lang, value — one row per sheet row and language
column, blank values included; ``ord`` numbers the languages of a sheet from 1.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import split_fields
from ..functions.fixed_values import LANGUAGE_CODES
from ..functions.text import make_key, utrim
from ..sources.sheets import effective_data_start, header_fields, language_slots, sheet_lines
from .skew import HOT_ROWS, count_keys, hot_keys, spread_join

def has_text() -> Column:
    return F.col("value") != ""


def unpivot_sheet(files: DataFrame, header_row: int = 2, data_start: int = 4) -> DataFrame:
    """Long table of sheets that each fit one row.

    The header is looked up in the sheet's own row and carried along, so there is neither a join nor
    a shuffle.
    """
    start = effective_data_start(header_row, data_start)
    sheets = files.select(
        F.col("path").alias("sheet"), sheet_lines().alias("_lines"),
        language_slots(header_fields(header_row)).alias("_slots"),
    )
    data = F.slice("_lines", start, F.size("_lines"))
    rows = sheets.select("sheet", "_slots", F.posexplode(data).alias("_pos", "line")).withColumn(
        "row_no", F.col("_pos") + start
    )
    return _unpivot(rows)


def unpivot_lines(
    rows: DataFrame, header_row: int = 2, data_start: int = 4, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Long table of line tables (path, row_no, line), for sheets of any size.

    The header reaches the rows by a join on the sheet; the rows of a large sheet are split.
    """
    start = effective_data_start(header_row, data_start)
    rows = rows.withColumnRenamed("path", "sheet")
    header = rows.where(F.col("row_no") == header_row).select(
        "sheet", language_slots(split_fields(F.col("line"))).alias("_slots")
    )
    data = rows.where(F.col("row_no") >= start)
    hot = hot_keys(count_keys(data, ["sheet"]), ["sheet"], hot_rows)
    return _unpivot(spread_join(data, header, ["sheet"], ["row_no"], hot))


def _unpivot(rows: DataFrame) -> DataFrame:
    codes = F.array_distinct(F.transform("_slots", lambda s: s["code"]))
    cells = rows.withColumn("_cells", split_fields(F.col("line"))).withColumn(
        "raw_key", utrim(F.get("_cells", F.lit(0)))
    )
    per_slot = F.transform("_slots", lambda s, i: F.struct(
        (i + 1).alias("ord"), s["code"].alias("lang"),
        F.coalesce(utrim(F.get("_cells", s["col_no"])), F.lit("")).alias("value"),
    ))
    # A code that heads two columns is one language: its last filled cell counts.
    per_code = F.transform(codes, lambda code, i: F.struct(
        (i + 1).alias("ord"), code.alias("lang"),
        F.coalesce(
            F.get(F.reverse(F.filter(per_slot, lambda p: (p["lang"] == code) & (p["value"] != ""))), F.lit(0))["value"],
            F.lit(""),
        ).alias("value"),
    ))
    # A filter on the key would split the line a second time; no values for a blank key does the same.
    values = F.when(F.col("raw_key") != "", F.when(F.size(codes) == F.size("_slots"), per_slot).otherwise(per_code))
    return cells.select("sheet", "row_no", "raw_key", make_key("raw_key").alias("key"), F.inline(values))


def last_value_per_key(long: DataFrame) -> DataFrame:
    """One row per sheet, language and key that has a text: the last non-blank one wins.

    ``first_row``/``last_row`` span all rows of the key, ``first_filled`` those with a text in the
    language, ``used_row`` is where the text came from.
    """
    filled_row = F.when(has_text(), F.col("row_no"))
    return long.groupBy("sheet", "lang", "key").agg(
        F.min("ord").alias("ord"),
        F.max_by("value", filled_row).alias("value"),
        F.max(filled_row).alias("used_row"), F.min(filled_row).alias("first_filled"),
        F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"),
    ).where(F.col("value").isNotNull())


def active_langs(long: DataFrame) -> DataFrame:
    """Languages of a sheet with at least one text."""
    return long.where(has_text()).groupBy("sheet", "lang").agg(F.min("ord").alias("ord"))


def keys_per_language(long: DataFrame) -> DataFrame:
    """Number of keys with a text, for every language column, 0 included."""
    return long.groupBy("sheet", "lang").agg(
        F.min("ord").alias("ord"), F.count_distinct(F.when(has_text(), F.col("key"))).alias("n_keys")
    )


def pivot_catalog(values: DataFrame, langs: list[str] = LANGUAGE_CODES) -> DataFrame:
    """Wide rows (sheet, key, one column per language) of ``last_value_per_key``; '' where missing.

    Only the listed languages are gathered, one text each, so a gathered group has a fixed bound.
    """
    texts = values.where(F.col("lang").isin(langs)).groupBy("sheet", "key").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "value"))).alias("_texts")
    )
    return texts.select("sheet", "key", *[
        F.coalesce(F.try_element_at("_texts", F.lit(lang)), F.lit("")).alias(lang) for lang in langs
    ])


def language_list(pairs: Column, separator: str = ", ") -> Column:
    """Languages of an array of (ord, lang), in column order, as text."""
    return F.array_join(F.transform(F.sort_array(pairs), lambda p: p["lang"]), separator)
