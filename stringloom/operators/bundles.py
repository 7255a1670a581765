"""Bundle entries and their text lines, per sheet and language.

A bundle is a set of lines with explicit order (section, pos, sub). No step gathers the lines of a
language: the last entry, which carries no comma, is found by an aggregate and marked by a join on
the full key.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.text import (
    dart_escape, derive_locale, fix_key, full_locale, json_string,
)


def bundle_entries(values: DataFrame, fmt: str) -> DataFrame:
    """sheet, lang, key, value, pos from ``translations.last_value_per_key``.

    ARB: keys by their first row in the sheet; keys starting with a digit are fixed, and where two
    keys become one, the key met last gives the value and the one met first the place. Others: keys
    by their first row with a text in the language.
    """
    if fmt != "arb":
        return values.select("sheet", "lang", "key", "value", F.col("first_filled").alias("pos"))
    return values.groupBy("sheet", "lang", fix_key("key").alias("key")).agg(
        F.max_by("value", "last_row").alias("value"), F.min("first_row").alias("pos")
    )


def render_bundle(entries: DataFrame, fmt: str) -> DataFrame:
    """Lines of all bundles: sheet, lang, section (0 head, 1 entry, 2 foot), pos, line."""
    last = entries.groupBy("sheet", "lang").agg(
        F.max_by("key", "pos").alias("key"), F.lit(True).alias("_last")
    )
    marked = entries.join(last, ["sheet", "lang", "key"], "left")
    comma = F.when(F.col("_last"), F.lit("")).otherwise(F.lit(","))
    if fmt == "getx":
        text = F.concat(F.lit("  '"), dart_escape("key"), F.lit("': '"), _no_dollar(), F.lit("'"), comma)
    else:
        text = F.concat(F.lit("  "), json_string("key"), F.lit(": "), json_string("value"), comma)
    lines = marked.select("sheet", "lang", F.lit(1).alias("section"), "pos", text.alias("line"))
    heads = {
        "arb": F.concat(F.lit('{\n  "@@locale": '), json_string(derive_locale("lang")), F.lit(",")),
        "getx": F.concat(F.lit("final Map<String, String> "), "lang", F.lit(" = {")),
        "json": F.lit("{"),
    }
    foot = "};" if fmt == "getx" else "}"
    frame = last.select("sheet", "lang", F.inline(F.array(
        F.struct(F.lit(0).alias("section"), F.lit(0).alias("pos"), heads[fmt].alias("line")),
        F.struct(F.lit(2).alias("section"), F.lit(0).alias("pos"), F.lit(foot).alias("line")),
    )))
    return lines.unionByName(frame)


def locale_manifest(active: DataFrame) -> DataFrame:
    """Active language -> full locale, the content of the language index."""
    return active.select("sheet", "ord", "lang", full_locale("lang").alias("locale"))


def _no_dollar():
    return F.replace(dart_escape("value"), F.lit("$"), F.lit("\\$"))
