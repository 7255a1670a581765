"""Sinks. Large outputs are directories of part files whose name order is the line order."""

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import LANGUAGE_CODES, LANGUAGE_NAMES
from ..functions.text import csv_escape, json_string, readable_key
from ..operators.catalog import FIRST, catalog_cells

CATALOG_ORDER = ("section", *FIRST, "ord")


def render_catalog_csv(
    merged: DataFrame, langs: list[str] = LANGUAGE_CODES, names: list[str] = LANGUAGE_NAMES,
    snake_case_keys: bool = True, newline_escape: bool = False,
) -> DataFrame:
    """Catalog lines with the order columns of ``CATALOG_ORDER``: three header rows, then one row per
    key of a merge result. ``newline_escape`` writes line breaks as ``\\n``, for line-based readers."""
    line = F.array_join(F.transform(catalog_cells(langs, snake_case_keys), csv_escape), ",")
    if newline_escape:
        line = F.replace(line, F.lit("\n"), F.lit("\\n"))
    found = F.when(F.col("status") == "removed", 2).otherwise(1)
    rows = merged.select(found.alias("section"), *FIRST, "ord", line.alias("line"))
    heads = [
        "," + ",".join(str(i) for i in range(1, len(langs) + 1)),
        "," + ",".join(langs),
        ",".join(["Key", *names]),
    ]
    head = merged.sparkSession.createDataFrame(
        [(i - 3, None, None, None, None, text) for i, text in enumerate(heads)], rows.schema
    )
    return head.unionByName(rows)


def render_catalog_json(strings: DataFrame) -> DataFrame:
    """Lines of one JSON object, key -> text, in scan order: section, first_*, line."""
    last = strings.agg(F.max_by("key", F.struct(*FIRST)).alias("key"))  # one row
    marked = strings.join(F.broadcast(last.withColumn("_last", F.lit(True))), "key", "left")
    comma = F.when(F.col("_last"), F.lit("")).otherwise(F.lit(","))
    rows = marked.select(F.lit(1).alias("section"), *FIRST, F.concat(
        F.lit("  "), json_string("key"), F.lit(": "), json_string("value"), comma).alias("line"))
    frame = strings.sparkSession.createDataFrame(
        [(0, None, None, None, "{"), (2, None, None, None, "}")], rows.schema
    )
    return frame.unionByName(rows)


def write_lines(lines: DataFrame, order: tuple[str, ...], path: str, replace: bool = False) -> None:
    """Text files whose lines, part after part, follow ``order``.

    ``replace`` takes the place of what is there, which ``lines`` must not read any more.
    """
    lines.orderBy(*order).select("line").write.mode("overwrite" if replace else "error").text(path)


def write_catalog_csv(merged: DataFrame, path: str, replace: bool = False, **options) -> None:
    write_lines(render_catalog_csv(merged, **options), CATALOG_ORDER, path, replace)


def write_catalog_json(strings: DataFrame, path: str, replace: bool = False) -> None:
    write_lines(render_catalog_json(strings), ("section", *FIRST), path, replace)


def write_bundles(lines: DataFrame, path: str) -> None:
    """One folder per sheet and language. Lines are sorted over all tasks, so a large bundle is
    written by several tasks; its part files in name order make up the bundle."""
    lines.orderBy("sheet", "lang", "section", "pos").select("sheet", "lang", "line").write.partitionBy(
        "sheet", "lang"
    ).text(path)


def write_report(header: DataFrame, blocks: DataFrame, path: str) -> None:
    """Missing-translation reports, one folder per sheet; nothing for a sheet without gaps."""
    head = header.select("sheet", F.lit(-1).alias("first_row"), F.lit("").alias("key"), "text")
    blocks.unionByName(head).orderBy("sheet", "first_row", "key").select("sheet", "text").write.partitionBy(
        "sheet"
    ).text(path)


def write_sheets(lines: DataFrame, path: str) -> None:
    """Sheet lines (sheet, row_no, line), one folder per sheet."""
    lines.orderBy("sheet", "row_no").select("sheet", "line").write.partitionBy("sheet").text(path)


def write_named_sheets(files: DataFrame, path: str) -> None:
    """Very many small sheets (path, content) in a few files, one per task: each line with its sheet's name and a tab
    before it. ``read_sheet_lines(by="name")`` reads them."""
    name = F.when(F.col("path").rlike("[\t\n]"), F.raise_error(F.concat(F.lit("a tab or line break in the name "), "path")))
    name = name.otherwise(F.coalesce("path", F.lit("")))
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("line"))
    lines.select(F.concat(name, F.lit("\t"), "line").alias("line")).write.text(path)


def write_rewritten(files: DataFrame, path: str) -> None:
    """Rewritten sources as a table (path, content, planned, applied); inputs are never overwritten."""
    files.write.parquet(path)


def json_lines(strings: DataFrame, path: str, readable: bool = False) -> None:
    """Catalog as JSON Lines."""
    key = readable_key("key") if readable else F.col("key")
    strings.select(key.alias("key"), "value").write.json(path)
