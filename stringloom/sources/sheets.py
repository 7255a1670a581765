"""Translation sheets: rows, cells, language columns, existing catalogs.

A sheet is a row (path, content). Blank lines do not count, and rows are numbered from 1 among the
others. Numbering, splitting and header lookup happen inside the row of the sheet, so they need no
shuffle. A sheet too large for one row is read with ``read_sheet_lines`` instead.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.fields import first_field, has_language_codes, split_fields
from ..functions.text import TRIM_CHARS, is_blank, make_key, preview_cell, utrim
from ..operators.skew import HOT_ROWS, count_keys, hot_keys, running_sum, spread_join
from .files import decode_text

# A line break outside quotes, and what stands up to the next one; a quote left open reaches to the end.
_RECORD = r'\n((?:[^"\n]++|"[^"]*+(?:"|\z))*+)'
# Lines of a split that are numbered together, as a power of two.
BLOCK_BITS = 16
# Lines of a row with quoted line breaks. More of them say that a quote was left open.
RECORD_LINES = 1_000


def effective_data_start(header_row: int, data_start: int) -> int:
    """Data follows the header."""
    return data_start if data_start > header_row else header_row + 1


def sheet_rows(files: DataFrame, blank: str = "trim", quoted_breaks: bool = False) -> DataFrame:
    """path, row_no, line. ``blank="empty"`` drops only lines without any character; ``quoted_breaks``
    keeps line breaks inside quotes in their row."""
    return files.select("path", F.posexplode(sheet_lines(blank, quoted_breaks)).alias("_pos", "line")).select(
        "path", (F.col("_pos") + 1).alias("row_no"), "line"
    )


def read_sheet_lines(
    spark: SparkSession, path: str, blank: str = "trim", quoted_breaks: bool = False, by: str = "file",
    record_lines: int = RECORD_LINES,
) -> DataFrame:
    """The rows of sheets of any size: path, row_no, line, numbered as ``sheet_rows`` does.

    The text source splits a large file over tasks. Rows are counted per split, the counts give each
    split its offset, and rows are numbered inside their split. With ``by="folder"`` the part files of a
    folder, in name order, are one sheet, named by the folder. With ``by="name"`` very many small sheets share a
    few files, as ``writers.write_named_sheets`` leaves them: each line begins with its sheet's name and a tab.

    With ``quoted_breaks`` a line break inside quotes belongs to its row; ``sheet_rows`` has the same
    option. A sheet where a row would have more than ``record_lines`` lines has a quote left open: it is
    read line by line, and ``open_quotes`` lists it.
    """
    lines = _split_lines(spark, path, by)
    if not quoted_breaks:
        return _number_lines(lines.where(_counts(blank, F.col("line"))))
    records = _records(lines, blank)
    open_sheets = _too_long(records, record_lines)
    closed = _join_records(records.join(open_sheets, "path", "left_anti"))
    plain = lines.join(open_sheets, "path", "left_semi").where(_counts(blank, F.col("line")))
    return closed.unionByName(_number_lines(plain))


def open_quotes(
    spark: SparkSession, path: str, blank: str = "trim", by: str = "file", record_lines: int = RECORD_LINES
) -> DataFrame:
    """Sheets that ``read_sheet_lines(quoted_breaks=True)`` reads line by line: path and problem."""
    found = _too_long(_records(_split_lines(spark, path, by), blank), record_lines)
    return found.withColumn("problem", F.lit("a quote is left open"))


def _split_lines(spark: SparkSession, path: str, by: str) -> DataFrame:
    """path, _split, _seq, line: lines with the split that they begin in and their place in it."""
    if by not in ("file", "folder", "name"):
        raise ValueError(f"unknown sheet: {by}")
    file, raw = F.col("_metadata.file_path"), F.col("value").cast("binary")
    last = F.substring_index(file, "/", -1)
    name = F.substring_index("value", "\t", 1)
    # What the path of a sheet says already is not carried along with every line.
    sheet, part = {
        "file": (file, F.lit("")), "folder": (F.left(file, F.length(file) - F.length(last) - 1), last), "name": (name, file)}[by]
    if by == "name":
        raw = F.substring(raw, F.octet_length(name) + 2, F.octet_length(raw))
    # Longer names of parts come later, so that part 100000 follows part 99999.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        sheet.alias("path"), part.alias("_part"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"), decode_text(raw).alias("line"))
    # A block of a split, so that the lines that are sorted together do not grow with the split.
    split = F.struct(
        F.length("_part").alias("length"), F.col("_part").alias("file"), F.col("_start").alias("start"),
        F.shiftright("_seq", BLOCK_BITS).alias("block"))
    return lines.select("path", split.alias("_split"), "_seq", "line")


def _number_lines(lines: DataFrame) -> DataFrame:
    return running_sum(lines, ["path"], F.col("_split"), "_seq", F.lit(1), "row_no").select(
        "path", F.col("row_no").cast("int").alias("row_no"), "line"
    )


def _records(lines: DataFrame, blank: str) -> DataFrame:
    """path, _split, _seq, line, row_no, _open: every line with the number of its row.

    Whether a line begins inside quotes depends on all before it. Each split says how many quotes it has
    and, for both states that it may begin in, how many rows begin in it; running over the splits, that
    gives every split its state and its offset. ``_open`` says that the row goes on or went on.
    """
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    inside = Window.partitionBy("path", "_split").orderBy("_seq")
    local = lines.withColumn("_odd", F.pmod(quotes, F.lit(2))).withColumn(
        "_local", F.pmod(F.coalesce(F.sum("_odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(2)))
    counts = _counts(blank, F.col("line"))
    splits = local.groupBy("path", "_split").agg(
        F.sum("_odd").alias("_flips"), F.count_if(counts & (F.col("_local") == 0)).alias("_rows0"),
        F.count_if(counts & (F.col("_local") == 1)).alias("_rows1"))
    before = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_state", F.pmod(F.coalesce(F.sum("_flips").over(before), F.lit(0)), F.lit(2)))
    begun = F.when(F.col("_state") == 0, F.col("_rows0")).otherwise(F.col("_rows1"))
    splits = splits.withColumn("_offset", F.coalesce(F.sum(begun).over(before), F.lit(0))).select(
        "path", "_split", "_state", "_offset")
    # Two states that differ are inside quotes; a line that is not blank begins a row outside.
    placed = local.join(splits, ["path", "_split"]).withColumn("_within", F.col("_local") != F.col("_state"))
    starts = (~F.col("_within") & counts).cast("int")
    row = F.col("_offset") + F.sum(starts).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = placed.withColumn("row_no", row.cast("int")).where(F.col("_within") | counts)
    return numbered.select(
        "path", "_split", "_seq", "line", "row_no", (F.col("_within") | (F.col("_odd") == 1)).alias("_open"))


def _too_long(records: DataFrame, record_lines: int) -> DataFrame:
    """path of the sheets that have a row of too many lines."""
    return records.where("_open").groupBy("path", "row_no").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > record_lines).select("path").distinct()


def _join_records(records: DataFrame) -> DataFrame:
    """path, row_no, line; only rows of several lines, of a bounded number each, are shuffled."""
    parts = F.array_sort(F.collect_list(F.struct("_split", "_seq", "line")))
    several = records.where("_open").groupBy("path", "row_no").agg(
        F.array_join(F.transform(parts, lambda part: part["line"]), "\n").alias("line"))
    return records.where(~F.col("_open")).select("path", "row_no", "line").unionByName(several)


def sheet_cells(rows: DataFrame, dialect: str = "escaped") -> DataFrame:
    """path, row_no, col_no (from 0), value."""
    return rows.select(
        "path", "row_no", F.posexplode(split_fields(F.col("line"), dialect)).alias("col_no", "value")
    )


def lang_columns(files: DataFrame, header_row: int = 2) -> DataFrame:
    """path, col_no, lang: the non-empty header cells after the first."""
    return files.select("path", F.inline(language_slots(header_fields(header_row)))).select(
        "path", "col_no", F.col("code").alias("lang")
    )


def sheet_problems(files: DataFrame, header_row: int = 2) -> DataFrame:
    """Sheets that cannot be generated from, with the reason. Generation leaves them out."""
    rows = F.size(sheet_lines())
    reason = F.when(rows < header_row, F.lit("fewer rows than the header row")).when(
        F.size(language_slots(header_fields(header_row))) == 0, F.lit("no language columns")
    )
    return files.select("path", F.explode(F.array_compact(F.array(reason))).alias("problem"))


def valid_header_rows(rows: DataFrame, dialect: str = "escaped") -> DataFrame:
    """Rows that could be the header: some field after the first looks like a language code."""
    return rows.where(has_language_codes(split_fields(F.col("line"), dialect))).select("path", "row_no")


def row_range(rows: DataFrame, first: int, last: int | None = None) -> DataFrame:
    kept = F.col("row_no") >= first
    return rows.where(kept if last is None else kept & (F.col("row_no") <= last))


def preview_sheet(files: DataFrame, rows: int = 5, columns: int = 5, dialect: str = "escaped") -> DataFrame:
    """The first rows and columns, short cells padded with ''."""
    head = files.select("path", F.posexplode(F.slice(sheet_lines(), 1, rows)).alias("_pos", "line"))
    fields = head.select(
        "path", (F.col("_pos") + 1).alias("row_no"), split_fields(F.col("line"), dialect).alias("_f")
    )
    return fields.select("path", "row_no", *[
        preview_cell(F.coalesce(F.get("_f", F.lit(i)), F.lit(""))).alias(f"c{i + 1}")
        for i in range(columns)
    ])


def sheet_keys(rows: DataFrame, data_start: int = 4) -> DataFrame:
    """Data rows with a key. A row with a blank key is dropped but keeps its number."""
    raw = utrim(F.get(split_fields(F.col("line")), F.lit(0)))
    keyed = row_range(rows, data_start).select(
        "path", "row_no", F.explode(F.filter(F.array(raw), lambda key: key != "")).alias("raw_key")
    )
    return keyed.withColumn("key", make_key("raw_key"))


def read_catalog(files: DataFrame, quoted_breaks: bool = False) -> DataFrame:
    """Existing catalogs: path, key, english, translations, ord; the last row of a key wins.

    Readable keys come back in the form that merges join on.

    Three header rows (codes in the second), data from the fourth; fewer than four rows is no
    catalog. A catalog without language codes raises an error instead of passing for an empty one.
    """
    lines = files.select("path", sheet_lines(quoted_breaks=quoted_breaks).alias("_lines"))
    is_catalog = F.size("_lines") >= 4
    codes = F.when(is_catalog, _catalog_codes(F.get("_lines", F.lit(1)))).otherwise(F.array().cast("array<string>"))
    rows = lines.withColumn("_codes", codes).select(
        "path", "_codes", F.posexplode(F.when(is_catalog, F.slice("_lines", 4, F.size("_lines")))).alias("ord", "line"))
    return _catalog_rows(rows)


def read_catalog_lines(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``read_catalog`` for line tables (path, row_no, line), for catalogs of any size.

    Only lines are grouped and shuffled; a line gets its texts of all languages when it is known to be its key's last.
    """
    header = rows.where(F.col("row_no") == 2).select("path", _catalog_codes(F.col("line")).alias("_codes"))
    data = rows.where(F.col("row_no") >= 4).select("path", (F.col("row_no") - 4).alias("ord"), "line")
    hot = hot_keys(count_keys(data, ["path"]), ["path"], hot_rows)
    last = _last_of_key(data.withColumn("key", make_key(utrim(first_field(F.col("line"))))), "line")
    return spread_join(last, header, ["path"], ["key"], hot).select("path", "key", *_catalog_texts(), "ord")


def _last_of_key(rows: DataFrame, value: str) -> DataFrame:
    """path, key, the value of the last row of the key, ord of its first."""
    return rows.groupBy("path", "key").agg(F.max_by(value, "ord").alias(value), F.min("ord").alias("ord"))


def _catalog_codes(line: Column) -> Column:
    """Codes of the languages after the English column; a catalog without any is an error."""
    raw = F.filter(F.split(line, ","), lambda c: ~is_blank(c))
    return F.when(F.size(raw) > 0, F.transform(F.slice(raw, 2, F.size(raw)), utrim)).otherwise(
        F.raise_error(F.concat(F.lit("no language codes in catalog "), F.col("path"))))


def _catalog_rows(rows: DataFrame) -> DataFrame:
    """path, key, english, translations, ord of rows (path, _codes, ord, line)."""
    last = _last_of_key(
        rows.select("path", "ord", make_key(utrim(first_field(F.col("line")))).alias("key"), F.struct("_codes", "line").alias("_last")),
        "_last")
    return last.select("path", "key", "_last.*", "ord").select("path", "key", *_catalog_texts(), "ord")


def _catalog_texts() -> list[Column]:
    """english and translations of a row with ``_codes`` and ``line``."""
    # Inside the function of an array of one the fields are split once, however often they are used.
    split = F.array(F.struct(
        split_fields(F.col("line")).alias("v"), (F.size(F.array_distinct("_codes")) < F.size("_codes")).alias("repeated")))

    def texts(row):
        entries = F.filter(
            F.transform("_codes", lambda c, i: F.struct(c.alias("lang"), utrim(F.get(row["v"], i + 2)).alias("text"))),
            lambda e: e["text"].isNotNull())
        last = lambda entries: F.filter(entries, lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda later: later["lang"] == e["lang"]))
        chosen = F.when(row["repeated"], F.get(F.transform(F.array(entries), last), F.lit(0))).otherwise(entries)
        return F.struct(
            F.coalesce(utrim(F.get(row["v"], F.lit(1))), F.lit("")).alias("english"), F.map_from_entries(chosen).alias("translations"))

    found = F.get(F.transform(split, texts), F.lit(0))
    return [found["english"].alias("english"), found["translations"].alias("translations")]


def sheet_lines(blank: str = "trim", quoted_breaks: bool = False) -> Column:
    content = F.col("content")
    lines = F.split(content, "\n")
    if quoted_breaks:
        records = F.regexp_extract_all(F.concat(F.lit("\n"), content), F.lit(_RECORD), 1)
        breaks = lambda record: F.length(record) - F.length(F.replace(record, F.lit("\n")))
        closed = ~F.exists(records, lambda record: breaks(record) >= RECORD_LINES)
        lines = F.when(content.contains('"') & closed, records).otherwise(lines)
    return F.filter(lines, lambda line: _counts(blank, line))


def _counts(blank: str, line: Column) -> Column:
    if blank not in ("trim", "empty"):
        raise ValueError(f"unknown blank rule: {blank}")
    return line != "" if blank == "empty" else F.trim(line, F.lit(TRIM_CHARS)) != ""


def header_fields(header_row: int, dialect: str = "escaped", blank: str = "trim") -> Column:
    return split_fields(F.coalesce(F.get(sheet_lines(blank), F.lit(header_row - 1)), F.lit("")), dialect)


def language_slots(header: Column) -> Column:
    """Array of (col_no, code) for the non-empty header fields after the first."""
    slots = F.transform(header, lambda code, i: F.struct(i.alias("col_no"), utrim(code).alias("code")))
    return F.filter(slots, lambda s: (s["col_no"] > 0) & (s["code"] != ""))
