"""The four end-to-end flows: extract, generate, replace, translate.

Each flow stages what several outputs read, then writes its outputs below ``out``. Nothing passes
through the driver.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fixed_values import FREE_QUOTA_CHARS, LANGUAGE_CODES, LANGUAGE_NAMES
from ..operators import bundles, catalog, extract, ledger as ledgers, quality, rewrite, translate, translations
from ..sinks import versions, writers
from ..sources import sheets
from .staging import owned_tables, stage


@dataclass
class Generated:
    """What generation reports per sheet; the long table and its reductions are staged tables."""

    entries: DataFrame
    keys: DataFrame
    missing: DataFrame
    duplicates: DataFrame
    stats: DataFrame
    active: DataFrame


def extract_strings(files: DataFrame, skip_dirs: bool = False, localized_rule: str = "line") -> DataFrame:
    """Source files to unique strings."""
    scanned = extract.scan_files(files, skip_dirs=skip_dirs)
    return extract.unique_strings(extract.occurrences(scanned, localized_rule=localized_rule))


def export_catalog(
    files: DataFrame, stored: DataFrame | None, out: str, mode: str = "merge", version: str = "v2",
    langs: list[str] = LANGUAGE_CODES, names: list[str] = LANGUAGE_NAMES, snake_case_keys: bool = True,
) -> DataFrame:
    """Extract, merge with the stored catalog and write it as ``export_strings`` does."""
    return export_strings(extract_strings(files), stored, out, mode, version, langs, names, snake_case_keys)


def export_strings(
    strings: DataFrame, stored: DataFrame | None, out: str, mode: str = "merge", version: str = "v2",
    langs: list[str] = LANGUAGE_CODES, names: list[str] = LANGUAGE_NAMES, snake_case_keys: bool = True,
) -> DataFrame:
    """Merge unique strings (of a scan, or of a stream's store) with the stored catalog and make the result
    the current version of the target folder, as ``csv``, ``json`` and ``merged`` (a table).

    ``merge`` takes its stored side from the current version if ``stored`` is not given. The former version
    stays readable until the new one is complete, and stays current if the run ends before. Stored
    languages that ``langs`` lacks become further columns, named by their codes. Returns the counts.
    """
    spark = strings.sparkSession
    with owned_tables(spark):
        strings = stage(strings, "strings")
        if stored is None and mode == "merge":
            stored = read_version(spark, out)
        merged, target = catalog.resolve_mode(strings, stored, mode, out, version)
        draft = versions.begin(spark, target)
        draft.write_table("merged", merged)
        merged = spark.read.schema(merged.schema).parquet(draft.path("merged"))
        extra = catalog.extra_languages(merged, langs)
        langs, names = [*langs, *extra], [*names, *extra]
        writers.write_catalog_csv(merged, draft.path("csv"), langs=langs, names=names, snake_case_keys=snake_case_keys)
        draft.add("csv", draft.datasets["merged"]["rows"])
        writers.write_catalog_json(strings, draft.path("json"))
        draft.add("json", strings.count())
        draft.commit()
    return catalog.merge_stats(merged)


def read_version(spark: SparkSession, target: str) -> DataFrame | None:
    """The catalog (key, english, translations, ord) in the CSV of a target's current version, if it has one."""
    version = versions.current(spark, target)
    if version is None:
        return None
    rows = sheets.read_sheet_lines(spark, version.path("csv"), quoted_breaks=True, by="folder")
    return sheets.read_catalog_lines(stage(rows, "lines")).drop("path")


def generate(long: DataFrame, fmt: str) -> Generated:
    """Bundles and reports of a long table. The long table is read twice: by key and by text."""
    keys = stage(quality.key_table(long), "keys")
    values = stage(translations.last_value_per_key(long), "values")
    return Generated(
        entries=bundles.bundle_entries(values, fmt), keys=keys, missing=quality.missing_by_key(keys),
        duplicates=quality.duplicate_keys(keys), stats=quality.generation_stats(keys, fmt),
        active=values.groupBy("sheet", "lang").agg(F.min("ord").alias("ord")),
    )


def generate_bundles(
    files: DataFrame, out: str, fmt: str, generated_at: str, header_row: int = 2, data_start: int = 4
) -> Generated:
    """Sheets to bundles, language index and missing report below ``out``."""
    return _write_generated(translations.unpivot_sheet(files, header_row, data_start), out, fmt, generated_at)


def generate_from_lines(
    rows: DataFrame, out: str, fmt: str, generated_at: str, header_row: int = 2, data_start: int = 4
) -> Generated:
    """``generate_bundles`` for the lines of sheets of any size, as ``read_sheet_lines`` gives them."""
    rows = stage(rows, "lines")
    return _write_generated(translations.unpivot_lines(rows, header_row, data_start), out, fmt, generated_at)


def _write_generated(long: DataFrame, out: str, fmt: str, generated_at: str) -> Generated:
    result = generate(stage(long, "long"), fmt)
    writers.write_bundles(bundles.render_bundle(result.entries, fmt), f"{out}/bundles")
    if fmt == "getx":
        bundles.locale_manifest(result.active).write.parquet(f"{out}/locales")
    writers.write_report(
        quality.report_header(result.stats, fmt, generated_at),
        quality.missing_report(result.missing, fmt), f"{out}/report",
    )
    return result


def plan_rewrite(files: DataFrame, entries: DataFrame, fmt: str) -> tuple[DataFrame, DataFrame]:
    """Replacement plan and missed strings of the files that may be rewritten."""
    found = stage(rewrite.rewritable(extract.occurrences(extract.scan_files(files))), "occurrences")
    matched = stage(rewrite.match_keys(found, entries), "matched")
    return rewrite.plan_replacements(matched, fmt), rewrite.missed_strings(matched)


def apply_rewrite(
    files: DataFrame, plan: DataFrame, out: str, by: str = "line", skips: DataFrame | None = None
) -> DataFrame:
    """Write the rewritten files as a new table; returns planned and applied counts per file.

    ``by="content"`` can leave out what a reviewer named by (path, batch, idx).
    """
    if skips is not None:
        plan = rewrite.drop_reviewed(rewrite.review_batches(plan), skips)
    apply = {"line": rewrite.apply_by_line, "content": rewrite.apply_by_content}[by]
    writers.write_rewritten(apply(files, plan), out)
    return files.sparkSession.read.parquet(out).select("path", "planned", "applied")


def translate_rows(
    rows: DataFrame, langs: list[str], memory: DataFrame, translator: Callable | None = None,
    ledger: str | None = None, quota: int = FREE_QUOTA_CHARS,
) -> DataFrame:
    """Rows (sheet, row_no, english, translations) with texts from the memory, then the translator.

    A text that nobody could translate leaves its cell as it was. With a ``ledger`` folder the translator
    stops at the quota, and a run that was ended goes on where it stopped.
    """
    return translate.apply_translations(rows, _fill(rows, langs, memory, translator, ledger, quota))


def translate_sheets(
    files: DataFrame, langs: list[str], memory: DataFrame, translator: Callable | None = None,
    header_row: int = 2, first: int = 4, last: int | None = None, dialect: str = "escaped",
    blank: str = "trim", ledger: str | None = None, quota: int = FREE_QUOTA_CHARS,
) -> DataFrame:
    """Lines (sheet, row_no, line) of the sheets with the data rows of a range translated.

    ``blank`` says which lines do not count, as in ``sheet_rows``; ``ledger`` and ``quota`` as in ``translate_rows``."""
    start = sheets.effective_data_start(header_row, first)
    texts = translate.sheet_texts(sheets.sheet_rows(files, blank), start, last, dialect)
    filled = _fill(texts, langs, memory, translator, ledger, quota)
    return translate.write_back(files, filled, header_row, dialect, blank)


def translate_lines(
    rows: DataFrame, langs: list[str], memory: DataFrame, translator: Callable | None = None,
    header_row: int = 2, first: int = 4, last: int | None = None, dialect: str = "escaped",
    ledger: str | None = None, quota: int = FREE_QUOTA_CHARS,
) -> DataFrame:
    """``translate_sheets`` for the lines of sheets of any size, as ``read_sheet_lines`` gives them."""
    rows = stage(rows, "lines")
    texts = translate.sheet_texts(rows, sheets.effective_data_start(header_row, first), last, dialect)
    return translate.write_back_lines(rows, _fill(texts, langs, memory, translator, ledger, quota), header_row, dialect)


def _fill(
    rows: DataFrame, langs: list[str], memory: DataFrame, translator: Callable | None, ledger: str | None, quota: int,
) -> DataFrame:
    """sheet, row_no, english, lang, text for every row and target language."""
    work = stage(translate.translation_work(rows.select("sheet", "row_no", "english"), langs), "work")
    known = stage(translate.translate_tm(work, memory), "known")
    if translator is None:
        return known
    rest = known.where(F.col("text").isNull()).drop("text")
    if ledger is None:
        texts = translate.translate_texts(rest, translator)
    else:
        texts = ledgers.translate_within_quota(rest, translator, ledger, quota)
    new = translate.attach_texts(rest, stage(texts.select("english", "lang", "text"), "texts"))
    return known.where(F.col("text").isNotNull()).unionByName(new)
