"""One query per operator, over whole tables. Each takes (spark, sf_dir) and returns a DataFrame."""

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import bundles, catalog, extract, ledger, quality, rewrite, translate, translations
from ..sinks import versions, writers
from ..sources import bundles as bundle_sources, files as file_sources, sheets
from ..streaming import catalog_stream, extract_stream
from . import flows, rescan
from .inputs import BROKEN, code_files, spread, table, view
from .staging import stage, staging_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TARGETS = ["app_fr", "app_ar"]
SHOWN = ["app_en", "app_fr", "app_ar", "app_pt_br", "app_zh_hk"]
AS_OF = "2024-03-01 12:00:00"
QUOTA = 20_000


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def _scanned(spark, sf) -> DataFrame:
    return extract.scan_files(view(spark, sf, "code_files"))


def _found(spark, sf) -> DataFrame:
    return extract.occurrences(_scanned(spark, sf))


def _strings(spark, sf) -> DataFrame:
    return extract.unique_strings(_found(spark, sf))


def _catalog(spark, sf) -> DataFrame:
    stored = view(spark, sf, "catalog")
    return stored.select("key", "ord", "english", F.create_map(F.lit("app_fr"), "app_fr").alias("translations"))


def _long(spark, sf) -> DataFrame:
    return view(spark, sf, "sheet_long").withColumn("key", text.make_key("raw_key"))


def _keys(spark, sf) -> DataFrame:
    return stage(quality.key_table(_long(spark, sf)), "keys")


def _values(spark, sf) -> DataFrame:
    return translations.last_value_per_key(_long(spark, sf))


def _rows(spark, sf) -> DataFrame:
    return sheets.sheet_rows(view(spark, sf, "sheet_files"))


def _matched(spark, sf) -> DataFrame:
    found = stage(rewrite.rewritable(_found(spark, sf)), "occurrences")
    return rewrite.match_keys(found, view(spark, sf, "entries"))


def _english(spark, sf) -> DataFrame:
    return view(spark, sf, "english_rows").select(
        "sheet", "row_no", "english",
        F.create_map(F.lit("app_fr"), "app_fr", F.lit("app_ar"), "app_ar").alias("translations"),
    )


def _work(spark, sf) -> DataFrame:
    return translate.translation_work(_english(spark, sf).drop("translations"), TARGETS)


# --- sources -----------------------------------------------------------------------


@query
def scan_files(spark, sf):
    return _scanned(spark, sf).select("path", F.length("content").alias("n_chars"))


@query
def scan_files_skip_dirs(spark, sf):
    return extract.scan_files(view(spark, sf, "code_files"), skip_dirs=True).select("path")


@query
def decode_text(spark, sf):
    """Parts in Latin-1 and documents in UTF-8, decoded alike."""
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("id"),
        F.encode(F.concat("p_name", F.lit("é")), "ISO-8859-1").alias("data"),
    )
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("id"),
        F.encode(F.concat(F.lit("\ufeff"), "text"), "UTF-8").alias("data"),
    )
    return parts.unionByName(docs).select("id", file_sources.decode_text(F.col("data")).alias("content"))


@query
def sheet_rows(spark, sf):
    return _rows(spark, sf)


@query
def sheet_cells(spark, sf):
    return sheets.sheet_cells(_rows(spark, sf))


@query
def sheet_cells_toggle(spark, sf):
    return sheets.sheet_cells(sheets.sheet_rows(view(spark, sf, "sheet_files"), blank="empty"), "toggle")


@query
def lang_columns(spark, sf):
    return sheets.lang_columns(view(spark, sf, "sheet_files"), header_row=2)


@query
def read_catalog(spark, sf):
    read = sheets.read_catalog(view(spark, sf, "sheet_files"))
    return read.select("path", "key", "english", "ord", *[
        F.try_element_at("translations", F.lit(lang)).alias(lang) for lang in ("app_fr", "app_ar", "app_zh_hk")
    ])


@query
def load_arb(spark, sf):
    return bundle_sources.load_arb(view(spark, sf, "arb_files")).drop("ord")


@query
def load_json(spark, sf):
    return bundle_sources.load_json(view(spark, sf, "json_files"))


@query
def load_getx(spark, sf):
    return bundle_sources.load_getx(view(spark, sf, "getx_files"))


@query
def bundle_problems(spark, sf):
    """Bundles of which some were cut, emptied or replaced by a list."""
    files = view(spark, sf, "arb_files").unionByName(view(spark, sf, "json_files")).unionByName(view(spark, sf, "getx_files"))
    return bundle_sources.bundle_problems(files.selectExpr("path", f"{BROKEN} as content"))


@query
def load_bundles(spark, sf):
    names = ("arb_files", "json_files", "getx_files")
    files = view(spark, sf, names[0])
    for name in names[1:]:
        files = files.unionByName(view(spark, sf, name))
    return bundle_sources.load_bundles(files).select("key", "value", "path")


# --- scalar functions ----------------------------------------------------------------


@query
def make_key(spark, sf):
    docs = spread(table(spark, sf, "documents")).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = table(spark, sf, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    key = text.make_key("text")
    return docs.unionByName(turns).select("kind", "id", key.alias("key"), (key == "").alias("is_empty"))


@query
def readable_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.readable_key(text.make_key("p_name")).alias("readable"))


@query
def derive_locale(spark, sf):
    return view(spark, sf, "locales").select("c_custkey", "lang", text.derive_locale("lang").alias("locale"))


@query
def full_locale(spark, sf):
    return view(spark, sf, "locales").select("c_custkey", "lang", text.full_locale("lang").alias("locale"))


@query
def fix_key(spark, sf):
    key = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("_"), text.make_key("p_name")))
    return table(spark, sf, "part").select(
        "p_partkey", text.fix_key(key.otherwise(text.make_key("p_name"))).alias("key"))


@query
def csv_escape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.csv_escape("text").alias("cell"))


@query
def json_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.json_escape("html").alias("escaped"))


@query
def dart_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.dart_escape("html").alias("escaped"))


@query
def replacement_expr(spark, sf):
    key = text.make_key("p_name")
    return table(spark, sf, "part").select("p_partkey", *[
        text.replacement_expr(key, fmt).alias(fmt) for fmt in ("arb", "getx", "json")])


@query
def relative_path(spark, sf):
    return view(spark, sf, "code_files").select("path", text.relative_path("path", "lib/screens").alias("relative"))


@query
def age_bucket(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", text.age_bucket("ts", F.lit(AS_OF).cast("timestamp_ntz")).alias("age"))


# --- extraction ----------------------------------------------------------------------


@query
def extract_literals(spark, sf):
    return extract.extract_literals(_scanned(spark, sf))


@query
def extract_lines(spark, sf):
    return extract.extract_lines(_scanned(spark, sf))


@query
def ignore_reason(spark, sf):
    literals = extract.extract_literals(_scanned(spark, sf))
    return literals.select(
        *extract.ORDER, F.coalesce(extract.ignore_reason("value"), F.lit("kept")).alias("reason"))


@query
def extract_clean(spark, sf):
    return extract.drop_noise(extract.extract_literals(_scanned(spark, sf)))


@query
def drop_localized(spark, sf):
    lines = extract.extract_lines(_scanned(spark, sf))
    by_line = extract.drop_localized(lines, "line").withColumn("rule", F.lit("line"))
    by_suffix = extract.drop_localized(lines, "suffix").withColumn("rule", F.lit("suffix"))
    return by_line.unionByName(by_suffix).select("rule", *extract.ORDER, "line_no", "value")


@query
def skip_large(spark, sf):
    return extract.skip_large(view(spark, sf, "document_files"), 5000).select("path")


@query
def occurrences(spark, sf):
    return _found(spark, sf)


@query
def occurrences_distinct(spark, sf):
    return extract.occurrences(_scanned(spark, sf), dedupe=True)


@query
def unique_strings(spark, sf):
    return _strings(spark, sf)


@query
def rescan_changed(spark, sf):
    """Strings of a tree that was scanned before a third of its files changed, one went and many came."""
    target = f"{staging_dir(spark)}/scan-{uuid.uuid4().hex}"
    now = view(spark, sf, "code_files").selectExpr("path", "content", "abs(hash(path)) % 3 as part")
    before = now.where("part > 0 or path like 'lib/%'").selectExpr("path", "if(part = 1, upper(content), content) as content", "0 as part")
    before = before.unionByName(before.selectExpr("'lib/gone.dart' as path", "'Text(\"gone\")' as content", "part").limit(1))
    for tree in (before, now):
        listing = tree.selectExpr("path", "octet_length(content) as length", "timestamp_seconds(if(part = 1, 2, 1)) as modified")
        read = lambda changed, tree=tree: tree.join(changed.select("path"), "path", "left_semi").selectExpr(
            "path", "cast(content as binary) as data")
        rescan.scan(spark, listing.where(extract.scannable()), read, target)
    return rescan.read_strings(spark, target)


@query
def extract_summary(spark, sf):
    return extract.extract_summary(_found(spark, sf))


# --- sheets --------------------------------------------------------------------------


@query
def valid_header_rows(spark, sf):
    return sheets.valid_header_rows(_rows(spark, sf))


@query
def sheet_problems(spark, sf):
    """Every sheet read with a header row that does not exist in it, and with the right one."""
    files = view(spark, sf, "sheet_files")
    return sheets.sheet_problems(files, header_row=9).withColumn("header_row", F.lit(9)).unionByName(
        sheets.sheet_problems(files, header_row=2).withColumn("header_row", F.lit(2)))


@query
def sheet_keys(spark, sf):
    return sheets.sheet_keys(_rows(spark, sf), data_start=4)


@query
def row_range(spark, sf):
    return sheets.row_range(_rows(spark, sf), 4, 6)


@query
def preview_sheet(spark, sf):
    return sheets.preview_sheet(view(spark, sf, "sheet_files"))


@query
def unpivot_sheet(spark, sf):
    return translations.unpivot_sheet(view(spark, sf, "sheet_files")).where(translations.has_text())


@query
def unpivot_lines(spark, sf):
    """The same cells from a table of lines, for sheets that do not fit a row."""
    return translations.unpivot_lines(stage(_rows(spark, sf), "rows"), hot_rows=100).where(translations.has_text())


@query
def last_value_per_key(spark, sf):
    return _values(spark, sf)


@query
def active_langs(spark, sf):
    return translations.active_langs(_long(spark, sf))


@query
def keys_per_language(spark, sf):
    return translations.keys_per_language(_long(spark, sf))


@query
def pivot_catalog(spark, sf):
    return translations.pivot_catalog(_values(spark, sf), SHOWN)


@query
def select_langs(spark, sf):
    langs = view(spark, sf, "sheet_long").groupBy("sheet", "lang").agg(F.min("ord").alias("ord"))
    picked = [("es_ar", None), ("top10", None), ("numbers", [2, 4]), ("all", None)]
    out = None
    for choice, numbers in picked:
        part = translate.select_langs(langs, choice, numbers).withColumn("choice", F.lit(choice))
        out = part if out is None else out.unionByName(part)
    return out


@query
def supported_langs(spark, sf):
    codes = view(spark, sf, "locales").withColumn("code", F.regexp_replace("lang", "^app_", ""))
    return translate.supported_langs(codes, "code").select("c_custkey", "code")


# --- quality -------------------------------------------------------------------------


@query
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(quality.key_table(_long(spark, sf)))


@query
def duplicate_rows(spark, sf):
    long = _long(spark, sf)
    return quality.duplicate_rows(long, _keys(spark, sf))


@query
def duplicate_lines(spark, sf):
    long = _long(spark, sf)
    return quality.duplicate_lines(quality.duplicate_rows(long, _keys(spark, sf)))


@query
def missing_pairs(spark, sf):
    return quality.missing_pairs(quality.missing_by_key(_keys(spark, sf)))


@query
def missing_by_key(spark, sf):
    missing = quality.missing_by_key(_keys(spark, sf))
    return missing.select("sheet", "key", translations.language_list(F.col("missing")).alias("langs"))


@query
def generation_stats(spark, sf):
    keys = _keys(spark, sf)
    out = None
    for fmt in ("arb", "getx", "json"):
        part = quality.generation_stats(keys, fmt).withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


@query
def missing_report(spark, sf):
    keys = _keys(spark, sf)
    blocks = quality.missing_report(quality.missing_by_key(keys), "arb")
    head = quality.report_header(quality.generation_stats(keys, "arb"), "arb", AS_OF)
    return blocks.unionByName(head.select("sheet", F.lit(-1).alias("first_row"), F.lit("").alias("key"), "text"))


# --- bundles -------------------------------------------------------------------------


def _render(spark, sf, fmt):
    return bundles.render_bundle(bundles.bundle_entries(stage(_values(spark, sf), "values"), fmt), fmt)


@query
def render_bundle(spark, sf):
    return _render(spark, sf, "arb")


@query
def render_bundle_getx(spark, sf):
    return _render(spark, sf, "getx")


@query
def render_bundle_json(spark, sf):
    return _render(spark, sf, "json")


@query
def locale_manifest(spark, sf):
    return bundles.locale_manifest(translations.active_langs(_long(spark, sf)))


# --- catalog -------------------------------------------------------------------------


@query
def smart_merge(spark, sf):
    return catalog.smart_merge(_strings(spark, sf), _catalog(spark, sf)).withColumn(
        "app_fr", F.try_element_at("translations", F.lit("app_fr"))).drop("translations")


@query
def merge_stats(spark, sf):
    return catalog.merge_stats(catalog.smart_merge(_strings(spark, sf), _catalog(spark, sf)))


@query
def removed_strings(spark, sf):
    return catalog.removed_strings(_strings(spark, sf), _catalog(spark, sf)).select("key", "ord", "english")


@query
def merge_modes(spark, sf):
    strings, stored = stage(_strings(spark, sf), "strings"), _catalog(spark, sf)
    out = None
    for mode in ("merge", "version", "overwrite"):
        rows, target = catalog.resolve_mode(strings, stored, mode, "app_strings")
        part = rows.select(F.lit(mode).alias("mode"), F.lit(target).alias("target"), "key", "english", "status")
        out = part if out is None else out.unionByName(part)
    return out


@query
def render_catalog_csv(spark, sf):
    merged = catalog.smart_merge(_strings(spark, sf), _catalog(spark, sf))
    return writers.render_catalog_csv(merged)


@query
def catalog_roundtrip(spark, sf):
    """A catalog with line breaks in its texts, written and read back from its part files."""
    merged = catalog.smart_merge(_strings(spark, sf), _catalog(spark, sf))
    broken = F.concat("english", F.lit('\n"'), "key", F.lit('",\n\nend'))
    folder = f"{staging_dir(spark)}/catalog-{uuid.uuid4().hex}"
    writers.write_catalog_csv(merged.withColumn("english", broken), folder)
    rows = sheets.read_sheet_lines(spark, folder, quoted_breaks=True, by="folder")
    return sheets.read_catalog_lines(stage(rows, "lines")).select(
        "key", "english", F.try_element_at("translations", F.lit("app_fr")).alias("app_fr"))


@query
def render_catalog_json(spark, sf):
    return writers.render_catalog_json(stage(_strings(spark, sf), "strings"))


@query
def catalog_version(spark, sf):
    """The catalog in the current version of a target: made once, given up once, and merged once with itself."""
    target = f"{staging_dir(spark)}/versions-{uuid.uuid4().hex}"
    strings = stage(_strings(spark, sf), "strings")
    flows.export_strings(strings, _catalog(spark, sf), target)
    versions.begin(spark, target).write_table("merged", strings.limit(0))
    flows.export_strings(strings, None, target)
    return flows.read_version(spark, target).select("key", "english", F.try_element_at("translations", F.lit("app_fr")).alias("app_fr"))


@query
def catalog_summary(spark, sf):
    return catalog.catalog_summary(view(spark, sf, "catalog_files"))


# --- rewrite -------------------------------------------------------------------------


@query
def match_keys(spark, sf):
    return _matched(spark, sf)


@query
def plan_replacements(spark, sf):
    matched = _matched(spark, sf)
    return rewrite.plan_replacements(matched, "arb").withColumn("format", F.lit("arb")).unionByName(
        rewrite.plan_replacements(matched, "getx").withColumn("format", F.lit("getx")))


@query
def missed_strings(spark, sf):
    return rewrite.missed_strings(_matched(spark, sf))


@query
def plan_text(spark, sf):
    matched = _matched(spark, sf)
    return rewrite.plan_text(rewrite.plan_replacements(matched, "getx")).unionByName(
        rewrite.missed_text(rewrite.missed_strings(matched)))


@query
def replacements_by_file(spark, sf):
    return rewrite.replacements_by_file(rewrite.plan_replacements(_matched(spark, sf), "arb"))


@query
def review_batches(spark, sf):
    """Batches of a plan without the second entry of every file."""
    batches = rewrite.review_batches(rewrite.plan_replacements(_matched(spark, sf), "arb"), size=4)
    skips = view(spark, sf, "part_files").select(
        "path", F.lit(1).alias("batch"), F.lit(2).alias("idx"))
    return rewrite.drop_reviewed(batches, skips).select(*extract.ORDER, "idx", "batch", "key")


def _plan(spark, sf):
    return stage(rewrite.plan_replacements(_matched(spark, sf), "getx"), "plan")


@query
def apply_by_line(spark, sf):
    return rewrite.apply_by_line(view(spark, sf, "code_files"), _plan(spark, sf))


@query
def apply_by_content(spark, sf):
    return rewrite.apply_by_content(view(spark, sf, "code_files"), _plan(spark, sf))


# --- translation ---------------------------------------------------------------------


@query
def translation_work(spark, sf):
    return _work(spark, sf)


@query
def translate_tm(spark, sf):
    return translate.translate_tm(_work(spark, sf), view(spark, sf, "memory"))


def _translator() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Stand-in translator; refuses some texts to show that the others go through."""

    def upper(frame):
        if frame["english"].str.contains("ring").any():
            raise ValueError("refused")
        return frame.assign(text=frame["lang"] + " " + frame["english"].str.upper())

    return upper


@query
def translate_fn(spark, sf):
    work = _work(spark, sf)
    return translate.attach_texts(work, stage(translate.translate_texts(work, _translator()), "texts"))


@query
def apply_translations(spark, sf):
    done = translate.translate_tm(_work(spark, sf), view(spark, sf, "memory"))
    return translate.apply_translations(_english(spark, sf), done).select(
        "sheet", "row_no", "english", *[F.try_element_at("translations", F.lit(t)).alias(t) for t in TARGETS])


@query
def translate_rows(spark, sf):
    """Memory first, then the translator for the rest."""
    rows = flows.translate_rows(_english(spark, sf), TARGETS, view(spark, sf, "memory"), _translator())
    return rows.select(
        "sheet", "row_no", "english", *[F.try_element_at("translations", F.lit(t)).alias(t) for t in TARGETS])


@query
def sheet_records(spark, sf):
    """Rows of sheets with line breaks inside quotes."""
    return sheets.sheet_rows(view(spark, sf, "break_files"), quoted_breaks=True)


@query
def sheet_records_scan(spark, sf):
    """The same rows from files that are read by splits. A file holds many sheets, each line with the name of its own."""
    folder = f"{staging_dir(spark)}/sheets-{uuid.uuid4().hex}"
    writers.write_named_sheets(view(spark, sf, "break_files"), folder)
    rows = sheets.read_sheet_lines(spark, folder, quoted_breaks=True, by="name")
    return rows.select(F.regexp_extract("path", "([0-9]+)[.]csv$", 1).cast("long").alias("sheet"), "row_no", "line")


@query
def sheet_texts(spark, sf):
    return translate.sheet_texts(_rows(spark, sf))


@query
def write_back(spark, sf):
    """Sheets with every English text translated; the memory knows the texts without an m."""
    files = view(spark, sf, "sheet_files")
    return translate.write_back(files, _known_texts(sheets.sheet_rows(files)))


@query
def write_back_lines(spark, sf):
    """The same from lines, with sheets above five rows split."""
    rows = _rows(spark, sf)
    return translate.write_back_lines(rows, _known_texts(rows), hot_rows=5)


def _known_texts(rows):
    work = translate.translation_work(translate.sheet_texts(rows), TARGETS)
    memory = work.where(~F.contains("english", F.lit("m"))).select("english", "lang").distinct().withColumn(
        "text", F.concat("lang", F.lit(', "'), "english", F.lit('"')))
    return translate.translate_tm(work, memory)


@query
def quota_estimate(spark, sf):
    return translate.quota_estimate(_english(spark, sf), len(TARGETS), QUOTA)


@query
def quota_usage(spark, sf):
    return translate.quota_usage(translate_fn(spark, sf), QUOTA)


@query
def quota_running(spark, sf):
    return translate.quota_running(translate_fn(spark, sf), 500, block=64)


@query
def admit_texts(spark, sf):
    """The distinct texts in the order of their rows, and which of them a quota admits."""
    return ledger.admit_texts(ledger.texts_in_order(_work(spark, sf)), QUOTA)


@query
def translate_quota(spark, sf):
    """A run that stops at half the quota, and one with the same ledger that goes on up to the quota."""
    work, folder = stage(_work(spark, sf), "work"), f"{staging_dir(spark)}/ledger-{uuid.uuid4().hex}"
    ledger.translate_within_quota(work, _translator(), folder, QUOTA // 2)
    return ledger.translate_within_quota(work, _translator(), folder, QUOTA).drop("units")


# --- streaming -----------------------------------------------------------------------


@query
def stream_extract(spark, sf):
    """Strings of a stream of new source files, kept in a store of per-batch states."""
    folder = f"{staging_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = extract_stream.start_extract(_arriving(spark, sf), f"{folder}/store", f"{folder}/checkpoint", available_now=True)
    run.awaitTermination()
    return extract_stream.read_store(spark, f"{folder}/store")


@query
def stream_catalog(spark, sf):
    """The stream's strings merged with the stored catalog, by the changes of its files."""
    folder = f"{staging_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = catalog_stream.start_catalog(
        _arriving(spark, sf), f"{folder}/catalog", f"{folder}/checkpoint", _catalog(spark, sf), available_now=True)
    run.awaitTermination()
    merged = catalog_stream.read_merged(spark, f"{folder}/catalog")
    return merged.withColumn("app_fr", F.try_element_at("translations", F.lit("app_fr"))).drop("translations")


def _arriving(spark, sf) -> DataFrame:
    """All source files as a stream. A table is a file or a folder of files; as a pattern, its path may be either."""
    tables = {}
    for name in ("part", "pages", "documents"):
        rows = table(spark, sf, name)
        tables[name] = spread(rows, spark.readStream.schema(rows.schema).parquet(f"{sf}/{name}.parque[t]"))
    return code_files(tables["part"], tables["pages"], tables["documents"])
