from stringloom.operators import bundles, quality, translations
from stringloom.sinks import writers

GLYPHS = "━" * 50


def long(spark, *cells):
    """Cells (sheet, row_no, key, {lang: value}) as a long table."""
    data = [
        (sheet, row, key, key, i, lang, value)
        for sheet, row, key, texts in cells for i, (lang, value) in enumerate(texts.items(), 1)
    ]
    return spark.createDataFrame(
        data, "sheet string, row_no int, raw_key string, key string, ord int, lang string, value string")


def sample(spark):
    return long(
        spark,
        ("a", 4, "go_back", {"app_en": "Go", "app_fr": "", "app_zz": ""}),
        ("a", 5, "ok", {"app_en": "OK", "app_fr": "D'accord $1", "app_zz": ""}),
        ("a", 6, "1_am", {"app_en": "", "app_fr": "", "app_zz": ""}),
        ("a", 7, "go_back", {"app_en": "", "app_fr": "Retour", "app_zz": ""}),
        ("a", 8, "key_1_am", {"app_en": "B", "app_fr": "", "app_zz": ""}),
        ("a", 9, "1_am", {"app_en": "A", "app_fr": "", "app_zz": ""}),
        ("b", 4, "x", {"app_en": "x"}),
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_duplicates(spark):
    table = quality.key_table(sample(spark))
    assert rows(quality.duplicate_keys(table), "*") == [("a", "1_am", 2, 6, 9), ("a", "go_back", 2, 4, 7)]
    every = quality.duplicate_rows(sample(spark), table, hot_rows=1)
    assert rows(every, "sheet", "key", "row_no") == [("a", "1_am", 6), ("a", "1_am", 9), ("a", "go_back", 4), ("a", "go_back", 7)]
    assert rows(quality.duplicate_lines(every), "key", "rows") == [("1_am", "6, 9"), ("go_back", "4, 7")]


def test_missing(spark):
    table = quality.key_table(sample(spark))
    for hot_rows in (1, 1000):
        missing = quality.missing_by_key(table, hot_rows=hot_rows)
        assert rows(missing, "sheet", "key", translations.language_list(missing["missing"])) == [
            ("a", "1_am", "app_fr"), ("a", "key_1_am", "app_fr")]
    assert rows(quality.missing_pairs(quality.missing_by_key(table)), "key", "lang") == [("1_am", "app_fr"), ("key_1_am", "app_fr")]


def test_untranslated_keys(spark):
    table = quality.key_table(long(
        spark, ("a", 4, "k", {"app_en": "", "app_fr": ""}), ("a", 5, "l", {"app_en": "x", "app_fr": "y"})))
    missing = quality.missing_by_key(table)
    assert rows(missing, "key", translations.language_list(missing["missing"])) == [("k", "app_en, app_fr")]
    assert quality.missing_by_key(table, skip_untranslated=True).count() == 0


def test_stats(spark):
    table = quality.key_table(sample(spark))
    columns = ("sheet", "files_created", "total_rows", "unique_keys", "missing_keys", "duplicate_keys", "fixed_keys")
    assert rows(quality.generation_stats(table, "arb"), *columns) == [("a", 2, 6, 4, 2, 2, 2), ("b", 1, 1, 1, 0, 0, 0)]
    assert rows(quality.generation_stats(table, "getx"), "files_created") == [(2,), (3,)]


def test_no_texts_at_all(spark):
    table = quality.key_table(long(spark, ("a", 4, "k", {"app_en": ""})))
    assert rows(quality.generation_stats(table, "json"), "files_created", "missing_keys") == [(0, 0)]
    assert quality.missing_by_key(table).count() == 0


def document(spark, fmt, sheet, lang):
    lines = bundles.render_bundle(bundles.bundle_entries(translations.last_value_per_key(sample(spark)), fmt), fmt)
    picked = lines.where((lines.sheet == sheet) & (lines.lang == lang)).orderBy("section", "pos").collect()
    return "\n".join(r["line"] for r in picked)


def test_arb(spark):
    assert document(spark, "arb", "a", "app_en") == (
        '{\n  "@@locale": "en",\n  "go_back": "Go",\n  "ok": "OK",\n  "key_1_am": "A"\n}')


def test_getx(spark):
    assert document(spark, "getx", "a", "app_fr") == (
        "final Map<String, String> app_fr = {\n  'ok': 'D\\'accord \\$1',\n  'go_back': 'Retour'\n};")


def test_json(spark):
    assert document(spark, "json", "a", "app_en") == (
        '{\n  "go_back": "Go",\n  "ok": "OK",\n  "key_1_am": "B",\n  "1_am": "A"\n}')


def test_manifest(spark):
    got = rows(bundles.locale_manifest(translations.active_langs(sample(spark))), "sheet", "lang", "locale")
    assert got == [("a", "app_en", "en_US"), ("a", "app_fr", "fr_FR"), ("b", "app_en", "en_US")]


def test_report(spark, tmp_path):
    table = quality.key_table(sample(spark))
    header = quality.report_header(quality.generation_stats(table, "arb"), "arb", "2026-01-15 10:30:00")
    blocks = quality.missing_report(quality.missing_by_key(table), "arb")
    writers.write_report(header, blocks, str(tmp_path / "report"))
    assert [p.name for p in (tmp_path / "report").iterdir() if p.is_dir()] == ["sheet=a"]
    text = "".join(p.read_text() for p in sorted((tmp_path / "report/sheet=a").glob("part-*")))
    assert text == (
        "📊 ARB Generation Report\nGenerated: 2026-01-15 10:30:00\nTotal keys: 6\nARB files created: 2\n"
        f"Keys with missing translations: 2\n\n{GLYPHS}\nMissing Translations (by key):\n{GLYPHS}\n\n"
        "[key_1_am]\n  Missing in: app_fr\n\n[key_1_am]\n  Missing in: app_fr\n\n")


def test_bundle_problems(spark):
    from stringloom.sources import bundles

    files = spark.createDataFrame([
        ("a.arb", '{"a":"b"}'), ("cut.json", '{"a":"b"'), ("list.json", '["a"]'), ("none.arb", " "), ("null.json", None),
        ("m.dart", "'k': 'v'"), ("n.dart", "class X {}"), ("o.txt", "{"), ("empty.json", "{}")], "path string, content string")
    got = {r["path"]: r["problem"] for r in bundles.bundle_problems(files).collect()}
    assert got == {"cut.json": "not a JSON object", "list.json": "not a JSON object", "none.arb": "empty", "null.json": "empty", "n.dart": "no entries"}
