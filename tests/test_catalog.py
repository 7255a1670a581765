import pytest

from stringloom.functions.fixed_values import LANGUAGE_CODES, LANGUAGE_NAMES
from stringloom.operators import catalog, extract
from stringloom.plans.staging import stage
from stringloom.sinks import writers
from stringloom.sources import bundles as sources, files as file_sources, sheets


def strings(spark, *texts):
    data = [("lib/a.dart", 1, i, i, t) for i, t in enumerate(texts, 1)]
    found = spark.createDataFrame(data, "path string, pattern_id int, match_ord int, line_no int, value string")
    return extract.unique_strings(found)


def stored(spark, *rows):
    return spark.createDataFrame(
        [(k, e, t, i) for i, (k, e, t) in enumerate(rows)],
        "key string, english string, translations map<string,string>, ord int")


def sample(spark):
    return strings(spark, "Go Back?", "Select Image", "New one", 'Say "hi", ok'), stored(
        spark, ("gone", "Gone", {"app_fr": "parti"}), ("go_back", "Go back", {"app_fr": "Retour"}),
        ("select_image", "", {"app_ar": "x"}))


def test_smart_merge(spark):
    merged = stage(catalog.smart_merge(*sample(spark)), "merged")
    got = {r["key"]: (r["english"], r["translations"], r["status"]) for r in merged.collect()}
    assert got == {
        "go_back": ("Go back", {"app_fr": "Retour"}, "updated"),
        "select_image": ("Select Image", {"app_ar": "x"}, "updated"),
        "new_one": ("New one", {}, "new"), "say_hi_ok": ('Say "hi", ok', {}, "new"),
        "gone": ("Gone", {"app_fr": "parti"}, "removed"),
    }
    stats = catalog.merge_stats(merged).first()
    assert tuple(stats) == (2, 2, 1, 5)
    assert [r["key"] for r in catalog.removed_strings(*sample(spark)).collect()] == ["gone"]


def test_modes(spark):
    new, old = sample(spark)
    for mode, target, n in (("merge", "p", 5), ("version", "p_v2", 4), ("overwrite", "p", 4)):
        rows, path = catalog.resolve_mode(new, old, mode, "p")
        assert (path, rows.count()) == (target, n)
    assert catalog.resolve_mode(new, old, "version", "p", " v7 ")[1] == "p_v7"
    assert catalog.resolve_mode(new, None, "merge", "p")[0].count() == 4
    with pytest.raises(ValueError):
        catalog.resolve_mode(new, old, "other", "p")


def read_text(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_csv_round_trip(spark, tmp_path):
    merged = stage(catalog.smart_merge(*sample(spark)), "merged")
    writers.write_catalog_csv(merged, str(tmp_path / "csv"))
    text = read_text(tmp_path / "csv")
    lines = text.split("\n")
    assert lines[0] == "," + ",".join(map(str, range(1, 71)))
    assert lines[1] == "," + ",".join(LANGUAGE_CODES)
    assert lines[2] == "Key," + ",".join(LANGUAGE_NAMES)
    assert [line.split(",")[0] for line in lines[3:8]] == ["go_back", "select_image", "new_one", "say_hi_ok", "gone"]
    assert lines[5] == "new_one,New one" + "," * 69
    assert lines[6].startswith('say_hi_ok,"Say ""hi"", ok",')
    again = sheets.read_catalog(spark.createDataFrame([("c.csv", text)], "path string, content string"))
    got = {r["key"]: (r["english"], {k: v for k, v in r["translations"].items() if v}) for r in again.collect()}
    assert got == {r["key"]: (r["english"], r["translations"]) for r in merged.collect()}


def test_readable_keys_and_newlines(spark):
    merged = catalog.start_fresh(strings(spark, "two\nlines"))
    lines = writers.render_catalog_csv(merged, ["app_en", "app_fr"], ["E", "F"], snake_case_keys=False, newline_escape=True)
    assert lines.where("section = 1").first()["line"] == 'two lines,"two\\nlines",'


def test_json(spark, tmp_path):
    writers.write_catalog_json(sample(spark)[0], str(tmp_path / "json"))
    text = read_text(tmp_path / "json")
    assert text == (
        '{\n  "go_back": "Go Back?",\n  "select_image": "Select Image",\n  "new_one": "New one",\n'
        '  "say_hi_ok": "Say \\"hi\\", ok"\n}\n')
    entries = sources.load_json(spark.createDataFrame([("c.json", text)], "path string, content string"))
    assert [(r["key"], r["value"]) for r in entries.orderBy("ord").collect()][3] == ("say_hi_ok", 'Say "hi", ok')
    writers.json_lines(sample(spark)[0], str(tmp_path / "lines"), readable=True)
    assert spark.read.json(str(tmp_path / "lines")).where("key = 'go back'").count() == 1


def test_summary(spark, tmp_path):
    for path, text in {
        "shop_strings/shop.csv": "1\n2\n3\n\na\nb\n", "shop_strings/other.csv": "1\n" * 9, "old/x.json": "{}",
        "web/web.csv": "1\n", ".git/a.csv": "1", "docs/readme.md": "x", "few/few.csv": "1\n2\n",
    }.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    files = file_sources.read_text_files(spark, str(tmp_path), "*")
    rows = catalog.catalog_summary(files).collect()
    assert {(r["folder"], r["base_name"], r["n_strings"]) for r in rows} == {
        ("shop_strings", "shop", 2), ("old", "old", 0), ("few", "few", 0)}
    assert [r["modified"] for r in rows] == sorted((r["modified"] for r in rows), reverse=True)


def test_load_bundles(spark):
    files = spark.createDataFrame([
        ("l/b.arb", '{"@@locale":"en","a":"1","n":5,"z":null,"o":{"x":1}}'), ("l/a.arb", '{"a":"0","q":"it\'s"}'),
        ("l/bad.arb", "{oops"), ("l/c.json", '{"@@x":"kept","b":"2"}'),
        ("l/d.dart", "final m = {\n 'a': 'last', 'b':\n'', 'it\\'s': 'x' };"), ("l/e.txt", "'no': 'no'"),
    ], "path string, content string")
    got = {r["key"]: (r["value"], r["path"], r["ord"]) for r in sources.load_bundles(files).collect()}
    assert got["a"] == ("last", "l/a.arb", 0)
    assert got["n"][0] == "5" and got["z"][0] == "null" and got["o"][0] == '{"x":1}'
    assert got["@@x"][0] == "kept" and "@@locale" not in got and "no" not in got
    assert got["b"] == ("", "l/c.json", 1)
    assert {r["key"] for r in sources.load_bundles(files, ("arb",)).collect()} == {"a", "n", "z", "o", "q"}


def test_blank_texts_of_many_languages(spark):
    """Blank and missing texts are empty cells; languages of the list make no rows when others are looked for."""
    merged = spark.createDataFrame(
        [("k", "E", {"app_fr": "", "app_ar": "x", "app_xx": ""}), ("l", "F", {}), ("m", "G", None), ("n", "H", {"app_fr": None})],
        "key string, english string, translations map<string,string>")
    cells = merged.select(catalog.catalog_cells(["app_en", "app_fr", "app_ar"]).alias("c"))
    assert [r["c"] for r in cells.orderBy("c").collect()] == [["k", "E", "", "x"], ["l", "F", "", ""], ["m", "G", "", ""], ["n", "H", "", ""]]
    assert "map_filter" in cells._jdf.queryExecution().optimizedPlan().toString().lower().replace("mapfilter", "map_filter")
    assert catalog.extra_languages(merged, ["app_en", "app_fr", "app_ar"]) == ["app_xx"]
