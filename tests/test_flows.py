import json
import pathlib

import pytest
from pyspark.sql import functions as F

from stringloom.operators import extract
from stringloom.plans import flows, staging
from stringloom.sinks import versions
from stringloom.sources import bundles, files as file_sources, sheets
from stringloom.streaming import extract_stream

SHEET = ",1,2\n,app_en,app_fr\nKey,E,F\nselect_image,Select Image,Choisir\nGo Back?,Go Back?,\n1_am,Morning,Matin\n"


def write(folder, texts):
    for path, text in texts.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text)


def read_text(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def exported(spark, target, name):
    return read_text(pathlib.Path(versions.current(spark, str(target)).path(name)))


def test_extract_then_merge(spark, tmp_path):
    write(tmp_path / "lib", {"a.dart": 'Text("Select Image")\nText("Go Back?")', "l10n_x/b.dart": "title: 'New'", "x_intl.dart": "Text('no')"})
    files = file_sources.read_code_files(spark, str(tmp_path / "lib"))
    first = flows.export_catalog(files, None, str(tmp_path / "one"))
    assert tuple(first.first()) == (3, 0, 0, 3)
    stored_text = exported(spark, tmp_path / "one", "csv").replace("Go Back?", "Back", 1)
    stored = sheets.read_catalog(spark.createDataFrame([("c", stored_text)], "path string, content string"))
    second = flows.export_catalog(files, stored, str(tmp_path / "two"))
    assert tuple(second.first()) == (0, 1, 2, 3)
    assert "go_back,Back," in exported(spark, tmp_path / "two", "csv")
    assert json.loads(exported(spark, tmp_path / "two", "json")) == {"select_image": "Select Image", "go_back": "Go Back?", "new": "New"}
    third = flows.export_catalog(files, stored, str(tmp_path / "two"), mode="version")
    assert tuple(third.first()) == (3, 0, 0, 3) and versions.current(spark, str(tmp_path / "two_v2")).number == 1


@pytest.mark.parametrize("mode", ["merge", "overwrite", "version"])
def test_every_mode_twice_on_one_target(spark, tmp_path, mode):
    out = tmp_path / ("out_v2" if mode == "version" else "out")
    for text in ("Select Image", "Go Back"):
        write(tmp_path / "lib", {"a.dart": f'Text("{text}")'})
        files = file_sources.read_code_files(spark, str(tmp_path / "lib"))
        stored = None
        if mode == "merge" and out.exists():
            parts = F.array_sort(F.collect_list(F.struct("path", "content")))
            text_of = F.array_join(F.transform(parts, lambda f: f["content"]), "").alias("content")
            parts_read = file_sources.read_text_files(spark, versions.current(spark, str(out)).path("csv"), "part-*")
            stored = sheets.read_catalog(parts_read.agg(F.lit("c").alias("path"), text_of))
        flows.export_catalog(files, stored, str(tmp_path / "out"), mode=mode)
    written = exported(spark, out, "csv")
    assert "go_back" in written and ("select_image" in written) == (mode == "merge")


def test_readable_keys_keep_their_translations(spark, tmp_path):
    write(tmp_path / "lib", {"a.dart": 'Text("Select Image")'})
    files = file_sources.read_code_files(spark, str(tmp_path / "lib"))
    flows.export_catalog(files, None, str(tmp_path / "one"), snake_case_keys=False)
    text = exported(spark, tmp_path / "one", "csv")
    assert "select image," in text
    stored = sheets.read_catalog(spark.createDataFrame([("c", text)], "path string, content string"))
    assert tuple(flows.export_catalog(files, stored, str(tmp_path / "two")).first()) == (0, 0, 1, 1)


def test_stored_languages_outside_the_list_are_kept(spark, tmp_path):
    write(tmp_path / "lib", {"a.dart": 'Text("Select Image")'})
    files = file_sources.read_code_files(spark, str(tmp_path / "lib"))
    text = ",1,2,3\n,app_en,app_pt_br,app_xx\nKey,E,P,X\nselect_image,Select Image,Escolher,\nold,Old,Velho,Xx\n"
    stored = sheets.read_catalog(spark.createDataFrame([("c", text)], "path string, content string"))
    flows.export_catalog(files, stored, str(tmp_path / "one"))
    lines = exported(spark, tmp_path / "one", "csv").splitlines()
    assert lines[1].endswith(",app_pt_br,app_xx") and lines[2].endswith(",app_pt_br,app_xx")
    assert len({line.count(",") for line in lines}) == 1
    again = spark.createDataFrame([("c", "\n".join(lines))], "path string, content string")
    got = {r["key"]: {k: v for k, v in r["translations"].items() if v} for r in sheets.read_catalog(again).collect()}
    assert {k: v.get("app_pt_br") for k, v in got.items()} == {"select_image": "Escolher", "old": "Velho"}
    assert got["old"]["app_xx"] == "Xx"


def test_generate_and_load_again(spark, tmp_path):
    one = spark.createDataFrame([("web/s.csv", SHEET)], "path string, content string")
    want = {("app_en", "select_image", "Select Image"), ("app_en", "go_back", "Go Back?"), ("app_en", "1_am", "Morning"),
            ("app_fr", "select_image", "Choisir"), ("app_fr", "1_am", "Matin")}
    for fmt, suffix in (("arb", ".arb"), ("getx", ".dart"), ("json", ".json")):
        out = tmp_path / fmt
        result = flows.generate_bundles(one, str(out), fmt, "2026-01-15 10:30:00")
        assert result.stats.first()["missing_keys"] == 1
        texts = [
            (folder.name.removeprefix("lang=") + suffix, read_text(folder))
            for folder in out.glob("bundles/sheet=*/lang=*")
        ]
        files = spark.createDataFrame(texts, "path string, content string")
        got = {(r["path"].split(".")[0], r["key"].replace("key_1", "1"), r["value"]) for r in bundles.load_format(files, fmt).collect()}
        assert got == want
        assert "[go_back]\n  Missing in: app_fr" in read_text(next(out.glob("report/sheet=*")))
    locales = spark.read.parquet(str(tmp_path / "getx/locales"))
    assert {(r["lang"], r["locale"]) for r in locales.collect()} == {("app_en", "en_US"), ("app_fr", "fr_FR")}


@pytest.mark.parametrize("blank", ["trim", "empty"])
def test_flows_over_lines_equal_those_over_files(spark, tmp_path, blank):
    """Sheets read by split, with a blank line, a repeated code and one without a header."""
    texts = {"a.csv": SHEET + " \nlate,Late,\n", "b.csv": ",1,2,3\n,app_en,app_fr,app_fr\nKey,E,F,F\nx,Go,,\n\ny,Stop,a,b\n", "c.csv": "x\n"}
    write(tmp_path / "in", texts)
    files = file_sources.read_text_files(spark, str(tmp_path / "in"), "*.csv")
    rows = sheets.read_sheet_lines(spark, str(tmp_path / "in"), blank)
    memory = spark.createDataFrame([("Go", "app_fr", "Va"), ("Late", "app_fr", "Tard")], "english string, lang string, text string")

    def told(lines):
        return sorted((r["sheet"].rsplit("/", 1)[1], r["row_no"], r["line"]) for r in lines.collect())

    want = told(flows.translate_sheets(files, ["app_fr"], memory, blank=blank))
    got = told(flows.translate_lines(rows, ["app_fr"], memory))
    assert got == want and any("Tard" in line for _, _, line in got) and ("c.csv", 1, "x") in got
    assert sum("Va" in line for _, _, line in got) == 1
    if blank == "trim":
        one = flows.generate_bundles(files, str(tmp_path / "one"), "json", "now")
        two = flows.generate_from_lines(rows, str(tmp_path / "two"), "json", "now")
        columns = ["lang", "key", "value"]
        assert sorted(one.entries.select(*columns).collect()) == sorted(two.entries.select(*columns).collect())
        assert two.entries.count() > 4


def test_large_bundle_is_written_by_several_tasks(spark, tmp_path):
    """The part files of a bundle, in name order, are the bundle."""
    sheet = ",1\n,app_en\nKey,E\n" + "".join(f"k{i},value {i}\n" for i in range(5000))
    one = spark.createDataFrame([("s.csv", sheet)], "path string, content string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        flows.generate_bundles(one, str(tmp_path), "json", "now")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    folder = next(tmp_path.glob("bundles/sheet=*/lang=*"))
    assert len(list(folder.glob("part-*"))) > 1
    assert list(json.loads(read_text(folder)).items()) == [(f"k{i}", f"value {i}") for i in range(5000)]


def test_replace(spark, tmp_path):
    files = spark.createDataFrame([("lib/a.dart", 'Text("Select Image")\nText("Go")\n')], "path string, content string")
    entries = bundles.load_bundles(spark.createDataFrame([("e.json", '{"select_image":"select image","go":"Go"}')], "path string, content string"))
    plan, missed = flows.plan_rewrite(files, entries, "getx")
    assert missed.count() == 0
    counts = flows.apply_rewrite(files, plan, str(tmp_path / "line"))
    assert [tuple(r) for r in counts.collect()] == [("lib/a.dart", 2, 2)]
    skips = spark.createDataFrame([("lib/a.dart", 1, 1)], "path string, batch int, idx int")
    flows.apply_rewrite(files, plan, str(tmp_path / "content"), by="content", skips=skips)
    assert spark.read.parquet(str(tmp_path / "content")).first()["content"] == "Text(\"Select Image\")\nText('go'.tr)\n"


def test_stream_equals_batch(spark, tmp_path):
    texts = {f"f{i}.dart": f'Text("word {i % 4}")\ntitle: "Word {i % 3}"' for i in range(12)}
    schema = "path string, content string"
    table = spark.createDataFrame(list(texts.items()), schema)
    source = str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = extract_stream.start_extract(stream, str(tmp_path / "store"), str(tmp_path / "ck"), available_now=True)
        query.awaitTermination()
        return sorted(map(tuple, extract_stream.read_store(spark, str(tmp_path / "store")).collect()))

    table.where("path < 'f3'").repartition(2).write.parquet(source)
    run()
    table.where("path >= 'f3'").repartition(2).write.mode("append").parquet(source)
    got = run()
    want = extract.unique_strings(extract.occurrences(extract.scan_files(table)))
    assert got == sorted(map(tuple, want.collect()))
    assert len(list((tmp_path / "store/files").glob("batch=*"))) > 2


def test_stream_keeps_the_newest_version_of_a_file(spark, tmp_path):
    schema = "path string, content string"
    source, store = str(tmp_path / "in"), str(tmp_path / "store")

    def arrive(rows, to):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        extract_stream.start_extract(stream, to, str(tmp_path / "ck"), available_now=True).awaitTermination()
        return {r["key"]: r["uses"] for r in extract_stream.read_store(spark, to).collect()}

    first = [("a.dart", 'Text("one")'), ("b.dart", 'Text("two")'), ("c.dart", 'Text("three")'), ("d.dart", None)]
    assert arrive(first, store) == {"one": 1, "two": 1, "three": 1}
    assert arrive([("a.dart", 'Text("uno")'), ("b.dart", 'Text("two")')], store) == {"uno": 1, "two": 1, "three": 1}
    assert arrive([("a.dart", "// no text"), ("c.dart", None)], store) == {"two": 1}
    new = str(tmp_path / "new")
    extract_stream.compact_store(spark, store, new)
    assert len(list((tmp_path / "new/found").glob("batch=*"))) == 1
    assert arrive([("c.dart", 'Text("three")')], new) == {"two": 1, "three": 1}
    counts = flows.export_strings(extract_stream.read_store(spark, new), None, str(tmp_path / "out"))
    assert tuple(counts.first()) == (2, 0, 0, 2)


def test_staging_uses_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert staging.staging_dir(spark) == folder
    staged = staging.stage(spark.range(3).select(F.lit("x").alias("v")), "t")
    assert staged.inputFiles()[0].startswith(f"file://{folder}/t-") and staged.count() == 3
