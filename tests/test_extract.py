import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stringloom.functions.fixed_values import LITERAL_PATTERNS
from stringloom.operators import extract
from stringloom.sources import files as sources

CODE = '''import "package:x/y.dart";
  Text(
    "Hello
 world"),
  title: 'A', title: 'B'.tr,
  content: Text( "hey!" ),
  message: "Don't stop",
  final b = "UP"
    .i18n;
  text: "a b"
  return "plain text";
  label: "12.5", label: "https://x", label: "assets/a.png", label: "/abs", label: " ... ", label: "L10n.x"
'''


def code(spark, *texts):
    return spark.createDataFrame([(f"lib/f{i}.dart", t) for i, t in enumerate(texts)], "path string, content string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def scan(content):
    """Matches by position, with line number and localization marks."""
    lines = content.split("\n")
    for pid, pattern in enumerate(LITERAL_PATTERNS, 1):
        for i, m in enumerate(re.finditer(pattern, content), 1):
            line_no = content[:m.start()].count("\n") + 1
            rest = content[m.end():].strip()
            line = lines[line_no - 1]
            yield (pid, i, line_no, m[1], rest.startswith((".tr", ".i18n")), ".tr" in line or ".i18n" in line)


COLUMNS = ("pattern_id", "match_ord", "line_no", "value", "suffix_localized", "line_localized")


def test_lines(spark):
    got = rows(extract.extract_lines(code(spark, CODE)), *COLUMNS)
    assert got == sorted(scan(CODE))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from([
    'Text("a")', "Text(\n'b c'", 'text: "x\ny"', "= 'q'", '= "v".tr', '="w" \n .i18n', "\n", " ", ".t", "return 'r'", "é😀", '"', "$",
    'content: Text("n")', ".trim()",
]), max_size=25).map("".join), min_size=30, max_size=40))
def test_lines_against_positions(spark, texts):
    got = extract.extract_lines(code(spark, *texts)).collect()
    want = [(f"lib/f{i}.dart", *hit) for i, t in enumerate(texts) for hit in scan(t)]
    assert sorted((r["path"], *(r[c] for c in COLUMNS)) for r in got) == sorted(want)


def test_many_matches_in_one_file(spark):
    text = "".join(f'a = "v{i}"' + ("\n" if i % 3 else ".tr;\n\n") for i in range(3000))
    assert rows(extract.extract_lines(code(spark, text)), *COLUMNS) == sorted(scan(text))


def test_occurrences(spark):
    found = extract.occurrences(code(spark, CODE))
    assert rows(found, "pattern_id", "line_no", "value") == [
        (1, 2, "Hello\n world"), (1, 6, "hey!"), (2, 10, "a b"), (7, 6, "hey!"), (8, 7, "Don"), (9, 11, "plain text")]
    assert rows(extract.occurrences(code(spark, CODE), dedupe=True), "pattern_id", "line_no").count((7, 6)) == 0
    by_suffix = extract.occurrences(code(spark, CODE), localized_rule="suffix")
    assert (3, 5, "A") in rows(by_suffix, "pattern_id", "line_no", "value")


def test_noise(spark):
    values = ["", "  ", "1", "1.5", "1.", "http://a", "https://a", " assets/x", "/a", "\\a", "?! -", "see L10n.a", "ok", "3 ok"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert [r[0] for r in df.select(extract.ignore_reason("value")).collect()] == [
        "empty", "empty", "number", "number", None, "url", "url", "asset", "file_path", "file_path", "symbols", "l10n_reference", None, None]


def test_scan_files(spark):
    paths = ["lib/a.dart", "lib/A_Localizations.dart", "lib/messages_en.dart", "lib/x_generated.dart", "lib/l10n/b.dart",
             "Intl/c.dart", "lib/a.txt", "lib/l10n"]
    df = spark.createDataFrame([(p, "") for p in paths], "path string, content string")
    assert rows(extract.scan_files(df), "path") == [("Intl/c.dart",), ("lib/a.dart",), ("lib/l10n/b.dart",)]
    assert rows(extract.scan_files(df, skip_dirs=True), "path") == [("lib/a.dart",)]


def test_unique_strings_order(spark):
    strings = extract.unique_strings(extract.occurrences(code(spark, 'text: "Go Back?"', 'Text("go back")\ntext: "GO BACK"')))
    assert rows(strings, "key", "value", "first_path", "first_line", "uses") == [("go_back", "GO BACK", "lib/f0.dart", 1, 3)]


def test_merged_states_equal_one_pass(spark):
    texts = [f'text: "word {i % 7}"\n= "Word {i % 5}"' for i in range(40)]
    found = extract.occurrences(code(spark, *texts))
    halves = [extract.string_states(found.where(F.xxhash64("path") % 2 == i)) for i in (0, 1, -1)]
    merged = extract.merge_states(halves[0].unionByName(halves[1]).unionByName(halves[2]))
    assert rows(extract.finish_states(merged), "*") == rows(extract.unique_strings(found), "*")


def test_extraction_needs_no_shuffle(spark):
    df = extract.occurrences(extract.scan_files(code(spark, CODE)))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_one_key_is_reduced_before_the_shuffle(spark):
    plan = extract.unique_strings(extract.occurrences(code(spark, CODE)))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max") > plan.index("Exchange")  # children are printed below


def test_read_code_files(spark, tmp_path):
    (tmp_path / "lib/sub").mkdir(parents=True)
    (tmp_path / "lib/a.dart").write_bytes(b"\xef\xbb\xbftext: 'x'")
    (tmp_path / "lib/sub/b.dart").write_text("text: 'é'", encoding="utf-8")
    (tmp_path / "lib/latin.dart").write_bytes("text: 'é'".encode("latin-1"))
    (tmp_path / "lib/big.dart").write_text("x" * (1024 * 1024 + 1))
    (tmp_path / "lib/exact.dart").write_text("é" * (1024 * 1024), encoding="utf-8")
    (tmp_path / "lib/c.txt").write_text("text: 'x'")
    got = {p.split("/lib/")[1]: c for p, c in rows(sources.read_code_files(spark, str(tmp_path)), "path", "content")}
    assert sorted(got) == ["a.dart", "big.dart", "exact.dart", "sub/b.dart"]
    assert got["a.dart"] == "text: 'x'"
    left = {(p.split("/lib/")[1], why) for p, why in rows(sources.unreadable_files(spark, str(tmp_path)), "path", "reason")}
    assert left == {("latin.dart", "not UTF-8")}


def test_a_large_file_is_scanned(spark):
    text = "// filler\n" * 150_000 + "title: 'Far Down'\n"
    found = extract.occurrences(extract.scan_files(code(spark, text)))
    assert {r["value"] for r in found.collect()} == {"Far Down"}


def test_decode_text(spark, tmp_path):
    for name, data in {"a.csv": "é".encode(), "b.csv": "é".encode("latin-1"), "c.csv": b"\xef\xbb\xbfx"}.items():
        (tmp_path / name).write_bytes(data)
    got = rows(sources.read_text_files(spark, str(tmp_path), "*.csv"), "content")
    assert got == [("x",), ("é",), ("é",)]


def test_bad_options(spark):
    with pytest.raises(ValueError):
        extract.drop_localized(code(spark, ""), "other")
