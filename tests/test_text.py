import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stringloom.functions import fixed_values, text
from stringloom.functions.fields import has_language_codes, split_fields


@pytest.mark.parametrize("value, key", [
    ("Select Image", "select_image"), ("Loading...", "loading"), ("Go Back?", "go_back"),
    ("Photo was saved", "photo_was_saved"), ("1000_am_1200_pm", "1000_am_1200_pm"),
    ("Café", "caf"), ("مرحبا", ""), ("  a  b\t\nc ", "a_b_c"), ("a\u0085b", "ab"), ("\ufeffHi  there", "hi_there"),
])
def test_make_key(one, value, key):
    assert one(text.make_key("x"), x=value) == key


@pytest.mark.parametrize("lang, short, full", [
    ("app_en", "en", "en_US"), ("app_zh_hk", "zh_HK", "zh_HK"), ("app_zhcn", "zhcn", "zh_CN"),
    ("app_zh_tw", "zh_TW", "zh_TW"), ("app_pt_br", "pt_BR", "pt_BR"), ("app_de", "de", "de_DE"),
    ("app_xx", "xx", "xx_US"), ("a_b_c", "a_b_c", "a_b_c_US"),
])
def test_locales(one, lang, short, full):
    assert one(text.derive_locale("x"), x=lang) == short
    assert one(text.full_locale("x"), x=lang) == full


def test_escapes(one):
    value = 'a"b\\c\'d\n\r\te$'
    assert one(text.json_escape("x"), x=value) == 'a\\"b\\\\c\'d\\n\\r\\te$'
    assert one(text.dart_escape("x"), x=value) == "a\"b\\\\c\\'d\\n\\r\\te$"
    assert one(text.csv_escape("x"), x='say "hi"') == '"say ""hi"""'
    assert one(text.csv_escape("x"), x="a,b") == '"a,b"'
    assert one(text.csv_escape("x"), x="plain") == "plain"
    assert one(text.json_string("x"), x='a"\u0001b') == '"a\\"\\u0001b"'


def test_replacement_and_paths(one):
    assert one(text.replacement_expr("x", "arb"), x="ok") == "AppLocalizations.of(context).ok"
    assert one(text.replacement_expr("x", "getx"), x="ok") == "'ok'.tr"
    assert one(text.replacement_expr("x", "json"), x="ok") == "AppLocalizations.of(context).ok"
    assert one(text.relative_path("x", "/home/me"), x="/home/me/lib/a.dart") == "lib/a.dart"
    assert one(text.relative_path("x", "/home/me"), x="lib/a.dart") == "lib/a.dart"
    assert one(text.fix_key("x"), x="1_am") == "key_1_am"
    assert one(text.readable_key("x"), x="go_back") == "go back"
    assert one(text.preview_cell("x"), x="x" * 21) == "x" * 17 + "..."
    assert one(text.preview_cell("x"), x="x" * 20) == "x" * 20


@pytest.mark.parametrize("hours, bucket", [
    (0, "today"), (23, "today"), (24, "yesterday"), (50, "2 days ago"), (24 * 7, "1 week ago"), (24 * 20, "2 weeks ago"),
])
def test_age_bucket(spark, hours, bucket):
    now = datetime.datetime(2024, 3, 1, 12)
    df = spark.createDataFrame([(now - datetime.timedelta(hours=hours), now)], "a timestamp, b timestamp")
    assert df.select(text.age_bucket("a", F.col("b"))).first()[0] == bucket


def test_utf16_length(one):
    assert one(text.utf16_length("x"), x="a😀é") == 4


def test_fixed_values():
    assert len(fixed_values.LANGUAGE_CODES) == len(fixed_values.LANGUAGE_NAMES) == 70
    assert len(fixed_values.LITERAL_PATTERNS) == 10
    assert len(fixed_values.SERVICE_LANGUAGES) == len(set(fixed_values.SERVICE_LANGUAGES)) == 110


def escaped_fields(line):
    """Field splitting as a loop over characters."""
    out, field, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"' and quoted and line[i + 1:i + 2] == '"':
            field += '"'
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out.append(field)
            field = ""
        else:
            field += c
        i += 1
    return [*out, field]


def toggled_fields(line):
    out, field, quoted = [], "", False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out.append(field.strip())
            field = ""
        else:
            field += c
    return [*out, field.strip()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet='",a b\r', max_size=14), min_size=300, max_size=400))
def test_split_fields(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = df.select("line", split_fields(F.col("line")), split_fields(F.col("line"), "toggle")).collect()
    for line, escaped, toggled in got:
        assert escaped == escaped_fields(line)
        assert toggled == toggled_fields(line)


def test_long_field(one):
    line = 'a,"' + 'x""' * 200_000 + '",b'
    assert one(F.transform(split_fields(F.col("x")), F.length), x=line) == [1, 400_000, 1]


@pytest.mark.parametrize("line, valid", [
    (",app_en", True), ("app_en,x", False), (",zh_hk", True), (",a_", False), (",1,2", False), ("", False),
])
def test_header_rule(one, line, valid):
    assert one(has_language_codes(split_fields(F.col("x"))), x=line) is valid
