"""Scalar text functions, as column expressions.

White space is spelled out once here, because the engines disagree on what ``\\s`` and ``trim``
cover: keys, trimming and patterns must treat NBSP, BOM and the Unicode spaces alike.
"""

from pyspark.sql import Column, functions as F

from .fixed_values import DEFAULT_COUNTRY

# Regex text of the white-space class, valid in Java and RE2 alike.
_ASCII_WS = r"\t\n\x0B\f\r "
_WIDE_WS = (
    r"\x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WS = _ASCII_WS + _WIDE_WS
# The characters that trimming removes: the class above and U+0085.
TRIM_CHARS = (
    "\t\n\x0b\x0c\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def with_ws(pattern: str) -> str:
    """Spell out ``\\s`` in a pattern, inside and outside brackets."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(WS if in_class else f"[{WS}]")
            i += 2
        elif two.startswith("\\"):
            out.append(two)
            i += 2
        else:
            in_class = pattern[i] == "[" or (in_class and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


def utrim(c) -> Column:
    """Trim Unicode white space on both sides (no regex, linear in the text)."""
    return F.trim(_c(c), F.lit(TRIM_CHARS))


def is_blank(c) -> Column:
    return utrim(c) == ""


def utf16_length(c) -> Column:
    """Length in UTF-16 units, the unit of the quota and size limits."""
    return (F.octet_length(F.encode(_c(c), "UTF-16BE")) / 2).cast("long")


def make_key(text) -> Column:
    """``Go Back?`` -> ``go_back``.

    Spaces beyond ASCII first become plain ones, in texts that may hold any; the patterns that see
    every character then need only a small ASCII class.
    """
    return key_of_lower(F.lower(_c(text)))


def key_of_lower(low: Column) -> Column:
    """The key of a text that is in lower case already."""
    ascii_only = F.octet_length(low) == F.length(low)
    plain = F.when(ascii_only, low).otherwise(F.regexp_replace(low, f"[{_WIDE_WS}]", " "))
    kept = F.regexp_replace(plain, rf"[^\w{_ASCII_WS}]+", "")
    return F.regexp_replace(F.trim(kept, F.lit("\t\n\x0b\x0c\r ")), f"[{_ASCII_WS}]+", "_")


def readable_key(key) -> Column:
    return F.replace(_c(key), F.lit("_"), F.lit(" "))


def fix_key(key) -> Column:
    """A key that starts with a digit gets the prefix ``key_``."""
    key = _c(key)
    return F.when(key.rlike("^[0-9]"), F.concat(F.lit("key_"), key)).otherwise(key)


def derive_locale(lang) -> Column:
    """``app_en`` -> ``en``, ``app_zh_hk`` -> ``zh_HK``."""
    code = _without_prefix(lang)
    return F.when(_parts(code) == 2, _upper_country(code)).otherwise(code)


def full_locale(lang) -> Column:
    """``app_en`` -> ``en_US``, ``app_zhcn`` -> ``zh_CN``; a bare language gets a country."""
    code = _without_prefix(lang)
    pairs = [F.lit(x) for pair in DEFAULT_COUNTRY.items() for x in pair]
    country = F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit("US"))
    return (
        F.when(code == "zhcn", F.lit("zh_CN"))
        .when(_parts(code) == 2, _upper_country(code))
        .otherwise(F.concat(code, F.lit("_"), country))
    )


def csv_escape(value) -> Column:
    value = _c(value)
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    special = value.contains(",") | value.contains('"') | value.contains("\n")
    return F.when(special, quoted).otherwise(value)


def json_escape(value) -> Column:
    """The five escapes a JSON bundle value carries."""
    return _escape(value, '"')


def dart_escape(value) -> Column:
    """The five escapes a Dart map value carries."""
    return _escape(value, "'")


def json_string(value) -> Column:
    """A complete JSON string with quotes, every control character escaped."""
    text = F.to_json(F.array(_c(value)))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def replacement_expr(key, fmt: str) -> Column:
    """Source text that reads the key at run time."""
    key = _c(key)
    if fmt == "getx":
        return F.concat(F.lit("'"), key, F.lit("'.tr"))
    return F.concat(F.lit("AppLocalizations.of(context)."), key)


def relative_path(path, base: str) -> Column:
    path = _c(path)
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 2), F.length(path))).otherwise(path)


def preview_cell(value) -> Column:
    """A cell of at most 20 characters."""
    value = _c(value)
    return F.when(F.length(value) > 20, F.concat(F.left(value, F.lit(17)), F.lit("..."))).otherwise(value)


def age_bucket(modified, as_of) -> Column:
    """Whole days between two instants as ``today``, ``yesterday``, ``N days ago``, ``N weeks ago``."""
    days = F.extract(F.lit("DAY"), _c(as_of) - _c(modified)).cast("long")
    weeks = F.floor(days / 7)
    return (
        F.when(days == 0, F.lit("today"))
        .when(days == 1, F.lit("yesterday"))
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(weeks > 1, F.concat(weeks.cast("string"), F.lit(" weeks ago")))
        .otherwise(F.concat(weeks.cast("string"), F.lit(" week ago")))
    )


def sql_text(value: str) -> str:
    """A string as a literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"



def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _without_prefix(lang) -> Column:
    return F.regexp_replace(_c(lang), "^app_", "")


def _parts(code: Column) -> Column:
    return F.size(F.split(code, "_"))


def _upper_country(code: Column) -> Column:
    return F.concat(
        F.substring_index(code, "_", 1), F.lit("_"), F.upper(F.substring_index(code, "_", -1))
    )


def _escape(value, quote: str) -> Column:
    out = _c(value)
    for raw, escaped in (("\\", "\\\\"), (quote, "\\" + quote), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out
