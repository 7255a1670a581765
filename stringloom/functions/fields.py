"""Field splitting of one sheet line, as column expressions.

A comma separates fields unless an odd number of quotes precedes it. Both dialects split alike and
differ only in how a field is cleaned. The patterns are possessive, so a long field needs neither
backtracking nor recursion.
"""

from pyspark.sql import Column, functions as F

from .text import utrim

_QUOTED = r'"((?:[^"]++|"")*+)(?:"|\z)'
_FIELD = r',((?:[^",]++|"(?:[^"]++|"")*+(?:"|\z))*+)'


def split_fields(line: Column, dialect: str = "escaped") -> Column:
    """Fields of a line. ``escaped``: ``""`` inside quotes is a quote. ``toggle``: quotes only
    switch quoting and each field is trimmed."""
    if dialect not in ("escaped", "toggle"):
        raise ValueError(f"unknown dialect: {dialect}")
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), 1)
    return F.transform(fields, _unquote if dialect == "escaped" else _strip_quotes)


def first_field(line: Column) -> Column:
    """The first of the ``escaped`` fields of a line, without splitting the others off."""
    return _unquote(F.regexp_extract(F.concat(F.lit(","), line), _FIELD, 1))


def has_language_codes(fields: Column) -> Column:
    """True when a field after the first looks like a language code."""
    return F.exists(
        F.slice(fields, F.lit(2), F.greatest(F.size(fields), F.lit(1))),
        lambda f: utrim(f).startswith("app_") | (utrim(f).contains("_") & (F.length(utrim(f)) > 2)),
    )


def _unquote(field: Column) -> Column:
    bare = F.replace(F.regexp_replace(field, _QUOTED, "$1"), F.lit('""'), F.lit('"'))
    return F.when(field.contains('"'), bare).otherwise(field)


def _strip_quotes(field: Column) -> Column:
    return utrim(F.replace(field, F.lit('"'), F.lit("")))
