"""Extraction of user-visible string literals from source files.

``occurrences`` is one row per kept literal: path, pattern_id, match_ord, line_no, value. All work
up to there happens inside the row of a file, so scanning needs no shuffle. Order is explicit:
(path, pattern_id, match_ord) is the order in which a sequential scan meets the literals.
"""

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import (
    LITERAL_PATTERNS, LOCALIZATION_DIRS, LOCALIZATION_FILE_PARTS, MAX_FILE_CHARS, NUMBER_PATTERN,
    SYMBOLS_PATTERN,
)
from ..functions.text import TRIM_CHARS, key_of_lower, make_key, sql_text, with_ws
from ..sources.files import fits

ORDER = ("path", "pattern_id", "match_ord")
_VALUE = """['\"]([^'\"$]+)['\"]"""
_SPACES = TRIM_CHARS.replace("\u0085", "")  # what ``\\s`` of the patterns stands for
_NONE = "cast(array() as array<int>)"


def scan_files(
    files: DataFrame, skip_dirs: bool = False, suffix: str = ".dart", max_chars: int | None = None
) -> DataFrame:
    """Files worth scanning: right suffix, not localization code.

    ``skip_dirs`` also drops files below a localization directory, ``max_chars`` those that are longer.
    """
    kept = files.where(scannable(skip_dirs, suffix))
    if max_chars is not None:
        kept = skip_large(kept, max_chars)
    return kept


def scannable(skip_dirs: bool = False, suffix: str = ".dart") -> Column:
    """Whether the file of a path is worth scanning."""
    kept = F.expr(
        f"endswith(path, {sql_text(suffix)}) and not "
        + contains_any("lower(substring_index(path, '/', -1))", LOCALIZATION_FILE_PARTS)
    )
    if not skip_dirs:
        return kept
    folders = F.split(F.lower(F.col("path")), "/")
    return kept & ~F.arrays_overlap(
        F.slice(folders, F.lit(1), F.size(folders) - 1),
        F.array(*[F.lit(d) for d in LOCALIZATION_DIRS]),
    )


def skip_large(files: DataFrame, max_chars: int = MAX_FILE_CHARS) -> DataFrame:
    return files.where(fits(F.col("content"), max_chars))


def extract_literals(files: DataFrame, patterns: list[str] = LITERAL_PATTERNS) -> DataFrame:
    """Every literal of every pattern: path, pattern_id, match_ord, value."""
    hits = ", ".join(
        f"transform(_k{pid}, (j, i) -> struct({pid} as pattern_id, i + 1 as match_ord, get(_p, j + 1) as value))"
        for pid in range(1, len(patterns) + 1)
    )
    return _matched(files, patterns).selectExpr("path", f"inline(flatten(array({hits})))")


def extract_lines(files: DataFrame, patterns: list[str] = LITERAL_PATTERNS) -> DataFrame:
    """Literals with the line of the match start and whether they are localized already.

    A file is cut at its quotes once. A match is a piece without a ``$`` between two quotes behind a
    piece that ends with the pattern's head, so each pattern is tried on the pieces that end with its last
    character only.
    """
    return _numbered(files, patterns).selectExpr("path", f"inline({_all_hits(patterns)})")


def file_occurrences(files: DataFrame, localized_rule: str = "line") -> DataFrame:
    """The rows of ``occurrences``, and a row whose ``value`` is null for every file whose first literal is
    none of them: so every file has a row, without a join."""
    hits = _numbered(files, LITERAL_PATTERNS).selectExpr("path", f"posexplode_outer({_all_hits(LITERAL_PATTERNS)}) as (pos, hit)")
    hits = hits.select("path", "pos", "hit.*")
    localized = F.col("suffix_localized")
    if _line_rule(localized_rule):
        localized = localized | F.col("line_localized")
    kept = F.col("pos").isNotNull() & ignore_reason("value").isNull() & ~localized
    rows = hits.withColumn("_kept", F.coalesce(kept, F.lit(False))).where(F.col("_kept") | (F.coalesce("pos", F.lit(0)) == 0))
    return rows.select(*ORDER, "line_no", F.when(F.col("_kept"), F.col("value")).alias("value"))


def file_states(files: DataFrame, localized_rule: str = "line", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The columns ``keep`` and key, last, first, uses: what ``string_states`` says of every row's own literals, one row
    per key, and a row whose ``key`` is null for a file without any.
    """
    return packed_states(files, localized_rule, keep).selectExpr(*keep, "inline_outer(states)")


def packed_states(files: DataFrame, localized_rule: str = "line", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The columns ``keep`` and ``states``, an array of what :func:`file_states` has a row of each of.

    A file's hits stand in its row, so they are grouped there: sorted by key and place, a key is a run of them.
    """
    wanted = "not h.suffix_localized" + (" and not h.line_localized" if _line_rule(localized_rule) else "")
    hits = _numbered(files, LITERAL_PATTERNS, keep).selectExpr(*keep, f"""transform(filter({_all_hits(LITERAL_PATTERNS)}, h -> {wanted}),
        h -> struct(h as hit, {_trimmed('h.value')} as text)) as _hits""")
    kept = hits.selectExpr(*keep, f"""transform(filter(_hits, h -> {_noise('h.text')} is null),
        h -> struct(lower(h.hit.value) as low, h.hit as hit)) as _kept""")
    keyed = kept.select(*keep, F.sort_array(F.transform("_kept", lambda h: F.struct(
        key_of_lower(h["low"]).alias("key"), *[h["hit"][name].alias(name) for name in (*ORDER[1:], "line_no", "value")]))).alias("_s"))
    runs = keyed.selectExpr(*keep, "_s", f"""if(size(_s) = 0, {_NONE}, filter(sequence(0, size(_s) - 1),
        i -> i = 0 or get(_s, i).key <> get(_s, i - 1).key)) as _from""")
    ends = runs.selectExpr(*keep, "_s", "transform(_from, (i, n) -> struct(i, coalesce(get(_from, n + 1), size(_s)) - 1 as j)) as _runs")
    place = "path, get(_s, r.{0}).pattern_id as pattern_id, get(_s, r.{0}).match_ord as match_ord, get(_s, r.{0}).{1} as {1}"
    return ends.selectExpr(*keep, f"""transform(_runs, r -> struct(
        get(_s, r.i).key as key, struct({place.format('j', 'value')}) as last, struct({place.format('i', 'line_no')}) as first,
        cast(r.j - r.i + 1 as bigint) as uses)) as states""")


def _matched(files: DataFrame, patterns: list[str], keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The columns ``keep``, content, the pieces ``_p`` and per pattern the pieces ``_k`` that its matches begin in."""
    ids = range(1, len(patterns) + 1)
    heads = [_head(p) for p in patterns]
    ends = ", ".join(sql_text(c) for c in sorted({last for _, last in heads}))
    # Trimming takes a table of a piece's characters, so only pieces that end with a space are trimmed.
    cut = files.selectExpr(*keep, "content", "split(content, '[\"\\']') as _p").selectExpr(*keep, "content", "_p", f"""transform(
        transform(_p, p -> struct(p, right(p, 1) as c)), z -> if(instr({sql_text(_SPACES)}, z.c) = 0, z.c,
        right(trim(trailing {sql_text(_SPACES)} from z.p), 1))) as _c""")
    # Behind piece j stand a quote, the value, a quote and piece j + 2.
    valued = cut.selectExpr(*keep, "content", "_p", "_c", f"""if(size(_p) < 3, {_NONE}, filter(sequence(0, size(_p) - 3), j ->
        get(_c, j) in ({ends}) and get(_p, j + 1) <> '' and not contains(get(_p, j + 1), '$'))) as _j""")
    groups = {last: f"_e{n}" for n, last in enumerate(sorted({last for _, last in heads}))}
    sorted_out = valued.selectExpr(
        *keep, "content", "_p", "array_contains(transform(_j, (j, i) -> i > 0 and get(_j, i - 1) = j - 1), true) as _close",
        *[f"filter(_j, j -> get(_c, j) = {sql_text(last)}) as {name}" for last, name in groups.items()])
    found = sorted_out.selectExpr(*keep, "content", "_p", "_close", *[
        f"filter({groups[last]}, j -> {_word(patterns[pid - 1])}rlike(get(_p, j), {sql_text(head)})) as _k{pid}"
        for pid, (head, last) in enumerate(heads, 1)])
    return found.selectExpr(*keep, "content", "_p", *[f"if(_close, {_apart(f'_k{pid}')}, _k{pid}) as _k{pid}" for pid in ids])


def _word(pattern: str) -> str:
    """A piece without the word that a pattern starts with need not be decoded for it."""
    word = re.match(r"[A-Za-z]+(?=\\s)", pattern)
    return f"contains(get(_p, j), '{word[0]}') and " if word else ""


def _head(pattern: str) -> tuple[str, str]:
    """What a pattern wants before the opening quote, as a regex for the end of a piece, and its last character."""
    head = pattern.removesuffix(_VALUE)
    last = re.search(r"\\?(.)\\s[*+]$", head)
    if head == pattern or not last:
        raise ValueError(f"a pattern is a head, white space and a quoted value: {pattern}")
    return f"{with_ws(head)}\\z", last[1]


def _apart(found: str) -> str:
    """Matches do not overlap: of pieces in a row, whose matches share a quote, every other one counts."""
    rows = f"array_join(transform({found}, (j, i) -> if(i > 0 and get({found}, i - 1) = j - 1, '1', '0')), '')"
    kept = f"split(regexp_replace({rows}, '([01])1', '$1x'), '')"
    return f"""if(size({found}) < 2, {found},
        transform(filter(arrays_zip({found}, {kept}), z -> z.`1` <> 'x'), z -> z.`{found}`))"""


def _numbered(files: DataFrame, patterns: list[str], keep: tuple[str, ...] = ("path",)) -> DataFrame:
    found = " + ".join(f"size(_k{pid})" for pid in range(1, len(patterns) + 1))
    names = [*keep, "_p", *[f"_k{pid}" for pid in range(1, len(patterns) + 1)]]
    return _matched(files, patterns, keep).selectExpr(
        *names,
        f"if({found} > 0 and {_marked('content')}, transform(split(content, '\n'), line -> {_marked('line')}), null) as _marked",
        f"if({found} > 0, {_QUOTE_LINES}, null) as _lines",
    )


def _all_hits(patterns: list[str]) -> str:
    return "flatten(array(" + ", ".join(_hits(pid, p) for pid, p in enumerate(patterns, 1)) + "))"


def _marked(text: str, test: str = "contains") -> str:
    return f"({test}({text}, '.tr') or {test}({text}, '.i18n'))"


def _newlines(text: str) -> str:
    return f"(octet_length({text}) - octet_length(replace({text}, '\n', '')))"


# The line of every quote, in order: a line has as many pieces' ends as it has quotes.
_QUOTE_LINES = """flatten(transform(split(content, '\n'), (line, i) -> array_repeat(i + 1,
    2 * octet_length(line) - octet_length(replace(line, '\"', '')) - octet_length(replace(line, '\\'', '')))))"""


def _hits(pid: int, pattern: str) -> str:
    head, _ = _head(pattern)
    # The line of the opening quote, less the newlines of the head before it.
    line = f"get(_lines, j) - {_newlines(f'regexp_extract(get(_p, j), {sql_text(head)}, 0)')}"
    behind = "get(_p, m.j + 2)"
    trimmed = f"trim(leading {sql_text(TRIM_CHARS)} from {behind})"
    return f"""transform(transform(_k{pid}, j -> struct(j, {line} as line)), (m, i) -> struct(
          {pid} as pattern_id, i + 1 as match_ord, m.line as line_no, get(_p, m.j + 1) as value,
          _marked is not null and {_marked(behind)} and {_marked(trimmed, 'startswith')} as suffix_localized,
          _marked is not null and get(_marked, m.line - 1) as line_localized))"""


def ignore_reason(column: str = "value") -> Column:
    """The first noise rule a literal falls under, or null."""
    return F.expr(_reason(column))


def _reason(column: str) -> str:
    return _noise(_trimmed(column))


def _trimmed(column: str) -> str:
    return f"trim(both {sql_text(TRIM_CHARS)} from {column})"


def _noise(text: str) -> str:
    return f"""
        case when {text} = '' then 'empty'
             when rlike({text}, {sql_text(NUMBER_PATTERN)}) then 'number'
             when startswith({text}, 'http://') or startswith({text}, 'https://') then 'url'
             when startswith({text}, 'assets/') then 'asset'
             when startswith({text}, '/') or startswith({text}, '\\\\') then 'file_path'
             when rlike({text}, {sql_text(with_ws(SYMBOLS_PATTERN))}) then 'symbols'
             when contains({text}, 'L10n.') then 'l10n_reference' end
    """


def drop_noise(literals: DataFrame) -> DataFrame:
    return literals.where(ignore_reason("value").isNull())


def drop_localized(lines: DataFrame, rule: str = "line") -> DataFrame:
    """Drop localized literals: by suffix or any mark on the line, or (``suffix``) by suffix only."""
    localized = F.col("suffix_localized")
    if _line_rule(rule):
        localized = localized | F.col("line_localized")
    return lines.where(~localized)


def _line_rule(rule: str) -> bool:
    if rule not in ("line", "suffix"):
        raise ValueError(f"unknown rule: {rule}")
    return rule == "line"


def occurrences(files: DataFrame, dedupe: bool = False, localized_rule: str = "line") -> DataFrame:
    """Kept literals of files that were selected with ``scan_files``.

    A literal that two patterns match is two rows; ``dedupe`` keeps one per path, line and value.
    """
    kept = drop_localized(drop_noise(extract_lines(files)), localized_rule)
    kept = kept.select(*ORDER, "line_no", "value")
    if dedupe:
        kept = kept.groupBy("path", "line_no", "value").agg(
            F.min(F.struct("pattern_id", "match_ord")).alias("_first")
        ).select("path", "_first.*", "line_no", "value")
    return kept


def string_states(found: DataFrame) -> DataFrame:
    """Per key: last text and first place in scan order, use count. States of parts can be merged.

    Groups shrink before the shuffle, so a key that fills a third of the rows costs one row per task.
    """
    return found.groupBy(make_key("value").alias("key")).agg(
        F.max(F.struct(*ORDER, "value")).alias("last"),
        F.min(F.struct(*ORDER, "line_no")).alias("first"),
        F.count(F.lit(1)).alias("uses"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state per key out of several."""
    return states.groupBy("key").agg(
        F.max("last").alias("last"), F.min("first").alias("first"), F.sum("uses").alias("uses")
    )


def finish_states(states: DataFrame) -> DataFrame:
    return states.select(
        "key", "last.value", F.col("first.path").alias("first_path"),
        F.col("first.pattern_id").alias("first_pattern"),
        F.col("first.match_ord").alias("first_match"),
        F.col("first.line_no").alias("first_line"), "uses",
    )


def unique_strings(found: DataFrame) -> DataFrame:
    """One row per key: the last text in scan order, where the key was first met, its use count."""
    return finish_states(string_states(found))


def extract_summary(found: DataFrame) -> DataFrame:
    """Counts over all occurrences; ``empty_keys`` counts texts that lose every character."""
    key = make_key("value")
    return found.agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count_distinct(key).alias("unique_keys"),
        F.count_if(key == "").alias("empty_keys"),
    )


def contains_any(text: str, parts: list[str]) -> str:
    """SQL condition: the text contains one of the parts."""
    return "(" + " or ".join(f"contains({text}, {sql_text(p)})" for p in parts) + ")"
