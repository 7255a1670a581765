"""DuckDB text for the queries: the same results, computed another way where there is one."""

from ..functions.fixed_values import (
    DEFAULT_COUNTRY, LANGUAGE_CODES, LANGUAGE_NAMES, LITERAL_PATTERNS, LOCALIZATION_DIRS,
    LOCALIZATION_FILE_PARTS, NUMBER_PATTERN, REWRITE_SKIP_PARTS, SERVICE_LANGUAGES, SYMBOLS_PATTERN,
)
from ..functions.text import TRIM_CHARS, WS, with_ws
from .inputs import BROKEN, view_sql
from .queries import AS_OF, QUOTA, SHOWN, TARGETS

ORACLES: dict[str, str] = {}

_NL = "chr(10)"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _trim(x: str) -> str:
    return f"trim({x}, {_q(TRIM_CHARS)})"


def _key(x: str) -> str:
    kept = f"regexp_replace(lower({x}), '[^\\w{WS}]', '', 'g')"
    return f"regexp_replace({_trim(kept)}, '[{WS}]+', '_', 'g')"


def _any(x: str, parts) -> str:
    return "(" + " or ".join(f"contains({x}, {_q(p)})" for p in parts) + ")"


def _fix(x: str) -> str:
    return f"case when regexp_matches({x}, '^[0-9]') then 'key_' || {x} else {x} end"


def _escape(x: str, quote: str) -> str:
    for raw, new in (("\\", "\\\\"), (quote, "\\" + quote)):
        x = f"replace({x}, {_q(raw)}, {_q(new)})"
    for code, new in ((10, "\\n"), (13, "\\r"), (9, "\\t")):
        x = f"replace({x}, chr({code}), '{new}')"
    return x


def _csv(x: str) -> str:
    return (f"case when contains({x}, ',') or contains({x}, '\"') or contains({x}, {_NL}) "
            f"then '\"' || replace({x}, '\"', '\"\"') || '\"' else {x} end")


def _base(x: str) -> str:
    return f"regexp_replace({x}, '^app_', '')"


def _country(x: str) -> str:
    return f"split_part({x}, '_', 1) || '_' || upper(split_part({x}, '_', 2))"


def _locale(x: str) -> str:
    b = _base(x)
    return f"case when len(string_split({b}, '_')) = 2 then {_country(b)} else {b} end"


def _full_locale(x: str) -> str:
    b = _base(x)
    countries = " ".join(f"when '{k}' then '{v}'" for k, v in DEFAULT_COUNTRY.items())
    return (f"case when {b} = 'zh_hk' then 'zh_HK' when {b} = 'zhcn' then 'zh_CN' when {b} = 'zh_tw' then 'zh_TW' "
            f"when len(string_split({b}, '_')) = 2 then {_country(b)} "
            f"else {b} || '_' || case {b} {countries} else 'US' end end")


def _utf16(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _reason(x: str) -> str:
    t = _trim(x)
    return f"""case when {t} = '' then 'empty'
      when regexp_matches({t}, '{NUMBER_PATTERN}') then 'number'
      when starts_with({t}, 'http://') or starts_with({t}, 'https://') then 'url'
      when starts_with({t}, 'assets/') then 'asset'
      when starts_with({t}, '/') or starts_with({t}, '\\') then 'file_path'
      when regexp_matches({t}, {_q(with_ws(SYMBOLS_PATTERN))}) then 'symbols'
      when contains({t}, 'L10n.') then 'l10n_reference' end"""


def _hits() -> str:
    """One row per match, with the text before it rebuilt from gaps and matches."""
    parts = []
    for pid, pattern in enumerate(LITERAL_PATTERNS, 1):
        p = _q(with_ws(pattern))
        parts.append(f"""
          select path, content, {pid} as pattern_id, regexp_split_to_array(content, {p}) as g,
                 regexp_extract_all(content, {p}, 0) as m, regexp_extract_all(content, {p}, 1) as v
          from scanned where regexp_matches(content, {p})""")
    return " union all ".join(parts)


_LINES = f"""
  select path, pattern_id, i as match_ord,
         cast(1 + length(before) - length(replace(before, {_NL}, '')) as int) as line_no, value,
         (starts_with(behind, '.tr') or starts_with(behind, '.i18n')) as suffix_localized,
         contains(string_split(content, {_NL})[1 + length(before) - length(replace(before, {_NL}, ''))], '.tr')
           or contains(string_split(content, {_NL})[1 + length(before) - length(replace(before, {_NL}, ''))], '.i18n')
           as line_localized
  from (select path, content, pattern_id, i, v[i] as value,
               array_to_string(g[1:i], '') || coalesce(array_to_string(m[1:i - 1], ''), '') as before,
               {_trim("g[i + 1] || coalesce(m[i + 1], '')")} as behind
        from (select *, unnest(range(1, len(m) + 1)) as i from hits))
"""
_ROWS = f"""
  select path, cast(i as int) as row_no, lines[i] as line
  from (select path, lines, unnest(range(1, len(lines) + 1)) as i
        from (select path, list_filter(string_split(content, {_NL}), lambda x: {_trim('x')} <> '') as lines from sheet_files))
"""
_FIELDS = (
    "list_transform(regexp_extract_all(',' || line, ',((?:[^\",]|\"(?:[^\"]|\"\")*(?:\"|$))*)', 1), "
    "lambda f: replace(regexp_replace(f, '\"((?:[^\"]|\"\")*)(?:\"|$)', '\\1', 'g'), '\"\"', '\"'))"
)
_CELLS = f"""
  select path, row_no, cast(i - 1 as int) as col_no, f[i] as value
  from (select path, row_no, f, unnest(range(1, len(f) + 1)) as i from (select path, row_no, {_FIELDS} as f from rows))
"""
_CTES = {
    "code_files": view_sql("code_files"),
    "scanned": f"""
      select path, content from code_files
      where path like '%.dart' and not {_any("lower(split_part(path, '/', -1))", LOCALIZATION_FILE_PARTS)}
        and {_utf16('content')} <= 1048576""",
    "hits": _hits(),
    "lines": _LINES,
    "literals": "select path, pattern_id, match_ord, value, line_no from lines",
    "found": f"""
      select path, pattern_id, match_ord, line_no, value from lines
      where not suffix_localized and not line_localized and {_reason('value')} is null""",
    "strings": f"""
      select key, arg_max(value, o) as value, min(o).path as first_path, min(o).pattern_id as first_pattern,
             min(o).match_ord as first_match, arg_min(line_no, o) as first_line, count(*) as uses
      from (select {_key('value')} as key, value, line_no,
                   {{'path': path, 'pattern_id': pattern_id, 'match_ord': match_ord}} as o from found)
      group by key""",
    "catalog": view_sql("catalog"),
    "entries": view_sql("entries"),
    "merged": """
      select coalesce(s.key, c.key) as key,
             case when c.key is null then s.value when s.key is null then c.english
                  when c.english <> '' then c.english else s.value end as english,
             case when c.key is null then 'new' when s.key is null then 'removed'
                  when c.english <> s.value then 'updated' else 'preserved' end as status,
             c.english as old_english, s.value as new_english, first_path, first_pattern, first_match, c.ord, c.app_fr
      from strings s full join catalog c on s.key = c.key""",
    "sheet_files": view_sql("sheet_files"),
    "break_files": view_sql("break_files"),
    "rows": _ROWS,
    "cells": _CELLS,
    "slots": f"""
      select path, col_no, {_trim('value')} as lang from cells
      where row_no = 2 and col_no >= 1 and {_trim('value')} <> ''""",
    "unpivoted": f"""
      select k.path as sheet, k.row_no, {_trim('k.value')} as raw_key, {_key(_trim('k.value'))} as key,
             cast(row_number() over (partition by k.path, k.row_no order by s.col_no) as int) as ord, s.lang,
             coalesce({_trim('c.value')}, '') as value
      from cells k join slots s on s.path = k.path
      left join cells c on c.path = k.path and c.row_no = k.row_no and c.col_no = s.col_no
      where k.col_no = 0 and k.row_no >= 4 and {_trim('k.value')} <> ''""",
    "long": f"select *, {_key('raw_key')} as key from ({view_sql('sheet_long')})",
    "values_": """
      select * from (
        select sheet, lang, key, min(ord) as ord, arg_max(value, row_no) filter (where value <> '') as value,
               max(row_no) filter (where value <> '') as used_row, min(row_no) filter (where value <> '') as first_filled,
               min(row_no) as first_row, max(row_no) as last_row
        from long group by sheet, lang, key) where value is not null""",
    "keys": """
      select sheet, key, count(distinct row_no) as n_rows, min(row_no) as first_row, max(row_no) as last_row
      from long group by sheet, key""",
    "active": "select sheet, lang, min(ord) as ord from long where value <> '' group by sheet, lang",
    "missing": """
      select k.sheet, k.key, k.first_row, a.lang, a.ord from keys k join active a on a.sheet = k.sheet
      where not exists (select 1 from values_ v where v.sheet = k.sheet and v.key = k.key and v.lang = a.lang)""",
    "english": view_sql("english_rows"),
    "memory": view_sql("memory"),
    "work": "select sheet, row_no, english, lang from english cross join "
            f"(values {', '.join(f'({_q(t)})' for t in TARGETS)}) t(lang) where english <> ''",
    "translated": """
      select w.*, m.text from work w left join (select english, lang, min(text) as text from memory group by all) m
      on m.english = w.english and m.lang = w.lang""",
    "rewritable": f"select * from found where not {_any('lower(path)', REWRITE_SKIP_PARTS)}",
    "matched": f"""
      select f.path, f.pattern_id, f.match_ord, f.line_no, f.value, coalesce(e.key, l.key, t.key) as key,
             case when e.key is not null then 1 when l.key is not null then 2 when t.key is not null then 3 end as tier
      from rewritable f
      left join (select value, arg_min(key, {{'path': path, 'ord': ord}}) as key from entries group by value) e on e.value = f.value
      left join (select lower(value) as value, arg_min(key, {{'path': path, 'ord': ord}}) as key from entries group by 1) l on l.value = lower(f.value)
      left join (select value, arg_min(key, {{'path': path, 'ord': ord}}) as key from entries group by value) t on t.value = {_trim('f.value')}""",
}
_NEEDS = {
    "scanned": ["code_files"], "hits": ["scanned"], "lines": ["hits"], "literals": ["lines"], "found": ["lines"],
    "strings": ["found"], "merged": ["strings", "catalog"], "rows": ["sheet_files"], "cells": ["rows"],
    "slots": ["cells"], "unpivoted": ["cells", "slots"], "values_": ["long"], "keys": ["long"], "active": ["long"],
    "missing": ["keys", "active", "values_"], "work": ["english"], "translated": ["work", "memory"],
    "rewritable": ["found"], "matched": ["rewritable", "entries"],
}


def _with(names: list[str], select: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    # Materialized: several steps read the same table, and DuckDB would scan the texts each time.
    return "with " + ",\n".join(f"{n} as materialized ({_CTES[n]})" for n in order) + "\n" + select


def oracle(name: str, needs: list[str], select: str) -> None:
    ORACLES[name] = _with(needs, select) if needs else select


# --- sources -----------------------------------------------------------------------
oracle("scan_files", ["scanned"], "select path, length(content) as n_chars from scanned")
oracle("scan_files_skip_dirs", ["scanned"], f"""
  select path from scanned
  where not list_has_any(string_split(lower(path), '/')[1:-2], [{', '.join(_q(d) for d in LOCALIZATION_DIRS)}])""")
oracle("decode_text", [], """
  select 'part ' || cast(p_partkey as varchar) as id, p_name || chr(233) as content from part
  union all select 'doc ' || cast(doc_id as varchar), text from documents""")
oracle("sheet_rows", ["rows"], "select path, row_no, line from rows")
oracle("sheet_cells", ["cells"], "select path, row_no, col_no, value from cells")
oracle("sheet_cells_toggle", ["sheet_files"], f"""
  select path, row_no, cast(i - 1 as int) as col_no, {_trim("replace(f[i], chr(34), '')")} as value from (
    select path, row_no, f, unnest(range(1, len(f) + 1)) as i from (
      select path, row_no, regexp_extract_all(',' || line, ',((?:[^",]|"[^"]*(?:"|$))*)', 1) as f from (
        select path, cast(i as int) as row_no, lines[i] as line from (
          select path, lines, unnest(range(1, len(lines) + 1)) as i from (
            select path, list_filter(string_split(content, {_NL}), lambda x: x <> '') as lines from sheet_files)))))""")
oracle("lang_columns", ["slots"], "select path, col_no, lang from slots")
oracle("read_catalog", ["cells"], f"""
  select path, key, arg_max(english, row_no) as english, cast(min(row_no) - 4 as int) as ord,
         arg_max(f, row_no)[1] as app_fr, arg_max(f, row_no)[2] as app_ar, arg_max(f, row_no)[3] as app_zh_hk
  from (select path, row_no, {_key(_trim("max(value) filter (where col_no = 0)"))} as key,
               coalesce({_trim("max(value) filter (where col_no = 1)")}, '') as english,
               [{', '.join(_trim(f"max(value) filter (where col_no = {c})") for c in (2, 3, 4))}] as f
        from cells where row_no >= 4 group by path, row_no) group by path, key""")
for _name, _skip in (("arb", True), ("json", False)):
    _entries = f"""
      select path, keys, unnest(range(1, len(keys) + 1)) as i, content
      from (select path, content, json_keys(content) as keys from ({view_sql(_name + '_files')}))"""
    _ord = "" if _skip else "cast(i - 1 as int) as ord, "
    oracle(f"load_{_name}", [], f"""
      select path, {_ord}keys[i] as key, json_extract_string(content, '$."' || keys[i] || '"') as value
      from ({_entries}) {"where not starts_with(keys[i], '@@')" if _skip else ''}""")
oracle("load_getx", [], f"""
  select path, cast(i - 1 as int) as ord, k[i] as key, v[i] as value from (
    select path, k, v, unnest(range(1, len(k) + 1)) as i from (
      select path, regexp_extract_all(content, {_q(f"'([^']+)':[{WS}]*'([^']*)'")}, 1) as k,
             regexp_extract_all(content, {_q(f"'([^']+)':[{WS}]*'([^']*)'")}, 2) as v from ({view_sql('getx_files')})))""")
_DART_ENTRY = r"'[^']+':\s*'[^']*'"
oracle("bundle_problems", [], f"""
  select * from (
    select path, case when trim(content) = '' then 'empty'
        when not ends_with(path, '.dart') and (not json_valid(content) or json_type(try_cast(content as json)) <> 'OBJECT') then 'not a JSON object'
        when ends_with(path, '.dart') and not regexp_matches(content, {_q(_DART_ENTRY)}) then 'no entries' end as problem
    from (select path, {BROKEN} as content from (
      {view_sql("arb_files")} union all {view_sql("json_files")} union all {view_sql("getx_files")})))
  where problem is not null""")
oracle("load_bundles", [], f"""
  select key, arg_max(value, path) as value, min(path) as path from (
    select 'k_' || cast(c_custkey % 600 as varchar) as key, c_name as value, p as path
    from customer cross join (select unnest(['.arb', '.json', '.dart']) as s) x,
      lateral (select 'l10n/app_' || lpad(cast(c_custkey as varchar), 12, '0') || s as p)
    union all
    select 'shared', 'Shared ' || cast(c_custkey as varchar), 'l10n/app_' || lpad(cast(c_custkey as varchar), 12, '0') || s
    from customer cross join (select unnest(['.arb', '.json', '.dart']) as s) x) group by key""")

# --- scalar functions ----------------------------------------------------------------
oracle("make_key", [], f"""
  select kind, id, {_key('text')} as key, {_key('text')} = '' as is_empty from (
    select 'doc' as kind, doc_id as id, text from documents
    union all select 'turn', conv_id * 1000 + turn, text from conversations)""")
oracle("readable_key", [], f"select p_partkey, replace({_key('p_name')}, '_', ' ') as readable from part")
oracle("derive_locale", [], f"select c_custkey, lang, {_locale('lang')} as locale from ({view_sql('locales')})")
oracle("full_locale", [], f"select c_custkey, lang, {_full_locale('lang')} as locale from ({view_sql('locales')})")
oracle("fix_key", [], f"""
  select p_partkey, {_fix('k')} as key from (select p_partkey,
    case when p_partkey % 2 = 0 then cast(p_size as varchar) || '_' || {_key('p_name')} else {_key('p_name')} end as k from part)""")
oracle("csv_escape", [], f"select doc_id, {_csv('text')} as cell from documents")
oracle("json_escape", [], f"select page_id, {_escape('html', chr(34))} as escaped from pages")
oracle("dart_escape", [], f"select page_id, {_escape('html', chr(39))} as escaped from pages")
oracle("replacement_expr", [], f"""
  select p_partkey, 'AppLocalizations.of(context).' || k as arb, chr(39) || k || chr(39) || '.tr' as getx,
         'AppLocalizations.of(context).' || k as json from (select p_partkey, {_key('p_name')} as k from part)""")
oracle("relative_path", ["code_files"], """
  select path, case when starts_with(path, 'lib/screens') then path[length('lib/screens') + 2:] else path end as relative
  from code_files""")
oracle("age_bucket", [], f"""
  select event_id, case when d = 0 then 'today' when d = 1 then 'yesterday' when d < 7 then cast(d as varchar) || ' days ago'
    when d // 7 > 1 then cast(d // 7 as varchar) || ' weeks ago' else cast(d // 7 as varchar) || ' week ago' end as age
  from (select event_id, (epoch_us(timestamp '{AS_OF}') - epoch_us(ts)) // 86400000000 as d from events)""")

# --- extraction ----------------------------------------------------------------------
oracle("extract_literals", ["literals"], "select path, pattern_id, cast(match_ord as int) as match_ord, value from literals")
oracle("extract_lines", ["lines"], "select * replace (cast(match_ord as int) as match_ord) from lines")
oracle("ignore_reason", ["lines"], f"""
  select path, pattern_id, cast(match_ord as int) as match_ord, coalesce({_reason('value')}, 'kept') as reason from lines""")
oracle("extract_clean", ["lines"], f"""
  select path, pattern_id, cast(match_ord as int) as match_ord, value from lines where {_reason('value')} is null""")
oracle("drop_localized", ["lines"], """
  select 'line' as rule, path, pattern_id, cast(match_ord as int) as match_ord, line_no, value from lines
  where not suffix_localized and not line_localized
  union all
  select 'suffix', path, pattern_id, cast(match_ord as int), line_no, value from lines where not suffix_localized""")
oracle("skip_large", [], f"""
  select path from ({view_sql('document_files')}) where {_utf16('content')} <= 5000""")
oracle("occurrences", ["found"], "select * replace (cast(match_ord as int) as match_ord) from found")
oracle("occurrences_distinct", ["found"], """
  select path, pattern_id, cast(match_ord as int) as match_ord, line_no, value from found
  qualify row_number() over (partition by path, line_no, value order by pattern_id, match_ord) = 1""")
oracle("unique_strings", ["strings"], "select * replace (cast(first_match as int) as first_match) from strings")
oracle("extract_summary", ["found"], f"""
  select count(*) as occurrences, count(distinct {_key('value')}) as unique_keys,
         count(*) filter (where {_key('value')} = '') as empty_keys from found""")

# --- sheets --------------------------------------------------------------------------
_CODE = _trim("value")
oracle("valid_header_rows", ["cells"], f"""
  select distinct path, row_no from cells
  where col_no >= 1 and (starts_with({_CODE}, 'app_') or (contains({_CODE}, '_') and length({_CODE}) > 2))""")
oracle("sheet_problems", ["rows", "slots"], """
  select path, 'fewer rows than the header row' as problem, 9 as header_row from rows group by path having max(row_no) < 9
  union all
  select path, 'no language columns', 2 from rows where path not in (select path from slots) group by path""")
oracle("sheet_keys", ["cells"], f"""
  select path, row_no, {_CODE} as raw_key, {_key(_CODE)} as key from cells
  where col_no = 0 and row_no >= 4 and {_CODE} <> ''""")
oracle("row_range", ["rows"], "select path, row_no, line from rows where row_no between 4 and 6")
ORACLES["preview_sheet"] = _with(["cells"], "select path, row_no, " + ", ".join(
    f"coalesce(max(case when length(value) > 20 then left(value, 17) || '...' else value end) "
    f"filter (where col_no = {c}), '') as c{c + 1}" for c in range(5)
) + " from cells where row_no <= 5 group by path, row_no")
oracle("unpivot_sheet", ["unpivoted"], "select * from unpivoted where value <> ''")
ORACLES["unpivot_lines"] = ORACLES["unpivot_sheet"]
_RECORDS = f"""
  select path, cast(i as int) as row_no, lines[i] as line
  from (select path, lines, unnest(range(1, len(lines) + 1)) as i
        from (select path, list_filter(regexp_extract_all({_NL} || content, '\\n((?:[^"\\n]|"[^"]*(?:"|$))*)', 1), lambda x: {_trim('x')} <> '') as lines
              from break_files))"""
oracle("sheet_records", ["break_files"], _RECORDS)
# A file ends with a line break; a quote left open takes it in.
oracle("sheet_records_scan", ["break_files"], f"""
  select cast(regexp_extract(path, '([0-9]+)', 1) as bigint) as sheet, row_no, line from ({_RECORDS})""")
oracle("catalog_roundtrip", ["merged"], f"""
  select key, {_trim("english || chr(10) || '\"' || key || '\",' || chr(10) || chr(10) || 'end'")} as english, coalesce({_trim("app_fr")}, '') as app_fr from merged""")
oracle("last_value_per_key", ["values_"], "select * from values_")
oracle("active_langs", ["active"], "select * from active")
oracle("keys_per_language", ["long"], """
  select sheet, lang, min(ord) as ord, count(distinct key) filter (where value <> '') as n_keys from long group by sheet, lang""")
oracle("pivot_catalog", ["values_"], "select sheet, key, " + ", ".join(
    f"coalesce(max(value) filter (where lang = '{lang}'), '') as {lang}" for lang in SHOWN
) + " from values_ group by sheet, key")
oracle("select_langs", ["long"], """
  select sheet, lang, ord, choice from (select sheet, lang, min(ord) as ord from long group by sheet, lang)
  cross join (values ('es_ar'), ('top10'), ('numbers'), ('all')) c(choice)
  where case choice when 'es_ar' then lang like '%es%' or lang like '%ar%' when 'top10' then ord <= 10
             when 'numbers' then ord in (2, 4) else true end""")
oracle("supported_langs", [], f"""
  select c_custkey, {_base('lang')} as code from ({view_sql('locales')})
  where upper({_base('lang')}) in {_in(SERVICE_LANGUAGES)}""")

# --- quality -------------------------------------------------------------------------
oracle("duplicate_keys", ["keys"], "select * from keys where n_rows > 1")
oracle("duplicate_rows", ["long", "keys"], """
  select distinct l.sheet, l.key, l.row_no from long l join keys k on k.sheet = l.sheet and k.key = l.key where n_rows > 1""")
oracle("duplicate_lines", ["long", "keys"], """
  select sheet, key, row_no // 1000 as block, string_agg(cast(row_no as varchar), ', ' order by row_no) as rows
  from (select distinct l.sheet, l.key, l.row_no from long l join keys k on k.sheet = l.sheet and k.key = l.key where n_rows > 1)
  group by all""")
oracle("missing_pairs", ["missing"], "select sheet, key, lang, ord from missing")
oracle("missing_by_key", ["missing"], "select sheet, key, string_agg(lang, ', ' order by ord) as langs from missing group by sheet, key")
_STATS = """
  select k.sheet, (select count(*) from active a where a.sheet = k.sheet) as n_active, sum(n_rows) as total_rows,
         count(*) as unique_keys, count(*) filter (where n_rows > 1) as duplicate_keys,
         coalesce(sum(n_rows) filter (where regexp_matches(key, '^[0-9]')), 0) as fixed_keys,
         (select count(distinct m.key) from missing m where m.sheet = k.sheet) as missing_keys
  from keys k group by k.sheet"""
oracle("generation_stats", ["missing"], f"""
  select sheet, n_active + case f when 'getx' then 1 else 0 end as files_created, cast(total_rows as bigint) as total_rows,
         unique_keys, missing_keys, duplicate_keys, cast(fixed_keys as bigint) as fixed_keys, f as format
  from ({_STATS}) cross join (values ('arb'), ('getx'), ('json')) x(f)""")
oracle("missing_report", ["missing"], f"""
  select sheet, first_row, key, '[' || {_fix('key')} || ']' || {_NL} || '  Missing in: ' || string_agg(lang, ', ' order by ord) || {_NL} as text
  from missing group by sheet, key, first_row
  union all
  select sheet, -1, '', '📊 ARB Generation Report' || {_NL} || 'Generated: {AS_OF}' || {_NL} || 'Total keys: ' || cast(cast(total_rows as bigint) as varchar)
    || {_NL} || 'ARB files created: ' || cast(n_active as varchar) || {_NL} || 'Keys with missing translations: ' || cast(missing_keys as varchar)
    || {_NL} || {_NL} || repeat('━', 50) || {_NL} || 'Missing Translations (by key):' || {_NL} || repeat('━', 50) || {_NL}
  from ({_STATS}) where missing_keys > 0""")


# --- bundles -------------------------------------------------------------------------
def _bundle(fmt: str) -> str:
    if fmt == "arb":
        entries = f"""select sheet, lang, {_fix('key')} as k, arg_max(value, last_row) as v, min(first_row) as pos
                      from values_ group by sheet, lang, {_fix('key')}"""
    else:
        entries = "select sheet, lang, key as k, value as v, first_filled as pos from values_"
    comma = "case when pos = max(pos) over (partition by sheet, lang) then '' else ',' end"
    if fmt == "getx":
        value = _escape("v", "'")
        text = (f"'  ' || chr(39) || {_escape('k', chr(39))} || chr(39) || ': ' || chr(39) || "
                f"replace({value}, '$', '\\$') || chr(39) || {comma}")
        head, foot = "'final Map<String, String> ' || lang || ' = {'", "'};'"
    else:
        text = f"'  ' || cast(to_json(k) as varchar) || ': ' || cast(to_json(v) as varchar) || {comma}"
        head, foot = "'{'", "'}'"
        if fmt == "arb":
            head = f"'{{' || {_NL} || '  \"@@locale\": ' || cast(to_json({_locale('lang')}) as varchar) || ','"
    return f"""
      select sheet, lang, 1 as section, pos, {text} as line from ({entries})
      union all select distinct sheet, lang, 0, 0, {head} from values_
      union all select distinct sheet, lang, 2, 0, {foot} from values_"""


oracle("render_bundle", ["values_"], _bundle("arb"))
oracle("render_bundle_getx", ["values_"], _bundle("getx"))
oracle("render_bundle_json", ["values_"], _bundle("json"))
oracle("locale_manifest", ["active"], f"select sheet, ord, lang, {_full_locale('lang')} as locale from active")

# --- catalog -------------------------------------------------------------------------
oracle("smart_merge", ["merged"], "select * replace (cast(first_match as int) as first_match) from merged")
oracle("merge_stats", ["merged"], """
  select count(*) filter (where status = 'new') as new_strings, count(*) filter (where status = 'updated') as updated_strings,
         count(*) filter (where status in ('preserved', 'removed')) as preserved_strings, count(*) as total_strings from merged""")
oracle("removed_strings", ["strings", "catalog"], """
  select key, ord, english from catalog where key not in (select key from strings)""")
oracle("merge_modes", ["merged"], """
  select 'merge' as mode, 'app_strings' as target, key, english, status from merged
  union all select 'version', 'app_strings_v2', key, value, 'new' from strings
  union all select 'overwrite', 'app_strings', key, value, 'new' from strings""")
_HEADS = [
    "," + ",".join(str(i) for i in range(1, len(LANGUAGE_CODES) + 1)), "," + ",".join(LANGUAGE_CODES),
    ",".join(["Key", *LANGUAGE_NAMES]),
]
_FR = LANGUAGE_CODES.index("app_fr")
oracle("catalog_version", ["merged"], f"""
  select key, {_trim("english")} as english, coalesce({_trim("app_fr")}, '') as app_fr from merged""")
oracle("render_catalog_csv", ["merged"], f"""
  select case status when 'removed' then 2 else 1 end as section, first_path, first_pattern, cast(first_match as int) as first_match, ord,
         {_csv('key')} || ',' || {_csv('english')} || repeat(',', {_FR}) || {_csv("coalesce(app_fr, '')")}
         || repeat(',', {len(LANGUAGE_CODES) - 1 - _FR}) as line from merged
  union all """ + " union all ".join(
    f"select {i - 3}, null, null, null, null, {_q(h)}" for i, h in enumerate(_HEADS)))
oracle("render_catalog_json", ["strings"], """
  select 1 as section, first_path, first_pattern, cast(first_match as int) as first_match,
         '  ' || cast(to_json(key) as varchar) || ': ' || cast(to_json(value) as varchar)
         || case when row_number() over (order by first_path desc, first_pattern desc, first_match desc) = 1 then '' else ',' end as line
  from strings
  union all select 0, null, null, null, '{' union all select 2, null, null, null, '}'""")
oracle("catalog_summary", [], f"""
  select folder as folder_path, folder, base_name, cast(coalesce(max(n) filter (where name = base_name || '.csv'), 0) as int) as n_strings,
         max(modified) as modified
  from (select *, case when folder like '%\\_strings' escape '\\' then replace(folder, '_strings', '') else folder end as base_name
        from (select split_part(path, '/', 1) as folder, split_part(path, '/', 2) as name, modified,
                     greatest(len(list_filter(string_split(content, {_NL}), lambda x: {_trim('x')} <> '')) - 3, 0) as n
              from ({view_sql('catalog_files')})) where not starts_with(folder, '.') and folder <> 'web')
  group by folder, base_name""")

# --- rewrite -------------------------------------------------------------------------
_M = "path, pattern_id, cast(match_ord as int) as match_ord"
_GETX = "chr(39) || key || chr(39) || '.tr'"
oracle("match_keys", ["matched"], f"select {_M}, line_no, value, key, tier from matched")
oracle("plan_replacements", ["matched"], f"""
  select {_M}, line_no, value as original, 'AppLocalizations.of(context).' || key as replacement, key, 'arb' as format from matched where key is not null
  union all select {_M}, line_no, value, {_GETX}, key, 'getx' from matched where key is not null""")
oracle("missed_strings", ["matched"], f"select {_M}, line_no, value from matched where key is null")
oracle("plan_text", ["matched"], f"""
  select {_M}, case when key is not null
    then 'Line ' || cast(line_no as varchar) || ': - ' || value || {_NL} || '         + ' || {_GETX}
    else path || ':' || cast(line_no as varchar) || ' - "' || value || '"' end as text from matched""")
oracle("replacements_by_file", ["matched"], "select path, count(*) as planned from matched where key is not null group by path")
oracle("review_batches", ["matched"], f"""
  select * from (select {_M}, cast(row_number() over (partition by path order by pattern_id, match_ord) as int) as idx,
    cast((row_number() over (partition by path order by pattern_id, match_ord) - 1) // 4 + 1 as int) as batch, key
    from matched where key is not null) where idx <> 2 or path not like '%part_%'""")
_STEP = """{'o': value, 'r': chr(39) || key || chr(39) || '.tr', 'n': 0}"""
oracle("apply_by_line", ["matched", "code_files"], f"""
  select f.path, array_to_string(list_transform(range(1, len(f.lines) + 1), lambda i: coalesce(s.done[i].o, f.lines[i])), {_NL}) as content,
         s.planned, s.applied
  from (select path, case when t[-1] = '' then t[1:-2] else t end as lines
        from (select path, regexp_split_to_array(content, '\\r\\n|\\r|\\n') as t from code_files)) f
  join (select path, map(list(line_no), list(d)) as done, cast(sum(n) as bigint) as planned, cast(sum(d.n) as int) as applied from (
    select path, line_no, n, list_reduce(steps, lambda a, s: {{
        'o': case when contains(a.o, '"' || s.o || '"') then replace(a.o, '"' || s.o || '"', s.r)
                  else replace(a.o, chr(39) || s.o || chr(39), s.r) end,
        'r': '', 'n': a.n + case when contains(a.o, '"' || s.o || '"') or contains(a.o, chr(39) || s.o || chr(39)) then 1 else 0 end }}) as d
    from (select m.path, m.line_no, count(*) as n,
                 list_concat([{{'o': any_value(string_split(c.content, {_NL})[m.line_no]), 'r': '', 'n': 0}}], list({_STEP} order by pattern_id, match_ord)) as steps
          from matched m join code_files c on c.path = m.path where key is not null group by m.path, m.line_no)) group by path) s on s.path = f.path
  where applied > 0""")
_LOOSE = f"'[{WS}]*' || regexp_escape(s.o) || '[{WS}]*'"
_PLAIN = "replace(s.r, chr(92), chr(92) || chr(92))"
oracle("apply_by_content", ["matched", "code_files"], f"""
  select path, d.o as content, planned, d.n as applied from (
    select path, cast(len(steps) - 1 as int) as planned, list_reduce(steps, lambda a, s: {{
      'o': case when contains(a.o, '"' || s.o || '"') then replace(a.o, '"' || s.o || '"', s.r)
                when contains(a.o, chr(39) || s.o || chr(39)) then replace(a.o, chr(39) || s.o || chr(39), s.r)
                when regexp_matches(a.o, '"' || {_LOOSE} || '"') then regexp_replace(a.o, '"' || {_LOOSE} || '"', {_PLAIN}, 'g')
                when regexp_matches(a.o, chr(39) || {_LOOSE} || chr(39)) then regexp_replace(a.o, chr(39) || {_LOOSE} || chr(39), {_PLAIN}, 'g')
                else a.o end,
      'r': '',
      'n': a.n + case when contains(a.o, '"' || s.o || '"') or contains(a.o, chr(39) || s.o || chr(39))
                 or regexp_matches(a.o, '"' || {_LOOSE} || '"') or regexp_matches(a.o, chr(39) || {_LOOSE} || chr(39)) then 1 else 0 end }}) as d
    from (select m.path, list_concat([{{'o': any_value(c.content), 'r': '', 'n': 0}}], list({_STEP} order by pattern_id, match_ord)) as steps
          from matched m join code_files c on c.path = m.path where key is not null group by m.path)) where d.n > 0""")

# --- translation ---------------------------------------------------------------------
oracle("translation_work", ["work"], "select * from work")
oracle("translate_tm", ["translated"], "select * from translated")
oracle("translate_fn", ["work"], """
  select *, case when contains(english, 'ring') then null else lang || ' ' || upper(english) end as text,
         case when contains(english, 'ring') then 'ValueError: refused' end as error from work""")


def _written(text: str) -> str:
    return "select e.sheet, e.row_no, e.english, " + ", ".join(
        f"coalesce((select {text} from translated t where t.sheet = e.sheet and t.row_no = e.row_no and t.lang = '{x}'), e.{x}) as {x}"
        for x in TARGETS) + " from english e"


oracle("apply_translations", ["translated"], _written("text"))
oracle("translate_rows", ["translated"], _written(
    "coalesce(text, case when contains(english, 'ring') then null else lang || ' ' || upper(english) end)"))
oracle("sheet_texts", ["cells"], """
  select path as sheet, row_no, max(value) filter (where col_no = 0) as key,
         coalesce(max(value) filter (where col_no = 1), '') as english
  from cells where row_no >= 4 group by path, row_no""")
_CELL = ("coalesce(case when i > 1 and length(e) > 0 and not contains(e, 'm') and row_no >= 4 and h[i] in "
         f"{_in(TARGETS)} then h[i] || ', \"' || e || '\"' end, f[i], '')")
oracle("write_back", ["rows"], f"""
  select path as sheet, row_no, case when row_no >= 4 and length(e) > 0 and not contains(e, 'm')
    then array_to_string(list_transform(range(1, greatest(len(f), len(h)) + 1), lambda i: {_csv(_CELL)}), ',') else line end as line
  from (select r.path, r.row_no, r.line, r.f, coalesce(r.f[2], '') as e, list_transform(h.f, lambda x: {_trim('x')}) as h
        from (select *, {_FIELDS} as f from rows) r
        join (select path, {_FIELDS} as f from rows where row_no = 2) h on h.path = r.path)""")
oracle("quota_estimate", ["english"], f"""
  select count(*) as strings, 2 as languages, count(*) * 40 as estimated_chars, cast(sum({_utf16('english')}) * 2 as bigint) as exact_chars,
         count(*) * 40 / {QUOTA}.0::double * 100 as percent, count(*) * 40 > {QUOTA} as exceeds from english""")
oracle("quota_usage", ["english"], f"""
  select used, {QUOTA} - used as remaining, used / {QUOTA}.0::double * 100 as percent,
         used / {QUOTA}.0::double * 100 >= 80 as near, used >= {QUOTA} as exceeded
  from (select cast(sum({_utf16('english')}) * 2 as bigint) as used
        from english where english <> '' and not contains(english, 'ring'))""")
oracle("quota_running", ["english"], f"""
  select sheet, row_no, english, used, used / 500.0::double * 100 >= 80 as near, used >= 500 as exceeded
  from (select sheet, row_no, english, cast(sum({_utf16('english')} * 2) over (partition by sheet order by row_no) as bigint) as used
        from english where english <> '' and not contains(english, 'ring'))""")
ORACLES["write_back_lines"] = ORACLES["write_back"]
_FIRST_TEXTS = f"""
  select english, lang, sheet, row_no, cast({_utf16('english')} as bigint) as units,
    sum({_utf16('english')}) over (order by sheet, row_no, english, lang) as running,
    row_number() over (order by sheet, row_no, english, lang) as place
  from (select *, row_number() over (partition by english, lang order by sheet, row_no) as nth from work) where nth = 1"""
oracle("admit_texts", ["work"], f"""
  select english, lang, sheet, row_no, units, cast(running as bigint) as used, place, running <= {QUOTA} as admitted
  from ({_FIRST_TEXTS})""")
# The second run starts at what the first one was answered, behind the texts that the first one sent.
oracle("translate_quota", ["work"], f"""
  select english, lang,
    case when sent and not refused then lang || ' ' || upper(english) end as text,
    case when sent and refused then 'ValueError: refused' end as error,
    case when not sent then 'over quota' when refused then 'refused' else 'answered' end as state
  from (select *, running <= {QUOTA // 2} or running - half + paid <= {QUOTA} as sent
        from (select *, contains(english, 'ring') as refused,
                coalesce(sum(units) filter (where running <= {QUOTA // 2}) over (), 0) as half,
                coalesce(sum(units) filter (where running <= {QUOTA // 2} and not contains(english, 'ring')) over (), 0) as paid
              from ({_FIRST_TEXTS})))""")

# --- streaming: the same as a batch over all source files ------------------------------
ORACLES["stream_extract"] = ORACLES["unique_strings"]
ORACLES["rescan_changed"] = ORACLES["unique_strings"]
ORACLES["stream_catalog"] = ORACLES["smart_merge"]
