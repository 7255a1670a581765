"""Tables the queries run on, derived by Spark from the test tables.

The expressions are plain SQL text that Spark and DuckDB both read, so a query and its check start
from the same rows. ``view_sql`` is the DuckDB form.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_Q = "chr(39)"  # a single quote

CODE_PATH = """
'lib/' || case p_partkey % 5 when 0 then 'l10n' when 1 then 'generated' else 'screens' end
  || '/part_' || cast(p_partkey as string)
  || case p_partkey % 11 when 0 then '_localizations.dart' when 1 then '_intl.dart'
                         when 2 then '.txt' when 3 then '_app_icons.dart' else '.dart' end
"""
CODE_CONTENT = f"""
concat_ws(chr(10),
  'import "package:x/y.dart";',
  '  Text("' || p_name || '"),',
  '  title: ' || {_Q} || p_type || {_Q} || ',',
  '  content: Text( "' || p_name || '!" ),',
  '  label: "' || cast(p_size as string) || '",',
  '  hintText: "' || p_brand || '" .tr,',
  '  message: "Don' || {_Q} || 't stop",',
  '  return "https://e.com/' || cast(p_partkey as string) || '";',
  '  text: " Size ' || cast(p_size as string) || '? ",',
  '  labelText: "...",',
  '  final a = "assets/' || p_name || '.png";',
  '  final b = "' || upper(p_name) || '"',
  '    .i18n;',
  '  final c = x.trim() == "' || p_type || '";',
  '  final d = "multi', 'line ' || cast(p_size as string) || '";',
  '  final e = "L10n.k' || cast(p_size as string) || '";',
  '  final f = "/abs/' || p_name || '";',
  '  final g = "caf' || chr(233) || ' ' || p_type || '";',
  '  text: "OK",',
  '  return "Item ' || cast(p_partkey as string) || ' is ready";')
"""
SHEET_CONTENT = '''
concat_ws(chr(10),
  ',1,2,3,4',
  ',app_en,app_fr,app_ar,app_zh_hk',
  'Key,ENGLISH - en,French - fr,Arabic - ar,Chinese - zh-HK',
  '',
  'Go Back?,"Go, back",' || case when s_suppkey % 2 = 0 then 'Retour ' || s_name else '' end || ',,',
  's ' || cast(s_suppkey % 10 as string) || ' name,"say ""' || s_name || '""",fr,' || case when s_suppkey % 3 = 0 then 'ar' else '' end || ',',
  '   ,orphan,x,y,z',
  'go_back,Back,,' || case when s_suppkey % 5 = 0 then 'ar2' else '' end,
  cast(s_suppkey as string) || '_am,Morning,,,',
  '')
'''
# Quoted line breaks, also beside blank lines, doubled quotes and commas, and a quote left open in some sheets.
BREAK_CONTENT = '''
concat_ws(chr(10), ',1,2', ',app_en,app_fr', 'Key,ENGLISH - en,French - fr', '',
  'address,"' || s_name || chr(10) || chr(10) || cast(s_nationkey as string) || '","un' || chr(10) || ' deux"',
  '  ', 'said,"""' || s_name || '""' || chr(10) || '","a, b"', 'plain,' || cast(s_suppkey as string) || ',x',
  case when s_suppkey % 4 = 0 then 'open,"left ' || s_name else 'last,"' || chr(10) || '",' end, 'end,"a""b",c')
'''
LONG_VALUE = """
case when ord = 5 or (p_partkey + ord * 3) % 4 = 0 then ''
     else lang || ':' || p_name || ' ' || cast(p_partkey % 3 as string) end
"""
ARB_CONTENT = """
'{"@@locale":"en","k_' || cast(c_custkey % 600 as string) || '":"' || c_name || '","shared":"Shared '
  || cast(c_custkey as string) || '"}'
"""
JSON_CONTENT = ARB_CONTENT.replace('"@@locale":"en",', "")
GETX_CONTENT = f"""
concat_ws(chr(10), 'final Map<String, String> m = {{',
  '  ' || {_Q} || 'k_' || cast(c_custkey % 600 as string) || {_Q} || ': ' || {_Q} || c_name || {_Q} || ',',
  '  ' || {_Q} || 'shared' || {_Q} || ': ' || {_Q} || 'Shared ' || cast(c_custkey as string) || {_Q},
  '}};')
"""
# What becomes of some bundles, by the number in their name.
_NUMBER = "cast(substring(path, 10, 12) as int)"
BROKEN = f"""case when {_NUMBER} % 7 = 0 then left(content, length(content) - 4) when {_NUMBER} % 11 = 0 then '["a"]'
  when {_NUMBER} % 13 = 0 then ' ' else content end"""
_KEYS = "concat('000000000000', cast(c_custkey as string))"
BUNDLE_PATH = f"'l10n/app_' || right({_KEYS}, 12)"

CATALOG = """
select replace(p_name, ' ', '_') as key, cast(min(p_partkey) as int) as ord,
       case when min(p_partkey) % 4 = 0 then '' when min(p_partkey) % 4 = 1 then 'Old ' || p_name else p_name end as english,
       'fr ' || p_name as app_fr
from {part} where p_partkey % 3 = 0 group by p_name
union all
select 'item_' || cast(p_partkey as string) || '_is_ready', cast(p_partkey + 1000000 as int),
       case when p_partkey % 4 = 0 then '' when p_partkey % 4 = 1 then 'Old item'
            else 'Item ' || cast(p_partkey as string) || ' is ready' end,
       case when p_partkey % 2 = 0 then '' else 'fr, "item" ' || cast(p_partkey as string) end
from {part} where p_partkey % 3 = 0
union all
select 'gone_' || cast(c_custkey as string), cast(c_custkey + 2000000 as int), 'Gone ' || c_mktsegment, 'fr ' || c_name
from {customer} where c_custkey % 2 = 0
"""
ENTRIES = """
select replace(p_name, ' ', '_') as key, case when min(p_partkey) % 2 = 0 then p_name else upper(p_name) end as value,
       'l10n/a.arb' as path, cast(min(p_partkey) as int) as ord
from {part} group by p_name
union all
select 'item_' || cast(p_partkey as string), 'Item ' || cast(p_partkey as string) || ' is ready', 'l10n/b.arb', cast(p_partkey as int)
from {part} where p_partkey % 3 = 0
union all
select 'size_' || cast(p_size as string) || '_' || p_type, 'Size ' || cast(p_size as string) || '?', 'l10n/c.arb', cast(min(p_partkey) as int)
from {part} where p_size % 2 = 0 group by p_size, p_type
union all
select 'ok_' || r_name, case when r_regionkey % 2 = 0 then 'ok' else 'Ok' end, 'l10n/d.arb', cast(r_regionkey as int) from {region}
"""
MEMORY = """
select p_name as english, 'app_fr' as lang, 'app_fr ' || p_name as text from {part} where p_size % 2 = 0 group by p_name
union all
select p_name, 'app_ar', 'app_ar ' || p_name from {part} where p_size % 2 = 0 group by p_name
union all
select p_name || ' ' || cast(p_partkey as string), 'app_fr', 'fr ' || cast(p_partkey as string) from {part} where p_partkey % 3 = 0
"""
ROWS = """
select p_brand as sheet, cast(p_partkey + 4 as int) as row_no,
       case when p_partkey % 7 = 0 then '' when p_partkey % 3 = 0 then p_name || ' ' || cast(p_partkey as string) else p_name end as english,
       case when p_partkey % 2 = 0 then 'fr ' || p_name else '' end as app_fr, '' as app_ar
from {part}
"""
CATALOG_FILES = """
select case s_suppkey % 6 when 0 then 'web' when 1 then '.cache' when 2 then 'app' || cast(s_suppkey as string)
            else 'shop' || cast(s_suppkey as string) || '_strings' end
       || '/' || case s_suppkey % 6 when 2 then 'app' else 'shop' end || cast(s_suppkey as string)
       || case s_suppkey % 4 when 3 then '.json' else '.csv' end as path,
       {sheet} as content, coalesce(modified, cast('2020-01-01 00:00:00' as timestamp)) as modified
from {supplier} left join (select user_id as u, max(ts) as modified from {events} group by user_id) e on e.u = s_suppkey
""".replace("{sheet}", SHEET_CONTENT)
LOCALES = """
select c_custkey, case c_custkey % 6
  when 0 then 'app_' || lower(left(c_mktsegment, 2)) when 1 then 'app_' || lower(left(c_mktsegment, 2)) || '_' || lower(right(c_mktsegment, 2))
  when 2 then 'app_zh_hk' when 3 then 'app_zhcn' when 4 then lower(c_mktsegment) else 'app_de' end as lang
from {customer}
"""
LANGS = [(1, "app_en"), (2, "app_fr"), (3, "app_ar"), (4, "app_pt_br"), (5, "app_zh_hk")]
_LANG_STRUCTS = ", ".join(f"struct({i} as ord, '{c}' as lang)" for i, c in LANGS)
_LANG_VALUES = ", ".join(f"({i}, '{c}')" for i, c in LANGS)

PAGE_PATH = "'web/page_' || cast(page_id as string) || '.dart'"
DOCUMENT_PATH = "'docs/doc_' || cast(doc_id as string) || '.dart'"
_SQL_VIEWS = {
    "catalog": CATALOG, "entries": ENTRIES, "memory": MEMORY, "english_rows": ROWS,
    "catalog_files": CATALOG_FILES, "locales": LOCALES,
    "part_files": f"select {CODE_PATH} as path, {CODE_CONTENT} as content from {{part}}",
    "page_files": f"select {PAGE_PATH} as path, html as content from {{pages}}",
    "document_files": f"select {DOCUMENT_PATH} as path, text as content from {{documents}}",
    "sheet_files": f"select 'sheets/' || cast(s_suppkey as string) || '.csv' as path, {SHEET_CONTENT} as content from {{supplier}}",
    "break_files": f"select 'sheets/' || cast(s_suppkey as string) || '.csv' as path, {BREAK_CONTENT} as content from {{supplier}}",
    "arb_files": f"select {BUNDLE_PATH} || '.arb' as path, {ARB_CONTENT} as content from {{customer}}",
    "json_files": f"select {BUNDLE_PATH} || '.json' as path, {JSON_CONTENT} as content from {{customer}}",
    "getx_files": f"select {BUNDLE_PATH} || '.dart' as path, {GETX_CONTENT} as content from {{customer}}",
}
# Rows of a table that one task makes longer rows or several rows of.
TASK_ROWS = 100_000
_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, stream: DataFrame | None = None) -> DataFrame:
    """A table (or the stream of its rows) of fewer splits than cores (the test tables have one) or of very many rows
    to a split, spread before its rows grow. Counting reads Parquet's footers only."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    rows = df if stream is None else stream
    return rows.repartition(parts) if df.rdd.getNumPartitions() < parts else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table by name."""
    if name == "code_files":
        parts = [view(spark, sf_dir, n) for n in ("part_files", "page_files", "document_files")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])
    if name == "sheet_long":
        langs = F.expr(f"inline(array({_LANG_STRUCTS}))")
        return spread(table(spark, sf_dir, "part")).select("*", langs).selectExpr(
            "p_brand as sheet", "cast(p_partkey + 4 as int) as row_no", "p_name as raw_key", "ord", "lang",
            f"{LONG_VALUE} as value",
        )
    text, own_views = _SQL_VIEWS[name], []
    for t in _TABLES:
        if "{" + t + "}" in text:
            source = table(spark, sf_dir, t)
            if name.endswith("_files"):
                source = spread(source)
            own = f"loom_{t}_{uuid.uuid4().hex}"  # no view of the user's is replaced
            source.createOrReplaceTempView(own)
            own_views.append(own)
            text = text.replace("{" + t + "}", own)
    rows = spark.sql(text)  # resolved here, so the views have served their turn
    for own in own_views:
        spark.catalog.dropTempView(own)
    return rows


def code_files(part: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Source files out of batches or streams of the three tables."""
    return part.selectExpr(f"{CODE_PATH} as path", f"{CODE_CONTENT} as content").unionByName(
        pages.selectExpr(f"{PAGE_PATH} as path", "html as content")).unionByName(
        documents.selectExpr(f"{DOCUMENT_PATH} as path", "text as content"))


def view_sql(name: str) -> str:
    """The same table as DuckDB text."""
    if name == "code_files":
        return " union all ".join(f"({view_sql(n)})" for n in ("part_files", "page_files", "document_files"))
    if name == "sheet_long":
        return (
            "select p_brand as sheet, cast(p_partkey + 4 as int) as row_no, p_name as raw_key, ord, lang, "
            f"{LONG_VALUE} as value from part cross join (values {_LANG_VALUES}) as l(ord, lang)"
        )
    text = _SQL_VIEWS[name]
    for t in _TABLES:
        text = text.replace("{" + t + "}", t)
    return text
