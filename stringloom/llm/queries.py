"""The registered queries of this package and their DuckDB texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stringloom.llm import (
    alignment, chat, decontaminate, embeddings, lines, merkle, mixing, pii, quality, repeats, simhash, tokens, warc)
from stringloom.llm.common import read_table


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(read_table(spark, sf_dir, "pages"))
    return warc.read_records(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(read_table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", "action", "inserted", F.sha2("segment", 256).alias("segment_sha256"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    manifest = merkle.build_manifest(docs, altered=F.when(even, F.replace("text", F.lit("\n"), F.lit(""))))
    return merkle.verify(manifest)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_suffixes, op2_decontaminate, op3_quality, op4_warc, op5_chat, op6_tokens, op7_embeddings, op8_simhash, op9_mixing,
    op10_lines, op11_manifest, op12_pii, op13_alignment)}

ORACLES: dict[str, str] = {}

ORACLES["op2_decontaminate"] = r"""
with item_words as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words
  from benchmark),
windows as (
  select distinct item_id, unnest(list_transform(range(1, greatest(1, len(words) - 9) + 1), lambda s: array_to_string(words[s:s + 9], ' '))) as phrase
  from item_words where len(words) > 0),
shapes as (select distinct phrase, len(string_split(phrase, ' ')) as n from windows),
lengths as (select distinct n from shapes),
doc_words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words
  from documents),
places as (
  select doc_id, n, unnest(range(1, len(words) - n + 2)) as s, unnest(list_transform(range(1, len(words) - n + 2), lambda s: array_to_string(words[s:s + n - 1], ' '))) as phrase
  from doc_words, lengths where len(words) >= n),
matched as (select doc_id, s, p.n, phrase from places p semi join shapes using (phrase)),
hits as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(s, s + n)) as place from matched) group by doc_id),
items as (
  select doc_id, list_sort(list(distinct cast(item_id as varchar))) as listed
  from (select distinct doc_id, phrase from matched) join windows using (phrase) group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(listed), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(listed, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hits using (doc_id) left join items using (doc_id)
"""

ORACLES["op10_lines"] = r"""
with split as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
numbered as (
  select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as n from split),
keyed as (
  select doc_id, n, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from numbered),
repeated as (
  select k, min(doc_id) as first_id from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
marked as (
  select doc_id, n, line, r.k is not null and doc_id <> first_id as gone from keyed left join repeated r using (k))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def _manifest_sql(levels: int = 14) -> str:
    """Trees as lists, one column per level; a level of one node is the level below it."""

    def text(value: str) -> str:
        return f"case when {value} is null then '-' else strlen(cast({value} as varchar)) || ':' || cast({value} as varchar) end"

    def leaf(body: str) -> str:
        return "sha256(" + " || ".join(f"({text(v)})" for v in ("doc_id", "source", "lang", "n_chars", body)) + ")"

    def up(row: str) -> str:
        return (f"case when len({row}) > 1 then list_transform(range(0, (len({row}) + 2) // 3), "
                f"lambda i: sha256(array_to_string({row}[3 * i + 1:3 * i + 3], ''))) else {row} end")

    def tree(name: str, source: str, key: str, first: str, tops: str) -> str:
        out = [f"{name}0 as (select {key}, {first} as l0 from {source} group by {key})"]
        for k in range(levels):
            kept = ", ".join(f"l{i}" for i in range(k + 1))
            out.append(f"{name}{k + 1} as (select {key}, {kept}, {up(f'l{k}')} as l{k + 1} from {name}{k})")
        named = ", ".join(f"l{i} as {tops}{i}" for i in range(levels + 1))
        return ",\n".join([*out, f"{name} as (select {key}, {named} from {name}{levels})"])

    def side(row: str, place: str, k: int, left: bool) -> str:
        at = f"({place} // {3**k})"
        part = f"[3 * ({at} // 3) + 1:{at}]" if left else f"[{at} + 2:3 * ({at} // 3) + 3]"
        return f"case when len({row}) > 1 then array_to_string({row}{part}, '') else '' end"

    steps = [(f"s{k}", "rank", k) for k in range(levels)] + [(f"r{k}", "tree", k) for k in range(levels)]
    proof = " || ".join(f"{side(row, place, k, left)}" for row, place, k in steps for left in (True, False))
    folds = ["folded0 as (select *, shown as n0 from placed)"]
    for i, (row, place, k) in enumerate(steps):
        node = f"case when len({row}) > 1 then sha256({side(row, place, k, True)} || n{i} || {side(row, place, k, False)}) else n{i} end"
        folds.append(f"folded{i + 1} as (select * exclude (n{i}), {node} as n{i + 1} from folded{i})")
    digits = "flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda d: [ascii(d), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = (f"xor(list_reduce(list_prepend(4294967295::bigint, {digits}), "
           "lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end), 4294967295)")
    body = f"case when {crc} % 2 = 0 then replace(text, chr(10), '') else text end"
    return f"""
with leaves as (select doc_id, source, {leaf('text')} as leaf, {leaf(body)} as shown from documents),
ranked as (
  select *, dense_rank() over (order by source nulls first) - 1 as tree,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as rank from leaves),
{tree('source_tree', 'ranked', 'tree', 'list(leaf order by rank)', 's')},
tops as (select 0 as one, tree as place, s{levels}[1] as subroot from source_tree),
{tree('root_tree', 'tops', 'one', 'list(subroot order by place)', 'r')},
placed as (select * from ranked join source_tree using (tree) cross join root_tree),
{", ".join(folds)}
select doc_id, leaf, s{levels}[1] as subroot, r{levels}[1] as root, sha256({proof}) as proof_sha256,
  n{len(steps)} as folded_root, n{len(steps)} = r{levels}[1] as verified
from folded{len(steps)}
"""


ORACLES["op11_manifest"] = _manifest_sql()
