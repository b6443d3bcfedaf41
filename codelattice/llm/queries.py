"""The registered queries of the corpus operators, over whole tables, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm import filter_audit, huffman_ids, interpolated_lm, packing, pairwise_quality, pivot_index, prefix_trie, rule_cascade, sentencepiece_codec, simhash_vptree, suffix_merge, toxicity, url_rules
from codelattice.llm.common import read_table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as pieces, and its text again: digests of both."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_codec.encode(docs, model, decoded=True)
    return coded.select("doc_id", "n_tokens", "score", F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))


def op3_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))


def op5_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vptree.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash_vptree.hex_of("fp").alias("fingerprint"), "component_id")


def op6_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_merge.deduplicate(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_cascade.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = huffman_ids.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 2, huffman_ids.new_path(spark))
    return huffman_ids.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024)
    return pieces.select("doc_id", "start", "length", packing.crc_of("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Rules of ``op11_url_rules``: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.rules_of(spark, URL_RULES))


OP11_SQL = """
with rests as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from rests
), rules(verdict, rule_host, rule_path) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), places as (
  select *, row_number() over () as place from parts
), fits as (
  select place, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(verdict, length(rule_host || rule_path)) as verdict
  from places, rules
  where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by place
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from places left join fits using (place)
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP12_SQL = r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null
), convs as (
  select conv_id, conv_id - conv_id % 20 as base,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)),
           4294967295::bigint) % 4 as h
  from (select distinct conv_id from turns)
), rebuilt as (
  select c.conv_id, 0 as own, pos, role, text from convs c join turns t on t.conv_id = c.base and t.pos <= c.h
  union all
  select c.conv_id, 1, pos, role, text from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h
), steps as (
  select conv_id, text, md5(length(role)::varchar || ':' || role || text) as step, row_number() over (partition by conv_id order by own, pos) as depth from rebuilt
), members as (
  select conv_id, 0 as depth, '' as path, 0 as words from convs
  union all
  select conv_id, depth, string_agg(step, '') over (partition by conv_id order by depth), len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) from steps
), lasts as (
  select conv_id, max(depth) as turns from members group by conv_id
), nodes as (
  select path, any_value(m.depth) as depth, min(m.conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
         coalesce(string_agg(m.conv_id::varchar, ',' order by m.conv_id) filter (where m.depth = turns), '') as ends
  from members m join lasts using (conv_id) group by path
), links as (
  select n.path, parent.path as above, parent.conv_id as parent_conv_id from nodes n join nodes parent on n.depth > 0 and parent.path = left(n.path, length(n.path) - 32)
), kids as (
  select above as path, count(*) as n_children from links group by above
), below as (
  select n.path, count(*) filter (where k.path is null) as n_leaves, sum((m.n_convs - 1) * m.words) as saved
  from nodes n join nodes m on starts_with(m.path, n.path) left join kids k on k.path = m.path group by n.path
)
select conv_id, depth::bigint as depth, parent_conv_id, n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(ends) as ends_sha256
from nodes left join links using (path) left join kids using (path) join below using (path)
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, read_table(spark, sf_dir, "labels"))


OP13_SQL = r"""
with texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as body from documents
), worded as (
  select *, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from texts
), marks as (
  select doc_id, max((quality is not distinct from 1)::int) as good, max((toxic is not distinct from 1)::int) as toxic from labels where doc_id is not null group by doc_id
), firsts as (
  select body, min(doc_id) as first_id from texts group by body
), failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         (len(words) < 50)::int + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::int
         + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body))::int
         + 8 * regexp_matches(body, '[#$%&*|]')::int + 16 * coalesce((doc_id > first_id)::int, 0) as mask
  from worded join firsts using (body) left join marks using (doc_id)
), cells as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by all
), bits(letter, bit) as (
  values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as applied
  from bits a, bits b, bits c, bits d, bits e
  where len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps as (
  select filter_order, step, applied[step] as bit, coalesce(list_sum(applied[1:step - 1]), 0) as before
  from orders, range(1, 6) t(step)
), found as (
  select part, filter_order, step, bit,
         sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
         sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end) as removed,
         sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end) as redundant,
         sum(case when mask = bit then n else 0 end) as unique_fails,
         sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end) as good_lost,
         sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end) as toxic_lost
  from cells, (select filter_order, step, bit::int as bit, before::int as before from steps)
  group by all
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       sum(removed) over (partition by part, bit)::bigint as shapley
from found
"""


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_interpolated_lm": op3_interpolated_lm,
    "op4_pairwise_quality": op4_pairwise_quality,
    "op5_simhash_vptree": op5_simhash_vptree,
    "op6_suffix_merge": op6_suffix_merge,
    "op7_pivot_index": op7_pivot_index,
    "op8_rule_cascade": op8_rule_cascade,
    "op9_huffman_ids": op9_huffman_ids,
    "op10_packing": op10_packing,
    "op11_url_rules": op11_url_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {"op11_url_rules": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_filter_audit": OP13_SQL}
