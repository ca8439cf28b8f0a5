"""The registered queries of the operators, with their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretrail.llm import (
    bpe,
    copies,
    decontaminate,
    fingerprints,
    licenses,
    lines,
    manifest,
    near,
    prefixes,
    secrets,
    sharding,
    suffixes,
    toxicity,
)
from caretrail.llm.common import documents, row_keys


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_history(documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    count = [F.size(F.filter("spans", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}")
             for k in secrets.BASE]
    return found.select(
        F.col("path").alias("doc_id"), *count, F.sha2(secrets.digest(base), 256).alias("base_sha256"),
        secrets.digest(F.col("spans")).alias("spans"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    cleaned = lines.dedup_lines(docs)
    rows = docs.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")))
    return rows.join(cleaned.dropDuplicates(["_k", "_h"]), ["_k", "_h"]).select(
        "doc_id", "n_lines", "n_repeats", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(documents(spark, sf_dir))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.digests(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digests(documents(spark, sf_dir))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_secret_scans": op5_secret_scans,
    "op1_line_dedup": op1_line_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_license_scans": op3_license_scans,
    "op4_sharding": op4_sharding,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_bpe": op7_bpe,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_trie": op13_conversation_trie,
}

_SPLIT = "string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "

# crc32 of a text of ASCII digits, from the table of the reflected polynomial
_CRC = """
crcs as (
  select list(list_reduce(list_prepend(n, range(8)),
    lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) crc
  from range(256) t(n)
)"""


def _crc32(number: str) -> str:
    codes = f"list_transform(string_split({number}::varchar, ''), lambda x: ascii(x)::bigint)"
    return (f"xor(list_reduce(list_prepend(4294967295, {codes}), "
            "lambda c, b: xor(c >> 8, crc[((xor(c, b) & 255) + 1)::int])), 4294967295)")


_MARKED = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in (
    "doc_id", "source", "lang", "n_chars"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": """
with rows as (
  select doc_id, text, string_split(text, chr(10)) l from documents
), lines as (
  select doc_id, unnest(l) line, unnest(range(len(l))) pos from rows
), firsts as (
  select line, min(doc_id) doc_id, arg_min(pos, (doc_id, pos)) pos, strlen(line) n from lines
  where strlen(line) >= 24 group by line
), near as (
  select distinct b.line from firsts a join firsts b
  on b.n between a.n - 2 and a.n + 2 and (a.doc_id, encode(a.line)) < (b.doc_id, encode(b.line))
  where levenshtein(a.line, b.line) <= 2
), kept as (
  select lines.*, near.line is not null gone, firsts.doc_id is not null first
  from lines left join firsts using (line, doc_id, pos) left join near on near.line = firsts.line
)
select doc_id, count(*) n_lines, count_if(strlen(line) >= 24 and not first) n_repeats, count_if(gone) n_near,
       sha256(coalesce(string_agg(line, chr(10) order by pos)
                       filter (where strlen(line) < 24 or (first and not gone)), '')) kept_sha256
from kept group by doc_id""",
    "op2_minhash_near_dedup": r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end s from words
), shingles as (select doc_id, len(s) n, unnest(s) g from sets),
links as (
  select a.doc_id a, b.doc_id b from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), smallest as (select a doc_id, min(b) m from reach group by a)
select doc_id, cast(len(s) as bigint) n_shingles, least(doc_id, m) component_id, doc_id <= coalesce(m, doc_id) kept
from sets left join smallest using (doc_id)""",
    "op9_benchmark_decontamination": rf"""
with words as (
  select doc_id, list_filter({_SPLIT}'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents
), items as (
  select item_id, list_filter({_SPLIT}'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark
), item_windows as (
  select distinct item_id, w[p + 1 : p + least(10, len(w))] g
  from (select item_id, w, unnest(range(len(w) - least(10, len(w)) + 1)) p from items where len(w) > 0)
), lengths as (select distinct len(g) m from item_windows),
doc_windows as (
  select doc_id, p, m, w[p + 1 : p + m] g
  from (select doc_id, w, m, unnest(range(len(w) - m + 1)) p from words, lengths where len(w) >= m)
), hits as (select doc_id, p, m, item_id from doc_windows join item_windows using (g)),
n as (
  select doc_id, count(distinct q) n_hit
  from (select doc_id, unnest(range(p, p + m)) q from (select distinct doc_id, p, m from hits)) group by doc_id
), i as (
  select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids
  from (select distinct doc_id, cast(item_id as varchar) id from hits) group by doc_id
)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, n_hit is not null contaminated
from words left join n using (doc_id) left join i using (doc_id)""",
    "op11_exact_dedup": r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') t, length(coalesce(text, '')) c from documents
)
select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by t) group_size,
       row_number() over w = 1 kept, sha256(t) text_sha256
from n window w as (partition by t order by c desc, doc_id nulls last)""",
    "op12_merkle_manifest": f"""
with recursive {_CRC}, leaves as (
  select doc_id, lang, sha256({_MARKED} || coalesce(strlen(text) || ':' || text, '-')) h,
         case when coalesce({_crc32("doc_id")} % 3 = 0, false)
              then sha256({_MARKED} || coalesce(strlen({_LOWERED}) || ':' || {_LOWERED}, '-')) end bad
  from documents, crcs
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 pos from leaves
), runs as (
  select 0 lvl, lang, pos // 8 run, list(h order by pos) hs, count(*) over (partition by lang) n from placed group by lang, pos // 8
  union all
  select lvl + 1, lang, run // 8, list(sha256(array_to_string(hs, '')) order by run), count(*) over (partition by lang)
  from runs where n > 1 group by lvl, lang, run // 8
), tops as (
  select lang, h from (select lang, case when len(hs) = 1 and lvl = 0 then hs[1] else sha256(array_to_string(hs, '')) end h,
    row_number() over (partition by lang order by lvl desc) r, n from runs where n = 1) where r = 1
), ordered as (select *, row_number() over (order by lang nulls first) - 1 pos from tops),
up_runs as (
  select 0 lvl, pos // 8 run, list(h order by pos) hs, count(*) over () n from ordered group by pos // 8
  union all
  select lvl + 1, run // 8, list(sha256(array_to_string(hs, '')) order by run), count(*) over ()
  from up_runs where n > 1 group by lvl, run // 8
), top as (
  select case when len(hs) = 1 and lvl = 0 then hs[1] else sha256(array_to_string(hs, '')) end root
  from up_runs where n = 1 order by lvl desc limit 1
), single as (select lang, count(*) = 1 one from placed group by lang),
climb as (
  select doc_id, h, placed.lang, pos, pos place, 0 lvl, coalesce(bad, h) d, '' p from placed
  union all
  select doc_id, h, c.lang, pos, place // 8, c.lvl + 1,
         sha256(array_to_string(hs[1 : place % 8] || [d] || hs[place % 8 + 2 : 8], '')),
         p || array_to_string(hs[1 : place % 8] || hs[place % 8 + 2 : 8], '')
  from climb c join runs r on r.lang is not distinct from c.lang and r.lvl = c.lvl and r.run = c.place // 8
  join single s on s.lang is not distinct from c.lang where not s.one
), below as (
  select * from (select *, row_number() over (partition by lang, pos order by lvl desc) r from climb) where r = 1
), upper as (
  select doc_id, b.h, b.lang, b.pos, o.pos place, 0 lvl, d, p, o.h subroot
  from below b join ordered o on o.lang is not distinct from b.lang
  union all
  select doc_id, h, lang, pos, place // 8, u.lvl + 1, sha256(array_to_string(hs[1 : place % 8] || [d] || hs[place % 8 + 2 : 8], '')),
         p || array_to_string(hs[1 : place % 8] || hs[place % 8 + 2 : 8], ''), subroot
  from upper u join up_runs r on r.lvl = u.lvl and r.run = u.place // 8
  where (select count(*) from tops) > 1
)
select doc_id, h leaf, subroot, root, sha256(p) proof_sha256, d folded_root, d = root verified
from (select *, row_number() over (partition by lang, pos order by lvl desc) r from upper), top where r = 1""",
    "op13_conversation_trie": rf"""
with {_CRC}, turns as (
  select conv_id, coalesce(role, '') role, coalesce(text, '') text, row_number() over (partition by conv_id
    order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 pos
  from conversations where conv_id is not null
), heads as (
  select conv_id, count(*) n, conv_id - conv_id % 20 base, {_crc32("conv_id")} % 4 h from turns, crcs group by conv_id, crc
), built as (
  select c.conv_id, 0 own, pos, role, text from heads c join turns t on t.conv_id = c.base and t.pos < h
  union all
  select c.conv_id, 1, pos, role, text from heads c join turns t on t.conv_id = c.conv_id and t.pos >= h
), convs as (
  select h.conv_id, coalesce(list({{'role': role, 'text': text}} order by own, pos) filter (where role is not null), []) l
  from heads h left join built using (conv_id) group by h.conv_id
), ways as (select conv_id, l, d, l[1:d] way from (select *, unnest(range(len(l) + 1)) d from convs)),
nodes as (
  select way, d, min(conv_id) conv_id, count(*) n,
         string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(l) = d) ends
  from ways group by way, d
), families as (select way[1 : d - 1] way, count(*) n_children from nodes where d > 0 group by 1),
known as (
  select nodes.*, coalesce(n_children, 0) n_children, case when d > 0 then
    (n - 1) * len(regexp_extract_all(way[d].text, '[^\x20\x09-\x0D]+')) else 0 end saved
  from nodes left join families using (way)
), sums as (
  select way[1:e] way, sum((n_children = 0)::int)::bigint n_leaves, sum(saved)::bigint saved_tokens
  from (select *, unnest(range(d + 1)) e from known) group by 1
)
select k.conv_id, k.d::bigint depth, p.conv_id parent_conv_id, k.n n_convs, k.n_children, n_leaves, saved_tokens,
       sha256(coalesce(k.ends, '')) ends_sha256
from known k join sums on sums.way = k.way left join nodes p on k.d > 0 and p.d = k.d - 1 and p.way = k.way[1 : k.d - 1]""",
}
