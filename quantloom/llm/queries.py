"""The corpus operators' queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import langid, line_dedup, media, ngram_join, packing, quality, sentencepiece_codec, suffix_dedup, url_filter, warc

#: (action, host, path) of the URL rules.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), special=True)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.delete_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_ngram_jaccard_join, op3_best_fit_packing, op4_url_filter, op5_line_dedup,
        op6_suffix_array_dedup, op7_warc, op8_quality_rules, op9_language_id, op10_media_columns,
    )
}

_FITS = " union all ".join(f"select '{a}' as action, '{h}' as host, '{p}' as path" for a, h, p in URL_RULES)
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op4_url_filter": rf"""
with rules as ({_FITS}),
split as (
  select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from split),
fits as (
  select p.page_id, r.action, r.host || r.path as rule,
    row_number() over (partition by p.page_id order by length(r.host || r.path) desc, length(r.host) desc, r.action desc) as k
  from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path))
select p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') as verdict
from parts p left join fits f on f.page_id = p.page_id and f.k = 1""",
    "op7_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select *, case when n >= 100 then min(page_id) over (partition by d, n) else page_id end as first from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type,
  case when first = page_id then null else first end as refers_to from f""",
    "op8_quality_rules": rf"""
with w as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text, {_WORDS} as words from documents),
pos as (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3),
tri as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as n from pos),
again as (
  select doc_id, count(distinct i + d) as n from tri, (select unnest([0, 1, 2]) as d) where n > 1 group by doc_id),
lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as dup
  from (select doc_id, unnest(string_split(text, chr(10))) as line from w)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (
  select w.doc_id, host, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(dup, 0) as bigint) as n_dup_lines, cast(coalesce(again.n, 0) as bigint) as n_repeat_words, coalesce(n_lines, 0) as n_lines
  from w left join again using (doc_id) left join lines using (doc_id)),
f as (
  select *, case when n_words < 50 then 1 else 0 end as r1, case when 100 * n_repeat_words > 50 * n_words then 1 else 0 end as r2,
    case when 10 * n_symbols > n_words then 1 else 0 end as r3, case when 100 * n_dup_lines > 30 * n_lines then 1 else 0 end as r4,
    case when word_chars < 2 * n_words or word_chars > 15 * n_words then 1 else 0 end as r5 from m),
h as (select host, rule, cast(count(*) as double) as n, cast(sum(bad) as double) as k from (unpivot f on r1, r2, r3, r4, r5 into name rule value bad) group by host, rule),
t as (select rule, sum(n) as n, sum(k) / sum(n) as mean, sum(k * k / n) / sum(n) - power(sum(k) / sum(n), 2) as spread from h group by rule),
s as (select rule, mean, case when spread > 0 then least(1e6, greatest(1.0, mean * (1 - mean) / spread - 1)) else 1e6 end as weight from t),
bad as (
  select host, bool_or((k + mean * weight) / (n + weight) > {quality.MAX_RATE}) as host_rejected,
    bool_or(rule = 'r3' and (k + mean * weight) / (n + weight) > {quality.STRICT} * mean) as s3,
    bool_or(rule = 'r4' and (k + mean * weight) / (n + weight) > {quality.STRICT} * mean) as s4,
    bool_or(rule = 'r5' and (k + mean * weight) / (n + weight) > {quality.STRICT} * mean) as s5
  from h join s using (rule) group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 + r2 > 0 as base_failed,
  r1 + r2 = 0 and not host_rejected and not (r3 = 1 and s3) and not (r4 = 1 and s4) and not (r5 = 1 and s5) as kept, host_rejected
from f join bad using (host)""",
}
