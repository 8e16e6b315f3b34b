"""The text operators' queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, mixture, ngram_join, quality_rules, suffix_dedup, token_counts, toxicity, url_lists, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_links(table(spark, sf_dir, "documents"), k=3, num=9, den=10, lower=True)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item; documents without a leak have no row."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the 400-byte repeats, the bytes of repeated passages: 50 words of three letters are 200 bytes."""
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), length=400, passage=200)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)


def url_history(pages: DataFrame) -> DataFrame:
    """The query's list: the pages' own hosts, listed and delisted on dates that md5 of the host
    gives, two whole domains, and the path /en of some hosts."""
    hosts = pages.select(url_lists.host(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("d", F.substring(F.md5("host"), 1, 1))
    entry = lambda where, pattern, at, action: hosts.where(where).select(F.expr(pattern).alias("pattern"), F.lit(at).cast("date").alias("at"), F.lit(action).alias("action"))
    own = entry("d in ('0', '1', '2')", "host", "2024-02-01", "add").union(entry("d in ('0', '1')", "host", "2024-05-01", "remove")).union(entry("d = '0'", "host", "2024-09-01", "add"))
    own = own.union(entry("d = '4'", "host || '/en'", "2024-03-15", "add")).union(entry("d = '5'", "host || '/en'", "2024-06-15", "add"))
    fixed = [("spam-farm.example.org", "2024-03-01", "add"), ("spam-farm.example.org", "2024-11-01", "remove"), ("example.net", "2024-12-20", "add")]
    return own.union(pages.sparkSession.createDataFrame(fixed, "pattern string, at string, action string").withColumn("at", F.col("at").cast("date")))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages; a page's fetch date follows from its page_id."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return url_lists.judge(pages.select("page_id", "url", fetched.alias("fetched")), url_history(pages))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"), least_bytes=0)


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_decontamination, op3_quality_rules, op4_token_counts, op5_chat_formatting, op6_suffix_dedup, op7_toxicity, op8_mixing_sources, op9_url_filters, op10_warc)
}

_OP5 = """
with t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as place from conversations),
lines as (select conv_id, place, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as line,
          case when role is null then 'n' else 'r' || role end || chr(1) || case when text is null then 'n' else 't' || text end || chr(2) as said from t),
so_far as (select *, md5(string_agg(said, '' order by place) over (partition by conv_id order by place rows between unbounded preceding and current row)) as prefix,
           count(*) over (partition by conv_id) as n_turns from lines),
whole as (select conv_id, n_turns, prefix from so_far where place = n_turns),
heads as (select n_turns, prefix, min(conv_id) as conv_id from whole group by n_turns, prefix),
kept as (select conv_id, n_turns from heads h where not exists (select 1 from so_far s where s.place = h.n_turns and s.prefix = h.prefix and s.n_turns > h.n_turns))
select s.conv_id, (s.place - 1) // 1024 as part, s.n_turns, string_agg(s.line, '' order by s.place) as rendered
from so_far s join kept k on s.conv_id is not distinct from k.conv_id group by all
"""
_OP8 = r"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('20240229:' || cast(doc_id as varchar)) as spot from documents),
src as (select source, sum(size)::bigint as source_size, count(*) as n_docs from sized group by source),
wgt as (select *, [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, sum(source_size) over ()::double * 1.5::double as total from src),
fil as (select *, 2 * source_size as cap, coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as used,
        sum(weight) over (order by 2 * source_size / weight, source nulls last rows between current row and unbounded following) as rest from wgt),
lvl as (select *, max(case when (total - used) / rest * weight <= cap then (total - used) / rest end) over () as level from fil),
tgt as (select source, source_size, n_docs, least(cap::double, level * weight) as target, round(total / 32)::bigint as blocks from lvl),
quo as (select source, target / (2 * k + 1) as quotient, k, blocks from (select source, target, blocks, unnest(range(blocks)) as k from tgt where target > 0)),
won as (select source, count(*) as quota from (select *, row_number() over (order by quotient desc, source nulls last, k) as place from quo) where place <= blocks group by source),
put as (select s.*, t.source_size, t.target, t.n_docs, coalesce(w.quota, 0) as blocks, ('0x' || substr(s.spot, 1, 8))::bigint % ceil(t.n_docs / 4000)::bigint as shard
        from sized s join tgt t on s.source is not distinct from t.source left join won w on s.source is not distinct from w.source),
shd as (select source, shard, sum(size)::bigint as words, max(blocks) as blocks from put group by source, shard),
squ as (select source, shard, words / (2 * k + 1) as quotient, k, blocks from (select *, unnest(range(blocks)) as k from shd where words > 0)),
swn as (select source, shard, count(*) as quota from (select *, row_number() over (partition by source order by quotient desc, shard, k) as place from squ) where place <= blocks group by source, shard),
lay as (select d.source, d.shard, greatest(1, ceil(d.words / 32)::bigint) as n, coalesce(w.quota, 0) as quota, ('0x' || substr(md5('20240229:' || coalesce(d.source, '') || ':' || d.shard), 1, 8))::bigint as start
        from shd d left join swn w on d.source is not distinct from w.source and d.shard = w.shard),
cut as (select source, shard, n, least(quota, 2 * n) // n as times, least(quota, 2 * n) % n as extra, start % n as shift from lay),
lin as (select p.*, sum(p.size) over (partition by p.source, p.shard order by spot, doc_id, size rows between unbounded preceding and current row)::bigint as stop, c.n, c.times, c.extra, c.shift
        from put p join cut c on p.source is not distinct from c.source and p.shard = c.shard),
two as (select doc_id, size, source_size, target, n, times, extra, shift, stop as b, stop - size as a from lin)
select doc_id, size, source_size, target, (
    times * b + 32 * (((b // 32 + shift) * extra) // n - (shift * extra) // n) + (b - b // 32 * 32) * (((b // 32 + shift + 1) * extra) // n - ((b // 32 + shift) * extra) // n)
  - times * a - 32 * (((a // 32 + shift) * extra) // n - (shift * extra) // n) - (a - a // 32 * 32) * (((a // 32 + shift + 1) * extra) // n - ((a // 32 + shift) * extra) // n))::bigint as taken
from two
"""
_OP9 = r"""
with p as (select page_id, url, date '2024-01-01' + cast(page_id * 37 % 366 as int) as fetched, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') as host,
           list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') as parts from pages),
h as (select distinct host, substr(md5(host), 1, 1) as d from p where host <> ''),
e as (select host as pattern, date '2024-02-01' as since, date '2024-05-01' as until from h where d in ('0', '1')
      union all select host, date '2024-02-01', null from h where d = '2'
      union all select host, date '2024-09-01', null from h where d = '0'
      union all select host || '/en', date '2024-03-15', null from h where d = '4'
      union all select host || '/en', date '2024-06-15', null from h where d = '5'
      union all select 'spam-farm.example.org', date '2024-03-01', date '2024-11-01'
      union all select 'example.net', date '2024-12-20', null),
u as (select pattern, since, until from e where pattern <> 'spam-farm.example.org' or since = date '2024-03-01'),
k as (select distinct url, fetched, unnest(list_distinct(list_concat(
        list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, 1000), '.')),
        list_transform(range(1, len(parts) + 1), lambda i: lower(host || '/' || array_to_string(list_slice(parts, 1, i), '/')))))) as pattern from p where host <> ''),
a as (select k.url, k.fetched, count(*) as n_active, min(k.pattern) as first_pattern from k join u on k.pattern = u.pattern and u.since <= k.fetched and (u.until is null or k.fetched < u.until) group by all)
select p.page_id, p.url, cast(p.fetched as date) as fetched, coalesce(a.n_active, 0) as n_active, a.first_pattern, a.n_active is not null as blocked
from p left join a on p.url is not distinct from a.url and p.fetched = a.fetched
"""
_OP10 = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as s from pages),
f as (select *, min(page_id) over (partition by s) as first from p)
select page_id, strlen(h)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (k * 5 // 4 + 1)::int, 2))::int >> (3 - k * 5 % 4)::int) & 31) + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from f
"""
ORACLES: dict[str, str] = {"op5_chat_formatting": _OP5, "op8_mixing_sources": _OP8, "op9_url_filters": _OP9, "op10_warc": _OP10}
