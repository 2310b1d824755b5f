"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    scored = classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return scored.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", "predicted")


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents", "doc_id", "source", "text")).drop("source")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import tag

    scored = tag(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", "predicted", "spans")


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents", "lang", "text"))


@query
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_conversations

    control = F.lit("</s>[INST] ok [/INST]")
    probe = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(("user", "assistant"))])).alias("x")
    planted = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), probe).select("conv_id", "x.turn", "x.role", control.alias("text"))
    return digests(format_conversations(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(planted)))


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restored

    cut = fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select(
        "row.doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL["op4_warc"] = """
with p as (
  select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as digest,
    max(page_id) over (partition by coalesce(html, '')) as holder
  from pages)
select page_id, n as payload_bytes, digest as payload_digest,
  case when n >= 1000 and page_id <> holder then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> holder then holder end as refers_to
from p
"""


SQL["op6_mixing"] = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, '')) as key
  from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w, source_size * 3 as cap from s0),
s2 as (select *, sum(source_size) over () as total,
         coalesce(sum(cap) over (order by cap * (6 // w), source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
         sum(w) over (order by cap * (6 // w), source nulls last rows between current row and unbounded following) as w_left
       from s1),
s3 as (select *, cap * w_left <= (total - before) * w as capped from s2),
s4 as (select source, source_size,
         case when capped then cap::double
              else ((total - sum(case when capped then cap else 0 end) over ()) * w)::bigint::double
                   / (sum(case when capped then 0 else w end) over ())::bigint::double end as target
       from s3),
p as (select d.doc_id, d.size, s4.source_size, s4.target,
        coalesce(sum(d.size) over (partition by d.source order by d.key, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from d join s4 on d.source is not distinct from s4.source)
select doc_id, size, source_size, target,
  ((case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end) * size
   + least(greatest(floor(target + 0.5)::bigint
       - (case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end) * source_size - start, 0), size))::bigint as taken
from p
"""

SQL["op8_exact_dedup"] = """
with d as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from d
"""

SQL["op11_phrases"] = """
with d as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text, row_number() over () as d from documents),
p as (
  select lang, d, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) as piece, generate_subscripts(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]'), 1) as p from d),
w as (
  select lang, d, p, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select *, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p) t),
g as (
  select lang, w as w1, lead(w, 1) over o as w2, lead(w, 2) over o as w3, lead(w, 3) over o as w4, lead(w, 4) over o as w5 from w window o as (partition by d, p order by i)),
f as (
  select lang, [w1] as ws, count(*) as f from g group by all having count(*) >= 100
  union all select lang, [w1, w2], count(*) from g where w2 is not null group by all having count(*) >= 100
  union all select lang, [w1, w2, w3], count(*) from g where w3 is not null group by all having count(*) >= 100
  union all select lang, [w1, w2, w3, w4], count(*) from g where w4 is not null group by all having count(*) >= 100
  union all select lang, [w1, w2, w3, w4, w5], count(*) from g where w5 is not null group by all having count(*) >= 100),
n as (select lang, count(*) as n from w group by lang),
inside as (
  select lang, f, ws[i:i + m - 1] as ws from (select lang, f, ws, unnest(range(1, len(ws) - m + 2)) as i, m from (select *, unnest(range(2, len(ws))) as m from f where len(ws) > 2) t) u),
c as (
  select * from f where len(ws) > 1 and not exists (select 1 from inside x where x.lang = f.lang and x.ws = f.ws and 100 * x.f >= 100 * f.f)),
cuts as (
  select c.lang, c.ws, c.f as a, k, l.f as l, r.f as r, n.n, (1000::hugeint * c.f * n.n) // (l.f::hugeint * r.f) as score
  from (select *, unnest(range(1, len(ws))) as k from c) c
  join f l on l.lang = c.lang and l.ws = c.ws[1:k] join f r on r.lang = c.lang and r.ws = c.ws[k + 1:] join n on n.lang = c.lang),
worst as (select * from (select *, row_number() over (partition by lang, ws order by score, k) as o from cuts) t where o = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, array_to_string(ws, ' ')) as rank from worst)
select lang, rank, array_to_string(ws, ' ') as phrase, a, l, r, n, score::bigint as score from ranked where rank <= 2000
"""

SQL["op12_chat"] = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, * from (values (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) t),
t as (
  select *, len(text) + len(regexp_extract_all(text, '[<\\[]\\\\*(/?s>|/?(INST|SYS|ROLE)\\]|(TEXT|IMG|AUDIO|DOC)\\])'))
    + case role when 'user' then 13 when 'assistant' then 4 when 'system' then 11
      else 19 + len(role) + len(regexp_extract_all(role, '[<\\[]\\\\*(/?s>|/?(INST|SYS|ROLE)\\]|(TEXT|IMG|AUDIO|DOC)\\])')) end as chars
  from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first)) as turns_sha256,
  sum(case when role = 'assistant' then len(text) else 0 end)::bigint as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first)) as loss_sha256,
  (3 + sum(chars))::bigint as formatted_chars, 0::bigint as media_tokens
from t group by conv_id
"""

SQL["op13_fill_middle"] = """
with d as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
n as (
  select doc_id, text, len(text) as n, [('0x' || substr(h, 8 * i + 1, 8))::bigint for i in range(4)] as h from d),
c as (
  select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form
  from n),
o as (
  select *, left(text, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from o
"""
