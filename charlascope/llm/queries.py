"""Registered queries of the corpus operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from charlascope.llm import (
    alignment,
    decontaminate,
    language,
    lines,
    neighbours,
    orderhash,
    packing,
    ranking,
    repeats,
    secrets,
    simhash,
    toxicity,
    warc,
)
from charlascope.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("record_id", "url")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_digest(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_counts(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.edited_likeness(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def registered() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


WARC_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages
), d as (
  select page_id, n, sha256(html) as digest, min(page_id) over (partition by html) as first from p
)
select page_id, n as payload_bytes, digest as payload_digest,
  case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to
from d
"""

RANKING_SQL = """
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents
), i as (
  select row_number() over () as q, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from benchmark
), sized as (
  select r, doc_id, len(terms) as n, terms from d where len(terms) > 0
), totals as (
  select count(*)::bigint as big_n, sum(n)::bigint as big_l from sized
), asked as (
  select q, item_id, term, count(*) as repeats from i group by all
), tf as (
  select r, term, count(*) as tf from (select r, unnest(terms) as term from sized)
  where term in (select term from asked) group by all
), df as (
  select term, count(*) as df from tf group by term
), impact as (
  select tf.r, tf.term,
    floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)::double))::bigint
      * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) as points
  from tf join df using (term) join sized using (r) cross join totals
), scored as (
  select q, item_id, r, doc_id, sum(points * repeats)::bigint as score
  from asked join impact using (term) join sized using (r) group by q, item_id, r, doc_id
), ranked as (
  select item_id, doc_id, score, row_number() over (partition by q order by score desc, doc_id nulls last) as rank
  from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""

# Text between the matches, from splitting, and the matches' own lengths give their places.
SECRETS_SQL = f"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), m as ({" union all ".join(
    f"""select r, {place} as place, '{rule.kind}' as kind,
    list_transform(string_split_regex(t, p), lambda x: length(x)) as gaps,
    list_transform(regexp_extract_all(t, p, 0), lambda x: length(x)) as sizes,
    list_transform(regexp_extract_all(t, p, {rule.group}), lambda x: length(x)) as tested, {rule.least} as least
  from (select *, '{rule.pattern.replace("'", "''")}' as p from d)"""
    for place, rule in enumerate(secrets.RULES)
)}), e as (
  select *, unnest(range(1, len(sizes) + 1)) as i from m where len(sizes) > 0
), s as (
  select r, place, kind, list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) as begins, sizes[i] as size
  from e where tested[i] >= least
), named as (
  select r, place, kind, begins, kind || ':' || cast(begins as bigint) || ':' || cast(begins + size as bigint) as span from s
), g as (
  select r, string_agg(span, ',' order by begins, place) as spans,
    string_agg(span, ',' order by begins, place) filter (place < {len(secrets.BASE)}) as base,
    {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in secrets.BASE)}
  from named group by r
)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in secrets.BASE)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (r)
"""


def oracles() -> dict[str, str]:
    """SQL for the operators that it can express."""
    return {"op1_warc": WARC_SQL, "op3_secrets": SECRETS_SQL, "op11_ranking": RANKING_SQL}
