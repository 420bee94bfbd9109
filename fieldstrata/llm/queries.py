"""Queries of this subpackage's operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import aligntokens, bytededup, centroids, decontaminate, linededup, packing, piispans, qualitymil, qualityrules, simhash, toxicity, warc, worddedup
from .common import table


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_classes(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytededup.dedup_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piispans.find(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualityrules.judge(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = qualitymil.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out(5, 0))
    return scored.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages", "attention")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worddedup.dedup_words(table(spark, sf_dir, "documents")).drop("kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def held_out(modulus: int, rest: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus == rest


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out(3, 1))
    return scored.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("exact_distances")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolved(warc.write(table(spark, sf_dir, "pages")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligntokens.alignment(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_packing, op3_pii, op4_decontamination, op5_suffix_array, op6_simhash, op7_quality_rules, op8_quality_classifier, op9_substring_dedup, op10_toxicity, op11_centroids, op12_warc, op13_token_alignment)}


#: Words of a text (runs of anything but ASCII white space) and its lines that have a word.
_WORDS = "list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '')"
_LINES = "list_filter(string_split(t, chr(10)), lambda x: not regexp_full_match(x, '[ \\t\\n\\x0b\\x0c\\r]*'))"

OP7 = f"""with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, {_WORDS} as w, {_LINES} as l from d),
c as (select *, len(w) as n, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as symbols, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as chars, len(l) - len(list_distinct(l)) as dup from w),
g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, n - 3)) as i from c)),
r as (select doc_id, count(distinct i + k) as repeated from (select doc_id, i, count(*) over (partition by doc_id, s) as times from g) x, (select unnest(range(0, 5)) as k) y where times > 1 group by 1),
f as (select c.*, coalesce(repeated, 0) as repeated, n < 10 or 100 * coalesce(repeated, 0) > 20 * n as failed from c left join r using (doc_id)),
o as (select *, not (chars between 2 * n and 20 * n) or symbols > 0.1 * n or length(t) - length(replace(t, '!', '')) > 0.2 * n
 or len(list_filter(w, lambda x: strlen(x) > 1 and regexp_matches(x, '[A-Z]') and not regexp_matches(x, '[a-z]'))) > 0.5 * n or dup > 0.5 * greatest(len(l), 1)
 or (n >= 50 and len(list_distinct(w)) < 0.05 * least(n, 1000)) or length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) > 0.5 * greatest(strlen(t), 1)
 or len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t\\n\\x0b\\x0c\\r]*$'))) > 0.3 * greatest(len(l), 1) or len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t\\n\\x0b\\x0c\\r]*[-*•]'))) > 0.9 * greatest(len(l), 1) as refused from f)
select doc_id, n::bigint as n_words, chars::bigint as word_chars, symbols::bigint as n_symbols, dup::bigint as n_dup_lines, repeated::bigint as n_repeat_words, failed as base_failed, not failed and not refused as kept from o"""

OP9 = f"""with d as (select doc_id, coalesce(text, '') as t from documents), w as (select doc_id, {_WORDS} as w from d),
g as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as rn from g) where rn > 1),
gone as (select doc_id, list(distinct i + k) as gone from later, (select unnest(range(0, 20)) as k) y group by 1),
k as (select doc_id, w, list_transform(list_filter(range(1, len(w) + 1), lambda i: gone is null or not list_contains(gone, i)), lambda i: w[i]) as kept from w left join gone using (doc_id))
select doc_id, len(w)::bigint as n_words, (len(w) - len(kept))::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k"""



def _op11(rounds: int = 10) -> str:
    """Rounds written out: a numbers the vectors with their nearest centroid, c has the centroids."""
    near = "select vec_id, any_value(x) as x, min({'d': d, 'c': c}) as m from (select v.vec_id, v.x, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::bigint as d from v, c%d c) group by vec_id"
    sums = "select m.c as c, i, sum(e)::bigint as s, count(*)::bigint as n from (select m, unnest(range(1, 65)) as i, unnest(x) as e from a%d) group by 1, 2"
    steps = ["""v as materialized (select vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) as x, sha256('3:' || vec_id) as h from embeddings
 where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64)""", "c0 as materialized (select row_number() over (order by h) - 1 as c, x from v qualify c < 8)"]
    for r in range(rounds):
        steps += [f"a{r} as materialized ({near % r})", f"c{r + 1} as materialized (select c, list((s - (s % n + n) % n) // n order by i) as x from ({sums % r}) group by c union all select c, x from c{r} where c not in (select m.c from a{r}))"]
    steps.append(f"a{rounds} as materialized ({near % rounds})")
    return "with " + ",\n".join(steps) + f"""
select vec_id, m.c::int as cluster, m.d as distance, (sum(m.d) over (partition by m.c))::bigint as cluster_inertia, (sum(m.d) over ())::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.c = a.m.c"""


#: DuckDB has sha1 but no base32: five bits at a time by place, 20 bytes are 32 letters.
OP12 = """with p as (select page_id, coalesce(html, '') as t from pages), g as (select *, min(page_id) over (partition by t) as low from p),
h as (select page_id, low, strlen(t)::bigint as n, sha1(t) as s from g),
b as (select *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', s[i]) - 1), 4, '0')), 'string_agg', '') as bits from h)
select page_id, n as payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 list_sum(list_transform(range(0, 5), lambda k: substr(bits, 5 * i + k + 1, 1)::int * (16 >> k)))::int + 1, 1)), 'string_agg', '') as payload_digest,
case when page_id = low then 'response' else 'revisit' end as record_type, case when page_id <> low then low end as refers_to from b"""


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": OP7, "op9_substring_dedup": OP9, "op11_centroids": _op11(), "op12_warc": OP12}
