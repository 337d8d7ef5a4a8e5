"""The operators over the given tables, one query each, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import (bloom_scores, html_text, mixing, near_dedup, packing, pair_counts,
                         phrase_prints, secrets, token_counts, token_files, toxicity,
                         vector_dedup, whitening)
from corvane.llm.common import table

#: The registered dedup takes pairs of words.
PAIR = 2


def op1_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents"), PAIR)


def op2_poisson_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "source", "lang", "text", "n_chars", "mix_copies", "mix_copy", "mix_key")


def op3_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def op4_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf, "documents")))


def op5_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def op6_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secrets_report(table(spark, sf, "documents"))


def op7_vector_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf, "embeddings"))


def op8_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.token_files(table(spark, sf, "documents"))


def op9_phrase_prints(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_prints.edit_likeness(table(spark, sf, "documents"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op11_vector_whitening(spark: SparkSession, sf: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_bloom_scores(spark: SparkSession, sf: str) -> DataFrame:
    return bloom_scores.score_documents(table(spark, sf, "documents"),
                                        F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op13_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pair_counts.token_alignment(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_minhash_dedup, op2_poisson_mix, op3_html_text, op4_length_histogram,
        op5_best_fit_packing, op6_secret_scan, op7_vector_dedup, op8_token_files,
        op9_phrase_prints, op10_toxicity, op11_vector_whitening, op12_bloom_scores, op13_pair_counts)}

_COMPONENTS = """
both_ways as (select a, b from links union select b, a from links),
reached(a, b) as (select a, b from both_ways
                  union select r.a, l.b from reached r join both_ways l on r.b = l.a),
roots as (select a, least(a, min(b)) as root from reached group by a)
"""

OP1_SQL = f"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda w: w <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < {PAIR} then [w[1]] else
    list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) end as s
  from words),
items as (select doc_id, len(s) as n, unnest(s) as x from sets),
shared as (
  select p.doc_id as a, q.doc_id as b, any_value(p.n) as n, any_value(q.n) as m, count(*) as c
  from items p join items q on p.x = q.x and p.doc_id < q.doc_id
    and 5 * least(p.n, q.n) >= 4 * greatest(p.n, q.n)
  group by all),
links as (select a, b from shared where 100 * c >= 80 * (n + m - c)),
{_COMPONENTS}
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(r.root, s.doc_id) as component_id,
  coalesce(r.root, s.doc_id) = s.doc_id as kept
from sets s left join roots r on r.a = s.doc_id
"""


def _uniform(parts: str) -> str:
    return (f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13))::bigint"
            f" / {float(1 << 52)})")


OP2_SQL = f"""
with recursive sizes as (select source, count(*) as n, sqrt(count(*)::double) as weight
  from documents group by source),
whole as (select sum(weight::decimal(28, 6))::double as w, sum(n)::double as n from sizes),
rates as (select source, whole.n * (weight / w) / sizes.n as rate from sizes, whole),
parts as (select source, greatest(ceil(rate / {mixing.PART_MEAN}), 1)::int as m, rate from rates),
cdf(source, k, mean, term, below) as (
  select source, 0, rate / m, exp(-(rate / m)), exp(-(rate / m)) from parts
  union all select source, k + 1, mean, term * mean / (k + 1), below + term * mean / (k + 1)
  from cdf where k < {mixing.TERMS}),
draws as (
  select d.doc_id, d.source, d.lang, d.text, d.n_chars, unnest(range(1, m + 1)) as part
  from documents d join parts p on d.source is not distinct from p.source),
copies as (
  select d.doc_id, d.source, d.lang, d.text, d.n_chars, count(*)::int as n
  from draws d join cdf c on d.source is not distinct from c.source
    and c.below <= {_uniform(f"'{mixing.SEED}', d.doc_id, d.part")}
  group by all),
each as (select *, unnest(range(1, n + 1))::int as copy from copies)
select doc_id, source, lang, text, n_chars, n as mix_copies, copy as mix_copy,
  md5(concat_ws('|', '{mixing.SEED}', doc_id, copy)) as mix_key from each
"""


def _spans_sql() -> str:
    """All parts of each text as (doc_id, start, rank, end)."""
    out = []
    kinds = [(p, g, n, 1 << 30, ()) for p, g, n in secrets.BASE.values()] + [
        (p, 0, 1, most, needs) for _, p, most, needs in secrets.WEAK.values()]
    for rank, (pattern, group, least, most, needs) in enumerate(kinds):
        p = "'" + pattern.replace("'", "''") + "'"
        good = " and ".join([f"length(g[k]) >= {least}", f"length(m[k]) <= {most}",
                             *(f"regexp_matches(m[k], '{need}')" for need in needs)])
        out.append(f"""
select doc_id, rank, start, start + length(m[k]) as stop from (
  select *, (list_sum(list_transform(b[1:k], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::bigint as start
  from (select doc_id, {rank} as rank, regexp_extract_all(text, {p}, 0) as m,
          regexp_extract_all(text, {p}, {group}) as g, string_split_regex(text, {p}) as b,
          unnest(range(1, len(m) + 1)) as k
        from texts)) where {good}""")
    return " union all ".join(out)


def _list_sql(where: str) -> str:
    kinds = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    return (f"coalesce(string_agg(concat({kinds}[rank + 1], ':', start, ':', stop), ',' "
            f"order by start, rank) filter ({where}), '')")


_ROLE = "case {0}.rank " + " ".join(
    f"when {k} then '{r}'" for k, r in enumerate(
        [*(secrets.BASE_ROLES[b] for b in secrets.BASE), *(w[0] for w in secrets.WEAK.values())])
) + " end"
_N = len(secrets.BASE)

OP6_SQL = f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
parts as ({_spans_sql()}),
met as (
  select a.doc_id, a.rank, a.start, a.stop, {_ROLE.format("a")} as role,
    bool_or(b.start < a.stop and b.stop > a.start and b.rank < {_N}) as covered,
    bool_or({_ROLE.format("b")} = 'id') as has_id,
    bool_or({_ROLE.format("b")} = 'secret') as has_secret,
    bool_or({_ROLE.format("b")} = 'endpoint') as has_endpoint
  from parts a join parts b on a.doc_id = b.doc_id and a.rank >= {_N}
    and b.start <= a.stop + {secrets.SCOPE} and b.stop >= a.start - {secrets.SCOPE}
  group by all),
kept as (
  select doc_id, rank, start, stop from parts where rank < {_N}
  union all select doc_id, rank, start, stop from met where not covered and (
    role = 'id' and has_secret or role = 'secret' and (has_id or has_endpoint)
    or role = 'endpoint' and has_id and has_secret))
select d.doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access,
  count(*) filter (rank = 2) as n_hex, sha256({_list_sql(f"rank < {_N}")}) as base_sha256,
  {_list_sql("rank is not null")} as spans
from documents d left join kept k on k.doc_id = d.doc_id group by d.doc_id
"""

OP7_SQL = f"""
with recursive good as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select p.vec_id as a, q.vec_id as b from good p join good q
  on p.label = q.label and len(p.v) = len(q.v) and p.vec_id < q.vec_id
  where list_cosine_similarity(p.v, q.v) >= {vector_dedup.LINK}),
{_COMPONENTS},
counts as (select a, count(*) as n from both_ways group by a)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, coalesce(r.root, e.vec_id) as component_id,
  coalesce(r.root, e.vec_id) = e.vec_id as kept
from embeddings e left join roots r on r.a = e.vec_id left join counts c on c.a = e.vec_id
"""

ORACLES = {"op1_minhash_dedup": OP1_SQL, "op2_poisson_mix": OP2_SQL,
           "op6_secret_scan": OP6_SQL, "op7_vector_dedup": OP7_SQL}
