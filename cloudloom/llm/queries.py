"""The thin query of each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, clustering, exact_dedup, hard_negatives, language_id, line_dedup, mixing, packing, quality, secret_scan, simhash, tokens, url_filter
from .common import held_out, scratch_path, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs, ~held_out(F.col("doc_id")))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), added=True)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = secret_scan.as_text(F.col("spans"))
    return found.select("doc_id", *(count(r.kind) for r in secret_scan.RULES), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokens.write_files(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), tokenizer_path(), added=True)
    return tokens.read_documents(files, tokens.crc_of, "doc_id long, start long, n_tokens long, value long").withColumnRenamed("value", "ids_crc32")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("bucket")


# The target weights of the mixture; nodes without one weigh 1.
MIXTURE = {
    ("domain0",): 5, ("domain1",): 3, ("domain2",): 2,
    ("*", "en"): 6, ("*", "de"): 2, ("*", "fr"): 2, ("*", "es"): 1,
}
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.75, 3, 42


def domain_of():
    """Sources are dealt to three domains by their number; the others are domain3."""
    number = F.regexp_extract("source", "^src([0-9]{1,9})$", 1)
    return F.when(F.length(number) > 0, F.concat(F.lit("domain"), (F.try_to_number(number, F.lit("999999999")).cast("long") % 3).cast("string"))).otherwise("domain3")


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, MIXTURE, domain_of(), BUDGET_SHARE, MAX_EPOCHS, SEED)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "epoch", "domain", "lang", "source", "tokens")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    out = quality.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# The rules of the URL filter.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, url_filter.learn(pages, URL_RULES)).drop("url")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash_dedup, op3_best_fit_packing, op4_nearest_neighbours, op5_secret_scan, op6_token_files, op7_exact_dedup, op8_mixing, op9_quality, op10_line_dedup, op11_centroid_clustering, op12_url_filter, op13_hard_negatives)}

_ASSIGN, _ACCESS, _HEX = (r.pattern.replace("'", "''") for r in secret_scan.RULES)


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""
  select doc_id, '{kind}' as kind, {rank} as rank, list_sum(sizes[1:i]) + coalesce(list_sum(hits[1:i-1]), 0) as s,
         list_sum(sizes[1:i]) + list_sum(hits[1:i]) as e
  from (select doc_id, sizes, hits, tested, unnest(range(1, len(hits) + 1)) as i from (
    select doc_id, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) as sizes,
           list_transform(regexp_extract_all(text, '{pattern}', 0), lambda x: length(x)) as hits,
           list_transform(regexp_extract_all(text, '{pattern}', {group}), lambda x: length(x)) as tested
    from d)) where tested[i] >= {least}"""


def _shared_out(name: str, above: str, keys: str, last: str, weight: str) -> str:
    """CTEs that share the budgets of ``above`` among the nodes of ``name``."""
    on = f"join {above}_b using ({keys})" if keys else f"cross join {above}_b"
    part = f"partition by {keys}" if keys else ""
    return f"""
{name}_w as (select n.*, {weight} as weight, up.budget as budget_up from {name} n {on.replace(above + "_b", above + "_b up")}),
{name}_l as (select *, budget_up - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as left_,
  sum(weight) over (o rows between current row and unbounded following) as heavy_
  from {name}_w window o as ({part} order by cap::double / weight::double, {last})),
{name}_f as (select *, cap::hugeint * heavy_::hugeint <= weight::hugeint * left_::hugeint as full_ from {name}_l),
{name}_k as (select *, budget_up - coalesce(sum(case when full_ then cap end) over ({part}), 0) as kept_,
  sum(case when not full_ then weight end) over ({part}) as open_ from {name}_f),
{name}_b as (select * exclude (weight, budget_up, left_, heavy_, full_, kept_, open_),
  case when full_ then cap else ((weight::hugeint * kept_::hugeint) // open_::hugeint)::bigint end as budget from {name}_k)"""


def _mixing_sql() -> str:
    case = lambda k, at: "case " + " ".join(f"when {at} = '{p[-1]}' then {w}" for p, w in MIXTURE.items() if len(p) == k) + " else 1 end"
    return rf"""
with d as (select doc_id, lang, source, coalesce('domain' || (nullif(regexp_extract(source, '^src([0-9]{{1,9}})$', 1), '')::bigint % 3), 'domain3') as d,
  coalesce(lang, '') as l, coalesce(source, '') as s, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) + 1 as n from documents),
leaf as (select d, l, s, sum(n)::bigint as tokens, (sum(n) * {MAX_EPOCHS})::bigint as cap from d group by all),
lang_ as (select d, l, sum(cap)::bigint as cap from leaf group by all),
dom as (select d, sum(cap)::bigint as cap from lang_ group by all),
root_b as (select least(floor(sum(tokens) * {BUDGET_SHARE}::double)::bigint, sum(cap)::bigint) as budget from leaf),
{_shared_out("dom", "root", "", "d", case(1, "d"))},
{_shared_out("lang_", "dom", "d", "l", case(2, "l")).replace("n.*", "n.*", 1)},
{_shared_out("leaf", "lang_", "d, l", "s", "1")},
e as (select *, budget // tokens as epochs, budget % tokens as rest from leaf_b),
o as (select d.*, e.epochs, e.rest, md5('{SEED}:' || e.epochs || ':' || d.doc_id) as key from d join e using (d, l, s)),
c as (select *, sum(n) over (partition by d, l, s order by key range between unbounded preceding and current row) as upto from o),
t as (select *, epochs + (upto <= rest)::bigint as times from c)
select doc_id, unnest(range(times))::int as epoch, d as domain, lang, source, n::bigint as tokens from t where times > 0"""


def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """Each round joins all vectors with all centroids, a row a component."""
    steps = [f"c0 as (select nth as cluster, pos, x from (select rid, row_number() over (order by sha256('1:' || vec_id), rid) - 1 as nth from r) join v using (rid) where nth < {k})"]
    for i in range(rounds + 1):
        steps.append(f"""
d{i} as (select rid, cluster, sum((v.x - c.x) * (v.x - c.x))::bigint as distance from v join c{i} c using (pos) group by all),
a{i} as (select rid, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from d{i} group by rid)""")
        if i < rounds:
            steps.append(f"""
m{i} as (select a.cluster, v.pos, (floor_div(sum(v.x)::bigint, count(*))) as x from a{i} a join v using (rid) group by all),
c{i + 1} as (select c.cluster, c.pos, coalesce(m.x, c.x) as x from c{i} c left join m{i} m using (cluster, pos))""")
    return f"""
with r as (select row_number() over (order by vec_id) as rid, vec_id, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
v as (select rid, unnest(range(1, 65)) as pos, floor(64 * unnest(embedding)::double)::bigint as x from r),
{",".join(steps)},
s as (select cluster, sha256(string_agg(x::bigint::varchar, ',' order by pos)) as centroid_sha256 from c{rounds} group by cluster)
select r.vec_id, a.cluster::int as cluster, a.distance, sum(a.distance) over (partition by a.cluster)::bigint as cluster_inertia,
       sum(a.distance) over ()::bigint as inertia, s.centroid_sha256
from a{rounds} a join r using (rid) join s using (cluster)""".replace("floor_div(sum(v.x)::bigint, count(*))", "(sum(v.x)::bigint - (((sum(v.x)::bigint % count(*)) + count(*)) % count(*))) // count(*)")


_HARD_NEGATIVES_SQL = """
with e as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
a as (select * from e where vec_id % 50 = 0),
s as (select a.vec_id as anchor_id, e.vec_id, a.label = e.label as same, list_inner_product(a.v, e.v)::bigint as score
  from a join e on len(a.v) = len(e.v) and (a.vec_id <> e.vec_id or a.label <> e.label)),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3"""


SQL = {
    "op11_centroid_clustering": _clustering_sql(),
    "op13_hard_negatives": _HARD_NEGATIVES_SQL,
    "op5_secret_scan": f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
spans as ({" union all ".join((_sql_spans("assign", 0, _ASSIGN, 2, 12), _sql_spans("access", 1, _ACCESS, 0, 18), _sql_spans("hex", 2, _HEX, 0, 16)))}),
each as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
         count(*) filter (kind = 'hex') as n_hex, string_agg(concat(kind, ':', s::bigint, ':', e::bigint), ',' order by s, rank) as spans from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join each using (doc_id)""",
    "op7_exact_dedup": r"""
with d as (select doc_id, coalesce(length(text), 0) as cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
r as (select *, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size from d
      window w as (partition by text_sha256 order by cp desc, doc_id nulls last))
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from r""",
    "op8_mixing": _mixing_sql(),
    "op10_line_dedup": f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as pos from d),
k as (select doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') as key from l),
s as (select key, max(doc_id) as stays from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.doc_id, k.line, k.pos, s.key is not null and k.doc_id <> s.stays as gone from k left join s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id""",
}
