"""One query per numbered operator, with production parameters, over its whole table; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, hardneg, langid, lexical, minhash, quality, substring, suffix, token_counts, toxicity, urls
from .common import fold_of, table

def held_out(folds: int, fold: int) -> Column:
    """Rows of one fold of ids; null ids are in none."""
    return F.coalesce(fold_of("doc_id", folds) == fold, F.lit(False))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out(5, 0)
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold_of("doc_id", 5) != 0))
    return langid.identify(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out(3, 1)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES))


OP5_SQL = r"""
with u as (select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
f as (select *,
    (host = 'net' or host like '%.net') and starts_with(path, '/') as r1,
    (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') as r2,
    (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') as r3,
    (host = 'org' or host like '%.org') and starts_with(path, '/fr/') as r4 from u)
select page_id, host, path,
    case when r2 then 'example.net/en/' when r3 then 'example.com/de/' when r4 then 'org/fr/' when r1 then 'net/' end as rule,
    case when r2 then 'allow' when r3 then 'block' when r4 then 'allow' when r1 then 'block' else 'allow' end as verdict from f
"""


def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_runs(table(spark, sf_dir, "documents"), length=200)


OP6_SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as hx, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, i, md5(substr(hx, (2 * i + 1)::bigint, 400)) as h from (select doc_id, hx, unnest(range(0, n - 199)) as i from d where n >= 200)),
m as (select h from w group by h having count(*) > 1),
s as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from w semi join m using (h)),
r as (select doc_id, i, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by doc_id order by i) as k from s),
g as (select doc_id, k, min(i) as b, max(i) + 200 as e from r group by all),
t as (select doc_id, sum(e - b)::bigint as n_removed, count(*) as n_spans, list(b order by b) as bs, list(e order by b) as es from g group by doc_id)
select d.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
    sha256(unhex(case when bs is null then hx else array_to_string(list_transform(range(1, len(bs) + 2),
        lambda j: substr(hx, 2 * (case when j = 1 then 0 else es[j - 1] end) + 1, 2 * ((case when j > len(bs) then n else bs[j] end) - (case when j = 1 then 0 else es[j - 1] end)))), '') end)) as kept_sha256
from d left join t using (doc_id)
"""


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50),
k as (select doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) as h from p),
m as (select h, min(doc_id) as first_id from k group by h),
r as (select distinct doc_id, unnest(range(i, i + 50)) as pos from k join m using (h) where k.doc_id > m.first_id),
c as (select doc_id, list(pos) as gone from r group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, len(coalesce(gone, []))::bigint as n_removed,
    sha256(coalesce(array_to_string(list_filter(ws, lambda x, j: not list_contains(coalesce(gone, []), j)), ' '), '')) as kept_sha256
from w left join c using (doc_id)
"""


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP8_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
j as (select a.doc_id as x, b.doc_id as y, count(*) as both_n from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select x, y from j join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * both_n >= 85 * (nx.n + ny.n - both_n)),
reach as (select doc_id as a, doc_id as b from w union select r.a, l.y from reach r join l on l.x = r.b),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, w.doc_id = component_id as kept
from w join c using (doc_id) left join n using (doc_id)
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label_col=shifted)


OP11_SQL = r"""
with r as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, list_inner_product(a.q, b.q)::bigint as score from r a join r b on a.vec_id % 50 = 0),
p as (select anchor_id, own, vec_id, score from s where label = own and vec_id <> anchor_id qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id)::integer as rank, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and s.label <> p.own and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
qualify rank <= 3
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
i as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
t as (select count(*) filter (len(ts) > 0) as many, sum(len(ts))::bigint as length from d),
q as (select item_id, term, count(*) as times from i group by all),
f as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ts) as term from d) semi join q using (term) group by all),
w as (select term, floor(1000 * ln((2 * many + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, t group by term, many),
s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ts) * many) // length))))::bigint as score
    from q join f using (term) join w using (term) join d using (doc_id), t group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score from s where score > 0 qualify rank <= 10
"""


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_suffix_arrays": op6_suffix_arrays,
    "op7_substrings": op7_substrings,
    "op8_minhash": op8_minhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_lexical_search": op13_lexical_search,
}
SQL = {"op5_url_filter": OP5_SQL, "op6_suffix_arrays": OP6_SQL, "op7_substrings": OP7_SQL, "op8_minhash": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op13_lexical_search": OP13_SQL}
