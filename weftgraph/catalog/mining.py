"""Registered queries: co-change mining, text functions, routes and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import retrieval as r
from ..operators import temporal as tm
from ..sources.graph_views import commits, nodes, table
from .registry import query

_COMMITS = """c as (select o_orderkey::varchar as hash, epoch(o_orderdate)::double as ts, list(l_suppkey::varchar) as files from orders join lineitem on o_orderkey = l_orderkey group by 1, 2)"""
_ITEMS = f"""{_COMMITS}, latest as (select max(ts) as latest from c),
i as (select hash, ts, age, exp(-ln(2) / 180.0::double * age) as weight, unnest(list_distinct(files)) as file from (select hash, ts, files, greatest(0.0::double, (latest - ts) / 86400) as age from c, latest where len(files) between 2 and 50))"""
_PAIRS = f"""{_ITEMS}, p as (select a.file as file_a, b.file as file_b, sum(a.weight) as weight, count(*) as n, min(a.age) as age from i a join i b on a.hash = b.hash and a.file <> b.file group by 1, 2)"""
_REL = f"""{_PAIRS}, s as (select file as file_a, sum(weight) as weight_a, count(*) as total_commits_a from i group by 1),
rel as (select file_a, file_b, round(least(0.99::double, weight / weight_a), 4) as probability, n as co_commit_count, total_commits_a, round(age, 1) as last_co_commit_age_days from p join s using (file_a) where n >= 2 and least(0.99::double, weight / weight_a) >= LEAST)"""


@query(f"with {_PAIRS} select file_a, file_b, round(weight, 6) as weight, n, round(age, 3) as age from p")
def cochange_pairs(spark, d):
    return tm.pairs(tm.touched(commits(spark, d))).select("file_a", "file_b", F.round("weight", 6).alias("weight"), "n", F.round("age", 3).alias("age"))


@query(f"with {_REL} select * from rel".replace("LEAST", "0.05"))
def cochange_prob(spark, d):
    return tm.co_changes(commits(spark, d), min_confidence=0.05)


@query(f"with {_REL} select * from rel where file_a = '7' order by probability desc, file_b limit 20".replace("LEAST", "0.01"))
def cochange_target(spark, d):
    return tm.for_target(tm.co_changes(commits(spark, d), min_confidence=0.01), "7")


@query(f"with {_REL} select 'py:' || file_a || '::' as src, 'py:' || file_b || '::' as dst, 'CO_CHANGED_WITH' as type, 'dynamic' as confidence from rel".replace("LEAST", "0.08"))
def cochange_edges(spark, d):
    return tm.edges(tm.co_changes(commits(spark, d), min_confidence=0.08))


_SPLIT = f"""{_COMMITS}, k as (select ts as cut from (select ts, row_number() over (order by ts) - 1 as place, count(*) over () as n from c) where place = greatest(2, floor(0.7 * n)))"""


@query(f"with {_SPLIT} select case when ts <= cut then 'train' else 'test' end as part, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from c, k group by 1")
def temporal_split(spark, d):
    return tm.split_at(commits(spark, d)).groupBy("part").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""with {_COMMITS}, by_ as (select ts, sum(count(*)) over (order by ts) as upto from c group by ts), n as (select count(*) as total from c),
cut as (select min(ts) as cut from by_, n where upto > least(greatest(2, floor(0.7::double * total)::bigint), total - 1)), tr as (select c.* from c, cut where ts <= cut),
te as (select hash, list_distinct(files) as files from c, cut where ts > cut and len(files) between 2 and 50), latest as (select max(ts) as latest from tr), h as (select unnest([90.0, 180.0])::double as half_life),
i as (select half_life, hash, age, exp(-ln(2) / half_life * age) as weight, unnest(list_distinct(files)) as file from (select hash, files, greatest(0.0::double, (latest - ts) / 86400) as age from tr, latest where len(files) between 2 and 50), h),
p as (select a.half_life, a.file as file_a, b.file as file_b, sum(a.weight) as weight, count(*) as n from i a join i b on a.half_life = b.half_life and a.hash = b.hash and a.file <> b.file group by 1, 2, 3),
s as (select half_life, file as file_a, sum(weight) as weight_a from i group by 1, 2), rel as (select half_life, file_a, file_b, round(least(0.99::double, weight / weight_a), 4) as probability from p join s using (half_life, file_a) where n >= 2 and least(0.99::double, weight / weight_a) >= 0.25),
k as (select *, row_number() over (partition by half_life, file_a order by probability desc, file_b) as rank from rel), a as (select hash, unnest(files) as file_a, files from te where len(files) > 1),
q as (select half_life, hash, file_a, len(files) as m, count(*) filter (rank <= 5 and list_contains(files, file_b)) as at_5, count(*) filter (list_contains(files, file_b)) as at_10, min(case when list_contains(files, file_b) then rank end) as first from a join k using (file_a) where rank <= 10 group by 1, 2, 3, 4)
select half_life, count(hash) as n, round(avg(at_5 / 5::double), 4) as precision_5, round(avg(at_5 / (m - 1)::double), 4) as recall_5, round(avg(at_10 / 10::double), 4) as precision_10, round(avg(at_10 / (m - 1)::double), 4) as recall_10, round(avg(case when hash is not null then coalesce(1 / first::double, 0) end), 4) as mrr
from h left join q using (half_life) group by 1""")
def temporal_eval(spark, d):
    return tm.evaluate(commits(spark, d), half_lives=(90.0, 180.0))


@query(r"select event_id, path[1] as key, path[2] as value from (select event_id, [regexp_extract(props, '\"([^\"]+)\": *([^,}]+)', 1), regexp_extract(props, '\"([^\"]+)\": *([^,}]+)', 2)] as path from events)")
def json_flatten(spark, d):
    from ..sources.parse import flat_json

    return flat_json(table(spark, d, "events").select("event_id", "props"), "props").select("event_id", "key", "value")


_STEM = r"""case when length(w) <= 3 then w
 when w in ('configuration', 'configure', 'configuring', 'configured') then 'config' when w in ('parameters', 'parameter') then 'param' when w in ('specification', 'specifications') then 'spec'
 when w like '%ies' and length(w) > 4 then w[:-4] || 'y'
 when regexp_matches(w, '(sses|shes|ches|xes)$') and length(w) > 4 then w[:-3]
 else case when s like '%ation' and length(s) > 6 then s[:-6] || 'ate' when s like '%ition' and length(s) > 6 then s[:-6] || 'ite'
  when s like '%tion' and s not like '%ation' and length(s) > 5 then s[:-4] when s like '%ying' and length(s) > 5 then s[:-5] || 'y'
  when s like '%ing' and length(s) > 4 then VERB(s[:-4]) when s like '%ied' and length(s) > 4 then s[:-4] || 'y' when s like '%ed' and length(s) > 4 then VERB(s[:-3]) else s end end"""


def _verb(sql: str) -> str:
    for cut in ("s[:-4]", "s[:-3]"):
        sql = sql.replace(f"VERB({cut})", f"case when regexp_matches({cut}, '(at|iz|id)$') or {cut} in ('pars', 'clos', 'mak', 'writ') then {cut} || 'e' when length({cut}) >= 2 and {cut}[-1:] = {cut}[-2:-2] and {cut}[-1:] <> 's' then {cut}[:-2] else {cut} end")
    return sql


@query(_verb(f"""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from conversations), s as (select w, case when w like '%s' and not regexp_matches(w, '(ss|us|is)$') and length(w) > 3 then w[:-2] else w end as s from w)
select w as term, {_STEM} as stem from s"""))
def stem_terms(spark, d):
    terms = table(spark, d, "conversations").select(F.explode(t.words(F.col("text"))).alias("term")).distinct()
    return terms.select("term", t.stem(F.col("term")).alias("stem"))


@query()
def identifier_variants(spark, d):
    return table(spark, d, "part").select("p_name").distinct().select("p_name", t.variants(F.initcap("p_name")).alias("variants"))


@query(r"""select conv_id, turn, len(regexp_extract_all(text, '[A-Za-z_]+\.[A-Za-z_]+'))::int as n_dotted, len(regexp_extract_all(text, '[0-9]+'))::int as n_numbers,
len(regexp_extract_all(lower(text), '[a-z0-9]+'))::int as n_words, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::int as n_distinct from conversations""")
def intent_tokens(spark, d):
    n = lambda c, p: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    w = t.words(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", n(F.col("text"), r"[A-Za-z_]+\.[A-Za-z_]+").alias("n_dotted"), n(F.col("text"), "[0-9]+").alias("n_numbers"), F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"))


def _route_sql(col: str) -> str:
    path = f"regexp_replace(split_part(split_part({col}, '?', 1), '#', 1), '^.*?://[^/]*/?', '/')"
    return f"""'/' || array_to_string([case when regexp_matches(x, '^(:[a-zA-Z0-9_$]+|\\d+|[0-9a-fA-F-]{{36}})$') or (contains(x, '{{') and contains(x, '}}')) or (contains(x, '<') and contains(x, '>')) then ':param' else lower(x) end for x in str_split({path}, '/') if x <> ''], '/')"""


@query(f"select page_id, url, {_route_sql('url')} as route from pages")
def route_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", "url", t.normalize_route(F.col("url")).alias("route"))


def _servers(spark, d):
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    links = table(spark, d, "pages").select(href.alias("raw")).where("raw like '%/%'").select(t.normalize_route(F.col("raw")).alias("server"))
    # routes with a parameter, as a server would declare them, under a version
    own = table(spark, d, "pages").select(t.normalize_route(F.col("url")).alias("server")).where("server like '%:param'").select(F.concat(F.lit("/v1"), "server").alias("server"))
    return links.union(own).distinct()


_MATCH = rf"""with c as (select page_id, {_route_sql('url')} as client from pages),
s as (select distinct {_route_sql('raw')} as server from (select unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as raw from pages) where raw like '%/%' union select '/v1' || client from c where ends_with(client, ':param')),
cs as (select *, [x for x in str_split(client, '/') if x <> ''] as a from c), ss as (select *, [x for x in str_split(server, '/') if x <> ''] as b from s),
m as (select page_id, client, server, a, b, least(len(a), len(b)) as n from cs, ss),
tl as (select *, a[len(a) - n + 1:] as x, b[len(b) - n + 1:] as y from m where n > 0 and len([z for z in a if z <> ':param']) > 0),
h as (select page_id, client, server, len([z for z in b if z <> ':param'])::int as n_literals from tl
 where client = server or ((len(a) = len(b) or n >= 2) and len([i for i in range(1, n + 1) if x[i] = y[i] or x[i] = ':param' or y[i] = ':param']) = n
  and list_has_any([z for z in x if z <> ':param'], [z for z in y if z <> ':param'])))
select page_id, client, server, n_literals from (select *, max(n_literals) over (partition by page_id) as best from h) where n_literals = best"""


@query(_MATCH)
def route_match(spark, d):
    from ..operators.routes import match

    clients = table(spark, d, "pages").select("page_id", t.normalize_route(F.col("url")).alias("client"))
    return match(clients, _servers(spark, d), "page_id")


@query(f"with x as ({_MATCH}) select server, count(*) as n_clients, count(distinct client) as n_routes from x group by 1")
def http_routes(spark, d):
    return route_match(spark, d).groupBy("server").agg(F.count("*").alias("n_clients"), F.countDistinct("client").alias("n_routes"))


@query("""with t as (select distinct item_id as doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from benchmark)
select token, count(*) as n, min(doc) as first_doc from t where length(token) > 1 group by 1""")
def inverted_index(spark, d):
    p = r.postings(table(spark, d, "benchmark"), "item_id", {"text": 1.0})
    return p.where(F.length("token") > 1).groupBy("token").agg(F.count("*").alias("n"), F.min("doc").alias("first_doc"))


def _bm25_sql(docs: str, columns: dict[str, float], terms: list[str]) -> str:
    cells = " union all ".join(f"select doc, {w}::double as weight, unnest(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')) as token from d" for c, w in columns.items())
    sizes = " + ".join(f"len(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'))" for c in columns)
    words = ", ".join(f"'{x}'" for x in terms)
    return f"""d as ({docs}), sz as (select doc, {sizes} as length from d), st as (select count(*) as total, avg(length) as mean from sz),
h as (select token, doc, sum(weight) as tf from ({cells}) where token in ({words}) group by 1, 2), f as (select token, count(*) as df from h group by 1),
q as (select doc, greatest(1e-6::double, ln((total - df + 0.5::double) / (df + 0.5::double))) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / mean)) as part
 from h join f using (token) join sz using (doc), st), b as (select doc, list_reduce(list_prepend(0.0::double, list_sort(list(part))), lambda x, y: x + y) as score from q group by 1)"""


_TERMS = ["the", "thation", "heing", "tionst", "idiot", "license"]


@query("with " + _bm25_sql("select doc_id as doc, text from documents where lang = 'en'", {"text": 1.0}, _TERMS) + " select doc, round(score, 6) as score from b")
def bm25_search(spark, d):
    docs = table(spark, d, "documents").where("lang = 'en'")
    return r.bm25(docs, "doc_id", {"text": 1.0}, _TERMS).select("doc", F.round("score", 6).alias("score"))


_COLS = {"p_name": 5.0, "p_brand": 2.0, "p_type": 1.5}


@query("with " + _bm25_sql("select p_partkey as doc, p_name, p_brand, p_type from part", _COLS, ["red", "brand", "steel", "12", "large"]) + " select doc, round(score, 6) as score from b order by round(score, 9) desc, doc limit 50")
def bm25_weighted(spark, d):
    return r.bm25(table(spark, d, "part"), "p_partkey", _COLS, ["red", "brand", "steel", "12", "large"], 50).select("doc", F.round("score", 6).alias("score"))


@query("with " + _bm25_sql("select doc_id as doc, text from documents where lang = 'en'", {"text": 1.0}, _TERMS) + """,
x as (select doc, 2.0::double / (60 + row_number() over (order by round(score, 6) desc, doc)) as part from b),
y as (select doc_id as doc, 0.5::double / (60 + row_number() over (order by n_chars::double desc, doc_id)) as part from documents where lang = 'en')
select doc, round(sum(part), 9) as score from (select * from x union all select * from y) group by 1""")
def rrf_fusion(spark, d):
    docs = table(spark, d, "documents").where("lang = 'en'")
    return r.rrf([bm25_search(spark, d), docs.select(F.col("doc_id").alias("doc"), F.col("n_chars").cast("double").alias("score"))], [2.0, 0.5])


@query("with " + _bm25_sql("select doc_id as doc, text from documents where lang = 'en'", {"text": 1.0}, _TERMS) + """,
k as (select doc, round(1 / (1 + 0.1::double * (row_number() over (order by round(score, 6) desc, doc) - 1)), 4) as lexical from b)
select doc_id as doc, round(0.35::double * (quality = 1)::int + 0.20::double * toxic + 0.10::double * coalesce(lexical, 0) + 0.05::double * (n_chars > 1000)::int, 6) as score
from documents join labels using (doc_id) left join k on k.doc = doc_id where lang = 'en'""")
def score_linear(spark, d):
    from pyspark.sql import Window

    ranked = bm25_search(spark, d).withColumn("lexical", r.lexical(F.row_number().over(Window.orderBy(F.desc("score"), "doc")))).select(F.col("doc").alias("doc_id"), "lexical")
    docs = table(spark, d, "documents").where("lang = 'en'").join(table(spark, d, "labels"), "doc_id").join(ranked, "doc_id", "left")
    parts = {"exact": (F.col("quality") == 1).cast("int"), "overlap": F.col("toxic"), "lexical": F.coalesce("lexical", F.lit(0.0)), "path": (F.col("n_chars") > 1000).cast("int")}
    return docs.select(F.col("doc_id").alias("doc"), r.linear(parts).alias("score"))


@query("""with s as (select id, kind, lower(id) as lid, lower(sig) as sig, lower(split_part(split_part(id, '::', -1), '.', -1)) as name from nodes),
p as (select id, kind, sum(case when ends_with(lid, '::' || t) or ends_with(lid, '.' || t) then 10 when name = t then 8 when list_contains(regexp_split_to_array(lid, '[^a-z0-9]+'), t) then 4
 when length(t) > 3 and contains(lid, t) then 2 else 0 end + case when contains(sig, t) then 3 else 0 end) as raw from s, (select unnest(['red', 'catalog', 'china', '42']) as t) group by 1, 2)
select id, kind, round(raw * case when kind in ('function', 'method', 'class') then 1.3::double when kind in ('file', 'module') then 0.6::double else 1.0::double end, 4) as score from p where raw > 0 order by score desc, id limit 100""", views=True)
def identifier_search(spark, d):
    return r.identifier_search(nodes(spark, d), ["red", "catalog", "china", "42"])


@query("""with g as (select page_id as id, list_distinct([lower(url)[i:i + 2] for i in range(1, length(url) - 1)]) as g from pages), b as (select p_name as id, list_distinct([lower(p_name)[i:i + 2] for i in range(1, length(p_name) - 1)]) as g from (select distinct p_name from part))
select * from (select b.id as a_id, g.id as b_id, round(len(list_intersect(b.g, g.g))::double / (len(b.g) + len(g.g) - len(list_intersect(b.g, g.g))), 6) as jaccard from b, g) where jaccard > 0.05""")
def trigram_jaccard(spark, d):
    """The distinct names of all parts against all pages."""
    parts = table(spark, d, "part").select(F.col("p_name").alias("a_id"), F.col("p_name").alias("text")).distinct()
    return r.trigram_jaccard(parts, table(spark, d, "pages").select(F.col("page_id").alias("b_id"), F.col("url").alias("text")))
