"""Registered queries: context for tasks, evaluation, enrichment and text rules, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context as c
from ..operators import enrich as en
from ..operators import evaluate as ev
from ..operators import graph as g
from ..operators import intent as it
from ..operators import task as t
from ..plans import lenses
from ..sources.graph_views import edges, nodes, table
from ..sources.tables import written
from .registry import query

# A nation is a task; its customers are one hop away, their orders two.
_NEAR = """near as (select n_name as task, 'py:crm/' || c_nationkey || '::' || c_name as id, 'class' as kind, 'crm/' || c_nationkey || '/' || c_mktsegment || '.py' as file, 1 as distance, 0.9::double as graph_score, 'direct' as category
  from customer join nation on c_nationkey = n_nationkey
 union all select n_name, 'py:sales/' || o_custkey || '::' || o_orderkey, case o_orderstatus when 'F' then 'method' else 'yaml_config' end, 'sales/' || year(o_orderdate) || '.py', 2, 0.4::double, 'indirect'
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
entries as (select n_name as task, 'py:crm/' || c_nationkey || '::' || c_name as id, 'crm/' || c_nationkey || '/' || c_mktsegment || '.py' as file, row_number() over (partition by n_name order by c_custkey) - 1 as place
  from customer join nation on c_nationkey = n_nationkey qualify place < 3)"""


def _customers(spark, d):
    cust = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    node_id = F.concat(F.lit("py:crm/"), "c_nationkey", F.lit("::"), "c_name")
    return cust.select(F.col("n_name").alias("task"), "c_custkey", node_id.alias("id"), F.concat(F.lit("crm/"), "c_nationkey", F.lit("/"), "c_mktsegment", F.lit(".py")).alias("file"))


def _near(spark, d):
    cust = _customers(spark, d)
    one = cust.select("task", "id", F.lit("class").alias("kind"), "file", F.lit(1).alias("distance"), F.lit(0.9).alias("graph_score"), F.lit("direct").alias("category"))
    o = table(spark, d, "orders").join(cust.select("task", "c_custkey"), F.expr("o_custkey = c_custkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "method").otherwise("yaml_config")
    two = o.select("task", F.concat(F.lit("py:sales/"), "o_custkey", F.lit("::"), "o_orderkey").alias("id"), kind.alias("kind"), F.concat(F.lit("sales/"), F.year("o_orderdate"), F.lit(".py")).alias("file"), F.lit(2).alias("distance"), F.lit(0.4).alias("graph_score"), F.lit("indirect").alias("category"))
    return one.unionByName(two)


def _entries(spark, d):
    place = F.row_number().over(Window.partitionBy("task").orderBy("c_custkey")) - 1
    return _customers(spark, d).withColumn("place", place).where("place < 3").select("task", "id", "file", "place")


_RELEVANT = f"""{_NEAR}, rel as (select n.*, (task, id) in (select (task, id) from entries) as entry,
  round(graph_score + case when (task, id) in (select (task, id) from entries) then 0.8 else 0 end + case when (task, file) in (select (task, file) from entries) then 0.5 else 0 end
  + least(1.0, 0.25 * ((contains(lower(id), '0001') or contains(lower(file), '0001'))::int + (contains(lower(id), 'build') or contains(lower(file), 'build'))::int))
  + case when kind in ('class', 'method') then 0.35 when kind = 'yaml_config' then -0.4 else 0 end - 0.25 * (distance - 1), 6) as relevance from near n)"""


@query(f"""with {_RELEVANT}, kept as (select *, row_number() over (partition by task, category order by relevance desc, id) as place from rel
 where case when category = 'direct' then entry or distance = 1 or relevance >= 0.25 else relevance >= 0.35 end)
select task, id, category, relevance::double as relevance, place::int as place from kept where place <= case when category = 'direct' then 12 else 8 end""")
def neighbor_relevance(spark, d):
    near, entries = _near(spark, d), _entries(spark, d)
    terms = table(spark, d, "nation").select(F.col("n_name").alias("task"), F.array(F.lit("0001"), F.lit("BUILD"), F.lit("a")).alias("terms"))
    return c.keep_neighbors(c.relevance(near, entries, terms)).select("task", "id", "category", "relevance", "place")


@query(f"""with {_NEAR}, b as (select task, file, 10.0 - place as n from entries union all select task, file, 1.0 from near),
s as (select task, file, sum(n) as base, regexp_extract(lower(file), '([^/]*)\\.[^./]*$', 1) as stem from b group by task, file),
f as (select task, file, round(base + case when stem in ('building', 'household') then 5 else 0 end, 6) as file_score from s),
r as (select *, row_number() over (partition by task order by file_score desc, file) as place, max(file_score) over (partition by task) as top from f)
select task, file, place::int as place from r where place = 1 or (place <= 4 and file_score >= 0.5 * top)""")
def file_band(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("task"), F.array(F.lit("Building"), F.lit("HouseHold")).alias("names"))
    return c.keep_files(c.file_scores(_entries(spark, d), _near(spark, d), names))


@query("""select id, 'parameter' as tier, '`' || id || '` takes (' || kind || ', ' || file || ')' as text from nodes
union all select id, 'return', '`' || id || '` returns ' || sig from nodes where kind = 'function' and sig <> ''
union all select id, 'exception', '`' || id || '` may raise E' || complexity from nodes where complexity > 15
union all select id, 'schema', 'table `' || id || '` is used' from nodes where kind = 'sql_table'
union all select id, 'behavior', '`' || id || '`: ' || lang from nodes""", views=True)
def constraint_tiers(spark, d):
    n = nodes(spark, d)
    facts = {"params": F.array("kind", "file"), "returns": F.when(F.col("kind") == "function", F.col("sig")), "raises": F.when(F.col("complexity") > 15, F.array(F.concat(F.lit("E"), "complexity"))), "story": F.col("lang")}
    return c.constraints(n.withColumns(facts))


_PLAN = f"""{_NEAR}, t as (select n_name as task, n_nationkey % 2 = 0 as creates, n_nationkey % 3 = 0 as registers from nation),
e as (select task, id, file, place + 1 as place from entries), f as (select distinct task, file from near where category = 'direct' union select n_name, 'tests/test_' || n_regionkey || '.py' from nation where n_regionkey = 1),
dd as (select task, id, file, 0.5::double as confidence, row_number() over (partition by task order by id) as place from near where category = 'direct'),
ch as (select e.*, creates from e join t using (task)), seen as (select task, id from ch where case when creates then place = 1 else place <= 2 end),
st as (select task, 0 as o, 1 as p, 'pre_check' as phase, null as target, null as file, coalesce('run the tests ' || (select string_agg(file, ' ' order by file) from f where f.task = t.task and contains(file, 'test')), 'start from a clean tree') as action from t
 union all select task, 1, place, 'scaffold', id, file, 'create it after the pattern of ' || id from ch where creates and place = 1
 union all select task, 2, 1, 'registration', 'module exports', null, 'register and export what is new' from t where creates and registers
 union all select task, 1, place, 'modification', id, file, 'modify ' || id from ch where not creates and place <= 2
 union all select task, 3, place, 'review', id, file, 'review it, a dependent with confidence 0.50' from dd where place <= 3 and (task, id) not in (select (task, id) from seen)
 union all select task, 4, 1, 'post_check', null, null, 'run the tests of ' || (select count(*) from f where f.task = t.task) || ' files' from t
 union all select task, 5, 1, 'post_check', null, null, 'bring the graph up to date' from t)"""


@query(f"with {_PLAN} select task, row_number() over (partition by task order by o, p, coalesce(target, ''))::int as step, phase, target, file, action from st")
def change_plan(spark, d):
    near = _near(spark, d).where("category = 'direct'")
    nation = table(spark, d, "nation")
    tasks = nation.select(F.col("n_name").alias("task"), (F.col("n_nationkey") % 2 == 0).alias("creates"), (F.col("n_nationkey") % 3 == 0).alias("registers"))
    tests = nation.where("n_regionkey = 1").select(F.col("n_name").alias("task"), F.concat(F.lit("tests/test_"), "n_regionkey", F.lit(".py")).alias("file"))
    direct = near.select("task", "id", "file", F.lit(0.5).alias("confidence"), F.row_number().over(Window.partitionBy("task").orderBy("id")).alias("place"))
    return c.change_plan(tasks, _entries(spark, d).withColumn("place", F.col("place") + 1), direct, near.select("task", "file").distinct().unionByName(tests))


@query("""with t as (select c_custkey as task, c_custkey % 3 = 0 as creates, count(distinct l_suppkey) % 2 as tables, count(distinct l_partkey) as affected, count(distinct o_orderkey) as files from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by 1, 2)
select task, case when creates then case when files <= 2 then 'LOW' else 'MEDIUM' end when tables > 0 or affected > 5 then 'HIGH' when affected > 1 or files > 1 then 'MEDIUM' else 'LOW' end as risk from t""")
def change_risk(spark, d):
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey"))
    n = lines.groupBy(F.col("o_custkey").alias("task")).agg((F.countDistinct("l_suppkey") % 2).alias("tables"), F.countDistinct("l_partkey").alias("affected"), F.countDistinct("o_orderkey").alias("files"))
    return c.risk_levels(n.join(table(spark, d, "customer").select(F.col("c_custkey").alias("task")), "task").withColumn("creates", F.col("task") % 3 == 0))


_EST = "greatest(floor(case when trim({0}, ' ') = '' then 0 else len(regexp_split_to_array(trim({0}, ' '), '\\s+')) end * 1.3), floor(length({0}) / 4))::bigint"


@query(f"""with l as (select doc_id as task, string_agg('- `' || lang || '` -> `x' || k || '` [CALLS]', chr(10) order by k) as e0, string_agg(case when k <= 3 then '- `' || lang || '` -> `x' || k || '` [CALLS]' end, chr(10) order by k) as e3 from documents, range(1, 6) r(k) group by 1),
f as (select doc_id as task, '### `d' || doc_id || '` (file) [' || source || ']' as head, chr(10) || '- **Signature:** ' || lang as sig, chr(10) || '- **Story:** A text in ' || lang || '. It has words.' as story, chr(10) || '- **Story:** A text in ' || lang || '.' as short,
 chr(10) || '- **Facts:** chars=' || n_chars as facts, chr(10) || '```' || chr(10) || rtrim(text, ' ') || chr(10) || '```' as code from documents),
p as (select task, '# Context pack' || chr(10) || chr(10) as h, head || sig || story || coalesce(code, '') || facts as c0, head || sig || story || facts as c1, head || sig || short as c2, chr(10) || chr(10) || '## Links' || chr(10) || e0 as l0, chr(10) || chr(10) || '## Links' || chr(10) || e3 as l3 from f join l using (task)),
s as (select task, h || c0 || l0 as s0, h || c1 || l0 as s1, h || c2 || l0 as s2, h || c2 || l3 as s3 from p), n as (select *, {_EST.format('s0')} as n0, {_EST.format('s1')} as n1, {_EST.format('s2')} as n2, {_EST.format('s3')} as n3 from s)
select task, case when n0 <= 80 then 0 when n1 <= 80 then 1 when n2 <= 80 then 2 when n3 <= 80 then 3 else 4 end::int as stage, case when n0 <= 80 then n0 when n1 <= 80 then n1 when n2 <= 80 then n2 else n3 end as tokens from n""")
def pack_stages(spark, d):
    """Each document's card with its text as snippet; texts without words inside trimmed ends agree in both engines."""
    docs = table(spark, d, "documents")
    cards = docs.select(
        F.col("doc_id").alias("task"), F.lit(1).alias("place"), F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("file").alias("kind"), F.col("source").alias("at"), F.col("lang").alias("sig"),
        F.concat(F.lit("A text in "), "lang", F.lit(". It has words.")).alias("story"), F.concat(F.lit("chars="), "n_chars").alias("facts"), F.col("text").alias("snippet"),
    )
    links = docs.select(F.col("doc_id").alias("task"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("place"), F.col("lang").alias("src")).select("task", "place", "src", F.concat(F.lit("x"), "place").alias("dst"), F.lit("CALLS").alias("type"))
    return c.render(cards, links, 80).select("task", "stage", "tokens")


@query()
def explain_task(spark, d):
    return t.explain(nodes(spark, d), "Fix Customer#000000007 and the cold widget in Brand#13")


@query()
def suggested_questions(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return spark.createDataFrame([(q,) for q in g.questions(g.god_nodes(n, e, 3), None, g.surprising(n, e, top=3), 1)], "question string")


@query()
def context_package(spark, d):
    """The whole compilation of a task: cards in order, with the plan's risk and the text's stage."""
    n, e = written(nodes(spark, d), "nodes")[0], written(edges(spark, d), "edges")[0]
    p = c.compile_context(n, e, "Change Customer#000000007 without touching supply/", 400)
    return p.entries.select("id", F.lit("entry").alias("role")).unionByName(p.near.select("id", F.col("category").alias("role"))).withColumns({"risk": F.lit(p.risk), "stage": F.lit(p.stage), "tokens": F.lit(p.tokens)})


_LAST = "regexp_extract(lower({}), '([^:.]*)$', 1)"


@query("""with g as (select c_custkey as task, p_name as symbol from customer join part on p_partkey = c_custkey % 100), p as (select o_custkey as task, 'py:catalog/' || p_brand || '::' || p_partkey || '.' || p_name as id, o_totalprice + l_linenumber as w from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey),
r as (select task, id, row_number() over (partition by task order by max(w) desc, id) as rank from p group by task, id),
h as (select g.task, min(rank) as first from g left join r on r.task = g.task and (lower(id) = lower(symbol) or ends_with(lower(id), '::' || lower(symbol)) or ends_with(lower(id), '.' || lower(symbol))) group by 1)
select count(*) as tasks, round(avg(coalesce((first <= 50)::int::double, 0)), 4) as candidates_50, round(avg(coalesce((first <= 100)::int::double, 0)), 4) as candidates_100, round(avg(coalesce((first <= 1)::int::double, 0)), 4) as recall_1, round(avg(coalesce((first <= 3)::int::double, 0)), 4) as recall_3,
round(avg(coalesce((first <= 5)::int::double, 0)), 4) as recall_5, round(avg(coalesce((first <= 10)::int::double, 0)), 4) as recall_10, round(coalesce(avg(case when first <= 10 then 1.0::double / first else 0 end), 0), 4) as mrr from h""")
def retrieval_eval(spark, d):
    return ev.retrieval_metrics(*_retrieved(spark, d))


def _retrieved(spark, d):
    part = table(spark, d, "part")
    gold = table(spark, d, "customer").withColumn("k", F.col("c_custkey") % 100).join(part, F.expr("p_partkey = k")).select(F.col("c_custkey").alias("task"), F.col("p_name").alias("symbol"))
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey")).join(part, F.expr("l_partkey = p_partkey"))
    node_id = F.concat(F.lit("py:catalog/"), "p_brand", F.lit("::"), "p_partkey", F.lit("."), "p_name")
    best = lines.groupBy(F.col("o_custkey").alias("task"), node_id.alias("id")).agg(F.max(F.col("o_totalprice") + F.col("l_linenumber")).alias("w"))
    return best.select("task", "id", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("w"), "id")).alias("rank")), gold


@query("""with g as (select c_custkey as task, p_name as symbol from customer join part on p_partkey = c_custkey % 100), p as (select o_custkey as task, 'py:catalog/' || p_brand || '::' || p_partkey || '.' || p_name as id, o_totalprice + l_linenumber as w from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey),
r as (select task, id, row_number() over (partition by task order by max(w) desc, id) as rank from p group by task, id),
h as (select g.task, g.symbol, min(rank) as first from g left join r on r.task = g.task and (lower(id) = lower(symbol) or ends_with(lower(id), '::' || lower(symbol)) or ends_with(lower(id), '.' || lower(symbol))) group by 1, 2)
select task, case when first <= 100 then 'RANKING_ERROR' when contains(lower(symbol), lower(c_mktsegment)) or contains(lower(symbol), 'cold') then 'IDENTIFIER_MISS' else 'LEXICAL_MISS' end as category, case when first <= 100 then first end as first
from h join customer on c_custkey = task where first is null or first > 5""")
def failure_triage(spark, d):
    ranked, gold = _retrieved(spark, d)
    terms = table(spark, d, "customer").select(F.col("c_custkey").alias("task"), F.explode(F.array(F.col("c_mktsegment"), F.lit("COLD"))).alias("term"))
    return ev.triage(ranked, gold, terms)


_SIZES = "n as (select c_custkey as task, c_custkey % 700 as tokens, 500 + c_custkey % 900 as raw_tokens from customer)"


@query(f"""with {_SIZES}, i as (select o_custkey as task, 'symbol' as what, 'py:s/' || o_orderkey || '.py::' || o_orderkey % 10 as item from orders union select o_custkey, 'file', 'src/' || o_orderkey % 7 || '.py' from orders),
g as (select c_custkey as task, 'symbol' as what, (c_custkey % 10)::varchar as item from customer union all select c_custkey, 'related', (c_custkey % 5)::varchar from customer where c_custkey % 4 > 0 union all select c_custkey, 'file', '/' || c_custkey % 7 || '.py' from customer union all select c_custkey, 'test', 'src/' || c_custkey % 9 || '.py' from customer union all select c_custkey, 'excluded', (c_custkey % 3)::varchar from customer),
b as (select g.task, g.what, g.item, i.what as as_, i.item as in_, coalesce((i.what = 'symbol' and g.what in ('symbol', 'related', 'excluded') and (lower(i.item) = lower(g.item) or ends_with(lower(i.item), '::' || g.item) or ends_with(lower(i.item), '.' || g.item)))
 or (i.what = 'file' and g.what in ('file', 'test', 'excluded') and (ends_with(i.item, regexp_replace(g.item, '^[./]+', '')) or ends_with(regexp_replace(g.item, '^[./]+', ''), i.item))), false) as hit from g left join i on i.task = g.task),
pg as (select task, what, item, max(hit::int) as hit from b group by 1, 2, 3), pi as (select task, in_, max((hit and what in ('symbol', 'related'))::int) as rel from b where as_ = 'symbol' group by 1, 2), pt as (select task, avg(rel) as p from pi group by 1)
select (select count(*) from n) as tasks, (select round(avg(tokens), 1) from n) as mean_tokens, (select round(greatest(1 - sum(tokens) / sum(raw_tokens)::double, 0) * 100, 2) from n) as reduction_pct,
round(coalesce(avg(case when what = 'symbol' then hit end), 1), 4) as symbol_recall, round(coalesce(avg(case when what = 'file' then hit end), 1), 4) as file_recall, round(coalesce(avg(case when what = 'test' then hit end), 1), 4) as test_recall, round(coalesce(avg(case when what = 'excluded' then hit end), 0), 4) as false_inclusion,
(select round(avg(coalesce(p, 0)), 4) from n left join pt using (task)) as precision from pg""")
def context_eval(spark, d):
    o, cust = table(spark, d, "orders"), table(spark, d, "customer")
    key = F.col("c_custkey")
    as_ = lambda df, task, what, item: df.select(task.alias("task"), F.lit(what).alias("what"), item.cast("string").alias("item"))
    included = as_(o, F.col("o_custkey"), "symbol", F.concat(F.lit("py:s/"), "o_orderkey", F.lit(".py::"), F.col("o_orderkey") % 10)).union(as_(o, F.col("o_custkey"), "file", F.concat(F.lit("src/"), F.col("o_orderkey") % 7, F.lit(".py")))).distinct()
    parts = [("symbol", key % 10, cust), ("related", key % 5, cust.where("c_custkey % 4 > 0")), ("file", F.concat(F.lit("/"), key % 7, F.lit(".py")), cust), ("test", F.concat(F.lit("src/"), key % 9, F.lit(".py")), cust), ("excluded", key % 3, cust)]
    gold = None
    for what, item, df in parts:
        one = as_(df, key, what, item)
        gold = one if gold is None else gold.unionByName(one)
    return ev.context_metrics(included, gold, cust.select(key.alias("task"), (key % 700).alias("tokens"), (key % 900 + 500).alias("raw_tokens")))


@query("""with n as (select *, k % 3 as calls from (select id, kind, complexity, content_hash, row_number() over () * 0 + start_line as k from nodes)), cached as (select sha256(content_hash || ':fast:1') as key from nodes where start_line % 5 = 0),
x as (select n.*, kind in ('json_config', 'yaml_config', 'file', 'external_symbol', 'variable', 'command', 'sql_table') or (kind in ('function', 'method') and complexity = 1 and calls = 0) as trivial, sha256(content_hash || ':fast:1') in (select key from cached) as hit from n),
a as (select id, row_number() over (order by complexity desc, calls desc, id) as place from x where not trivial and not hit)
select id, case when trivial then 'trivial' when hit then 'cache' when place <= 200 and place * 150 <= 20000 then 'model' else 'template' end as tier from x left join a using (id)""", views=True)
def story_tiers(spark, d):
    n = nodes(spark, d).withColumns({"calls": F.col("start_line") % 3, "reads": F.array().cast("array<string>"), "writes": F.array().cast("array<string>")})
    cache = n.where("start_line % 5 = 0").select(F.sha2(F.concat_ws(":", "content_hash", F.lit("fast"), F.lit("1")), 256).alias("key"))
    return en.tiers(n, cache, room=20_000)


@query("""with t as (select case when kind in ('json_config', 'yaml_config', 'file', 'sql_table') then 'template' else kind end as value from nodes) select value, count(*) as n from t group by 1""", views=True)
def enrichment_tally(spark, d):
    source = F.when(F.col("kind").isin("json_config", "yaml_config", "file", "sql_table"), "template").otherwise(F.col("kind"))
    return g.kind_counts(nodes(spark, d).withColumn("story_source", source), "story_source")


@query("select kind as value, count(*) as n from nodes group by 1", views=True)
def kind_counts(spark, d):
    return g.kind_counts(nodes(spark, d))


@query("select id, not (lower(kind) in ('variable', 'token', 'key') or regexp_matches(id, '[\\[\\]]') or (kind in ('json_config', 'yaml_config') and contains(split_part(id, '::', 2), '.'))) as exported from nodes", views=True)
def exportable_nodes(spark, d):
    return nodes(spark, d).select("id", g.exportable(F.col("id"), F.col("kind")).alias("exported"))


@query("""with r as (select 'a' as root union all select 'b'), n as (select regexp_replace(id, '^([^:]*):', '\\1:' || root || '/') as id, root from nodes, r),
e as (select regexp_replace(src, '^([^:]*):', '\\1:' || root || '/') as src from edges, r)
select root, count(*) as n_nodes, count(distinct id) as n_ids, (select count(*) from e where src like '%:' || n.root || '/%') as n_edges from n group by root""", views=True)
def federated_union(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    (na, ea), (nb, eb) = lenses.rooted(n, e, "a"), lenses.rooted(n, e, "b")
    by = na.unionByName(nb).groupBy("root").agg(F.count("*").alias("n_nodes"), F.countDistinct("id").alias("n_ids"))
    m = ea.unionByName(eb).groupBy(F.regexp_extract("src", "^[^:]*:([^/]*)/", 1).alias("root")).agg(F.count("*").alias("n_edges"))
    return by.join(m, "root")


@query("""with k as (select user_id as run, event_id as call, case event_type when 'click' then 'small' when 'purchase' then 'large' else 'other' end as model, floor(abs(value) * 10)::bigint as prompt, (event_id % 50)::bigint as cached, (event_id % 300)::bigint as completion from events),
p as (select *, prompt + completion as used, (prompt - cached / 2) / 1e6 * case model when 'small' then 0.05::double when 'large' then 0.6::double else 0.2::double end + completion / 1e6 * case model when 'small' then 0.08::double when 'large' then 1.0::double else 0.2::double end as price from k),
s as (select run, call, coalesce(sum(used) over w, 0)::bigint as spent_tokens, coalesce(sum(round(price * 1e9)::bigint) over w, 0)::bigint / 1e9::double as spent_cost from p window w as (partition by run order by call rows between unbounded preceding and 1 preceding))
select *, spent_tokens + 150 <= 100000 and spent_cost < 0.01 as allowed from s""")
def governor(spark, d):
    e = table(spark, d, "events")
    model = F.when(F.col("event_type") == "click", "small").when(F.col("event_type") == "purchase", "large").otherwise("other")
    prompt = F.floor(F.abs("value") * 10)
    calls = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("call"), model.alias("model"), prompt.alias("prompt"), (F.col("event_id") % 50).alias("cached"), (F.col("event_id") % 300).alias("completion"))
    rates = spark.createDataFrame([("small", 0.05, 0.08), ("large", 0.6, 1.0), ("default", 0.2, 0.2)], "model string, price_in double, price_out double")
    return en.governor(calls, rates, max_cost=0.01)


_RAW = "case o_orderkey % 6 when 0 then '${base}/path' when 1 then 'url' when 2 then '/api/:id/' || o_orderkey when 3 then '/api/orders/' || o_orderkey when 4 then 'https://h.example/' || o_orderkey else '' end"


@query(f"with u as (select o_orderkey, {_RAW} as url from orders) select o_orderkey, url, o_orderkey % 6 in (0, 1, 4, 5) as template_only from u")
def url_template_only(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 6 == 0, "${base}/path").when(k % 6 == 1, "url").when(k % 6 == 2, F.concat(F.lit("/api/:id/"), k)).when(k % 6 == 3, F.concat(F.lit("/api/orders/"), k)).when(k % 6 == 4, F.concat(F.lit("https://h.example/"), k)).otherwise("")
    return table(spark, d, "orders").select("o_orderkey", raw.alias("url")).select("o_orderkey", "url", tx.template_only(F.col("url")).alias("template_only"))


@query("""with m as (select event_id, case event_id % 4 when 0 then props when 1 then 'Here:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' when 2 then 'so ' || props || ' it is' else 'no braces' end as said, props from events)
select event_id, case when event_id % 4 < 3 then props end as object from m""")
def json_salvage(spark, d):
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("so "), "props", F.lit(" it is"))).otherwise("no braces")
    return table(spark, d, "events").select("event_id", tx.json_object(said).alias("object"))


@query("""select id, kind, lower(id) = lower(sig) or ends_with(lower(id), '::' || lower(sig)) or ends_with(lower(id), '.' || lower(sig)) as symbol, ends_with(lower(file), '1.py') or ends_with('1.py', lower(file)) as file_ from nodes""", views=True)
def gold_matchers(spark, d):
    return nodes(spark, d).select("id", "kind", tx.symbols_match(F.col("id"), F.col("sig")).alias("symbol"), tx.files_match(F.col("file"), F.lit(".\\1.PY")).alias("file_"))


@query()
def task_intents(spark, d):
    """The intents of a few tasks as rows: driver-side text rules."""
    texts = ["Fix `Cart.add` so that retries stop; do not modify ship/box.py", "create a new docker deploy", "Rename user_id in /api/users/{id} without touching LegacyStore"]
    rows = [(i, w.identifiers, w.concepts, w.exclusions, w.api_paths, w.creates, w.infrastructure, it.search_terms(w)) for i, w in enumerate(map(it.intent, texts))]
    return spark.createDataFrame(rows, "task int, identifiers array<string>, concepts array<string>, exclusions array<string>, api_paths array<string>, creates boolean, infrastructure boolean, terms array<string>")
