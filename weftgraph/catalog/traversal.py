"""Registered queries: priors, traversals, cycles, components and communities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import confidence as c
from ..plans import communities as cm
from ..plans import traverse as tr
from ..plans.components import components
from ..sources.graph_views import edges, nodes, table
from ..sources.tables import written
from .registry import query

_TYPE = "case type when 'CALLS' then 0.95::double when 'INHERITS' then 0.95::double when 'DEFINED_IN' then 0.95::double when 'WRITES' then 0.85::double when 'IMPORTS' then 0.80::double else 0.80::double end"
_LEVEL = "case confidence when 'resolved' then 0.95::double when 'ambiguous' then 0.50::double when 'dynamic' then 0.50::double when 'external' then 0.40::double when 'unresolved' then 0.30::double else 0.80::double end"
_PRIOR = f"case when confidence = 'resolved' then {_TYPE} else round(least({_LEVEL}, {_TYPE}), 4) end"
_FOLD = "list_reduce(list_prepend(1.0::double, list_sort(list(p))), lambda a, x: a * (1 - x))"


@query(f"select type, confidence, {_PRIOR} as prior, count(*) as n from edges group by 1, 2, 3", views=True)
def edge_prior(spark, d):
    return edges(spark, d).groupBy("type", "confidence", c.edge_prior(F.col("type"), F.col("confidence")).alias("prior")).agg(F.count("*").alias("n"))


_NOISY = "list_reduce(list_prepend(1.0::double, list_sort(list(p))), lambda a, x: a * greatest(0.0::double, 1.0::double - x))"


@query(f"select dst as id, count(*) as n, round(least(0.99::double, 1.0::double - {_NOISY}), 6) as confidence from (select dst, {_PRIOR} as p from edges) group by dst", views=True)
def noisy_or(spark, d):
    e = edges(spark, d).groupBy(F.col("dst").alias("id"), c.edge_prior(F.col("type"), F.col("confidence")).alias("p")).agg(F.count("*").alias("n"))
    return e.groupBy("id").agg(F.sum("n").alias("n"), c.noisy_or_of_counts(F.collect_list(F.struct("p", "n"))).alias("confidence"))  # a few priors a node


def _order(spark, d):
    return nodes(spark, d).where("kind = 'method'").agg(F.min("id")).first()[0]


_ADJ = f"""adj as (select dst as node, src as peer, type, confidence, {_PRIOR} as prior from edges union all select src, dst, type, confidence, {_PRIOR} from edges)"""
_ACROSS = "(type = 'WRITES' or split_part(node, ':', 1) = split_part(peer, ':', 1))"


@query(f"""with {_ADJ}, t as (select min(id) as id from nodes where kind = 'method'),
l1 as (select peer as node, [node, peer] as seen, prior as product, 1 as hops, confidence not in ('external', 'unresolved') as on_ from adj where node = (select id from t) and peer <> node and {_ACROSS}),
l2 as (select peer as node, list_append(seen, peer) as seen, product * prior as product, 2 as hops, adj.confidence not in ('external', 'unresolved') as on_ from l1 join adj using (node) where on_ and not list_contains(seen, peer) and {_ACROSS}),
r as (select node as id, hops, round(least(0.99::double, product * exp(-0.25::double * (hops - 1))), 6) as p from (select node, hops, product from l1 union all select node, hops, product from l2)),
g as (select id, min(hops)::int as distance, count(*) as n_paths, round(least(0.99::double, 1.0::double - {_NOISY}), 6) as confidence from r group by id)
select id, kind, file, distance, n_paths, confidence, round(confidence * exp(-0.70::double * (distance - 1)), 6) as score,
case when confidence < 0.2 then 'excluded' when distance = 1 and confidence >= 0.5 then 'direct' else 'indirect' end as category from g left join nodes using (id)""", views=True)
def blast_radius_open(spark, d):
    """Two hops without guards."""
    n, e = _stored(spark, d)
    return tr.blast_radius(n, e, _order(spark, d), 2, degree_limit=None, fanout=None, paths=None)


def _stored(spark, d):
    """The views as tables, since every level of a traversal reads them."""
    return written(nodes(spark, d), "nodes")[0], written(edges(spark, d), "edges")[0]


@query()
def blast_radius(spark, d):
    n, e = _stored(spark, d)
    return tr.blast_radius(n, e, _order(spark, d))


@query()
def blast_summary(spark, d):
    n, e = _stored(spark, d)
    return tr.blast_summary(tr.blast_radius(n, e, _order(spark, d), rules=["supply/"], degree_limit=None, max_depth=3))


_SEED = "(select min(id) from nodes where kind = 'sql_table')"


@query(f"""with recursive {{VIEWS}}, w as (select id, 0 as depth from nodes where id = {_SEED} union select src, depth + 1 from w join (select distinct src, dst from edges) on dst = id where depth < 2)
select id, kind, file, min(depth)::int as depth from w left join nodes using (id) where depth > 0 group by 1, 2, 3""")
def impact_bfs(spark, d):
    n = nodes(spark, d)
    return tr.impact(n, edges(spark, d), n.where("kind = 'sql_table'").agg(F.min("id")).first()[0], 2)


@query(f"""with recursive {{VIEWS}}, e as (select distinct src, dst, type from edges), w as (select src, dst, type, 1 as depth from e where dst = {_SEED} union select e.src, e.dst, e.type, depth + 1 from w join e on e.dst = w.src where depth < 2)
select src, dst, type, depth::int as depth from w""")
def impact_cte(spark, d):
    n = nodes(spark, d)
    return tr.impact_edges(edges(spark, d), n.where("kind = 'sql_table'").groupBy().agg(F.min("id").alias("id")), 2)


@query("""with e as (select distinct src, dst, type from edges), s as (select id from nodes where kind = 'method' and complexity = 3), g as (select * from e where type in ('WRITES', 'INHERITS')),
d0 as (select id, 0 as depth from s), d1 as (select distinct dst as id, 1 as depth from e join d0 on src = id where dst not in (select id from d0)),
k1 as (select * from d0 union all select * from d1), d2 as (select distinct dst as id, 2 as depth from e join d1 on src = id where dst not in (select id from k1)),
k as (select * from k1 union all select * from d2), f as (select e.*, depth + 1 as depth from e join k on src = id),
b as (select m.max_hops::int as max_hops, count(*) as found, count(*) filter ((f.src, f.dst, f.type) in (select (src, dst, type) from g)) as hits from f, (select unnest([1, 2, 3]) as max_hops) m where f.depth <= m.max_hops group by 1),
q as (select *, hits / found::double as p, hits / (select count(*) from g)::double as r from b)
select max_hops, found, hits, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) as f1 from q""", views=True)
def reach_by_depth(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return tr.reach_by_depth(e, n.where("kind = 'method' and complexity = 3").select("id"), e.where("type in ('WRITES', 'INHERITS')"), 3)


def trade(spark, d):
    """(src, dst): a customer's and a supplier's nation where the line items between them are 5 % above the first's mean."""
    t = lambda name: table(spark, d, name)
    n = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("supplier"), F.expr("l_suppkey = s_suppkey"))
    n = n.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("src")  # a row for each nation
    return n.withColumns({"all": F.sum("n").over(own), "to": F.count("*").over(own)}).where("n * to * 100 > all * 105 and src <> dst").select("src", "dst")


_TRADE = """t as (select src, dst from (select c_nationkey::bigint as src, s_nationkey::bigint as dst, count(*) as n, sum(count(*)) over (partition by c_nationkey) as all_, count(*) over (partition by c_nationkey) as to_
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2, c_nationkey) where n * to_ * 100 > all_ * 105 and src <> dst)"""


def _cycles_of(n: int) -> str:
    """Elementary cycles of n nodes from their least one."""
    x = [f"x{i}" for i in range(n)]
    joins = " ".join(f"join t {b} on {a}.dst = {b}.src" for a, b in zip(x, x[1:], strict=False))
    apart = [f"x0.src < {b}.src" for b in x[1:]] + [f"{a}.src <> {b}.src" for i, a in enumerate(x[1:], 1) for b in x[i + 1 :]]
    return f"select {n} as length, [{', '.join(f'{a}.src' for a in x)}, x0.src] as cycle from t x0 {joins} where {x[-1]}.dst = x0.src and {' and '.join(apart)}"


@query(f"with {_TRADE} {' union all '.join(_cycles_of(n) for n in range(2, 5))}")
def import_cycles(spark, d):
    return tr.cycles(trade(spark, d), 4)


@query()
def connected_components(spark, d):
    """Customers and suppliers that orders link, over all line items."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey"))
    return components(o.select(F.col("o_custkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b")))


_ROUND = "v{i} as (select src as id, community from u join l{j} on dst = id union all select id, community from l{j}), l{i} as (select id, community from (select id, community, row_number() over (partition by id order by count(*) desc, community) as k from v{i} group by id, community) where k = 1)"


@query(f"with {_TRADE}, u as (select src, dst from t union select dst, src from t), l0 as (select distinct src as id, src as community from u), {', '.join(_ROUND.format(i=i, j=i - 1) for i in range(1, 6))} select * from l5")
def label_propagation(spark, d):
    return tr.label_propagation(trade(spark, d))


@query(f"""with {_TRADE}, m as (select n_nationkey::bigint as id, n_regionkey as community from nation), p as (select distinct least(src, dst) as a, greatest(src, dst) as b from t), e as (select x.community as ca, y.community as cb from p join m x on x.id = a join m y on y.id = b),
s as (select ca as community, (ca = cb)::int as inside from e union all select cb, 0 from e), c as (select community, sum(inside) as inside, count(*) as degree from s group by 1), n as (select count(*) as n_links from e)
select n_links, round(sum(inside / n_links::double - power(degree / (2.0::double * n_links), 2)), 6) as modularity from c, n group by n_links""")
def modularity(spark, d):
    return cm.modularity(_members(spark, d), trade(spark, d))


@query()
def modularity_communities(spark, d):
    """Nations by trade."""
    return cm.by_modularity(trade(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id")))


_REGION = "m as (select n_nationkey::bigint as id, n_regionkey as community from nation)"


def _members(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("community"))


@query(f"""with {_TRADE}, {_REGION}, p as (select distinct least(src, dst) as a, greatest(src, dst) as b from t), i as (select x.community, count(*) as n_links from p join m x on x.id = a join m y on y.id = b where x.community = y.community group by 1)
select community, count(*) as n_nodes, coalesce(max(n_links), 0) as n_links, round(case when count(*) <= 1 then 1.0 else coalesce(max(n_links), 0) / (count(*) * (count(*) - 1) / 2::double) end, 4) as cohesion from m left join i using (community) group by 1""")
def cohesion(spark, d):
    return tr.cohesion(_members(spark, d), trade(spark, d))


@query(f"with {_TRADE}, {_REGION} select x.community as a, y.community as b, count(*) as n from t join m x on x.id = src join m y on y.id = dst where x.community <> y.community group by 1, 2")
def cross_community(spark, d):
    return tr.cross_community(_members(spark, d), trade(spark, d))


@query("""with m as (select *, complexity as community, regexp_extract(file, '([^/]+)/[^/]*$', 1) as folder from nodes where kind = 'class'),
b as (select community, folder, count(*) as n from m group by 1, 2), f as (select community, folder, row_number() over (partition by community order by n desc, folder) as k from b)
select community, folder || ': ' || (select min(sig) from m where m.community = f.community) as label from f where k = 1""", views=True)
def community_labels(spark, d):
    n = nodes(spark, d).where("kind = 'class'")
    return tr.community_labels(n.select("id", F.col("complexity").alias("community")), n)


@query("""with e as (select distinct 'py:sales/' || o_custkey || '::' || o_orderkey as src, c_name as dst, o_orderkey % 3 as k from orders join customer on o_custkey = c_custkey),
c as (select c_name, min('py:crm/' || c_nationkey || '::' || c_name) as id, count(*) as n from customer group by 1)
select src, case when k = 0 then 'ext:py:unresolved:gone_' || dst else id end as dst, 'CALLS' as type, case when k = 0 then 'external' when n > 1 then 'ambiguous' else 'resolved' end as confidence from e join c on c_name = dst""")
def resolve_symbols(spark, d):
    from ..plans.resolve import resolve

    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("gone_"), "c_name")).otherwise(F.col("c_name"))
    raw = o.select(F.concat(F.lit("py:sales/"), "o_custkey", F.lit("::"), "o_orderkey").alias("src"), name.alias("dst"), F.lit("CALLS").alias("type"), F.lit("unresolved").alias("confidence"))
    return resolve(nodes(spark, d).select("id", "kind", "file"), raw)[0]
