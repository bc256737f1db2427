"""Registered queries: metrics, budgets, rules, telemetry and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate as estimate
from ..operators import budget as b
from ..operators import metrics as m
from ..sources.graph_views import edges, nodes, table
from ..streaming import events as ev
from .registry import query

_RANKED = """r as (select o_custkey % 200 as task, l_partkey % 500 as item, row_number() over (partition by o_custkey % 200 order by sum(l_quantity) desc, l_partkey % 500) as rank from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
k as (select * from r where rank <= 20), g as (select distinct o_custkey % 200 as task, l_suppkey as item from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' and l_quantity > 45 and o_custkey % 200 <> 13)"""


def _lines(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey")).withColumn("task", F.col("o_custkey") % 200)


def _ranked(spark, d):
    n = _lines(spark, d).groupBy("task", (F.col("l_partkey") % 500).alias("item")).agg(F.sum("l_quantity").alias("q"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("q"), "item"))).where("rank <= 20").drop("q")


def _gold(spark, d):
    return _lines(spark, d).where("l_returnflag = 'R' and l_quantity > 45 and task <> 13").select("task", F.col("l_suppkey").alias("item")).distinct()


_RECALL = f"""{_RANKED}, f as (select task, min(rank) as first from k join g using (task, item) group by 1),
t as (select distinct k.task, f.first, k.task in (select task from g) as has from k left join f using (task)),
per as (select task, (not has or coalesce(first <= 1, false))::int as recall_1, (not has or coalesce(first <= 3, false))::int as recall_3, (not has or coalesce(first <= 5, false))::int as recall_5, (not has or coalesce(first <= 10, false))::int as recall_10, round(coalesce(1 / first::double, 0), 6) as reciprocal_rank from t)"""


@query(f"with {_RECALL} select * from per")
def recall_at_k(spark, d):
    return m.recall_at(_ranked(spark, d), _gold(spark, d))


@query(f"with {_RECALL} select count(*) as n, round(avg(reciprocal_rank), 4) as mrr from per")
def mrr(spark, d):
    return m.mrr(m.recall_at(_ranked(spark, d), _gold(spark, d)))


_SETS = f"""{_RANKED}, n as (select coalesce(k.task, g.task) as task, count(k.item) as nf, count(g.item) as ng, count(case when k.item is not null and g.item is not null then 1 end) as hits
 from (select distinct task, item from k) k full join g on k.task = g.task and k.item = g.item group by 1)"""


@query(f"""with {_SETS}, q as (select *, case when nf = 0 then (ng = 0)::int else hits / nf::double end as p, case when ng = 0 then 1 else hits / ng::double end as r from n)
select task, round(p, 4) as precision, round(r, 4) as recall, round(case when hits = 0 then 0 else 2 * p * r / (p + r) end, 4) as f1 from q""")
def prf1(spark, d):
    return m.precision_recall(_ranked(spark, d).select("task", "item"), _gold(spark, d))


@query(f"with {_SETS} select task, round(1 - case when ng = 0 then 0 else hits / ng::double end, 4) as negative_precision, round(case when nf = 0 then 0 else hits / nf::double end, 4) as false_inclusion from n")
def negative_precision(spark, d):
    return m.negative_precision(_ranked(spark, d).select("task", "item"), _gold(spark, d))


_PRED = "p as (select least(n_chars / 5000.0::double, 1.0::double) as p, quality as outcome from documents join labels using (doc_id))"


def _predictions(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("p"), F.col("quality").alias("outcome"))


@query(f"with {_PRED} select count(*) as n, round(avg((p - outcome) * (p - outcome)), 4) as brier, round(avg(case when outcome = 1 then p end), 4) as mean_correct, round(avg(case when outcome = 0 then p end), 4) as mean_incorrect from p")
def brier(spark, d):
    return m.brier(_predictions(spark, d))


@query(f"""with {_PRED}, o as (select floor(least(greatest(p, 0.0::double), 0.9999::double) / 0.1::double)::int as bucket, count(*) as n, avg(p) as mean_p, avg(outcome) as accuracy from p group by 1)
select i::int as bucket, round(i * 0.1::double, 4) as low, round((i + 1) * 0.1::double, 4) as high, coalesce(n, 0) as n, round(coalesce(mean_p, (i + 0.5::double) * 0.1::double), 4) as mean_p, round(coalesce(accuracy, 0), 4) as accuracy from range(10) t(i) left join o on bucket = i""")
def calibration(spark, d):
    return m.calibration(_predictions(spark, d))


@query("select event_type, round(quantile_cont(value, 0.5), 2) as p50, round(quantile_cont(value, 0.95), 2) as p95, round(avg(value), 2) as mean, round(max(value), 2) as max from events group by 1")
def latency_percentiles(spark, d):
    return m.percentiles(table(spark, d, "events"), "event_type", "value")


_EST = r"greatest(floor(len(regexp_extract_all(text, '\S+')) * 1.3::double), floor(length(text) / 4::double))::bigint"


@query(f"select conv_id, turn, {_EST} as tokens from conversations")
def token_estimate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", estimate(F.col("text")).alias("tokens"))


@query(f"""select conv_id, turn, cost, spent from (select conv_id, turn, {_EST} as cost, (sum({_EST}) over (partition by conv_id order by turn rows unbounded preceding))::bigint as spent from conversations) where spent <= 600""")
def budget_prefix(spark, d):
    return b.budget_prefix(table(spark, d, "conversations"), "conv_id", ["turn"], estimate(F.col("text")), 600).select("conv_id", "turn", "cost", "spent")


@query("select p_partkey, p_brand, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as k from part) where k <= 2 order by p_retailprice desc, p_partkey limit 8")
def cap_per_group(spark, d):
    return b.cap_per_group(table(spark, d, "part"), "p_brand", [F.desc("p_retailprice"), "p_partkey"], 2, 8).select("p_partkey", "p_brand", "p_retailprice")


@query("""select p_brand, p_partkey, p_retailprice, place from (select *, max(p_retailprice) over (partition by p_brand) as top, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey)::int as place from part)
where (place = 1 or p_retailprice >= 0.99::double * top) and place <= 4""")
def band_cut(spark, d):
    return b.band_cut(table(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey", 0.99).select("p_brand", "p_partkey", "p_retailprice", "place")


@query(f"""with w as (select conv_id % 40 as task, conv_id * 7 % 1300 as file from conversations), f as (select doc_id as file, {_EST} as tokens from documents)
select task, greatest(sum(coalesce(tokens, 1200)), 2000)::bigint as tokens from w left join f using (file) group by 1""")
def raw_token_baseline(spark, d):
    wanted = table(spark, d, "conversations").select((F.col("conv_id") % 40).alias("task"), (F.col("conv_id") * 7 % 1300).alias("file"))
    return b.raw_token_baseline(wanted, table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text"))


_CALLS = "c as (select event_type as tool, value as latency_ms, (user_id % 700)::bigint as tokens_returned, (event_id % 1000 - 100)::bigint as tokens_saved from events)"


@query(f"""with {_CALLS}, t as (select tool, count(*) as calls, sum(greatest(tokens_returned, 0))::bigint as tokens_returned, sum(greatest(tokens_saved, 0))::bigint as tokens_saved, round(avg(latency_ms), 2) as avg_latency_ms from c group by rollup (tool))
select *, round(case when tokens_returned + tokens_saved > 0 then 100.0::double * tokens_saved / (tokens_returned + tokens_saved) else 0 end, 1) as reduction_pct from t""")
def telemetry_rollup(spark, d):
    calls = table(spark, d, "events").select(F.col("event_type").alias("tool"), F.col("value").alias("latency_ms"), (F.col("user_id") % 700).alias("tokens_returned"), (F.col("event_id") % 1000 - 100).alias("tokens_saved"))
    return b.telemetry(calls)


@query("""with e as (select event_id, user_id, (event_id % 5000) / 1e6::double * 0.5::double + 0 as x, ((event_id % 5000) - (event_id % 300) / 2::double) / 1e6::double * case when event_type = 'purchase' then 3.0::double else 0.5::double end + (event_id % 700) / 1e6::double * 1.5::double as cost from events)
select event_id, user_id, round(sum(cost) over (partition by user_id order by event_id rows unbounded preceding), 9) as spent from e""")
def cost_running(spark, d):
    k = F.col("event_id")
    rates = spark.createDataFrame([("purchase", 3.0)], "event_type string, price double")
    e = table(spark, d, "events").join(rates, "event_type", "left").withColumn("cost", b.cost(k % 5000, k % 300, k % 700, F.coalesce("price", F.lit(0.5)), F.lit(1.5)))
    upto = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", "user_id", F.round(F.sum("cost").over(upto), 9).alias("spent"))


@query("""with a as (select src as id, count(distinct dst) as affected, count(distinct case when kind = 'sql_table' then dst end) as tables, count(distinct file) as files from edges join nodes on nodes.id = dst group by 1)
select case when tables > 0 or affected > 5 then 'HIGH' when affected > 1 or files > 1 then 'MEDIUM' else 'LOW' end as risk, count(*) as n from a group by 1""", views=True)
def risk_level(spark, d):
    return b.risk_of_sources(nodes(spark, d), edges(spark, d)).groupBy("risk").agg(F.count("*").alias("n"))


@query(r"""select doc_id, len(regexp_extract_all(text, '\S+')) <= 60 and not regexp_matches(text, '```|def |class |\bimport |=>|[{};]') and not (regexp_matches(lower(text), '\b(api|service|endpoint|http)\b') and n_chars % 2 = 0) and source in ('src0', 'src1') as stands from documents""")
def verify_story(spark, d):
    known = F.array(F.lit("src0"), F.lit("src1"))
    return table(spark, d, "documents").select("doc_id", b.verified_story(F.col("text"), F.array("source"), known, F.col("n_chars") % 2).alias("stands"))


@query("""with n as (select nodes.*, coalesce(k, 0) as degree from nodes left join (select dst, count(*) as k from edges group by 1) on dst = id)
select id, case when kind in ('function', 'method') then upper(kind[1]) || kind[2:] || ' ' || sig || ' has complexity ' || complexity || ' and ' || degree || ' links.' when kind = 'class' then 'Class ' || sig || ' has ' || degree || ' links.'
when kind = 'sql_table' then 'Table ' || sig || ' is used by ' || degree || ' statements.' when kind = 'file' then 'File ' || sig || '.' else kind || ' ' || sig || '.' end as story from n""", views=True)
def story_template(spark, d):
    n = edges(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    n = nodes(spark, d).join(n, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return n.select("id", b.story(F.col("kind"), F.col("sig"), F.col("complexity"), F.col("degree")).alias("story"))


@query("""with k as (select doc_id, sha256(sha256(coalesce(text, '')) || ':2:v1') as key from documents), c as (select distinct key from k where doc_id % 3 = 0)
select count(*) as lookups, count(c.key) as hits, round(count(c.key) / count(*)::double, 4) as hit_rate from k left join c using (key)""")
def cache_hit_rate(spark, d):
    k = table(spark, d, "documents").select("doc_id", b.cache_key(F.sha2(F.coalesce("text", F.lit("")), 256), "2", "v1").alias("key"))
    cache = k.where("doc_id % 3 = 0").select("key").distinct().withColumn("hit", F.lit(1))
    return k.join(cache, "key", "left").agg(F.count("*").alias("lookups"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count("*"), 4).alias("hit_rate"))


@query("""with o as (select doc_id::varchar as path, n_chars as mtime, n_chars as size from documents where doc_id % 10 <> 1), n as (select doc_id::varchar as path, n_chars + (doc_id % 7 = 0)::int as mtime, n_chars + (doc_id % 5 = 0)::int as size from documents where doc_id % 10 <> 2)
select coalesce(o.path, n.path) as path, case when o.path is null then 'created' when n.path is null then 'deleted' else 'changed' end as change from o full join n on o.path = n.path where o.path is null or n.path is null or n.mtime > o.mtime or n.size <> o.size""")
def snapshot_diff(spark, d):
    t = table(spark, d, "documents")
    path, k = F.col("doc_id").cast("string").alias("path"), F.col("doc_id")
    old = t.where(k % 10 != 1).select(path, F.col("n_chars").alias("mtime"), F.col("n_chars").alias("size"))
    new = t.where(k % 10 != 2).select(path, (F.col("n_chars") + (k % 7 == 0).cast("int")).alias("mtime"), (F.col("n_chars") + (k % 5 == 0).cast("int")).alias("size"))
    return b.snapshot_diff(old, new)


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark, d):
    return ev.tumbling(table(spark, d, "events"), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""with e as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from (select user_id, ts, max(new) over (partition by user_id, ts) as new0, case when row_number() over (partition by user_id, ts) = 1 then max(new) over (partition by user_id, ts) else 0 end as new from e))
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from s group by user_id, k""")
def events_session(spark, d):
    out = ev.sessions(table(spark, d, "events"), "30 minutes")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("select event_type as tool, count(*) as calls, round(avg(value), 2) as avg_latency_ms from events group by 1")
def streaming_telemetry(spark, d):
    """The stream, run over what there is and read back."""
    return ev.stream_telemetry(spark, f"{d}/events.parquet")
