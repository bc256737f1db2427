"""Graph views over the driver tables: nodes, edges, and the baskets and postings that other operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import dealt

NODE_COLUMNS = ["id", "lang", "kind", "sig", "file", "start_line", "end_line", "complexity", "content_hash"]
EDGE_COLUMNS = ["src", "dst", "type", "confidence"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nation(key: str) -> F.Column:
    return F.concat(F.lit("py:geo/"), F.col("n_regionkey"), F.lit("::"), F.col("n_name"))


def _part() -> F.Column:
    return F.concat(F.lit("py:catalog/"), F.col("p_brand"), F.lit("::"), F.col("p_partkey"), F.lit("."), F.col("p_name"))


def _supplier() -> F.Column:
    return F.concat(F.lit("sql:supply/"), F.col("s_nationkey"), F.lit("::"), F.col("s_name"))


def _customer() -> F.Column:
    return F.concat(F.lit("py:crm/"), F.col("c_nationkey"), F.lit("::"), F.col("c_name"))


def _order() -> F.Column:
    return F.concat(F.lit("py:sales/"), F.col("o_custkey"), F.lit("::"), F.col("o_orderkey"))


def _cards(df: DataFrame, node_id: F.Column, kind: str, sig: F.Column, file: F.Column, key: str) -> DataFrame:
    line = (F.col(key) % 1000 + 1).cast("int")
    return df.select(
        node_id.alias("id"), F.substring_index(node_id, ":", 1).alias("lang"), F.lit(kind).alias("kind"), sig.cast("string").alias("sig"), file.alias("file"),
        line.alias("start_line"), (line + F.col(key) % 40).cast("int").alias("end_line"), (F.col(key) % 20 + 1).cast("int").alias("complexity"), F.sha2(node_id, 256).alias("content_hash"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each region, nation, customer, supplier, part and order."""
    t = lambda name: table(spark, sf_dir, name)
    parts = [
        _cards(t("region"), F.concat(F.lit("yaml:geo/region::"), F.col("r_name")), "yaml_config", F.col("r_name"), F.lit("geo/region.yaml"), "r_regionkey"),
        _cards(t("nation"), _nation(""), "file", F.col("n_name"), F.concat(F.lit("geo/"), F.col("n_regionkey"), F.lit("/"), F.col("n_name"), F.lit(".py")), "n_nationkey"),
        _cards(t("customer"), _customer(), "class", F.col("c_name"), F.concat(F.lit("crm/"), F.col("c_nationkey"), F.lit("/"), F.col("c_mktsegment"), F.lit(".py")), "c_custkey"),
        _cards(t("supplier"), _supplier(), "sql_table", F.col("s_name"), F.concat(F.lit("supply/"), F.col("s_nationkey"), F.lit(".sql")), "s_suppkey"),
        _cards(t("part"), _part(), "function", F.col("p_name"), F.concat(F.lit("catalog/"), F.col("p_brand"), F.lit(".py")), "p_partkey"),
        _cards(t("orders"), _order(), "method", F.col("o_orderkey"), F.concat(F.lit("sales/"), F.year("o_orderdate"), F.lit(".py")), "o_orderkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges between these nodes, a multiset: one CALLS and one WRITES edge for each line item."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, src, dst, kind, confidence: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), confidence.alias("confidence"))
    sure, nation = F.lit("resolved"), t("nation")
    orders, items = t("orders"), t("lineitem")
    parts = t("part").select(F.col("p_partkey"), _part().alias("part_id"))
    suppliers = t("supplier").select(F.col("s_suppkey"), _supplier().alias("supplier_id"))
    # numbers are joined before ids, so that little is shuffled
    sold = dealt(dealt(items, "l_orderkey").join(orders, F.expr("l_orderkey = o_orderkey")), "l_partkey").join(parts, F.expr("l_partkey = p_partkey"))
    lines = dealt(items, "l_partkey").join(parts, F.expr("l_partkey = p_partkey"))
    flag = F.when(F.col("l_returnflag") == "N", "resolved").when(F.col("l_returnflag") == "R", "ambiguous").otherwise("unresolved")
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "ambiguous").otherwise("dynamic")
    all_ = [
        edge(t("customer").join(nation, F.expr("c_nationkey = n_nationkey")), _customer(), _nation(""), "DEFINED_IN", sure),
        edge(t("supplier").join(nation, F.expr("s_nationkey = n_nationkey")), _supplier(), _nation(""), "IMPORTS", sure),
        edge(nation.join(t("region"), F.expr("n_regionkey = r_regionkey")), _nation(""), F.concat(F.lit("yaml:geo/region::"), F.col("r_name")), "IMPORTS", sure),
        edge(orders.join(t("customer"), F.expr("o_custkey = c_custkey")), _order(), _customer(), "INHERITS", status),
        edge(sold, _order(), F.col("part_id"), "CALLS", flag),
        edge(lines.join(suppliers, F.expr("l_suppkey = s_suppkey")), F.col("part_id"), F.col("supplier_id"), "WRITES", F.when(F.col("l_linestatus") == "O", "resolved").otherwise("external")),
    ]
    out = all_[0]
    for e in all_[1:]:
        out = out.unionByName(e)
    return out


def commits(spark: SparkSession, sf_dir: str, item: str = "l_suppkey") -> DataFrame:
    """(hash, ts, files): an order is a commit, its suppliers or parts the files it touches, as listed, repeats included."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col(item).cast("string"))).alias("files"))
    orders = table(spark, sf_dir, "orders")
    when = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    return orders.join(items, F.expr("o_orderkey = l_orderkey")).select(F.col("o_orderkey").cast("string").alias("hash"), when.alias("ts"), "files")


#: The same views as CTEs for DuckDB.
SQL = """
nodes as (
  select id, split_part(id, ':', 1) as lang, kind, sig, file, (k % 1000 + 1)::int as start_line, (k % 1000 + 1 + k % 40)::int as end_line,
         (k % 20 + 1)::int as complexity, sha256(id) as content_hash
  from (
    select 'yaml:geo/region::' || r_name as id, 'yaml_config' as kind, r_name as sig, 'geo/region.yaml' as file, r_regionkey::bigint as k from region
    union all select 'py:geo/' || n_regionkey || '::' || n_name, 'file', n_name, 'geo/' || n_regionkey || '/' || n_name || '.py', n_nationkey from nation
    union all select 'py:crm/' || c_nationkey || '::' || c_name, 'class', c_name, 'crm/' || c_nationkey || '/' || c_mktsegment || '.py', c_custkey from customer
    union all select 'sql:supply/' || s_nationkey || '::' || s_name, 'sql_table', s_name, 'supply/' || s_nationkey || '.sql', s_suppkey from supplier
    union all select 'py:catalog/' || p_brand || '::' || p_partkey || '.' || p_name, 'function', p_name, 'catalog/' || p_brand || '.py', p_partkey from part
    union all select 'py:sales/' || o_custkey || '::' || o_orderkey, 'method', o_orderkey::varchar, 'sales/' || year(o_orderdate) || '.py', o_orderkey from orders)),
edges as (
  select 'py:crm/' || c_nationkey || '::' || c_name as src, 'py:geo/' || n_regionkey || '::' || n_name as dst, 'DEFINED_IN' as type, 'resolved' as confidence
  from customer join nation on c_nationkey = n_nationkey
  union all select 'sql:supply/' || s_nationkey || '::' || s_name, 'py:geo/' || n_regionkey || '::' || n_name, 'IMPORTS', 'resolved' from supplier join nation on s_nationkey = n_nationkey
  union all select 'py:geo/' || n_regionkey || '::' || n_name, 'yaml:geo/region::' || r_name, 'IMPORTS', 'resolved' from nation join region on n_regionkey = r_regionkey
  union all select 'py:sales/' || o_custkey || '::' || o_orderkey, 'py:crm/' || c_nationkey || '::' || c_name, 'INHERITS',
    case o_orderstatus when 'F' then 'resolved' when 'O' then 'ambiguous' else 'dynamic' end from orders join customer on o_custkey = c_custkey
  union all select 'py:sales/' || o_custkey || '::' || o_orderkey, 'py:catalog/' || p_brand || '::' || p_partkey || '.' || p_name, 'CALLS',
    case l_returnflag when 'N' then 'resolved' when 'R' then 'ambiguous' else 'unresolved' end from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
  union all select 'py:catalog/' || p_brand || '::' || p_partkey || '.' || p_name, 'sql:supply/' || s_nationkey || '::' || s_name, 'WRITES',
    case l_linestatus when 'O' then 'resolved' else 'external' end from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)
"""
