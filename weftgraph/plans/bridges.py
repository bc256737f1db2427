"""Client calls bridged to server routes across files and languages, from the facts that parsers leave on nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_route, template_only
from ..operators.routes import match


def facts(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes (id, method, raw, route) and calls (id, method, raw, route) of nodes with ``reads``: ROUTE:method:path and
    HTTP:[method:]url; method is null where none is said. Calls whose URL has no literal segment are left out."""
    said = nodes.select("id", F.explode("reads").alias("fact"))
    method = F.regexp_extract("fact", r"^(?:ROUTE|HTTP):([A-Z]+):", 1)
    rows = said.where(F.col("fact").rlike("^(ROUTE|HTTP):")).select("id", "fact", F.when(~method.isin("", "ANY"), method).alias("method"), F.regexp_replace("fact", r"^(?:ROUTE|HTTP):(?:[A-Z]+:)?", "").alias("raw"))
    rows = rows.withColumn("route", normalize_route(F.col("raw")))
    of = lambda what: rows.where(F.col("fact").startswith(what)).drop("fact").distinct()
    return of("ROUTE:"), of("HTTP:").where(~template_only(F.col("raw")))


def links(nodes: DataFrame) -> DataFrame:
    """(src, dst, method, route, confidence): each call with the routes that fit it and allow its method, of these the ones
    with the most literal segments."""
    routes, calls = facts(nodes)
    pairs = match(calls.select("id", F.col("route").alias("client")).distinct(), routes.select(F.col("route").alias("server")).distinct(), "id", best=False)
    c = calls.select("id", F.col("route").alias("client"), "method")
    s = routes.select(F.col("id").alias("dst"), F.col("route").alias("server"), F.col("method").alias("allowed"))
    ok = F.col("method").isNull() | F.col("allowed").isNull() | (F.col("method") == F.col("allowed"))
    hits = pairs.join(c, ["id", "client"]).join(s, "server").where(ok)
    most = F.max("n_literals").over(Window.partitionBy("id", "client", "method"))  # the routes that one call fits
    hits = hits.withColumn("most", most).where((F.col("n_literals") == F.col("most")) & (F.col("id") != F.col("dst")))
    return hits.select(F.col("id").alias("src"), "dst", "method", F.col("server").alias("route"), F.lit("resolved").alias("confidence")).distinct()
