"""Client calls joined to server routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import literals, routes_match, segments


def match(clients: DataFrame, servers: DataFrame, key: str, best: bool = True) -> DataFrame:
    """(key, client, server, n_literals): per client the matching servers with the most literal segments, or all of them.

    Two routes that match share a literal segment at the same distance from their ends, so the join is on (segment,
    distance), over distinct routes; pairs without one are never formed. ``clients`` has key and client, ``servers``
    has server, both normalized.
    """

    def places(df: DataFrame, name: str) -> DataFrame:
        s = segments(F.col(name))
        return df.select(name).distinct().select(name, F.posexplode(F.reverse(s)).alias("place", "segment")).where("segment <> ':param'")

    pairs = places(clients, "client").join(places(servers, "server"), ["place", "segment"]).select("client", "server").distinct()
    hits = pairs.where(routes_match(F.col("client"), F.col("server"))).withColumn("n_literals", F.size(literals(F.col("server"))))
    if best:
        hits = hits.withColumn("best", F.max("n_literals").over(Window.partitionBy("client"))).where("n_literals = best").drop("best")
    return clients.join(hits, "client").select(key, "client", "server", "n_literals")
