"""Stories of nodes by the cheapest tier that gives one, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .budget import cache_key, cost

# Kinds that never need more than a template; the budgets of a run.
PLAIN_KINDS = ["json_config", "yaml_config", "file", "external_symbol", "variable", "command", "sql_table"]
MOST_TOKENS, MOST_COST, EXPECTED = 100_000, 1.0, 150


def is_trivial(kind: Column, complexity: Column, calls: Column, reads: Column, writes: Column) -> Column:
    """Whether a node is plain: one of the plain kinds, or code without branches that calls, reads and writes nothing."""
    idle = (complexity == 1) & (calls == 0) & (F.coalesce(F.size(reads), F.lit(0)) <= 0) & (F.coalesce(F.size(writes), F.lit(0)) <= 0)
    return kind.isin(PLAIN_KINDS) | (kind.isin("function", "method") & F.coalesce(idle, F.lit(False)))


def tiers(nodes: DataFrame, cache: DataFrame, allowed: int = 200, room: int | None = None, version: str = "1") -> DataFrame:
    """(id, tier) for nodes (id, kind, complexity, calls, reads, writes, content_hash): trivial, cache (key), template for what
    isn't among the ``allowed`` most complex nodes or doesn't fit ``room`` tokens of a model, else model."""
    df = nodes.withColumn("__key", cache_key(F.col("content_hash"), "fast", version)).withColumn("__trivial", is_trivial(F.col("kind"), F.col("complexity"), F.col("calls"), F.col("reads"), F.col("writes")))
    df = df.join(cache.select(F.col("key").alias("__key")).distinct().withColumn("__hit", F.lit(True)), "__key", "left")
    first = df.where("not __trivial and __hit is null").orderBy(F.desc("complexity"), F.desc("calls"), "id").limit(allowed).select("id", "complexity", "calls")
    w = Window.orderBy(F.desc("complexity"), F.desc("calls"), "id")  # ``allowed`` rows
    chosen = first.withColumn("__n", F.row_number().over(w)).select("id", "__n")
    fits = F.lit(True) if room is None else F.col("__n") * EXPECTED <= room
    tier = F.when(F.col("__trivial"), "trivial").when(F.col("__hit"), "cache").when(F.col("__n").isNotNull() & fits, "model").otherwise("template")
    return df.join(F.broadcast(chosen), "id", "left").select("id", tier.alias("tier"))


def governor(calls: DataFrame, rates: DataFrame, max_tokens: int = MOST_TOKENS, max_cost: float = MOST_COST) -> DataFrame:
    """(run, call, spent_tokens, spent_cost, allowed) for calls (run, call, model, prompt, cached, completion) in the order of
    call: what a run has used before it, and whether the call may still be made; rates: (model, price_in, price_out), with
    a row ``default`` for the others."""
    r = F.broadcast(rates)  # a row a model
    other = rates.where("model = 'default'").select(F.col("price_in").alias("__in"), F.col("price_out").alias("__out"))
    df = calls.join(r, "model", "left").join(F.broadcast(other))
    price = cost(F.col("prompt"), F.col("cached"), F.col("completion"), F.coalesce("price_in", "__in"), F.coalesce("price_out", "__out"))
    upto = Window.partitionBy("run").orderBy("call").rowsBetween(Window.unboundedPreceding, -1)
    nano = F.round(price * 1e9).cast("long")  # whole numbers, so that sums are exact in any order
    df = df.withColumns({"spent_tokens": F.coalesce(F.sum(F.col("prompt") + F.col("completion")).over(upto), F.lit(0)), "spent_cost": F.coalesce(F.sum(nano).over(upto), F.lit(0)) / 1e9})
    return df.select("run", "call", "spent_tokens", "spent_cost", ((F.col("spent_tokens") + EXPECTED <= max_tokens) & (F.col("spent_cost") < max_cost)).alias("allowed"))
