"""Budgets, caps, rules and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..sources.tables import dealt


def budget_prefix(df: DataFrame, group: str, order: list, cost: Column, budget: int) -> DataFrame:
    """The rows of each group, in order, up to the first that would exceed the budget; ``spent``: the sum so far."""
    upto = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cost", cost).withColumn("spent", F.sum("cost").over(upto)).where(F.col("spent") <= budget)


def cap_per_group(df: DataFrame, group: str, order: list, each: int, total: int) -> DataFrame:
    """At most ``each`` rows of a group in order, then at most ``total`` rows in order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= each).drop("place").orderBy(*order).limit(total)


def band_cut(df: DataFrame, group: str, score: str, tie: str, share: float = 0.5, most: int = 4) -> DataFrame:
    """Of each group the best row and those within a share of its score, ``most`` at most."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("top", F.max(score).over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc(score), tie)))
    return ranked.where((F.col("place") == 1) | (F.col(score) >= share * F.col("top"))).where(F.col("place") <= most).drop("top")


def raw_token_baseline(wanted: DataFrame, files: DataFrame, missing: int = 1200, least: int = 2000) -> DataFrame:
    """Per task of (task, file) the tokens of its whole files (file, text)."""
    est = files.select("file", token_estimate(F.col("text")).alias("tokens"))
    n = wanted.join(est, "file", "left").groupBy("task").agg(F.sum(F.coalesce("tokens", F.lit(missing))).alias("tokens"))
    return n.select("task", F.greatest("tokens", F.lit(least)).alias("tokens"))


def telemetry(calls: DataFrame) -> DataFrame:
    """(tool, calls, tokens_returned, tokens_saved, avg_latency_ms, reduction_pct) by tool, and in all (tool null);
    negative counts are 0."""
    pos = lambda c: F.sum(F.greatest(F.col(c), F.lit(0)))
    t = calls.rollup("tool").agg(F.count("*").alias("calls"), pos("tokens_returned").alias("tokens_returned"), pos("tokens_saved").alias("tokens_saved"), F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"))
    whole = F.col("tokens_returned") + F.col("tokens_saved")
    return t.withColumn("reduction_pct", F.round(F.when(whole > 0, 100.0 * F.col("tokens_saved") / F.greatest(whole, F.lit(1))).otherwise(0.0), 1))


def cost(prompt: Column, cached: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """The cost of a call; cached prompt tokens cost half."""
    return (prompt - cached / 2) / 1e6 * price_in + completion / 1e6 * price_out


def risk(tables: Column, affected: Column, files: Column) -> Column:
    return F.when((tables > 0) | (affected > 5), "HIGH").when((affected > 1) | (files > 1), "MEDIUM").otherwise("LOW")


def risk_of_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, risk) of the sources of edges to known nodes. More than one file counts only where a source has a single
    target, so files are counted by target; distinct targets are counted where their join has put them together."""
    targets = nodes.groupBy(F.col("id").alias("dst")).agg(F.max(F.when(F.col("kind") == "sql_table", 1).otherwise(0)).alias("table"), F.countDistinct("file").alias("files"))
    one = dealt(edges.select("src", "dst"), "dst").join(targets, "dst").groupBy("src", "dst").agg(F.max("table").alias("table"), F.max("files").alias("files"))
    a = one.groupBy("src").agg(F.count("*").alias("affected"), F.max("table").alias("tables"), F.max("files").alias("files"))
    return a.select("src", risk(F.col("tables"), F.col("affected"), F.col("files")).alias("risk"))


def verified_story(story: Column, table_names: Column, known: Column, calls: Column) -> Column:
    """Whether a one-line story may stand: 60 words at most, no code, no table that isn't known, no claim of services
    without calls."""
    short = F.size(F.split(F.trim(story), r"\s+")) <= 60
    code = story.rlike(r"```|def |class |\bimport |=>|[{};]")
    service = F.lower(story).rlike(r"\b(api|service|endpoint|http)\b")
    return short & ~code & (F.size(F.array_except(table_names, known)) == 0) & ~(service & (calls == 0))


def story(kind: Column, name: Column, complexity: Column, degree: Column) -> Column:
    """A deterministic sentence on a node by its kind."""
    return (
        F.when(kind.isin("function", "method"), F.format_string("%s %s has complexity %d and %d links.", F.initcap(kind), name, complexity, degree))
        .when(kind == "class", F.format_string("Class %s has %d links.", name, degree))
        .when(kind == "sql_table", F.format_string("Table %s is used by %d statements.", name, degree))
        .when(kind == "file", F.format_string("File %s.", name))
        .otherwise(F.format_string("%s %s.", kind, name))
    )


def cache_key(content_hash: Column, tier: str, version: str) -> Column:
    return F.sha2(F.concat_ws(":", content_hash, F.lit(tier), F.lit(version)), 256)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of listings (path, mtime, size): created, changed (newer or of another size), deleted."""
    both = old.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0")).join(new.select("path", F.col("mtime").alias("m1"), F.col("size").alias("s1")), "path", "full_outer")
    change = F.when(F.col("m0").isNull(), "created").when(F.col("m1").isNull(), "deleted").when((F.col("m1") > F.col("m0")) | (F.col("s1") != F.col("s0")), "changed")
    return both.select("path", change.alias("change")).where("change is not null")
