"""Evaluation of retrieval and context against gold references, as joins on tasks and ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import files_match, symbols_match

KS, POOL, TOP = (1, 3, 5, 10), 100, 5


def first_hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(task, first): the first rank at which a task's ranked (task, id, rank) meets one of its gold symbols (task, symbol);
    null for tasks without a hit. Ids meet names by their last part, so no pair of a task is formed that can't match."""
    last = lambda c: F.element_at(F.split(F.lower(F.trim(c)), r"::|\."), -1)
    g = gold.select("task", "symbol", last(F.col("symbol")).alias("__last"))
    r = ranked.select("task", "id", "rank", last(F.col("id")).alias("__last"))
    hits = r.join(g, ["task", "__last"]).where(symbols_match(F.col("id"), F.col("symbol"))).groupBy("task").agg(F.min("rank").alias("first"))
    return gold.select("task").distinct().join(hits, "task", "left")


def retrieval_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: tasks with gold symbols, candidate recall at 50 and 100, recall at 1, 3, 5 and 10, mean reciprocal rank over
    the first ten."""
    h = first_hits(ranked, gold)
    share = lambda k, name: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 4).alias(name)
    rr = F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0)
    return h.agg(F.count("*").alias("tasks"), share(50, "candidates_50"), share(100, "candidates_100"), *[share(k, f"recall_{k}") for k in KS], F.round(F.coalesce(F.avg(rr), F.lit(0.0)), 4).alias("mrr"))


def triage(ranked: DataFrame, gold: DataFrame, terms: DataFrame) -> DataFrame:
    """(task, category, first) of the tasks whose gold isn't among the first five: a ranking error where it is in the pool,
    else an identifier miss where a term of the task (task, term) and a gold symbol are part of each other, else a
    lexical miss."""
    missed = first_hits(ranked, gold).where(F.col("first").isNull() | (F.col("first") > TOP))
    low = lambda c: F.lower(F.col(c))
    # a task has few gold symbols and few terms
    near = gold.join(terms, "task").where(low("symbol").contains(low("term")) | low("term").contains(low("symbol"))).select("task").distinct().withColumn("__near", F.lit(True))
    category = F.when(F.col("first") <= POOL, "RANKING_ERROR").when(F.col("__near"), "IDENTIFIER_MISS").otherwise("LEXICAL_MISS")
    return missed.join(near, "task", "left").select("task", category.alias("category"), F.when(F.col("first") <= POOL, F.col("first")).alias("first"))


def compare(runs: dict[str, DataFrame], gold: DataFrame) -> DataFrame:
    """``retrieval_metrics`` of each named run: an ablation or a comparison of strategies."""
    out = None
    for name, ranked in runs.items():
        one = retrieval_metrics(ranked, gold).withColumn("run", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def context_metrics(included: DataFrame, gold: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row over all tasks: recall of gold symbols, files and tests, precision of included symbols, false inclusion of
    what is excluded, tokens and their reduction.

    included: (task, what, item) with what symbol or file; gold: (task, what, item) with what symbol, related, file, test or
    excluded; sizes: (task, tokens, raw_tokens). A task has tens of items.
    """
    i, g = included.withColumnRenamed("item", "__in").withColumnRenamed("what", "__as"), gold
    symbol, file = F.col("__as") == "symbol", F.col("__as") == "file"
    meets = (symbol & F.col("what").isin("symbol", "related", "excluded") & symbols_match(F.col("__in"), F.col("item"))) | (file & F.col("what").isin("file", "test", "excluded") & files_match(F.col("__in"), F.col("item")))
    both = g.join(i, "task", "left").withColumn("hit", F.coalesce(meets, F.lit(False)))
    per_gold = both.groupBy("task", "what", "item").agg(F.max("hit").alias("hit"))
    share = lambda what: F.avg(F.when(F.col("what") == what, F.col("hit").cast("double")))
    recalls = per_gold.agg(*[F.round(F.coalesce(share(w), F.lit(1.0)), 4).alias(f"{w}_recall") for w in ("symbol", "file", "test")], F.round(F.coalesce(share("excluded"), F.lit(0.0)), 4).alias("false_inclusion"))
    pool = F.col("what").isin("symbol", "related")
    per_in = both.where("__as = 'symbol'").groupBy("task", "__in").agg(F.max(F.col("hit") & pool).alias("relevant"), F.max(pool).alias("__pool"))
    has_pool = g.groupBy("task").agg(F.max(F.col("what").isin("symbol", "related")).alias("__has"))
    precise = sizes.select("task").join(has_pool, "task", "left").join(per_in.groupBy("task").agg(F.avg(F.col("relevant").cast("double")).alias("p")), "task", "left")
    precision = precise.agg(F.round(F.avg(F.when(F.coalesce("__has", F.lit(False)), F.coalesce("p", F.lit(0.0))).otherwise(1.0)), 4).alias("precision"))
    tokens = sizes.agg(F.count("*").alias("tasks"), F.round(F.avg("tokens"), 1).alias("mean_tokens"), F.round(F.coalesce(F.greatest(1 - F.sum("tokens") / F.sum("raw_tokens"), F.lit(0.0)) * 100, F.lit(0.0)), 2).alias("reduction_pct"))
    return tokens.join(recalls).join(precision)  # one row each


def same_results(make: Callable[[], DataFrame], times: int = 3) -> bool:
    """Whether a query gives the same multiset of rows each time."""

    def digest() -> tuple:
        df = make()
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)"))).first())

    first = digest()
    return all(digest() == first for _ in range(times - 1))


def markdown(df: DataFrame, title: str) -> str:
    """A small result as a Markdown table."""
    rows = df.collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join([*lines, *["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows]]) + "\n"
