"""Co-change mining over commits (hash, ts in epoch seconds, files)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

HALF_LIFE_DAYS, MIN_CONFIDENCE, MIN_COMMITS, MAX_FILES = 180.0, 0.25, 2, 50


def decay(age_days: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    return F.exp(-math.log(2) / half_life_days * age_days)


#: Ordered pairs that a task makes before they are summed, so that its table of sums stays small whatever the input.
PAIRS_A_TASK = 1_000_000


def _stored(commits: DataFrame, max_files: int) -> tuple[DataFrame, float | None, int]:
    """(hash, ts, files), files once each, of commits that list 2 to ``max_files`` as a written table, the latest time of all
    commits, and the number of tasks for their pairs."""
    c, _ = written(commits.select("hash", "ts", F.array_distinct("files").alias("files"), F.size("files").between(2, max_files).alias("listed")), "commits")
    n = F.size("files")
    row = c.agg(F.max("ts").alias("latest"), F.sum(F.when(F.col("listed"), n * (n - 1))).alias("pairs")).first()
    return c.where("listed").drop("listed"), row.latest, math.ceil((row.pairs or 1) / PAIRS_A_TASK)


def _aged(stored: DataFrame, latest: float | None, half_life_days: float) -> DataFrame:
    age = F.greatest(F.lit(0.0), (F.lit(latest).cast("double") - F.col("ts")) / 86400)
    return stored.withColumn("age", age).withColumn("weight", decay(F.col("age"), half_life_days))


def touched(commits: DataFrame, half_life_days: float = HALF_LIFE_DAYS, max_files: int = MAX_FILES) -> DataFrame:
    """(hash, ts, age, weight, file, beside): distinct files of commits that list 2 to ``max_files`` files, and the files of
    all such commits of their hash. Ages count from the latest of all commits."""
    return _touched(*_stored(commits, max_files), half_life_days)


def _touched(stored: DataFrame, latest: float | None, tasks: int, half_life_days: float) -> DataFrame:
    # commits are dealt by hash to as many tasks as their pairs need; a hash that comes twice still meets itself
    beside = F.flatten(F.collect_list("files").over(Window.partitionBy("hash")))
    dealt = _aged(stored.repartition(tasks, "hash"), latest, half_life_days).withColumn("beside", beside)
    return dealt.select("hash", "ts", "age", "weight", F.explode("files").alias("file"), "beside")


def pairs(items: DataFrame) -> DataFrame:
    """(file_a, file_b, weight, n, age) of ordered pairs that share a commit; a commit has ``max_files`` files at most,
    so it gives a bounded number of pairs."""
    both = items.select(F.col("file").alias("file_a"), "weight", "age", F.explode("beside").alias("file_b")).where("file_a <> file_b")
    return both.groupBy("file_a", "file_b").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.min("age").alias("age"))


def co_changes(commits: DataFrame, half_life_days: float = HALF_LIFE_DAYS, min_confidence: float = MIN_CONFIDENCE, min_commits: int = MIN_COMMITS, max_files: int = MAX_FILES) -> DataFrame:
    """(file_a, file_b, probability, co_commit_count, total_commits_a, last_co_commit_age_days): how likely b changes
    when a does, recent commits counting more."""
    return _relations(*_stored(commits, max_files), half_life_days, min_confidence, min_commits)


def _relations(stored: DataFrame, latest: float | None, tasks: int, half_life_days: float, min_confidence: float = MIN_CONFIDENCE, min_commits: int = MIN_COMMITS) -> DataFrame:
    each = _aged(stored, latest, half_life_days).select("weight", F.explode("files").alias("file_a"))
    alone = each.groupBy("file_a").agg(F.sum("weight").alias("weight_a"), F.count("*").alias("total_commits_a"))
    p = F.least(F.lit(0.99), F.col("weight") / F.col("weight_a"))
    items = _touched(stored, latest, tasks, half_life_days)
    found = pairs(items).where(F.col("n") >= min_commits).join(alone, "file_a").withColumn("p", p).where(F.col("p") >= min_confidence)
    return found.select("file_a", "file_b", F.round("p", 4).alias("probability"), F.col("n").alias("co_commit_count"), "total_commits_a", F.round("age", 1).alias("last_co_commit_age_days"))


def edges(relations: DataFrame, lang: str = "py") -> DataFrame:
    """CO_CHANGED_WITH edges of co-change relations."""
    node = lambda c: F.concat(F.lit(f"{lang}:"), F.regexp_replace(c, "^[./]+", ""), F.lit("::"))
    return relations.select(node("file_a").alias("src"), node("file_b").alias("dst"), F.lit("CO_CHANGED_WITH").alias("type"), F.lit("dynamic").alias("confidence"))


def for_target(relations: DataFrame, target: str, most: int = 20) -> DataFrame:
    """Relations from a file, given whole or by the end of its path, likeliest first."""
    hit = (F.col("file_a") == target) | F.col("file_a").endswith(f"/{target}")
    return relations.where(hit).orderBy(F.desc("probability"), "file_b").limit(most)


def split_at(commits: DataFrame, share: float = 0.7) -> DataFrame:
    """``commits`` with ``part``: train up to the commit at a share of the chronological order, test after it."""
    total = commits.count()
    place = max(2, int(share * total))
    # the timestamp at a place, from running counts over distinct timestamps
    by = commits.groupBy("ts").count()
    upto = by.withColumn("upto", F.sum("count").over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    cut = upto.where(F.col("upto") > min(place, total - 1)).agg(F.min("ts").alias("cut"))
    return commits.join(F.broadcast(cut)).withColumn("part", F.when(F.col("ts") <= F.col("cut"), "train").otherwise("test")).drop("cut")


def evaluate(commits: DataFrame, ks: tuple[int, ...] = (5, 10), half_lives: tuple[float, ...] = (30.0, 90.0, 180.0)) -> DataFrame:
    """Per half-life how well relations of the earlier commits foretell the other files of later ones: mean precision
    and recall at k, and mean reciprocal rank, over (commit, file) pairs whose file has relations."""
    parts = split_at(written(commits.select("hash", "ts", "files"), "commits")[0])
    train = _stored(parts.where("part = 'train'"), MAX_FILES)
    tests = parts.where("part = 'test'").where(F.size("files").between(2, MAX_FILES)).select("hash", F.array_distinct("files").alias("files"))
    asked = tests.select("hash", F.explode("files").alias("file_a"), "files").where(F.size("files") > 1)
    out = None
    for h in half_lives:
        rel = _relations(*train, h)
        ranked = rel.withColumn("rank", F.row_number().over(Window.partitionBy("file_a").orderBy(F.desc("probability"), "file_b")))
        lists = ranked.where(F.col("rank") <= max(ks)).groupBy("file_a").agg(F.sort_array(F.collect_list(F.struct("rank", "file_b"))).alias("found"))
        q = asked.join(lists, "file_a").withColumn("hits", F.transform("found", lambda x: F.when(F.array_contains(F.col("files"), x["file_b"]), x["rank"])))
        first = F.array_min(F.filter("hits", lambda x: x.isNotNull()))
        at = lambda k: F.size(F.filter(F.slice("hits", 1, k), lambda x: x.isNotNull()))  # noqa: B023, E731
        mean = lambda c: F.round(F.avg(c), 4)
        cols = [m for k in ks for m in (mean(at(k) / k).alias(f"precision_{k}"), mean(at(k) / (F.size("files") - 1)).alias(f"recall_{k}"))]
        row = q.agg(F.count("*").alias("n"), *cols, mean(F.coalesce(1 / first, F.lit(0.0))).alias("mrr")).select(F.lit(h).alias("half_life"), "*")
        out = row if out is None else out.unionByName(row)
    return out
