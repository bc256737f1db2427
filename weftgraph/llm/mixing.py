"""Mixing sources to target weights by entropy balancing.

Among all ways to weight the words of a corpus that meet the token constraints, entropy balancing takes the one that is
nearest to the corpus in relative entropy: a document's rate is exponentially tilted, the exponential of the sum of the
multipliers of the constraints that it is under (its source, and further columns where they have targets too). The
convex dual is the sum over documents of size * rate, less the sum over constraints of multiplier * target. Newton's
iteration solves it: each step is a job that sums the gradient and the Hessian over all documents, pre-aggregated to the
cells that are under the same constraints. With sources alone the Hessian is diagonal, and the step is a join, whatever
the number of sources; where constraints overlap, its entries go to the driver, which solves for the step by conjugate
gradients. Iteration ends when every constraint is met within ``TOLERANCE``, and fails where none can be.

Rates become copies by controlled rounding: every document has floor(rate) copies, and documents in the order of the
md5 of their ids take one more as long as their cell's words stay within its target; then the one document whose size
is nearest to the words still missing takes one more, if that brings the cell nearer. The place where the order is cut
is found on totals of 256 groups of 256 buckets of md5 and then within one bucket, so no task sorts a source. (The sources
themselves are sorted in one task: a hundred bytes each.)
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, remove, settled, written

WORDS = r"[^\x20\x09-\x0D]++"
#: Newton steps at most: a multiplier falls by about 1 a step until near its solution, so this reaches rates of e**-190.
STEPS, TOLERANCE = 200, 1e-10
#: Entries of the Hessian of overlapping constraints up to which the driver takes them (about 100 bytes each).
MOST_ENTRIES = 1 << 20
#: Cells (or values of a constraint) up to which their table is broadcast: about 10 MB.
BROADCAST_ROWS = 100_000


def size_of(text: str | Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) of a table (source, source_size).

    Sources in the order of their code points, null last, weigh as ``weights`` repeats; they share ``share`` times all
    words by weight, none more than ``cap`` times its own. With u the common level, a target is min(cap * size,
    weight * u): the sources that reach their cap are those with the least cap * size / weight, so u follows from
    running sums in that order; it rises along the capped ones and falls after, so it is the largest found.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.get(table, (F.row_number().over(order) - 1) % len(weights)))
    s = s.withColumn("limit", cap * F.col("source_size")).withColumn("level", F.col("limit") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("capped", F.coalesce(F.sum("limit").over(by_level), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
    s = s.withColumn("u", (share * F.sum("source_size").over(everything) - F.col("capped")) / (F.sum("weight").over(everything) - F.col("gone")))
    s = s.withColumn("free", F.max(F.when(F.col("level") > F.col("u"), F.col("u"))).over(everything))
    u = F.coalesce("free", F.max("level").over(everything))
    return s.select("source", "source_size", "weight", F.least("limit", F.col("weight") * u).alias("target"))


def _meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Joins a table of cells by their columns; nulls meet nulls."""
    right = right.withColumnsRenamed({c: f"__{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    return left.join(F.broadcast(right) if few else right, same, how).drop(*[f"__{c}" for c in on])


def solve(cells: DataFrame, goals: dict[str, DataFrame], steps: int = STEPS) -> DataFrame:
    """``cells`` with ``rate``: the exponential of the sum of its constraints' multipliers in the dual's solution.

    cells: the columns that ``goals`` names, and size; goals: for each column its values with their targets (value,
    target). Cells with a value whose target is 0 or missing have rate 0. ValueError where no rates meet all targets.
    """
    spark, kinds = cells.sparkSession, list(goals)
    multipliers, few = {}, True
    for kind, goal in goals.items():
        table, path = written(goal.where("target > 0").select(F.col("value").cast(cells.schema[kind].dataType).alias(kind), "target", F.lit(0.0).alias(f"lambda_{kind}")), "multipliers")
        few = few and table.count() <= BROADCAST_ROWS
        multipliers[kind] = table, path

    def tilted() -> DataFrame:
        out = cells
        for kind in kinds:
            out = _meet(out, multipliers[kind][0].drop("target"), [kind], few=few)
        return out.withColumn("rate", F.exp(reduce(lambda a, b: a + b, [F.col(f"lambda_{k}") for k in kinds])))

    for _ in range(steps):
        now, worst = tilted().withColumn("words", F.col("size") * F.col("rate")), 0.0
        new: dict[str, DataFrame] = {}
        if len(kinds) == 1:
            kind = kinds[0]
            # the gradient is words - target, the Hessian has words on its diagonal
            sums = now.groupBy(kind).agg(F.sum("words").alias("words"))
            step = (F.col("words") - F.col("target")) / F.greatest(F.col("words"), F.lit(1e-300))
            new[kind] = _meet(multipliers[kind][0], sums, [kind], few=few).select(kind, "target", (F.col(f"lambda_{kind}") - step).alias(f"lambda_{kind}"), (F.abs(F.col("words") / F.col("target") - 1)).alias("off"))
        else:
            new = _newton_on_driver(now, {k: v[0] for k, v in multipliers.items()})
        for kind in kinds:
            table, path = written(new[kind], "multipliers")
            worst = max(worst, table.agg(F.max("off")).first()[0] or 0.0)
            remove(spark, multipliers[kind][1])
            multipliers[kind] = table.drop("off"), path
        if worst <= TOLERANCE:
            break
    else:
        raise ValueError("no mix meets these targets together")
    rates = tilted().select(*kinds, "rate")
    return _meet(cells, rates, kinds, "left", few).withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def _newton_on_driver(now: DataFrame, multipliers: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One step for constraints that overlap: (value, target, multiplier, off) of each kind. The sums come from a job,
    their number is checked first; multipliers move by 2 at most, as far from the solution the step may be too long."""
    kinds, spark = list(multipliers), now.sparkSession
    pairs = [now.groupBy(a, b).agg(F.sum("words").alias("words")) for a, b in combinations(kinds, 2)]
    if sum(p.count() for p in pairs) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} combinations of overlapping constraints")
    tables = {k: t.toPandas() for k, t in multipliers.items()}
    place, size = {}, 0
    for k in kinds:
        for v in tables[k][k].tolist():
            place[k, v] = size
            size += 1
    diagonal = np.zeros(size)
    for k in kinds:
        for v, words in now.groupBy(k).agg(F.sum("words")).collect():
            diagonal[place[k, v]] = words
    entries = [(place[a, x], place[b, y], words) for (a, b), p in zip(combinations(kinds, 2), pairs, strict=True) for x, y, words in p.collect()]
    i, j, w = (np.array(x) for x in zip(*entries, strict=True)) if entries else (np.zeros(0, int),) * 3
    target = np.concatenate([tables[k]["target"].to_numpy(float) for k in kinds])
    # a little more on the diagonal, as constraints whose sums agree leave directions that change nothing
    times = lambda x: (1 + 1e-8) * diagonal * x + np.bincount(i, w * x[j], size) + np.bincount(j, w * x[i], size)
    gradient = diagonal - target
    # conjugate gradients, scaled by the diagonal
    scale = 1 / np.maximum(diagonal, 1e-300)
    x, rest = np.zeros(size), gradient.copy()
    direction = scale * rest
    along = first = rest @ direction
    for _ in range(4 * size):
        ahead = times(direction)
        if along <= 1e-18 * first or direction @ ahead <= 0:  # what is left is up to the next step
            break
        length = along / (direction @ ahead)
        x, rest = x + length * direction, rest - length * ahead
        before, along = along, rest @ (scale * rest)
        direction = scale * rest + along / before * direction
    step, off, out, at = x * min(1.0, 2 / max(np.abs(x).max(initial=0), 1e-300)), np.abs(diagonal / target - 1), {}, 0
    for k in kinds:
        n = len(tables[k])
        rows = [(v, t, m - s, o) for v, t, m, s, o in zip(tables[k][k].tolist(), target[at : at + n].tolist(), tables[k][f"lambda_{k}"].tolist(), step[at : at + n].tolist(), off[at : at + n].tolist(), strict=True)]
        out[k], at = spark.createDataFrame(rows, f"{k} string, target double, lambda_{k} double, off double"), at + n
    return out


def _key(doc_id: str | Column) -> Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def plan(sizes: DataFrame, also: dict[str, dict[str | None, float]] | None = None, **options) -> DataFrame:
    """What mixes a table (doc_id, source, size, and the columns of ``also``): per cell source_size, target, rate, copies
    of each document, and the md5 up to which documents take one copy more ('' for none)."""
    also = also or {}
    on = ["source", *also]
    keyed = sizes.withColumn("key", _key("doc_id"))
    buckets, buckets_path = written(keyed.groupBy(*on, F.substring("key", 1, 4).alias("bucket")).agg(F.sum("size").alias("size")), "buckets")
    cells, cells_path = written(buckets.groupBy(*on).agg(F.sum("size").alias("size")), "cells")
    by_source, targets_path = written(targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), **options), "targets")
    goals = {"source": by_source.select(F.col("source").alias("value"), "target")}
    if also:
        words = by_source.agg(F.sum("target")).first()[0] or 0.0
        for column, weights in also.items():
            whole = sum(weights.values())
            goals[column] = sizes.sparkSession.createDataFrame([(v, float(w) / whole * words) for v, w in weights.items()], "value string, target double")
    rates = _meet(solve(cells, goals), by_source.select("source", "source_size", "target"), ["source"])
    own = F.col("size") * F.col("rate") if also else F.col("target")  # a cell's words; of a whole source they are its target
    rates = rates.withColumn("copies", F.floor(own / F.greatest("size", F.lit(1)) + 1e-9)).withColumn("extra", own - F.col("copies") * F.col("size")).drop("size")
    rates, rates_path = written(rates, "rates")
    before = lambda *order: Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # words before a bucket: those of the 256 groups of buckets before its own, and those before it in its group
    group = F.substring("bucket", 1, 2).alias("group")
    groups = buckets.groupBy(*on, group).agg(F.sum("size").alias("size"))
    groups = groups.select(*on, "group", F.coalesce(F.sum("size").over(before("group")), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*on, F.substring("bucket", 1, 2)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = buckets.select(*on, "bucket", "size", group, F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("within"))
    b = _meet(b, groups, [*on, "group"]).select(*on, "bucket", "size", (F.col("base") + F.col("within")).alias("before"))
    # the bucket in which the extra words are reached: the last that begins before them
    at = _meet(b, rates.where("extra > 0").select(*on, "extra"), on).where(F.col("before") <= F.col("extra"))
    at = at.groupBy(*on).agg(F.max_by(F.struct("bucket", "before", "extra"), "bucket").alias("at")).select(*on, "at.*")
    few = rates.count() <= BROADCAST_ROWS
    near = _meet(keyed, at, on, few=few).where(F.substring("key", 1, 4) == F.col("bucket"))
    near = near.groupBy(*on, "key").agg(F.sum("size").alias("size"), F.first("before").alias("base"), F.first("extra").alias("extra"))
    near = near.withColumn("until", F.col("base") + F.sum("size").over(Window.partitionBy(*on).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
    last = near.where(F.col("until") <= F.col("extra")).groupBy(*on).agg(F.max("key").alias("key"), F.max("until").alias("until"))
    # 4 digits of a bucket come before all its keys
    cut = _meet(at, last, on, "left").select(*on, F.coalesce("key", "bucket").alias("cut"), (F.col("extra") - F.coalesce("until", "before")).alias("gap"))
    cut, cuts_path = written(cut, "cuts")
    rest = _meet(keyed, cut, on, few=few).where(F.col("key") > F.col("cut"))
    best = rest.groupBy(*on).agg(F.min_by("key", F.struct(F.abs(F.col("size") - F.col("gap")), "key")).alias("fill"), F.first("gap").alias("gap"))
    best = _meet(keyed, best, on, few=few).where(F.col("key") == F.col("fill")).groupBy(*on).agg(F.first("fill").alias("fill"), F.sum("size").alias("size"), F.first("gap").alias("gap"))
    best = best.where(F.abs(F.col("size") - F.col("gap")) < F.col("gap")).select(*on, "fill")
    out = _meet(_meet(rates, cut, on, "left"), best, on, "left")
    out = out.select(*on, "source_size", "target", "rate", "copies", F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("fill", F.lit("")).alias("fill"))
    return settled(out, "mixture", [buckets_path, cells_path, targets_path, rates_path, cuts_path])


def mix(docs: DataFrame, also: dict[str, dict[str | None, float]] | None = None, **options) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0, 1 or 2 with the default options) for each row.

    ``docs`` has doc_id, source and text; null texts have no words, a null source is a source of its own and sorts
    last, null ids are all alike. Rows with the same doc_id in one source take the same number of copies. Rows
    without words go with their neighbours in the order. A source without words has target 0. Reruns agree, as the
    order depends on ids alone. Other columns are kept; one that is named like an added column (in any case) gets a 0
    after its name. An empty table stays empty. ``also`` gives further columns (of strings) with weights for their
    values, which share the words taken by them; documents with other values are not taken. With it the copies may
    exceed 2.
    """
    also = also or {}
    on = ["source", *also]
    place = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    col = {n: F.col(f"c{i}") for i, n in enumerate(docs.columns)}
    own = pick(docs, "doc_id", *on, "text").select("doc_id", "source", *[F.col(c).cast("string").alias(c) for c in also], size_of("text").alias("size"))
    sizes, sizes_path = written(own, "sizes")
    cells = plan(sizes, also, **options)
    remove(docs.sparkSession, sizes_path)
    few = cells.count() <= BROADCAST_ROWS
    added = ("size", "source_size", "target", "copies")
    taken = cells.toDF(*[f"__{c}" for c in cells.columns])
    same = reduce(lambda a, b: a & b, [col[c].cast("string").eqNullSafe(F.col(f"__{c}")) for c in on])
    out = place.join(F.broadcast(taken) if few else taken, same, "left")
    key = F.md5(F.coalesce(col["doc_id"].cast("string"), F.lit("")).cast("binary"))
    out = out.withColumn("__all", F.col("__copies") + ((key <= F.col("__cut")) | (key == F.col("__fill"))).cast("long"))
    values = (size_of(col["text"]), F.col("__source_size"), F.col("__target"), F.col("__all"))
    return out.select(*[c.alias(n + "0" * (n.lower() in added)) for n, c in col.items()], *[v.alias(n) for v, n in zip(values, added, strict=True)])
