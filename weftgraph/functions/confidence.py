"""Confidence of edges and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Priors of edge types, then of confidence levels.
TYPE_PRIOR = {
    "CALLS": 0.95, "INHERITS": 0.95, "IMPLEMENTS": 0.95, "DEFINED_IN": 0.95, "WRITES": 0.85, "READS": 0.85, "EMBEDS_SQL": 0.85,
    "IMPORTS": 0.80, "RUNS_SCRIPT": 0.80, "INVOKES": 0.75, "TESTS_CODE": 0.90, "CO_CHANGED_WITH": 0.70,
}
LEVEL_PRIOR = {"resolved": 0.95, "ambiguous": 0.50, "dynamic": 0.50, "external": 0.40, "unresolved": 0.30}
UNKNOWN_PRIOR = 0.80
# The order in which edge types are followed, and the types that may join two languages.
FOLLOW = ["CALLS", "INHERITS", "IMPLEMENTS", "INVOKES", "DEFINED_IN", "TESTS_CODE", "WRITES", "READS", "EMBEDS_SQL", "IMPORTS", "RUNS_SCRIPT", "CO_CHANGED_WITH"]
ACROSS = ["INVOKES", "CO_CHANGED_WITH", "EMBEDS_SQL", "READS", "WRITES"]
CAP = 0.99


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def edge_prior(kind: Column, confidence: Column) -> Column:
    """The type's prior for resolved edges, else the lower one of the level's and the type's."""
    by_type = lookup(TYPE_PRIOR, kind, UNKNOWN_PRIOR)
    by_level = lookup(LEVEL_PRIOR, F.lower(confidence), UNKNOWN_PRIOR)
    return F.when(F.lower(confidence) == "resolved", by_type).otherwise(F.round(F.least(by_level, by_type), 4))


def path_confidence(product: Column, hops: Column) -> Column:
    """min(0.99, product of priors * exp(-0.25 * (hops - 1))), 6 digits."""
    return F.round(F.least(F.lit(CAP), product * F.exp(-0.25 * (hops - 1))), 6)


def noisy_or(values: Column) -> Column:
    """1 - prod(1 - p) of an array, at most 0.99, 6 digits. Sorted first, so that the order of rows doesn't matter."""
    unseen = F.aggregate(F.array_sort(values), F.lit(1.0), lambda acc, p: acc * F.greatest(F.lit(0.0), 1.0 - p))
    return F.round(F.least(F.lit(CAP), 1.0 - unseen), 6)


def noisy_or_of_counts(counts: Column) -> Column:
    """The same of an array of (p, n): values with how often each occurs. Values are few where confidences are rounded, so
    a node of any degree has a short array."""
    unseen = F.aggregate(F.array_sort(counts), F.lit(1.0), lambda acc, x: acc * F.pow(F.greatest(F.lit(0.0), 1.0 - x["p"]), x["n"]))
    return F.round(F.least(F.lit(CAP), 1.0 - unseen), 6)


def graph_score(combined: Column, distance: Column) -> Column:
    """combined * exp(-0.70 * (distance - 1)), 6 digits."""
    return F.round(combined * F.exp(-0.70 * (F.greatest(distance, F.lit(1)) - 1)), 6)
