"""Ranked retrieval: postings, BM25, identifier search, linear scores, rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.tables import ranked, settled

K1, B, RRF_K = 1.2, 0.75, 60
#: Parts of each trigram's list.
SALTS = 8
# Weights of the components of a candidate's score.
COMPONENTS = {"exact": 0.35, "identifier": 0.25, "overlap": 0.20, "lexical": 0.10, "path": 0.05, "kind": 0.05}


def postings(docs: DataFrame, key: str, columns: dict[str, float], terms: list[str] | None = None) -> DataFrame:
    """(token, doc, tf, n): per token and document the weighted count over ``columns`` and the plain count; of some ``terms``
    alone where these are given, so that no other posting is made."""
    own = lambda tokens: tokens if terms is None else F.filter(tokens, lambda t: t.isin(terms))
    cells = F.array(*[F.struct(own(words(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias("tokens"), F.lit(float(w)).alias("weight")) for c, w in columns.items()])
    t = docs.select(F.col(key).alias("doc"), F.explode(cells).alias("cell")).select("doc", "cell.weight", F.explode("cell.tokens").alias("token"))
    return t.groupBy("token", "doc").agg(F.sum("weight").alias("tf"), F.count("*").alias("n"))


def bm25(docs: DataFrame, key: str, columns: dict[str, float], terms: list[str], top: int | None = None) -> DataFrame:
    """(doc, score) of documents with any of the terms. A term in over half of the documents counts next to nothing."""
    cells = F.concat(*[words(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    sizes = docs.select(F.col(key).alias("doc"), F.size(cells).alias("length"))
    stats = sizes.agg(F.count("*").alias("total"), F.avg("length").alias("mean"))
    hits = postings(docs, key, columns, sorted(set(terms)))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    # as many rows as terms, and one row
    scored = hits.join(F.broadcast(df), "token").join(sizes, "doc").join(F.broadcast(stats))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    out = scored.groupBy("doc").agg(F.aggregate(F.array_sort(F.collect_list(part)), F.lit(0.0), lambda a, x: a + x).alias("score"))
    return out if top is None else out.orderBy(F.desc(F.round("score", 9)), "doc").limit(top)


def token_index(nodes: DataFrame) -> DataFrame:
    """(token, ids): tokens of ids and signatures, longer than one character, with the nodes that have them."""
    t = nodes.select("id", F.explode(F.array_distinct(F.concat(words(F.col("id")), words(F.coalesce("sig", F.lit("")))))).alias("token")).where(F.length("token") > 1)
    return t.groupBy("token").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def identifier_search(nodes: DataFrame, terms: list[str], top: int = 100) -> DataFrame:
    """Nodes by where terms stand in their ids: at the end 10, as the name 8, as a part 4, within it 2 (of longer terms);
    in the signature 3 more; functions and methods by 1.3, files by 0.6."""
    lid, sig = F.lower("id"), F.lower(F.coalesce("sig", F.lit("")))
    name = F.substring_index(F.substring_index(lid, "::", -1), ".", -1)
    total = F.lit(0.0)
    for t in sorted({x.lower() for x in terms if x}):
        at = F.when(lid.endswith(f"::{t}") | lid.endswith(f".{t}"), 10).when(name == t, 8).when(F.array_contains(F.split(lid, "[^a-z0-9]+"), t), 4)
        at = (at.when(lid.contains(t), 2) if len(t) > 3 else at).otherwise(0)
        total = total + at + F.when(sig.contains(t), 3).otherwise(0)
    factor = F.when(F.col("kind").isin("function", "method", "class"), 1.3).when(F.col("kind").isin("file", "module"), 0.6).otherwise(1.0)
    return nodes.select("id", "kind", F.round(total * factor, 4).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(top)


def lexical(rank: Column) -> Column:
    """The lexical component of a 1-based rank."""
    return F.round(1 / (1 + 0.1 * (rank - 1)), 4)


def linear(parts: dict[str, Column]) -> Column:
    """The weighted sum of a candidate's components, 6 digits."""
    total = F.lit(0.0)
    for name, weight in COMPONENTS.items():
        total = total + weight * parts.get(name, F.lit(0.0))
    return F.round(total, 6)


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists (doc, score): sum of weight / (k + rank), ranks by falling score, then doc."""
    out, made = None, []
    for i, one in enumerate(lists):
        placed, path = ranked(one.select("doc", "score"), F.desc("score"), "doc")
        made.append(path)
        part = placed.select("doc", ((weights[i] if weights else 1.0) / (k + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return settled(out.groupBy("doc").agg(F.round(F.sum("part"), 9).alias("score")), "fused", made)


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of a text in lower case."""
    low = F.lower(text)
    n = F.greatest(F.length(low) - 2, F.lit(0))
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>")))


def trigram_jaccard(a: DataFrame, b: DataFrame, least: float = 0.05) -> DataFrame:
    """(a_id, b_id, jaccard) of rows (a_id, text) and (b_id, text) above a similarity: an inverted index on trigrams
    joins the sides, and counts of shared trigrams decide. Meant for short texts."""
    grams = lambda df, key: df.select(key, F.explode(trigrams(F.col("text"))).alias("gram"))
    ga, gb = grams(a, "a_id"), grams(b, "b_id")
    # a common trigram's list is dealt to SALTS tasks: b by its id, a to all of them
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    left = ga.withColumn("salt", F.explode(salts))
    right = gb.withColumn("salt", F.pmod(F.xxhash64("b_id"), F.lit(SALTS)).cast("int"))
    shared = left.join(right, ["gram", "salt"]).groupBy("a_id", "b_id").agg(F.count("*").alias("shared"))
    size = lambda g, key, name: g.groupBy(key).agg(F.count("*").alias(name))
    j = shared.join(size(ga, "a_id", "na"), "a_id").join(size(gb, "b_id", "nb"), "b_id")
    return j.select("a_id", "b_id", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard")).where(F.col("jaccard") > least)
