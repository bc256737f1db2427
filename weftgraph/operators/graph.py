"""Queries over a property graph: lookup, search, neighbours, degrees, traces."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..plans.lenses import NOISE_KINDS, language
from ..sources.tables import dealt

# Names of builtins and of plain data fields, which are no abstractions of a code base.
BUILTIN_NAMES = """str int float bool bytes bytearray complex object True False None MagicMock Mock AsyncMock
NonCallableMock PropertyMock patch sentinel Path Any Optional List Dict Set Tuple Union Callable Type ClassVar Final
Literal Protocol Counter defaultdict OrderedDict datetime Enum os sys re json io abc typing String Int Double Float Bool
Data URL Date UUID void char long short unsigned signed error nil string int32 int64 uint32 uint64 byte rune len range
print isinstance issubclass enumerate zip sum max min getattr setattr hasattr delattr open type list dict set tuple iter
next repr super any all abs round sorted filter map format callable id""".split()
FIELD_NAMES = """start end name id type properties value key data items title description version dependencies
devdependencies peerdependencies optionaldependencies bundleddependencies""".split()


def last_part(node_id: Column) -> Column:
    return F.substring_index(node_id, "::", -1)


def is_noise(node_id: Column, kind: Column, sig: Column, file: Column) -> Column:
    """External, unlocated and configuration nodes, and those named like builtins or data fields."""
    name = last_part(node_id)
    return (
        node_id.startswith("ext:") | kind.isin(NOISE_KINDS) | F.coalesce(file == "", F.lit(True)) | F.coalesce(F.trim(sig).isin(BUILTIN_NAMES), F.lit(False))
        | name.isin(BUILTIN_NAMES) | F.lower(name).isin(FIELD_NAMES)
    )


def label(node_id: Column, sig: Column) -> Column:
    return F.when(F.coalesce(sig, F.lit("")) != "", sig).otherwise(last_part(node_id))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with in_degree, out_degree and degree over the multiset of edges."""
    end = lambda c, n_in: F.struct(F.col(c).alias("id"), F.lit(n_in).alias("n_in"), F.lit(1 - n_in).alias("n_out"))
    ends = edges.select(F.inline(F.array(end("src", 0), end("dst", 1))))  # edges are made once for both of their ends
    n = ends.groupBy("id").agg(F.sum("n_in").alias("in_degree"), F.sum("n_out").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = nodes.join(n, "id", "left").withColumns({c: zero(c) for c in ("in_degree", "out_degree")})
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = 10, hub_percentile: float | None = None) -> DataFrame:
    """The most connected nodes that are abstractions; above a nearest-rank percentile of all degrees, hubs are left out."""
    d = degrees(nodes, edges)
    if hub_percentile is not None:
        # the degree at a rank: running counts over distinct degrees, not over nodes
        by = d.groupBy("degree").count()
        upto = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
        ranked = by.withColumn("upto", F.sum("count").over(upto)).withColumn("rank", F.greatest(F.floor(F.sum("count").over(Window.partitionBy()) * F.lit(hub_percentile) / 100), F.lit(1)))
        limit = ranked.where("upto >= rank").agg(F.min("degree").alias("limit"))
        d = d.join(F.broadcast(limit), F.col("degree") <= F.col("limit")).drop("limit")
    kept = d.where(~F.col("kind").isin("file", "repository") & ~is_noise(F.col("id"), F.col("kind"), F.col("sig"), F.col("file")))
    cols = ["id", label(F.col("id"), F.col("sig")).alias("label"), "kind", "degree", "in_degree", "out_degree", "file", "start_line", "complexity"]
    return kept.select(*cols).orderBy(F.desc("degree"), "id").limit(top)


def _first_with_total(parts: list[DataFrame], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each table in an order, with its number of rows as ``total``: counted by partial sums and
    cut by partial tops, so that no task holds all rows of a hub."""
    out = None
    for part in parts:
        one = part.orderBy(*order).limit(most).join(F.broadcast(part.agg(F.count("*").alias("total"))))
        out = one if out is None else out.unionByName(one)
    return out


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, direction: str = "both", most: int = 30) -> DataFrame:
    """(direction, peer, type, confidence, peer_kind, peer_file, total, truncated): the edges around a node, at most
    ``most`` each way, by peer and type."""
    parts = []
    if direction in ("both", "incoming", "upstream"):
        parts.append(edges.where(F.col("dst") == node_id).select(F.lit("incoming").alias("direction"), F.col("src").alias("peer"), "type", "confidence"))
    if direction in ("both", "outgoing", "downstream"):
        parts.append(edges.where(F.col("src") == node_id).select(F.lit("outgoing").alias("direction"), F.col("dst").alias("peer"), "type", "confidence"))
    e = _first_with_total(parts, ["peer", "type", "confidence"], most)
    peers = nodes.select(F.col("id").alias("peer"), F.col("kind").alias("peer_kind"), F.col("file").alias("peer_file"))
    return peers.join(F.broadcast(e), "peer", "right").select("direction", "peer", "type", "confidence", "peer_kind", "peer_file", "total", (F.col("total") > most).alias("truncated"))


def one_hop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per target of edges: callers, readers, distinct files of its sources, distinct tables among them."""
    src = nodes.select(F.col("id").alias("src"), F.col("file").alias("src_file"), F.col("kind").alias("src_kind"))
    return dealt(edges, "src").join(src, "src", "left").groupBy(F.col("dst").alias("id")).agg(
        F.count_if(F.col("type") == "CALLS").alias("callers"), F.count_if(F.col("type") == "READS").alias("readers"),
        F.countDistinct("src_file").alias("files"), F.countDistinct(F.when(F.lower("src_kind").isin("sql_table", "table"), F.col("src"))).alias("tables"),
    )


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose source or target is no node, as (end, id, n)."""
    ids = nodes.select(F.col("id").alias("__id"))
    missing = lambda end: edges.join(ids, F.col(end) == F.col("__id"), "left_anti").groupBy(F.lit(end).alias("end"), F.col(end).alias("id")).agg(F.count("*").alias("n"))
    return missing("src").unionByName(missing("dst"))


def lookup(nodes: DataFrame, query: str) -> DataFrame:
    """The best node for a name: exact ids first, then names, then parts of names, external nodes last; at equal rank
    the shorter id, then the lesser."""
    q, low = query.strip(), query.strip().lower()
    nid, lid = F.col("id"), F.lower("id")
    qual = last_part(nid)
    bare = F.lower(F.substring_index(qual, ".", -1))
    coarse = F.col("kind").isin("file", "module", "repository")
    outside = nid.startswith("ext:") | F.col("kind").isin("external", "external_symbol", "unresolved") | F.col("file").isNull()
    tier = (
        F.when(outside, F.when((nid == q) | (bare == low), 8).otherwise(9))
        .when(nid == q, 0)
        .when(nid.endswith(f"::{q}") | nid.endswith(f".{q}"), 1)
        .when(lid.endswith(f"::{low}") | lid.endswith(f".{low}"), 2)
        .when(bare == low, 3)
        .when(F.lower(qual) == low, 4)
        .when(bare.contains(low), F.when(coarse, 7).otherwise(5))
        .otherwise(F.when(coarse, 7).otherwise(6))
    )
    hits = nodes.where((lid.contains(low) | F.coalesce(F.lower("sig").contains(low), F.lit(False))) & F.lit(q != ""))
    return hits.withColumn("tier", tier).orderBy("tier", F.length("id"), "id").limit(1)


def search(nodes: DataFrame, text: str, most: int = 10) -> DataFrame:
    """Nodes with a text in id or signature, by id."""
    low = text.lower()
    return nodes.where(F.lower("id").contains(low) | F.coalesce(F.lower("sig").contains(low), F.lit(False))).orderBy("id").limit(most)


def data_trace(nodes: DataFrame, edges: DataFrame, entity: str, most: int = 30) -> DataFrame:
    """Distinct writers and readers of an entity: (role, src, file, sig, total), ``most`` of each role by id."""
    low = entity.strip().lower()
    dst = F.lower("dst")
    token = rf"(?:^|[.:/]){re.escape(low)}(?:$|[.:])"
    hit = (dst == low) | dst.endswith(f":{low}") | dst.endswith(f".{low}") | dst.rlike(token)
    role = F.when(F.col("type") == "WRITES", "writer").when(F.col("type") == "READS", "reader")
    e = edges.where(hit & role.isNotNull()).select(role.alias("role"), "src").distinct()
    e = _first_with_total([e.where(F.col("role") == name) for name in ("writer", "reader")], ["src"], most)
    return nodes.select(F.col("id").alias("src"), "file", "sig").join(F.broadcast(e), "src", "right").select("role", "src", "file", "sig", "total")


def surprising(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Edges that cross files, folders, file types or communities, or are unsure, by an additive score; the best of each
    pair of nodes."""
    folder = lambda f: F.when(f.contains("/"), F.regexp_replace(f, "/[^/]*$", "")).otherwise(".")
    suffix = lambda f: F.lower(F.regexp_extract(f, r"[^/.][^/]*?(\.[^./]*)$", 1))
    unsure = F.when(F.col("confidence").isin("ambiguous", "dynamic", "unresolved"), 3).when(F.col("confidence") == "external", 1).otherwise(0)
    a, b = F.col("src_file"), F.col("dst_file")
    cross = F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))
    score = F.when(cross, 1 + F.when(folder(a) != folder(b), 2).otherwise(0) + F.when((suffix(a) != "") & (suffix(b) != "") & (suffix(a) != suffix(b)), 3).otherwise(0)).otherwise(0)
    most, own = 6, nodes.select("id", "file")
    if communities is not None:
        own, most = own.join(communities.select("id", "community"), "id", "left"), most + 3
        score = score + F.when(F.col("src_community") != F.col("dst_community"), 3).otherwise(0)
    # the unsurest edges first; those below come only if the most that they can score reaches the last of the best so far
    found: dict[tuple, Row] = {}
    for least in (3, 1, 0):
        ranked = sorted(found.values(), key=lambda r: (-r.score, r.src, r.dst))[:top]
        if len(ranked) == top and least + most < ranked[-1].score:
            break
        e = edges.where((F.col("type") != "DEFINED_IN") & (unsure == least)).select("src", "dst", "type", "confidence")
        for end in ("src", "dst"):
            e = dealt(e, end).join(own.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in own.columns[1:]]), end)
        e = e.select("src", "dst", "type", (score + least).cast("int").alias("score"), "confidence").where("score > 0")
        # a pair's edges lie together by their target
        pairs = e.groupBy("src", "dst").agg(F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("less"), "type", "confidence")).alias("best"))
        for r in pairs.select("src", "dst", "best.type", "score", "best.confidence").orderBy(F.desc("score"), "src", "dst").limit(top).collect():
            found.setdefault((r.src, r.dst), r)
    ranked = sorted(found.values(), key=lambda r: (-r.score, r.src, r.dst))[:top]
    best = nodes.sparkSession.createDataFrame(ranked, "src string, dst string, type string, score int, confidence string")
    for end in ("src", "dst"):  # labels for ``top`` rows only
        best = nodes.select(F.col("id").alias(end), label(F.col("id"), F.col("sig")).alias(f"{end}_label")).join(F.broadcast(best), end)
    return best.select("src", "dst", "src_label", "dst_label", "type", "score", "confidence").orderBy(F.desc("score"), "src", "dst")


def language_breakdown(nodes: DataFrame) -> DataFrame:
    """(lang, n_nodes, n_files) by language; where nodes have no column lang, it is that of their ids."""
    own = nodes if "lang" in nodes.columns else nodes.withColumn("lang", language(F.col("id")))
    return own.groupBy("lang").agg(F.count("*").alias("n_nodes"), F.countDistinct("file").alias("n_files")).orderBy(F.desc("n_nodes"), "lang")


def kind_counts(rows: DataFrame, column: str = "kind") -> DataFrame:
    """(value, n) of a column, the commonest first: kinds of nodes, types of files or edges, categories of failures."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def exportable(node_id: Column, kind: Column) -> Column:
    """Whether a node gets a note of its own: no variables, tokens or keys, no indexed or dotted configuration keys."""
    name = last_part(node_id)
    return ~(F.lower(kind).isin("variable", "token", "key") | node_id.rlike(r"[\[\]]") | (kind.isin("json_config", "yaml_config") & name.contains(".")))


def questions(gods: DataFrame, cycles: DataFrame | None, surprises: DataFrame, n_communities: int, most: int = 10) -> list[str]:
    """Questions that a graph suggests, from its first results."""
    out = [f"What depends on `{r.label}`, and what breaks when it changes? ({r.degree} links)" for r in gods.orderBy(F.desc("degree"), "id").limit(3).collect()]
    if cycles is not None and (first := cycles.orderBy("length", "cycle").limit(1).collect()):
        out.append(f"Can the import cycle {' -> '.join(map(str, first[0].cycle))} be broken?")
    out += [f"Why does `{r.src_label}` reach `{r.dst_label}` by {r.type}?" for r in surprises.orderBy(F.desc("score"), "src", "dst").limit(3).collect()]
    if n_communities > 1:
        out.append(f"Do the {n_communities} communities match the folders?")
    return out[:most]
