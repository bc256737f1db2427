"""A property graph on disk: Parquet tables partitioned for point reads, a manifest, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(nodes: DataFrame, edges: DataFrame, path: str, version: str = "1", shards: int = 64) -> None:
    """Nodes by shard of their file, edges once, by shard of their source; within a shard in their fixed order."""
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    nodes.withColumn("shard", shard(F.coalesce("file", F.lit("")))).repartition("shard").sortWithinPartitions("shard", "id").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/nodes")
    edges.withColumn("shard", shard("src")).repartition("shard").sortWithinPartitions("shard", "src", "dst", "type", "confidence").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/edges")
    manifest(nodes, edges, version).write.mode("overwrite").parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes").drop("shard"), spark.read.parquet(f"{path}/edges").drop("shard")


def load_file(spark: SparkSession, path: str, file: str, shards: int = 64) -> DataFrame:
    """The nodes of a file, from its shard alone."""
    own = spark.range(1).select(F.pmod(F.xxhash64(F.lit(file)), F.lit(shards))).first()[0]
    found = spark.read.parquet(f"{path}/nodes").where((F.col("shard") == own) & (F.col("file") == file)).drop("shard")
    if found.isEmpty():
        raise FileNotFoundError(file)
    return found


def load_node(spark: SparkSession, path: str, node_id: str) -> DataFrame:
    """The node of an id, and no other file than those whose statistics may hold it."""
    return spark.read.parquet(f"{path}/nodes").where(F.col("id") == node_id).drop("shard")


def edges_of(spark: SparkSession, path: str, src: str | None = None, dst: str | None = None, kind: str | None = None, shards: int = 64) -> DataFrame:
    """Edges by any of their ends and type, in their order; those of a source come from its shard alone."""
    found = spark.read.parquet(f"{path}/edges")
    if src is not None:
        own = spark.range(1).select(F.pmod(F.xxhash64(F.lit(src)), F.lit(shards))).first()[0]
        found = found.where((F.col("shard") == own) & (F.col("src") == src))
    for column, value in (("dst", dst), ("type", kind)):
        found = found if value is None else found.where(F.col(column) == value)
    return found.drop("shard").orderBy("src", "dst", "type", "confidence")


def save_lenses(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Each named lens as tables of its own."""
    from ..plans.lenses import LENSES, named_lens

    for name in LENSES:
        n, e = named_lens(nodes, edges, name)
        n.write.mode("overwrite").parquet(f"{path}/lenses/{name}/nodes")
        e.write.mode("overwrite").parquet(f"{path}/lenses/{name}/edges")


def load_lens(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/lenses/{name}/nodes"), spark.read.parquet(f"{path}/lenses/{name}/edges")


def save_analytics(engine, path: str, top: int = 50) -> None:
    """What readers ask for most, worked out once: degrees, surprising links, communities, one-hop counts, kinds."""
    from ..operators import graph as g

    tables = {"god_nodes": engine.god_nodes(top), "surprising": engine.surprising(top), "communities": engine.communities(), "one_hop": g.one_hop(engine.nodes, engine.edges), "kinds": engine.kinds()}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/analytics/{name}")


def _sum(df: DataFrame, *cols: str) -> DataFrame:
    """Count and an order-free digest of a multiset of rows: a sum of hashes, so that rows which repeat count each time."""
    each = F.xxhash64(*[F.col(c) if c in df.columns else F.lit(None).cast("string") for c in cols])
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(each.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def manifest(nodes: DataFrame, edges: DataFrame, version: str = "1") -> DataFrame:
    """(version, what, n, digest)."""
    parts = [_sum(nodes, "id", "kind", "content_hash").select(F.lit("nodes").alias("what"), "n", "digest"), _sum(edges, "src", "dst", "type", "confidence").select(F.lit("edges").alias("what"), "n", "digest")]
    return parts[0].unionByName(parts[1]).select(F.lit(version).alias("version"), "what", "n", "digest")


def graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Elements of a GraphML document, a line each, in order of nodes and edges; header and footer are lines of their own."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    one = lambda n, s: spark.range(1).select(F.lit(n).alias("part"), F.lit("").alias("key"), F.lit(s).alias("value"))
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit('<node id="'), esc("id"), F.lit('"><data key="kind">'), esc("kind"), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("|", "src", "dst", "type").alias("key"), F.concat(F.lit('<edge source="'), esc("src"), F.lit('" target="'), esc("dst"), F.lit('"><data key="type">'), esc("type"), F.lit("</data></edge>")).alias("value"))
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="kind" for="node" attr.name="kind" attr.type="string"/><key id="type" for="edge" attr.name="type" attr.type="string"/><graph edgedefault="directed">'
    rows = one(0, head).unionByName(n).unionByName(e).unionByName(one(3, "</graph></graphml>"))
    rows.orderBy("part", "key").select("value").write.mode("overwrite").text(path)


def notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, text): a Markdown note for each node with links to what it points at; long names end in a digest."""
    plain = F.regexp_replace("id", r"[^A-Za-z0-9._-]+", "_")
    name = F.when(F.length(plain) > 120, F.concat(F.substring(plain, 1, 100), F.lit("_"), F.substring(F.sha2("id", 256), 1, 16))).otherwise(plain)
    n = nodes.withColumn("name", name)
    out = edges.join(n.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst").select("src", "type", "dst_name").distinct()
    links = out.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), "type", F.lit(" [["), "dst_name", F.lit("]]")))).alias("links"))
    body = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("kind: "), "kind"), F.concat(F.lit("file: "), F.coalesce("file", F.lit(""))), F.lit("---"), F.concat(F.lit("# "), F.coalesce("sig", "id")), F.array_join(F.coalesce("links", F.array().cast("array<string>")), "\n"))
    return n.join(links, "id", "left").select("name", body.alias("text"))


def read_notes(df: DataFrame) -> DataFrame:
    """(name, kind, links) of notes (name, text)."""
    return df.select("name", F.regexp_extract("text", r"(?m)^kind: (.*)$", 1).alias("kind"), F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#]+)"), F.lit(1)).alias("links"))


def report(nodes: DataFrame, edges: DataFrame, top: int = 10) -> str:
    """A Markdown report from small results."""
    from ..operators import graph as g

    lines = ["# Graph report", "", "| language | nodes | files |", "| --- | --- | --- |"]
    lines += [f"| {r.lang} | {r.n_nodes} | {r.n_files} |" for r in g.language_breakdown(nodes).collect()]
    lines += ["", "## Most connected", "", *[f"- `{r.id}` ({r.kind}): {r.degree} links" for r in g.god_nodes(nodes, edges, top).collect()]]
    lines += ["", "## Surprising connections", "", *[f"- `{r.src}` -> `{r.dst}` ({r.type}, score {r.score})" for r in g.surprising(nodes, edges, top=top).collect()]]
    return "\n".join(lines) + "\n"
