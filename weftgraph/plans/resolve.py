"""Names at the ends of raw edges resolved to node ids by prioritized joins.

Distinct (file, language, name, family) are resolved, not edges: each rule is an equi-join that proposes (target,
confidence) at a priority, the best proposal wins, and what none resolves becomes an external node.
"""

from __future__ import annotations

import builtins
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .lenses import language

CODE_ENDINGS = r"\.(py|ts|tsx|js|jsx|mjs|cjs)$"
SYMBOLS, FILES = ["class", "function", "method", "interface", "type"], ["file", "module", "shell_script"]


def family(kind: Column) -> Column:
    """How the name at an edge's end is looked for."""
    return F.when(kind.isin("CALLS", "INHERITS", "IMPLEMENTS"), "symbol").when(kind == "IMPORTS", "import").when(kind == "RUNS_SCRIPT", "script").when(kind.isin("READS", "WRITES"), "data")


def external_id(lang: Column, name: Column, how: Column) -> Column:
    """ext:<language>:<ecosystem>:<name> of a name that nothing resolves."""
    root = F.substring_index(F.substring_index(name, ".", 1), "/", 1)
    own = [n for n in dir(builtins) if n.islower() and not n.startswith("_")]
    python = F.when(root.isin(own), "builtin").when(root.isin(sorted(sys.stdlib_module_names)), "stdlib").otherwise("unresolved")
    script = F.when((how == "import") | name.contains("/") | name.isin("next", "react", "axios"), "npm").otherwise("unresolved")
    eco = F.when(lang == "py", python).when(lang.isin("ts", "js"), script).otherwise("unresolved")
    safe = F.coalesce(F.nullif(F.trim(F.replace(name, F.lit("::"), F.lit("."))), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("ext:"), F.when(lang == "", "unk").otherwise(lang), F.lit(":"), eco, F.lit(":"), safe)


def _dotted(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, CODE_ENDINGS, ""), F.lit("/"), F.lit("."))


def _suffixes(dotted: Column) -> Column:
    """(place, suffix) of a dotted name, the whole name first."""
    parts = F.split(dotted, r"\.")
    return F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def _relative(file: Column, name: Column) -> Column:
    """A name with leading dots as a dotted path from the root, beside its file; other names as they are."""
    dots = F.length(F.regexp_extract(name, r"^(\.+)", 1))
    folder = F.when(file.contains("/"), F.split(F.regexp_replace(file, "/[^/]*$", ""), "/")).otherwise(F.array().cast("array<string>"))
    slashed = F.size(F.filter(F.split(name, "/"), lambda p: p == ".."))
    up = F.when(name.contains("/"), slashed).otherwise(dots - 1)
    base = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - up, F.lit(0)))
    rest = F.when(name.contains("/"), F.filter(F.split(F.regexp_replace(name, CODE_ENDINGS, ""), "/"), lambda p: ~p.isin("", ".", ".."))).otherwise(F.filter(F.split(name, r"\."), lambda p: p != ""))
    return F.when(dots > 0, F.array_join(F.concat(base, rest), ".")).otherwise(F.replace(F.regexp_replace(name, CODE_ENDINGS, ""), F.lit("/"), F.lit(".")))


def _modules(nodes: DataFrame) -> DataFrame:
    """(module, file_id, module_file): every suffix of every file's dotted path, the least file of equals; a package is
    found by its folder."""
    files = nodes.where(F.col("kind").isin(FILES))
    path = F.regexp_replace(_dotted(F.col("file")), r"\.(__init__|index)$", "")
    s = files.select("id", "file", _suffixes(path).alias("place", "module"))
    best = s.groupBy("module").agg(F.min(F.struct("place", "id", "file")).alias("b"))
    return best.select("module", F.col("b.id").alias("file_id"), F.col("b.file").alias("module_file"))


def _imports(names: DataFrame, modules: DataFrame, symbols: DataFrame, column: str = "name") -> DataFrame:
    """``names`` (with src_file and a dotted name in ``column``) joined to what it imports: (.., target, rank). Whole
    names come before their suffixes, modules before symbols in modules."""
    at = names.withColumn("__full", _relative(F.col("src_file"), F.col(column)))
    s = at.select("*", _suffixes(F.col("__full")).alias("__place", "module"))
    whole = s.join(modules, "module").select(*names.columns, F.col("file_id").alias("target"), (F.col("__place") * 2).alias("rank"))
    head, tail = F.regexp_extract("__part", r"^(.*)\.[^.]+$", 1), F.substring_index("__part", ".", -1)
    t = s.withColumnRenamed("module", "__part").where(F.col("__part").contains(".")).withColumn("module", head).withColumn("qualname", tail)
    inner = t.join(modules, "module").join(symbols.select(F.col("file").alias("module_file"), "qualname", F.col("id").alias("symbol_id")), ["module_file", "qualname"])
    return whole.unionByName(inner.select(*names.columns, F.col("symbol_id").alias("target"), (F.col("__place") * 2 + 1).alias("rank")))


def resolve(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with resolved ends, nodes for external ends) of ``nodes`` (id, kind, file) and raw ``edges`` (src, dst,
    type, confidence, ...). Ends that are node ids already stay, unless a call, import or base crosses languages; RAISES
    ends and scripts that are not found stay names."""
    qual = F.regexp_extract("id", "::(.*)$", 1)
    n = nodes.select("id", "kind", "file", qual.alias("qualname"), F.substring_index(qual, ".", -1).alias("bare"), language(F.col("id")).alias("lang"))
    symbols, variables = n.where(F.col("kind").isin(SYMBOLS)), n.where("kind = 'variable'")
    src = n.select(F.col("id").alias("src"), F.col("file").alias("src_file"))
    e = edges.join(src, "src", "left").withColumn("src_file", F.coalesce("src_file", F.lit(""))).withColumn("lang", language(F.col("src"))).withColumn("how", family(F.col("type")))
    known = n.select(F.col("id").alias("dst"), F.col("lang").alias("dst_lang"))
    e = e.join(known, "dst", "left")
    crosses = (F.col("dst_lang") != F.col("lang")) & F.col("how").isin("symbol", "import")
    names = e.where(F.col("how").isNotNull() & F.col("dst_lang").isNull()).select("src_file", "lang", F.col("dst").alias("name"), "how").distinct()
    modules = _modules(nodes)
    key = ["src_file", "lang", "name", "how"]
    found = []

    def offer(df: DataFrame, target: str, priority: Column | int, confidence: Column | str = "resolved") -> None:
        p = priority if isinstance(priority, Column) else F.lit(priority)
        c = confidence if isinstance(confidence, Column) else F.lit(confidence)
        found.append(df.select(*key, F.col(target).alias("target"), p.cast("int").alias("priority"), c.alias("sure")))

    # symbols: in the file by whole name, then by its last part, through the file's imports, then anywhere in the language
    s = names.where("how = 'symbol'").withColumn("bare", F.substring_index("name", ".", -1)).withColumn("first", F.substring_index("name", ".", 1))
    here = symbols.select(F.col("file").alias("src_file"), "qualname", F.col("id").alias("hit"))
    offer(s.withColumn("qualname", F.col("name")).join(here, ["src_file", "qualname"]), "hit", 0)
    offer(s.withColumn("qualname", F.col("bare")).join(here, ["src_file", "qualname"]), "hit", 1)
    imported = e.where("type = 'IMPORTS'").select("src_file", F.col("dst").alias("path"), F.regexp_extract("dst", r"([^./]+)$", 1).alias("alias")).distinct()
    by_bare = s.join(imported.withColumnRenamed("alias", "bare"), ["src_file", "bare"]).withColumn("path", F.col("path"))
    by_first = s.where("name <> bare").join(imported.withColumnRenamed("alias", "first"), ["src_file", "first"]).withColumn("path", F.concat("path", F.lit("."), F.expr("substring(name, length(first) + 2)")))
    through = _imports(by_bare.select(*key, "path").unionByName(by_first.select(*key, "path")), modules, symbols, "path")
    offer(through.where(language(F.col("target")) == F.col("lang")), "target", F.lit(10) + F.col("rank"))
    anywhere = symbols.groupBy("lang", "bare").agg(F.min("id").alias("hit"), F.count("*").alias("n"))
    offer(s.join(anywhere, ["lang", "bare"]), "hit", 1000, F.when(F.col("n") > 1, "ambiguous").otherwise("resolved"))
    # imports
    i = _imports(names.where("how = 'import'"), modules, symbols)
    offer(i.where((F.col("lang") == "") | (language(F.col("target")) == F.col("lang"))), "target", F.col("rank"))
    # scripts: the path itself, then paths with the same file name of which one ends with the other
    c = names.where("how = 'script'").withColumn("path", F.regexp_replace("name", "^[./]+", "")).withColumn("base", F.substring_index("path", "/", -1))
    files = n.where(F.col("kind").isin(FILES)).select("file", F.col("id").alias("hit"), F.substring_index("file", "/", -1).alias("base"))
    ends = F.col("file").endswith(F.col("path")) | F.col("path").endswith(F.col("file"))
    offer(c.join(files, "base").where(ends), "hit", F.when(F.col("file") == F.col("path"), 0).otherwise(1))
    # data: tables, exact configuration keys, attributes and variables of the file, short keys, variables of the language
    d = names.where("how = 'data'").withColumn("low", F.lower("name")).withColumn("bare", F.substring_index("name", ".", -1))
    tables = n.where(F.lower("kind").isin("sql_table", "table")).groupBy(F.lower("qualname").alias("low")).agg(F.min("id").alias("hit"))
    offer(d.join(tables, "low"), "hit", 0)
    configs = n.where(F.col("kind").isin("json_config", "yaml_config"))
    offer(d.join(configs.groupBy(F.lower("qualname").alias("low")).agg(F.min("id").alias("hit")), "low"), "hit", 1)
    own = variables.select(F.col("file").alias("src_file"), F.col("qualname").alias("name"), F.col("id").alias("hit"))
    offer(d.join(own, ["src_file", "name"]), "hit", 2)
    offer(d.join(variables.select(F.col("file").alias("src_file"), "bare", F.col("id").alias("hit")), ["src_file", "bare"]), "hit", 3)
    short = configs.groupBy(F.lower(F.regexp_extract("qualname", r"([^.\[\]]+)(?:\[\d+\])?$", 1)).alias("low")).agg(F.min("id").alias("hit"), F.count("*").alias("n"))
    offer(d.join(short, "low"), "hit", 4, F.when(F.col("n") > 1, "ambiguous").otherwise("resolved"))
    offer(d.join(variables.groupBy("lang", "bare").agg(F.min("id").alias("hit"), F.count("*").alias("n")), ["lang", "bare"]), "hit", 5, F.when(F.col("n") > 1, "ambiguous").otherwise("resolved"))

    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.groupBy(*key).agg(F.min(F.struct("priority", "target", "sure")).alias("best")).select(*[F.col(k).alias("dst" if k == "name" else k) for k in key], "best.target", "best.sure")
    r = e.join(best, ["src_file", "lang", "dst", "how"], "left")
    outside = external_id(F.col("lang"), F.when(crosses, F.substring_index("dst", "/", -1)).otherwise(F.col("dst")), F.col("how"))
    stays = F.col("dst_lang").isNotNull() & ~F.coalesce(crosses, F.lit(False)) | F.col("how").isNull()
    lost = ~stays & F.col("target").isNull()
    dst = F.when(stays, F.col("dst")).when(F.col("target").isNotNull(), F.col("target")).when(F.col("how") == "script", F.col("dst")).otherwise(outside)
    sure = F.when(stays, F.col("confidence")).when(F.col("target").isNotNull(), F.when(F.col("confidence").isin("ambiguous", "dynamic"), F.col("confidence")).otherwise(F.col("sure"))).when(F.col("how") == "script", "unresolved").otherwise("external")
    out = r.withColumns({"__dst": dst, "__sure": sure, "__lost": lost & (F.col("how") != "script")})
    rest = [c for c in edges.columns if c not in ("dst", "confidence")]
    done = out.select(*rest, F.col("__dst").alias("dst"), F.col("__sure").alias("confidence"))
    new = out.where("__lost").select(F.col("__dst").alias("id")).distinct().select("id", F.lit("external_symbol").alias("kind"), F.lit(None).cast("string").alias("file"))
    return done.select(*edges.columns), new


def update_files(nodes: DataFrame, edges: DataFrame, raw_edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, raw edges, edges) after the files in ``changed`` (file) were parsed anew, gone files having no new rows.

    Raw edges of other files are resolved again where they name something that a changed file had or has, so that calls
    into it survive it; all their other edges stay as they were resolved (``edges``; without it all are resolved again).
    """
    gone = changed.select("file").distinct()
    kept = nodes.join(gone, "file", "left_anti").where("not id like 'ext:%'")
    all_nodes = kept.unionByName(new_nodes)
    others = raw_edges.join(gone, "file", "left_anti")
    raw = others.unionByName(new_raw)
    if edges is None:
        done, outside = (written(df, "resolved")[0] for df in resolve(all_nodes.select("id", "kind", "file"), raw))
        return all_nodes.unionByName(outside, allowMissingColumns=True), raw, done
    last = lambda c: F.element_at(F.split(F.lower(c), r"::|[./]"), -1)
    touched = nodes.join(gone, "file", "left_semi").select("id", "file").unionByName(new_nodes.select("id", "file"))
    stem = F.regexp_extract(F.lower("file"), r"([^/.]+)(?:\.[^/]*)?$", 1)
    names = touched.select(last(F.col("id")).alias("__name")).union(touched.select(stem)).union(touched.select(F.regexp_extract(F.lower("file"), "([^/]+)/[^/]*$", 1))).distinct()
    # an edge of a line goes with the others that its source has there, as a resolved edge no longer says its raw name
    key = ["src", "type", "file", "start_line"]
    plain = F.when(F.col("dst").rlike(r"\.[a-z]{1,4}$") & F.col("dst").contains("/"), F.regexp_extract(F.lower("dst"), r"([^/.]+)(?:\.[^/]*)?$", 1)).otherwise(last(F.col("dst")))
    parts = others.withColumn("__name", F.explode(F.array_distinct(F.concat(F.array(plain), F.split(F.lower("dst"), r"::|[./]")))))
    again_keys = parts.join(names, "__name", "left_semi").select(*key).distinct()
    again = others.join(again_keys, key, "left_semi").unionByName(new_raw)
    done, outside = (written(df, "resolved")[0] for df in resolve(all_nodes.select("id", "kind", "file"), again))
    stays = edges.join(gone, "file", "left_anti").join(again_keys, key, "left_anti")
    done = stays.unionByName(done.select(*stays.columns))
    still = nodes.where("id like 'ext:%'").join(stays.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    new_outside = outside.join(still.select("id"), "id", "left_anti")
    return all_nodes.unionByName(still, allowMissingColumns=True).unionByName(new_outside, allowMissingColumns=True), raw, done
