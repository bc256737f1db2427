"""A source tree as a table of files: scan, ignore rules, classification, status and hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lenses import _glob

# Folders and names that are never part of a code base's own source.
IGNORED_FOLDERS = """.git .venv venv __pycache__ .pytest_cache .mypy_cache .ruff_cache node_modules dist build .idea .vscode
.obsidian output scratch postman coverage htmlcov .next vendor .tox site-packages""".split()
IGNORED_NAMES = "*.pyc *.pyo *.pyd .DS_Store Thumbs.db *.egg-info poetry.lock package-lock.json yarn.lock pnpm-lock.yaml *.min.js".split()
# File types by suffix.
SUFFIXES = {
    "python": "py pyi pyw", "sql": "sql", "shell": "sh bash", "json": "json", "yaml": "yaml yml", "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs ejs",
    "go": "go", "rust": "rs", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp cu cuh", "csharp": "cs", "ruby": "rb rake", "php": "php", "kotlin": "kt kts",
    "scala": "scala", "swift": "swift", "lua": "lua luau", "zig": "zig", "powershell": "ps1 psm1 psd1", "elixir": "ex exs", "erlang": "erl hrl",
    "fortran": "f f90 f95 f03 f08", "julia": "jl", "objc": "m mm", "verilog": "v sv svh", "dart": "dart", "terraform": "tf tfvars hcl", "solidity": "sol",
    "groovy": "groovy gradle", "pascal": "pas pp dpr lpr", "vue": "vue", "svelte": "svelte", "astro": "astro", "markdown": "md mdx",
}
INTERPRETERS = {"python": "python", "node": "javascript", "ruby": "ruby", "bash": "shell", "sh": "shell", "zsh": "shell"}
# Names of files that hold secrets, and endings of templates that don't.
SENSITIVE = [
    r"(?i)(^|[\\/])\.(env|envrc)(\.|$)", r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$", r"(?i)(^|[^A-Za-z0-9])(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)^secring(\.(gpg|pgp))?$", r"(?i)(\.netrc|\.pgpass|\.htpasswd|\.npmrc|\.pypirc|\.git-credentials|\.boto)$",
]
TEMPLATES = [".example", ".sample", ".template", ".dist"]
BINARY_BYTES, LARGEST_KB = 8192, 2048


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def ignored(path: Column, rules: list[str] | None = None) -> Column:
    """Whether a path lies in an ignored folder or falls under a name pattern; ``rules`` are lines of an ignore file."""
    parts = F.split(path, "/")
    folders = F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(IGNORED_FOLDERS))
    own = [r.strip() for r in rules or [] if r.strip() and not r.strip().startswith("#")]

    def hit(rule: str) -> Column:
        one = _glob(rule)
        return F.exists(parts, lambda p: p.rlike(one)) | path.rlike(one) | path.rlike(_glob(rule + "/*"))

    return folders | _any([hit(rule.rstrip("/")) for rule in [*IGNORED_NAMES, *own]])


def file_type(path: Column, first_line: Column) -> Column:
    """A file's type by suffix, or else by the interpreter its first line names, or other."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = {s: kind for kind, many in SUFFIXES.items() for s in many.split()}
    by_suffix = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), suffix)
    runs = F.when(first_line.startswith("#!"), F.regexp_extract(first_line, r"(python|node|ruby|bash|zsh|sh)[0-9.]*(?:\s|$)", 1))
    by_line = F.element_at(F.create_map(*[F.lit(x) for kv in INTERPRETERS.items() for x in kv]), runs)
    return F.coalesce(by_suffix, by_line, F.lit("other"))


def sensitive(name: Column) -> Column:
    return _any([name.rlike(p) for p in SENSITIVE]) & ~_any([F.lower(name).endswith(t) for t in TEMPLATES])


def described(raw: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """(path, kind, size, is_binary, status, sha256, blob_sha, text) of rows (path, content); ignored paths are left out.

    status: sensitive, binary, oversize, unsupported or pending, the first that holds; only pending files have text.
    """
    name, body = F.element_at(F.split("path", "/"), -1), F.col("content")
    size, head = F.octet_length(body), F.substring(body, 1, BINARY_BYTES)
    df = raw.where(~ignored(F.col("path"), rules)).withColumn("size", size.cast("long")).withColumn("is_binary", F.position(F.lit(b"\x00"), head) > 0)
    first_line = F.substring_index(F.decode(F.substring(body, 1, 128), "ISO-8859-1"), "\n", 1)
    df = df.withColumn("kind", file_type(F.col("path"), first_line))
    status = F.when(sensitive(name), "sensitive").when(F.col("is_binary"), "binary").when(F.col("size") > LARGEST_KB * 1024, "oversize").when(F.col("kind") == "other", "unsupported").otherwise("pending")
    blob = F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.col("size").cast("string")), "UTF-8"), F.lit(b"\x00"), body))
    df = df.withColumn("status", status).withColumn("sha256", F.sha2(body, 256)).withColumn("blob_sha", blob)
    text = F.when(F.col("status") == "pending", F.try_validate_utf8(body.cast("string")))
    return df.select("path", "kind", "size", "is_binary", "status", "sha256", "blob_sha", text.alias("text"))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def scan(spark: SparkSession, root: str, rules: list[str] | None = None, batch_bytes: int = 16 << 20) -> DataFrame:
    """The files below a folder, by paths relative to it.

    The driver lists the top folder, tasks the folders in it; names are filtered before anything is read. Spark's own file
    sources pass over names that begin with a dot or an underscore, which a source tree has many of, so tasks read the
    files themselves.
    """
    files, top = opened(root.rstrip("/"))
    first = [(i.path[len(top) :].lstrip("/"), i.type == fs.FileType.Directory) for i in files.get_file_info(fs.FileSelector(top))]

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = opened(root.rstrip("/"))
        for batch in batches:
            for name, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                inside = own.get_file_info(fs.FileSelector(f"{at}/{name}", recursive=True)) if folder else []
                names = [i.path[len(at) :].lstrip("/") for i in inside if i.type == fs.FileType.File] if folder else [name]
                yield pa.record_batch([pa.array(names, pa.string())], ["path"])

    listed = spark.createDataFrame(sorted(first), "path string, folder boolean").repartition("path")
    paths = listed.mapInArrow(below, "path string").where(~ignored(F.col("path"), rules)).repartition("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = opened(root.rstrip("/"))
        for batch in batches:
            names, bodies, held = [], [], 0
            for name in batch.column(0).to_pylist():
                with own.open_input_stream(f"{at}/{name}") as f:
                    bodies.append(f.read())
                names.append(name)
                held += len(bodies[-1])
                if held >= batch_bytes:
                    yield pa.record_batch([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], ["path", "content"])
                    names, bodies, held = [], [], 0
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], ["path", "content"])

    return described(paths.mapInArrow(read, "path string, content binary"), rules)


def git_log(lines: DataFrame) -> DataFrame:
    """(hash, ts, files) of rows (n, line) of a log: a line ``COMMIT:hash|epoch`` and then a file per line. Commits
    without files are left out."""
    from pyspark.sql import Window

    head = F.regexp_extract("line", r"^COMMIT:([^|]+)\|(\d+)", 1)
    df = lines.withColumn("head", F.when(head != "", head)).withColumn("at", F.when(head != "", F.regexp_extract("line", r"\|(\d+)", 1).cast("double")))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # a log is read from one process
    df = df.withColumn("hash", F.last("head", True).over(w)).withColumn("ts", F.last("at", True).over(w))
    rows = df.where("head is null and trim(line) <> '' and hash is not null")
    return rows.groupBy("hash", "ts").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.trim("line").alias("f")))), lambda x: x["f"]).alias("files"))
