"""What git knows of a source tree: its state, its log, and which files haven't changed. Git runs on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMEOUT, COMMITS = 5, 2000


def _git(root: str, *args: str, timeout: int = TIMEOUT) -> str | None:
    """The output of a git command; null where there is no git, no repository, or no answer in time."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout if done.returncode == 0 else None


def provenance(spark: SparkSession, root: str) -> DataFrame:
    """One row (is_git, commit, branch, dirty)."""
    commit = (_git(root, "rev-parse", "HEAD") or "").strip()
    branch = (_git(root, "rev-parse", "--abbrev-ref", "HEAD") or "").strip() or None
    row = (True, commit, branch, bool((_git(root, "status", "--porcelain") or "").strip())) if commit else (False, None, None, False)
    return spark.createDataFrame([row], "is_git boolean, commit string, branch string, dirty boolean")


def log(spark: SparkSession, root: str, most: int = COMMITS) -> DataFrame:
    """(hash, ts, files) of the last commits that aren't merges, commits without files left out; no rows for a shallow clone
    or where git gives no answer. ``most`` bounds what the driver reads."""
    schema = "hash string, ts double, files array<string>"
    shallow = (_git(root, "rev-parse", "--is-shallow-repository") or "true").strip() != "false"
    text = None if shallow else _git(root, "log", "--no-merges", "--name-only", "--format=COMMIT:%H|%at", f"-n{most}", timeout=60)
    rows = []
    for block in (text or "").split("COMMIT:")[1:]:
        head, *files = block.strip().split("\n")
        commit, _, ts = head.partition("|")
        if names := [f.strip() for f in files if f.strip()]:
            rows.append((commit, float(ts), names))
    return spark.createDataFrame(rows, schema)


def unchanged(files: DataFrame, known: DataFrame) -> DataFrame:
    """``files`` (path, blob_sha) with ``same``: whether the path had this blob when it was last read (path, blob_sha)."""
    was = known.select("path", F.col("blob_sha").alias("__was"))
    return files.join(was, "path", "left").withColumn("same", F.coalesce(F.col("blob_sha") == F.col("__was"), F.lit(False))).drop("__was")
