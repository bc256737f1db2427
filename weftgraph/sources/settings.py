"""Small files that the driver reads: settings, and tasks with gold references."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

GOLD = ("symbols", "files", "related_symbols", "dependencies", "tests", "constraints", "excluded")
TASKS = "id string, task string, repository string, category string, " + ", ".join(f"{g} array<string>" for g in GOLD)
DEFAULTS = {"max_file_kb": 2048, "budget": 1500, "max_depth": 5, "threshold": 0.2, "ignore": [], "exclude": []}


def load_settings(path: str) -> dict:
    """The defaults with what a JSON file says over them; unknown names raise."""
    file = Path(path)
    given = json.loads(file.read_text(encoding="utf-8")) if file.exists() else {}
    if unknown := sorted(set(given) - set(DEFAULTS)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return DEFAULTS | given


def save_settings(settings: dict, path: str) -> None:
    Path(path).write_text(json.dumps(settings, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def _problems(rows: list[tuple]) -> list[str]:
    out, seen = [], set()
    for place, (name, text, _, _, *gold) in enumerate(rows):
        if not name:
            out.append(f"task {place} has no id")
        elif name in seen:
            out.append(f"id {name} occurs twice")
        seen.add(name)
        if not text:
            out.append(f"task {name} has no text")
        if not (gold[GOLD.index("symbols")] or gold[GOLD.index("files")] or gold[GOLD.index("excluded")]):
            out.append(f"task {name} has no gold symbols, files or exclusions")
    return out


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The tasks of a YAML or JSON file: a list, or an object with ``tasks``. ValueError names all that is wrong with them."""
    import yaml

    text = Path(path).read_text(encoding="utf-8")
    data = json.loads(text) if path.endswith(".json") else yaml.safe_load(text)
    if not isinstance(data, (list, dict)):
        raise ValueError(f"{path} is no list of tasks")
    rows = []
    for item in data if isinstance(data, list) else data.get("tasks", []):
        gold = item.get("gold") or {}
        rows.append((str(item.get("id") or ""), str(item.get("task") or "").strip(), str(item.get("repository", "")), str(item.get("category", "General")), *[list(gold.get(g) or []) for g in GOLD]))
    if wrong := _problems(rows):
        raise ValueError("; ".join(wrong))
    return spark.createDataFrame(rows, TASKS)
