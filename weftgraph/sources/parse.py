"""Configuration text to rows: flattened keys."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def flatten(value, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(dotted key, value) of every member of a document, containers included: a.b for members, a[0] for elements."""
    items = value.items() if isinstance(value, dict) else ((f"[{i}]", v) for i, v in enumerate(value)) if isinstance(value, list) else ()
    for k, v in items:
        key = f"{prefix}{k}" if isinstance(value, list) or not prefix else f"{prefix}.{k}"
        yield key, v
        yield from flatten(v, key)


def flat_json(df: DataFrame, column: str) -> DataFrame:
    """The first column of ``df`` with (key, value) for each member of the JSON text in ``column``; text that is no JSON
    gives no rows."""
    first = df.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(own, k, v if isinstance(v, str) else json.dumps(v, sort_keys=True)) for k, v in flatten(json.loads(text or "null"))]
                except ValueError:
                    continue
            yield pa.record_batch([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], [first.name, "key", "value"])

    return df.select(first.name, column).mapInArrow(run, f"`{first.name}` {first.dataType.simpleString()}, key string, value string")
