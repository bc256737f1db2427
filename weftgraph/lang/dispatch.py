"""Parsers by file type, run over a table of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import others, python
from .model import Found

NODE = "struct<id:string,kind:string,sig:string,file:string,start_line:int,end_line:int,complexity:int,calls:int,params:array<string>,returns:string,reads:array<string>,writes:array<string>,raises:array<string>,story:string,content_hash:string>"
EDGE = "struct<src:string,dst:string,type:string,confidence:string,file:string,start_line:int,end_line:int,how_derived:string>"
_TEXTS = pa.list_(pa.string())
_NODE = pa.struct([(n, pa.int32() if n in ("start_line", "end_line", "complexity", "calls") else _TEXTS if n in ("params", "reads", "writes", "raises") else pa.string()) for n in "id kind sig file start_line end_line complexity calls params returns reads writes raises story content_hash".split()])
_EDGE = pa.struct([(n, pa.int32() if n.endswith("_line") else pa.string()) for n in "src dst type confidence file start_line end_line how_derived".split()])


def parse(text: str, path: str, kind: str) -> Found:
    if kind == "python":
        return python.parse(text, path)
    if kind in ("typescript", "javascript", "vue", "svelte", "astro"):
        return others.typescript(text, path)
    if kind in ("json", "yaml"):
        return others.config(text, path, kind)
    if kind in ("sql", "shell"):
        return {"sql": others.sql, "shell": others.shell}[kind](text, path)
    if kind in others.PATTERNS or kind in others.SAME_AS:
        return others.by_lines(text, path, kind)
    return Found(path, kind)


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, raw edges and errors (path, error) of files (path, kind, text); files without text are passed over, and a
    file that its parser can't read gives an error row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, kind, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if text is None:
                    continue
                try:
                    found = parse(text, path, kind)
                    rows += [(path, n, None, None) for n in found.nodes] + [(path, None, e, None) for e in found.edges]
                except (ValueError, RecursionError, LookupError) as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:300]))
                except Exception as e:  # noqa: BLE001  yaml's own errors
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), _NODE, _EDGE, pa.string()))], ["path", "node", "edge", "error"])

    union = files.select("path", "kind", "text").mapInArrow(run, f"path string, node {NODE}, edge {EDGE}, error string")
    return union.where("node is not null").select("node.*"), union.where("edge is not null").select("edge.*"), union.where("error is not null").select("path", "error")
