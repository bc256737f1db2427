"""What a parser collects."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field


@dataclass
class Found:
    """Nodes and edges of one file. Edge ends that are no ids yet are names for the resolver."""

    path: str
    lang: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.path = re.sub(r"^[./]+", "", self.path)

    def id(self, name: str) -> str:
        return f"{self.lang}:{self.path}::{name}"

    def node(self, name: str, kind: str, sig: str, start: int, end: int, body: str = "", *, story: str = "", complexity: int = 1, calls: int = 0, params=(), returns=None, reads=(), writes=(), raises=()) -> str:
        own = self.id(name)
        self.nodes.append(
            {"id": own, "kind": kind, "sig": sig, "file": self.path, "start_line": start, "end_line": max(start, end), "complexity": complexity, "calls": calls, "params": list(params), "returns": returns,
             "reads": sorted(reads), "writes": sorted(writes), "raises": sorted(raises), "story": story, "content_hash": hashlib.sha256(body.encode()).hexdigest()}
        )
        return own

    def edge(self, src: str, dst: str, kind: str, line: int, how: str, confidence: str = "unresolved", end: int | None = None) -> None:
        self.edges.append({"src": src, "dst": dst, "type": kind, "confidence": confidence, "file": self.path, "start_line": line, "end_line": end or line, "how_derived": how})


def named_tables(sql: str) -> tuple[set[str], set[str]]:
    """Tables that a statement reads and writes, by the words before their names; names of WITH queries are no tables."""
    plain = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", " ", sql, flags=re.DOTALL)
    own = {m.lower() for m in re.findall(r"(?:\bwith|,)\s+(?:recursive\s+)?([A-Za-z_]\w*)\s+as\s*\(", plain, re.IGNORECASE)}
    name = r"[\"`\[]?([A-Za-z_][\w.]*)[\"`\]]?"
    writes = set(re.findall(rf"\b(?:insert\s+(?:overwrite\s+)?into|update|delete\s+from|merge\s+into|truncate\s+table|replace\s+into)\s+{name}", plain, re.IGNORECASE))
    rest = re.sub(r"\bdelete\s+from\b", "delete", plain, flags=re.IGNORECASE)
    reads = set(re.findall(rf"\b(?:from|join|using)\s+{name}", rest, re.IGNORECASE))
    for group in re.findall(r"\bfrom\s+([A-Za-z_][\w.]*(?:\s+\w+)?(?:\s*,\s*[A-Za-z_][\w.]*(?:\s+\w+)?)+)", rest, re.IGNORECASE):
        reads |= {part.split()[0] for part in re.split(r"\s*,\s*", group.strip())}
    words = {"select", "where", "set", "values", "lateral", "unnest"}
    keep = lambda s: {x for x in s if x.lower() not in own | words}
    return keep(reads), keep(writes)
