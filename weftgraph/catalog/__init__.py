"""The registered queries of the library, apart from those of the subpackage llm."""

from __future__ import annotations

from . import context, graph, mining, reports, traversal  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
