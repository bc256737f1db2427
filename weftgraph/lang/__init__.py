"""Source text to nodes and edges of a property graph.

``parse_files`` runs one parser per file in Arrow batches and splits the tagged rows into nodes and edges.
"""

from .dispatch import parse_files  # noqa: F401
