"""Queries of a source tree or a stored graph from the command line: python -m weftgraph.cli --tree PATH god-nodes"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from .engine import GraphEngine

#: name -> (needs an argument, function of engine and argument)
COMMANDS = {
    "save": (True, lambda e, a: e.save(a)), "lookup": (True, lambda e, a: e.lookup(a)), "search": (True, lambda e, a: e.search(a)), "neighbors": (True, lambda e, a: e.neighbors(a)),
    "blast-radius": (True, lambda e, a: e.blast_radius(a)), "impact": (True, lambda e, a: e.impact(a)), "data-trace": (True, lambda e, a: e.data_trace(a)), "co-changes": (True, lambda e, a: e.co_changes(a)),
    "resolve": (True, lambda e, a: e.resolve(a)), "explain": (True, lambda e, a: e.explain(a)), "context": (True, lambda e, a: e.compile(a).text), "plan": (True, lambda e, a: e.compile(a).plan),
    "pack": (True, lambda e, a: e.context_pack(a.split(","))), "lens": (True, lambda e, a: e.lens(a)[1]), "graphml": (True, lambda e, a: e.graphml(a)), "god-nodes": (False, lambda e, a: e.god_nodes()),
    "surprising": (False, lambda e, a: e.surprising()), "cycles": (False, lambda e, a: e.cycles()), "communities": (False, lambda e, a: e.communities()), "components": (False, lambda e, a: e.components()),
    "routes": (False, lambda e, a: e.routes()), "questions": (False, lambda e, a: "\n".join(e.questions())), "report": (False, lambda e, a: e.report()), "kinds": (False, lambda e, a: e.kinds()),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs one command and returns what it printed."""
    parser = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    given = parser.add_mutually_exclusive_group(required=True)
    given.add_argument("--tree", help="a source tree to scan")
    given.add_argument("--graph", help="a stored graph")
    parser.add_argument("--format", choices=("text", "json"), default="text")
    parser.add_argument("--most", type=int, default=50, help="rows printed at most")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("argument", nargs="?", default="")
    args = parser.parse_args(argv)
    needs, run = COMMANDS[args.command]
    if needs and not args.argument:
        parser.error(f"{args.command} needs an argument")
    spark = spark or SparkSession.builder.appName("weftgraph").getOrCreate()
    engine = GraphEngine.from_tree(spark, args.tree, with_log=args.command == "co-changes") if args.tree else GraphEngine.load(spark, args.graph)
    found = run(engine, args.argument)
    if isinstance(found, DataFrame):
        rows = [row.asDict(recursive=True) for row in found.limit(args.most).collect()]
        found = "\n".join(json.dumps(r, default=str) if args.format == "json" else "\t".join("" if v is None else str(v) for v in r.values()) for r in rows)
    out = found or ""
    print(out)
    return out


if __name__ == "__main__":
    main()
