"""Command line: ``python -m codeweave COMMAND``."""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading

from pyspark.sql import DataFrame, SparkSession

from codeweave.graph import CodeGraph
from codeweave.plans.build import build_index, open_graph
from codeweave.plans.cypher import cypher
from codeweave.sources.catalog import Catalog
from codeweave.streaming.live import Poller, live, spooled

TOOLS = (
    "search_symbols", "get_symbol", "symbols_in_file", "callers", "callees", "uses", "used_by", "inheritors", "inherited_from", "search_docs",
    "list_files", "imports", "dependents", "repo_map", "search_semantic", "module_overview", "hot_symbols", "architecture_violations",
    "subgraph", "path", "read_symbol_body", "batch_read_symbol_bodies", "overview",
)


def session() -> SparkSession:
    spark = SparkSession.builder.appName("codeweave").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def audit(per_turn: int | None = None) -> dict:
    """Approximate tokens (characters // 4) that describing each tool costs, most first; and the break-even number of look-ups a turn."""
    costs = []
    for name in TOOLS:
        method = getattr(CodeGraph, name)
        code = method.__code__
        costs.append((name, len(json.dumps({"name": name, "about": method.__doc__ or "", "parameters": code.co_varnames[1 : code.co_argcount]})) // 4))
    costs.sort(key=lambda c: (-c[1], c[0]))
    total = sum(c for _, c in costs) if per_turn is None else per_turn
    return {"tools": dict(costs), "total": total, "break_even": max(1, round(total / 5000, 2))}


def show(df: DataFrame) -> None:
    for line in df.toJSON().toLocalIterator():
        print(line)


def serve(graph: CodeGraph) -> None:
    """JSON lines in, JSON lines out: {"tool": name, "args": {...}}."""
    for line in sys.stdin:
        try:
            asked = json.loads(line)
            if asked["tool"] not in TOOLS:
                raise ValueError(f"no tool {asked['tool']}")
            rows = [json.loads(r) for r in getattr(graph, asked["tool"])(**asked.get("args", {})).toJSON().collect()]
            print(json.dumps({"rows": rows}), flush=True)
        except Exception as e:  # a bad request must not end the loop
            print(json.dumps({"error": str(e)}), flush=True)


def watch_tree(spark: SparkSession, root: str, home: str, seconds: float | None = None) -> None:
    """Indexes the tree, then again after every burst of changes; a JSON line each time."""
    print(json.dumps({"reason": "start", **build_index(spark, root, home)}), flush=True)
    folder = os.path.join(Catalog(spark, home).folder(os.path.realpath(root)), "watch")
    poller, stop = Poller(root, f"{folder}/events"), threading.Event()
    threading.Thread(target=poller.run, args=(stop,), daemon=True).start()
    query = live(spark, root, home, spooled(spark, f"{folder}/events"), f"{folder}/checkpoint", lambda why, stats: print(json.dumps({"reason": why, **stats}), flush=True))
    try:
        query.awaitTermination(seconds)
    except KeyboardInterrupt:
        pass
    finally:
        stop.set()
        query.stop()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codeweave")
    parser.add_argument("--home", default=os.path.expanduser("~/.codeweave"))
    parser.add_argument("--root", default=".")
    sub = parser.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("--full", action="store_true")
    index.add_argument("--vectors", choices=("learned", "hashed"), help="how texts become vectors; as before, if not given")
    sub.add_parser("stats")
    sub.add_parser("query").add_argument("cypher")
    sub.add_parser("sql").add_argument("sql")
    repo_map = sub.add_parser("map")
    repo_map.add_argument("--dir")
    repo_map.add_argument("--budget", type=int, default=2000)
    sub.add_parser("audit")
    sub.add_parser("serve")
    sub.add_parser("projects")
    watching = sub.add_parser("watch")
    watching.add_argument("--seconds", type=float, help="how long; until interrupted, if not given")
    export = sub.add_parser("export")
    export.add_argument("out")
    args = parser.parse_args(argv)
    if args.command == "audit":
        print(json.dumps(audit()))
        return 0
    spark = session()
    if args.command == "index":
        print(json.dumps(build_index(spark, args.root, args.home, args.full, learned=args.vectors and args.vectors == "learned")))
        return 0
    if args.command == "watch":
        watch_tree(spark, args.root, args.home, args.seconds)
        return 0
    catalog = Catalog(spark, args.home)
    if args.command == "projects":
        for p in catalog.projects():
            print(json.dumps(p))
        return 0
    graph = open_graph(spark, args.root, args.home)
    if graph is None:
        print("no graph here; run index first", file=sys.stderr)
        return 1
    if args.command == "stats":
        print(json.dumps({r["label"]: r["n"] for r in graph.stats().collect()}))
    elif args.command == "query":
        show(cypher(graph.g, args.cypher))
    elif args.command == "sql":
        catalog.views(os.path.realpath(args.root))
        show(spark.sql(args.sql))
    elif args.command == "map":
        for row in graph.repo_map(args.dir, args.budget).select("row").toLocalIterator():
            print(row["row"])
    elif args.command == "serve":
        serve(graph)
    elif args.command == "export":
        for name in ("files", "symbols", "calls", "uses", "inherits", "contains", "imports"):
            getattr(graph.g, name).write.mode("overwrite").json(f"{args.out}/{name}")
    return 0
