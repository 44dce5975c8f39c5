"""Read a snapshot store from the shell: python -m graphloom STORE COMMAND ..., one JSON object a line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.browse import clamped, observed_types, summaries
from graphloom.operators.graph import Graph, Hop, search_everywhere
from graphloom.plans.planner import Find
from graphloom.sources.store import SnapshotStore


def _filter(text: str) -> tuple[str, str, object]:
    field, op, value = text.split(" ", 2)
    try:
        return field, op, json.loads(value)
    except ValueError:
        return field, op, value


def _hop(text: str) -> Hop:
    """relation, or <relation for the reverse direction, with :limit after it."""
    name, _, limit = text.partition(":")
    return Hop(name.lstrip("<"), "reverse" if name.startswith("<") else "forward", limit=int(limit) if limit else 10)


def answer(graph: Graph, args: argparse.Namespace) -> DataFrame:
    order = (args.order, "desc" if args.desc else "asc") if args.order else None
    limit, where = clamped(args.limit), [_filter(w) for w in args.where]
    if args.command == "schema":
        return observed_types(graph)
    if args.command == "get":
        return summaries(graph.get_doc(args.terms[0]))
    if args.command == "find-nodes":
        return summaries(graph.find_nodes(args.terms[0], where, order, limit))
    if args.command == "find-edges":
        named = dict(t.split("=", 1) for t in args.terms)
        return summaries(graph.find_edges(Find(**named, where=where, order_by=order, limit=limit)))
    if args.command == "traverse":
        return summaries(graph.traverse([args.terms[0]], [_hop(t) for t in args.terms[1:]]))
    return summaries(search_everywhere(graph, args.terms[0], clamped(args.limit, 20, 50)))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    cli = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    cli.add_argument("store")
    cli.add_argument("command", choices=("schema", "get", "find-nodes", "find-edges", "traverse", "search"))
    cli.add_argument("terms", nargs="*", help="a document id, a type, field=value pairs, a start and hops, or a text")
    cli.add_argument("--scope", default="")
    cli.add_argument("--where", action="append", default=[], metavar="'FIELD OP VALUE'")
    cli.add_argument("--order")
    cli.add_argument("--desc", action="store_true")
    cli.add_argument("--limit", type=int)
    args = cli.parse_args(argv)
    if args.command != "schema" and not args.terms:
        cli.error(f"{args.command} needs a term")
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    rows = answer(SnapshotStore(spark, args.store).graph(args.scope), args)
    for row in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        print(row["j"])


if __name__ == "__main__":
    main()
