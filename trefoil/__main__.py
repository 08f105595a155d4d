"""Command line: ``python -m trefoil orbits node|edge 4|5 IN OUT`` and ``python -m trefoil totals IN OUT``."""

from __future__ import annotations

import argparse

from trefoil.operators.orbits import OrbitCounts, graphlet_totals
from trefoil.session import get_spark
from trefoil.sources import files, sinks


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trefoil")
    sub = parser.add_subparsers(dest="command", required=True)
    orbits = sub.add_parser("orbits")
    orbits.add_argument("kind", choices=["node", "edge"])
    orbits.add_argument("size", type=int, choices=[4, 5])
    totals = sub.add_parser("totals")
    for p in (orbits, totals):
        p.add_argument("source")
        p.add_argument("target")
        p.add_argument("--strict", action="store_true")
    args = parser.parse_args(argv)
    edges, nodes = files.read_graph(get_spark(), args.source, args.strict)
    counts = OrbitCounts(edges, nodes, getattr(args, "size", 5))
    if args.command == "totals":
        sinks.write_totals(graphlet_totals(counts.node_orbits()), args.target)
    elif args.kind == "node":
        sinks.write_node_orbits(counts.node_orbits(), args.target, args.size)
    else:
        sinks.write_edge_orbits(counts.edge_orbits(), args.target, args.size)


if __name__ == "__main__":
    main()
