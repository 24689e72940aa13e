"""Command line: parse, cc, bfs, prd."""

from __future__ import annotations

import argparse
import sys
import time

from .operators import bfs, connected_components, page_rank_delta
from .session import session
from .sources import convert, read_graph


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein", description="Graph analytics on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("parse", help="convert adjacency text")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("input")
    for name in ("cc", "bfs", "prd"):
        c = sub.add_parser(name)
        c.add_argument("input", help="a graph written by parse")
        c.add_argument("--save", help="write the result as Parquet")
        if name == "bfs":
            c.add_argument("-s", "--source", type=int, required=True)
        if name == "prd":
            c.add_argument("-i", "--iterations", type=int, required=True)
            c.add_argument("--mode", default="reference", choices=("reference", "published"))
        if name == "cc":
            c.add_argument("--symmetrize", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session("skein-cli")
    if args.command == "parse":
        t = time.perf_counter()
        g = convert(spark, args.input, args.output)
        print(f"{g.num_nodes} nodes, {g.num_rels} relationships in {time.perf_counter() - t:.3f} s")
        return 0
    g = read_graph(spark, args.input)
    t = time.perf_counter()
    if args.command == "cc":
        out = connected_components(g, args.symmetrize)
    elif args.command == "bfs":
        out = bfs(g, args.source)
    else:
        out = page_rank_delta(g, args.iterations, args.mode)
    if args.save:
        out.write.mode("overwrite").parquet(args.save)
    print(f"{out.count()} rows in {time.perf_counter() - t:.3f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
