"""Command line: query, explain, inspect-parquet, generate-data, benchmark."""

from __future__ import annotations

import argparse
import json
import statistics
import sys
import time
from pathlib import Path

from .api import Engine, stats_json
from .datagen import sales
from .errors import EngineError
from .results import FORMATS
from .session import build_session


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakemill")
    top.add_argument("--master", default="local[*]")
    top.add_argument("--root", help="directory that local paths must stay in")
    verbs = top.add_subparsers(dest="verb", required=True)
    query = verbs.add_parser("query")
    explain = verbs.add_parser("explain")
    for verb in (query, explain):
        text = verb.add_mutually_exclusive_group(required=True)
        text.add_argument("--sql")
        text.add_argument("--file", type=Path)
    query.add_argument("--format", choices=FORMATS, default="table")
    query.add_argument("--output", type=Path)
    query.add_argument("--stats", action="store_true")
    explain.add_argument("--logical", action="store_true")
    explain.add_argument("--format", choices=("text", "json"), default="text")
    look = verbs.add_parser("inspect-parquet")
    look.add_argument("path")
    make = verbs.add_parser("generate-data")
    make.add_argument("path")
    make.add_argument("--rows", type=int, default=100_000)
    make.add_argument("--seed", type=int, default=42)
    make.add_argument("--files", type=int, default=4)
    bench = verbs.add_parser("benchmark")
    bench.add_argument("sf_dir")
    bench.add_argument("--queries", nargs="*")
    bench.add_argument("--iterations", type=int, default=3)
    return top


def main(argv: list[str] | None = None) -> int:
    args = _arguments().parse_args(argv)
    try:
        if args.verb == "inspect-parquet":
            from .sources import inspect

            print(json.dumps(inspect(args.path), indent=2, default=str))
            return 0
        spark = build_session(master=args.master)
        engine = Engine(spark, root=args.root)
        if args.verb in ("query", "explain"):
            text = args.sql or args.file.read_text()
        if args.verb == "query":
            table, stats = engine.run(text)
            made = FORMATS[args.format](table)
            data = made if isinstance(made, bytes) else made.encode()
            if args.output:
                args.output.write_bytes(data)
            else:
                sys.stdout.buffer.write(data)
            if args.stats:
                print(stats_json(stats), file=sys.stderr)
        elif args.verb == "explain":
            print(engine.explain(text, args.logical, args.format))
        elif args.verb == "generate-data":
            sales(spark, args.rows, seed=args.seed, files=args.files).write.mode("errorifexists").parquet(args.path)
        else:
            from .operators import catalogue

            found = catalogue()
            names = args.queries or [n for n in found if n.startswith("tpch_")]
            report = {}
            for name in names:
                seconds = []
                for _ in range(args.iterations + 1):
                    began = time.perf_counter()
                    found[name].run(spark, args.sf_dir).toArrow()
                    seconds.append(time.perf_counter() - began)
                warm = seconds[1:]
                report[name] = {"cold": seconds[0], "median": statistics.median(warm), "mean": statistics.mean(warm), "min": min(warm), "max": max(warm), "stddev": statistics.pstdev(warm)}
            print(json.dumps(report, indent=2))
    except EngineError as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
