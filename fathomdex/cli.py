"""python -m fathomdex index|watch|search|read|list|status [--folder PATH]... [--data-dir PATH] ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from . import VERSION
from .config import Settings, parse_folders


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathomdex", description=__doc__)
    p.add_argument("command", nargs="?", default="status", choices=("index", "watch", "search", "read", "list", "status", "call"))
    p.add_argument("words", nargs="*", help="the query, a document's id, or a tool's name and its arguments as JSON")
    p.add_argument("--folder", action="append", default=[])
    p.add_argument("--folders", default="", help="several, separated by semicolons, commas or newlines")
    p.add_argument("--data-dir")
    p.add_argument("--silent", "-s", action="store_true", help="the same as index")
    p.add_argument("--force", action="store_true")
    p.add_argument("--prune", action="store_true")
    p.add_argument("--results", type=int)
    p.add_argument("--in", dest="within", help="a folder to which the search or list is limited")
    p.add_argument("--version", "-v", action="version", version=f"fathomdex {VERSION}")
    return p


def main(argv: list[str] | None = None) -> int:
    """Exit code 0; 1 after errors; 2 if no folder is named to index or watch."""
    args = parser().parse_args(argv)
    if args.silent:
        args.command = "index"
    settings = Settings.from_env()
    folders = [*args.folder, *parse_folders(args.folders)]
    settings = replace(settings, folders=tuple(folders) or settings.folders, data_dir=args.data_dir or settings.data_dir)
    if args.command in ("index", "watch") and not settings.folders:
        print("fathomdex: name a folder", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .plans.engine import Engine, NotFound

    engine = Engine(SparkSession.builder.appName("fathomdex").getOrCreate(), settings)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str, indent=2))
    try:
        if args.command == "index":
            summary = engine.index(force=args.force, prune=args.prune)
            show(summary)
            return int(summary["errores"] > 0)
        if args.command == "watch":
            if stream := engine.start():
                stream.awaitTermination()
        elif args.command == "search":
            show([r.asDict() for r in engine.search(" ".join(args.words), args.results, args.within).collect()])
        elif args.command == "read":
            show(engine.document(args.words[0]))
        elif args.command == "call":
            from .plans.tools import Tools

            result = Tools(engine).call(args.words[0], json.loads(args.words[1]) if args.words[1:] else {})
            show(result["structuredContent"])
            return int("isError" in result)
        elif args.command == "list":
            show([r.asDict() for r in engine.documents(args.within).collect()])
        else:
            show(engine.status())
    except (ValueError, NotFound) as e:
        print(f"fathomdex: {e}", file=sys.stderr)
        return 1
    return 0
