"""Command line over the facade: python -m lodestone.plans.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from lodestone.plans.engine import Engine
from lodestone.runtime import session
from lodestone.settings import LodestoneError, Settings


def _positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone")
    top.add_argument("--kb", help="folder of one knowledge base")
    top.add_argument("--collections", help="name:path,name:path")
    top.add_argument("--index-root")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *, query: bool = False, filters: bool = False, **kw) -> argparse.ArgumentParser:
        p = sub.add_parser(name, **kw)
        p.add_argument("--collection")
        if query:
            p.add_argument("query")
            p.add_argument("--top-k", type=_positive)
        if filters:
            p.add_argument("--path-prefix", action="append")
            p.add_argument("--extension", action="append")
            p.add_argument("--since")
        return p

    add("search", query=True, filters=True, help="adaptive search")
    for mode in ("keyword", "semantic", "hybrid"):
        add(mode, query=True, filters=True, help=f"{mode} search")
    add("get").add_argument("path")
    listing = add("list", filters=True)
    listing.add_argument("--folder")
    listing.add_argument("--limit", type=_positive, default=100)
    add("stats")
    add("reindex").add_argument("--force", action="store_true")
    add("doctor").add_argument("--probe", default="overview")
    add("collections")
    return top


def run(argv: Sequence[str], engine: Engine | None = None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    say = lambda x: print(x, file=out)
    try:
        if engine is None:
            settings = Settings.from_env()
            changes = {"kb_path": args.kb, "collections": args.collections, "index_root": args.index_root}
            if args.kb or args.collections:
                settings = settings.but(kb_path=None, collections="")
            engine = Engine(session("lodestone-cli"), settings.but(**{k: v for k, v in changes.items() if v}))
        filters = {k: v for k in ("path_prefix", "extension", "since") if (v := getattr(args, k, None))}
        if args.command == "search":
            say(engine.search_text(args.query, args.top_k or 10, args.collection, **filters))
        elif args.command in ("keyword", "semantic", "hybrid"):
            say(engine.results_text(args.query, args.command, args.top_k, args.collection, **filters))
        elif args.command == "get":
            say(engine.get_document(args.path, args.collection))
        elif args.command == "list":
            for r in engine.list_documents(args.collection, args.folder, args.limit, **filters).collect():
                say(f"{r['collection']}\t{r['folder']}\t{r['path']}\t{r['title']}")
        elif args.command == "stats":
            say(json.dumps(engine.stats(args.collection), indent=1))
        elif args.command == "reindex":
            for name, m in engine.reindex(args.collection, args.force).items():
                say(f"{name}: {m.documents} documents, {m.chunks} chunks, {m.generation}")
        elif args.command == "collections":
            for c in engine.resolve(args.collection):
                say(f"{c.name}\t{c.root}\t{c.location}")
        else:
            ok, found = engine.doctor(args.probe)
            for d in found:
                say(f"{d.collection}: {d.state} ({d.detail}); files {d.files}; probe {d.probe_ms and round(d.probe_ms)} ms {d.probe_error or ''}".rstrip())
            return 0 if ok else 1
    except (LodestoneError, ValueError) as x:
        print(f"error: {x}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
