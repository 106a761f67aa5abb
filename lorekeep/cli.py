"""Command line: query, sync-index, rebuild-index, optimize-index, validate-wiki, show-config, serve."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import config as configuration
from .engine import Engine
from .errors import EngineError
from .plans.contracts import ContextQuery, SyncReport


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lorekeep")
    top.add_argument("--wiki-root")
    top.add_argument("--config-dir")
    commands = top.add_subparsers(dest="command", required=True)
    q = commands.add_parser("query")
    q.add_argument("query", nargs="?", default="")
    q.add_argument("--limit", type=int, default=10)
    q.add_argument("--document-limit", type=int, default=5)
    q.add_argument("--scope", default="")
    for name, into in (("--tag", "tags"), ("--note-type", "note_types"), ("--keyword", "keywords"), ("--metadata", "metadata")):
        q.add_argument(name, action="append", default=[], dest=into)
    q.add_argument("--keyword-all", action="store_true")
    q.add_argument("--modified-after-ns", type=int)
    q.add_argument("--modified-before-ns", type=int)
    q.add_argument("--modified-desc", action="store_true")
    q.add_argument("--include-relations", action="store_true")
    for name in ("sync-index", "rebuild-index", "optimize-index", "show-config", "serve"):
        commands.add_parser(name)
    v = commands.add_parser("validate-wiki")
    v.add_argument("--path")
    v.add_argument("--full", action="store_true")
    v.add_argument("--fix-format", action="store_true")
    return top


def metadata_filters(pairs: list[str]) -> dict[str, object]:
    """KEY=VALUE with a JSON value, or else a string."""
    out: dict[str, object] = {}
    for pair in pairs:
        key, equals, value = pair.partition("=")
        if not equals:
            raise SystemExit(f"error: --metadata expects KEY=VALUE, got `{pair}`")
        try:
            out[key] = json.loads(value)
        except ValueError:
            out[key] = value
    return out


def snippet(content: str) -> str:
    one = " ".join(content.split())
    return f" :: {one[:80]}{'…' * (len(one) > 80)}" if one else ""


def report_line(r: SyncReport) -> str:
    first = f"indexed={r.indexed} removed={r.removed} moved={r.moved} unchanged={r.unchanged} vectors_pending={r.vectors_pending} degraded={len(r.degraded)}"
    return "\n".join([first, *(f"  degraded: {d}" for d in r.degraded)])


def run(arguments: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(arguments)
    settings = configuration.load(args.config_dir)
    root = Path(args.wiki_root).expanduser() if args.wiki_root else settings.wiki_root
    if args.command == "show-config":
        origin = "cli" if args.wiki_root else "config" if settings.config_file else "default"
        print(f"config_file = {settings.config_file or '(none — created default)'}")
        print(f"wiki_root = {root} ({origin})")
        print(f"embedding_model = {settings.embedding_model or 'null (semantic leg off)'}")
        print(f"projection_dir = {settings.projection_dir}")
        return 0
    if args.command == "validate-wiki":
        if args.path is None and not args.full and args.fix_format:
            raise SystemExit("error: --fix-format requires --path or --full")
        if args.path is not None and args.full:
            raise SystemExit("error: --path and --full are mutually exclusive")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lorekeep").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine.open(spark, root, settings.projection_for(root), settings.embedding_model, rule_file=settings.rule_file)
    if args.command == "query":
        result = engine.query(
            ContextQuery(
                args.query, args.scope, args.document_limit, args.limit, args.keywords, "all" if args.keyword_all else "any", args.tags, args.note_types,
                metadata_filters(args.metadata), args.modified_after_ns, args.modified_before_ns, "modified_desc" if args.modified_desc else "relevance", args.include_relations,
            )
        )
        for h in result.documents:
            print(f"DOC {h.path} {h.score:.4f}{snippet(h.content)}")
        for h in result.fragments:
            print(f"{h.path} [{h.section}]{f' {h.score:.4f}' if h.score > 0 else ''}{snippet(h.content)}")
        print(f"{len(result.documents)} documents; {len(result.fragments)} fragments; degraded={len(result.degraded)}")
    elif args.command in ("sync-index", "rebuild-index"):
        print(report_line(engine.sync() if args.command == "sync-index" else engine.rebuild()))
    elif args.command == "optimize-index":
        engine.maintain_indexes()
        print("indexes repaired and updated")
    elif args.command == "serve":
        from .tools import serve

        serve(engine)
    else:
        result = engine.validate(args.path, args.fix_format)
        for path in result.formatted_paths:
            print(f"formatted {path}")
        for i in result.issues:
            print(f"{i.severity.upper()} {i.kind}:{i.path} {i}")
        if not result.issues:
            print("no issues")
    return 0


def main() -> None:
    try:
        sys.exit(run())
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        sys.exit(1)


if __name__ == "__main__":
    main()
