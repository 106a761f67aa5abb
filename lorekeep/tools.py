"""JSON tools for agents: context, rules and validation; and a line-based server for them."""

from __future__ import annotations

import json
import sys
from dataclasses import asdict
from datetime import UTC, datetime
from typing import IO

from .engine import Engine
from .errors import EngineError
from .plans.contracts import ContextQuery, Hit


class InvalidParams(ValueError):
    """Arguments that contradict each other or are not known."""


def rfc3339(ns: int) -> str:
    return datetime.fromtimestamp(ns // 1_000_000_000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _hit(hit: Hit, own: dict) -> dict:
    return {"path": hit.path, "type": hit.note_type, "filename": hit.filename} | own | {"tags": hit.tags, "rank_score": hit.score, "match_sources": hit.sources, "modified_at": rfc3339(hit.modified_at_ns), "frontmatter": hit.frontmatter}


def get_wiki_context(engine: Engine, query: str = "", scope: str = "", limit: int = 10, document_limit: int = 5, **more) -> str:
    try:
        asked = ContextQuery(query=query, scope=scope, fragment_limit=limit, document_limit=document_limit, **more)
    except TypeError as e:
        raise InvalidParams(str(e)) from e
    result = engine.query(asked)
    documents = [_hit(h, {"summary": h.content}) for h in result.documents]
    fragments = [_hit(h, {"section": h.section, "snippet": h.content}) for h in result.fragments]
    return json.dumps(
        {
            "query": query,
            "scope": scope,
            "strategy": result.strategy,
            "degraded": result.degraded,
            "documents": documents,
            "fragments": fragments,
            "relations": [asdict(r) for r in result.related],
            "truncated": len(documents) >= document_limit or len(fragments) >= limit,
        },
        ensure_ascii=False,
    )


def validate_wiki(engine: Engine, path: str | None = None, full: bool = False, fix_format: bool = False) -> str:
    if (path is None) != full:
        raise InvalidParams("either a path or full is needed, not both")
    result = engine.validate(path, fix_format).as_dict()
    for issue in result["issues"]:
        issue["path"] = str(engine.root / issue["path"])
    result["formatted_paths"] = [str(engine.root / p) for p in result["formatted_paths"]]
    return json.dumps(result, ensure_ascii=False)


def get_wiki_rules(engine: Engine, scope: str = "") -> str:
    return json.dumps(asdict(engine.rules(scope)), ensure_ascii=False)


TOOLS = {
    "get_wiki_context": (get_wiki_context, "Search the wiki and return ranked Markdown evidence."),
    "validate_wiki": (validate_wiki, "Validate Markdown, headers, links and rules."),
    "get_wiki_rules": (get_wiki_rules, "Return the rules that hold for a scope."),
}


def serve(engine: Engine, requests: IO[str] = sys.stdin, responses: IO[str] = sys.stdout) -> None:
    """JSON-RPC, a message a line: initialize, tools/list and tools/call."""
    for line in requests:
        if not line.strip():
            continue
        reply: dict = {"jsonrpc": "2.0", "id": None}
        try:
            message = json.loads(line)
            reply["id"] = message.get("id")
            method, given = message.get("method"), message.get("params") or {}
            if reply["id"] is None:
                continue  # a notification
            if method == "initialize":
                reply["result"] = {"protocolVersion": given.get("protocolVersion", "2025-06-18"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lorekeep", "version": "1"}}
            elif method == "tools/list":
                reply["result"] = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object"}} for n, (_, d) in TOOLS.items()]}
            elif method == "tools/call" and given.get("name") in TOOLS:
                text = TOOLS[given["name"]][0](engine, **(given.get("arguments") or {}))
                reply["result"] = {"content": [{"type": "text", "text": text}]}
            else:
                reply["error"] = {"code": -32601, "message": f"unknown method {method}"}
        except (InvalidParams, TypeError) as e:
            reply["error"] = {"code": -32602, "message": str(e)}
        except EngineError as e:
            reply["error"] = {"code": -32603, "message": str(e)}
        except ValueError as e:
            reply["error"] = {"code": -32700, "message": str(e)}
        responses.write(json.dumps(reply, ensure_ascii=False) + "\n")
        responses.flush()
