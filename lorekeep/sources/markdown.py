"""Reading documents: stable, bounded, parsed in one pass into units and edges."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..errors import FileError, ParseError
from ..functions import chunk, frontmatter, links
from .paths import scope_path

MOST_BYTES = 16 << 20  # fixed value: the largest document

UNIT = ", ".join(c.replace(" ", ": ", 1) for c in chunk.UNIT_SCHEMA.split(", "))
READ_SCHEMA = (
    "path string, state string, content_hash string, mtime_ns long, size long, frontmatter string, error string, warnings array<string>, "
    f"units array<struct<{UNIT}>>, edges array<struct<to_path: string, relation_type: string, section_source: string>>"
)


@dataclass
class Document:
    path: str
    content_hash: str
    mtime_ns: int
    size: int
    frontmatter: dict
    body: str
    raw: str


def read_document(root: str, path: str, previous_hash: str | None = None) -> Document | tuple[str, int, int]:
    """A document, or (hash, mtime, size) where the content is what it was; nothing is parsed then."""
    scope_path(root, path)
    full = os.path.join(root, path)
    try:
        before = os.stat(full)
        if before.st_size > MOST_BYTES:
            raise ParseError(f"{path}: document is larger than {MOST_BYTES} bytes")
        with open(full, "rb") as f:
            data = f.read(MOST_BYTES + 1)
        after = os.stat(full)
    except OSError as e:
        raise FileError(f"{path}: {e}") from e
    if len(data) > MOST_BYTES:
        raise ParseError(f"{path}: document is larger than {MOST_BYTES} bytes")
    if (before.st_mtime_ns, before.st_size) != (after.st_mtime_ns, after.st_size) or len(data) != after.st_size:
        raise ParseError(f"{path}: written to while it was read; left for the next synchronisation")
    digest = hashlib.sha256(data).hexdigest()
    if previous_hash is not None and digest == previous_hash:
        return digest, after.st_mtime_ns, after.st_size
    try:
        raw = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ParseError(f"{path}: not UTF-8: {e}") from e
    header, body = frontmatter.parse(raw)
    if frontmatter.malformed(raw, body):
        raise ParseError(f"{path}: the header is not readable as YAML")
    return Document(path, digest, after.st_mtime_ns, after.st_size, header, body, raw)


def project(root: str, path: str, previous_hash: str | None) -> dict:
    """One row of READ_SCHEMA: state read, same or failed."""
    row = dict.fromkeys(("content_hash", "mtime_ns", "size", "frontmatter", "error")) | {"path": path, "state": "read", "warnings": [], "units": [], "edges": []}
    try:
        found = read_document(root, path, previous_hash)
    except (FileError, ParseError) as e:
        return row | {"state": "failed", "error": str(e)}
    if isinstance(found, tuple):
        return row | {"state": "same"} | dict(zip(("content_hash", "mtime_ns", "size"), found))
    edges, warnings = links.edges(path, found.frontmatter, found.body)
    return row | {
        "content_hash": found.content_hash,
        "mtime_ns": found.mtime_ns,
        "size": found.size,
        "frontmatter": frontmatter.compact(found.frontmatter),
        "warnings": warnings,
        "units": chunk.units(path, found.frontmatter, found.body, found.mtime_ns),
        "edges": [dict(zip(("to_path", "relation_type", "section_source"), e)) for e in edges],
    }


def read(paths: DataFrame, root: str) -> DataFrame:
    """Reads, parses, cuts and links documents in parallel; paths: path, previous_hash.

    The wiki's folder must be visible to the executors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "state", "content_hash", "mtime_ns", "size", "frontmatter", "error", "warnings", "units", "edges"]
        for batch in batches:
            rows = [project(root, p, h if isinstance(h, str) else None) for p, h in zip(batch["path"], batch["previous_hash"])]
            out = pd.DataFrame(rows, columns=columns)
            for c in ("mtime_ns", "size"):
                out[c] = out[c].astype("Int64")
            yield out

    return paths.select("path", "previous_hash").mapInPandas(run, READ_SCHEMA)
