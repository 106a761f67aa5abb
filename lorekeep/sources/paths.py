"""The Markdown files of a wiki, and which paths are inside it."""

from __future__ import annotations

import os
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from ..errors import FileError, PathOutsideRoot

LISTING = "path string, mtime_ns long, size long"


def scope_path(root: Path | str, path: str) -> str:
    """A relative path inside the root, also after links are followed; the target need not exist."""
    root = Path(root)
    if not root.is_absolute():
        raise PathOutsideRoot(f"root is not absolute: {root}")
    pure = PurePosixPath(path)
    if pure.is_absolute() or ".." in pure.parts:
        raise PathOutsideRoot(f"path leaves the wiki: {path}")
    real, base = os.path.realpath(root / path), os.path.realpath(root)
    if real != base and not real.startswith(base.rstrip("/") + "/"):
        raise PathOutsideRoot(f"path leaves the wiki: {path}")
    return str(pure) if path else ""


def snapshot(root: Path | str, rule_file: str) -> list[str]:
    """All documents by path components.

    Folders with a leading dot and links to folders are not entered; the rule
    file at the root is no document.  Any folder that cannot be read ends the
    scan, so its documents are not taken for deleted.
    """
    found: list[str] = []
    folders = [""]
    while folders:
        folder = folders.pop()
        try:
            with os.scandir(os.path.join(root, folder)) as entries:
                for e in entries:
                    try:
                        e.name.encode("utf-8")
                    except UnicodeEncodeError:
                        continue
                    path = f"{folder}/{e.name}" if folder else e.name
                    if e.is_dir(follow_symlinks=False):
                        if not e.name.startswith("."):
                            folders.append(path)
                    elif e.is_file() and os.path.splitext(e.name)[1] == ".md" and path != rule_file:
                        found.append(path)
        except OSError as error:
            raise FileError(f"{folder or root}: {error}") from error
    return sorted(found, key=lambda p: p.split("/"))


def stat(root: Path | str, path: str) -> tuple[int, int]:
    s = os.stat(os.path.join(root, path))
    return s.st_mtime_ns, s.st_size


def listing(spark: SparkSession, root: Path | str, rule_file: str) -> DataFrame:
    """path, mtime_ns, size of all documents; a file that vanished meanwhile is not listed."""
    rows = []
    for path in snapshot(root, rule_file):
        try:
            rows.append((path, *stat(root, path)))
        except OSError:
            continue
    return spark.createDataFrame(rows, LISTING)
