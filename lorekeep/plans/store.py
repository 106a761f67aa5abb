"""Derived data of one wiki: Parquet tables in numbered generations.

A generation is written whole beside the current one and becomes current by one
atomic replacement of a small pointer file; a crash leaves the old one in use.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import shutil
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.chunk import UNIT_SCHEMA

VERSION = 1
SCHEMAS = {
    "documents": "path string, content_hash string, mtime_ns long, size long, frontmatter string",
    "units": f"{UNIT_SCHEMA}, embedding_input_hash string, vector array<float>",
    "edges": "from_path string, to_path string, relation_type string, section_source string, status string",
    "postings": "unit_kind string, term string, chunk_id string, tf int, dl int, path string",
    "stats": "unit_kind string, n long, avgdl double",
}
PARTITIONED = {"units": ["unit_kind"], "postings": ["unit_kind"]}


#: Tables that hold what was read from files; the others follow from them.
READ = {"documents", "units", "edges"}


class Store:
    """``analyser`` is what describes the index's terms; an index of other terms is built anew."""

    def __init__(self, spark: SparkSession, folder: Path | str, model: str | None = None, dimensions: int | None = None, analyser: dict | None = None):
        self.spark, self.folder, self.model, self.dimensions, self.analyser = spark, Path(folder), model, dimensions, analyser
        self.folder.mkdir(parents=True, exist_ok=True)

    def signature(self, name: str) -> str:
        """What a table's rows depend on beside the files."""
        width = self.dimensions if name == "units" else None
        terms = self.analyser if name in ("postings", "stats") else None
        return hashlib.sha256(json.dumps([VERSION, SCHEMAS[name], width, terms], sort_keys=True).encode()).hexdigest()

    def manifest(self) -> dict | None:
        """The current generation."""
        try:
            return json.loads((self.folder / "CURRENT").read_text())
        except FileNotFoundError:
            return None

    def usable(self, name: str) -> bool:
        """Whether the current generation has this table, written under the same schema, version, width and terms."""
        current = self.manifest()
        return current is not None and current.get("signatures", {}).get(name) == self.signature(name) and (self.folder / f"generation-{current['generation']}" / name).is_dir()

    def unusable(self) -> set[str]:
        return {name for name in SCHEMAS if not self.usable(name)}

    def path(self, generation: int, table: str) -> str:
        return f"file://{self.folder.resolve()}/generation-{generation}/{table}"

    def table(self, name: str) -> DataFrame:
        current = self.manifest()
        if not self.usable(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(current["generation"], name))

    def write(self, tables: dict[str, DataFrame], fingerprint: str | None = None, model: str | None = None) -> None:
        """Writes all tables as the next generation and makes it current; ``model`` made the vectors."""
        current = self.manifest()
        generation = (current or {"generation": 0})["generation"] + 1
        shutil.rmtree(self.folder / f"generation-{generation}", ignore_errors=True)
        for name, schema in SCHEMAS.items():
            columns = [c.split()[0] for c in schema.split(", ")]
            writer = tables[name].select(*columns).write
            if name in PARTITIONED:
                writer = writer.partitionBy(*PARTITIONED[name])
            writer.parquet(self.path(generation, name))
        temp = self.folder / "CURRENT.tmp"
        temp.write_text(json.dumps({"generation": generation, "signatures": {name: self.signature(name) for name in SCHEMAS}, "fingerprint": fingerprint, "model": model}))
        os.replace(temp, self.folder / "CURRENT")
        for old in self.folder.glob("generation-*"):  # readers of the previous one may still be at work
            if int(old.name.split("-")[1]) < generation - (1 if current else 0):
                shutil.rmtree(old, ignore_errors=True)

    def reset(self) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(self.folder / "CURRENT")
        for old in self.folder.glob("generation-*"):
            shutil.rmtree(old, ignore_errors=True)

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        """Excludes other processes that write here."""
        with open(self.folder / "lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            try:
                yield
            finally:
                fcntl.flock(f, fcntl.LOCK_UN)

    def scratch(self) -> Path:
        path = self.folder / "scratch"
        shutil.rmtree(path, ignore_errors=True)
        return path
