"""The engine: one object for each wiki."""

from __future__ import annotations

import os
import threading
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import RULE_FILE
from .errors import FileError
from .functions import embedding
from .functions import rules as rule_functions
from .functions.text import Analyser
from .operators import governance
from .plans import retrieval, syncing, validation
from .plans.contracts import ContextQuery, SearchResult, SyncReport, ValidationResult
from .plans.store import Store
from .session import ship
from .sources import markdown, paths

DEFAULT_RULES = """---
default_type: note
required_fields: []
---

# Wiki guide

Search first, then read the documents that matter in full before drawing conclusions.
Before writing to an unfamiliar directory, ask for the rules that hold there.
After changing documents, validate them.
"""


@dataclass
class RulesResult:
    wiki_root: str
    guide_content: str
    source_modified_at_ns: int
    source_size: int
    default_type: str
    required_fields: list[str]
    tag_aliases: dict[str, list[str]]
    sections: list[dict]
    known_tags: list[str]
    scope: str


class Engine:
    """Operations run one at a time: a lock in this process, a file lock between processes."""

    def __init__(self, spark: SparkSession, wiki_root: Path | str, projection_dir: Path | str, embedder=None, rule_file: str = RULE_FILE, cjk_bigrams: bool = False, analyser: Analyser | None = None):
        try:
            Path(wiki_root).mkdir(parents=True, exist_ok=True)
        except OSError as e:
            raise FileError(f"{wiki_root}: {e}") from e
        self.spark, self.rule_file, self.embedder = spark, rule_file, embedder
        self.root = Path(os.path.realpath(wiki_root))
        self.analyse = analyser or Analyser(cjk_bigrams=cjk_bigrams)
        rules = self.root / rule_file
        if not rules.exists():
            rules.write_text(DEFAULT_RULES, encoding="utf-8")
        ship(spark)
        self.store = Store(spark, projection_dir, getattr(embedder, "model", None), getattr(embedder, "dimensions", None), self.analyse.signature())
        self._lock = threading.RLock()

    @classmethod
    def open(cls, spark: SparkSession, wiki_root: Path | str, projection_dir: Path | str, embedding_model: str | None = None, **options) -> Engine:
        return cls(spark, wiki_root, projection_dir, embedding.embedder(embedding_model, projection_dir), **options)

    @property
    def wiki_root(self) -> Path:
        return self.root

    def sync(self) -> SyncReport:
        with self._lock:
            return syncing.ensure_fresh(self.store, self.root, self.rule_file, self.embedder, analyse=self.analyse)

    def rebuild(self) -> SyncReport:
        with self._lock:
            return syncing.rebuild(self.store, self.root, self.rule_file, self.embedder, self.analyse)

    def maintain_indexes(self) -> None:
        with self._lock:
            syncing.maintain(self.store, self.analyse)

    def query(self, query: ContextQuery | str = "", **arguments) -> SearchResult:
        """A whole ContextQuery, or its fields."""
        if not isinstance(query, ContextQuery):
            query = ContextQuery(query, **arguments)
        query.validate()
        query.scope = paths.scope_path(self.root, query.scope)
        with self._lock:
            report = self.sync()
            result = retrieval.run(self.store, query, self.embedder, self.analyse)
        result.degraded += report.degraded
        return result

    def validate(self, path: str | None = None, fix_format: bool = False) -> ValidationResult:
        with self._lock:
            return validation.validate(self.spark, str(self.root), self.rule_file, path, fix_format)

    def rules(self, scope: str = "") -> RulesResult:
        paths.scope_path(self.root, scope)
        with self._lock:
            syncing.ensure_fresh(self.store, self.root, self.rule_file, self.embedder, vectors=False, analyse=self.analyse)
            counts = governance.tag_counts(self.store.table("units"))
            known = [r["tag"] for r in counts.orderBy(F.desc("count"), "tag").collect()]
            source = markdown.read_document(str(self.root), self.rule_file)
        own = rule_functions.effective(scope, rule_functions.parse(source.frontmatter))
        return RulesResult(str(self.root), source.body, source.mtime_ns, source.size, own.default_type, own.required_fields, own.tag_aliases, own.as_dict()["sections"], known, scope)
