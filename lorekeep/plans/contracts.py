"""What callers pass in and get back."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from ..errors import ConfigError

LIMITS = (1, 20)


@dataclass
class ContextQuery:
    query: str = ""
    scope: str = ""
    document_limit: int = 5
    fragment_limit: int = 10
    keywords: list[str] = field(default_factory=list)
    keyword_mode: str = "any"
    tags: list[str] = field(default_factory=list)
    note_types: list[str] = field(default_factory=list)
    metadata_filters: dict[str, object] = field(default_factory=dict)
    modified_after_ns: int | None = None
    modified_before_ns: int | None = None
    order: str = "relevance"
    include_relations: bool = False

    def __post_init__(self) -> None:
        for name, empty in (("keywords", []), ("tags", []), ("note_types", []), ("metadata_filters", {})):
            if getattr(self, name) is None:
                setattr(self, name, empty)

    def is_recent(self) -> bool:
        return not self.query.strip() and not self.keywords

    def validate(self) -> None:
        after, before = self.modified_after_ns, self.modified_before_ns
        size = lambda text: len(text.encode("utf-8", "surrogatepass"))
        fits = {
            "document_limit": LIMITS[0] <= self.document_limit <= LIMITS[1],
            "fragment_limit": LIMITS[0] <= self.fragment_limit <= LIMITS[1],
            "query": size(self.query) <= 8192,
            "keywords": len(self.keywords) <= 20 and all(size(k) <= 256 for k in self.keywords),
            "tags": len(self.tags) <= 100,
            "note_types": len(self.note_types) <= 100,
            "metadata_filters": len(self.metadata_filters) <= 100,
            "modified_after_ns": after is None or before is None or after <= before,
            "keyword_mode": self.keyword_mode in ("any", "all"),
            "order": self.order in ("relevance", "modified_desc"),
        }
        if not all(fits.values()):
            raise ConfigError(f"out of range: {', '.join(name for name, ok in fits.items() if not ok)}")


@dataclass
class Hit:
    path: str
    unit_kind: str
    chunk_id: str
    note_type: str
    tags: list[str]
    ordinal: int
    section: str
    content: str
    score: float
    sources: list[str]
    filename: str
    modified_at_ns: int
    frontmatter: dict


@dataclass
class Related:
    path: str
    filename: str
    direction: str
    relation_type: str
    resolution_status: str
    source_section: str
    context: str


@dataclass
class SearchResult:
    strategy: str
    documents: list[Hit]
    fragments: list[Hit]
    related: list[Related]
    degraded: list[str]


@dataclass
class SyncReport:
    indexed: int = 0
    removed: int = 0
    moved: int = 0
    unchanged: int = 0
    vectors_ready: int = 0
    vectors_reused: int = 0
    vectors_pending: int = 0
    degraded: list[str] = field(default_factory=list)
    generation: str = ""


@dataclass(frozen=True, order=True)
class Issue:
    path: str
    kind: str
    message: str
    severity: str

    def __str__(self) -> str:
        return self.message


@dataclass
class ValidationResult:
    issues: list[Issue]
    formatted_paths: list[str]

    def as_dict(self) -> dict:
        return {"issues": [asdict(i) for i in self.issues], "formatted_paths": self.formatted_paths}
