"""The rule file: strict parsing, and the rules that hold for a path."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

from ..errors import ParseError
from .text import PatternError, glob_match, glob_regex

BUILT_IN = ("type", "tags", "summary")  # fixed values: required of every document


@dataclass
class Section:
    path: str
    types: list[str] = field(default_factory=list)
    required_fields: list[str] = field(default_factory=list)
    filename_pattern: str | None = None


@dataclass
class Rules:
    default_type: str = "note"
    required_fields: list[str] = field(default_factory=list)
    tag_aliases: dict[str, list[str]] = field(default_factory=dict)
    sections: list[Section] = field(default_factory=list)

    def as_dict(self) -> dict:
        return asdict(self)


def _texts(value: object, name: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ParseError(f"invalid rule file: `{name}` must be a list of strings")
    return value


def _only(found: dict, allowed: tuple[str, ...]) -> None:
    for key in found:
        if key not in allowed:
            raise ParseError(f"invalid rule file: unknown field `{key}`")


def _pattern(name: str, value: object) -> str:
    if not isinstance(value, str):
        raise ParseError(f"invalid rule file: `{name}` must be a string")
    try:
        glob_regex(value)
    except PatternError as e:
        raise ParseError(f"invalid {name} pattern `{value}`: {e}") from e
    return value


def parse(header: dict) -> Rules:
    """Rules from a rule file's header; unknown fields and malformed globs are errors."""
    _only(header, ("default_type", "required_fields", "tag_aliases", "sections"))
    out = Rules()
    if "default_type" in header:
        if not isinstance(header["default_type"], str):
            raise ParseError("invalid rule file: `default_type` must be a string")
        out.default_type = header["default_type"]
    if "required_fields" in header:
        out.required_fields = _texts(header["required_fields"], "required_fields")
    if "tag_aliases" in header:
        if not isinstance(header["tag_aliases"], dict):
            raise ParseError("invalid rule file: `tag_aliases` must be a map")
        out.tag_aliases = {k: _texts(header["tag_aliases"][k], f"tag_aliases.{k}") for k in sorted(header["tag_aliases"])}
    if "sections" in header:
        if not isinstance(header["sections"], list):
            raise ParseError("invalid rule file: `sections` must be a list")
        for entry in header["sections"]:
            if not isinstance(entry, dict):
                raise ParseError("invalid rule file: a section must be a map")
            _only(entry, ("path", "types", "required_fields", "filename_pattern"))
            if "path" not in entry:
                raise ParseError("invalid rule file: missing field `path`")
            pattern = entry.get("filename_pattern")
            out.sections.append(
                Section(
                    _pattern("section.path", entry["path"]),
                    _texts(entry.get("types", []), "types"),
                    _texts(entry.get("required_fields", []), "required_fields"),
                    None if pattern is None else _pattern("section.filename_pattern", pattern),
                )
            )
    return out


def covers(section: str, path: str) -> bool:
    """A glob over the whole path, or a literal directory with everything below it."""
    directory = section.rstrip("/")
    return glob_match(section, path) or (bool(directory) and path.startswith(directory + "/"))


def effective(path: str, rules: Rules) -> Rules:
    """The sections that cover a path, shortest pattern first, and all required fields once."""
    own = sorted((s for s in rules.sections if covers(s.path, path)), key=lambda s: len(s.path.encode()))
    required = list(dict.fromkeys([*BUILT_IN, *rules.required_fields, *(f for s in own for f in s.required_fields)]))
    return Rules(rules.default_type, required, rules.tag_aliases, own)


LONG = 400  # fixed value: characters of a summary that needs no remark

Finding = tuple[str, str, str]


def _filled(value: object) -> bool:
    return isinstance(value, str) and bool(value.strip())


def _governing(own: Rules) -> Section:
    """The section with the longest pattern decides; without one nothing is decided."""
    return own.sections[-1] if own.sections else Section("")


def _misplaced(header: dict, own: Rules) -> Iterator[str]:
    section, kind = _governing(own), header.get("type")
    kind = kind if isinstance(kind, str) else own.default_type
    if section.types and kind not in section.types:
        yield f"{section.path} takes {' or '.join(section.types)}, not {kind}"


def _misnamed(path: str, own: Rules) -> Iterator[str]:
    pattern, name = _governing(own).filename_pattern, path.rpartition("/")[2]
    if pattern is not None and not glob_match(pattern, name):
        yield f"{name} is not of the form {pattern}"


def _untagged(tags: object) -> Iterator[str]:
    if not (isinstance(tags, list) and tags and all(map(valid_tag, tags))):
        yield "tags: a list with printable text in every entry is needed"


#: kind, severity, and what finds it in (path, header, rules that hold).
CHECKS: list[tuple[str, str, Callable[[str, dict, Rules], Iterable[str]]]] = [
    ("frontmatter.required", "error", lambda path, header, own: (f"{f}: not in the header" for f in own.required_fields if f not in header)),
    ("type.invalid", "error", lambda path, header, own: ["type: text is needed"] if "type" in header and not _filled(header["type"]) else []),
    ("summary.invalid", "error", lambda path, header, own: ["summary: text is needed"] if "summary" in header and not _filled(header["summary"]) else []),
    ("summary.long", "warning", lambda path, header, own: [f"summary: more than {LONG} characters"] if _filled(s := header.get("summary")) and len(s) > LONG else []),
    ("type.not_allowed", "error", lambda path, header, own: _misplaced(header, own)),
    ("path.filename", "error", lambda path, header, own: _misnamed(path, own)),
    ("tags.invalid", "error", lambda path, header, own: _untagged(header["tags"]) if "tags" in header else []),
]


def check(path: str, header: dict, rules: Rules) -> list[Finding]:
    """(kind, message, severity) of a document's own header; tags that need the whole archive are left out."""
    own = effective(path, rules)
    return [(kind, message, severity) for kind, severity, find in CHECKS for message in find(path, header, own)]


def valid_tag(tag: object) -> bool:
    return isinstance(tag, str) and bool(tag.strip()) and not any(ord(c) < 32 or 127 <= ord(c) < 160 for c in tag)
