"""YAML headers of Markdown files, as JSON values."""

from __future__ import annotations

import json
import math
import re

import yaml

BOM = "\ufeff"


class _Loader(yaml.SafeLoader):
    """YAML 1.2 scalars only: null, true/false, integers and floats; no merge keys, no repeated keys."""


_Loader.yaml_implicit_resolvers = {}
_Loader.add_implicit_resolver("tag:yaml.org,2002:null", re.compile(r"^(?:~|null|Null|NULL|)$"), ["~", "n", "N", ""])
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
_Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^(?:[-+]?(?:0|[1-9][0-9]*)|0o[0-7]+|0x[0-9a-fA-F]+)$"), list("-+0123456789"))
_Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$"), list("-+0123456789."))


def _integer(loader: _Loader, node: yaml.ScalarNode) -> int:
    text = node.value
    return int(text, 0) if text.lower().startswith(("0o", "0x")) else int(text)


def _float(loader: _Loader, node: yaml.ScalarNode) -> float:
    return float(node.value.lower().replace(".inf", "inf").replace(".nan", "nan"))


class _Dropped:
    """A value that JSON cannot hold, such as one with an application's tag."""


def _mapping(loader: _Loader, node: yaml.MappingNode) -> dict:
    out: dict = {}
    for key_node, value_node in node.value:
        key = loader.construct_object(key_node, deep=True)
        try:
            if key in out:
                raise yaml.constructor.ConstructorError(None, None, f"duplicate key {key!r}", key_node.start_mark)
        except TypeError:  # a list or map as key
            continue
        out[key] = loader.construct_object(value_node, deep=True)
    return out


_Loader.add_constructor("tag:yaml.org,2002:int", _integer)
_Loader.add_constructor("tag:yaml.org,2002:float", _float)
_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)
_Loader.add_multi_constructor("!", lambda loader, suffix, node: _Dropped())


def _json(value: object) -> object:
    if isinstance(value, dict):
        return {k: _json(v) for k, v in value.items() if isinstance(k, str) and not isinstance(v, _Dropped)}
    if isinstance(value, list):
        return [_json(v) for v in value if not isinstance(v, _Dropped)]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 64:
        return float(value)
    return value


def parse(raw: str) -> tuple[dict, str]:
    """The header as a map and the body.

    Without a header, with one that never closes or is no map, the map is empty
    and the body is the raw text.
    """
    text = raw.lstrip(BOM)
    if not text.startswith("---"):
        return {}, raw
    end = text.find("\n---", 3)
    if end < 0:
        return {}, raw
    try:
        value = yaml.load(text[3:end], _Loader)
    except (yaml.YAMLError, ValueError):
        return {}, raw
    if value is None:
        value = {}
    if not isinstance(value, dict):
        return {}, raw
    return _json(value), text[end + 4 :]


def malformed(raw: str, body: str) -> bool:
    """A reader's test: a header was opened as a line of its own and could not be parsed."""
    return body == raw and raw.lstrip(BOM).startswith("---\n")


def unterminated(raw: str, body: str) -> bool:
    """A validator's test: the text starts like a header and all of it is body."""
    text = raw.lstrip(BOM)
    return text.startswith("---") and body == text


def compact(value: object) -> str:
    """Compact JSON with sorted keys; non-ASCII text stays as it is."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
