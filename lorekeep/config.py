"""Settings, read from a JSON file that is seeded with defaults."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from pathlib import Path

from .errors import ConfigError, FileError

FILE_NAME = "config.json"
MODELS = ("BAAI/bge-small-zh-v1.5",)  # fixed values: models that can be configured
RULE_FILE = "WIKI.md"
DEFAULT_ROOT = "~/wiki"


@dataclass(frozen=True)
class Config:
    wiki_root: Path
    embedding_model: str | None
    projection_dir: Path
    config_file: Path | None
    rule_file: str = RULE_FILE

    def projection_for(self, root: Path) -> Path:
        """The folder for derived data of one wiki; spellings of one root agree."""
        root.mkdir(parents=True, exist_ok=True)
        name = hashlib.sha256(os.path.realpath(root).encode()).hexdigest()
        return self.projection_dir / "projection" / name


def resolve(folder: Path, path: str) -> Path:
    expanded = Path(path).expanduser()
    return expanded if expanded.is_absolute() else folder / expanded


def load(folder: Path | str | None = None) -> Config:
    """The settings in a folder; a missing file is written with defaults, unknown keys are ignored."""
    folder = Path(os.path.abspath(Path(folder).expanduser())) if folder else Path.home() / ".lorekeep"
    path = folder / FILE_NAME
    raw: dict = {"wiki_root": DEFAULT_ROOT, "embedding_model": None}
    found = path.exists()
    try:
        if found:
            try:
                own = json.loads(path.read_text(encoding="utf-8"))
            except ValueError as e:
                raise ConfigError(f"{path}: {e}") from e
            if not isinstance(own, dict):
                raise ConfigError(f"{path}: expected an object")
            raw |= own
        else:
            folder.mkdir(parents=True, exist_ok=True)
            path.write_text(json.dumps(raw, indent=2), encoding="utf-8")
    except OSError as e:
        raise FileError(f"{path}: {e}") from e
    root, model, rules = raw["wiki_root"], raw["embedding_model"], raw.get("rule_file", RULE_FILE)
    if not isinstance(root, str) or not root.strip():
        raise ConfigError(f"{path}: invalid `wiki_root`: empty path")
    if model is not None and model not in MODELS:
        raise ConfigError(f"{path}: unsupported `embedding_model`")
    if not isinstance(rules, str) or "/" in rules or not rules.endswith(".md"):
        raise ConfigError(f"{path}: invalid `rule_file`")
    return Config(resolve(folder, root), model, folder, path if found else None, rules)
