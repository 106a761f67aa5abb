"""What can go wrong, by kind."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of the engine."""


class ConfigError(EngineError):
    """A setting or argument that cannot be used."""


class FileError(EngineError):
    """A file that cannot be read or written."""


class ParseError(EngineError):
    """A file whose text cannot be understood."""


class IndexError_(EngineError):
    """Derived data that cannot be read or written."""


class EmbeddingError(EngineError):
    """A model that cannot be loaded or run; queries go on without it."""


class PathOutsideRoot(EngineError):
    """A path that leaves the wiki."""


class FormatConflict(EngineError):
    """A file that changed while it was being formatted."""
