"""Validation of a wiki: each document on its own in parallel, then what needs all of them."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, EngineError, FileError, FormatConflict, ParseError, PathOutsideRoot
from ..functions import chunk, frontmatter, links
from ..functions import rules as rule_functions
from ..functions.formatting import Unformattable, format_markdown
from ..operators import governance
from ..sources import markdown, paths
from .contracts import Issue, ValidationResult

FACTS = "path string, issues array<struct<kind: string, message: string, severity: string>>, targets array<string>, tags array<string>, raw_tags array<string>"


def load_rules(root: str, rule_file: str) -> tuple[rule_functions.Rules | None, Issue | None]:
    """The rules, if there is a rule file; an issue if it is broken."""
    if not os.path.exists(os.path.join(root, rule_file)):
        return None, None
    try:
        return rule_functions.parse(markdown.read_document(root, rule_file).frontmatter), None
    except EngineError as e:
        return None, Issue(rule_file, "rules.parse", str(e), "error")


def text_of(root: str, path: str) -> tuple[str | None, tuple[str, str, str] | None]:
    """A document's text, or why there is none."""
    try:
        paths.scope_path(root, path)
        with open(os.path.join(root, path), encoding="utf-8", newline="") as f:
            return f.read(), None
    except PathOutsideRoot as e:
        return None, ("path.unsafe", str(e), "error")
    except (OSError, UnicodeDecodeError) as e:
        return None, ("io.read", f"no text to read: {type(e).__name__}", "error")


def remarks(path: str, raw: str, header: dict, body: str) -> Iterator[tuple[str, str, str]]:
    """What is to be said of a text whatever the rules."""
    if frontmatter.unterminated(raw, body):
        yield "markdown.parse", "the header has no end", "error"
    elif changes_in_format(raw):
        yield "markdown.formatting", "formatting would change the text", "warning"
    if body.strip() == "" and not any(u["content"] for u in chunk.units(path, header, body, 0)):
        yield "content.empty", "nothing stands below the header", "error"


def changes_in_format(raw: str) -> bool:
    try:
        return format_markdown(raw) is not None
    except Unformattable:
        return False


def inspect(root: str, path: str, rules: rule_functions.Rules | None) -> dict:
    """One row of FACTS."""
    raw, why = text_of(root, path)
    if raw is None:
        return _facts(path, [why], [], [], [])
    header, body = frontmatter.parse(raw)
    found = [*remarks(path, raw, header, body), *(rule_functions.check(path, header, rules) if rules is not None else [])]
    listed = header.get("tags")
    tags = [t for t in listed if isinstance(t, str)] if isinstance(listed, list) else []
    governed = [] if rules is None else list(filter(rule_functions.valid_tag, tags))
    return _facts(path, found, [to for to, _, _ in links.edges(path, header, body)[0]], governed, tags)


def _facts(path: str, found: list[tuple[str, str, str]], targets: list[str], tags: list[str], raw_tags: list[str]) -> dict:
    return {"path": path, "issues": [dict(zip(("kind", "message", "severity"), f)) for f in found], "targets": targets, "tags": tags, "raw_tags": raw_tags}


def facts(listed: DataFrame, root: str, rules: rule_functions.Rules | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([inspect(root, p, rules) for p in batch["path"]], columns=["path", "issues", "targets", "tags", "raw_tags"])

    return listed.select("path").mapInPandas(run, FACTS)


def issues(spark: SparkSession, root: str, rule_file: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """path, kind, message, severity of a document or of the whole archive; and the facts, kept until unpersisted."""
    rules, broken = load_rules(root, rule_file)
    every = spark.createDataFrame([(p,) for p in paths.snapshot(root, rule_file)], "path string")
    chosen = every if path is None else spark.createDataFrame([(path,)], "path string")
    found = facts(chosen.repartition(spark.sparkContext.defaultParallelism), root, rules).persist()
    columns = ["path", "kind", "message", "severity"]
    parts = [found.select("path", F.explode("issues").alias("i")).select("path", "i.*")]
    edges = found.select(F.col("path").alias("from_path"), F.explode("targets").alias("to_path"))
    lost = governance.broken_links(edges, every)
    parts.append(lost.select("path", "kind", F.concat(F.lit("no such document: "), "target").alias("message"), F.lit("warning").alias("severity")))
    if rules is not None:
        tags = found.select("path", F.explode("tags").alias("tag"))
        variants = governance.non_canonical(tags, rules.tag_aliases)
        parts.append(variants.select("path", F.lit("tags.non_canonical").alias("kind"), F.format_string("%s: the rules spell this tag %s", "tag", "canonical").alias("message"), F.lit("warning").alias("severity")))
        if path is None:
            new = governance.new_tags(tags, governance.raw_tag_counts(found), rules.tag_aliases)
            parts.append(new.select("path", F.lit("tags.new").alias("kind"), F.format_string("%s: first use of this tag, and no rule names it", "tag").alias("message"), F.lit("warning").alias("severity")))
    if broken is not None:
        parts.append(spark.createDataFrame([(broken.path, broken.kind, broken.message, broken.severity)], "path string, kind string, message string, severity string"))
    return governance.union_all([p.select(*columns) for p in parts]), found


def format_file(root: str, path: str, rule_file: str) -> bool:
    """Formats one document in place, unless it changes meanwhile; whether it was written."""
    paths.scope_path(root, path)
    if path == rule_file or not path.endswith(".md"):
        raise ConfigError("only documents of the wiki can be named here")
    full = os.path.join(root, path)
    try:
        before = os.stat(full)
        with open(full, encoding="utf-8", newline="") as f:
            original = f.read()
    except (OSError, UnicodeDecodeError) as e:
        raise FileError(f"{path}: {e}") from e
    try:
        formatted = format_markdown(original)
    except Unformattable as e:
        raise ParseError(f"{path}: {e}") from e
    if formatted is None:
        return False
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(full), prefix=".")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(formatted)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temp, before.st_mode & 0o7777)
        paths.scope_path(root, path)
        now = os.stat(full)
        with open(full, encoding="utf-8", newline="") as f:
            same = f.read() == original
        if (now.st_size, now.st_mtime_ns) != (before.st_size, before.st_mtime_ns) or not same:
            raise FormatConflict(path)
        os.replace(temp, full)
        temp = ""
    except OSError as e:
        raise FileError(f"{path}: {e}") from e
    finally:
        if temp:
            os.unlink(temp)
    return True


def validate(spark: SparkSession, root: str, rule_file: str, path: str | None = None, fix_format: bool = False) -> ValidationResult:
    """Formats first if asked to, then reports; failures to format come after the sorted issues."""
    if path is not None:
        paths.scope_path(root, path)
        if path == rule_file or not path.endswith(".md"):
            raise ConfigError("only documents of the wiki can be named here")
    formatted, failures = [], []
    if fix_format:
        for p in [path] if path is not None else paths.snapshot(root, rule_file):
            try:
                if format_file(root, p, rule_file):
                    formatted.append(p)
            except FormatConflict:
                failures.append(Issue(p, "format.conflict", "written by someone else while it was being formatted", "error"))
            except EngineError as e:
                failures.append(Issue(p, "format.failed", str(e), "error"))
    reported, kept = issues(spark, root, rule_file, path)
    found = reported.orderBy("path", "kind", "message").collect()
    kept.unpersist()
    return ValidationResult([Issue(r["path"], r["kind"], r["message"], r["severity"]) for r in found] + failures, formatted)
