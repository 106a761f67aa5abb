"""Headers, blocks, units, links, paths, globs, rules and formatting, without Spark."""

import json
import os

import pytest

from lorekeep import config
from lorekeep.errors import ConfigError, ParseError, PathOutsideRoot
from lorekeep.functions import blocks, chunk, formatting, frontmatter, links, rules, text
from lorekeep.sources import markdown, paths


def test_header_with_marks_and_line_ends():
    assert frontmatter.parse("﻿---\ntype: note\n---\nbody") == ({"type": "note"}, "\nbody")
    assert frontmatter.parse("---\r\ntype: note\r\n---\r\nbody")[0] == {"type": "note"}
    raw = "---\ntype: note\nbody"
    assert frontmatter.parse(raw) == ({}, raw) and frontmatter.malformed(raw, raw)
    assert frontmatter.parse("---\njust text\n---\n") == ({}, "---\njust text\n---\n")
    assert frontmatter.parse("---\n---\nx") == ({}, "\nx")


def test_header_scalars_keep_their_kind():
    head, _ = frontmatter.parse("---\na: yes\nb: 2024-01-02\nc: 1:30\nd: 18446744073709551615\ne: null\nf: {g: [null, 2]}\nh: 1.0\ni: true\nj: !x y\n---\n")
    assert head == {"a": "yes", "b": "2024-01-02", "c": "1:30", "d": 18446744073709551615, "e": None, "f": {"g": [None, 2]}, "h": 1.0, "i": True}
    assert frontmatter.parse("---\na: 1\na: 2\n---\n")[0] == {}


def test_headings_of_all_kinds():
    body = "intro\n\n# One `c`\n\n```\n# no\n```\n\nTwo\n===\n\n    # code\n\n### Three ###\n\n> ## Quoted\n> text\n\n- # Item\n\n<div>\n# html\n</div>\n\n## Last\nend\n"
    found, outline = chunk.sections(body)
    assert outline == ["One c", "Two", "Three", "Quoted", "Item", "Last"]
    assert [s.section for s in found][0] == "" and found[0].content == "intro"


def test_empty_sections_stay_in_the_outline():
    found, outline = chunk.sections("# A\n\n## B\n\ntext\n\n# C\n")
    assert outline == ["A", "B", "C"]
    assert [(s.section, s.content) for s in found] == [("A / B", "text")]


def test_units_keep_the_budget():
    body = "# Title\n\n" + ("word " * 700) + "\n\n" + "\n\n".join("line " * 30 for _ in range(8)) + "\n\n```\n" + "code\n" * 40 + "```\n"
    found = chunk.units("a/b.md", {"summary": "s" * 900, "tags": ["X ", "y"], "n": 2, "title": ""}, body, 5)
    assert found[0]["unit_kind"] == "document" and found[0]["ordinal"] == 0
    assert found[0]["tags"] == ["x", "y"] and found[0]["facets"] == ["n=2"] and "b" in found[0]["lookup_keys"]
    assert [u["ordinal"] for u in found] == list(range(len(found)))
    assert all(len(u["search_text"]) + 16 <= 512 for u in found)
    assert len({u["chunk_id"] for u in found}) == len(found)


def test_fitting_blocks_are_not_cut():
    parts = ["p" * 100 + str(i) for i in range(10)]
    cut = chunk.split_oversized("\n\n".join(parts), 250)
    assert all(any(p in c for c in cut) for p in parts) and all(len(c) <= 250 for c in cut)
    assert chunk.units("a.md", {}, " \n", 0) == chunk.units("a.md", {}, "", 0)


def test_links_and_their_sections():
    body = "# H\n\n[[x#part]] and [y](sub/y.md#z) ![i](i.md) [w](http://a/b.md) `[[no]]` [ref][r]\n\n[r]: /top.md\n\n```\n[[no]]\n```\n"
    edges, warnings = links.edges("d/a.md", {}, body)
    assert {e[0] for e in edges} == {"d/x.md", "d/sub/y.md", "top.md"} and not warnings
    assert {e[2] for e in edges} == {"H"}


def test_declared_relations():
    edges, warnings = links.edges("a.md", {"relations": [{"target": "b"}, {"type": "t", "target": "../c"}, {"type": "t"}, 3]}, "")
    assert edges == [("b.md", "related", "frontmatter")] and len(warnings) == 3
    assert links.edges("a.md", {"relations": "x"}, "")[1]


def test_paths(tmp_path):
    for p in ["a-b/c.md", "a.md", "a/b.md", "_x.md", ".y.md", "_d/z.md", ".hidden/no.md", "WIKI.md", "n/WIKI.md", "t.txt"]:
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    os.symlink(tmp_path / "a", tmp_path / "link")
    assert paths.snapshot(tmp_path, "WIKI.md") == [".y.md", "_d/z.md", "_x.md", "a/b.md", "a-b/c.md", "a.md", "n/WIKI.md"]
    for bad in ["../x", "/etc/passwd"]:
        with pytest.raises(PathOutsideRoot):
            paths.scope_path(tmp_path, bad)
    os.symlink("/etc", tmp_path / "out")
    with pytest.raises(PathOutsideRoot):
        paths.scope_path(tmp_path, "out/x.md")


def test_reading_is_bounded_and_skips_equal_content(tmp_path):
    (tmp_path / "a.md").write_text("---\nbad: [\n---\n")
    with pytest.raises(ParseError):
        markdown.read_document(str(tmp_path), "a.md")
    import hashlib

    digest = hashlib.sha256((tmp_path / "a.md").read_bytes()).hexdigest()
    assert markdown.read_document(str(tmp_path), "a.md", digest)[0] == digest
    with open(tmp_path / "big.md", "wb") as f:
        f.truncate(markdown.MOST_BYTES + 1)
    with pytest.raises(ParseError):
        markdown.read_document(str(tmp_path), "big.md")


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("*", "a/b", True), ("a?c", "abc", True), ("[!x]b", "ab", True), ("[^x]b", "xb", False), ("[a-c]", "b", True), ("{a,b}.md", "b.md", True), ("", "", True), ("", "a", False), ("A", "a", False), ("a\\b", "a\\b", True)],
)
def test_globs(pattern, path, hit):
    assert text.glob_match(pattern, path) is hit


def test_rules_are_strict():
    with pytest.raises(ParseError):
        rules.parse({"titlee": 1})
    with pytest.raises(ParseError):
        rules.parse({"sections": [{"path": "[a"}]})
    own = rules.parse({"required_fields": ["type", "x"], "sections": [{"path": "projects/*", "required_fields": ["y"]}, {"path": "p"}, {"path": "projects", "types": ["t"]}]})
    found = rules.effective("projects/a.md", own)
    assert found.required_fields == ["type", "tags", "summary", "x", "y"] and [s.path for s in found.sections] == ["projects", "projects/*"]
    assert not rules.covers("decisions", "decisions-old/a.md") and rules.covers("decisions/", "decisions/a.md")


def test_formatting_preserves_and_settles():
    raw = "---\n# comment\na: 'x'\n---\n\n-  item   \n\n\n\ntext  \nnext\n\n```\n-  code   \n\n\nx\n```\n\n"
    once = formatting.format_markdown(raw)
    assert once == "---\n# comment\na: 'x'\n---\n\n- item\n\ntext  \nnext\n\n```\n-  code   \n\n\nx\n```\n"
    assert formatting.format_markdown(once) is None
    assert formatting.format_markdown("# A\n\ntext\n") is None


def test_inline_text():
    assert blocks.plain("a *b* **c** `d` [e](f.md) <g@h.i> &amp; \\* x_y_z") == "a b c d e g@h.i & * x_y_z"


def test_configuration(tmp_path):
    first = config.load(tmp_path)
    assert first.config_file is None and json.loads((tmp_path / "config.json").read_text())["embedding_model"] is None
    (tmp_path / "config.json").write_text(json.dumps({"wiki_root": "w", "other": 1}))
    assert config.load(tmp_path).wiki_root == tmp_path / "w"
    for bad in ({"wiki_root": " "}, {"embedding_model": "x"}, {"rule_file": "a/b"}):
        (tmp_path / "config.json").write_text(json.dumps(bad))
        with pytest.raises(ConfigError):
            config.load(tmp_path)
    own = first.projection_for(tmp_path / "wiki-a")
    assert own == first.projection_for(tmp_path / "wiki-a" / ".") != first.projection_for(tmp_path / "wiki-b")


def test_parts_are_trimmed():
    assert chunk.fit_parts([" a ", "  ", "summary\n", "x" * 300]) == "a\nsummary\n" + "x" * 240
    assert chunk.fit_outline(["", "one", "two", "three"], 9) == "one / two" and chunk.fit_outline(["long heading"], 5) == "" and chunk.fit_outline(["a", "", "b"], 20) == "a /  / b"


def test_code_keeps_its_spaces():
    for raw in ("x\n\n    code   \n    more  \n\ny\n", "- a\n\n      code   \n", "- ```\n  q   \n  ```\n"):
        assert formatting.format_markdown(raw) is None, raw
    assert formatting.format_markdown("x   \n\n    code   \n") == "x\n\n    code   \n"


def test_formatting_is_linear():
    import time

    raw = "```\na  \n```\n\n" * 4000
    began = time.process_time()
    formatting.format_markdown(raw)
    assert time.process_time() - began < 5


def test_rule_checks_by_kind():
    own = rules.parse({"required_fields": ["status"], "sections": [{"path": "d", "types": ["log"], "filename_pattern": "[0-9]*.md"}]})
    kinds = lambda header, path="d/x.md": sorted(k for k, _, _ in rules.check(path, header, own))
    good = {"type": "log", "tags": ["a"], "summary": "s", "status": "done"}
    assert kinds(good, "d/1.md") == [] and kinds(good) == ["path.filename"]
    assert kinds(good | {"type": "note"}, "d/1.md") == ["type.not_allowed"]
    assert kinds({"type": "", "tags": [], "summary": "x" * 401}, "e/x.md") == ["frontmatter.required", "summary.long", "tags.invalid", "type.invalid"]
    assert kinds({"summary": 3, "tags": ["\x01"], "status": 1}, "e/x.md") == ["frontmatter.required", "summary.invalid", "tags.invalid"]
    assert kinds({"type": ["log"], "tags": ["a"], "summary": "s", "status": 1}, "d/1.md") == ["type.invalid", "type.not_allowed"]
