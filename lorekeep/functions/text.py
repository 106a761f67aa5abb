"""Column expressions for text, paths and times; all of them stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import asdict, dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def utrim(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Runs of letters and digits, lower-cased; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def tokens_of(text: str) -> list[str]:
    """The same tokens on the driver."""
    out, word = [], []
    for ch in text.lower() + " ":
        if ch.isalpha() or ch.isnumeric():
            word.append(ch)
        elif word:
            out.append("".join(word))
            word = []
    return out


def bigram_tokens(c: Column) -> Column:
    """``tokens`` with each run of Han characters as its overlapping pairs."""
    han = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?<=\p{IsHan})(?=\p{IsHan})", "\u0001")
    parts = F.regexp_extract_all(han, F.lit(r"[\p{L}\p{N}\x01]+"), F.lit(0))

    def pairs(word: Column) -> Column:
        letters = F.split(word, "\u0001")
        n = F.size(letters)
        return F.when(n < 2, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.element_at(letters, i), F.element_at(letters, F.least(i + 1, n)))))

    return F.flatten(F.transform(parts, pairs))


def bigram_tokens_of(text: str) -> list[str]:
    """The same pairs on the driver."""
    parted = regex.sub(r"(?<=\p{Han})(?=\p{Han})", "\u0001", text.lower())
    out = []
    for word in "".join(ch if ch == "\u0001" or ch.isalpha() or ch.isnumeric() else " " for ch in parted).split(" "):
        letters = word.split("\u0001")
        out += [a + b for a, b in zip(letters, letters[1:])] if len(letters) > 1 else [word] * bool(word)
    return out


# Words that an index may leave out.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
_bare = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1}


@dataclass(frozen=True)
class Analyser:
    """How texts become terms, in the JVM for tables and on the driver for queries; both sides must use one.

    ``longest`` drops longer words, ``fold`` takes marks off Latin letters, ``stop``
    leaves out common English words, ``stem`` takes off plural endings, and
    ``cjk_bigrams`` cuts runs of Han characters into pairs.
    """

    cjk_bigrams: bool = False
    longest: int = 40
    fold: bool = False
    stop: bool = False
    stem: bool = False

    def __call__(self, c: Column) -> Column:
        c = F.lower(F.coalesce(c, F.lit("")))
        if self.fold:
            c = F.translate(c, "".join(_bare), "".join(_bare.values()))
        words = bigram_tokens(c) if self.cjk_bigrams else tokens(c)
        words = F.filter(words, lambda w: F.length(w) <= self.longest)
        if self.stop:
            words = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
        if self.stem:
            words = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, IES, "y"), PLURAL, ""))
        return words

    def words(self, text: str) -> list[str]:
        text = text.lower()
        if self.fold:
            text = text.translate(str.maketrans(_bare))
        words = [w for w in (bigram_tokens_of if self.cjk_bigrams else tokens_of)(text) if len(w) <= self.longest]
        if self.stop:
            words = [w for w in words if w not in STOP_WORDS]
        return [re.sub(PLURAL, "", re.sub(IES, "y", w)) for w in words] if self.stem else words

    def signature(self) -> dict:
        return asdict(self)


# Plural endings: "ies" becomes "y", an "s" after another letter than s, u and i goes.
IES, PLURAL = r"(?<=[^ae])ies$", r"(?<=[a-z][^sui])s$"
PLAIN = Analyser()


def in_scope(path: Column, scope: str) -> Column:
    """Literal directory or document; the empty scope holds everything."""
    scope = scope.strip("/")
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def path_order(path: Column) -> Column:
    """Sorts by path components."""
    return F.split(path, "/")


def stem(path: Column) -> Column:
    """The file name without its extension; a leading dot is no extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:(?<=[^/])\.[^./]*)?$", 1)


def rfc3339(ns: Column) -> Column:
    """Whole seconds, rounded down, in UTC."""
    seconds = F.call_function("div", ns - F.pmod(ns, F.lit(1_000_000_000)), F.lit(1_000_000_000))
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snippet(c: Column, length: int = 80) -> Column:
    """One line: white space collapsed, cut with an ellipsis."""
    one = utrim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(one) > length, F.concat(F.substring(one, 1, length), F.lit("…"))).otherwise(one)


class PatternError(ValueError):
    """A malformed glob."""


def glob_regex(pattern: str) -> str:
    """A regular expression for the whole text: ``*`` crosses ``/``, classes, ``{a,b}``, no escapes."""
    out, at, depth = [], 0, 0
    while at < len(pattern):
        ch = pattern[at]
        at += 1
        if ch == "*":
            while pattern[at : at + 1] == "*":
                at += 1
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            end = pattern.find("]", at + 1 + (pattern[at : at + 1] in ("!", "^")))
            if end < 0:
                raise PatternError(f"unclosed character class in {pattern!r}")
            body, at = pattern[at:end], end + 1
            negated = body[:1] in ("!", "^")
            body = body[1:] if negated else body
            for low, high in re.findall(r"(.)-(.)", body, re.S):
                if low > high:
                    raise PatternError(f"invalid range {low}-{high} in {pattern!r}")
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body)
            out.append(f"[{'^' if negated else ''}{body}]")
        elif ch == "{":
            depth += 1
            out.append("(?:")
        elif ch == "}":
            depth -= 1
            if depth < 0:
                raise PatternError(f"unopened alternation in {pattern!r}")
            out.append(")")
        elif ch == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(ch))
    if depth:
        raise PatternError(f"unclosed alternation in {pattern!r}")
    return "(?s:" + "".join(out) + ")"


def glob_match(pattern: str, text: str) -> bool:
    return re.fullmatch(glob_regex(pattern), text) is not None


def matches_glob(c: Column, pattern: str) -> Column:
    return c.rlike(f"^{glob_regex(pattern)}\\z")


def matches_section(path: Column, section: str) -> Column:
    """A section's glob, or its literal directory."""
    directory = section.rstrip("/")
    inside = path.startswith(directory + "/") if directory else F.lit(False)
    return matches_glob(path, section) | inside
