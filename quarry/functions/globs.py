"""Globs and ignore rules as regular expressions that Java and RE2 both read.

A glob is parsed to a tree of segments, which is then rendered: `*` and `?` stay in a segment, a segment `**` stands for
any number of segments, `**` beside other text for anything, `[...]` for one character of a class, `{a,b}` for either.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from quarry.functions.predicates import literal_regex

_LOG = logging.getLogger(__name__)

#: A separator, a character of a segment, what may stand before an anchored path and before a name.
SEPARATOR, IN_SEGMENT = r"[\\/]", r"[^\\/]"
ANCHORED, ANYWHERE = r"^(?:[a-zA-Z]:)?[\\/]?", r"(?:^|[\\/])"


@dataclass(frozen=True)
class Text:
    text: str

    def regex(self) -> str:
        return literal_regex(self.text)


@dataclass(frozen=True)
class Stars:
    count: int

    def regex(self) -> str:
        return {1: f"{IN_SEGMENT}*", 2: ".*"}.get(self.count, "")  # three and more stand for nothing


@dataclass(frozen=True)
class AnyOne:
    def regex(self) -> str:
        return IN_SEGMENT


@dataclass(frozen=True)
class OneOf:
    members: str

    def regex(self) -> str:
        return f"[{self.members}]"


@dataclass(frozen=True)
class Either:
    choices: tuple[Path, ...]

    def regex(self) -> str:
        return f"(?:{'|'.join(c.regex() for c in self.choices)})"


@dataclass(frozen=True)
class Path:
    """Segments, each a sequence of the above."""

    segments: tuple[tuple[Text | Stars | AnyOne | OneOf | Either, ...], ...]

    def regex(self) -> str:
        out = []
        for segment in self.segments[:-1]:
            out.append(f"(?:.*{SEPARATOR})?" if segment == (Stars(2),) else "".join(x.regex() for x in segment) + SEPARATOR)
        return "".join(out) + "".join(x.regex() for x in self.segments[-1])


def _path(glob: str, tokens: Iterator[str], braced: bool) -> tuple[Path, str]:
    """A path up to the end, or in braces up to ',' or '}', and what ended it."""
    segments: list[list] = [[]]
    for t in tokens:
        if braced and t in ",}":
            return Path(tuple(map(tuple, segments))), t
        if t in ("]", "}") or (t == "{" and braced):
            raise ValueError(f"mismatched {t!r} in glob {glob!r}")
        if t == "/":
            segments.append([])
        elif t == "?":
            segments[-1].append(AnyOne())
        elif t[0] == "*":
            segments[-1].append(Stars(len(t)))
        elif t == "[":
            segments[-1].append(OneOf(_members(glob, tokens)))
        elif t == "{":
            choices, end = [], ","
            while end == ",":
                choice, end = _path(glob, tokens, True)
                choices.append(choice)
            segments[-1].append(Either(tuple(choices)))
        else:
            segments[-1].append(Text(t))
    if braced:
        raise ValueError(f"a brace isn't closed in glob {glob!r}")
    return Path(tuple(map(tuple, segments))), ""


def _members(glob: str, tokens: Iterator[str]) -> str:
    """What stands between brackets, which may nest."""
    open_, out = 1, []
    for t in tokens:
        open_ += (t == "[") - (t == "]")
        if not open_:
            return "".join(out)
        out.append(t)
    raise ValueError(f"a bracket isn't closed in glob {glob!r}")


def glob_regex(glob: str) -> str:
    """Anchored at the root if it holds a '/' that isn't its last, else at any path segment.

    Raises ValueError on brackets or braces that don't pair, or braces inside braces."""
    if not glob:
        return ""
    whole = glob.replace("\\", "/")
    anchored = whole.startswith("/") or "/" in whole.rstrip("/")
    path, _ = _path(glob, iter(re.findall(r"\*+|[][{}?/,]|[^][{}?/,*]+", whole.removeprefix("/"))), False)
    return (ANCHORED if anchored else ANYWHERE) + path.regex() + "$"


def with_ancestors(regex: str) -> str:
    """The same, also true of everything below a path that matches."""
    return regex[:-1] + r"(?:$|[\\/])" if regex.endswith("$") else regex


def pattern_list(patterns: str) -> str:
    """'*.exe;*.lnk' or commas to one regular expression over names; nothing is '*'."""
    each = [p.strip() for p in re.split("[;,]", patterns) if p.strip()] or ["*"]
    return "|".join(f"(?:{glob_regex(p)})" for p in each)


@dataclass(frozen=True)
class IgnoreRule:
    """Lines of an ignore file: what they match below its directory, whether they keep, whether only directories count."""

    regex: str
    keep: bool
    dirs_only: bool


def ignore_rules(text: str) -> list[IgnoreRule]:
    """Rules of an ignore file in order: '#' comments, '!' keeps, a separator at the end is for directories; one at the start
    doesn't anchor. Lines that can't be read are left out and logged."""
    rules = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!").strip().replace("\\", "/")
        if not line.strip("/"):
            continue
        try:
            rules.append(IgnoreRule(glob_regex(line.strip("/")), keep, line.endswith("/")))
        except ValueError as error:
            _LOG.warning("ignore rule %r is left out: %s", line, error)
    return rules


def folded(rules: list[IgnoreRule]) -> list[IgnoreRule]:
    """The same verdicts from fewer rules: neighbours that say the same are one expression."""
    runs = groupby(rules, key=lambda r: (r.keep, r.dirs_only))
    return [IgnoreRule("|".join(f"(?:{r.regex})" for r in run), keep, dirs_only) for (keep, dirs_only), run in runs]
