"""Search query text to dataclasses; pure Python, run on the driver but for trigger_columns().

'/' and '\\\\' are both taken as separators; the port's paths use '/'.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

FUZZY, EXACT, BOUNDARY, PREFIX, SUFFIX, EQUAL = "fuzzy", "exact", "boundary", "prefix", "suffix", "equal"


@dataclass(frozen=True)
class Term:
    kind: str
    text: str
    inverse: bool = False
    case_sensitive: bool = False
    alias_form: bool = False


@dataclass(frozen=True)
class Pattern:
    """Sets joined by AND; the terms of a set joined by OR, the first that matches counting."""

    sets: tuple[tuple[Term, ...], ...] = ()
    drive: str | None = None

    @property
    def term_length(self) -> int:
        """Length of the first non-inverse term of each set."""
        return sum(next((len(t.text) for t in s if not t.inverse), 0) for s in self.sets)


@dataclass(frozen=True)
class ParsedQuery:
    text: str
    path_mode: bool = False
    drive: str | None = None
    exact_path: str = ""
    ends_with_separator: bool = False
    directory: str = ""
    name: str = ""


@dataclass(frozen=True)
class BoxQuery:
    """What the search box holds: text, ':a,b' tokens and the '*' exclusion bypass."""

    text: str
    tokens: tuple[str, ...] = field(default=())
    bypass: bool = False


def split_tokens(raw: str) -> BoxQuery:
    """The last word ':a,b,c' gives tokens, unless a part is empty; a leading '*' bypasses exclusions."""
    text, tokens = raw, ()
    head, _, last = raw.rstrip().rpartition(" ")
    if len(last) >= 2 and last.startswith(":"):
        parts = last[1:].split(",")
        if all(p.strip() for p in parts):
            text, tokens = head.rstrip(), tuple(p.strip() for p in parts)
    stripped = text.lstrip()
    return BoxQuery(stripped[1:].lstrip(), tokens, True) if stripped.startswith("*") else BoxQuery(text, tokens)


def lines_to_or(pasted: str) -> str:
    """Two or more filled lines become alternatives."""
    lines = [x.strip() for x in pasted.splitlines() if x.strip()]
    return " | ".join(lines) if len(lines) > 1 else pasted


def type_trigger(text: str, triggers: dict[str, str]) -> tuple[str | None, str]:
    """First character -> result type, taken off."""
    return (triggers[text[0]], text[1:].lstrip()) if text and text[0] in triggers else (None, text)


def trigger_columns(text: Column, triggers: dict[str, str]) -> tuple[Column, Column]:
    """type_trigger() over a column: (result type or null, text without its trigger)."""
    first = F.substring(text, 1, 1)
    kind = F.lit(None).cast("string")
    for c, name in triggers.items():
        kind = F.when(first == c, name).otherwise(kind)
    return kind, F.when(kind.isNotNull(), F.ltrim(F.substring(text, 2, 1 << 30))).otherwise(text)


def keyword_gate(text: str, keyword: str) -> str | None:
    """What follows '<keyword> ', or None if the text isn't for that keyword."""
    word, _, rest = text.strip().partition(" ")
    return rest.strip() if keyword and word.lower() == keyword.lower() else None


def parse_query(raw: str) -> ParsedQuery:
    """Any separator makes it a path query: lower-cased, drive shorthand expanded, split at the last separator."""
    text = raw.strip().replace("\\", "/").lower()
    if "/" not in text:
        drive = re.fullmatch(r"([a-z]):\s*(.*)", text)
        return ParsedQuery(raw.strip(), drive=drive[1] if drive else None, name=drive[2] if drive else text)
    if short := re.match(r"([a-z])/(.*)", text):
        text = f"{short[1]}:/{short[2]}"
    drive = text[0] if re.match(r"[a-z]:", text) else None
    exact = text.rstrip("/")
    if drive and len(exact) <= 2:
        exact = f"{drive}:/"
    directory, _, name = text.rpartition("/")
    return ParsedQuery(text, True, drive, exact, text.endswith("/"), directory, name)


def _words(text: str) -> list[str]:
    """Words by spaces, '\\\\ ' being a space inside one; a quoted phrase is one word if its quotes are at word edges."""
    out, now, escaped = [], "", False
    for c in text:
        if escaped:
            now += c if c == " " else "\\" + c
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == " ":
            out += [now] if now else []
            now = ""
        else:
            now += c
    now += "\\" if escaped else ""
    out += [now] if now else []
    merged: list[str] = []
    i = 0
    while i < len(out):
        head = out[i].removeprefix("!")
        if head.startswith("'") and not (len(head) > 1 and head.endswith("'")):
            stop = next((j for j in range(i + 1, len(out)) if out[j] == "|" or out[j].endswith("'")), None)
            if stop is not None and out[stop] != "|":
                merged.append(" ".join(out[i : stop + 1]))
                i = stop + 1
                continue
        merged.append(out[i])
        i += 1
    return merged


def parse_term(word: str, fuzzy: bool = True) -> Term | None:
    """Operators are read in the order ! $ '...' ' ^."""
    inverse = word.startswith("!") and len(word) > 1
    text = word[1:] if inverse else word
    kind = EXACT if inverse or not fuzzy else FUZZY
    suffix = text.endswith("$") and len(text) > 1
    if suffix:
        text, kind = text[:-1], SUFFIX
    if len(text) > 2 and text.startswith("'") and text.endswith("'"):
        text, kind = text[1:-1], BOUNDARY
    elif len(text) > 1 and text.startswith("'"):
        text, kind = text[1:], EXACT if fuzzy and not inverse else FUZZY
    elif len(text) > 1 and text.startswith("^"):
        text, kind = text[1:].removeprefix("'") or text[1:], EQUAL if suffix else PREFIX
    if not text:
        return None
    cased = text != text.lower()
    return Term(kind, text, inverse, cased)


def parse_pattern(text: str, fuzzy: bool = True, alias_forms: Callable[[str], Iterable[str]] | None = None) -> Pattern:
    """A drive word anywhere names the drive, the last one counting; '|' between words makes alternatives."""
    sets: list[list[Term]] = []
    drive, chain = None, False
    for word in _words(text):
        if word == "|":
            chain = bool(sets)
            continue
        if m := re.match(r"([A-Za-z]):(.*)", word):
            drive, word = m[1].lower(), m[2]
            if not word:
                continue
        term = parse_term(word, fuzzy)
        if term is None:
            continue
        if chain:
            sets[-1].append(term)
        else:
            sets.append([term])
        chain = False
    if alias_forms:
        for own in sets:
            own += [replace(t, text=form, alias_form=True) for t in list(own) if not t.inverse and not t.case_sensitive for form in alias_forms(t.text)]
    return Pattern(tuple(tuple(s) for s in sets), drive)
