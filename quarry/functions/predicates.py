"""Term predicates as native columns: everything stays inside whole-stage code generation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import query as Q

#: Bonus scale and scores of the ranking model.
SCORE_MATCH = 16
BONUS_BOUNDARY = 8
BONUS_WHITE = 10
BONUS_DELIMITER = 9
BONUS_CAMEL = 7
BONUS_CONSECUTIVE = 4
GAP_START = -3
GAP_EXTENSION = -1
FIRST_FACTOR = 2

#: Characters that stand for themselves in Java's and RE2's regular expressions alike.
_PLAIN = re.compile(r"[A-Za-z0-9_ ]")
#: Letters and digits, the classes above the delimiters.
WORD_CLASS = r"[\p{L}0-9]"


def literal_regex(text: str) -> str:
    return "".join(c if _PLAIN.fullmatch(c) or ord(c) > 127 else f"\\{c}" for c in text)


def term_column(name: Column, term: Q.Term) -> Column:
    """Does a name match the term (before inversion)?"""
    subject, text = (name, term.text) if term.case_sensitive else (F.lower(name), term.text.lower())
    if term.kind == Q.FUZZY:
        # each step skips to the next such character, so long names don't make the engine try again
        return subject.rlike("^" + "".join(f"[^{literal_regex(c)}]*{literal_regex(c)}" for c in text))
    if term.kind == Q.EXACT:
        return subject.contains(text)
    if term.kind == Q.BOUNDARY:
        return subject.rlike(f"(^|[^\\p{{L}}0-9]){literal_regex(text)}([^\\p{{L}}0-9]|$)")
    if term.kind == Q.PREFIX:
        return (subject if text[0].isspace() else F.ltrim(subject)).startswith(text)
    if term.kind == Q.SUFFIX:
        return (subject if text[-1].isspace() else F.rtrim(subject)).endswith(text)
    left = subject if text[0].isspace() else F.ltrim(subject)
    return (left if text[-1].isspace() else F.rtrim(left)) == text


def set_column(name: Column, terms: tuple[Q.Term, ...]) -> Column:
    """First-match OR: an inverse term that hits fails the set, unless an earlier plain term has matched."""
    out = F.lit(any(t.inverse for t in terms))
    for t in reversed(terms):
        hit = term_column(name, t)
        out = F.when(hit, F.lit(False)).otherwise(out) if t.inverse else F.when(hit, F.lit(True)).otherwise(out)
    return out


def pattern_column(name: Column, pattern: Q.Pattern) -> Column:
    return reduce(lambda a, b: a & b, (set_column(name, s) for s in pattern.sets), F.lit(True))


def mask_bit(c: str) -> int:
    """Fixed buckets: 0-25 letters, 26-35 digits, 36-63 anything else by code."""
    if "a" <= c <= "z":
        return ord(c) - 97
    return 26 + ord(c) - 48 if "0" <= c <= "9" else 36 + ord(c) % 28


def mask_of(text: str) -> int:
    """As a signed 64-bit number."""
    m = 0
    for c in text.lower():
        m |= 1 << mask_bit(c)
    return m - (1 << 64) if m >> 63 else m


def mask_column(name: Column) -> Column:
    """Character mask of a name, bit by bit from its distinct characters."""
    code = lambda c: F.ascii(c)
    bit = lambda c: F.when(c.between("a", "z"), code(c) - 97).when(c.between("0", "9"), code(c) - 22).otherwise(F.lit(36) + code(c) % 28)
    chars = F.array_distinct(F.filter(F.split(F.lower(name), ""), lambda c: c != ""))
    return F.aggregate(chars, F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c).cast("int"))))


def mask_filter(mask: Column, pattern: Q.Pattern) -> Column:
    """Necessary condition of the pattern on a baked mask; sets with an inverse term say nothing."""
    has = lambda t: mask.bitwiseAND(F.lit(mask_of(t.text))) == F.lit(mask_of(t.text))
    tests = [reduce(lambda a, b: a | b, map(has, s)) for s in pattern.sets if not any(t.inverse for t in s)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def segmented_column(text: Column, pattern: Q.Pattern) -> Column:
    """Text with '|' matches if one of its segments does; terms don't straddle segments."""
    return F.exists(F.split(text, r"\|"), lambda s: pattern_column(s, pattern))


def boundary_bonus(name: Column, start: Column) -> Column:
    """Bonus of a match that starts at 1-based position start of a name of letters, digits, blanks and ASCII punctuation."""
    before, here = F.substring(name, start - 1, F.lit(1)), F.substring(name, start, F.lit(1))
    at_start = start == 1
    digit = here.rlike("^[0-9]")
    return (
        F.when(at_start | before.rlike(r"^\s"), BONUS_WHITE)
        .when(before.rlike(r"^[\\/:;,|]"), BONUS_DELIMITER)
        .when(~before.rlike(rf"^{WORD_CLASS}"), BONUS_BOUNDARY)
        .when(before.rlike("^[a-z]") & here.rlike("^[A-Z]") | digit & ~before.rlike("^[0-9]"), BONUS_CAMEL)
        .when(here.rlike(r"^\s"), BONUS_WHITE)
        .when(~here.rlike(rf"^{WORD_CLASS}"), BONUS_BOUNDARY)
        .otherwise(0)
    )


def clamp16(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(65535)).cast("int")


def position_point(name: Column, begin: Column) -> Column:
    """Rank field of a 0-based match start: 0 at the start, 256 + i at a word boundary, else 4096 + i."""
    before, here = F.substring(name, begin, F.lit(1)), F.substring(name, begin + 1, F.lit(1))
    boundary = ~before.rlike(rf"^{WORD_CLASS}") | before.rlike(r"^\p{Ll}") & here.rlike(r"^[\p{Lu}0-9]")
    return F.when(begin <= 0, 0).otherwise(clamp16(F.when(boundary, 256).otherwise(4096) + begin))
