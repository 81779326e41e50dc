"""Alignment scores, positions, highlight marks and weights of names.

Names are scored a batch at a time. A fuzzy term's alignments end where the term is first complete in the name; among
them the best local alignment counts. It is found by a sweep over the columns at which a character of the term stands,
all names side by side: the state of a name is, for each length of the term's head, the best score, whether a gap is
open, and length and first bonus of the run of matches that ends there. Columns between are told from their number,
as a score only falls there. Where a match begins is found by the same sweep backwards.

Literal terms, and fuzzy ones in texts too long for the sweep, are scored by where their characters stand.

Applied to distinct names only and through UDFs marked non-deterministic, so that the optimizer neither pushes them
below a distinct nor doubles them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import predicates as P
from quarry.functions import query as Q

#: Character classes, and above which term length or table size the greedy scan scores instead.
WHITE, NON_WORD, DELIMITER, LOWER, UPPER, LETTER, NUMBER = range(7)
DELIMITERS = "\\/:;,|"
MAX_PATTERN, MAX_CELLS = 1000, 250_000
#: Cells of the sweep's tables that are held at once.
TABLE_CELLS = 1 << 20

Match = tuple[int, int, int]


@lru_cache(maxsize=65536)
def char_class(c: str) -> int:
    if c.isspace():
        return WHITE
    if c in DELIMITERS:
        return DELIMITER
    if c.isascii():
        return LOWER if c.islower() else UPPER if c.isupper() else NUMBER if c.isdigit() else NON_WORD
    return LETTER if c.isalpha() else NON_WORD


def first_class(scheme: str) -> int:
    """Class that counts as standing before a text."""
    return DELIMITER if scheme == "path" else WHITE


@lru_cache(maxsize=8)
def bonus_table(scheme: str = "default") -> np.ndarray:
    """Bonus of a character by the class before it and its own."""
    white = P.BONUS_WHITE if scheme == "default" else P.BONUS_BOUNDARY
    table = np.zeros((7, 7), np.int32)
    table[:, NON_WORD] = table[:, DELIMITER] = P.BONUS_BOUNDARY
    table[LOWER, UPPER] = P.BONUS_CAMEL
    table[[c for c in range(7) if c != NUMBER], NUMBER] = P.BONUS_CAMEL
    table[NON_WORD, :] = P.BONUS_BOUNDARY
    table[DELIMITER, :] = P.BONUS_BOUNDARY if scheme == "history" else P.BONUS_DELIMITER
    table[WHITE, :] = table[:, WHITE] = white
    return table


def bonus(before: int, here: int, scheme: str = "default") -> int:
    return int(bonus_table(scheme)[before, here])


_CLASS_OF_CODE = np.full(0x110000, 255, np.uint8)


def classes(codes: np.ndarray) -> np.ndarray:
    """Classes of code points; a code is classed when it is first met."""
    new = codes[_CLASS_OF_CODE[codes] == 255]
    for c in set(new.tolist()):
        _CLASS_OF_CODE[c] = char_class(chr(c))
    return _CLASS_OF_CODE[codes]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def bonuses(text: str, scheme: str = "default") -> np.ndarray:
    own = classes(_codes(text))
    return bonus_table(scheme)[np.concatenate([[first_class(scheme)], own[:-1]]).astype(int)[: len(own)], own]


def _low(text: str, cased: bool) -> str:
    if cased:
        return text
    return text.lower() if text.isascii() else text.translate({ord(c): c.lower() for c in set(text) if len(c.lower()) == 1})


def _bonus_at(text: str, at: Sequence[int], scheme: str) -> list[int]:
    start = first_class(scheme)
    return [bonus(char_class(text[i - 1]) if i else start, char_class(text[i]), scheme) for i in at]


def placed_score(at: np.ndarray, own: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scores of terms whose characters stand at given places (rows) and have these bonuses, up to an end.

    A match counts its bonus, the first twice; within a run it counts the best bonus of the run so far, where only
    boundaries renew it, and CONSECUTIVE at least. Each gap costs by its length, the one before the end too."""
    lead = own[:, 0]
    total = P.SCORE_MATCH * at.shape[1] + P.FIRST_FACTOR * lead
    cost = lambda gap: np.where(gap > 0, P.GAP_START + (gap - 1) * P.GAP_EXTENSION, 0)
    for k in range(1, at.shape[1]):
        gap = at[:, k] - at[:, k - 1] - 1
        renewed = (gap > 0) | (own[:, k] >= P.BONUS_BOUNDARY) & (own[:, k] > lead)
        lead = np.where(renewed, own[:, k], lead)
        total = total + cost(gap) + np.where(gap > 0, own[:, k], np.maximum(np.maximum(own[:, k], lead), P.BONUS_CONSECUTIVE))
    return total + cost(end - at[:, -1] - 1)


def _score_of(text: str, at: Sequence[int], end: int, scheme: str) -> int:
    return int(placed_score(np.array([at]), np.array([_bonus_at(text, at, scheme)]), np.array([end]))[0])


def _greedy(folded: str, wanted: str, start: int = 0) -> list[int] | None:
    """The earliest places of the term's characters one after another."""
    at = []
    for c in wanted:
        start = folded.find(c, start) + 1
        if not start:
            return None
        at.append(start - 1)
    return at


def _latest_start(folded: str, wanted: str, end: int) -> int:
    """Where the shortest alignment that ends at `end` from the right begins."""
    for c in reversed(wanted):
        end = folded.rfind(c, 0, end)
    return end


def span_score(text: str, term: str, start: int, end: int, cased: bool = False, scheme: str = "default") -> int:
    """Score of a term's earliest places in text[start:end]; -1 if it isn't complete there."""
    at = _greedy(_low(text, cased), _low(term, cased), start)
    return _score_of(text, at, end, scheme) if at and at[-1] < end else -1


@dataclass
class Aligned:
    """Matches of one fuzzy term in a batch; score -1 where there is none. places[i] has text i's matched places."""

    begin: np.ndarray
    end: np.ndarray
    score: np.ndarray
    places: list[Sequence[int]]

    def of(self, i: int) -> Match | None:
        return (int(self.begin[i]), int(self.end[i]), int(self.score[i])) if self.score[i] >= 0 else None


def align(texts: Sequence[str], term: str, cased: bool = False, scheme: str = "default") -> Aligned:
    """The best alignment of a fuzzy term in each text."""
    n, m = len(texts), len(term)
    out = Aligned(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1 if m else 0, np.int64), [()] * n)
    wanted = _low(term, cased)
    swept: list[tuple[int, str, str, list[int]]] = []
    for i, text in enumerate(texts if m else ()):
        folded = _low(text, cased)
        found = _greedy(folded, wanted)
        if found is None:
            continue
        end = folded.rindex(wanted[-1]) + 1
        if m > MAX_PATTERN or (end - max(0, found[0] - 1)) * m > MAX_CELLS:
            found = _greedy(folded, wanted, _latest_start(folded, wanted, end))
            out.begin[i], out.end[i], out.score[i], out.places[i] = found[0], end, _score_of(text, found, end, scheme), found
        elif m == 1:
            every = [k for k, c in enumerate(folded) if c == wanted]
            own = _bonus_at(text, every, scheme)
            best = next((k for k, b in enumerate(own) if b >= P.BONUS_BOUNDARY), int(np.argmax(own)))
            out.begin[i], out.end[i], out.score[i], out.places[i] = every[best], every[best] + 1, P.SCORE_MATCH + P.FIRST_FACTOR * own[best], [every[best]]
        else:
            swept.append((i, text, folded, found))
    swept.sort(key=lambda x: x[3][-1] - x[3][0])
    at = 0
    while at < len(swept):  # texts of like length together, so that little is padding
        upto, wide = at, 0
        while upto < len(swept) and (upto == at or (upto - at + 1) * m * (wide := swept[upto][3][-1] - swept[upto][3][0] + 1) <= TABLE_CELLS):
            upto += 1
        _sweep(swept[at:upto], wanted, scheme, out)
        at = upto
    return out


def _columns(part: list[tuple[int, str, str, list[int]]], wanted: str, scheme: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The columns that count of each text, padded on the right: place (-1 is padding), bonus, character; and how many."""
    # a text's stretch, with the character before it for its class
    cut = [(max(0, f[0] - 1), f[-1] + 1) for _, _, _, f in part]
    raw = _codes("".join(t[a:b] for (_, t, _, _), (a, b) in zip(part, cut)))
    low = _codes("".join(t[a:b] for (_, _, t, _), (a, b) in zip(part, cut)))
    size = np.array([b - a for a, b in cut])
    begin = np.cumsum(size) - size
    own = classes(raw).astype(int)
    before = np.concatenate([[0], own[:-1]])
    before[begin] = first_class(scheme)
    row = np.repeat(np.arange(len(part)), size)
    place = np.arange(len(raw)) - begin[row] + np.array([a for a, _ in cut])[row]
    counts = np.isin(low, _codes(wanted)) & (place >= np.array([f[0] for _, _, _, f in part])[row])
    row, place, char, gain = row[counts], place[counts], low[counts], bonus_table(scheme)[before[counts], own[counts]]
    n = np.bincount(row, minlength=len(part))
    column = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    shape = (len(part), int(n.max()))
    padded = []
    for values, empty in ((place, -1), (gain, 0), (char, 0)):
        whole = np.full(shape, empty, np.int64)
        whole[row, column] = values
        padded.append(whole)
    return *padded, n


def _sweep(part: list[tuple[int, str, str, list[int]]], wanted: str, scheme: str, out: Aligned) -> None:
    place, gain, char, n = _columns(part, wanted, scheme)
    order = np.argsort(-n, kind="stable")  # longest first, so that the names still under way are the first rows
    place, gain, char, n = place[order], gain[order], char[order], n[order]
    names, m, steps = len(n), len(wanted), place.shape[1]
    heads = _codes(wanted).astype(np.int64)
    score, run, lead, fall = (np.zeros((steps + 1, names, m), np.int32) for _ in range(4))
    fall[0] = P.GAP_START  # what the next column costs if it is skipped
    reached = np.zeros((names, m + 1), bool)
    reached[:, 0] = True
    active = np.searchsorted(-n, -np.arange(steps), "left")  # names with more than so many columns

    def just_before(s: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distance of column s from the one before, and the scores in the column next to it."""
        d = (place[:k, s] - place[:k, s - 1] if s else np.full(k, 1 << 20))[:, None]
        return d, np.where(d == 1, score[s, :k], np.maximum(score[s, :k] + fall[s, :k] + (d - 2) * P.GAP_EXTENSION, 0))

    for s in range(steps):  # tables are one step ahead of columns: score[s + 1] is the state after column s
        k = active[s]
        d, near = just_before(s, k)
        own = gain[:k, s, None]
        skip = score[s, :k] + fall[s, :k] + (d - 1) * P.GAP_EXTENSION
        hit = (char[:k, s, None] == heads) & reached[:k, :-1]
        length = np.where(d == 1, run[s, :k, :-1], 0) + 1
        first = lead[s, :k, :-1]
        goes_on = (length > 1) & ~((own >= P.BONUS_BOUNDARY) & (own > first))
        take = np.zeros((k, m), np.int32)
        take[:, :1] = P.SCORE_MATCH + P.FIRST_FACTOR * own
        take[:, 1:] = near[:, :-1] + P.SCORE_MATCH + np.where(goes_on, np.maximum(np.maximum(own, first), P.BONUS_CONSECUTIVE), own)
        take = np.where(hit, take, 0)
        kept = take >= skip
        kept[:, 0] = hit[:, 0]  # a head of one character is matched wherever it stands
        score[s + 1, :k] = np.maximum(np.where(kept, take, skip), 0)
        fall[s + 1, :k] = np.where(kept, P.GAP_START, P.GAP_EXTENSION)
        run[s + 1, :k, 0] = hit[:, 0]
        run[s + 1, :k, 1:] = np.where(hit[:, 1:] & kept[:, 1:], np.where(goes_on, length, 1), 0)
        lead[s + 1, :k, :1] = own
        lead[s + 1, :k, 1:] = np.where(goes_on, first, own)
        reached[:k, 1:] |= hit
    # backwards: a column is taken if its score comes from neither neighbour; a tie goes to the run on the right
    every = np.arange(names)
    earliest = np.array([part[i][3] for i in order])
    taken = earliest.copy()  # what the way back doesn't reach stands where it can first stand
    head = np.full(names, m - 1)
    open_ = np.ones(names, bool)
    seen = head.copy()  # the row in which the column on the right was passed
    for s in range(steps - 1, -1, -1):
        k = active[s]
        rows = every[:k]
        i, p = head[:k], place[:k, s]
        open_[:k] &= (i >= 0) & (p >= earliest[rows, np.maximum(i, 0)])
        i = np.maximum(i, 0)
        _, near = just_before(s, k)
        here = score[s + 1, rows, i]
        left = near[rows, i]
        diagonal = np.where(i > 0, near[rows, np.maximum(i - 1, 0)], 0)
        gap = np.where(s + 1 < n[:k], place[:k, min(s + 1, steps - 1)] - p, 0)
        gap2 = np.where(s + 2 < n[:k], place[:k, min(s + 2, steps - 1)] - p, 0)
        was = seen[:k]
        up = lambda step, row: np.where(row < m - 1, run[min(step, steps), rows, np.minimum(row + 1, m - 1)] > 0, False)
        beside = (run[min(s + 2, steps), rows, was] > 1) | (gap2 == 2) & up(s + 3, was)
        prefer = np.where(s + 1 == n[:k], True, np.where(gap == 1, beside, (gap == 2) & up(s + 2, i)))
        take = open_[:k] & (here > diagonal) & ((here > left) | (here == left) & prefer)
        taken[rows[take], i[take]] = p[take]
        seen[:k] = i
        head[:k] = np.where(take, i - 1, head[:k])
    for row, i in enumerate(order.tolist()):
        at = part[i][0]
        out.begin[at], out.end[at], out.score[at], out.places[at] = taken[row, 0], earliest[row, -1] + 1, score[n[row], row, m - 1], taken[row].tolist()


def fuzzy(text: str, term: str, cased: bool = False, scheme: str = "default") -> tuple[int, int, int, list[int]] | None:
    """(begin, end, score, places) of the best alignment in one text."""
    found = align([text], term, cased, scheme)
    return (*found.of(0), list(found.places[0])) if found.score[0] >= 0 else None


def _occurrences(folded: str, wanted: str) -> Iterator[int]:
    at = folded.find(wanted)
    while at >= 0:
        yield at
        at = folded.find(wanted, at + 1)


def literal_match(text: str, term: Q.Term, scheme: str = "default") -> Match | None:
    """(begin, end, score) of an exact, boundary, prefix, suffix or equal term."""
    folded, wanted, n = _low(text, term.case_sensitive), _low(term.text, term.case_sensitive), len(term.text)
    span = lambda at: (at, at + n, _score_of(text, range(at, at + n), at + n, scheme))
    if term.kind in (Q.EXACT, Q.BOUNDARY):
        outside = lambda i: not 0 <= i < len(text) or char_class(text[i]) <= DELIMITER
        fits = [(_bonus_at(text, [at], scheme)[0], at) for at in _occurrences(folded, wanted)]
        if term.kind == Q.BOUNDARY:
            fits = [(b, at) for b, at in fits if b >= P.BONUS_BOUNDARY and outside(at - 1) and outside(at + n)]
        if not fits:
            return None
        # the first at a boundary, else the first of the best
        b, at = next((x for x in fits if x[0] >= P.BONUS_BOUNDARY), max(fits, key=lambda x: (x[0], -x[1])))
        return (at, at + n, P.SCORE_MATCH * n + P.BONUS_WHITE * (n + 1) + b) if term.kind == Q.BOUNDARY else span(at)
    left = 0 if wanted[0].isspace() else len(text) - len(text.lstrip())
    right = len(text) if wanted[-1].isspace() else len(text.rstrip())
    if term.kind == Q.EQUAL:
        return (left, left + n, (P.SCORE_MATCH + P.BONUS_WHITE) * n + P.BONUS_WHITE) if folded[left:right] == wanted else None
    at = left if term.kind == Q.PREFIX else right - n
    return span(at) if at >= 0 and folded.startswith(wanted, at) else None


def term_matches(texts: Sequence[str], term: Q.Term, scheme: str = "default") -> list[Match | None]:
    if term.kind == Q.FUZZY:
        found = align(texts, term.text, term.case_sensitive, scheme)
        return [found.of(i) for i in range(len(texts))]
    return [literal_match(t, term, scheme) for t in texts]


def term_match(text: str, term: Q.Term, scheme: str = "default") -> Match | None:
    return term_matches([text], term, scheme)[0]


def _set_hit(hits: list[tuple[Q.Term, Match | None]]) -> tuple[bool, Match | None]:
    """Whether a set of terms is met, and by which match. Terms are asked in order up to the first plain match; an
    inverse term that hits before it fails the set, one that doesn't meets it with nothing to count."""
    met = False
    for term, found in hits:
        if found and term.inverse:
            return False, None
        if found:
            return True, found
        met |= term.inverse
    return met, None


def pattern_matches(texts: Sequence[str], pattern: Q.Pattern, scheme: str = "default") -> list[Match | None]:
    """(begin, end, score) in each text; begin is -1 if only inverse terms decided. Of a text with '|', the best segment's."""
    parts = [(i, offset, s) for i, t in enumerate(texts) for offset, s in _segments(t)]
    segments = [s for _, _, s in parts]
    by_term = [[(t, term_matches(segments, t, scheme)) for t in terms] for terms in pattern.sets]
    out: list[Match | None] = [None] * len(texts)
    for j, (i, offset, _) in enumerate(parts):
        sets = [_set_hit([(t, found[j]) for t, found in terms]) for terms in by_term]
        if not all(met for met, _ in sets):
            continue
        hits = [hit for _, hit in sets if hit]
        score = sum(h[2] for h in hits)
        if out[i] is None or score > out[i][2]:
            out[i] = (min(h[0] for h in hits) + offset, max(h[1] for h in hits) + offset, score) if hits else (-1, -1, 0)
    return out


def _segments(text: str) -> Iterator[tuple[int, str]]:
    offset = 0
    for part in text.split("|"):
        yield offset, part
        offset += len(part) + 1


def pattern_match(text: str, pattern: Q.Pattern, scheme: str = "default") -> Match | None:
    return pattern_matches([text], pattern, scheme)[0]


def marks_of(texts: Sequence[str], pattern: Q.Pattern) -> list[np.ndarray]:
    """Characters that any plain term matches: all its literal occurrences, else a fuzzy term's places."""
    out = [np.zeros(len(t), bool) for t in texts]
    for term in (t for terms in pattern.sets for t in terms):
        if term.inverse or term.alias_form or not term.text:
            continue
        wanted, without = _low(term.text, term.case_sensitive), []
        for i, text in enumerate(texts):
            found = False
            for at in _occurrences(_low(text, term.case_sensitive), wanted):
                out[i][at : at + len(wanted)] = found = True
            if not found:
                without.append(i)
        if term.kind == Q.FUZZY and without:
            for i, places in zip(without, align([texts[i] for i in without], term.text, term.case_sensitive).places):
                out[i][list(places)] = True
    return out


def marks(text: str, pattern: Q.Pattern) -> np.ndarray:
    return marks_of([text], pattern)[0]


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(mask, np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def weight(mask: np.ndarray) -> float:
    """Share of the text that is marked, times how contiguous the marks are."""
    total = int(np.sum(mask))
    return total / len(mask) * (sum((b - a) ** 2 for a, b in runs(mask)) / (total * total)) if total else 0.0


MATCH_TYPE = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.IntegerType())])


def _frame(names: pd.Series, found: list[Match | None]) -> pd.DataFrame:
    """Matches as columns; null where a name is null or has none."""
    known = iter(found)
    rows = [None if x is None else next(known) for x in names]
    return pd.DataFrame({k: pd.array([r[i] if r else None for r in rows], "Int32") for i, k in enumerate(("begin", "end", "score"))})


def match_udf(pattern: Q.Pattern, scheme: str = "default"):
    """Name -> struct(begin, end, score), null without a match."""
    run = lambda names: _frame(names, pattern_matches([x for x in names if x is not None], pattern, scheme))

    def matches(names: pd.Series) -> pd.DataFrame:
        return run(names)

    return F.pandas_udf(matches, MATCH_TYPE).asNondeterministic()


def fuzzy_udf(term: str, cased: bool = False):
    """Text -> struct(begin, end, score) of one fuzzy term over all of it, '|' and line ends included; null without a match."""

    def matches(texts: pd.Series) -> pd.DataFrame:
        return _frame(texts, term_matches([x for x in texts if x is not None], Q.Term(Q.FUZZY, term, case_sensitive=cased)))

    return F.pandas_udf(matches, MATCH_TYPE).asNondeterministic()


def weights(names: Sequence[str | None], pattern: Q.Pattern) -> list[float]:
    return [weight(x) for x in marks_of([n or "" for n in names], pattern)]


def weight_udf(pattern: Q.Pattern):
    return F.pandas_udf(lambda names: pd.Series(weights(list(names), pattern), dtype=float), T.DoubleType()).asNondeterministic()


def best_weight_udf(pattern: Q.Pattern):
    """Texts -> the best weight of any of them."""

    def best(*columns: pd.Series) -> pd.Series:
        return pd.DataFrame({i: weights(list(c), pattern) for i, c in enumerate(columns)}).max(axis=1).astype(float)

    return F.pandas_udf(best, T.DoubleType()).asNondeterministic()


def ranges_udf(pattern: Q.Pattern):
    """Name -> [from, to, from, to, ...] of its highlighted characters."""
    return F.pandas_udf(lambda names: pd.Series([[i for r in runs(x) for i in r] for x in marks_of([n or "" for n in names], pattern)]), T.ArrayType(T.IntegerType())).asNondeterministic()


def weighted(score: Column, share: Column) -> Column:
    return F.when(share < 1, F.floor(score * share)).otherwise(score).cast("int")
