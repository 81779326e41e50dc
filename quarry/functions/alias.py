"""Aliases of names in another alphabet: generation, acceptance, query segmentation, position maps.

The transliteration table is a parameter; SAMPLE_READINGS is a small hand-made one for tests, as no full table is
available.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import query as Q
from quarry.functions import scoring as S

#: A small sample of characters and their readings.
SAMPLE_READINGS: dict[str, tuple[str, ...]] = {"重": ("zhong", "chong"), "庆": ("qing",), "火": ("huo",), "锅": ("guo",), "北": ("bei",), "京": ("jing",), "烤": ("kao",), "鸭": ("ya",), "和": ("he", "hu", "huo"), "中": ("zhong",), "国": ("guo",)}
JOINT = "\u0002"
MAX_COMBINATIONS = 32
MAX_FORMS, MAX_QUERY, MAX_STEPS = 8, 32, 20_000
#: Fixed values of the acceptance gate.
SPAN_FACTOR, SPAN_LEAST, SCORE_FACTOR, TERM_SPAN_FACTOR, TERM_SPAN_LEAST, ANCHOR_LENGTH = 3, 20, 5, 4, 8, 3
INTERJECTIONS = {"a", "o", "e", "ai", "ei", "en", "ou", "ng"}


def acceptable(span: Column, score: Column, length: Column) -> Column:
    return (span <= F.greatest(length * SPAN_FACTOR, F.lit(SPAN_LEAST))) & (score >= length * SCORE_FACTOR)


def alias_score(score: Column, length: Column, span: Column) -> Column:
    return F.when(span > length, F.rint(score * length / span)).otherwise(score).cast("long")


def accepts(pattern: Q.Pattern, text: str, found: tuple[int, int, int]) -> bool:
    """The gate, with its second path: every positive set lands tightly in one segment and a long term anchors it."""
    n = pattern.term_length
    if found[1] - found[0] <= max(n * SPAN_FACTOR, SPAN_LEAST) and found[2] >= n * SCORE_FACTOR:
        return True
    positive = [[t for t in s if not t.inverse] for s in pattern.sets]
    positive = [s for s in positive if s]
    if len(positive) < 2 or not any(len(t.text) >= ANCHOR_LENGTH for s in positive for t in s):
        return False

    def tight(part: str, t: Q.Term) -> bool:
        m = S.term_match(part, t)
        return m is not None and m[1] - m[0] <= max(len(t.text) * TERM_SPAN_FACTOR, TERM_SPAN_LEAST)

    return any(all(any(tight(part, t) for t in s) for s in positive) for part in text.split("|"))


def best_alias(aliases: DataFrame, pattern: Q.Pattern) -> DataFrame:
    """(name, alias, alias_score): the best accepted alias of each name."""

    def run(texts: pd.Series) -> pd.Series:
        n = pattern.term_length
        out = []
        for x, m in zip(texts, S.pattern_matches(list(texts), pattern)):
            span = m[1] - m[0] if m else 0
            out.append((round(m[2] * n / span) if span > n else m[2]) if m and accepts(pattern, x, m) else None)
        return pd.Series(pd.array(out, "Int32"))

    score = F.pandas_udf(run, T.IntegerType()).asNondeterministic()
    each = aliases.select("alias").distinct().withColumn("alias_score", score("alias")).where("alias_score is not null")
    return aliases.join(each, "alias").groupBy("name").agg(F.max_by("alias", F.struct("alias_score", "alias")).alias("alias"), F.max("alias_score").alias("alias_score"))


@dataclass(frozen=True)
class AliasProvider:
    """Spellings of names, and of query terms; stored spellings of another version are made anew."""

    provider_id: int
    version: int
    spell: Callable[[str], list[str]]
    query_forms: Callable[[str], list[str]] = lambda term: []


def spelled(names: DataFrame, providers: list[AliasProvider]) -> DataFrame:
    """(name, provider_id, version, alias) of distinct names by all providers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, p.provider_id, p.version, a) for n in batch.column(0).to_pylist() if n is not None for p in providers for a in p.spell(n)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["name", "provider_id", "version", "alias"])

    return names.select("name").distinct().mapInArrow(run, "name string, provider_id int, version int, alias string")


def reconcile(stored: DataFrame, names: DataFrame, providers: list[AliasProvider]) -> DataFrame:
    """Stored aliases less those of other versions, providers or names, and the spellings of what has none in this version."""
    each = names.select("name").where("name is not null").distinct()
    current = reduce(lambda a, b: a | b, ((F.col("provider_id") == p.provider_id) & (F.col("version") == p.version) for p in providers), F.lit(False))
    kept = stored.where(current).join(each, "name", "left_semi")
    made = []
    for p in providers:
        have = kept.where(F.col("provider_id") == p.provider_id).select("name").distinct()
        made.append(spelled(each.join(have, "name", "left_anti"), [p]))
    return reduce(DataFrame.unionByName, made, kept.select("name", "provider_id", "version", "alias"))


def generate(name: str, readings: Mapping[str, tuple[str, ...]] = SAMPLE_READINGS) -> list[str]:
    """Initials alias and full alias: variants joined by '|', a joint mark between adjacent transliterated characters."""
    if not any(c in readings for c in name):
        return []
    if len(name) == 1:
        return ["|".join(readings[name])]
    pieces = [readings.get(c, (c,)) for c in name]
    full: list[str] = []
    initials: list[str] = []
    for n, combo in enumerate(product(*pieces)):
        if n >= MAX_COMBINATIONS:
            break
        text = ""
        for i, (c, r) in enumerate(zip(name, combo)):
            text += (JOINT if i and c in readings and name[i - 1] in readings else "") + r
        full.append(text)
        short = "".join(r[0] if c in readings else r for c, r in zip(name, combo))
        if short not in initials:
            initials.append(short)
    return ["|".join(initials), "|".join(full)]


def syllables_of(readings: Mapping[str, tuple[str, ...]] = SAMPLE_READINGS) -> set[str]:
    return {r for rs in readings.values() for r in rs}


def segment(query: str, syllables: Iterable[str]) -> list[list[str]]:
    """Ways to read a query as two or more syllables, the last perhaps half typed; fewest pieces, then fewest interjections."""
    known = set(syllables)
    prefixes = {s[:i] for s in known for i in range(1, len(s) + 1)}
    if not (2 <= len(query) <= MAX_QUERY) or not query.isascii() or not query.isalpha() or not query.islower():
        return []
    half = query not in prefixes
    found: list[list[str]] = []
    stack: list[tuple[int, tuple[str, ...]]] = [(0, ())]
    steps = 0
    while stack and steps < MAX_STEPS:
        steps += 1
        at, pieces = stack.pop()
        if at == len(query):
            if len(pieces) >= 2:
                found.append(list(pieces))
            continue
        for end in range(at + 1, min(at + 6, len(query)) + 1):
            piece = query[at:end]
            if piece in known or (half and end == len(query) and piece in prefixes):
                stack.append((end, (*pieces, piece)))
    return sorted(found, key=lambda p: (len(p), sum(x in INTERJECTIONS for x in p), p))[:MAX_FORMS]


def position_map(name: str, alias: str, readings: Mapping[str, tuple[str, ...]] = SAMPLE_READINGS) -> list[int] | None:
    """Source position of each alias character, or None if the alias isn't one of the name's."""
    plain = alias.replace(JOINT, "")
    if len(plain) == len(name) and all(a == c or any(r[0] == a for r in readings.get(c, ())) for a, c in zip(plain, name)):
        return list(range(len(name)))
    out: list[int] = []
    at = 0
    for i, c in enumerate(name):
        fit = next((r for r in sorted(readings.get(c, (c,)), key=len, reverse=True) if plain.startswith(r, at)), None)
        if fit is None:
            return None
        out += [i] * len(fit)
        at += len(fit)
    return out if at == len(plain) else None


def mixed_match(name: str, term: str, readings: Mapping[str, tuple[str, ...]] = SAMPLE_READINGS) -> tuple[int, int, int] | None:
    """A term that mixes source and alias letters: source runs literally, alias runs along readings; 16 a character."""
    if not (any(c in readings for c in term) and any(c.isascii() and c.isalpha() for c in term)):
        return None
    at, begin, i = 0, -1, 0
    while i < len(term):
        if term[i] in readings or not term[i].isascii():
            place = name.find(term[i], at)
            if place < 0:
                return None
            i, last = i + 1, place
        else:
            end = i
            while end < len(term) and term[end].isascii() and term[end] not in readings:
                end += 1
            run, used, last, place = term[i:end], 0, -1, -1
            for j in range(at, len(name)):
                for r in readings.get(name[j], (name[j],)):
                    k = used
                    for c in r:
                        k += k < len(run) and c == run[k]
                    if k > used:
                        place, used, last = (j if place < 0 else place), k, j
                        break
                if used == len(run):
                    break
            if used < len(run):
                return None
            i = end
        begin = place if begin < 0 else begin
        at = last + 1
    return begin, at, 16 * len(term)


def mixed_match_udf(term: str):
    def run(names: pd.Series) -> pd.DataFrame:
        found = [mixed_match(x, term) if x else None for x in names]
        return pd.DataFrame({k: pd.array([f[i] if f else None for f in found], "Int32") for i, k in enumerate(("begin", "end", "score"))})

    return F.pandas_udf(run, S.MATCH_TYPE).asNondeterministic()


def generate_udf():
    return F.pandas_udf(lambda s: s.map(lambda x: generate(x or "")), T.ArrayType(T.StringType())).asNondeterministic()


def segment_udf(syllables: Iterable[str]):
    """Query -> its best reading, syllables parted by blanks; empty without one."""
    known = set(syllables)

    def run(queries: pd.Series) -> pd.Series:
        return queries.map(lambda q: " ".join((segment(q or "", known) or [[]])[0])).astype(object)

    return F.pandas_udf(run, T.StringType())


def position_udf():
    """(name, alias) -> positions parted by commas, null where they don't belong together."""

    def run(names: pd.Series, aliases: pd.Series) -> pd.Series:
        found = [position_map(n, a) if n and a else None for n, a in zip(names, aliases)]
        return pd.Series([None if x is None else ",".join(map(str, x)) for x in found], dtype=object)

    return F.pandas_udf(run, T.StringType())
