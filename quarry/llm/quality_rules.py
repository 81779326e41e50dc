"""Quality rules by repetition coverage.

Rolling polynomial hashes of several n-gram lengths over a text's words, in numpy, give the share of characters that
lie inside n-grams found at least twice in the same text, and the share inside repeated lines. No row needs another
row, so there is no shuffle; texts are worked on in slices of bounded size.

Defined results: a null text is empty (no words, base_failed). White space alone has no words. Every input row gives
one output row, repeated rows and null ids included; other columns of the input are ignored. Windows of words are told
apart by 64-bit hashes within their text: of n words, the odds of a chance pair are below n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import portions, raw_texts, slices

#: n-gram length in words -> largest share of word characters inside repeated n-grams of that length.
MAX_COVERAGE = {5: 0.40, 7: 0.35, 10: 0.30}
#: Largest share of characters inside lines that repeat an earlier line.
MAX_LINE_COVERAGE = 0.40
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: Bytes of UTF-8 that begin no character.
_INNER_BYTES = bytes(range(0x80, 0xC0))
_BASE = np.uint64(0x9E3779B97F4A7C15)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "{id} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_coverage double, ngram_coverage array<double>, base_failed boolean, kept boolean"


def _code_points(raw: bytes) -> int:
    return len(raw.translate(None, _INNER_BYTES))


def _repeated(hashes: np.ndarray, doc: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """For each word: does it lie in an n-word window that its text holds at least twice?"""
    m = len(hashes)
    out = np.zeros(m, bool)
    if m < n:
        return out
    key = hashes[: m - n + 1].copy()
    for j in range(1, n):
        key *= _BASE
        key += hashes[j : m - n + 1 + j]
    inside = np.flatnonzero(np.arange(n, m + 1) <= ends[: m - n + 1])
    key = (key[inside] ^ (key[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key ^= (doc[inside].astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = inside[twice]
    step = np.zeros(m + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts and coverages of texts given as UTF-8."""
    split = [t.split() for t in texts]  # bytes.split() parts at 09-0D and 20
    n_words = np.array([len(w) for w in split], np.int64)
    flat = [w for ws in split for w in ws]
    m, k = len(flat), len(texts)
    doc = np.repeat(np.arange(k), n_words)
    ends = np.repeat(np.cumsum(n_words), n_words)
    hashes = np.fromiter(map(hash, flat), np.int64, m).view(np.uint64)
    if m:
        whole = np.frombuffer(b" ".join(flat) + b" ", np.uint8)
        lens = np.fromiter(map(len, flat), np.int64, m) + 1
        chars = np.add.reduceat(((whole & 0xC0) != 0x80).astype(np.int64), np.cumsum(lens) - lens) - 1
    else:
        chars = np.zeros(0, np.int64)
    total = np.bincount(doc, chars, k)
    lines, line_cover = np.zeros(k, np.int64), np.zeros(k)
    for i, t in enumerate(texts):
        own = [x for x in t.split(b"\n") if x.strip()]
        lines[i] = len(own) - len(set(own))
        if lines[i]:
            every = sum(map(_code_points, own))
            line_cover[i] = (every - sum(map(_code_points, set(own)))) / every
    out = {"n_words": n_words, "word_chars": total.astype(np.int64), "n_dup_lines": lines, "line_coverage": line_cover}
    out["n_symbols"] = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
    out["n_repeat_words"] = np.bincount(doc, _repeated(hashes, doc, ends, 3), k).astype(np.int64)
    out["ngram_coverage"] = np.stack([np.bincount(doc, chars * _repeated(hashes, doc, ends, n), k) / np.maximum(total, 1) for n in MAX_COVERAGE], 1)
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
    fine = (out["ngram_coverage"] <= np.array(list(MAX_COVERAGE.values()))).all(1) & (line_cover <= MAX_LINE_COVERAGE)
    out["kept"] = ~out["base_failed"] & fine
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts, coverages, base_failed and the verdict kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            ids, texts = batch.column(0), raw_texts(batch.column(1))
            for a, b in slices([len(t) for t in texts]):
                m = measure(texts[a:b])
                cover = pa.ListArray.from_arrays(np.arange(0, (b - a) * len(MAX_COVERAGE) + 1, len(MAX_COVERAGE), dtype=np.int32), pa.array(m["ngram_coverage"].ravel()))
                columns = [ids.slice(a, b - a).cast(pa.int64()), *(pa.array(m[c]) for c in COUNTS), pa.array(m["line_coverage"]), cover, pa.array(m["base_failed"]), pa.array(m["kept"])]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *COUNTS, "line_coverage", "ngram_coverage", "base_failed", "kept"])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA.format(id=id_col))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, at):
            texts = raw_texts(batch.column(at))
            kept = [measure(texts[a:b])["kept"] for a, b in slices([len(t) for t in texts])]
            yield batch.filter(pa.array(np.concatenate(kept or [np.zeros(0, bool)])))

    return docs.mapInArrow(run, docs.schema)
