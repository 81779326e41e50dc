"""Phrase mining against a brute-force count."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quarry.llm import phrase_mining

DOCS = "doc_id long, text string, lang string, phrase string, n int, f long"


def docs_of(spark, rows):
    """With extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, lang, "p", 1, 2) for i, (t, lang) in enumerate(rows)], DOCS)


def brute(rows, top, least, max_words):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    found = defaultdict(list)
    for (lang, ws), a in candidates.items():
        cuts = [(1_000_000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        inside = any(
            g == lang and len(ws) < len(longer) and any(longer[i : i + len(ws)] == ws for i in range(len(longer))) and 100 * b >= 50 * a for (g, longer), b in candidates.items()
        )
        if not inside:
            found[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, every in found.items() for rank, (s, a, p, left, right) in enumerate(sorted(every)[:top], 1))


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "B", "the", "The", "é", "x#", "long-word", "日本", "\x00", "q\x1cr"]
    said = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ".", "\n", "!", "\r", "\x0b"]) for _ in range(rng.randint(0, 60)))
    return [(rng.choice([said(), said(), None, "", " "]), rng.choice(["en", "en", "en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_collocations(spark, max_words):
    rows = texts(max_words)
    rows += rows[:5]  # repeats count each time
    got = phrase_mining.collocations(docs_of(spark, rows), top=25, least=3, max_words=max_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, 25, 3, max_words)
    assert len(want) > 20
    assert sorted(map(tuple, got.collect())) == want


def test_a_word_of_a_third_of_all_rows_is_dealt_out(spark):
    """Here all words are over the bound, so that each goes to several tasks; and the bound holds for their number."""
    rows = [("the cat the dog the cat the bird the cat sat", "en")] * 5 + [("lorem ipsum " + c, None) for c in "abcdefghij" * 3]
    d = docs_of(spark, rows)
    words = phrase_mining.word_counts(d)
    heavy = phrase_mining.heavy_words(words, 4)
    assert heavy["en", b"the"] > 1 and heavy["und", b"lorem"] > 1 and len(heavy) < 16
    assert sorted(map(tuple, phrase_mining.collocations(d, least=5).collect())) == brute(rows, 2000, 5, 3)


def test_slices_add_up(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "SLICE", 100)
    monkeypatch.setattr(phrase_mining, "CHUNK", 7)
    rows = texts(9)
    assert sorted(map(tuple, phrase_mining.collocations(docs_of(spark, rows), least=4).collect())) == brute(rows, 2000, 4, 3)


def test_nothing_to_mine(spark):
    d = docs_of(spark, [(None, None), ("", "en"), (" \t.", "en"), ("one two", "fr")])
    assert phrase_mining.collocations(d).count() == 0
    assert phrase_mining.collocations(d.limit(0)).count() == 0


def test_growth_of_a_part_keeps_small_counts():
    projection = [b"b c:2 d d\ne ", b"b d:7"]
    assert sorted(phrase_mining.grow(b"a", projection, 9, 3)) == [(b"a b", 2, 11), (b"a b d", 3, 9)]
    assert sorted(phrase_mining.grow(b"a", projection, 9, 3, part=True)) == [(b"a b", 2, 11), (b"a b d", 3, 9), (b"a e", 2, 1)]


def test_projection():
    head, shard, n, follow = next(phrase_mining.projections([b"A b c. a b c, A b\ta", b"b"]))
    assert list(zip(head.to_pylist(), shard.to_pylist(), n.to_pylist(), follow.to_pylist())) == [(b"a", 0, 3, b"b a c:2"), (b"b", 0, 3, b"a \nc :2")]
