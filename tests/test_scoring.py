import random

import pytest

from quarry.functions import alias as A
from quarry.functions import query as Q
from quarry.functions import scoring as S


@pytest.mark.parametrize(
    "text,query,hit",
    [("report", "rpt", True), ("report", "tpr", False), ("my report", "'port", True), ("my report", "'port'", False), ("my report", "'report'", True), ("  lead", "^lead", True), ("trail  ", "trail$", True), (" same ", "^same$", True), ("README", "README", True), ("readme", "README", False), ("b", "b | !a", True), ("a b", "b | !a", True), ("a b", "!a | b", False), ("ab|cd", "'ab 'cd", False), ("ab cd|x", "'ab 'cd", True)],
)
def test_matches(text, query, hit):
    assert (S.pattern_match(text, Q.parse_pattern(query)) is not None) == hit


def test_scores():
    # first character doubles its bonus; consecutive ones carry the start's bonus
    assert S.term_match("bolt", Q.parse_term("'bolt"))[2] == 4 * 16 + 10 * 2 + 10 * 3
    assert S.fuzzy("bolt", "bolt")[:3] == (0, 4, 114)
    assert S.fuzzy("a_bolt", "b")[:3] == (2, 3, 16 + 8 * 2)
    assert S.term_match("x bolt y", Q.parse_term("'bolt'")) == (2, 6, 16 * 4 + 10 * 5 + 10)
    assert S.term_match("same", Q.parse_term("^same$"))[2] == 26 * 4 + 10
    assert S.bonus(S.LOWER, S.UPPER) == 7 and S.bonus(S.LETTER, S.NUMBER) == 7 and S.bonus(S.DELIMITER, S.LOWER) == 9


def placements(text, pattern, at=0):
    if not pattern:
        yield []
        return
    for i in range(at, len(text)):
        if text[i] == pattern[0]:
            for rest in placements(text, pattern[1:], i + 1):
                yield [i, *rest]


def earliest(text, term):
    at = [-1]
    for c in term:
        at.append(text.find(c, at[-1] + 1))
        if at[-1] < 0:
            return None
    return at[1:]


def model(text, term, scheme="default"):
    """(begin, end, score) cell by cell: a table of scores, gaps and runs over all columns, and the way back through it."""
    low = text.lower()
    first = earliest(low, term)
    if first is None:
        return None
    own, last, m = S.bonuses(text, scheme).tolist(), first[-1], len(term)
    if m == 1:
        every = [(own[i], i) for i, c in enumerate(low) if c == term]
        b, at = next((x for x in every if x[0] >= 8), max(every, key=lambda x: (x[0], -x[1])))
        return at, at + 1, 16 + 2 * b
    score, run, gap = {}, {}, {}
    for k in range(m):
        for j in range(first[k], last + 1):
            skip = score.get((k, j - 1), 0) + (-1 if gap.get((k, j - 1)) else -3)
            take = length = 0
            if low[j] == term[k] and k == 0:
                score[k, j], run[k, j], gap[k, j] = 16 + 2 * own[j], 1, False
                continue
            if low[j] == term[k]:
                b, length = own[j], run.get((k - 1, j - 1), 0) + 1
                if length > 1:
                    lead = own[j - length + 1]
                    length, b = (1, b) if b >= 8 and b > lead else (length, max(b, lead, 4))
                take = score.get((k - 1, j - 1), 0) + 16 + b
                length = 0 if take < skip else length
            score[k, j], run[k, j], gap[k, j] = max(take, skip, 0), length, take < skip or k == 0
    k, j, prefer = m - 1, last, True
    while k >= 0 and j >= first[k]:
        here, diagonal, left = score[k, j], score.get((k - 1, j - 1), 0) if k else 0, score.get((k, j - 1), 0)
        row = k
        if here > diagonal and (here > left or here == left and prefer):
            if k == 0:
                return j, last + 1, score[m - 1, last]
            k -= 1
        prefer = run.get((row, j), 0) > 1 or run.get((row + 1, j + 1), 0) > 0
        j -= 1
    return first[0], last + 1, score[m - 1, last]


@pytest.mark.parametrize("scheme", ["default", "path", "history"])
def test_alignments_against_the_table(scheme):
    """A whole batch at once, of texts of all lengths, with and without matches."""
    rng = random.Random(4)
    for letters, size in (("abAB1_ /", 12), ("ab c", 40), ("abc/1 éÉ:", 90), ("a b-", 25)):
        for term in ("ab", "ba", "aa", "b1", "abc", "aab", "abab", "c", "cba1", "éa"):
            texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, size))) for _ in range(150)]
            found = S.align(texts, term, scheme=scheme)
            assert [found.of(i) for i in range(len(texts))] == [model(t, term, scheme) for t in texts], (term, letters)


def test_fuzzy_against_all_placements():
    """Its places are a placement that ends where the term is first complete; no placement up to there scores more, and
    on most texts the best one scores the same."""
    rng = random.Random(5)
    same = total = 0
    for _ in range(1600):
        text = "".join(rng.choice("abAB1_ /") for _ in range(rng.randint(1, 11)))
        term = "".join(rng.choice("ab1") for _ in range(rng.randint(2, 4)))
        found, first = S.fuzzy(text, term), earliest(text.lower(), term)
        assert (found is None) == (first is None)
        if found:
            every = [p for p in placements(text.lower(), term) if p[-1] == first[-1]]
            assert found[3] in every and found[0] == found[3][0] and found[1] == first[-1] + 1
            best = max(S._score_of(text, p, p[-1] + 1, "default") for p in every)
            assert 0 < found[2] <= best
            total, same = total + 1, same + (found[2] == best)
    assert total > 200 and same > 0.8 * total


def test_tables_in_parts_agree(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 200))) for _ in range(80)]
    whole = S.align(texts, "abc")
    monkeypatch.setattr(S, "TABLE_CELLS", 100)
    parts = S.align(texts, "abc")
    assert whole.score.tolist() == parts.score.tolist() and whole.places == parts.places


@pytest.mark.parametrize(
    "query,text,hit",
    [  # shapes of a fuzzy finder's extended search
        ("foo", "f_o_o", True), ("foo", "fo", False), ("^foo", "foobar", True), ("^foo", "a foo", False), ("bar$", "foobar", True), ("bar$", "bar foo", False),
        ("^foo$", "foo", True), ("^foo$", "foo bar", False), ("!foo", "bar", True), ("!foo", "a foo", False), ("!^foo", "a foo", True), ("!bar$", "bar a", True),
        ("foo bar", "bar foo", True), ("foo bar", "foo", False), ("^a | ^b", "bc", True), ("^a | ^b", "cb", False), ("'a\\ b", "x a b", True), ("Foo", "foo", False), ("foo", "FOO", True), ("a !b | c", "ac", True),
    ],
)
def test_query_shapes(query, text, hit):
    assert (S.pattern_match(text, Q.parse_pattern(query)) is not None) == hit


def test_long_input_uses_greedy_scan():
    text = "x" * 300_000 + "abc"
    assert S.fuzzy(text, "ab")[1] == 300_002
    assert S.fuzzy("a" + "-" * 300_000 + "ab-b", "ab")[:3] == (300_001, 300_005, S.span_score("-ab-b", "ab", 1, 5))


def test_weight_and_marks():
    p = Q.parse_pattern("'ring")
    assert S.weight(S.marks("ring", p)) == 1.0
    assert abs(S.weight(S.marks("a ring", p)) - 4 / 6) < 1e-12
    assert S.runs(S.marks("ring ring", p)) == [(0, 4), (5, 9)]


def test_alias():
    assert A.generate("重庆")[0] == "zq|cq"
    assert "chong\u0002qing" in A.generate("重庆")[1]
    assert A.generate("plain") == []
    assert A.segment("beijing", A.syllables_of()) == [["bei", "jing"]]
    assert A.position_map("重庆", "chong\u0002qing") == [0] * 5 + [1] * 4
    assert A.position_map("北京", "xx") is None
    assert A.mixed_match("重庆", "重qing") == (0, 2, 80)
