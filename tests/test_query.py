import pytest

from quarry.functions import query as Q


@pytest.mark.parametrize(
    "word,kind,text,inverse",
    [("abc", Q.FUZZY, "abc", False), ("'abc", Q.EXACT, "abc", False), ("'abc'", Q.BOUNDARY, "abc", False), ("^abc", Q.PREFIX, "abc", False), ("abc$", Q.SUFFIX, "abc", False), ("^abc$", Q.EQUAL, "abc", False), ("!abc", Q.EXACT, "abc", True), ("!'abc", Q.FUZZY, "abc", True), ("!^abc", Q.PREFIX, "abc", True), ("!abc$", Q.SUFFIX, "abc", True)],
)
def test_terms(word, kind, text, inverse):
    t = Q.parse_term(word)
    assert (t.kind, t.text, t.inverse) == (kind, text, inverse)


def test_pattern_structure():
    p = Q.parse_pattern("a b | c d:rest !x")
    assert p.drive == "d"
    assert [[t.text for t in s] for s in p.sets] == [["a"], ["b", "c"], ["rest"], ["x"]]
    assert p.term_length == 1 + 1 + 4
    assert Q.parse_pattern("README").sets[0][0].case_sensitive
    assert Q.parse_pattern("'two words' end").sets[0][0] == Q.Term(Q.BOUNDARY, "two words")
    assert Q.parse_pattern("bolt", fuzzy=False).sets[0][0].kind == Q.EXACT
    assert Q.parse_pattern("'bolt", fuzzy=False).sets[0][0].kind == Q.FUZZY


@pytest.mark.parametrize(
    "raw,path_mode,drive,exact,ends",
    [("readme", False, None, "", False), ("c: readme", False, "c", "", False), ("c:\\foo\\bar\\", True, "c", "c:/foo/bar", True), ("c:/foo/bar", True, "c", "c:/foo/bar", False), ("c\\foo", True, "c", "c:/foo", False), ("C:\\", True, "c", "c:/", True)],
)
def test_parse_query(raw, path_mode, drive, exact, ends):
    q = Q.parse_query(raw)
    assert (q.path_mode, q.drive, q.exact_path, q.ends_with_separator) == (path_mode, drive, exact, ends)


def test_box():
    assert Q.split_tokens("abc :.txt,s-") == Q.BoxQuery("abc", (".txt", "s-"), False)
    assert Q.split_tokens("abc :a,,b") == Q.BoxQuery("abc :a,,b", (), False)
    assert Q.split_tokens("*abc").bypass
    assert Q.lines_to_or("a\n\n b \n") == "a | b"
    assert Q.keyword_gate("Bm foo bar", "bm") == "foo bar" and Q.keyword_gate("x foo", "bm") is None
