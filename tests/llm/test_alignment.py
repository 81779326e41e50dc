"""Cross-tokenizer alignment against a token-by-token model that uses the libraries on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import token_alignment

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]


def docs_of(spark, texts, ids=None):
    """With extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, "x", 1, [2]) for i, t in zip(ids or range(len(texts)), texts)], "doc_id long, text string, block string, a int, place array<int>")


def brute(texts):
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    byte_of = {c: x for x, c in zip(range(256), token_alignment_alphabet())}
    said_a = {i: bytes(byte_of[c] for c in t) for t, i in a.get_vocab().items() if all(c in byte_of for c in t)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    counts, rows = Counter(), []
    for t in texts:
        whole = (" " + (t or "")).encode()
        x, y = a.encode(" " + t, add_special_tokens=False).ids if t else [], b.encode(t) if t else []
        p, q = [said_a[i] for i in x], [piece(i) for i in y]
        if not t or b"".join(p) != whole or b"".join(q) != whole:
            rows.append(None)
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ea, eb = ends(p), ends(q)
        links = [(i, j) for i, e in zip(x, ea) for j, f in zip(y, eb) if e == f]
        counts.update(links)
        common, groups, low = sorted(set(ea) & set(eb)), [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for i, f in zip(ids, es) if low < f <= e) for ids, es in ((x, ea), (y, eb))))
            low = e
        overlaps = sum(max(e - len(u), f - len(v)) < min(e, f) for u, e in zip(p, ea) for v, f in zip(q, eb))
        rows.append((len(x), len(y), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest(), overlaps))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(0, 0, 0, 0, 0, 0, "", 0) if r is None else (*r[:3], len(r[3]), sum(counts[x] == most[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), *r[4:]) for r in rows]


def token_alignment_alphabet():
    """Byte-level vocabularies write byte x as the character at place x."""
    fixed, more = [*range(33, 127), *range(161, 173), *range(174, 256)], iter(range(256, 512))
    return [chr(x) if x in fixed else chr(next(more)) for x in range(256)]


AWKWARD = [None, "", " ", "  ", "\n", "a", "the cat's 12 hats", "the cat's 12 hats", " lead and trail ", "two  spaces   here", "tab\tand\r\nline \n end", "Ünïcödé ☃ 日本語のテキスト", "mark▁inside", "<s>ok</s> <|endoftext|> <unk> <0x41>", "\x00\x01 nul", "no break 　 wide x", "x" * 2500, "don't DON'T we'll", "🙂🙃 emoji👩‍👩‍👧", "﻿bom ​zero"]


@pytest.mark.parametrize("block", [60, 300, 1 << 20])
def test_alignment(spark, monkeypatch, block):
    monkeypatch.setattr(token_alignment, "BLOCK", block)  # counts of many blocks add up
    rng = random.Random(block)
    alphabet = ["a", "e", "the", "ing", "é", "ß", "日", "1", ".", ",", "'s", "\n", "\t", "  ", "▁", "#", "\x85", "　", "☃"]
    made = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    texts = AWKWARD + made + made[:3]
    got = token_alignment.token_alignment(docs_of(spark, texts), JSON, MODEL)
    assert got.columns == NAMES
    want = brute(texts)
    assert sum(w[0] > 0 for w in want) > 25
    for r in got.collect():
        assert tuple(r)[1:] == want[r["doc_id"]], texts[r["doc_id"]]
    assert got.count() == len(texts)


def test_long_text_in_parts(monkeypatch):
    """The same alignment as of the whole text, wherever it is cut; a part that isn't spelled takes the text with it."""
    t = token_alignment.tokenizers(JSON, MODEL)
    rng = random.Random(2)
    text = " ".join(rng.choice(["the", "cat's", "日本", "x\ny", "12", "ing,", "#é"]) + rng.choice(["", "", " "]) for _ in range(3000)).encode()
    whole = token_alignment.align([text], t)
    for size in (150, 1500, 1 << 20):
        monkeypatch.setattr(token_alignment, "BLOCK", size)
        got = token_alignment.align_long(text, t)
        assert got["texts"].to_pydict() == whole["texts"].to_pydict()
        assert got["sha256"] == [hashlib.sha256(whole["groups"][0][:-1]).hexdigest()]
        counts = Counter()
        for a, b, n in zip(*(got["pairs"][c].to_pylist() for c in "abn")):
            counts[a, b] += n
        assert counts == {(a, b): n for a, b, n in zip(*(whole["pairs"][c].to_pylist() for c in "abn"))}
        assert got["stretch_links"][got["place"]].sum() == whole["texts"]["n_links"][0].as_py() and got["text_places"].sum() == len(got["place"])
    monkeypatch.setattr(token_alignment, "BLOCK", 500)
    assert token_alignment.align_long(text + " mark▁inside ".encode() + text, t) is None


def test_ids_that_repeat_or_are_null(spark):
    texts = ["one two", "one two", "three", None]
    got = token_alignment.token_alignment(docs_of(spark, texts, [7, 7, None, None]), JSON, MODEL).collect()
    assert sorted((r["doc_id"] or -1, r["n_a"]) for r in got) == [(-1, 0), (-1, 1), (7, 2), (7, 2)]
    best = next(r for r in got if r["doc_id"] == 7)
    assert best["count_sum"] == 4 and best["n_best"] == 2


def test_empty_tables(spark):
    d = docs_of(spark, [None, "", "▁"])
    assert [tuple(r)[1:] for r in token_alignment.token_alignment(d, JSON, MODEL).collect()] == [(0, 0, 0, 0, 0, 0, "", 0)] * 3
    assert token_alignment.token_alignment(d.limit(0), JSON, MODEL).count() == 0


def test_long_unbroken_text():
    t = token_alignment.tokenizers(JSON, MODEL)
    found = token_alignment.align([b"ab" * 200_000, "日本".encode() * 5000], t)
    assert found["texts"]["n_a"].to_pylist()[0] > 1000


def test_blocks_are_stored_in_small_rows(spark, monkeypatch):
    """No row and no list grows with a block or with a text, and slices of stretches align as all do at once."""
    text = " ".join(f"word{i % 4000}, and" for i in range(60_000))
    want = token_alignment.align([text.encode()], token_alignment.tokenizers(JSON, MODEL))
    monkeypatch.setattr(token_alignment, "ALIGNED", 100)
    got = token_alignment.align([text.encode()], token_alignment.tokenizers(JSON, MODEL))
    assert got["texts"].equals(want["texts"]) and got["groups"] == want["groups"] and got["pairs"].equals(want["pairs"])
    assert all((got[c] == want[c]).all() for c in ("link_pair", "stretch_links", "place", "text_places"))
    stored = token_alignment.aligned_blocks(docs_of(spark, [text, text]), JSON, MODEL)
    for field in stored.schema:
        assert field.dataType.typeName() not in ("array", "map", "struct"), field
    longest = max(len(r["data"]) for r in stored.where("data is not null").select("data").collect())
    assert longest <= 4 * token_alignment.PIECE < len(want["place"]) * 4
