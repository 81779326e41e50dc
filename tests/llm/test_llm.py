"""The training-data operators against brute force, libraries, round trips and held-out rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import chat_format, common, decontamination, html_extraction, language_id, quality_classifier, quality_rules, queries, sentencepiece_bpe, simhash, substring_dedup, suffix_array, warc_fixity
from quarry.llm.fm_index import FMIndex, suffix_order

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int"


def docs_of(spark, texts, ids=None):
    """With extra columns whose names clash with the operators' own."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in zip(ids, texts)], DOCS)


AWKWARD = [None, "", " ", "\n\t", "a", "Ünïcödé ☃ " * 30, "x" * 5000, "word " * 400, "a b c d e", "a b c d e", "\x00\x01 nul", "日本語のテキスト" * 40]


def operators(spark):
    model = queries.model_path()
    bench = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "")], "item_id long, text string")
    net = quality_classifier.fit([b"good text here", b"### $$$ !!!"] * 4, np.array([1, 0] * 4, np.float32))
    centroids = language_id.fit(language_id.count_vectors([b"the cat", b"der hund"]), ["en", "de"])
    return {
        "rules": quality_rules.quality_rules,
        "rules_keep": quality_rules.keep_good,
        "encode": lambda d: sentencepiece_bpe.encode(d, model),
        "digests": lambda d: sentencepiece_bpe.encode_digests(d, model),
        "decontaminate": lambda d: decontamination.decontaminate(d, bench),
        "clean": lambda d: decontamination.keep_clean(d, bench),
        "language": lambda d: language_id.identify(d, centroids),
        "classify": lambda d: quality_classifier.classify(d, net),
        "substring": substring_dedup.substring_dedup,
        "cut": substring_dedup.cut_repeats,
        "simhash": simhash.near_duplicates,
        "representatives": simhash.representatives,
    }


@pytest.mark.parametrize("name", ["rules", "rules_keep", "encode", "digests", "decontaminate", "clean", "language", "classify", "substring", "cut", "simhash", "representatives"])
def test_awkward_and_empty_tables(spark, name):
    op = operators(spark)[name]
    d = docs_of(spark, AWKWARD, [*range(len(AWKWARD) - 2), None, 0])
    n = op(d).count()
    whole = name not in ("rules_keep", "clean", "representatives")
    assert n == len(AWKWARD) if whole else n <= len(AWKWARD)
    assert op(d.limit(0)).count() == 0


def test_columns_that_clash_are_kept(spark):
    """Columns that bear the names of an operator's own come back as they were."""
    names = ["doc_id", "text", "_doc", "_tag", "_id", "fp", "spans", "c0", "wanted"]
    rows = [(i, f"a text of some words number {i} that differs " + "and passage " * 20, f"d{i}", i, None, 1.5, "s", "z", i) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc string, _tag int, _id string, fp double, spans string, c0 string, wanted int")
    for op in (quality_rules.keep_good, simhash.representatives, substring_dedup.cut_repeats, lambda d: decontamination.keep_clean(d, spark.createDataFrame([(1, "x y")], "item_id long, text string"))):
        out = op(df)
        assert out.columns == names
        for r in out.collect():
            assert tuple(r)[2:] == rows[r["doc_id"]][2:]
    assert substring_dedup.cut_repeats(df).count() == 4 and simhash.near_duplicates(df).count() == 4 and substring_dedup.substring_dedup(df).count() == 4


# ---- quality rules


def brute_rules(t):
    ws = (t or "").encode().split()
    n = len(ws)
    windows = [tuple(ws[i : i + 3]) for i in range(n - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 3))
    lines = [x for x in (t or "").encode().split(b"\n") if x.split()]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    symbols = sum(c in "#*$%&|<>" for c in t or "")
    return n, sum(len(w.decode()) for w in ws), symbols, dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_rules(spark):
    rng = random.Random(1)
    texts = [*AWKWARD, *(("\n" if rng.random() < 0.1 else " ").join(rng.choice(["a", "é", "b#", "c", "dd", "long"]) for _ in range(rng.randint(0, 150))) + rng.choice(["", "\nx y\nx y"]) for _ in range(40))]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_rules(t)
        assert not (r["base_failed"] and r["kept"])
    lines = ["é" * 30, "plain line of words", "é" * 30, "日本語"]
    assert abs(quality_rules.measure(["\n".join(lines).encode()])["line_coverage"][0] - 30 / sum(map(len, lines))) < 1e-12
    unique = " ".join(f"w{i}" for i in range(200))
    passage = " ".join(f"p{i}" for i in range(60))
    m = quality_rules.measure([unique.encode(), (passage + " " + unique + " " + passage + " " + passage).encode()])
    assert m["kept"].tolist() == [True, False]
    assert m["ngram_coverage"][0].max() == 0 and abs(m["ngram_coverage"][1][0] - 3 * sum(map(len, passage.split())) / m["word_chars"][1]) < 1e-9


# ---- SentencePiece


def test_pieces_equal_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    own = sentencepiece_bpe.PieceCodec(queries.model_path())
    rng = random.Random(3)
    for k in range(4000):
        t = "".join(rng.choice("abcdething  \t\n▁<>s0日本éñ☃\x00　.,") for _ in range(rng.randint(0, 40)))
        t = " " * rng.randint(0, 30) + t if k % 5 == 0 else t
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids)
    assert own.decode([1, 3 + 0xC3, 500, 2]) == lib.decode([1, 3 + 0xC3, 500, 2])


def test_pieces_of_a_long_unbroken_text():
    """Time in proportion to the text: 4 MB without a space, where a bitfield that is copied at each step takes minutes."""
    import time

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    own = sentencepiece_bpe.PieceCodec(queries.model_path())
    t = "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz", k=4_000_000))
    began = time.perf_counter()
    ids = own.encode(t)
    assert time.perf_counter() - began < 60
    assert ids == lib.encode(t, add_bos=True, add_eos=True)
    assert not any(len(c) > sentencepiece_bpe.MEMO_CHARS for c in own.memo)


# ---- decontamination


def brute_hits(raw, items):
    ws, hit, found = decontamination.words(raw), set(), set()
    for item, text in items:
        own = decontamination.words(text)
        for i in range(max(1, len(own) - 12) if own else 0):
            w = own[i : i + 13]
            for j in range(len(ws) - len(w) + 1):
                if ws[j : j + len(w)] == w:
                    found.add(item)
                    hit.update(range(j, j + len(w)))
    return len(hit), found


def scanned(texts, items, cut=1):
    """Shard of all texts, searched for the items in so many blocks."""
    import pyarrow as pa

    step = -(-len(items) // cut)
    windows = [decontamination.Windows(items[i : i + step]) for i in range(0, len(items), step)]
    anchors = decontamination.AnchorMap(1)
    for w in windows:
        anchors.add(w)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    return [shard for _, shard in decontamination.scan([batch], 0, anchors, lambda: windows)]


def test_decontamination():
    rng = random.Random(2)
    for k in range(90):
        v = [b"a", b"b", b"c", b"d", b"e" * 5000][: rng.randint(2, 5)]
        items = [(str(i), b" ".join(rng.choices(v, k=rng.randint(0, 18)))) for i in range(6)]
        texts = [b" ".join(rng.choices([*v, b"zz"], k=rng.randint(0, 80))) for _ in range(8)]
        texts[0] = b"x " + items[0][1] + b" " + items[1][1]
        for cut in (1, 2, 6):
            (shard,) = scanned(texts, items, cut)
            for t, s, f in zip(texts, shard.spans(), shard.items):
                assert (sum(b - a for a, b in s), f) == brute_hits(t, items)


def test_words_have_one_hash_wherever_they_stand(monkeypatch):
    rng = random.Random(3)
    made = [bytes(rng.choices(b"abc", k=rng.choice([1, 2, 3, 30, 200]))) for _ in range(300)]
    alone = [decontamination.Words([w]).hashes[0] for w in made]
    monkeypatch.setattr(decontamination, "_AT_ONCE", 64)
    monkeypatch.setattr(decontamination, "_LONG", 40)
    by_part = {w: decontamination.Words([w]).hashes[0] for w in made}
    together = decontamination.Words([b", ".join(made[:100]), b"", b" ".join(made[100:])])
    assert [together.word(i) for i in range(300)] == made and together.first.tolist() == [0, 100, 100, 300]
    assert together.hashes.tolist() == [by_part[w] for w in made]
    assert len({*alone}) == len({*made}) == len({*by_part.values()})


def test_many_blocks_cost_little_more_than_one(spark, sf_dir, monkeypatch):
    """One index a shard serves all blocks; the cost of a block is its lookup, not another pass over the texts."""
    import time

    texts = [(r[0] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rng = random.Random(5)
    items = [(str(i), b" ".join(decontamination.words(t)[:40])) for i, t in enumerate(texts[:200])]
    items += [(f"x{i}", b" ".join(b"w%d" % rng.randrange(5000) for _ in range(60))) for i in range(4000)]
    took, found = {}, {}
    for cut in (1, 40):
        step = -(-len(items) // cut)
        windows = [decontamination.Windows(items[i : i + step]) for i in range(0, len(items), step)]
        anchors = decontamination.AnchorMap(len(items) * 40)
        for w in windows:
            anchors.add(w)
        best = []
        for _ in range(3):
            began = time.perf_counter()
            shard = decontamination.Shard(texts, anchors)
            for w in windows:
                shard.search(w)
            spans = shard.spans()
            best.append(time.perf_counter() - began)
        took[cut], found[cut] = min(best), (spans, shard.items)
    assert found[1] == found[40] and sum(map(len, found[1][0])) > 100
    assert took[40] < 1.5 * took[1] + 0.1, took


def test_a_full_map_of_anchors_loses_nothing(monkeypatch):
    monkeypatch.setattr(decontamination, "MAP_BITS", 1 << 16)
    rng = random.Random(6)
    items = [(str(i), b" ".join(b"w%d" % rng.randrange(900) for _ in range(30))) for i in range(3000)]
    texts = [b"u v " + items[i][1] + b" y z" for i in range(0, 3000, 500)]
    (shard,) = scanned(texts, items, 3)
    for k, (t, s, f) in enumerate(zip(texts, shard.spans(), shard.items)):
        assert s == [(2, 32)] and str(500 * k) in f


def test_benchmark_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 2)  # so that items are parted too
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(15))) for i in range(5)], "item_id long, text string")
    docs = docs_of(spark, ["zz " + " ".join(f"w{i}x{j}" for j in range(15)) for i in range(5)] + ["clean text"])
    out = {r["doc_id"]: r for r in decontamination.decontaminate(docs, bench).collect()}
    assert all(out[i]["n_hit"] == 15 and out[i]["item_ids"] == [str(i)] and out[i]["contaminated"] for i in range(5))
    assert out[5]["n_hit"] == 0 and decontamination.keep_clean(docs, bench).count() == 1
    monkeypatch.setattr(decontamination, "CYCLE_BYTES", 100)  # and the texts go through the blocks in several cycles
    again = decontamination.decontaminate(docs, bench)
    assert {r["doc_id"]: r for r in again.collect()} == out
    common.dropped(again)  # the blocks go from the executors
    with pytest.raises(Exception, match="(?i)broadcast|destroyed"):
        again.collect()


def test_benchmark_items_that_repeat_or_lack_an_id(spark):
    phrase = " ".join(f"w{j}" for j in range(13))
    bench = spark.createDataFrame([(1, phrase, "x"), (1, "other words here", "x"), (1, phrase, "y"), (None, phrase, "x"), (2, None, "x"), (3, " .,", "x")], "item_id long, text string, doc_id string")
    docs = docs_of(spark, [phrase, "see other words here now", None, phrase.upper()], [0, 1, 2, 0])
    got = sorted(((r["doc_id"], r["n_hit"], r["item_ids"]) for r in decontamination.decontaminate(docs, bench).collect()), key=str)
    assert got == [(0, 13, ["", "1"]), (0, 13, ["", "1"]), (1, 3, ["1"]), (2, 0, [])]


def test_fm_index_locates_all():
    rng = np.random.default_rng(5)
    s = rng.integers(0, 4, 500)
    index = FMIndex(s, 4)
    phrases = rng.integers(1, 4, (40, 3))
    lo, hi = index.search(phrases, np.full(40, 3))
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(498) if (s[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want
    assert suffix_order(s).tolist() == sorted(range(500), key=lambda i: s[i:].tolist())


# ---- suffix arrays


def test_suffix_array_and_prefixes():
    rng = random.Random(5)
    for trial in range(120):
        n, k = rng.randint(1, 700), rng.choice([1, 2, 3, 5, 200])
        raw = bytes(rng.randrange(k) for _ in range(n))
        raw = (raw[:30] * 40)[:n] if trial % 3 == 0 else raw
        a = np.frombuffer(raw, np.uint8)
        sa = suffix_array.suffix_array(a)
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        lcp = suffix_array.permuted_common_prefixes(a, sa, 1000)
        for i, j in zip(sa[1:], sa):
            m = 0
            while i + m < n and j + m < n and raw[i + m] == raw[j + m]:
                m += 1
            assert lcp[i] == m


def brute_cut(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [48, 3])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(2, 9)))
    passage, loop = " ".join(word() for _ in range(60)), "ab" * 200
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 40))) + (passage if i % 3 else passage[50:260]) + " ".join(word() for _ in range(rng.randint(0, 40))) + (loop[: rng.randint(90, 400)] if i % 7 == 0 else "")) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 1000), (1003, passage)]
    df = docs_of(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(df).collect()}
    assert got == brute_cut(rows)
    texts = {r["doc_id"]: r for r in substring_dedup.cut_repeats(df).collect()}
    assert texts[1003]["text"] == "" and texts[1003]["n_chars"] == 0 and texts[1000]["text"] is None


# ---- SimHash


def brute_print(t):
    ws = (t or "").encode().lower().split()
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("crowd", [1024, 2])
def test_simhash(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash.bucket_links, "__defaults__", (simhash.RADIUS, crowd))
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijkl") + str(rng.randint(0, 30)) for _ in range(400)] for _ in range(12)]
    texts = [*AWKWARD]
    for ws in base:
        for _ in range(10):
            own = list(ws)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = [brute_print(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for i, p in enumerate(prints):
        assert got[i]["fingerprint"] == f"{p:016x}" and got[i]["component_id"] == find(i)
    assert len({find(i) for i in range(len(texts))}) < len(texts) - 30


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    """A fingerprint that only null ids carry joins two that are out of reach of one another."""
    prints = [(7, 0), (None, 0b1111), (3, 0b11111111), (None, 1 << 40 | 0x7FFF << 20), (9, 0x7FFF << 44)]
    df = spark.createDataFrame([(i, fp) for i, fp in prints], "id long, fp long")
    got = {r["fp"]: (r["root"], r["rep"]) for r in simhash.grouped(df).collect()}
    assert got[0] == got[0b1111] == got[0b11111111] == (0, 3)
    assert got[prints[3][1]] == (prints[3][1], None) and got[prints[4][1]][1] == 9


def test_simhash_representatives_by_row(spark):
    a, b = ("one two three four five six " * 9).strip(), ("ten other words of a wholly different kind " * 9).strip()
    docs = docs_of(spark, [a, b, a, a, b, "alone of all these words here", "alone of all these words here"], [5, 5, None, 6, 8, None, None])
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.representatives(docs).collect()), key=str)
    assert kept == sorted([(5, a), (5, b), (None, "alone of all these words here")], key=str)


def test_simhash_odds_follow_correlation():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (4000, 16)).repeat(4, axis=1)
    bits = base ^ (rng.random((4000, 64)) < 0.05)
    together = (bits.T @ bits).astype(float)
    group = list(range(16))
    pairs = rng.integers(0, 4000, (200_000, 2))
    seen = (bits[pairs[:, 0]][:, group] != bits[pairs[:, 1]][:, group]).sum(1)
    odds = simhash._meeting_odds(group, np.diag(together) / 4000, together / 4000, 4)
    for t in range(5):
        assert 0.3 < odds[t] / max((seen <= t).mean(), 1e-4) < 3
    assert odds[0] > 20 * 0.5**16


def test_pigeonhole_thresholds():
    together = np.full((64, 64), 250.0)
    np.fill_diagonal(together, 500.0)
    for n in (10, 10**5, 10**9):
        plan = simhash.allocate(n, together * n / 1000)
        bits = [b for g, _ in plan for b in g]
        assert len(bits) == len(set(bits))
        # whatever four bits differ, some partition is within its threshold
        rng = random.Random(1)
        for _ in range(500):
            flip = set(rng.sample(range(64), 4))
            assert any(len(flip & set(g)) <= t for g, t in plan)


# ---- chat


def test_chat_layouts():
    asked = [("user", "q"), ("assistant", "a")]
    for line in ('{"prompt":"q","completion":"a"}', '{"instruction":"q","output":"a","id":7}', '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"question":"q","answer":"a"}'):
        assert chat_format.turns_of_json(line) == asked
    assert chat_format.turns_of_json('{"unknown":1}') == [] and chat_format.turns_of_json("{") == [] and chat_format.turns_of_json(None) == []
    assert chat_format.turns_of_json('{"instruction":"i","input":"x","output":"o"}')[0] == ("user", "i\n\nx")


def test_chat_layouts_are_selected_by_fingerprint(spark):
    """A subset test would take these records for messages, for prompts and for pairs; their fingerprints aren't in the table."""
    both = '{"messages":[{"role":"user","content":"q"}],"text":"t","role":"user"}'
    mixed = '{"prompt":"p","completion":"c","response":"r"}'
    strings = '{"instruction":"i","output":"o","messages":[{"content":"x","role":"y"}]}'
    for line in (both, mixed, strings):
        assert chat_format.turns_of_json(line) == [] and chat_format.fingerprint_of_json(line)
    # what no layout knows is taken away, what a layout declares may stand beside it
    assert chat_format.turns_of_json('{"role":"user","text":"t","prompt":"p","when":{"y":1}}') == [("user", "t")]
    for name, (needed, beside) in chat_format.LAYOUTS.items():
        assert chat_format.BY_PRINT[chat_format.fingerprint(needed)] == name == chat_format.layout_of({*needed, *beside, "more.x[]"})
    kind = spark.createDataFrame([], "conv_id long, turn long, role string, text string").schema
    assert chat_format.BY_PRINT[chat_format.fingerprint(chat_format.schema_paths(kind) & chat_format.KNOWN)] == "turn_rows"


def test_chat_records_that_stopped_the_job(spark):
    lines = ['{"role":"user","text":"\\ud800 x"}', '{"role":"\\udfff","text":"\\ud83d\\ude00"}', '{"messages[].content":"a","messages[].role":"b"}', '{"":{"role":"u","text":"t"}}', '{"a":{"":1},"role":"u","text":"t"}', '{"a.b":1,"a":{"b":2}}']
    df = spark.createDataFrame(list(enumerate(lines)), "conv_id long, record string")
    got = {r["conv_id"]: (r["turn"], r["role"], r["text"], r["layout"]) for r in chat_format.convert_records(df).collect()}
    assert got[0] == (0, "user", "\ufffd x", "turn_rows") and got[1] == (0, "\ufffd", "😀", "turn_rows")
    assert got[2] == got[3] == got[5] == (None, None, None, None) and got[4] == (0, "u", "t", "turn_rows")
    assert chat_format.fingerprint_of_json(lines[5]) == chat_format.fingerprint(["a\\.b", "a.b"])


def test_chat_tables_and_round_trip(spark):
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", tricky), (1, 0, "user", "<||x<|"), (2, 0, None, None), (None, 5, "user", "z"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    turns = chat_format.canonical_turns(spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, piece string"))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\n<||x<|\nassistant\n{tricky}\n".encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(tricky.encode()).hexdigest() and got[1]["loss_chars"] == len(tricky)
    assert got[2]["n_turns"] == 1 and got[None]["n_turns"] == 1
    assert got[3]["loss_sha256"] == hashlib.sha256(b"ab").hexdigest()
    for role, text in (("a\nb", "x"), ("<|nl|>", "<|im_end|>\n"), ("user", "<" * 5 + "|")):
        assert chat_format.parse(chat_format.format_turn(role, text)[0]) == [(role, text)]
    clashing = spark.createDataFrame([(4, 0, "user", "t", "p", "c")], "conv_id long, turn long, role string, text string, prompt string, input string")
    assert [tuple(r) for r in chat_format.canonical_turns(clashing).collect()] == [(4, 0, "user", "t")]
    nested = spark.createDataFrame([(9, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<`from`:string,value:string>>")
    assert [tuple(r) for r in chat_format.canonical_turns(nested).orderBy("turn").collect()] == [(9, 0, "user", "q"), (9, 1, "assistant", "a")]


def test_long_conversation_leaves_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PIECE_CHARS", 200)
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} " * 5) for i in range(200)]
    turns = chat_format.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    pieces = chat_format.format_conversations(turns)
    assert pieces.count() > 20
    r = chat_format.read_back(pieces).first()
    assert r["n_turns"] == 200 and r["loss_sha256"] == hashlib.sha256("".join(t for _, _, x, t in rows if x == "assistant").encode()).hexdigest()


def test_chat_records_of_mixed_layouts(spark):
    lines = ['{"role":"user","text":"a"}', '{"messages":[{"role":"user","content":null},{"role":"x","content":["p"]},3]}', '{"prompt":5,"completion":null,"new":{"deep":[1]}}', "{", None, "[1]", "", '{"messages":[]}', "[" * 100_000, '{"unknown":1}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"z"}],"id":"7"}']
    df = spark.createDataFrame([(i, x, "t") for i, x in enumerate(lines)] + [(None, lines[0], "t"), (0, lines[0], "t")], "conv_id long, record string, text string").repartition(3)
    got = {}
    for r in chat_format.convert_records(df).collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"], r["layout"]))
    assert got[None] == [(0, "user", "a", "turn_rows")] and got[0] == got[None] * 2
    assert sorted(got[2]) == [(0, "user", "5", "prompt_completion"), (1, "assistant", "", "prompt_completion")]
    assert sorted(got[10]) == [(0, "user", "q", "from_value"), (1, "assistant", "z", "from_value")]
    assert all(got[i] == [(None, None, None, None)] for i in (3, 4, 5, 6, 7, 8, 9))
    assert chat_format.fingerprint_of_json('{"a":1,"b":{"c":[{"d":2}]}}') == chat_format.fingerprint(["a", "b.c[].d"])
    assert chat_format.fingerprint_of_json(lines[2]) != chat_format.fingerprint_of_json('{"prompt":5,"completion":null}')
    assert chat_format.convert_records(df.limit(0)).count() == 0


def test_pieces_read_back_in_any_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chat_format, "PIECE_CHARS", 50)
    rows = [(c, i, "assistant" if i % 2 else "user", f"turn {i} of {c}") for c in range(5) for i in range(30)]
    pieces = chat_format.format_conversations(chat_format.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    pieces.repartition(7, "piece").write.parquet(f"{tmp_path}/pieces")
    again = chat_format.read_back(spark.read.parquet(f"{tmp_path}/pieces"))
    key = lambda r: r["conv_id"]
    assert sorted(again.collect(), key=key) == sorted(chat_format.read_back(pieces, ordered=True).collect(), key=key) and again.count() == 5
    assert chat_format.read_back(pieces.limit(0)).count() == 0 and chat_format.format_conversations(pieces.limit(0).selectExpr("conv_id", "piece turn", "formatted role", "formatted text")).count() == 0


# ---- WARC


def test_fixity(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(5000)] + [(None, None, None), (3, "http://h/3", None)]
    other = [p for p in pages if p[0] != 17]
    other = [(i, u, "bad") if i in (5, 4999) else (i, u, h) for i, u, h in other] + [(70000, "x", "y")]
    kind = "page_id long, url string, html string"
    a, b = (warc_fixity.records(spark.createDataFrame(x, kind).repartition(3)) for x in (pages, other))
    got = warc_fixity.audit(a, b).collect()
    assert {(r["id"], r["status"]) for r in got if r["status"] != "ok"} == {(17, "missing"), (5, "corrupt"), (4999, "corrupt"), (70000, "extra")}
    assert len(got) == len(pages) + 1
    first = sorted((r for r in got if r["shard"] == 0), key=lambda r: r["offset"])
    assert first[0]["offset"] == 0 and all(x["offset"] + x["length"] == y["offset"] for x, y in zip(first, first[1:]))
    empty = spark.createDataFrame([], kind)
    assert warc_fixity.audit(warc_fixity.records(empty), warc_fixity.records(empty)).count() == 0


def test_fixity_of_hot_slots_and_large_ids(spark):
    big = (1 << 53) + 1
    pages = [(None, f"u{i % 7}", "x" * (i % 3)) for i in range(300)] + [(5, None, None)] * 4 + [(5, "u", "y")] + [(big + 4096 * i, "u", "z") for i in range(-2, 3)] + [(-3, "u", "z")]
    kind = "page_id long, url string, html string"
    recs = warc_fixity.records(spark.createDataFrame(pages, kind).repartition(4))
    shuffled = warc_fixity.records(spark.createDataFrame(pages[::-1], kind).repartition(3))
    got = warc_fixity.audit(recs, shuffled).collect()
    assert len(got) == len(pages) and {r["status"] for r in got} == {"ok"}
    assert {r["shard"] for r in got} == {(p[0] if p[0] is not None else -1) // 4096 for p in pages}
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r)
    for rows in by_shard.values():
        rows.sort(key=lambda r: r["offset"])
        assert [(r["slot"], r["length"], r["digest"]) for r in rows] == sorted((r["slot"], r["length"], r["digest"]) for r in rows)
        assert rows[0]["offset"] == 0 and all(x["offset"] + x["length"] == y["offset"] for x, y in zip(rows, rows[1:]))
    less = warc_fixity.audit(recs, warc_fixity.records(spark.createDataFrame(pages[1:], kind))).collect()
    assert {(r["id"], r["status"]) for r in less if r["status"] != "ok"} == {(-1, "corrupt")}


# ---- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="<p>no</p>";</script></head><body>
<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap"><main><article><h1>Head &amp; {0}</h1><p>First   <b>bold</b>
text {0}.</p><aside>Aside</aside><p>Second &eacute;<br>line {0}</p><ul><li>One</li><li>Two</li></ul><div class="ad">Buy</div></article>
<section id="comments"><p>A reader says</p></section></main><div class="sidebar">Side</div></div><form><input><p>Mail</p></form><footer>&copy; host</footer></body></html>"""
WANT = "Head & {0}\nFirst bold text {0}.\nSecond é\nline {0}\nOne\nTwo"


def test_html(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(8)]
    rows += [(100, "http://b.example/", "<body><p>Only text</p><footer>x</footer>"), (101, None, None), (102, "http://a.example/z", ""), (103, "not a url", "plain < text"), (0, "http://a.example/0", PAGE.format(0))]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, slot string")
    out = html_extraction.extract(df).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    for i in range(8):
        assert got[i] == WANT.format(i)
    assert got[100] == "Only text" and got[101] == "" and got[102] == "" and got[103] == "plain < text"
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_html_slot_from_template_alone(spark):
    """No article or main element: the slot comes from the classes of tokens that all pages of the host share."""
    page = "<html><body><div id=top><span>Brand line of the site</span></div><div id=content><div id=story><p>{0}</p></div></div><div id=foot2><p>Fixed</p></div></body></html>"
    df = spark.createDataFrame([(i, f"http://c.example/{i}", page.format(f"story number {i} " * (3 + i))) for i in range(6)], "page_id long, url string, html string")
    found = html_extraction.templates(html_extraction.occurrence_vectors(df))
    assert found.where("token like '%div.story'").count() == 1
    for r in html_extraction.extract(df).collect():
        assert r["text"] == (f"story number {r['page_id']} " * (3 + r["page_id"])).strip()


def test_html_left_out_end_tags_and_deep_nesting():
    text = html_extraction.main_text
    assert text("<html><head><title>T</title><body><p>One<p>Two", None) == "One\nTwo"
    assert text("<title>T</title><p>One<table><tr><td>a<td>b<tr><td>c</table>d<option>e<p>f", None) == "One\na\nb\nc\nde\nf"
    assert text("<p>a<script>var x = '<p>no'", None) == "a"
    assert text('<article><header class="entry-header"><h1>H</h1></header><p>x</p><article class="comment">no</article></article>', None) == "H\nx"
    assert text('<article class="post"><h1>H</h1><div class="w-1/2 body"><p>x</p></div></article><p>y', "article.post") == "H\nx"
    for deep in ("<div class=a>" * 30_000 + "x" + "</div>" * 30_000, "<tr><td>x" * 20_000, "<p>x<b>" * 30_000, "</div><option>" * 30_000 + "<p>x", "<a b='" * 20_000 + "<p>x"):
        vector = html_extraction.page_vector(deep)
        assert sum(len(k) for k in vector) < 60_000_000 and isinstance(text(deep, None), str)
    assert html_extraction.page_vector("<div><p>ab</p><div>c</div></div>d")[""][1] == 4


def test_html_slot_widens_to_its_article(spark):
    page = "<html><body><nav><a>m</a></nav><article class=post><h1>Head {0}</h1><div class=body><p>{1}</p></div></article></body></html>"
    df = spark.createDataFrame([(i, f"http://d.example/{i}", page.format(i, f"words of {i} " * 20)) for i in range(5)], "page_id long, url string, html string")
    slots = html_extraction.main_slots(html_extraction.templates(html_extraction.occurrence_vectors(df))).collect()
    assert [r["slot"] for r in slots] == ["html/body/article.post"]
    assert all(r["text"] == f"Head {r['page_id']}\n" + (f"words of {r['page_id']} " * 20).strip() for r in html_extraction.extract(df).collect())


def _bare(i, article, menu="menu {0} of many", box=""):
    """A page without article or main elements and without names."""
    return f"<html><body><div><ul><li>{menu.format(i)}</li></ul></div><div><h1>Head {i}</h1>{article}{box}</div><div>host line {i % 3}</div></body></html>"


def test_html_slot_without_names(spark):
    """Sibling regions are told apart by their place alone; with the slot dropped all regions come out."""
    rows = [(i, f"http://e.example/{i}", _bare(i, f"<p>{'words of %d and more ' % i * 20}</p>")) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_extraction.extract(df).collect()}
    for i, _, page in rows:
        want = f"Head {i}\n" + ("words of %d and more " % i * 20).strip()
        assert found[i] == want
        assert html_extraction.main_text(page, None) != want


def test_html_page_with_other_siblings(spark):
    """A box more or less before the nameless slot moves its place; the fullest of its siblings is taken then."""
    rows = [(i, f"http://s.example/{i}", _bare(i, f"<p>{'words of %d and more ' % i * 20}</p>")) for i in range(20)]
    rows[3] = (3, rows[3][1], rows[3][2].replace("<body>", "<body><div>one more box</div>"))
    rows[4] = (4, rows[4][1], rows[4][2].replace("<div><ul><li>menu 4 of many</li></ul></div>", ""))
    found = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Head {i}\n" + ("words of %d and more " % i * 20).strip() for i in range(20))


def test_html_text_that_the_host_repeats_goes(spark):
    box = "<div><p>Please register to read on</p></div>"
    rows = [(i, f"http://f.example/{i}", _bare(i, f"<p>{'words of %d and more ' % i * 9}</p>", box=box)) for i in range(20)]
    # copies of one article aren't template text, however many of the host's pages they are
    rows += [(100 + i, f"http://g.example/{i}", _bare(i, "<p>the very same article " * 9)) for i in range(20)]
    rows += [(200 + i, f"http://k.example/{i}", _bare(0, "<p>one and the same page</p>", menu="m")) for i in range(20)]
    out = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Head {i}\n" + ("words of %d and more " % i * 9).strip() for i in range(20))
    assert all(out[100 + i].count("the very same article") == 9 and "menu" not in out[100 + i] for i in range(20))
    assert all("one and the same page" in out[200 + i] for i in range(20))


def test_html_names_mark_only_as_a_whole():
    """Words of the list inside other names, at hyphens or not, take nothing from an article."""
    kept = ['class="sharing-economy"', 'class="related-work"', 'class="search-results-analysis"', 'class="social-history"', 'id="alert-level"', 'class="menus-of-the-world lead"', 'role="note"']
    gone = ['class="ad"', 'class="site-nav"', 'class="comment-list"', 'id="cookie_notice_box"', 'class="x share-buttons"', 'class="lead sidebar"', 'role="navigation"', 'class="ad-slot-3"']
    page = "<article><h1>H</h1>%s<p>end</p></article>"
    assert html_extraction.main_text(page % "".join(f"<p {a}>k{i}</p><div {a}>d{i}</div>" for i, a in enumerate(kept)), None) == "\n".join(["H", *(f"{c}{i}" for i in range(len(kept)) for c in "kd"), "end"])
    assert html_extraction.main_text(page % "".join(f"<p {a}>k{i}</p><div {a}>d{i}</div>" for i, a in enumerate(gone)), None) == "H\nend"


@pytest.mark.parametrize("n", [3, 5, 15, 16, 30])
def test_html_notices_go_on_hosts_of_any_size(spark, n):
    """Nothing switches at a number of pages: a nameless notice that all pages of a host have in their article goes."""
    page = '<html><body><div id="x"><h1>Head {0}</h1><div class="box"><p>Please register to read on</p></div><p>Words of page {0} {1}</p><div class="q"><p>Buy now</p></div></div></body></html>'
    rows = [(i, f"http://h{n}.example/{i}", page.format(i, "and more " * 12)) for i in range(n)]
    # two pages that share a passage aren't a template
    rows += [(100 + i, "http://two.example/", page.format(i, "more " * 9)) for i in range(2)]
    out = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Head {i}\nWords of page {i} " + ("and more " * 12).strip() for i in range(n))
    assert all("Please register" in out[100 + i] for i in range(2))


def test_html_long_lists_keep_their_places():
    """Containers of one label are told apart however many there are."""
    page = "<body><div>" + "".join(f"<div><p>{i}</p></div>" for i in range(80)) + "</div></body>"
    tokens = [t for t in html_extraction.page_vector(page) if "/=" in t]
    assert len({t.rpartition("/=")[0] for t in tokens}) == 80


def brute_text(pages, n):
    """The main text of a host's pages, deduced from whole vectors of nested div and p pages, without sums or tables."""
    import re as r

    blocks = [[(m[1], m[2]) for m in r.finditer(r"<p data=(\w+)>([^<]*)</p>", p)] for p in pages]
    count = {}
    for own in blocks:
        for b in own:
            count.setdefault(b, []).append(own)
    share = lambda b: len(count[b]) >= max(3, 0.8 * n) and len({str(o) for o in count[b]}) > 1
    return ["\n".join(t for k, t in own if not share((k, t))) for own in blocks]


@pytest.mark.parametrize("n", [3, 4, 6, 20])
def test_html_text_against_brute_force(spark, n):
    rng = random.Random(n)
    fixed = [f"fixed {k} " + "x " * rng.randint(1, 4) for k in "abc"]
    pages = []
    for i in range(n):
        parts = [f"<div class=c{k}><p data=k{k}>{t.strip()}</p></div>" for k, t in enumerate(fixed)]
        own = [f"<div class=m{j}><p data=own>page {i} part {j} {' '.join(rng.choices('abcdefgh', k=30))}</p></div>" for j in range(3)]
        pages.append("<body><div class=top><h1></h1>" + own[0] + parts[0] + own[1] + parts[1] + own[2] + parts[2] + "</div></body>")
    df = spark.createDataFrame([(i, f"http://b{n}.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    out = [r["text"] for r in html_extraction.extract(df).orderBy("page_id").collect()]
    assert out == brute_text(pages, n)


def test_html_vectors_against_brute_force(spark):
    """Occurrence vectors and classes: tokens have one vector exactly if they occur equally often on every page."""
    rng = random.Random(4)
    rows = [(i, f"http://h{i % 2}.example/{i}", "<html><body>" + "".join(rng.choice(["<div class=a><p>x</p></div>", "<ul><li>y</li></ul>", "<p>z</p>", f"<h2>t{rng.randint(0, 2)}</h2>"]) for _ in range(rng.randint(1, 6))) + "<div class=b><p>end</p></div></body></html>") for i in range(24)]
    found = html_extraction.occurrence_vectors(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    counts = {}
    for i, url, page in rows:
        for token, (n, chars, _) in html_extraction.page_vector(page).items():
            counts.setdefault((html_extraction.host_of(url), token), {})[i] = (n, chars)
    counts = {k: v for k, v in counts.items() if len(v) > 1 or "/=" not in k[1]}
    got = {(r["host"], r["token"]): r for r in found}
    assert set(got) == set(counts)
    for k, v in counts.items():
        assert (got[k]["n_pages"], got[k]["n_chars"]) == (len(v), sum(c for _, c in v.values()))
        for j, w in counts.items():
            alike = {i: n for i, (n, _) in v.items()} == {i: n for i, (n, _) in w.items()}
            assert (got[k]["vector"] == got[j]["vector"]) == alike or k[0] != j[0]


def test_html_marks_on_all_elements():
    text = html_extraction.main_text
    page = '<article><h1>H</h1><p class="advertisement">buy</p><p>one <span class="share">Share <span>it</span> now</span>two</p><h3 class="related">R</h3><p hidden>no</p><p class=notice>gone<p>kept<ul><li class="menu">m<li>item</ul><a class="social"><div>x</div>y</a> end</article>'
    assert text(page, None) == "H\none two\nkept\nitem\nend"
    assert text('<p>a <span class="ad">b', None) == "a"
    assert text('<p>a <img class="ad"> b</p>', None) == "a b"


def test_slots_are_found_alike_by_join_and_broadcast(spark, monkeypatch):
    page = '<html><body><div class="x"><p>short {0}</p></div><div class="y"><div class="z"><p>' + "the long text of page {0} " * 9 + "</p></div></div></body></html>"
    urls = [f"{u}{k}" for u in ("1http://h/", "http://[bad/", "http://a\tb.org/", "http://plain.org/") for k in range(4)] + [None]
    pages = spark.createDataFrame([(i, u, page.format(i)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    sent = sorted(map(tuple, html_extraction.extract(pages).collect()), key=lambda r: r[0])
    monkeypatch.setattr(html_extraction, "SLOTS_BYTES", -1)
    joined = sorted(map(tuple, html_extraction.extract(pages).collect()), key=lambda r: r[0])
    assert joined == sent and all("short" not in r[2] for r in sent)


# ---- classifiers


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    model = language_id.fit(language_id.count_vectors([b"the cat and the dog", b"der hund und die katze"] * 3), ["en", "de"] * 3)
    out = {r["doc_id"]: r for r in language_id.identify(docs_of(spark, [None, "123 !!", "the dog", "qqqq zzzz xxxx"]), model).collect()}
    assert [out[i]["lang_pred"] for i in range(3)] == ["und", "und", "en"] and out[3]["rejected"] and out[3]["lang_pred"] != "und"
    assert language_id.identify(docs_of(spark, ["abc"]), None).first()["lang_pred"] == "und"
    marks = language_id.identify(docs_of(spark, ["²½①", "½ 12", "ª", "٣"]), model).collect()
    assert [r["lang_pred"] == "und" for r in sorted(marks, key=lambda r: r["doc_id"])] == [True, True, False, True]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > np.mean([r["quality"] for r in got])
    assert quality_classifier.score_texts(None, [b"", b"x"]).tolist() == [0.5, 0.5]
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        c = quality_classifier.chunks_of(b"x" * n)
        assert c.shape[1] == 512 and (c.sum(0) > 0).sum() == min(n, 512) and len(c) * 448 + 64 >= n


def test_quality_sample_is_whole_and_bounded(spark, monkeypatch):
    """Rows bound the sample, not parts of texts: a mark at the end of a long text is learned from."""
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda texts, labels: seen.append((texts, labels.tolist())))
    long_text = "word " * 100_000 + "end"
    docs = docs_of(spark, [long_text, "b", "b", "c", None], [1, 2, 2, 2, 3])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    quality_classifier.train(docs, labels)
    assert seen[0] == ([long_text.encode(), *sorted([b"b", b"c"], key=lambda t: next(r[0] for r in spark.sql(f"select xxhash64('{t.decode()}')").collect())), b""], [1, 0, 0, 1])
    monkeypatch.setattr(quality_classifier, "SAMPLE_ROWS", 2)
    quality_classifier.train(docs, labels)
    assert len(seen[1][0]) == 2


def test_quality_training_on_awkward_rows(spark):
    docs = docs_of(spark, [*AWKWARD, "good words " * 9000, "### $$$ " * 9000])
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(len(AWKWARD) + 2)] + [(0, None, 0, "x"), (None, 1, 0, "x"), (5, 1, 0, "x"), (5, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    net = quality_classifier.train(docs, labels)
    assert np.isfinite(net.table).all() and quality_classifier.classify(docs, net).where("score between 0 and 1").count() == len(AWKWARD) + 2
    assert quality_classifier.train(docs.limit(0), labels) is None and quality_classifier.train(docs, labels.limit(0)) is None


# ---- pipeline


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Null ids, repeated rows, null and empty texts, an extra column; and an empty table."""
    import corpus_pipeline

    rng = random.Random(3)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n))
    good, other = fresh(120), fresh(120)
    rows = [(1, good), (1, good), (None, good), (None, other), (2, None), (3, ""), (4, " "), (5, "\u00e9" * 3000), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _doc int")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, fresh(20)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sorted((r["doc_id"] for r in out), key=str) == [1, None]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    rng = random.Random(12)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passage, item = fresh(60), fresh(30)
    texts = {i: fresh(120) for i in range(20)}
    texts[20] = texts[3]  # an exact copy
    texts[21] = texts[4].rsplit(" ", 1)[0] + " changed"  # a near copy
    texts[22], texts[23] = fresh(80) + " " + passage, fresh(80) + " " + passage
    texts[24] = fresh(100) + " " + item  # contaminated
    texts[25] = "spam " * 100
    texts[26] = None
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    import tempfile

    sf = tempfile.mkdtemp()
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == list(corpus_pipeline.COLUMNS)
        now = now.cache()
        kept.append({r["doc_id"]: r for r in now.collect()})
    assert set(kept[0]) == set(range(25))
    assert set(kept[1]) == set(range(25)) - {20, 21}
    assert passage not in kept[2][23]["text"] and passage in kept[2][22]["text"] and kept[2][5]["text"] == texts[5]
    assert set(kept[3]) == set(kept[2]) - {24}
    assert set(kept[4]) == set(kept[3])
    assert corpus_pipeline.run(spark, sf).count() == len(kept[4])
