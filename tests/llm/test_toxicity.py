"""The toxicity classifier: held-out rows, pooling against brute force, thresholds, awkward rows."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string, score int, _id long"


def docs_of(spark, texts, ids=None):
    """With extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, "en", 1, 2) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def small_net(seed=3):
    rng = np.random.default_rng(seed)
    net = toxicity.fit([b"you are a vile pig", b"have a nice day"] * 6, np.array([1, 0] * 6, np.float32))
    net.embedding[:] = rng.normal(0, 1, net.embedding.shape)
    return net


def brute_log_odds(net, raw):
    """Word by word and filter by filter, without any of the module's sums."""
    kept = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in raw.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    vectors = [np.mean([net.embedding[i] for i in toxicity.word_ids(w)[0]], 0) for w in kept.split()]
    vectors = (vectors or [np.zeros(toxicity.DIM)]) + [np.zeros(toxicity.DIM)] * (toxicity.WIDTHS[-1] - 1)
    n = len(vectors) - toxicity.WIDTHS[-1] + 1
    top = [max(sum(vectors[i + j] @ f[j][:, k] for j in range(w)) for i in range(n)) for w, f in zip(toxicity.WIDTHS, net.filters) for k in range(toxicity.FILTERS)]
    return np.maximum(np.array(top) + net.bias, 0) @ net.weight + net.shift[0]


def test_pooling_against_brute_force(monkeypatch):
    net = small_net()
    texts = [b"", b"x", b"one two", "Ünïted wörds, AND ONE".encode(), b"a b c " * 50, b"... !!! ", bytes(range(256)), b"z" * 700 + b" tail"]
    want = [brute_log_odds(net, t) for t in texts]
    np.testing.assert_allclose([net.log_odds(net.pooled(toxicity.parts(t))) for t in texts], want, rtol=1e-4, atol=1e-4)
    monkeypatch.setattr(toxicity, "PART", 64)  # the words of a text come part after part
    texts = texts[:-2]  # the last two have runs longer than a part
    want = [brute_log_odds(net, t) for t in texts]
    np.testing.assert_allclose([net.log_odds(net.pooled(toxicity.parts(t))) for t in texts], want, rtol=1e-4, atol=1e-4)


def test_a_word_has_the_same_rows_wherever_it_stands():
    alone = toxicity.word_ids(b"idiots")
    assert (toxicity.word_ids(b"some IDIOTS, here")[1] == alone[0]).all()
    assert (toxicity.word_ids(b"idiot")[0, 1:2] == alone[0, 1:2]).all() and (toxicity.word_ids(b"idiot")[0, 0] != alone[0, 0]).all()


def test_threshold_by_f1():
    z, y = np.array([3.0, 2, 1, -1, -2]), np.array([1.0, 1, 0, 0, 0])
    assert toxicity.best_cut(z, y) == 1.5
    assert toxicity.best_cut(z - 2.5, y) == -1.0
    assert toxicity.best_cut(np.array([1.0, 1, -1]), np.array([1.0, 1, 0])) == 0.0
    assert toxicity.best_cut(np.array([2.0, 2, 2]), np.array([1.0, 0, 0])) == 1.0  # equal scores aren't parted


def test_thresholds_by_language(monkeypatch):
    monkeypatch.setattr(toxicity, "ENOUGH", 2)
    net = small_net()
    texts = [b"vile pig", b"pig vile pig", b"nice day", b"a day", b"good", b"good good"]
    toxicity.calibrate(net, texts, np.array([1, 1, 0, 0, 1, 0], np.float32), ["a"] * 4 + ["b"] * 2)
    assert set(net.cut) == {"", "a"}  # b has too few rows
    toxicity.calibrate(net := small_net(), texts[:2], np.ones(2, np.float32), ["a"] * 2)
    assert not net.cut


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op13_toxicity(spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    out = [r for r in rows if r["held_out"]]
    hit = sum(r["predicted"] and r["toxic"] for r in out)
    # about one toxic label in twenty is on a text without any toxic word
    assert hit / sum(r["toxic"] for r in out) > 0.85 and hit / sum(r["predicted"] for r in out) > 0.9
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_awkward_rows(spark):
    texts = [None, "", " ", "\n", "a", "a", "x" * 300_000, "you vile pig", "\x00", "日本語" * 50]
    d = docs_of(spark, texts, [*range(len(texts) - 1), None])
    net = small_net()
    got = toxicity.classify(d, net)
    assert got.columns == ["doc_id", "score"] and got.count() == len(texts)
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert scores[0] == scores[1] == scores[2] and scores[4] == scores[5]
    assert toxicity.classify(d.limit(0), net).count() == 0
    assert {r["score"] for r in toxicity.classify(d, None).collect()} == {0.5}


def test_training_on_awkward_labels(spark, monkeypatch):
    texts = ["you vile pig", "a nice day", "", None, "vile pig", "day nice", "nice"]
    d = docs_of(spark, texts, [1, 2, 3, 4, 5, 5, None])
    marks = [(1, 1, "x"), (1, 1, "x"), (2, 0, "x"), (3, None, "x"), (4, 0, "x"), (5, 1, "x"), (5, 0, "x"), (None, 1, "x"), (9, 1, "x"), (2, 7, "x")]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text string")
    got = toxicity.labelled_sample(d, labels, "toxic")
    assert sorted((r[0], r[2], r[3].decode()) for r in got) == [(1, 1, "you vile pig"), (2, 0, "a nice day"), (4, 0, ""), (5, 0, "day nice"), (5, 0, "vile pig"), (5, 1, "day nice"), (5, 1, "vile pig")]
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 20)  # a text that doesn't fit is left, those behind it are not
    assert sum(len(r[3]) for r in toxicity.labelled_sample(d, labels, "toxic")) <= 20
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 3)
    assert len(toxicity.labelled_sample(d, labels, "toxic")) <= 3
    assert toxicity.train(d, labels.limit(0)) is None
    one = toxicity.train(d, labels.where(F.col("toxic") == 1))
    assert toxicity.classify(d, one).count() == 7
