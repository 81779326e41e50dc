"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A text becomes a sequence of words, each the mean of the hashed embeddings of the word and of its beginnings. Filters of
several widths run over the words, each filter's largest response in the text is its pooled value, and a logistic layer
makes one probability of the pooled values. Whole texts are pooled, part after part, so memory doesn't follow their words.

The model learns from a sample of labelled rows that is bounded in rows and in bytes (SAMPLE_ROWS, SAMPLE_BYTES), with
Adam, the same rows and draws each time. One part in CALIBRATION of the sample isn't trained on; there the threshold of
each language is chosen, the language being what the nearest-centroid classifier says of the text. The score is the
probability after the language's threshold has been moved to 0.5. Scoring shuffles nothing; the model travels with the
task (about 2 MB).

Defined results: null and empty texts score as a text without words. Without labelled rows all scores are 0.5. Rows that
repeat id, text and label are learned from once; an id of several texts or labels counts once for each; rows without an
id or with a label other than 0 and 1 aren't learned from. A language not met in the sample, or too seldom, has the
common threshold. Unbroken runs of over PART bytes count as several words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import language_id
from quarry.llm.common import portions, raw_texts, slices

#: Bounds of the labelled sample that is learned from.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 64 << 20
CALIBRATION = 5
BUCKETS, DIM = 1 << 15, 12
WIDTHS, FILTERS = (1, 2, 3), 8
#: Bytes of a word's beginnings that have embeddings of their own; 0 is the whole word.
BEGINNINGS = (0, 4, 6, 8)
#: Bytes of text whose words are embedded at once.
PART = 1 << 18
STEPS, BATCH, RATE, DECAY = 300, 64, 0.01, 1e-3
#: Texts that must use an embedding for it to be learned, and the part of words that a training step leaves out.
MIN_TEXTS, DROP = 5, 0.3
#: Labelled rows of each kind that a language needs for a threshold of its own.
ENOUGH = 10
#: F1 that a threshold may lose for being nearer to the trained one; small sets choose by chance otherwise.
SLACK = 0.01

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)], np.uint8)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(PART + 1, _FACTOR | np.uint64(1), np.uint64))


def word_ids(raw: bytes) -> np.ndarray:
    """Embedding rows of each word of at most PART bytes of text: one column for each of BEGINNINGS."""
    text = _FOLD[np.frombuffer(raw, np.uint8)]
    inside = np.concatenate([[0], (text != 32).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    # a hash of a run is the sum of its bytes times powers, moved to one place for all runs
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(text)])])
    shift = _POWERS[PART - starts]
    found = np.empty((len(starts), len(BEGINNINGS)), np.int64)
    for j, size in enumerate(BEGINNINGS):
        stop = np.minimum(starts + size, ends) if size else ends
        h = (total[stop] - total[starts]) * shift + np.uint64(size)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        found[:, j] = (h >> np.uint64(32)).astype(np.int64) % BUCKETS
    return found


def parts(raw: bytes) -> Iterator[np.ndarray]:
    """word_ids of a whole text, cut at spaces."""
    at = 0
    while at < len(raw):
        end = at + PART
        if end < len(raw) and (cut := raw.rfind(b" ", at, end)) > at:
            end = cut + 1
        yield word_ids(raw[at:end])
        at = end


@dataclass
class ToxicNet:
    embedding: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray
    weight: np.ndarray
    shift: np.ndarray
    cut: dict[str, float] = field(default_factory=dict)  # language -> threshold, in log odds
    languages: language_id.Centroids | None = None

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        out = self.embedding[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            out = out + self.embedding[ids[:, j]]
        return out / np.float32(ids.shape[1])

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each filter at each place, by width; x has the words, with empty ones behind them."""
        n = len(x) - WIDTHS[-1] + 1
        return [sum(x[j : j + n] @ f[j] for j in range(w)) for w, f in zip(WIDTHS, self.filters)]

    def pooled(self, ids: Iterator[np.ndarray]) -> np.ndarray:
        """Largest response of each filter in a text whose words come part after part."""
        top = np.full(len(self.bias), -np.inf, np.float32)
        empty = np.zeros((WIDTHS[-1] - 1, DIM), np.float32)
        last = np.zeros((0, DIM), np.float32)
        for part in ids:
            x = np.concatenate([last, self.vectors(part)])
            if len(x) >= WIDTHS[-1]:
                top = np.maximum(top, np.concatenate([r.max(0) for r in self.responses(x)]))
                x = x[len(x) - WIDTHS[-1] + 1 :]
            last = x
        x = np.concatenate([last if len(last) else empty[:1], empty])
        return np.maximum(top, np.concatenate([r.max(0) for r in self.responses(x)]))

    def log_odds(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.weight + self.shift[0]


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> ToxicNet | None:
    """Learns from texts and their 0/1 labels; see calibrate() for thresholds."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    width = len(WIDTHS) * FILTERS
    net = ToxicNet(rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), [rng.normal(0, 1 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(width, np.float32), np.abs(rng.normal(0, 0.3, width)).astype(np.float32), np.zeros(1, np.float32))
    share = float(np.clip(labels.mean(), 0.02, 0.98))
    net.shift[0] = np.log(share / (1 - share))
    params = [net.embedding, *net.filters, net.bias, net.weight, net.shift]
    first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    ids = [np.concatenate([*parts(t), np.zeros((0, len(BEGINNINGS)), np.int64)]).astype(np.int32) for t in texts]
    # a row that few texts use would learn those texts by heart: it stays at zero
    seen = np.zeros(BUCKETS, np.int32)
    for x in ids:
        seen[np.unique(x)] += 1
    known = (seen >= MIN_TEXTS)[:, None]
    net.embedding *= known
    kinds = [x for x in (np.flatnonzero(labels == v) for v in (0, 1)) if len(x)]
    rare = min(kinds, key=len)
    drawn = BATCH // 3  # from the rarer label, with weights that undo it
    pad = WIDTHS[-1] - 1
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(rare, drawn), rng.integers(0, len(texts), BATCH - drawn)])
        odds = np.where(np.isin(pick, rare), drawn / len(rare), 0) + (BATCH - drawn) / len(texts)
        importance = (BATCH / len(texts)) / odds
        sizes = np.array([max(1, len(ids[i])) + pad for i in pick])
        first = np.cumsum(sizes) - sizes
        rows = np.zeros((sizes.sum(), len(BEGINNINGS)), np.int32)
        real = np.zeros(len(rows), bool)
        for at, i in zip(first, pick):
            rows[at : at + len(ids[i])] = ids[i]
            real[at : at + len(ids[i])] = rng.random(len(ids[i])) >= DROP
        x = net.vectors(rows) * real[:, None]
        places = np.zeros((len(pick), width), np.int64)
        top = np.empty((len(pick), width), np.float32)
        for r, at in zip(net.responses(x), range(0, width, FILTERS)):
            for k, (a, n) in enumerate(zip(first, sizes - pad)):
                own = r[a : a + n]
                where = own.argmax(0)
                places[k, at : at + FILTERS] = a + where
                top[k, at : at + FILTERS] = own[where, np.arange(FILTERS)]
        live = top + net.bias > 0
        p = 1 / (1 + np.exp(-np.clip(net.log_odds(top), -30, 30)))
        d = ((p - labels[pick]) * importance / len(pick)).astype(np.float32)
        back = d[:, None] * net.weight * live
        grads = [np.zeros_like(p) for p in params]
        for w, f, g, at in zip(WIDTHS, net.filters, grads[1 : 1 + len(WIDTHS)], range(0, width, FILTERS)):
            text_no, filter_no = np.nonzero(back[:, at : at + FILTERS])
            value, place = back[text_no, at + filter_no], places[text_no, at + filter_no]
            for j in range(w):
                np.add.at(g[j].T, filter_no, value[:, None] * x[place + j])
                dx = value[:, None] * f[j][:, filter_no].T * real[place + j, None] / len(BEGINNINGS)
                for c in range(len(BEGINNINGS)):
                    np.add.at(grads[0], rows[place + j, c], dx)
            g += DECAY * f
        grads[0] *= known
        grads[-3], grads[-2], grads[-1] = back.sum(0), np.maximum(top + net.bias, 0).T @ d + DECAY * net.weight, np.array([d.sum()], np.float32)
        for q, g, m, v in zip(params, grads, first_moment, second_moment):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        net.embedding *= np.float32(1 - DECAY)
    return net


def best_cut(z: np.ndarray, labels: np.ndarray) -> float:
    """The threshold nearest to 0 among those whose F1 is within SLACK of the largest; thresholds lie midway between scores."""
    order = np.argsort(-z, kind="stable")
    ranked, hits = z[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + labels.sum())
    f1[:-1][ranked[:-1] == ranked[1:]] = -1  # equal scores aren't parted
    below = np.append(ranked[1:], ranked[-1] - 2)
    good = f1 >= f1.max() - SLACK
    # any value between two scores will do; the midpoint, or 0 where it lies between them
    cuts = np.where((below[good] < 0) & (ranked[good] > 0), 0.0, (ranked[good] + below[good]) / 2)
    return float(cuts[np.abs(cuts).argmin()])


def calibrate(net: ToxicNet, texts: list[bytes], labels: np.ndarray, languages: list[str]) -> None:
    """Sets the threshold of each language with ENOUGH rows of both labels, and a common one under ''."""
    if not len(labels) or labels.min() == labels.max():
        return
    z = np.array([net.log_odds(net.pooled(parts(t))) for t in texts])
    net.cut[""] = best_cut(z, labels)
    for lang in sorted(set(languages)):
        own = np.array([x == lang for x in languages])
        if min((labels[own] == 1).sum(), (labels[own] == 0).sum()) >= ENOUGH:
            net.cut[lang] = best_cut(z[own], labels[own])


def text_languages(model: language_id.Centroids | None, texts: list[bytes]) -> list[str]:
    """What the text's own n-grams say; no column is asked."""
    if model is None:
        return ["" for _ in texts]
    found: list[str] = []
    for a, b in slices([max(len(t), language_id.DIM) for t in texts]):
        found += [model.languages[j] for j in model.predict(language_id.count_vectors(texts[a:b]))[0].tolist()]
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int, bytes]]:
    """(id, text hash, label, text) of at most SAMPLE_ROWS distinct rows that have a 0/1 label and SAMPLE_BYTES of text: in
    the order of their id's hash, those that still fit. Texts are hashed only where a label was picked."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    picked = marked.distinct().orderBy(F.xxhash64("_id"), "_id", "_label").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    found = texts.select("_id", "_label", F.coalesce("_text", F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    order = (F.xxhash64("_id"), "_id", "_label", "_h")
    sizes = found.select("_id", "_label", "_h", F.octet_length("_text").alias("_n")).distinct().orderBy(*order).limit(SAMPLE_ROWS).collect()
    room, kept = SAMPLE_BYTES, []
    for r in sizes:
        if r["_n"] <= room:
            room -= r["_n"]
            kept.append((r["_id"], r["_label"], r["_h"]))
    if not kept:
        return []
    sample = docs.sparkSession.createDataFrame(kept, "_id long, _label int, _h long")
    rows = found.join(F.broadcast(sample), ["_id", "_label", "_h"]).groupBy("_id", "_label", "_h").agg(F.first("_text").alias("_text")).toLocalIterator()
    return sorted((r["_id"], r["_h"], r["_label"], r["_text"].encode()) for r in rows)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> ToxicNet | None:
    """Learns from labelled rows of docs; languages are learned from docs too, and are told from text alone afterwards."""
    rows = labelled_sample(docs, labels, label_col, id_col, text_col)
    if not rows:
        return None
    out = np.array([r[1] % CALIBRATION == 0 for r in rows])  # by text, so that copies are on one side
    texts, y = [r[3] for r in rows], np.array([r[2] for r in rows], np.float32)
    use = np.flatnonzero(~out) if (~out).any() else np.arange(len(rows))
    net = fit([texts[i] for i in use], y[use])
    net.languages = language_id.train(docs, id_col, text_col, lang_col)
    left = np.flatnonzero(out)
    calibrate(net, [texts[i] for i in left], y[left], text_languages(net.languages, [texts[i] for i in left]))
    return net


def score_texts(net: ToxicNet | None, texts: list[bytes]) -> np.ndarray:
    """Probabilities, 0.5 at the threshold of the text's language."""
    if net is None:
        return np.full(len(texts), 0.5)
    z = np.array([net.log_odds(net.pooled(parts(t))) for t in texts])
    common = net.cut.get("", 0.0)
    cut = np.array([net.cut.get(x, common) for x in text_languages(net.languages, texts)])
    return 1 / (1 + np.exp(-np.clip(z - cut, -30, 30)))


def classify(docs: DataFrame, net: ToxicNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            ids = batch.column(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(score_texts(sent.value, raw_texts(batch.column(1))), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, score double")
