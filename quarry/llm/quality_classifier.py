"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. Learned filters, one weight for each offset and byte value,
run over every chunk; each filter's largest response in a chunk is its pooled value. The chunks' pooled vectors combine
into their largest and their mean, and a logistic layer makes one probability of both.

Trained by Adam on at most SAMPLE_ROWS labelled rows, the same rows and draws each time. A training step sees all
chunks of its texts, as scoring does; the driver holds the sample's texts, whole, and a step's chunks PART at a time.
Scoring covers the whole text of every row and shuffles nothing; the filters travel with the task.

Defined results: null and empty texts score as a text of padding alone. Without rows to learn from, all scores are 0.5.
A null id counts as the text '' where rows are told apart by id; an id with several texts or labels counts once for
each of them, equal rows once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import portions, raw_texts, slices

#: Bound of the labelled sample that is learned from, in rows.
SAMPLE_ROWS = 4000
CHUNK, OVERLAP = 512, 64
WIDTH, FILTERS = 8, 24
#: Chunks that are worked on at once; their responses should stay in a core's cache.
PART = 16
STEPS, BATCH, RATE, DECAY = 500, 48, 0.01, 1e-4


@dataclass
class ByteNet:
    table: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    weight: np.ndarray  # 2 * FILTERS + 1
    shift: float

    def pooled(self, chunks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each chunk (rows of bytes), and on demand where it is."""
        top = np.zeros((len(chunks), FILTERS), np.float32)
        where = np.zeros((len(chunks), FILTERS), np.int64) if places else None
        wide = chunks.shape[1] - WIDTH + 1
        term = np.empty((min(PART, len(chunks)), wide, FILTERS), np.float32)
        for i in range(0, len(chunks), PART):
            x = chunks[i : i + PART]
            out = np.take(self.table[0], x[:, :wide], axis=0)
            for j in range(1, WIDTH):
                out += np.take(self.table[j], x[:, j : j + wide], axis=0, out=term[: len(x)], mode="clip")
            top[i : i + PART] = out.max(1)
            if places:
                where[i : i + PART] = out.argmax(1)
        return np.maximum(top + self.bias, 0), where

    def probability(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """From the pooled chunks of texts that start at rows first."""
        size = np.diff(np.append(first, len(pooled)))
        top, mean = np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / size[:, None]
        z = np.concatenate([top, mean], 1) @ self.weight + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chunks_of(raw: bytes) -> np.ndarray:
    """Rows of CHUNK bytes that start CHUNK - OVERLAP apart and cover the text; the last is padded with zeros."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    buf = np.zeros(n * step + OVERLAP, np.uint8)
    buf[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.as_strided(buf, (n, CHUNK), (step, 1))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> ByteNet | None:
    """Learns from texts and their labels."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    net = ByteNet(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    share = np.clip(labels.mean(), 0.02, 0.98)
    net.shift = float(np.log(share / (1 - share)))
    params = [net.table, net.bias, net.weight, np.array([net.shift], np.float32)]
    first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_label = [np.flatnonzero(labels == v) for v in (0, 1)]
    for step in range(1, STEPS + 1):
        # a third of each batch is from the rarer label, with weights that undo it
        half = [x for x in by_label if len(x)]
        rare = min(half, key=len)
        pick = np.concatenate([rng.choice(rare, BATCH // 3), rng.integers(0, len(texts), BATCH - BATCH // 3)])
        odds = np.where(np.isin(pick, rare), BATCH // 3 / len(rare), 0) + (BATCH - BATCH // 3) / len(texts)
        importance = (BATCH / len(texts)) / odds
        rows = [chunks_of(texts[i]) for i in pick]
        x, size = np.concatenate(rows), np.array([len(r) for r in rows])
        first = np.cumsum(size) - size
        pooled, where = net.pooled(x, True)
        net.shift = float(params[3][0])
        p = net.probability(pooled, first)
        d = ((p - labels[pick]) * importance / len(pick)).astype(np.float32)
        top = np.maximum.reduceat(pooled, first)
        feats = np.concatenate([top, np.add.reduceat(pooled, first) / size[:, None]], 1)
        owner = np.repeat(np.arange(len(pick)), size)
        is_top = pooled == top[owner]
        d_pooled = (d[owner, None] * (is_top * net.weight[:FILTERS] + net.weight[FILTERS:] / size[owner, None]) * (pooled > 0)).astype(np.float32)
        d_table = np.zeros_like(net.table)
        chunk_no, filter_no = np.nonzero(d_pooled)
        value, place = d_pooled[chunk_no, filter_no], where[chunk_no, filter_no]
        for j in range(WIDTH):
            np.add.at(d_table[j], (x[chunk_no, place + j], filter_no), value)
        grads = [d_table, d_pooled.sum(0), feats.T @ d + DECAY * net.weight, np.array([d.sum()], np.float32)]
        for q, g, m, v in zip(params, grads, first_moment, second_moment):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    net.shift = float(params[3][0])
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteNet | None:
    """Learns from at most SAMPLE_ROWS rows of docs that have a 0/1 label: those of smallest id hash."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    picked = marked.distinct().orderBy(F.xxhash64("_id"), "_id", "_label").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull())
    hashed = texts.withColumn("_h", F.xxhash64("_text"))
    # ids that repeat can stand for more rows than were picked; the bound holds for rows
    sample = hashed.drop("_text").join(F.broadcast(picked), "_id").distinct().orderBy(F.xxhash64("_id"), "_id", "_label", "_h").limit(SAMPLE_ROWS)
    found = hashed.join(F.broadcast(sample), ["_id", "_h"]).groupBy("_id", "_label", "_h").agg(F.first("_text").alias("_text"))
    rows = sorted(((r["_id"], r["_h"], r["_label"], (r["_text"] or "").encode()) for r in found.toLocalIterator()), key=lambda r: r[:3])
    return fit([r[3] for r in rows], np.array([r[2] for r in rows], np.float32))


def score_texts(net: ByteNet | None, texts: list[bytes]) -> np.ndarray:
    """Probabilities."""
    if net is None:
        return np.full(len(texts), 0.5)
    rows = [chunks_of(t) for t in texts]
    size = np.array([len(r) for r in rows])
    x = np.concatenate(rows)
    return net.probability(net.pooled(x)[0], np.cumsum(size) - size).astype(np.float64)


def classify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            ids, texts = batch.column(0), raw_texts(batch.column(1))
            for a, b in slices([max(len(t), CHUNK) for t in texts]):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.array(score_texts(sent.value, texts[a:b]))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, score double")
