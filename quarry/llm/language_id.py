"""Language ID by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte n-grams. Each language gets several centroids from spherical
k-means over a bounded sample; a text takes the language of the centroid of largest cosine. A text that is farther from
that centroid than nearly all of its own training texts is marked as rejected (distance-based rejection); the nearest
language is given nevertheless.

The sample holds at most SAMPLE_ROWS rows: those of smallest id hash in each language, an equal share for each, rows that
repeat id, text and language once. Only their vectors come to the driver. Prediction covers the whole text of every row and shuffles nothing.

Defined results: a null text or one without a letter is `und` with score 0. Without any row to learn from, everything
is. Null languages are not learned from. A null id counts as the text '' where rows are told apart by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import portions, raw_texts, slices

#: Bound of the sample that is learned from, in rows over all languages, and in rows for a language.
SAMPLE_ROWS, SAMPLE_ROWS_EACH = 4000, 800
DIM = 2048
CENTROIDS = 4
REJECT_QUANTILE, REJECT_SLACK = 0.99, 0.10
TEMPERATURE = 0.05
#: A letter is what Unicode says is one (category L).
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint32)


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def count_vectors(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of letters, digits and marks folded to spaces; one row per text."""
    k = len(texts)
    buf = _FOLD[np.frombuffer(b" ".join([b"", *texts, b" "]), np.uint8)]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    row = np.repeat(np.arange(k), sizes)  # a text's grams start at the space before it
    n = len(row)
    two = (buf[:n] * np.uint32(0x9E3779B1) + buf[1 : n + 1] * np.uint32(0x85EBCA77)) >> np.uint32(21)
    three = ((buf[:n] * np.uint32(0xC2B2AE3D) + buf[1 : n + 1] * np.uint32(0x27D4EB2F)) ^ (buf[2 : n + 2] * np.uint32(0x165667B1))) >> np.uint32(21)
    base = row * DIM
    return (np.bincount(base + two, minlength=k * DIM) + np.bincount(base + three, minlength=k * DIM)).reshape(k, DIM).astype(np.float32)


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    language_of: np.ndarray
    least_cosine: np.ndarray  # by language, for rejection

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score and whether it is rejected."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = np.stack([cosine[:, self.language_of == j].max(1) for j in range(len(self.languages))], 1)
        which = best.argmax(1)
        top = best.max(1)
        odds = np.exp((best - top[:, None]) / TEMPERATURE)
        return which, 1 / odds.sum(1), top < self.least_cosine[which]


def _spherical_means(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    k = min(k, len(v))
    seeds = [0]
    for _ in range(k - 1):  # the text least like any seed so far
        seeds.append(int((v @ v[seeds].T).max(1).argmin()))
    c = v[seeds]
    for _ in range(rounds):
        near = (v @ c.T).argmax(1)
        c = np.stack([v[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(counts: np.ndarray, languages: list[str]) -> Centroids | None:
    names = sorted(set(languages))
    if not names:
        return None
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    model = Centroids(names, idf, np.zeros((0, DIM), np.float32), np.zeros(0, np.int64), np.zeros(len(names)))
    v, of = model.vectors(counts), np.array([names.index(x) for x in languages])
    centres = [_spherical_means(v[of == j], CENTROIDS) for j in range(len(names))]
    model.centroids = np.concatenate(centres)
    model.language_of = np.repeat(np.arange(len(names)), [len(c) for c in centres])
    for j, c in enumerate(centres):
        model.least_cosine[j] = np.quantile((v[of == j] @ c.T).max(1), 1 - REJECT_QUANTILE) - REJECT_SLACK
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids | None:
    """Learns from the rows with a text and a language among docs."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    sizes = {r["_lang"]: r["n"] for r in usable.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(SAMPLE_ROWS).collect()}
    each = min(SAMPLE_ROWS_EACH, max(1, SAMPLE_ROWS // max(1, len(sizes))))
    part = F.pmod(F.xxhash64(F.coalesce("_id", F.lit(0))), F.lit(1 << 40)) / float(1 << 40)
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))))
    picked = usable.where(part < F.coalesce(share[F.col("_lang")], F.lit(0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 0):
            texts = raw_texts(batch.column(0))
            for a, b in slices([max(len(t), DIM) for t in texts]):
                counts = count_vectors(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([c.tobytes() for c in counts], pa.binary())], names=["_lang", "_h", "v"])

    rows = picked.select("_text", "_lang", F.xxhash64("_id", "_text").alias("_h")).mapInArrow(run, "_lang string, _h long, v binary").dropDuplicates(["_lang", "_h"]).orderBy("_h", "_lang").limit(SAMPLE_ROWS).collect()
    if not rows:
        return None
    return fit(np.stack([np.frombuffer(r["v"], np.float32) for r in rows]), [r["_lang"] for r in rows])


def identify(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in portions(batches, 1):
            ids, texts = batch.column(0), raw_texts(batch.column(1))
            for a, b in slices([max(len(t), DIM) for t in texts]):
                lang, score, rejected = ["und"] * (b - a), np.zeros(b - a), np.zeros(b - a, bool)
                some = [i for i in range(b - a) if _LETTER.search(texts[a + i].decode())]
                if some and m is not None:
                    which, s, r = m.predict(count_vectors([texts[a + i] for i in some]))
                    score[some], rejected[some] = s, r
                    for i, j in zip(some, which.tolist()):
                        lang[i] = m.languages[j]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, lang_pred string, score double, rejected boolean")
