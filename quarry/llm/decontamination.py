"""Benchmark decontamination with an FM-index per training shard.

Every slice of documents is a shard with an FM-index of its own. The benchmark's windows are searched backward in it, all
at once, occurrences are located through sampled suffix positions, and the words they cover are merged into removal spans.

What can't be part of an occurrence isn't indexed. Each window has an anchor, the least hash of its runs of ANCHOR words
(of all its words, if it has fewer), and a bitmap of all anchors tells which places of a text could be one. Only the words
that a window around such a place could cover go into the shard's index, once, whatever the size of the benchmark. The
hashes only pass over words: which windows occur is told by the index, word for word.

The benchmark goes to the executors in blocks of at most BLOCK_WINDOWS windows in the order of their anchors, and as the
bitmap, of at most MAP_BITS bits. A worker gathers shards of CYCLE_BYTES of text and takes all of them through one block
after another, so it holds one block and one bitmap; a shard looks up its own few anchors in a block. The driver builds
one block at a time. dropped() removes them once the result isn't used any more. Documents are never shuffled and each
shard is independent, so a lost executor costs its shards only.

Defined results: null texts and texts without words have no words, no hits and are clean; benchmark rows with a null or
wordless text are never found; items that share an id count once; an empty benchmark leaves all documents clean.
Repeated rows and null document ids each give one row; other columns of either input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import portions, raw_texts
from quarry.llm.fm_index import FMIndex

WINDOW, ANCHOR = 13, 3
#: Benchmark windows sent to the executors at once; one takes about 30 bytes with its words.
BLOCK_WINDOWS = 1 << 18
#: Bits of the bitmap of anchors, at most. A larger benchmark fills it more, which costs time and no hits.
MAP_BITS = 1 << 27
#: Bytes of text that are taken through the blocks together.
CYCLE_BYTES = 64 << 20
#: A document is contaminated if hit words are at least one in so many.
HIT_SHARE = 20

_SPACE = 0x20
_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else _SPACE for c in range(256))
#: Bytes that are hashed at once, and the bytes of a word beyond which it is hashed by itself.
_AT_ONCE, _LONG = 1 << 20, 1 << 12
_POWERS = np.cumprod(np.full(_AT_ONCE + _LONG + 1, 0x9E3779B97F4A7C15, np.uint64))


def words(raw: bytes) -> list[bytes]:
    """Lower-cased words: digits, letters a-z and everything that isn't ASCII."""
    return raw.translate(_WORD_BYTES).split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of texts that stand one behind the other: where each starts and ends, its text, its hash."""

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join(texts).translate(_WORD_BYTES)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        inside = np.concatenate([[0], (self.bytes != _SPACE).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[::2], edges[1::2]
        behind = np.cumsum([len(t) + 1 for t in texts])
        #: words before each text, and after the last
        self.first = np.append(0, np.searchsorted(self.starts, behind))
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A sum of a word's bytes times powers, moved to one place for all words."""
        found = np.empty(len(self.starts), np.uint64)
        long = self.ends - self.starts > _LONG
        for at in range(0, len(self.raw), _AT_ONCE):
            own = slice(*np.searchsorted(self.starts, [at, at + _AT_ONCE]))
            a, b = self.starts[own] - at, np.minimum(self.ends[own] - at, _AT_ONCE + _LONG)
            part = self.bytes[at : at + _AT_ONCE + _LONG].astype(np.uint64) + np.uint64(1)
            total = np.append(np.uint64(0), np.cumsum(part * _POWERS[: len(part)]))
            found[own] = _mixed((total[b] - total[a]) * _POWERS[_AT_ONCE + _LONG - a])
        for i in np.flatnonzero(long):
            found[i] = int.from_bytes(hashlib.blake2b(self.raw[self.starts[i] : self.ends[i]], digest_size=8).digest(), "little")
        return found

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, of whatever text."""
    k = max(0, len(hashes) - n + 1)
    out = np.full(k, n, np.uint64)
    for j in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + k])
    return out


class Windows:
    """The distinct windows of a block of benchmark items, by anchor; an item may come in several parts."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        text = Words([raw for _, raw in items])
        self.names = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.names)}
        n_words = np.diff(text.first)
        some = np.flatnonzero(n_words)
        count = np.maximum(1, n_words[some] - size + 1)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts = np.repeat(text.first[some], count) + step
        length = np.repeat(np.minimum(n_words[some], size), count)
        owner = np.repeat(np.array([number[items[i][0]] for i in some], np.int32), count)
        vocabulary: dict[bytes, int] = {}
        flat = np.array([vocabulary.setdefault(text.word(i), len(vocabulary) + 1) for i in range(len(text.starts))] + [0] * size, np.int32)
        anchor = self._anchors(text.hashes, starts, length)
        spelled = np.where(np.arange(size) < length[:, None], flat[starts[:, None] + np.arange(size)], 0)
        order = np.lexsort((owner, *spelled.T, anchor))
        spelled, owner = spelled[order], owner[order]
        new = np.ones(len(order), bool)
        new[1:] = (spelled[1:] != spelled[:-1]).any(1)
        kept = order[new]
        self.flat, self.vocabulary, self.size = flat, list(vocabulary), size  # word numbers of all items, one behind the other
        self.starts, self.lengths, self.anchors = starts[kept].astype(np.int32), length[kept].astype(np.int8), anchor[kept]
        # the items of window k: owner[first[k] : first[k + 1]]
        once = new.copy()
        once[1:] |= owner[1:] != owner[:-1]
        self.owner = owner[once]
        self.first = np.append(np.flatnonzero(new[once]), len(self.owner)).astype(np.int32)

    @staticmethod
    def _anchors(hashes: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for n in np.unique(length):
            k, own = min(ANCHOR, int(n)), length == n
            g = grams(hashes, k)
            least = np.lib.stride_tricks.sliding_window_view(g, n - k + 1).min(1) if len(g) >= n - k + 1 else g
            out[own] = least[starts[own]]
        return out

    def items_of(self, k: int) -> list[str]:
        return [self.names[i] for i in self.owner[self.first[k] : self.first[k + 1]]]


class AnchorMap:
    """Which hashes may be anchors, of how many words they are, and how far from them a window can reach."""

    def __init__(self, anchors: int):
        self.bits = np.zeros(max(1 << 16, min(MAP_BITS, 1 << (16 * max(1, anchors) - 1).bit_length())) >> 3, np.uint8)
        self.sizes: dict[int, int] = {}  # words of an anchor -> words of the longest window with such

    def add(self, w: Windows) -> None:
        at = self._place(w.anchors)
        np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        for n in np.unique(w.lengths).tolist():
            k = min(ANCHOR, n)
            self.sizes[k] = max(n, self.sizes.get(k, 0))

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return hashes & np.uint64(len(self.bits) * 8 - 1)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        at = self._place(hashes)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Shard:
    """A slice of documents: their words, an index of those that windows could cover, and what has been found so far."""

    def __init__(self, texts: list[bytes], anchors: AnchorMap):
        text = Words(texts)
        self.first = text.first
        self.n_words = np.diff(text.first)
        n = len(text.starts)
        self.items: list[set[str]] = [set() for _ in texts]
        cover, hashes = np.zeros(n + 1, np.int32), []
        owner = np.repeat(np.arange(len(texts)), self.n_words)
        for k, longest in anchors.sizes.items():
            g = grams(text.hashes, k)
            at = np.flatnonzero(anchors.test(g))
            hashes.append(g[at])
            doc = owner[at]
            np.add.at(cover, np.maximum(self.first[doc], at - (longest - k)), 1)
            np.add.at(cover, np.minimum(self.first[doc + 1], at + longest), -1)
        self.anchors = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.places = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        self.hits: list[tuple[np.ndarray, np.ndarray]] = []
        if len(self.places):
            number: dict[bytes, int] = {}
            symbols = np.array([number.setdefault(text.word(i), len(number) + 1) for i in self.places])
            # a separator wherever two places aren't side by side in one text
            gap = np.append(True, (np.diff(self.places) > 1) | (np.diff(owner[self.places]) > 0))
            at = np.arange(len(symbols)) + np.cumsum(gap)
            spaced = np.zeros(at[-1] + 2, np.int64)
            spaced[at] = symbols
            self.place_of = np.zeros(len(spaced), np.int64)
            self.place_of[at] = self.places
            self.number, self.index = number, FMIndex(spaced, len(number) + 1)

    def search(self, w: Windows) -> None:
        """Adds the hits of a block: its windows of this shard's anchors are searched in the index, all at once."""
        if not len(self.places) or not len(w.starts):
            return
        lo, hi = np.searchsorted(w.anchors, self.anchors, "left"), np.searchsorted(w.anchors, self.anchors, "right")
        counts = hi - lo
        windows = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        if not len(windows):
            return
        length = w.lengths[windows].astype(np.int64)
        step = np.arange(w.size)
        spelled = np.where(step < length[:, None], w.flat[w.starts[windows][:, None] + step], 0)
        used = np.unique(spelled)
        own = np.array([self.number.get(w.vocabulary[i - 1], -1) if i else 0 for i in used.tolist()])
        phrases = own[np.searchsorted(used, spelled)]
        whole = (phrases >= 0).all(1)
        windows, length, phrases = windows[whole], length[whole], phrases[whole]
        lo, hi = self.index.search(phrases, length)
        counts = np.maximum(hi - lo, 0)
        found = np.repeat(np.arange(len(windows)), counts)
        at = self.place_of[self.index.locate(np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum()))]
        self.hits.append((at, length[found]))
        doc = np.searchsorted(self.first, at, "right") - 1
        for d, k in set(zip(doc.tolist(), windows[found].tolist())):
            self.items[d].update(w.items_of(k))

    def spans(self) -> list[list[tuple[int, int]]]:
        """For each document: merged spans of hit words."""
        found: list[list[tuple[int, int]]] = [[] for _ in self.items]
        if not self.hits:
            return found
        at, length = (np.concatenate(x) for x in zip(*self.hits))
        order = np.argsort(at, kind="stable")
        for a, b in zip(at[order].tolist(), (at + length)[order].tolist()):
            d = int(np.searchsorted(self.first, a, "right")) - 1
            base = int(self.first[d])
            if found[d] and a - base <= found[d][-1][1]:
                found[d][-1] = (found[d][-1][0], max(b - base, found[d][-1][1]))
            else:
                found[d].append((a - base, b - base))
        return found


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's texts in blocks of a bounded number of windows; a longer item is parted so that no window is lost."""
    block, held = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        ws = words(row[1].encode())
        for at in range(0, max(1, len(ws) - size + 1), BLOCK_WINDOWS):
            part = ws[at : at + BLOCK_WINDOWS + size - 1]
            n = max(1, len(part) - size + 1)
            if block and held + n > BLOCK_WINDOWS:
                yield block
                block, held = [], 0
            block.append((row[0] or "", b" ".join(part)))
            held += n
    if block:
        yield block


class Sent:
    """The benchmark on the executors: a bitmap of anchors and blocks of windows."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str):
        context = benchmark.sparkSession.sparkContext
        anchors = AnchorMap(benchmark.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)  # a word has a byte and a space
        self.blocks: list[Broadcast] = []
        for items in blocks(benchmark, id_col, text_col):
            w = Windows(items)
            anchors.add(w)
            self.blocks.append(context.broadcast(w))
            self.blocks[-1].__dict__.pop("_value", None)  # the driver keeps none of them
        self.anchors = context.broadcast(anchors)

    def each(self) -> Iterator[Windows]:
        """The blocks one after another; of several, one is in a worker's memory at a time."""
        for b in self.blocks:
            yield b.value
            if len(self.blocks) > 1:
                b.__dict__.pop("_value", None)

    def destroy(self) -> None:
        for b in (*self.blocks, self.anchors):
            b.destroy()


def cycles(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[list[pa.RecordBatch]]:
    """Portions of the batches, gathered to CYCLE_BYTES of the text column at."""
    held, size = [], 0
    for part in portions(batches, at):
        held.append(part)
        size += part.column(at).nbytes
        if size >= CYCLE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def scan(batches: Iterable[pa.RecordBatch], at: int, anchors: AnchorMap, windows: Callable[[], Iterable[Windows]]) -> Iterator[tuple[pa.RecordBatch, Shard]]:
    """Slices of the batches, each with its shard, searched for all blocks."""
    for held in cycles(batches, at):
        shards = [Shard(raw_texts(part.column(at)), anchors) for part in held]
        if any(len(s.places) for s in shards):
            for w in windows():
                for s in shards:
                    s.search(w)
        yield from zip(held, shards)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, spans of hit words."""
    sent = Sent(benchmark, item_col, item_text_col)
    blocks_, anchors = sent.each, sent.anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shard in scan(batches, 1, anchors.value, blocks_):
            spans, n_words = shard.spans(), shard.n_words.tolist()
            n_hit = [sum(e - s for s, e in x) for x in spans]
            names = [sorted(x) for x in shard.items]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            bad = [h > 0 and HIT_SHARE * h >= n for h, n in zip(n_hit, n_words)]
            columns = [batch.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, names), pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_()), pa.array(names, pa.list_(pa.string())), pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans"])

    found = docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<array<int>>")
    found._stored_at = sent.destroy
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text_col)
    sent = Sent(benchmark, item_col, item_text_col)
    blocks_, anchors = sent.each, sent.anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shard in scan(batches, at, anchors.value, blocks_):
            hit = [sum(e - s for s, e in x) for x in shard.spans()]
            yield batch.filter(pa.array([not (h and HIT_SHARE * h >= n) for h, n in zip(hit, shard.n_words.tolist())], pa.bool_()))

    kept = docs.mapInArrow(run, docs.schema)
    kept._stored_at = sent.destroy
    return kept
