"""Exact SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The merge procedure of the model is never run over a text. Instead an Aho-Corasick automaton gives the longest piece
that starts at each position; pieces are laid left to right, a piece may follow another only if re-merging the text of
the two gives back just these two, and when nothing fits the last piece is taken back, with a bitfield of positions
that are known to fail. No piece of the vocabulary holds a space mark after another character (checked on loading),
so a text falls into chunks "marks, then other characters" that are encoded apart and remembered in a bounded memo.

Runs of two or more space marks have pieces of equal score, where adjacent compatibility does not decide; such chunks
go to the merge procedure itself (also used for the compatibility checks).

Defined results: a null text is empty; an empty text has no pieces beside the begin and end ids. Characters outside
the vocabulary become byte pieces. One output row per input row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quarry.llm.common import portions, raw_texts, slices

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Chunks kept in each of the memo's two generations, and the characters up to which a chunk is kept.
MEMO, MEMO_CHARS = 250_000, 256


class _Memo(dict):
    """Chunk -> (ids as little-endian uint32, decoded UTF-8); the older half goes when the newer is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, chunk: str) -> tuple[bytes, bytes]:
        if len(chunk) > MEMO_CHARS:
            return self.make(chunk)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        found = self.old.get(chunk) or self.make(chunk)
        self[chunk] = found
        return found


class PieceCodec:
    def __init__(self, model_path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = lib.get_piece_size()
        self.begin, self.end, self.unk = lib.bos_id().to_bytes(4, "little"), lib.eos_id().to_bytes(4, "little"), lib.unk_id()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.bytes_of = {int(self.pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_value = {i: b for b, i in self.bytes_of.items()}
        self.raw_piece = [bytes([self.byte_value[i]]) if lib.is_byte(i) else b"" if lib.is_control(i) else self.pieces[i].replace(MARK, " ").encode() for i in range(n)]
        self.score = {self.pieces[i]: lib.get_score(i) for i in range(n) if not special[i]}
        self.id = {self.pieces[i]: i for i in range(n) if not special[i]}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id):
            raise ValueError("a piece holds a space mark after another character; chunks can't be encoded apart")
        self.chars = {c for c in self.id if len(c) == 1}
        self.trie = ahocorasick.Automaton()
        for p in self.id:
            self.trie.add_word(p, (len(p) - 1, p))
        self.trie.make_automaton()
        #: two characters that no piece holds side by side are never merged: a cut point
        self.pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        #: piece -> its longest proper prefix that is a piece
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), None) for p in self.id}
        self.fits: dict[tuple[str, str], bool] = {}
        self.memo = _Memo(self._chunk)

    def merged(self, text: str) -> list[str]:
        """The merge procedure: the best-scored adjacent pair first, the leftmost of equals."""
        if len(text) <= 24:
            return self._merged_short(list(text))
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if j < len(parts) and (s := self.score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _merged_short(self, parts: list[str]) -> list[str]:
        get, low = self.score.get, float("-inf")
        scores = [get(a + b, low) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > low:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], low)
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], low)
        return parts

    def _fit(self, a: str, b: str) -> bool:
        if len(self.fits) > 400_000:
            self.fits.clear()
        found = self.fits[a, b] = self.merged(a + b) == [a, b]
        return found

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all in the vocabulary."""
        n = len(text)
        longest = [""] * n
        for end, (back, p) in self.trie.iter(text):
            longest[end - back] = p  # ends ascend, so the longest stays
        if len(longest[0]) == n:
            return [text]
        fits, failed, shorter = self.fits, bytearray((n >> 3) + 1), self.shorter  # bit i: position i is known to fail
        out: list[str] = []
        at, piece, last = 0, longest[0], ""
        while True:
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not last:
                        break
                    fit = fits.get((last, piece))
                    if fit or (fit is None and self._fit(last, piece)):
                        break
                piece = shorter[piece]
            if piece:
                out.append(piece)
                at = end
                if at == n:
                    return out
                last, piece = piece, longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                piece, last = shorter[piece], out[-1] if out else ""

    def _pieces(self, chunk: str) -> list[int]:
        if self.chars.issuperset(chunk) and not chunk.startswith(MARK * 2):
            return [self.id[p] for p in self.backtrack(chunk)]
        known = [c in self.chars for c in chunk]
        ids: list[int] = []
        i, n = 0, len(chunk)
        while i < n:
            j = i
            while j < n and known[j]:
                j += 1
            if j > i:
                run = chunk[i:j]
                ids += [self.id[p] for p in (self.merged(run) if run.startswith(MARK * 2) else self.backtrack(run))]
            if j < n:
                raw = chunk[j].encode()
                ids += [self.bytes_of[b] for b in raw] if self.bytes_of else [self.unk]
                j += 1
            i = j
        return ids

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        pairs = self.pairs
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in pairs]
        if cuts:
            found = [self.memo[chunk[i:j]] for i, j in zip([0, *cuts], [*cuts, len(chunk)])]
            return b"".join([x[0] for x in found]), b"".join([x[1] for x in found])
        ids = self._pieces(chunk)
        return array("I", ids).tobytes(), self._raw(ids)

    def _raw(self, ids: list[int]) -> bytes:
        """The pieces' text, with spaces for marks and bytes for byte pieces."""
        raw = self.raw_piece
        return b"".join([raw[i] for i in ids])

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def packed(self, text: str) -> tuple[bytes, bytes]:
        """All ids as little-endian uint32, and the UTF-8 of what they decode to."""
        memo = self.memo
        found = [memo[c] for c in self.chunks(text)]
        raw = b"".join([x[1] for x in found])
        return b"".join([self.begin, *[x[0] for x in found], self.end]), raw[1:] if raw.startswith(b" ") else raw

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.packed(text)[0]).cast("I"))

    def decode(self, ids: list[int]) -> str:
        """As the library's decode: the leading space that encoding adds is dropped; bytes that are no UTF-8 become U+FFFD."""
        raw = self._raw(list(ids))
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    """One codec per Python worker; the model file is read where the worker runs and never copied."""
    return PieceCodec(model_path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, token_ids array<int> with begin and end ids, decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in portions(batches, 1):
            ids, texts = batch.column(0), raw_texts(batch.column(1))
            for a, b in slices([len(t) for t in texts]):
                rows = [c.packed(t.decode()) for t in texts[a:b]]
                ends = np.cumsum([0, *(len(x[0]) // 4 for x in rows)], dtype=np.int32)
                tokens = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join([x[0] for x in rows]), np.int32))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), tokens, pa.array([x[1] for x in rows], pa.binary()).cast(pa.string())], names=[id_col, "token_ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, token_ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), but with the digests of ids and decoded text in place of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in portions(batches, 1):
            n, a, b = [], [], []
            for t in raw_texts(batch.column(1)):
                ids, text = c.packed(t.decode())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
