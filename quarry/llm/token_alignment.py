"""Cross-tokenizer alignment: DuckDB inside each task, Spark between them.

A block of texts becomes two tables of token intervals in bytes, of a byte-level BPE (A) and of SentencePiece (B). DuckDB
aligns them: an ASOF join finds the B token that ends last at or before an A token's end, and the two are linked if both
end there; window sums of the links number the groups between common ends; a range join inside the groups finds the
tokens that overlap. Pair counts of a block are partial; Spark adds them up over all blocks and brings the whole counts
back to the texts, whose alignments wait in a stored table. A block is many small rows there (its pairs, its texts, pieces
of its links), which come together again in a worker in their order: no row and no group grows with a block or the input.

Texts are cut into stretches at single spaces between characters that aren't white space. Neither tokenizer has a token
across such a cut, nor does what is on one side change the tokens of the other (A's pattern ends a token there, and no
piece of B has its space mark behind another character, which is checked on loading), so a block's like stretches are
tokenised and aligned once and counted as often as they occur.

Defined results: a null or empty text has no tokens; so has one whose pieces don't spell it (B turns U+2581 into a space);
all their numbers are 0 and their groups ''. Strings of special tokens inside texts are plain text. Repeated rows count
each time; null ids give rows of their own; other columns of the input are ignored. A pair's count is at least the
number of its links in a text, so a text's best links are those whose pair no other A id beats for its B id, ties included.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.common import portions, raw_texts, stored

#: UTF-8 bytes of texts that are aligned together; a longer text is aligned in parts of this size.
BLOCK = 5 << 20
#: Stretches of more characters go to the encoder whose time doesn't grow with the square of an unbroken run.
LONG = 1000
#: Stretches that A's encoder is given as one text.
TOGETHER = 2000
#: Stretches whose tokens are in DuckDB at a time.
ALIGNED = 1 << 15
#: 32-bit integers in one row of the stored alignments, and bytes of that table that a writer or reader holds at once.
PIECE, ROW_GROUP = 1 << 14, 16 << 20

_MARK = "▁"
#: White space of any definition; a cut has none of it on either side.
_SPACE = "\\s\x85\\u180e\\u200b\\ufeff"
_CUT = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
_APART = re.compile(f"(?![{_SPACE}])(?s:.*)(?<![{_SPACE}])\\Z")
#: The fixed alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, json_path: str, piece_path: str):
        self.slow = Tokenizer.from_file(json_path)
        self.slow.encode_special_tokens = True
        with open(json_path, encoding="utf-8") as f:
            found = json.load(f)
        byte_of = {chr(b): b for b in _PRINTED} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
        vocabulary, special = found["model"]["vocab"], {t["content"] for t in found["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in found["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("merges aren't in the order of their ids")
        self.fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        n = self.pieces.get_piece_size()
        if any(re.search(f"[^{_MARK}]{_MARK}", self.pieces.id_to_piece(i)) for i in range(n)):
            raise ValueError("a piece holds a space mark after another character; stretches can't be encoded apart")
        spelled = {i: b for b, i in ranks.items()}
        self.a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in ((i, self.pieces.id_to_piece(i)) for i in range(n))]
        self.a_size, self.b_size = np.array([len(b) for b in self.a_bytes]), np.array([len(b) for b in self.b_bytes])

    def encode(self, stretches: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The ids of all stretches and how many each has: A's of each behind a space, and B's, which adds the space itself."""
        a: list[list[int] | None] = [None] * len(stretches)
        plain = []
        for c, x in enumerate(stretches):
            if len(x) > LONG:
                a[c] = self.slow.encode(" " + x, add_special_tokens=False).ids
            elif _APART.match(x):
                plain.append(c)
            else:  # with white space at an end, what stands beside it would matter
                a[c] = self.fast.encode_ordinary(" " + x)
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            ids = self.fast.encode_ordinary("".join([" " + stretches[c] for c in some]))
            ends = np.searchsorted(np.cumsum(self.a_size[ids]), np.cumsum([len(stretches[c].encode()) + 1 for c in some])) + 1
            for c, i, j in zip(some, [0, *ends.tolist()], ends.tolist()):
                a[c] = ids[i:j]
        return _flat(a), _flat(self.pieces.encode(stretches, num_threads=1))


@lru_cache(maxsize=2)
def tokenizers(json_path: str, piece_path: str) -> Tokenizers:
    """One of each per Python worker; the files are read where the worker runs and never copied."""
    return Tokenizers(json_path, piece_path)


#: c: stretch, i: token, id, s and e: where it starts and ends in all stretches, one behind the other.
_TABLES = """
CREATE TEMP TABLE stretch (c INTEGER, n_a BIGINT, n_b BIGINT, n_links BIGINT, n_overlaps BIGINT);
CREATE TEMP TABLE link (c INTEGER, i INTEGER, a INTEGER, b INTEGER);
"""
_ALIGN = """
CREATE OR REPLACE TEMP TABLE ta AS SELECT *, coalesce(sum(CAST(b_id IS NOT NULL AS INTEGER)) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
  FROM (SELECT a.c, a.i, a.id, a.s, a.e, CASE WHEN b.e = a.e THEN b.id END AS b_id FROM a ASOF LEFT JOIN b ON a.e >= b.e);
CREATE OR REPLACE TEMP TABLE tb AS SELECT *, coalesce(sum(CAST(linked AS INTEGER)) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
  FROM (SELECT b.c, b.i, b.id, b.s, b.e, a.e IS NOT DISTINCT FROM b.e AS linked FROM b ASOF LEFT JOIN a ON b.e >= a.e);
INSERT INTO stretch SELECT c, n_a, n_b, n_links, n_overlaps FROM (SELECT c, count(*) AS n_a, count(b_id) AS n_links FROM ta GROUP BY c)
  JOIN (SELECT c, count(*) AS n_b FROM tb GROUP BY c) USING (c)
  JOIN (SELECT ta.c, count(*) AS n_overlaps FROM ta JOIN tb ON ta.g = tb.g AND ta.s < tb.e AND tb.s < ta.e GROUP BY ta.c) USING (c);
INSERT INTO link SELECT c, i, id, b_id FROM ta WHERE b_id IS NOT NULL;
"""
_PAIRS = """
DROP TABLE ta; DROP TABLE tb;
CREATE TEMP TABLE pair AS SELECT a, b, CAST(sum(w) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS p
  FROM link JOIN (SELECT c, count(*) AS w FROM place GROUP BY c) USING (c) GROUP BY a, b;
"""
#: The groups' spelling, token by token: the last of a group's A tokens, and the last of its B tokens, are those linked.
_SPELLED = """
SELECT c, t FROM (SELECT c, g, 0 AS side, i, CAST(id AS VARCHAR) || CASE WHEN b_id IS NULL THEN ',' ELSE '|' END AS t FROM ta
        UNION ALL SELECT c, g, 1, i, CAST(id AS VARCHAR) || CASE WHEN linked THEN ';' ELSE ',' END FROM tb) ORDER BY g, side, i
"""
#: d: text. Each link ends a group.
_TEXTS = """
SELECT d, CAST(sum(n_a) AS BIGINT) AS n_a, CAST(sum(n_b) AS BIGINT) AS n_b, CAST(sum(n_links) AS BIGINT) AS n_groups, CAST(sum(n_links) AS BIGINT) AS n_links,
       CAST(sum(n_overlaps) AS BIGINT) AS n_overlaps FROM place JOIN stretch USING (c) GROUP BY d ORDER BY d
"""


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all stretches, and how many each has."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), n


def _intervals(flat: np.ndarray, n: np.ndarray, size: np.ndarray, first: int) -> pa.Table:
    end = np.cumsum(size[flat])
    return pa.table({"c": np.repeat(np.arange(first, first + len(n), dtype=np.int32), n), "i": np.arange(len(flat), dtype=np.int32), "id": flat, "s": end - size[flat], "e": end})


def _unspelled(stretches: list[str], flat: np.ndarray, n: np.ndarray, spelling: list[bytes], size: np.ndarray) -> np.ndarray:
    """Whether the tokens of each stretch fail to spell it, with the space ahead."""
    raw = [b" " + s.encode() for s in stretches]
    ends = np.append(0, np.cumsum(n))
    total = np.append(0, np.cumsum(size[flat]))[ends]
    bad = np.diff(total) != np.fromiter(map(len, raw), np.int64, len(raw))
    joined = b"".join(map(spelling.__getitem__, flat.tolist()))
    if bad.any() or joined != b"".join(raw):
        bad |= np.array([joined[i:j] != x for i, j, x in zip(total[:-1].tolist(), total[1:].tolist(), raw)])
    return bad


def align_long(text: bytes, t: Tokenizers) -> dict | None:
    """As align() of one text, part after part; a part ends where a stretch does, so what has no cut is aligned whole."""
    s, at, parts, digest = text.decode(), 0, [], hashlib.sha256()
    while at is not None:
        m = _CUT.search(s, at + BLOCK)
        found = align([(s[at : m.start()] if m else s[at:]).encode()], t)
        if found is None:
            return None  # a part that its pieces don't spell takes the text with it
        digest.update(found.pop("groups")[0][: None if m else -1])
        parts.append(found)
        at = m.end() if m else None
    whole = {c: sum(x["texts"][c][0].as_py() for x in parts) for c in parts[0]["texts"].column_names if c != "d"}
    pairs, stretches = (np.cumsum([0, *(n(x) for x in parts)]) for n in (lambda x: len(x["pairs"]), lambda x: len(x["stretch_links"])))
    moved = lambda c, by: np.concatenate([x[c] + k for x, k in zip(parts, by)]).astype(np.int32)
    return {
        "texts": pa.table({"d": pa.array([0], pa.int32())} | {c: pa.array([v], pa.int64()) for c, v in whole.items()}), "sha256": [digest.hexdigest()],
        "pairs": pa.concat_tables([x["pairs"] for x in parts]), "link_pair": moved("link_pair", pairs), "stretch_links": np.concatenate([x["stretch_links"] for x in parts]),
        "place": moved("place", stretches), "text_places": np.array([sum(int(x["text_places"][0]) for x in parts)]),
    }


def align(texts: list[bytes], t: Tokenizers) -> dict | None:
    """The alignment of a block of texts: for each text with tokens its numbers and groups, the block's pairs with their
    counts, and by stretch and text which pairs are linked. None if no text has tokens."""
    number: dict[str, int] = {}
    cut = [np.array([number.setdefault(s, len(number)) for s in _CUT.split(x.decode())] if x else [], np.int32) for x in texts]
    stretches = list(number)
    (a_flat, a_n), (b_flat, b_n) = t.encode(stretches)
    # a piece is never longer than its text, so a text is spelled by its pieces if each of its stretches is
    bad = _unspelled(stretches, a_flat, a_n, t.a_bytes, t.a_size) | _unspelled(stretches, b_flat, b_n, t.b_bytes, t.b_size)
    places = np.concatenate(cut)
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    text = np.repeat(np.arange(len(cut), dtype=np.int32), sizes)
    fine = sizes > 0
    fine[text[bad[places]]] = False
    kept = np.flatnonzero(fine)
    if not len(kept):
        return None
    place, text, sizes = places[fine[text]], text[fine[text]], sizes[kept]
    used = np.bincount(place, minlength=len(bad)) > 0
    place = (np.cumsum(used) - 1)[place].astype(np.int32)
    a_flat, a_n, b_flat, b_n = a_flat[np.repeat(used, a_n)], a_n[used], b_flat[np.repeat(used, b_n)], b_n[used]
    n_texts = sum(map(len, texts))
    del cut, number, stretches, places, bad  # the strings go before the tables come
    room = max(500, n_texts * 160 >> 20)  # MB; more than a block only for a stretch that can't be cut
    groups: list[bytes] = []
    a_ends, b_ends = np.append(0, np.cumsum(a_n)), np.append(0, np.cumsum(b_n))
    with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{room}MB", "temp_directory": ""}) as con:
        con.execute(_TABLES)
        for i in range(0, len(a_n), ALIGNED):  # a stretch ends both tokenizers' tokens, so none meets another's
            j = min(i + ALIGNED, len(a_n))
            con.register("a", _intervals(a_flat[a_ends[i] : a_ends[j]], a_n[i:j], t.a_size, i))
            con.register("b", _intervals(b_flat[b_ends[i] : b_ends[j]], b_n[i:j], t.b_size, i))
            con.execute(_ALIGN)
            groups += _joined(con.sql(_SPELLED).to_arrow_table(), i, j)
        con.register("place", pa.table({"d": text, "c": place}))
        con.execute(_PAIRS)
        by_text, pairs, links = (con.sql(q).to_arrow_table() for q in (_TEXTS, "SELECT a, b, n FROM pair ORDER BY p", "SELECT c, p FROM link JOIN pair USING (a, b) ORDER BY c, i"))
    first = np.cumsum(sizes) - sizes
    at = place.tolist()
    spelled_out = [b"".join([groups[c] for c in at[f : f + n]]) for f, n in zip(first.tolist(), sizes.tolist())]
    n_links = np.bincount(links["c"].to_numpy(), minlength=len(a_n))
    return {"texts": by_text, "groups": spelled_out, "pairs": pairs, "link_pair": links["p"].to_numpy(), "stretch_links": n_links, "place": place, "text_places": sizes}


def _joined(spelled: pa.Table, first: int, last: int) -> list[bytes]:
    """The spelling of the groups of each stretch from first to before last, each with its semicolon."""
    c, t = spelled["c"].combine_chunks().to_numpy(), spelled["t"].combine_chunks()
    t = t.chunk(0) if isinstance(t, pa.ChunkedArray) else t
    ends = np.searchsorted(c, np.arange(first, last + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), t.cast(pa.binary())), b"").to_pylist()


#: Rows of a block by kind: its pairs (place p, ids, partial count), three arrays of 32-bit integers in pieces, its texts.
PAIR, LINK_PAIR, STRETCH_LINKS, PLACE, TEXT = range(5)
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
_TYPES = {"block": pa.int64(), "kind": pa.int32(), "p": pa.int32(), "a": pa.int32(), "b": pa.int32(), "n": pa.int64(), "data": pa.binary(), "doc_id": pa.int64(), **dict.fromkeys(_NUMBERS, pa.int64()), "n_places": pa.int64(), "groups_sha256": pa.string()}
_ROWS = ", ".join(f"{c} {k}" for c, k in zip(_TYPES, ("long", "int", "int", "int", "int", "long", "binary", "long", *["long"] * 6, "string")))


def _rows(block: int, kind: int, **columns) -> pa.RecordBatch:
    """Rows of one kind, numbered by p; columns that the kind hasn't are null."""
    n = len(next(iter(columns.values())))
    columns |= {"block": np.full(n, block), "kind": np.full(n, kind, np.int32), "p": np.arange(n, dtype=np.int32)}
    made = (columns.get(c) for c in _TYPES)
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if x is None else x.combine_chunks().cast(k) if isinstance(x, pa.ChunkedArray) else pa.array(x, k) for x, k in zip(made, _TYPES.values())], names=list(_TYPES))


def aligned_blocks(docs: DataFrame, json_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of bounded size for each block of texts: its pairs with partial counts, the links of its stretches and the
    stretches of its texts in pieces, and the numbers of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(json_path, piece_path)
        block = TaskContext.get().partitionId() << 32
        for batch in portions(batches, 1, BLOCK):
            texts = raw_texts(batch.column(1))
            found = align(texts, t) if len(texts) > 1 or len(texts[0]) <= BLOCK else align_long(texts[0], t)
            block += 1
            numbers = {c: np.zeros(len(texts), np.int64) for c in (*_NUMBERS, "n_places")}
            sha = np.full(len(texts), "", object)
            if found is not None:
                no = found["texts"]["d"].to_numpy()
                for c in _NUMBERS:
                    numbers[c][no] = found["texts"][c].to_numpy()
                numbers["n_places"][no] = found["text_places"]
                sha[no] = found.get("sha256") or [hashlib.sha256(g[:-1]).hexdigest() for g in found["groups"]]
                yield _rows(block, PAIR, **{c: found["pairs"][c] for c in "abn"})
                for kind, c in ((LINK_PAIR, "link_pair"), (STRETCH_LINKS, "stretch_links"), (PLACE, "place")):
                    x = found[c].astype("<i4")
                    yield _rows(block, kind, data=[x[i : i + PIECE].tobytes() for i in range(0, len(x), PIECE)])
            yield _rows(block, TEXT, doc_id=batch.column(0).cast(pa.int64()), **numbers, groups_sha256=sha)

    return docs.select(id_col, text_col).mapInArrow(run, _ROWS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best) over all blocks: how often tokens of the two ids end together, and whether no other A id does so
    more often with the B id."""
    counts = blocks.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def token_alignment(docs: DataFrame, json_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps."""
    blocks = stored(aligned_blocks(docs, json_path, piece_path, id_col, text_col), "alignments", **{"parquet.block.size": ROW_GROUP})
    told = blocks.where(F.col("kind") == PAIR).select("block", "kind", "p", "a", "b").join(pair_counts(blocks), ["a", "b"]).drop("a", "b")
    rest = blocks.where(F.col("kind") != PAIR).drop("a", "b", "n")
    whole = rest.unionByName(told, allowMissingColumns=True).repartition("block").sortWithinPartitions(F.col("block") * 8 + F.col("kind"))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def texts_of(block: pa.Table) -> pa.RecordBatch:
        of = lambda kind: block.filter(pc.equal(block["kind"], kind)).sort_by("p")
        ints = lambda kind: np.frombuffer(b"".join(of(kind)["data"].to_pylist()), "<i4")
        pairs, texts, place = of(PAIR), of(TEXT), ints(PLACE)
        found = {c: texts[c].to_numpy() for c in _NUMBERS} | {c: np.zeros(len(texts), np.int64) for c in ("n_best", "count_sum")}
        if len(place):
            pair, before, sizes = ints(LINK_PAIR), np.append(0, np.cumsum(ints(STRETCH_LINKS))), texts["n_places"].to_numpy()
            no = np.flatnonzero(sizes)
            for c, of_pair in (("n_best", pairs["best"].to_numpy().astype(np.int64)), ("count_sum", pairs["count"].to_numpy())):
                total = np.append(0, np.cumsum(of_pair[pair]))
                of_stretch = total[before[1:]] - total[before[:-1]]
                found[c][no] = np.add.reduceat(of_stretch[place], (np.cumsum(sizes) - sizes)[no])
        return pa.RecordBatch.from_arrays([texts["doc_id"].combine_chunks(), *(pa.array(found[c]) for c in names), texts["groups_sha256"].combine_chunks(), pa.array(found["n_overlaps"])], names=[id_col, *names, "groups_sha256", "n_overlaps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        for batch in batches:
            of = batch.column("block").to_numpy()
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            for i, j in zip(starts, [*starts[1:], len(of)]):
                if of[i] != block and parts:
                    yield texts_of(pa.Table.from_batches(parts))
                    parts = []
                block = of[i]
                parts.append(batch.slice(i, j - i))
        if parts:
            yield texts_of(pa.Table.from_batches(parts))

    return whole.mapInArrow(run, f"{id_col} long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long")
