"""Exact substring dedup with suffix arrays of shards.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller document id, or earlier in the same
document). Suffix arrays of all texts together can't be built, so equal strings are first brought together:

1. Anchors. The least hash among a string's GRAM-byte grams depends on the string alone, so equal strings have equal
   anchors. Consecutive strings of a text with one anchor form a run, kept as 30-odd bytes: hash of the anchor, hash of
   the run's bytes, document and place. Equal runs of a slice fold to the earliest before anything is shuffled.
2. Groups. By anchor hash, runs whose bytes are equal fold again to the earliest owner; later owners lose them whole.
   Runs that share an anchor but differ go on, anchors of one run only are done.
3. Shards. The bytes of those runs are fetched from their documents and dealt to shards by anchor. A shard is one
   collection: its suffix array by induced sorting and its permuted common prefixes give all groups of equal
   strings of LENGTH bytes, in which all but the earliest go.
4. Spans are merged for each document and cut.

Skew: an anchor with more than HOT differing runs in one slice (the edge of a passage that very many documents share)
is marked. Its runs are spread by their own hash, and in step 3 they are dealt string by string, by the string's hash,
after equal strings of a slice fold to the earliest. So a group never holds more than HOT runs, or one string, for each
slice of input, and no pair of documents is ever formed.

Runs are equal if the 64-bit hash of their bytes and 32 bits and the bucket of their anchor's agree; 2 * 10^12 runs, that
is about 100 TB of text, hold a chance pair with odds below 10^-6.

Defined results: a null text is empty; texts under LENGTH bytes keep all. Rows that repeat both id and text are one
document and all get its result; rows that share only the id are ordered by a hash of the text. A null id orders first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import n_buckets, portions, raw_texts, slices, stored, text_bytes, unnamed
from quarry.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 100
GRAM = 24
#: Differing runs of one anchor within a slice from which on the anchor counts as hot.
HOT = 48
#: Bytes of text worked on at once: a slice takes about 60 bytes of arrays for each.
SLICE = 1 << 20
#: Bytes of text whose runs a bucket should hold.
BUCKET_BYTES = 16 << 20

_NO_ID = -(1 << 63)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = 0xD1342543DE82EF95
_INVERSE = pow(_POWER, -1, 1 << 64)
COLD_RUN, HOT_RUN, HOT_MARK = 0, 1, 2
#: Kinds of rows between the steps.
REMOVED, FETCH, FETCH_HOT = 0, 1, 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M3
    return h ^ (h >> np.uint64(32))


def _sliding_least(key: np.ndarray, w: int) -> np.ndarray:
    """Least of key[i : i + w] for all i."""
    n = len(key)
    blocks = -(-n // w)
    k = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    k[:n] = key
    k = k.reshape(blocks, w)
    ahead = np.minimum.accumulate(k, axis=1).ravel()
    behind = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of a slice: row, lo (within the text), len (strings less one), anchor hash, hash of the run's bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(sizes)
    n = int(end[-1]) if len(end) else 0
    none = {k: np.zeros(0, d) for k, d in (("row", np.int64), ("lo", np.int64), ("len", np.int64), ("anchor", np.uint64), ("body", np.uint64))}
    if n < LENGTH or sizes.max() < LENGTH:
        return none
    buf = np.frombuffer(b"".join(texts) + bytes(32), np.uint8)
    word = np.lib.stride_tricks.as_strided(buf[:8].view(np.uint64), (n + 24,), (1,))
    m = n - GRAM + 1
    h = word[:m] * _M1
    h = (h ^ (h >> np.uint64(29)) ^ word[8 : m + 8]) * _M2
    h = (h ^ (h >> np.uint64(32)) ^ word[16 : m + 16]) * _M3
    h ^= h >> np.uint64(29)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    anchor = _sliding_least(key, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)
    count = len(anchor)
    whole = np.zeros(count + 1, np.int32)
    long_ = sizes >= LENGTH
    np.add.at(whole, end[long_] - sizes[long_], 1)
    np.add.at(whole, end[long_] - LENGTH + 1, -1)
    valid = np.cumsum(whole[:-1]) > 0
    new = np.ones(count, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(new & valid)
    stop = np.flatnonzero(np.append((new | ~valid)[1:], True))  # last place of each stretch
    hi = stop[np.searchsorted(stop, lo)]
    steps = np.full(n + 1, _POWER, np.uint64)
    steps[0] = 1
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[buf[:n]] * np.cumprod(steps)[:n], dtype=np.uint64)])
    steps[1:] = np.uint64(_INVERSE)
    body = _mix((prefix[hi + LENGTH] - prefix[lo]) * np.cumprod(steps)[lo] + (hi - lo).astype(np.uint64))
    row = np.searchsorted(end, lo, "right")
    return {"row": row, "lo": lo - (end - sizes)[row], "len": hi - lo, "anchor": _mix(h[anchor[lo].astype(np.int64)]), "body": body}


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys (the last first, as lexsort), and first place and size of the groups of the last len(keys) keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def _fold(group: np.ndarray, doc: np.ndarray, tag: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earliest member of each group, members that come after it)."""
    order = np.lexsort((lo, tag, doc, group))
    g = group[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])[: len(g)])
    head = np.repeat(order[first], np.diff(np.append(first, len(g))))
    later = (doc[order] != doc[head]) | (tag[order] != tag[head]) | (lo[order] != lo[head])
    return order[first], order[later]


def _merged(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Spans [lo, hi) that touch, joined."""
    order = np.lexsort((lo, tag, doc))
    doc, tag, lo, hi = doc[order], tag[order], lo[order], hi[order]
    if not len(doc):
        return [doc, tag, lo, hi]
    part = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    group = np.cumsum(part)
    wide = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + group * wide) - group * wide
    new = part.copy()
    new[1:] |= lo[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return [doc[first], tag[first], lo[first], np.maximum.reduceat(hi, first)]


_SPAN = "kind int, doc long, tag long, lo long, hi long, key long"


def _spans(kind: int, doc, tag, lo, hi, key=None) -> pa.Table:
    n = len(doc)
    return pa.table({"kind": pa.array(np.full(n, kind, np.int32)), "doc": pa.array(doc), "tag": pa.array(tag), "lo": pa.array(lo.astype(np.int64)), "hi": pa.array(hi.astype(np.int64)), "key": pa.array(np.zeros(n, np.int64) if key is None else key)})


def _packed(bucket: np.ndarray, columns: list[np.ndarray], kind: int) -> pa.RecordBatch:
    """One row for each bucket, its members' columns one behind the other."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])[: len(b)])
    ends = np.append(first[1:], len(b))
    columns = [c[order] for c in columns]
    packed = [b"".join([c[i:j].tobytes() for c in columns]) for i, j in zip(first, ends)]
    return pa.RecordBatch.from_arrays([pa.array(b[first].astype(np.int64)), pa.array(np.full(len(first), kind, np.int32)), pa.array(ends - first), pa.array(packed, pa.binary())], names=["bucket", "kind", "n", "packed"])


def _unpacked(table: pa.Table, kind: int, kinds: list[np.dtype]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[np.zeros(0, d)] for d in kinds]
    for k, n, raw in zip(table["kind"].to_pylist(), table["n"].to_pylist(), table["packed"].to_pylist()):
        at = 0
        for d, part in zip(kinds, parts if k == kind else ()):
            part.append(np.frombuffer(raw, d, n, at))
            at += n * np.dtype(d).itemsize
    return [np.concatenate(p) for p in parts]


_BUCKETS = "bucket long, kind int, n long, packed binary"
#: Within its bucket an anchor is told by 32 bits; a chance meeting only sends runs to a shard for nothing.
_RUN = [np.uint32, np.uint64, np.int64, np.int64, np.uint32, np.uint8, np.uint8]
_CUT = [np.int64, np.int64, np.int64, np.int64]


def _anchors(width: int):
    """Step 1: documents (doc, tag, text) to packed runs (kind 0) and spans that a slice itself settles (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            every_doc, every_tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = raw_texts(batch.column(2))
            for a, b in slices([len(t) for t in texts], SLICE):
                r = runs_of(texts[a:b])
                if not len(r["row"]):
                    continue
                doc, tag = every_doc[a:b][r["row"]], every_tag[a:b][r["row"]]
                lo, size, anchor, body = r["lo"], r["len"], r["anchor"], r["body"]
                # equal runs fold to the earliest; only those that repeat need sorting by owner
                both = np.argsort(anchor ^ (body * _M1), kind="stable")
                same = (anchor[both][1:] == anchor[both][:-1]) & (body[both][1:] == body[both][:-1])
                group = np.empty(len(both), np.int64)
                group[both] = np.concatenate([[0], np.cumsum(~same)])
                twice = np.bincount(group)[group] > 1
                at = np.flatnonzero(twice)
                head, later = _fold(group[at], doc[at], tag[at], lo[at])
                if len(later):
                    x = at[later]
                    cut = _merged(doc[x], tag[x], lo[x], lo[x] + size[x] + LENGTH)
                    yield _packed((_mix(cut[0].view(np.uint64)) % np.uint64(width)).astype(np.int64), cut, 1)
                keep = np.sort(np.concatenate([np.flatnonzero(~twice), at[head]]))
                doc, tag, lo, size, anchor, body = (x[keep] for x in (doc, tag, lo, size, anchor, body))
                _, which, count = np.unique(anchor, return_inverse=True, return_counts=True)
                hot = count[which] > HOT
                mark = np.flatnonzero(hot)
                mark = mark[np.unique(which[mark], return_index=True)[1]]
                key = np.where(hot, _mix(anchor ^ body), anchor)
                flag = np.where(hot, HOT_RUN, COLD_RUN).astype(np.uint8)
                key = np.append(key, anchor[mark])
                bucket, short = (key % np.uint64(width)).astype(np.int64), (key // np.uint64(width)).astype(np.uint32)
                columns = [short] + [np.append(x, y) for x, y in ((body, body[mark]), (doc, doc[mark]), (tag, tag[mark]), (lo.astype(np.uint32), lo[mark].astype(np.uint32)), (size.astype(np.uint8), size[mark].astype(np.uint8)), (flag, np.full(len(mark), HOT_MARK, np.uint8)))]
                yield _packed(bucket, columns, 0)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Step 2, for one bucket of anchors."""
    out = [_spans(REMOVED, *_unpacked(table, 1, _CUT))]
    key, body, doc, tag, lo, size, flag = _unpacked(table, 0, _RUN)
    key = key.astype(np.int64) | (int(table["bucket"][0].as_py()) << 32)
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])[: len(s)])
    n = np.diff(np.append(first, len(s)))
    hot = np.maximum.reduceat(flag[order], first) > COLD_RUN if len(first) else np.zeros(0, bool)
    taken = np.repeat((n > 1) | hot, n)
    at, hot = order[taken], np.repeat(hot, n)[taken]
    fine = flag[at] != HOT_MARK
    at, hot = at[fine], hot[fine]
    if len(at):
        key, body, doc, tag, lo, size = (x[at] for x in (key, body, doc, tag, lo, size))
        o, f, c = _groups(body, key)
        group = np.empty(len(at), np.int64)
        group[o] = np.repeat(np.arange(len(f)), c)
        head, later = _fold(group, doc, tag, lo)
        high = lo.astype(np.int64) + size + LENGTH
        out.append(_spans(REMOVED, doc[later], tag[later], lo[later], high[later]))
        _, which, kinds = np.unique(key[head], return_inverse=True, return_counts=True)
        cold = head[(kinds[which] > 1) & ~hot[head]]
        out.append(_spans(FETCH, doc[cold], tag[cold], lo[cold], high[cold], key[cold]))
        warm = head[hot[head]]
        out.append(_spans(FETCH_HOT, doc[warm], tag[warm], lo[warm], high[warm], key[warm]))
    return pa.concat_tables(out)


def _strings(doc: int, tag: int, raw: bytes, wanted: list[dict], cold: list, hot: dict, late: list) -> None:
    for w in wanted:
        lo, hi = w["lo"], w["hi"]
        if w["kind"] == FETCH:
            cold.append((w["key"], doc, tag, lo, raw[lo:hi]))
            continue
        for at in range(lo, hi - LENGTH + 1):
            s, own = raw[at : at + LENGTH], (doc, tag, at)
            had = hot.setdefault(s, own)
            if had != own:
                hot[s] = min(own, had)
                late.append(max(own, had))


def _fetch(width: int, text_col: str):
    """Step 3, first half: documents with the runs wanted from them, to packed strings by shard. Further columns are let
    pass unread: with them the documents' exchange is that of the last step, and is made once."""

    def batch_of(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        by: dict[int, list] = {}
        for key, *row in rows:
            by.setdefault(key % width, []).append(row)
        packed = []
        for own in by.values():
            columns = [np.array(x, d) for x, d in zip(zip(*(r[:3] for r in own)), (np.int64, np.int64, np.int64))]
            columns.append(np.array([len(r[3]) for r in own], np.int64))
            packed.append(b"".join([c.tobytes() for c in columns] + [r[3] for r in own]))
        return pa.RecordBatch.from_arrays([pa.array(by, pa.int64()), pa.array([0] * len(by), pa.int32()), pa.array([len(x) for x in by.values()], pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "kind", "n", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text_col):
            docs, tags, texts, wanted = batch.column("_doc").to_pylist(), batch.column("_tag").to_pylist(), raw_texts(batch.column(text_col)), batch.column("_wanted")
            for a, b in slices([len(t) for t in texts], SLICE):
                cold, hot, late = [], {}, []
                for i, want in zip(range(a, b), wanted.slice(a, b - a).to_pylist()):
                    _strings(docs[i], tags[i], texts[i], want, cold, hot, late)
                if cold or hot:
                    yield batch_of(cold + [(xxhash.xxh3_64_intdigest(s), *own, s) for s, own in hot.items()])
                if late:
                    x = np.array(late, np.int64)
                    cut = _merged(x[:, 0], x[:, 1], x[:, 2], x[:, 2] + LENGTH)
                    yield _packed((_mix(cut[0].view(np.uint64)) % np.uint64(width)).astype(np.int64), cut, 1)

    return run


def repeated_spans(strings: list[bytes], doc: np.ndarray, tag: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """Step 3, second half, for one shard: spans of the strings of LENGTH bytes that also start earlier."""
    sizes = np.array([len(s) for s in strings], np.int64)
    raw = np.frombuffer(b"\0".join(strings), np.uint8)
    sa = suffix_array(raw)
    prefix = permuted_common_prefixes(raw, sa, LENGTH)[sa]
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    owner = np.repeat(np.arange(len(strings)), sizes + 1)[: len(raw)]
    inside = np.arange(len(raw)) - begin[owner]
    fits = inside + LENGTH <= sizes[owner]
    group = np.cumsum(prefix < LENGTH)
    alike = np.bincount(group)[group] > 1
    at, group = sa[alike], group[alike]
    at, group = at[fits[at]], group[fits[at]]
    who = owner[at]
    start = lo[who] + inside[at]
    _, later = _fold(group, doc[who], tag[who], start)
    return _merged(doc[who][later], tag[who][later], start[later], start[later] + LENGTH)


def _shard(table: pa.Table) -> pa.Table:
    out = [_spans(REMOVED, *_unpacked(table, 1, _CUT))]
    strings: list[bytes] = []
    parts: list[list[np.ndarray]] = [[], [], []]
    for k, n, raw in zip(table["kind"].to_pylist(), table["n"].to_pylist(), table["packed"].to_pylist()):
        if k == 0:
            columns = [np.frombuffer(raw, np.int64, n, 8 * n * i) for i in range(4)]
            for p, c in zip(parts, columns):
                p.append(c)
            ends = 32 * n + np.cumsum(columns[3])
            strings += [raw[j - m : j] for j, m in zip(ends.tolist(), columns[3].tolist())]
    if strings:
        out.append(_spans(REMOVED, *repeated_spans(strings, *(np.concatenate(p) for p in parts))))
    return pa.concat_tables(out)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), "_tag": F.xxhash64(F.col(text_col))})


def find_spans(docs: DataFrame, n_bytes: int, text_col: str = "text") -> DataFrame:
    """(_doc, _tag, _spans): what goes from each keyed document that loses anything; spans may overlap."""
    width = n_buckets(docs.sparkSession, n_bytes, BUCKET_BYTES)
    runs = docs.select("_doc", "_tag", text_col).mapInArrow(_anchors(width), _BUCKETS)
    marks = stored(runs.groupBy("bucket").applyInArrow(_meet, _SPAN), "runs")
    wanted = marks.where(F.col("kind") != REMOVED).groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_list(F.struct("kind", "lo", "hi", "key")).alias("_wanted"))
    strings = docs.join(wanted, ["_doc", "_tag"]).mapInArrow(_fetch(width, text_col), _BUCKETS)
    found = strings.groupBy("bucket").applyInArrow(_shard, _SPAN)
    spans = marks.where(F.col("kind") == REMOVED).unionByName(found)
    return spans.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))


def cut(raw: bytes, spans: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal runs that went."""
    whole: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if whole and lo <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], hi)
        else:
            whole.append([lo, hi])
    edges = [0, *(x for s in whole for x in s), len(raw)]
    return b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2])]), [(a, b) for a, b in whole]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, removed spans [from, to)."""
    keyed = _keyed(docs, id_col, text_col).select("_doc", "_tag", F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            rows = [(raw, *cut(raw, s or [])) for raw, s in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist())]
            ids = [None if x == _NO_ID else x for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(r) for r, _, _ in rows], pa.int64()), pa.array([len(r) - len(k) for r, k, _ in rows], pa.int64()), pa.array([len(s) for _, _, s in rows], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for _, k, _ in rows], pa.string()), pa.array([[list(x) for x in s] for _, _, s in rows], pa.list_(pa.list_(pa.int64())))],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    joined = keyed.join(find_spans(keyed, text_bytes(keyed, "text")), ["_doc", "_tag"], "left").select("_doc", "text", "_spans")
    return joined.mapInArrow(run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with repeated strings cut out of the texts; characters of which bytes went go whole, and length_col follows."""
    names = docs.columns
    at = names.index(text_col)
    keyed = _keyed(unnamed(docs), f"c{names.index(id_col)}", f"c{at}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, at):
            texts = [raw if raw is None else cut(raw.encode(), s)[0].decode("utf-8", "ignore") if s else raw for raw, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    spans = find_spans(keyed, text_bytes(docs, text_col), f"c{at}")
    out = keyed.join(spans, ["_doc", "_tag"], "left").select(*(f"c{i}" for i in range(len(names))), "_spans").mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
