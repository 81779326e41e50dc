"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprints: majority bits of XXH64 over word shingles (one pass, no shuffle).
2. Equal fingerprints fold to one node before anything is compared.
3. Bits that agree more often than chance (from the co-occurrence counts over all fingerprints) are grouped into
   partitions. With thresholds t_i that sum to radius - m + 1, two fingerprints within the radius agree within t_i on
   at least one partition i. Dynamic programming picks the partition count and the thresholds with the fewest
   estimated candidates and probes. As the bits of a partition are correlated, fingerprints agree on it more often than
   independent bits would: the estimate is a beta-binomial with the mean and variance that the counts give.
4. Each fingerprint is filed under its own value of every partition and probes all values within t_i. Probes and
   entries travel packed by bucket, as many buckets as their bytes need; each meeting is verified on all 64 bits, and
   only a spanning forest of the links of a bucket leaves it, so rows stay linear in the fingerprints however large a
   group of copies is.
5. Components by alternating large-star and small-star steps on tables in the shared folder; a component's id is the
   smallest of the document ids of all its fingerprints.

A bucket key with more than CROWD members is not compared pair by pair: every member is filed under all values within
half the radius of it. Two members are within the radius exactly if they share such a value, and each value links its
members to one of them; this is exact and linear in the members.

Defined results: null and wordless texts have fingerprint zero, which links like any other. Rows that repeat an id each
get a row. Rows without an id link like any other, but take no part in choosing component_id, which is null if all ids
of the component are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, exp, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import dropped, n_buckets, portions, raw_texts, slices, stored, unnamed

_NO_ID = -(1 << 63)
SHINGLE = 4
RADIUS = 4
SEED = 42
#: Members of one bucket key that are still compared pair by pair.
CROWD = 1024
#: What one probe costs, in candidates: it is sorted, packed and shuffled (KEY_BYTES), a candidate is one comparison.
PROBE_COST = 160.0
#: A key with its fingerprint and whether it is an entry; bytes of them that a bucket should hold.
KEY_BYTES, BUCKET_BYTES = 17, 8 << 20


def fingerprint_many(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints of UTF-8 texts."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        ws = t.lower().split()  # bytes: A-Z only, and white space 09-0D and 20
        n = len(ws)
        if n > size:
            flat = b" ".join(ws)
            lens = np.fromiter(map(len, ws), np.int64, n)
            ends = np.cumsum(lens + 1) - 1
            starts = ends - lens
            hashes += [digest(flat[a:b], SEED) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())]
            counts[i] = n - size + 1
        elif n:
            hashes.append(digest(b" ".join(ws), SEED))
            counts[i] = 1
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        every = np.array(hashes, np.uint64)
        starts = (np.cumsum(counts) - counts)[some]
        for bit in range(64):
            ones = np.add.reduceat(((every >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
            out[some] |= (2 * ones > counts[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """One row per document: id, fp (the fingerprint's bits as a signed long), and further long columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            texts = raw_texts(batch.column(1))
            fps = [fingerprint_many(texts[a:b]) for a, b in slices([len(t) for t in texts])]
            fp = np.concatenate(fps or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp), *batch.columns[2:]], names=[id_col, "fp", *more])

    return docs.select(id_col, text_col, *more).mapInArrow(run, ", ".join(f"{c} long" for c in (id_col, "fp", *more)))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).astype(np.int64)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how often each two bits are set together: 64 rows, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            b = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            for i in range(0, len(b), 1 << 16):
                total += b[i : i + (1 << 16)].T @ b[i : i + (1 << 16)]
            n += len(b)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([n] * 64, pa.int64()), *(pa.array(total[:, j].astype(np.int64)) for j in range(64))], names=["i", "n", *(f"b{j}" for j in range(64))])

    part = nodes.select("fp").mapInArrow(run, "i int, n long, " + ", ".join(f"b{j} long" for j in range(64)))
    rows = part.groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(f"b{j}").alias(f"b{j}") for j in range(64))).orderBy("i").collect()
    if not rows:
        return 0, np.zeros((64, 64))
    return rows[0]["n"], np.array([[r[f"b{j}"] for j in range(64)] for r in rows], float)


def correlated_groups(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near-equal width; each takes the free bit most correlated with those it has."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free = set(range(64))
    groups = []
    for g in range(m):
        width = (64 - sum(map(len, groups))) // (m - g)
        own = [max(sorted(free), key=lambda b: spread[b])]
        free.discard(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: corr[b, own].mean())
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def _meeting_odds(bits: list[int], p: np.ndarray, joint: np.ndarray, upto: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0, 1, ... upto of the bits.

    Two fingerprints differ in both of two bits with chance 2 (p11 p00 + p10 p01); these give the variance of how many
    bits differ, which is more than independent bits have. p: how often a bit is set; joint: how often two are."""
    w = len(bits)
    q = p[bits]
    both = joint[np.ix_(bits, bits)]
    one, other = q[:, None] - both, q[None, :] - both
    neither = 1 - q[:, None] - q[None, :] + both
    differ = 2 * q * (1 - q)
    twice = 2 * (both * neither + one * other)
    np.fill_diagonal(twice, differ)
    mean = differ.sum() / w
    variance = max(float((twice - np.outer(differ, differ)).sum()), 0.0)
    even = w * mean * (1 - mean)
    rho = min(max((variance / even - 1) / (w - 1), 0.0), 0.999) if even > 0 and w > 1 else 0.0
    odds = np.zeros(upto + 1)
    if rho > 1e-9:
        a, b = mean * (1 - rho) / rho, (1 - mean) * (1 - rho) / rho
        log_beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
        for k in range(min(upto, w) + 1):
            odds[k] = comb(w, k) * exp(log_beta(k + a, w - k + b) - log_beta(a, b))
    else:
        odds[0] = 1.0
        for d in differ:
            odds[1:] = odds[1:] * (1 - d) + odds[:-1] * d
            odds[0] *= 1 - d
    return np.minimum(np.cumsum(odds), 1.0)


def _probes(width: int, t: int) -> int:
    total, c = 0, 1
    for k in range(t + 1):
        total += c
        c = c * (width - k) // (k + 1)
    return total


def allocate(n: int, together: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions with thresholds (those without one are left out), of least estimated cost."""
    joint = together / max(n, 1)
    p = np.diag(joint)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(2, radius + 2):
        groups = correlated_groups(n, together, m)
        want = radius - m + 1 + m  # thresholds from -1 up, counted from 0 by adding one to each
        cost = np.full((m + 1, want + 1), np.inf)
        cost[0, 0] = 0.0
        back: dict[tuple[int, int], int] = {}
        for i, g in enumerate(groups):
            odds = _meeting_odds(g, p, joint, radius)
            for have in range(want + 1):
                if np.isinf(cost[i, have]):
                    continue
                for t in range(-1, min(radius, len(g), want - have - 1) + 1):
                    price = 0.0 if t < 0 else n * n / 2.0 * odds[t] + PROBE_COST * n * _probes(len(g), t)
                    if cost[i, have] + price < cost[i + 1, have + t + 1]:
                        cost[i + 1, have + t + 1] = cost[i, have] + price
                        back[i + 1, have + t + 1] = t
        chosen, have = [], want
        for i in range(m, 0, -1):
            t = back[i, have]
            if t >= 0:
                chosen.append((groups[i - 1], t))
            have -= t + 1
        if best is None or cost[m, want] < best[0]:
            best = float(cost[m, want]), chosen[::-1]
    return best[1]


def _mask(bits: tuple[int, ...] | list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def _mix(key: np.ndarray, part: int) -> np.ndarray:
    h = (key ^ np.uint64(part * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a - b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        root = _roots(root)
    return root


def crowd_links(fp: np.ndarray, radius: int = RADIUS, slice_rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what lies within the radius, through shared values within half of it; linear in fp.

    Needs an even radius: two values at distance d <= radius have one within radius / 2 of both."""
    free = [b for b in range(64) if len(np.unique((fp >> np.uint64(b)) & np.uint64(1))) > 1]
    flips = np.array([np.uint64(0)] + [_mask(c) for k in range(1, radius // 2 + 1) for c in combinations(free, k)], np.uint64)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    n_slots = max(1, len(fp) * len(flips) // (slice_rows * 2048))
    for slot in range(n_slots):  # values in slots, so that one slot's keys are held at a time
        keys, owners = [], []
        for i in range(0, len(fp), slice_rows):
            k = (fp[i : i + slice_rows, None] ^ flips[None, :]).ravel()
            o = np.repeat(np.arange(i, min(i + slice_rows, len(fp))), len(flips))
            if n_slots > 1:
                mine = _mix(k, 99) % np.uint64(n_slots) == slot
                k, o = k[mine], o[mine]
            keys.append(k)
            owners.append(o)
        k, o = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        head = np.repeat(o[start], np.diff(np.append(start, len(k))))
        linked = np.unique(np.stack([head, o], 1)[head != o], axis=0)
        links.append((linked[:, 0], linked[:, 1]))
    return np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])


def bucket_links(key: np.ndarray, fp: np.ndarray, entry: np.ndarray, radius: int = RADIUS, crowd: int = CROWD) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint of its tree) links among what meets under equal keys in one bucket."""
    order = np.lexsort((~entry, key))
    key, fp, entry = key[order], fp[order], entry[order]
    node_fp, node = np.unique(fp.view(np.int64), return_inverse=True)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    n_entry = np.add.reduceat(entry.astype(np.int64), start)
    found_a, found_b = [], []
    fine = (n_entry > 0) & (size > 1) & (size <= crowd)
    s, c, e = start[fine], size[fine], n_entry[fine]
    pairs = c * e
    for i, j in slices(pairs.tolist(), 1 << 21):  # every member of a key against its entries
        own = pairs[i:j]
        k = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        wide = np.repeat(e[i:j], own)
        a, b = np.repeat(s[i:j], own) + k // wide, np.repeat(s[i:j], own) + k % wide
        near = (popcount(fp[a] ^ fp[b]) <= radius) & (node[a] != node[b])
        found_a.append(node[a[near]])
        found_b.append(node[b[near]])
    for x in np.flatnonzero((n_entry > 0) & (size > crowd)):
        own = np.unique(node[start[x] : start[x] + size[x]])
        a, b = crowd_links(node_fp[own].view(np.uint64), radius)
        found_a.append(own[a])
        found_b.append(own[b])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = _forest(len(node_fp), np.concatenate(found_a), np.concatenate(found_b))
    moved = np.flatnonzero(root != np.arange(len(root)))
    return node_fp[moved], node_fp[root[moved]]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v), v < u: links that connect all fingerprints (fp, distinct) within the radius."""
    spark = nodes.sparkSession
    n, together = bit_statistics(nodes)
    plan = allocate(n, together, radius)
    width = n_buckets(spark, n * KEY_BYTES * sum(_probes(len(bits), t) for bits, t in plan), BUCKET_BYTES)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 20_000):
                fp = every[at : at + 20_000]
                keys, owner, entry = [], [], []
                for part, (bits, t) in enumerate(plan):
                    own = fp & _mask(bits)
                    for k in range(t + 1):
                        for c in combinations(bits, k):
                            keys.append(_mix(own ^ _mask(c), part))
                            owner.append(np.arange(len(fp)))
                            entry.append(np.full(len(fp), k == 0))
                key, o, e = np.concatenate(keys), np.concatenate(owner), np.concatenate(entry)
                bucket = (key % np.uint64(width)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, o, e, bucket = key[order], o[order], e[order], bucket[order]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.append(cut[1:], len(bucket))
                packed = [key[a:b].tobytes() + fp[o[a:b]].tobytes() + e[a:b].tobytes() for a, b in zip(cut, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(ends - cut), pa.array(packed, pa.binary())], names=["bucket", "n", "packed"])

    def meet(t: pa.Table) -> pa.Table:
        parts = []
        for n_rows, raw in zip(t["n"].to_pylist(), t["packed"].to_pylist()):
            parts.append((np.frombuffer(raw, np.uint64, n_rows), np.frombuffer(raw, np.uint64, n_rows, 8 * n_rows), np.frombuffer(raw, bool, n_rows, 16 * n_rows)))
        u, v = bucket_links(*(np.concatenate(x) for x in zip(*parts)), radius=radius)
        return pa.table({"u": u, "v": v})

    packed = nodes.select("fp").mapInArrow(file, "bucket long, n long, packed binary")
    return packed.groupBy("bucket").applyInArrow(meet, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v): every node that has a link and isn't its component's smallest, with that smallest node."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: the larger neighbours of a node move to its smallest neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        then = stored(small, "edges")
        mark = [F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")]
        settled = then.agg(*mark).first() == now.agg(*mark).first()
        dropped(now)
        if settled:
            return then
        now = then
    raise RuntimeError("components did not settle")


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, rep): each fingerprint's component, named by its smallest fingerprint, and the component's smallest id."""
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    settled = components(links(nodes, radius))
    rooted = stored(nodes.join(settled.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "rep", F.coalesce("v", "fp").alias("root")), "rooted")
    # a root's own row is in rooted, so components of one fingerprint need no join
    wide = rooted.join(settled.select(F.col("v").alias("root")).distinct(), "root", "left_semi").groupBy("root").agg(F.min("rep").alias("least"))
    return rooted.join(wide, "root", "left").select("fp", "root", F.coalesce("least", "rep").alias("rep"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fp, fingerprint (hex), component_id."""
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    named = grouped(prints.select("fp", F.col(id_col).alias("id")), radius)
    return prints.join(named, "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("rep").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, then fingerprint, then text hash; a row
    without an id stays only where no row of its component has one."""
    at_id, at_text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    keyed = unnamed(docs).withColumns({"_id": F.coalesce(F.col(at_id).cast("long"), F.lit(_NO_ID)), "_tag": F.xxhash64(at_text)})
    prints = stored(fingerprints(keyed, "_id", at_text, "_tag"), "fingerprints")
    named = grouped(prints.select("fp", F.col("_id").alias("id")), radius).select("fp", "root")
    order = F.struct(F.col("_id") == _NO_ID, "_id", "fp", "_tag")
    best = prints.join(named, "fp").groupBy("root").agg(F.min(order).alias("x")).select("x._id", "x._tag")
    return keyed.join(best, ["_id", "_tag"], "left_semi").dropDuplicates(["_id", "_tag"]).drop("_id", "_tag").toDF(*docs.columns)
