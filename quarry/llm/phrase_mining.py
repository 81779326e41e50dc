"""Phrase collocation mining by contiguous pattern growth, PrefixSpan-style.

Occurrences of a word become pointers into what follows it in its piece of text. The pointers of one word, its projection,
are brought to one task, which extends the word to the right depth-first: pointers are dealt by the next word, and each
extension that is frequent is a prefix of its own, with its own pointers, and is extended in turn. Like continuations of
a slice of texts are one pointer with a weight, so the shuffle carries each once.

A word with many occurrences would be one large task. Words with over 1/(4 P) of all occurrences, P the number of shuffle
partitions, are therefore dealt to several tasks by their continuation; there are at most 4 P such words, so their list,
which goes to the executors, is bounded by the setting. Counts from such tasks are partial and are added up afterwards.
No task thus holds much over a quarter of an average partition's occurrences.

Frequent phrases are then scored by joins of phrases with their parts. Counts are over all texts, nothing is sampled.

Defined results: null texts are empty, a null language is `und`; texts without words count nothing; rows that repeat count
each time. Without a candidate the result is empty. Phrases are ordered by their UTF-8 bytes where score and count tie.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import portions, raw_texts, stored

#: A candidate has so many occurrences at least, and so many words at most.
LEAST, MAX_WORDS = 10, 3
#: A candidate goes if a longer one that holds it has at least so many hundredths of its occurrences.
INSIDE = 50
TOP = 2000
#: UTF-8 bytes of texts whose occurrences are projected together.
SLICE = 4 << 20

#: Words of a slice that are numbered at once.
CHUNK = 1 << 20

#: Stands for the end of a piece; no text in UTF-8 has this byte.
_END = b"\xff"
#: A-Z to a-z, ends of pieces to _END; a tab is white space as a space is, and no other white space is left.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else _END[0] if c in b".,;:!?\n\v\f\r" else c for c in range(256))


def tokens_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Words of texts with _END between pieces, in runs of about SLICE bytes; a run holds whole pieces, however long."""
    text = b".".join(texts).translate(_FOLD)
    at = 0
    while at < len(text):
        end = text.find(_END, at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(_END, b" %b " % _END).split()
        at = end


def _by_language(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    found: dict[str, list[bytes]] = defaultdict(list)
    for lang, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
        found[lang].append(raw)
    return found


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, f) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1, SLICE):
            for lang, texts in _by_language(batch).items():
                counts: Counter[bytes] = Counter()
                for tokens in tokens_of(texts):
                    counts.update(tokens)
                counts.pop(_END, None)
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "phrase", "n"])

    return _texts(docs, text_col, lang_col).mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def heavy_words(words: DataFrame, parts: int) -> dict[tuple[str, bytes], int]:
    """Words with over 1/(4 parts) of all occurrences, of which there are fewer than 4 * parts, and the number of their tasks."""
    total = words.agg(F.sum("f")).first()[0] or 0
    return {(r["lang"], r["phrase"].encode()): -(-r["f"] * 4 * parts // total) for r in words.where(F.col("f") * (4 * parts) > total).toLocalIterator()}


def _chunks(texts: list[bytes], max_words: int) -> Iterator[list[bytes]]:
    """Runs of at most CHUNK words and those that follow; they overlap, so that each word stands with its continuation in one."""
    for run in tokens_of(texts):
        run += [_END] * max_words
        for at in range(0, len(run) - max_words, CHUNK):
            yield run[at : at + CHUNK + max_words - 1]


def projections(texts: list[bytes], shards: dict[bytes, int] | None = None, max_words: int = MAX_WORDS) -> Iterator[list[pa.Array]]:
    """Columns (word, shard, occurrences, continuations) of what follows each word within its piece. There is a line for each
    next word: that word, then, after a space each, the further words of its occurrences, joined by commas, with ":n" behind
    what occurs n times. None of these marks can be in a word. A word that ends its piece has no continuation there."""
    for own in _chunks(texts, max_words):
        number = {w: i for i, w in enumerate(dict.fromkeys([_END, *own]))}
        ids = np.fromiter(map(number.__getitem__, own), np.int32, len(own))
        n = len(ids) - max_words + 1
        columns = [ids[k : n + k] for k in range(max_words)]
        for k in range(2, max_words):
            columns[k] = np.where(columns[k - 1] == 0, 0, columns[k])
        use = (columns[0] > 0) & (columns[1] > 0)
        if not use.any():
            continue
        columns = [c[use] for c in columns]
        shard = np.zeros(len(columns[0]), np.int32)
        if shards and (heavy := [(number[w], k) for w, k in shards.items() if w in number]):
            ways = np.zeros(len(number), np.int64)
            ways[[i for i, _ in heavy]] = [k for _, k in heavy]
            dealt = np.flatnonzero(ways[columns[0]])
            crc = np.fromiter(map(zlib.crc32, number), np.int64, len(number))
            mixed = np.zeros(len(dealt), np.int64)
            for c in columns[1:]:
                mixed = (mixed * 1_000_003 + crc[c[dealt]]) & 0xFFFFFFFFFFFF
            shard[dealt] = mixed % ways[columns[0][dealt]] + 1
        columns.insert(1, shard)
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]

        def starts(k: int) -> np.ndarray:
            """Where the first k columns have a new value."""
            new = np.ones(len(order), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns[:k]], 0)
            return np.flatnonzero(new)

        words = pa.array([b"", *list(number)[1:]], pa.binary())
        each, by_next, by_head = starts(max_words + 1), starts(3), starts(2)
        times = np.diff(np.append(each, len(order)))
        rest = words.take(pa.array(columns[3][each])) if max_words > 2 else pa.array([b""] * len(each), pa.binary())
        for c in columns[4:]:
            rest = pc.binary_join_element_wise(rest, words.take(pa.array(c[each])), b",")
        rest = pc.if_else(pa.array(times == 1), rest, pc.binary_join_element_wise(rest, pa.array(times).cast(pa.string()).cast(pa.binary()), b":"))
        joined = lambda x, inner, outer, mark: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(inner, outer), len(inner)).astype(np.int32)), x), mark)
        lines = pc.binary_join_element_wise(words.take(pa.array(columns[2][by_next])), joined(rest, each, by_next, b" "), b" ")
        yield [words.take(pa.array(columns[0][by_head])), pa.array(columns[1][by_head]), pa.array(np.diff(np.append(by_head, len(order)))), joined(lines, by_next, by_head, b"\n")]


def grow(head: bytes, projection: Iterable[bytes], least: int = LEAST, max_words: int = MAX_WORDS, part: bool = False) -> Iterator[tuple[bytes, int, int]]:
    """(phrase, number of words, occurrences) of the frequent extensions of a word, depth-first. Of a part of a projection,
    extensions that other parts may have too come with their count in this part, however small; only those of full length
    are all in one part."""
    dealt: dict[bytes, list[bytes]] = defaultdict(list)
    for lines in projection:
        for line in lines.split(b"\n"):
            word, _, rest = line.partition(b" ")
            dealt[word].append(rest)
    few = 1 if part and max_words > 2 else least
    for word, rests in dealt.items():
        follow: Counter[bytes] = Counter(b" ".join(rests).split(b" "))
        for c in [c for c in follow if b":" in c]:
            text, _, n = c.partition(b":")
            follow[text] += follow.pop(c) * int(n)
        n = follow.total()
        if n >= few:
            yield head + b" " + word, 2, n
            if max_words > 2:
                yield from _extend(head + b" " + word, 2, follow, least, max_words, part)


def _extend(prefix: bytes, depth: int, follow: dict[bytes, int], least: int, max_words: int, part: bool) -> Iterator[tuple[bytes, int, int]]:
    """follow: the pointers of a prefix, its further words and how often they occur."""
    if depth + 1 == max_words:
        yield from ((prefix + b" " + c, max_words, n) for c, n in follow.items() if n >= least and c)
        return
    dealt: dict[bytes, Counter[bytes]] = defaultdict(Counter)
    for c, n in follow.items():
        word, _, rest = c.partition(b",")
        if word:
            dealt[word][rest] += n
    for word, own in dealt.items():
        n = own.total()
        if n >= least or part:
            yield prefix + b" " + word, depth + 1, n
            yield from _extend(prefix + b" " + word, depth + 1, own, least, max_words, part)


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, size, f) of all phrases of 2 to max_words words that are frequent. words: see word_counts()."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy = spark.sparkContext.broadcast(heavy_words(words, parts))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, dict[bytes, int]] = defaultdict(dict)
        for (lang, word), n in heavy.value.items():
            shards[lang][word] = n
        for batch in portions(batches, 1, SLICE):
            for lang, texts in _by_language(batch).items():
                for head, shard, n, follow in projections(texts, shards.get(lang), max_words):
                    columns = [pa.array([lang] * len(head)), head.cast(pa.string()), shard, n, follow.cast(pa.string())]
                    found = pa.RecordBatch.from_arrays(columns, names=["lang", "head", "shard", "n", "follow"])
                    for at in range(0, len(found), 8192):
                        yield found.slice(at, 8192)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            lang, phrase, size, f = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(size, pa.int32()), pa.array(f, pa.int64())], names=["lang", "phrase", "size", "n"])

        def finish() -> None:
            if key and (total >= least or key[2]):
                out.extend((key[0], *x) for x in grow(key[1], held, least, max_words, key[2] > 0))

        key, held, total = None, [], 0
        for batch in batches:
            columns = [batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), raw_texts(batch.column(4))]
            for lang, head, shard, n, rows in zip(*columns):
                if key != (lang, head, shard):
                    finish()
                    key, held, total = (lang, head, shard), [], 0
                    if len(out) >= 4096:
                        yield batch_of()
                held.append(rows)
                total += n
        finish()
        if out:
            yield batch_of()

    sent = _texts(docs, text_col, lang_col).mapInArrow(project, "lang string, head string, shard int, n long, follow string")
    dealt = sent.repartition(parts, "lang", "head", "shard").sortWithinPartitions("lang", "head", "shard")
    every = dealt.mapInArrow(grown, "lang string, phrase string, size int, n long").groupBy("lang", "phrase").agg(F.max("size").alias("size"), F.sum("n").alias("f"))
    return every.where(F.col("f") >= least)


def scored(phrases: DataFrame, words: DataFrame, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase, size, a, l, r, cut, score, kept): each candidate at its lowest-scoring cut, and whether no longer
    candidate stands for it. The arithmetic is on decimals of 38 digits, which raise rather than round."""
    parts = phrases.select("lang", "phrase", "f").unionByName(words.where(F.col("phrase") != "").select("lang", "phrase", "f"))
    split = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = split.select("lang", "phrase", "size", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("cut"), "w")
    cuts = cuts.select("lang", "phrase", "size", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("size")), " ").alias("rest"))
    found = cuts.join(parts.toDF("lang", "first", "l"), ["lang", "first"]).join(parts.toDF("lang", "rest", "r"), ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('a')} * {wide('a')} * 1000000) div ({wide('l')} * {wide('r')})")
    best = found.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    # the runs of two words or more inside each longer candidate
    runs = split.where("size > 2").withColumn("run", F.explode(F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(w, i, n), ' '))))")))
    longer = runs.groupBy("lang", F.col("run").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = F.coalesce(F.col("longer") * 100 < F.col("a") * inside, F.lit(True))
    return best.join(longer, ["lang", "phrase"], "left").select("lang", "phrase", "size", "a", "best.l", "best.r", "best.cut", "best.score", kept.alias("kept"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, max_words: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    words = stored(word_counts(docs, text_col, lang_col), "words")
    phrases = stored(frequent_phrases(docs, words, least, max_words, text_col, lang_col), "phrases")
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    ordered = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored(phrases, words.where(F.col("f") >= least)).where("kept").withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    return first.join(n, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
