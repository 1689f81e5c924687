"""Phrase collocations: count-min sketches prune, a last pass counts what survives, scores and subsumes.

Every task adds its n-grams up in a sparse count-min sketch (Cormode and Muthukrishnan, 2005) of two rows of cells. Spark
merges the tasks' sketches block by block. A cell holds at least the count of each n-gram that falls into it, so an n-gram
with a cell below the threshold is not frequent, and one that is frequent is never lost. There are three sketches: of words,
of pairs of words that survive, and of longer n-grams all of whose pairs survive.

The exact pass reads the texts again and counts, in full, the n-grams that survive with all their parts. These counts hold
all that a score needs, since every part of a frequent phrase is as frequent at least. Scores and subsumption are joins and
groupings of the counts.

Of the merged sketches tasks get one bit a cell. There are about as many cells as words, up to ``MOST_CELLS``; beyond that a
sketch prunes less, the exact pass carries more, and the result is the same.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

LEAST = 30
WORDS = 4
TOP = 2_000
NO_LANG = "und"
#: Cells in a sketch's row: at most, at least, and the bytes of text for one.
MOST_CELLS = 1 << 29
FEWEST_CELLS = 1 << 16
BYTES_PER_CELL = 8
#: Blocks that the cells of both rows are merged in.
BLOCKS = 1 << 11
#: Parts that a language's phrases are dealt to.
BUCKETS = 256
#: Cells with counts, and phrases, that a task holds before it hands them on.
HELD_CELLS = 3_000_000
HELD_PHRASES = 500_000
#: Bytes of text worked on together.
CHUNK_BYTES = 2_000_000
_TIMES = np.uint64(0x9E3779B97F4A7C15)
#: Ends of pieces become a full stop, which no word holds; a tab becomes a space.
_STOP = b"."
_TABLE = bytes.maketrans(b",;:!?\n\v\f\r\t", b".........\x20")


class Grams:
    """The words of a chunk: ``ids`` in order (0 ends a piece), the different ``words``, their hashes, and n-grams by place."""

    def __init__(self, chunk: bytes, salt: int):
        self.tokens = chunk.replace(_STOP, b" . ").split()
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        numbers[_STOP]  # noqa: B018  gets number 0
        self.ids = np.fromiter(map(numbers.__getitem__, self.tokens), dtype=np.int64, count=len(self.tokens))
        self.words = list(numbers)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, salt) for w in self.words), dtype=np.uint64, count=len(self.words))

    def longer(self, starts: np.ndarray, hashes: np.ndarray, size: int, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of n-grams of ``size - 1`` words at ``starts``, those that a usable word continues, and their hashes."""
        inside = starts + size - 1 < len(self.ids)
        starts, hashes = starts[inside], hashes[inside]
        following = self.ids[starts + size - 1]
        fine = usable[following]
        with np.errstate(over="ignore"):
            h = hashes[fine] * _TIMES + self.hashes[following[fine]]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return starts[fine], h ^ (h >> np.uint64(29))

    def usable(self, words: Bits) -> np.ndarray:
        out = words.hold(self.hashes)
        out[0] = False
        return out

    def survivors(self, known: list[Bits]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Size, places and hashes of the n-grams of two words or more that survive the sketches ``known`` so far with all
        their parts. The sketches: of words, of pairs, of longer n-grams."""
        usable = self.usable(known[0])
        starts = np.flatnonzero(usable[self.ids])
        hashes = self.hashes[self.ids[starts]]
        for size in range(2, WORDS + 1):
            there = np.zeros(len(self.ids) + 1, dtype=bool)
            there[starts] = True
            starts, hashes = self.longer(starts, hashes, size, usable)
            fine = there[starts + 1]
            if (at := min(size - 1, 2)) < len(known):
                fine &= known[at].hold(hashes)
            starts, hashes = starts[fine], hashes[fine]
            yield size, starts, hashes


def chunks(batch: pd.DataFrame) -> Iterator[tuple[str, bytes]]:
    """(lang, pieces) of a batch's texts, cut between pieces; a piece that is longer than a chunk stays whole."""
    for lang, texts in batch.groupby("lang", sort=False)["text"]:
        held: list[bytes] = []
        size = 0
        for k, text in enumerate(texts):
            held.append(text.encode("utf-8", "replace"))
            size += len(held[-1])
            if size < CHUNK_BYTES and k < len(texts) - 1:
                continue
            data, held, size = _STOP.join(held).lower().translate(_TABLE), [], 0
            start = 0
            while start < len(data):
                stop = start + CHUNK_BYTES
                if stop < len(data):
                    stop = data.rfind(_STOP, start, stop) if _STOP in data[start:stop] else data.find(_STOP, stop)
                    stop = len(data) if stop < 0 else stop + 1
                yield lang, data[start:stop]
                start = stop


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    """An n-gram's cell in the first row, and in the second, which lies after the first."""
    mask = np.uint64(cells - 1)
    return np.stack([hashes & mask, ((hashes >> np.uint64(32)) & mask) + np.uint64(cells)]).astype(np.uint32)


class Bits:
    """One bit for each cell: whether its count reaches the threshold."""

    def __init__(self, cells: int, packed: np.ndarray):
        self.cells, self._packed = cells, packed

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        fine = np.ones(len(hashes), dtype=bool)
        for at in cells_of(hashes, self.cells):
            fine &= (self._packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return fine


class _Cells:
    """A task's sketch: the cells that are not empty, and their counts."""

    def __init__(self, cells: int):
        self._cells, self._parts, self._size = cells, [], 0

    def add(self, hashes: np.ndarray, n: np.ndarray) -> None:
        if not len(hashes):
            return
        self._parts.append((cells_of(hashes, self._cells).ravel(), np.tile(n, 2)))
        self._size += 2 * len(hashes)
        if self._size > HELD_CELLS:
            self._parts = [self._merged()]
            self._size = len(self._parts[0][0])

    def full(self) -> bool:
        return self._size > HELD_CELLS // 2 and len(self._parts) == 1

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        at, n = (np.concatenate(x) for x in zip(*self._parts))
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return at[first], np.add.reduceat(n[order], first)

    def blocks(self) -> Iterator[pd.DataFrame]:
        """Rows of block, cells (each one's distance from the one before it, compressed) and their counts."""
        if not self._parts:
            return
        at, n = self._merged()
        self._parts, self._size = [], 0
        wide = 2 * self._cells // BLOCKS
        block, first = np.unique(at // wide, return_index=True)
        rows = [slice(a, b) for a, b in zip(first, [*first[1:], len(at)])]
        inner, counts = at % wide, np.minimum(n, 1 << 30).astype("<u4")
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            yield pd.DataFrame({"block": block[k : k + 256].astype(np.int64), "cells": [_packed(np.diff(inner[r], prepend=0)) for r in part], "counts": [_packed(counts[r]) for r in part]})


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<u4")


def sketch(rows: DataFrame, cells: int, least: int, known: list) -> Bits:
    """Bits of the merged sketches over (lang, text): of words, of pairs, or of longer n-grams, as one, two or none are ``known``."""
    wide = 2 * cells // BLOCKS

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Cells(cells)
        for batch in batches:
            for lang, chunk in chunks(batch):
                grams = Grams(chunk, xxhash.xxh32_intdigest(lang))
                if not known:
                    held.add(grams.hashes[1:], np.bincount(grams.ids, minlength=len(grams.words))[1:])
                    continue
                for size, _, hashes in grams.survivors([b.value for b in known]):
                    if min(size - 1, 2) == len(known):
                        held.add(*np.unique(hashes, return_counts=True))
                    elif size > len(known):
                        break
                if held.full():
                    yield from held.blocks()
            if held.full():
                yield from held.blocks()
        yield from held.blocks()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, counts in zip(batch["block"], batch["cells"], batch["counts"]):
                if block not in held:
                    held[block] = np.zeros(wide, dtype=np.uint32)
                dense, at = held[block], np.cumsum(_unpacked(at), dtype=np.int64)  # each cell once
                dense[at] = np.minimum(dense[at] + _unpacked(counts), 1 << 30)
        for block, dense in held.items():
            yield pd.DataFrame({"block": [block], "bits": [np.packbits(dense >= least).tobytes()]})

    sent = rows.mapInPandas(add, "block long, cells binary, counts binary")
    merged = sent.repartition(common.tasks(rows), "block").mapInPandas(merge, "block long, bits binary")
    packed = np.zeros(2 * cells // 8, dtype=np.uint8)
    for r in merged.toLocalIterator():  # at most 2 * MOST_CELLS bits
        packed[r.block * wide // 8 : (r.block + 1) * wide // 8] = np.frombuffer(r.bits, np.uint8)
    return Bits(cells, packed)


def exact_counts(rows: DataFrame, known: list, least: int) -> DataFrame:
    """(lang, phrase, n): occurrences of all n-grams that survive the sketches with all their parts, if there are ``least``;
    the phrase '' stands for all words of a language. Tasks send many phrases in a row, dealt by the phrase's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))

        def hand_on() -> Iterator[pd.DataFrame]:
            for lang, counts in held.items():
                parts: dict[int, list[bytes]] = defaultdict(list)
                for phrase in sorted(counts):
                    parts[xxhash.xxh32_intdigest(phrase) % BUCKETS].append(phrase)
                times = [np.fromiter(map(counts.__getitem__, phrases), dtype="<i8", count=len(phrases)) for phrases in parts.values()]
                yield pd.DataFrame({"lang": lang, "bucket": list(parts), "phrases": [zstandard.compress(b"\n".join(x), 1) for x in parts.values()], "n": [zstandard.compress(x.tobytes(), 1) for x in times]})
            held.clear()

        for batch in batches:
            for lang, chunk in chunks(batch):
                _count(Grams(chunk, xxhash.xxh32_intdigest(lang)), [b.value for b in known], held[lang])
                if sum(map(len, held.values())) > HELD_PHRASES:
                    yield from hand_on()
        yield from hand_on()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        for batch in batches:
            for lang, phrases, n in zip(batch["lang"], batch["phrases"], batch["n"]):
                counts = held[lang]
                for phrase, times in zip(zstandard.decompress(phrases).split(b"\n"), np.frombuffer(zstandard.decompress(n), "<i8").tolist()):
                    counts[phrase] += times
        for lang, counts in held.items():
            kept = [(p.decode("utf-8", "replace"), n) for p, n in counts.items() if n >= least or not p]
            for k in range(0, len(kept), 50_000):
                yield pd.DataFrame(kept[k : k + 50_000], columns=["phrase", "n"]).assign(lang=lang)

    sent = rows.mapInPandas(run, "lang string, bucket int, phrases binary, n binary")
    return sent.repartition(common.tasks(rows), "lang", "bucket").mapInPandas(add, "lang string, phrase string, n long")


def _count(grams: Grams, known: list[Bits], counts: dict[bytes, int]) -> None:
    ids, tokens = grams.ids, grams.tokens
    usable = grams.usable(known[0])
    occurs = np.bincount(ids, minlength=len(grams.words))
    counts[b""] += int(occurs[1:].sum())
    for k in np.flatnonzero(usable & (occurs > 0)):
        counts[grams.words[k]] += int(occurs[k])
    before = np.flatnonzero(usable[ids])
    rank = ids[before]
    for size, starts, _ in grams.survivors(known):
        if not len(starts):
            return
        # an n-gram's number is that of the one before it and its last word: no hash decides what is equal
        key = rank[np.searchsorted(before, starts)] << 32 | ids[starts + size - 1]
        _, first, rank, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        for at, times in zip(starts[first].tolist(), n.tolist()):
            counts[b" ".join(tokens[at : at + size])] += times
        before = starts


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, phrase, n) of the phrases of up to ``WORDS`` words that occur ``least`` times or more, and '' for all words."""
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), common.text_or_empty(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(MOST_CELLS, max(FEWEST_CELLS, 1 << (size // BYTES_PER_CELL).bit_length()))
    known: list = []
    for _ in range(3):
        known.append(df.sparkSession.sparkContext.broadcast(sketch(rows, cells, least, known)))
    found = common.shared_table(exact_counts(rows, known, least), "phrases")
    for bits in known:
        bits.destroy()
    return found


def _part(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the candidates in ``counts``: the cut with the lowest score, ties to the earliest."""
    named = counts.where("phrase != ''")
    candidates = named.withColumn("words", F.split("phrase", " ")).where(F.size("words") >= 2)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumns({"first": _part(1, F.col("k")), "rest": _part(F.col("k") + 1, F.size("words") - F.col("k"))})
    part = lambda key, value: named.select("lang", F.col("phrase").alias(key), F.col("n").alias(value))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(2000000BD * n) div (cast(l as decimal(20, 0)) + r)")  # whole numbers beyond 64 bits
    least = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", F.col("n").alias("a"), "l", "r")).alias("b"))
    return least.select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")


def subsumed(counts: DataFrame, percent: int = 80) -> DataFrame:
    """(lang, phrase) of the candidates that lie inside a longer one with ``percent`` of their count or more."""
    words = counts.where("phrase != ''").withColumn("words", F.split("phrase", " "))

    def inside(size: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda k: _part(k, size))
        return F.when(F.size("words") > size, every)

    inner = [inside(size) for size in range(2, WORDS)]
    parts = F.explode(F.array_distinct(F.flatten(F.filter(F.array(*inner), lambda x: x.isNotNull()))))
    longest = words.where(F.size("words") > 2).select("lang", parts.alias("phrase"), F.col("n").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    enough = F.expr(f"100BD * longer >= {percent}BD * n")
    return counts.join(longest, ["lang", "phrase"]).where(enough).select("lang", "phrase")


def mine(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score, then count, then bytes.

    A null language counts as ``und``, a null text as empty; texts without a phrase that occurs ``least`` times give no rows. Repeated rows count as often as they occur. Only text and lang are read.
    """
    counts = phrase_counts(df, text, lang, least)
    kept = scored(counts).join(subsumed(counts), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # two steps, so that no task orders all phrases of one language
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("phrase = ''").select("lang", F.col("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(common.documents(spark, sf_dir))


SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i+m-1], ' '))) AS phrase FROM w, range(1, 5) t(m) WHERE len(w) >= m),
    c AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang),
    k AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE m >= 2 AND f >= 30),
    cuts AS (SELECT k.lang, k.phrase, a, i, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f::HUGEINT + r.f))::BIGINT AS score FROM k, range(1, 4) t(i)
        JOIN c l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:i], ' ') JOIN c r ON r.lang = k.lang AND r.phrase = array_to_string(w[i+1:], ' ') WHERE i < k.m),
    best AS (SELECT lang, phrase, a, arg_min(l, (score, i)) AS l, arg_min(r, (score, i)) AS r, min(score) AS score FROM cuts GROUP BY ALL),
    longer AS (SELECT DISTINCT lang, array_to_string(w[s:s+z-1], ' ') AS phrase, a AS f FROM k, range(2, 4) u(z), range(1, 4) t(s) WHERE z < m AND s + z - 1 <= m),
    kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM longer WHERE longer.lang = best.lang AND longer.phrase = best.phrase AND 100 * longer.f >= 80 * best.a)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
    SELECT ranked.lang, rank::INT AS rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
