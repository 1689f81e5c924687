"""Packing of token pieces into sequences of fixed capacity by linear grouping.

Lengths are whole numbers up to the capacity, so a histogram of lengths, at most ``capacity`` counts whatever the size
of the corpus, holds all that the plan depends on. The plan is made on that histogram:

1. large lengths are sorted, cut into groups of equal cardinality, and rounded up to their group's largest;
2. the few rounded sizes are packed by the configuration programme, solved by column generation;
3. actual lengths take the places of the rounded ones, longest first; the last place of a configuration goes to the
   longest large length that the room left by the others allows, so that rounding up wastes no space;
4. what is left, then the small lengths, go best-fit, largest first, into the remaining space.

Each bin class of the plan says how many sequences hold the same lengths in the same order. Pieces are then numbered
within their length by a distributed rank, and an interval lookup turns (length, rank) into a sequence and an offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

CAPACITY = 2048
#: Lengths above ``capacity // LARGE_PART`` are large.
LARGE_PART = 8
#: Room that a planned sequence of large lengths may leave for others. A plan is made with each of these, and the one with the
#: fewest sequences stays, of equal ones the first: where lengths are few, configurations that leave room are the best there are;
#: where there are many lengths, those that actual lengths fill leave more to choose from.
SLACKS = (CAPACITY, 64, 8, 0)
GROUPS = 48
TOKENIZER = "word_bpe_49k.json"


def _price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of largest value: a knapsack over whole-number sizes, one item more at each layer."""
    best = np.zeros(capacity + 1)
    layers = []
    for _ in range(capacity // int(sizes.min())):
        now, took = best.copy(), np.full(capacity + 1, -1)
        for k, (size, value) in enumerate(zip(sizes, values)):
            with_it = best[: capacity + 1 - size] + value
            more = with_it > now[size:] + 1e-12
            now[size:][more] = with_it[more]
            took[size:][more] = k
        layers.append(took)
        best = now
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    for took in layers[::-1]:
        if took[c] >= 0:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return best[capacity], pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 200) -> list[tuple[np.ndarray, int]]:
    """Configurations of rounded sizes and how often to use each, from the linear programme rounded down."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(columns)
        use = inverse @ demand
        value, pattern = _price(sizes, np.maximum(inverse.sum(axis=0), 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(ratio.argmin())] = pattern
    use = np.linalg.inv(columns) @ demand
    return [(columns[:, j].astype(np.int64), int(use[j] + 1e-6)) for j in range(k) if use[j] >= 1 - 1e-6]


def _grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, list[list[int]]]]:
    """Groups of equal cardinality, longest first: (rounded size, [[length, count], ...] longest first)."""
    total, out, room = int(counts.sum()), [], 0
    per = -(-total // groups)
    for length, count in zip(lengths[::-1].tolist(), counts[::-1].tolist()):
        while count:
            if not room:
                out.append((length, []))
                room = per
            n = min(room, count)
            out[-1][1].append([length, n])
            room, count = room - n, count - n
    return out


def _fill(slots: list[int], times: int, groups_of: dict[int, list[list[int]]], left: dict[int, int], large: list[int], capacity: int, slack: int) -> list[tuple[list[int], int]]:
    """Puts actual lengths into ``times`` sequences of one configuration. All places but the last take members of their
    group, longest first; the last takes the longest large length still there that fits, and the place before it the
    member of its group with which that leaves least room. Ends early where a group has run out, or where more than
    ``slack`` would be left: those lengths go best-fit."""
    out = []
    while times:
        content: list[int] = []
        taken: dict[int, int] = {}

        def free(length: int) -> int:
            return left[length] - taken.get(length, 0)

        def take(length: int) -> None:
            content.append(length)
            taken[length] = taken.get(length, 0) + 1

        for size in slots[:-2]:
            members = groups_of[size]
            while members and not left[members[0]]:  # all of them are in sequences
                members.pop(0)
            length = next((x for x in members if free(x) > 0), None)
            if length is None:
                return out
            take(length)
        best = None
        for first in groups_of[slots[-2]] if len(slots) > 1 else [0]:
            if first and free(first) <= 0:
                continue
            room = capacity - sum(content) - first
            k = bisect_right(large, room) - 1
            while k >= 0 and free(large[k]) <= (large[k] == first):
                k -= 1
            if k >= 0 and (best is None or room - large[k] < best[0]):
                best = room - large[k], first, large[k]
                if not best[0]:
                    break
        if best is None or best[0] > slack:
            return out
        for length in best[1:]:
            if length:
                take(length)
        n = min(times, *(left[x] // m for x, m in taken.items()))
        for x, m in taken.items():
            left[x] -= m * n
        out.append((content, n))
        times -= n
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[list[int], int]]:
    """Bin classes: (lengths in order, number of sequences). Every piece of the histogram is in exactly one."""
    return min((_planned(histogram, capacity, groups, slack) for slack in SLACKS), key=lambda bins: sum(n for _, n in bins))


def _planned(histogram: dict[int, int], capacity: int, groups: int, slack: int) -> list[tuple[list[int], int]]:
    left = {int(k): int(v) for k, v in histogram.items() if v}
    if any(k < 1 or k > capacity for k in left):
        raise ValueError("a piece is longer than a sequence, or empty")
    done: list[tuple[list[int], int]] = []
    if capacity in left:
        done.append(([capacity], left.pop(capacity)))
    open_bins: list[tuple[list[int], int]] = []
    large = np.array(sorted(k for k in left if k > capacity // LARGE_PART), dtype=np.int64)
    if len(large):
        grouped: dict[int, list[list[int]]] = {}
        for size, members in _grouped(large, np.array([left[int(k)] for k in large]), groups):
            grouped.setdefault(size, []).extend(members)
        sizes = np.array(sorted(grouped), dtype=np.int64)
        demand = np.array([sum(n for _, n in grouped[int(s)]) for s in sizes], dtype=float)
        groups_of = {size: [x for x, _ in members] for size, members in grouped.items()}
        # the fullest configurations first: there the last place has the least choice
        found = sorted(configurations(sizes, demand, capacity), key=lambda c: -int(c[0] @ sizes))
        for pattern, times in found:
            slots = [int(s) for s, n in zip(sizes, pattern) for _ in range(n)][::-1]
            open_bins += _fill(slots, times, groups_of, left, large.tolist(), capacity, slack)
    rooms: dict[int, list[tuple[list[int], int]]] = {}
    for content, n in open_bins:
        rooms.setdefault(capacity - sum(content), []).append((content, n))
    for length in sorted((k for k, v in left.items() if v), reverse=True):
        count = left[length]
        while count:
            room = min((r for r in rooms if r >= length and rooms[r]), default=None)
            if room is None:
                per = capacity // length
                full, rest = divmod(count, per)
                if full:
                    rooms.setdefault(capacity - per * length, []).append(([length] * per, full))
                if rest:
                    rooms.setdefault(capacity - rest * length, []).append(([length] * rest, 1))
                break
            content, n = rooms[room].pop()
            used = min(n, count)
            if used < n:
                rooms[room].append((content, n - used))
            rooms.setdefault(room - length, []).append((content + [length], used))
            count -= used
    return done + [x for r in sorted(rooms) for x in rooms[r]]


def _lookup(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Intervals of ranks, sorted by (length, first rank): where the pieces of each length go."""
    rows, taken, first = [], {}, 0
    for content, times in bins:
        offset = 0
        for length in content:
            start = taken.get(length, 0)
            rows.append((length, start, first, offset))
            taken[length] = start + times
            offset += length
        first += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "start", "sequence", "offset"), table.T))


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to every row of ``pieces``, a written table with lengths from 1 to ``capacity``.

    Equal rows each get a place of their own. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most ``capacity`` rows
    if not histogram:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = spark.sparkContext.broadcast(_lookup(plan(histogram, capacity)))  # bounded by capacity, not by rows
    numbered = common.ranked(pieces, length, [F.col(c) for c in order], "__rank", sum(histogram.values()))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        t = table.value
        base = np.int64(2**50)
        keys = t["length"] * base + t["start"]
        at = np.searchsorted(keys, lengths.to_numpy("int64") * base + ranks.to_numpy("int64"), side="right") - 1
        return pd.DataFrame({"sequence_id": t["sequence"][at] + ranks.to_numpy("int64") - t["start"][at], "offset": t["offset"][at]})

    return numbered.withColumn("__p", place(length, "__rank")).select(*[c for c in numbered.columns if c != "__rank"], "__p.sequence_id", "__p.offset")


def pieces_of(df: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = 0, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Token pieces: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for.

    A document's ids end with ``end_id``; null text counts as empty and gives one piece of one id. Only longer documents
    are cut. Other columns of ``df`` are not read.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        tail, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            ids, piece, start, length, crc, kept = [], [], [], [], [], []
            for doc_id, packed in zip(batch["doc_id"], encode(batch["text"].tolist())):
                packed += tail
                for n, at in enumerate(range(0, len(packed), width)):
                    part = packed[at : at + width]
                    ids.append(doc_id)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(np.frombuffer(part, "<u4").astype("int32"))
            out = {"doc_id": pd.array(ids, dtype="Int64"), "piece": piece, "start": start, "length": length, "ids_crc32": crc}
            yield pd.DataFrame(out | ({"ids": kept} if keep_ids else {}))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return df.select(F.col(key).cast("long").alias("doc_id"), common.text_or_empty(text).alias("text")).mapInPandas(cut, schema)


def pack_documents(df: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its offset there; see ``pieces_of`` and ``pack`` for nulls and ties."""
    with common.small_batches(df.sparkSession):
        pieces = common.shared_table(pieces_of(df, capacity, tokenizer, keep_ids=keep_ids), "pieces")
    return pack(pieces, capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir))
