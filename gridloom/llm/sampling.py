"""Sampled segmentation with a SentencePiece vocabulary, and lossless decoding.

A text is segmented by forward filtering and backward sampling over its piece lattice (the sampling that subword
regularisation uses; Kudo, 2018). Forward: the weight of all ways to reach a position. Backward: from the end, draw the
piece that ends here in proportion to the weight of the ways through it. Draws are a hash of the seed, the row's key, the
word and the step, so a row's segmentation is the same in every run and on every cluster.

The vocabulary's scores are ranks of merges, not probabilities; a piece weighs 1 / (rank + OFFSET) ** SHARPNESS. Spaces
are kept as the byte 0xFF, which no UTF-8 text holds: a literal lower block mark in a text is then an unknown character
like any other, and decoding gives back every text exactly. Characters without a piece go byte by byte.

Pieces never cross from a word into the spaces before the next, so a batch's different words are filtered once each,
all together in arrays, and all their occurrences are sampled together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
SEED = 7
OFFSET, SHARPNESS = 3.0, 1.0
#: Weights are scaled by this per byte, which changes no share but keeps products of many of them near one.
_SCALE = 12.0
_BYTE_WEIGHT = 1e-4
#: Longer words are filtered one at a time, in logarithms.
LONG = 48
CHUNK_WORDS = 150_000
_SPACED = re.compile(rb"\xff*[^\xff]+|\xff+")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """A vocabulary as a byte trie in arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id = np.zeros(256, dtype=np.int32)
        strings: dict[bytes, int] = {}
        self.bytes = [b""] * n
        ranks = sorted((-model.get_score(k), k) for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
        rank_of = {k: r for r, (_, k) in enumerate(ranks)}
        for k in range(n):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes[k] = k, bytes([value])
            elif k in rank_of:
                self.bytes[k] = piece.replace("▁", "\x00").encode().replace(b"\x00", b"\xff")
                strings[self.bytes[k]] = k
        nodes: list[dict[int, int]] = [{}]
        piece_at = [-1]
        for text, k in strings.items():
            node = 0
            for b in text:
                if b not in nodes[node]:
                    nodes[node][b] = len(nodes)
                    nodes.append({})
                    piece_at.append(-1)
                node = nodes[node][b]
            piece_at[node] = k
        inner = [k for k, c in enumerate(nodes) if c]
        order = inner + [k for k, c in enumerate(nodes) if not c]  # nodes with children first: only those need a row
        place = np.empty(len(nodes), dtype=np.int32)
        place[order] = np.arange(len(nodes))
        self.next = np.full((len(inner), 256), -1, dtype=np.int32)
        for k in inner:
            self.next[place[k], list(nodes[k])] = place[list(nodes[k].values())]
        self.piece = np.array(piece_at, dtype=np.int32)[order]
        length = np.array([len(x) for x in self.bytes])
        rank = np.array([rank_of.get(k, 0) for k in range(n)])
        self.weight = _SCALE**length / (rank + OFFSET) ** SHARPNESS
        self.weight[self.byte_id] = _BYTE_WEIGHT * _SCALE
        self.single = {x for x in strings if len(x.decode("utf-8", "ignore")) == 1 or x == b"\xff"}
        self.lengths = length
        self._joined = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._starts = np.cumsum(length) - length

    # filtering -------------------------------------------------------------------------------------------------------

    def _steps(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """The lattices of short words: for each, in one flat line of positions, (first, last) position, and all edges
        as (end position, start position, piece, share of the weight at its end)."""
        lengths = np.array([len(w) for w in words])
        first = np.cumsum(lengths + 1) - lengths - 1
        flat = np.zeros(int((lengths + 1).sum()) + 32, dtype=np.uint8)
        inside = np.ones(len(flat), dtype=bool)
        inside[first + lengths] = False
        inside[len(flat) - 32 :] = False
        flat[inside] = np.frombuffer(b"".join(words), np.uint8)
        ways = np.zeros(len(flat))
        ways[first] = 1.0
        known = self._known(flat, inside)
        ends, starts, pieces, weights = [], [], [], []
        live = np.arange(len(words))
        for p in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > p]
            at = first[live] + p
            at = at[ways[at] > 0]
            plain = at[~known[at]]
            if len(plain):
                ids = self.byte_id[flat[plain]]
                self._push(plain, plain + 1, ids, ways, ends, starts, pieces, weights)
            node, here, depth = np.zeros(len(at), dtype=np.int32), at, 0
            while len(here):
                where = here + depth
                ok = inside[where] & (node < len(self.next))
                here, node, where = here[ok], node[ok], where[ok]
                node = self.next[node, flat[where]]
                ok = node >= 0
                here, node = here[ok], node[ok]
                depth += 1
                ids = self.piece[node]
                hit = ids >= 0
                if hit.any():
                    self._push(here[hit], here[hit] + depth, ids[hit], ways, ends, starts, pieces, weights)
        parts = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, starts, pieces, weights)]
        return first, first + lengths, ways, *parts

    def _push(self, start, end, ids, ways, ends, starts, pieces, weights) -> None:
        gain = ways[start] * self.weight[ids]
        ways[end] += gain  # one start for each word: no end occurs twice
        ends.append(end)
        starts.append(start)
        pieces.append(ids)
        weights.append(gain)

    def _known(self, flat: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Where a character starts that has a piece of its own. Other bytes go by the byte pieces."""
        known = np.zeros(len(flat), dtype=bool)
        node, at = np.zeros(len(flat) - 8, dtype=np.int32), np.arange(len(flat) - 8)
        start = inside[: len(at)] & ((flat[: len(at)] < 0x80) | (flat[: len(at)] >= 0xC0))
        wide = np.where(flat < 0x80, 1, np.where(flat == 0xFF, 1, np.where(flat >= 0xF0, 4, np.where(flat >= 0xE0, 3, 2))))
        at, node = at[start], node[start]
        for depth in range(4):
            ok = (node < len(self.next)) & inside[at + depth]
            at, node = at[ok], node[ok]
            node = self.next[node, flat[at + depth]]
            ok = node >= 0
            at, node = at[ok], node[ok]
            done = (wide[at] == depth + 1) & (self.piece[node] >= 0)
            known[at[done]] = True
        return known

    def _long(self, word: bytes, draws) -> list[int]:
        """One word of any length, in logarithms: its sampled pieces."""
        n = len(word)
        flat = np.concatenate([np.frombuffer(word, np.uint8), np.zeros(32, np.uint8)])
        inside = np.zeros(len(flat), dtype=bool)
        inside[:n] = True
        known = self._known(flat, inside)
        ways = np.full(n + 1, -np.inf)
        ways[0] = 0.0
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        logs = np.log(self.weight)
        for p in range(n):
            if ways[p] == -np.inf:
                continue
            found = [] if known[p] else [(p + 1, int(self.byte_id[word[p]]))]
            node, q = 0, p
            while q < n and node < len(self.next) and (node := int(self.next[node, word[q]])) >= 0:
                q += 1
                if (k := int(self.piece[node])) >= 0:
                    found.append((q, k))
            for q, k in found:
                gain = float(ways[p] + logs[k])
                into[q].append((p, k, gain))
                ways[q] = np.logaddexp(ways[q], gain)
        out, q = [], n
        while q:
            u, total = draws(len(out)), 0.0
            for p, k, gain in into[q]:
                total += float(np.exp(gain - ways[q]))
                if u < total:
                    break
            out.append(k)
            q = p
        return out[::-1]

    # sampling --------------------------------------------------------------------------------------------------------

    @staticmethod
    def words(text: str) -> list[bytes]:
        raw = text.encode("utf-8", "replace")
        if b"  " in raw or b"\x00" in raw or raw[:1] == b" " or raw[-1:] == b" ":
            return _SPACED.findall(b"\xff" + raw.replace(b" ", b"\xff")) if raw else []
        return (b"\xff" + raw.replace(b" ", b"\x00\xff")).split(b"\x00") if raw else []

    def sample(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
        """Sampled ids of each text."""
        out: list[np.ndarray] = []
        chunk: list[list[bytes]] = []
        first = size = 0
        for k, text in enumerate(texts):
            chunk.append(self.words(text))
            size += len(chunk[-1])
            if size >= CHUNK_WORDS or k + 1 == len(texts):
                out += self._sample(chunk, keys[first : k + 1], seed)
                chunk, first, size = [], k + 1, 0
        return out

    def _sample(self, lists: list[list[bytes]], keys: np.ndarray, seed: int) -> list[np.ndarray]:
        counts = np.array([len(x) for x in lists])
        total = int(counts.sum())
        if not total:
            return [np.zeros(0, np.int32) for _ in lists]
        code = dict.fromkeys(chain.from_iterable(lists))
        code = dict(zip(code, range(len(code))))
        words = list(code)
        which = np.fromiter(map(code.__getitem__, chain.from_iterable(lists)), np.int64, total)
        long = np.array([len(w) > LONG for w in words])
        short = [w if not far else b"" for w, far in zip(words, long)]
        first, last, ways, ends, starts, pieces, weights = self._steps(short)
        order = np.argsort(ends, kind="stable")
        ends, starts, pieces = ends[order], starts[order], pieces[order]
        share = weights[order] / ways[ends]
        running = np.cumsum(share)
        begins = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])) if len(ends) else np.zeros(0, np.int64)
        group = np.zeros(len(ways), dtype=np.int64)
        group[ends[begins]] = begins
        base = np.where(begins > 0, running[begins - 1], 0.0) if len(begins) else np.zeros(0)
        before = np.zeros(len(ways))
        before[ends[begins]] = base
        size_of = np.zeros(len(ways), dtype=np.int64)
        size_of[ends[begins]] = np.diff(np.concatenate([begins, [len(ends)]]))
        # the word's place in its text, its text's key and the seed make the draw
        place = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        with np.errstate(over="ignore"):
            own = _mix(keys.astype(np.int64).view(np.uint64) ^ _mix(np.full(len(keys), seed, np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
            root = _mix(np.repeat(own, counts) + _mix(place.astype(np.uint64) + np.uint64(1)))
        draw = lambda at, step: (_mix(root[at] + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        n_of = np.zeros(total, dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(~long[which])
        at, stop = last[which[live]], first[which[live]]
        step = 0
        with np.errstate(over="ignore"):
            while len(live):
                more = at > stop
                live, at, stop = live[more], at[more], stop[more]
                if not len(live):
                    break
                begin, options = group[at], size_of[at]
                pick = begin + np.zeros(len(at), np.int64)
                several = np.flatnonzero(options > 1)
                if len(several):
                    s = several
                    aim = before[at[s]] + draw(live[s], step) * (running[begin[s] + options[s] - 1] - before[at[s]])
                    pick[s] = np.minimum(np.maximum(np.searchsorted(running, aim, side="right"), begin[s]), begin[s] + options[s] - 1)
                found.append((live, pieces[pick]))
                n_of[live] += 1
                at = starts[pick]
                step += 1
            far: dict[int, list[int]] = {}
            for w in np.flatnonzero(long[which]):
                far[int(w)] = self._long(words[which[w]], lambda k, w=w: float(draw(np.array([w]), k)[0]))
                n_of[w] = len(far[int(w)])
        offset = np.cumsum(n_of) - n_of
        ids = np.empty(int(n_of.sum()), dtype=np.int32)
        for step, (occurrence, piece) in enumerate(found):
            ids[offset[occurrence] + n_of[occurrence] - 1 - step] = piece
        for w, piece in far.items():
            ids[offset[w] : offset[w] + len(piece)] = piece
        cuts = np.cumsum(np.add.reduceat(np.concatenate([n_of, [0]]), np.minimum(np.cumsum(counts) - counts, total)) * (counts > 0))
        return np.split(ids, cuts[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes: pieces joined, marks back to spaces, the first mark off."""
        if not len(ids):
            return b""
        length = self.lengths[ids]
        total = int(length.sum())
        at = np.arange(total) - np.repeat(np.cumsum(length) - length, length) + np.repeat(self._starts[ids], length)
        return self._joined[at].tobytes()[1:].replace(b"\xff", b" ")


_loaded: dict[str, Pieces] = {}


def pieces(name: str = MODEL) -> Pieces:
    if name not in _loaded:
        import public_tokenizers

        _loaded[name] = Pieces(name if "/" in name else public_tokenizers.path(name))
    return _loaded[name]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, seed: int = SEED, digest_only: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids_crc32, text_crc32 (of the decoded text) and ids, unless
    ``digest_only``.

    Null and empty texts have no pieces. Rows that share key and text get the same ids; a null key draws as key 0. Only
    key and text are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = pieces(model)
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.iloc[start : start + 500]
                ids = vocabulary.sample(part["text"].tolist(), part["doc_id"].fillna(0).to_numpy("int64"), seed)
                out = {"doc_id": part["doc_id"].astype("Int64").to_numpy(), "n_pieces": [len(x) for x in ids]}
                out["ids_crc32"] = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                out["text_crc32"] = [zlib.crc32(vocabulary.decode(x)) for x in ids]
                yield pd.DataFrame(out | ({} if digest_only else {"ids": list(ids)})).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long" + ("" if digest_only else ", ids array<int>")
    return df.select(F.col(key).cast("long").alias("doc_id"), common.text_or_empty(text).alias("text")).mapInPandas(run, schema)


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``df`` with a column ``text`` decoded from its ids (null: null)."""

    @F.pandas_udf("string")
    def back(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else pieces(model).decode(np.asarray(x, dtype=np.int64)).decode("utf-8", "replace"))

    return df.withColumn("text", back(ids))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.documents(spark, sf_dir), digest_only=True)
