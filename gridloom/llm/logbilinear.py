"""Scoring by a log-bilinear neural language model, trained with noise-contrastive estimation (Mnih and Teh, 2012).

Words are lower-cased runs without ASCII white space; a text ends in one end mark. The most frequent words are symbols of
their own; every other word belongs to the class of its last two letters, and is drawn from it by its count in the corpus.
The model predicts the next symbol from the two before it: the vectors of both, each times its position's matrix, are added
up and multiplied with every symbol's output vector. Since that sum comes apart by position, the normaliser of every pair
of symbols is one matrix product of two tables (``Tables``), and a token's log-probability is exact and normalised.

Spark counts all words of the texts that teach. The model takes a warm start from a bounded sample and then passes over
every text that teaches: tasks train copies, and the copies are averaged by Spark, weighted by their tokens. Counts of the
``KNOWN_WORDS`` most frequent words are known to all tasks; those of rarer words meet them by a join on the word's hash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import chain, count

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Symbols: the end mark, frequent words, classes of word endings, one class for all other words.
SYMBOL_WORDS, SYMBOL_ENDINGS = 700, 322
END = 0
DIMS = 32
#: Noise symbols of a minibatch, tokens in it, and the step size of Adagrad.
NOISE = 64
BATCH = 4_096
STEP = 0.06
#: The warm start: documents in its sample, and minibatches drawn from it.
WARM_DOCUMENTS, WARM_BATCHES = 300, 250
SEED = 12
#: Words whose counts every task knows, besides those that are symbols (8 bytes of hash, 8 of count, 2 of symbol each).
KNOWN_WORDS = 1_000_000
#: Different words that a task counts before it hands them on, and bytes of text that it works on together.
HELD_WORDS = 1_000_000
CHUNK_BYTES = 4_000_000
FOLDS, HELD_OUT = 5, 1
#: Pieces in which a task sends its copy of the model.
SLICES = 16


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def ending_of(word: bytes) -> int:
    """The last two characters as one number."""
    last = word.decode("utf-8", "replace")[-2:]
    return ord(last[0]) << 21 | ord(last[1]) if len(last) == 2 else ord(last) if last else 0


def held_out(key: Column) -> Column:
    """The documents that do not teach; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


# counts ----------------------------------------------------------------------------------------------------------------


def count_words(texts: DataFrame) -> DataFrame:
    """(hash, ending, n) of every word of ``text``, and of the end mark, the empty word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def hand_on() -> Iterator[pd.DataFrame]:
            words = list(held)
            n = np.fromiter(held.values(), dtype=np.int64, count=len(words))
            held.clear()
            for k in range(0, len(words), 100_000):
                part = words[k : k + 100_000]
                hashes = np.fromiter(map(hash_of, part), dtype=np.uint64, count=len(part))
                yield pd.DataFrame({"hash": hashes.view(np.int64), "ending": np.fromiter(map(ending_of, part), dtype=np.int64, count=len(part)), "n": n[k : k + 100_000]})

        for batch in batches:
            held[b""] += len(batch)
            for text in batch["text"]:
                held.update(words_of(text))
                if len(held) > HELD_WORDS:
                    yield from hand_on()
        yield from hand_on()

    return texts.mapInPandas(run, "hash long, ending long, n long").groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What tasks know of the counted words. ``symbols`` gives each known word's symbol, ``endings`` that of each ending;
    ``weight`` is the mass of a class, all other symbols have 0; ``counts`` holds the tokens of each symbol."""

    tokens: int
    kinds: int
    least: int
    hashes: np.ndarray
    n: np.ndarray
    symbols: np.ndarray
    endings: dict[int, int]
    weight: np.ndarray
    counts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.weight)

    @property
    def other(self) -> int:
        return self.size - 1

    @property
    def smoothed(self) -> float:
        return self.tokens + 0.5 * (self.kinds + 1)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, count (-1 if not known) and symbol of each word."""
        hashes = np.fromiter(map(hash_of, words), dtype=np.uint64, count=len(words))
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(words), dtype=bool)
        n, symbol = np.full(len(words), -1, dtype=np.int64), np.full(len(words), self.other, dtype=np.int64)
        n[known], symbol[known] = self.n[at[known]], self.symbols[at[known]]
        for k in np.flatnonzero(~known):
            symbol[k] = self.endings.get(ending_of(words[k]), self.other)
        return hashes, n, symbol


def vocabulary(words: DataFrame, known_words: int = KNOWN_WORDS) -> Vocabulary:
    """Chosen from all counts; ``words`` is a written table. Bounded rows reach the driver."""
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    end = hash_of(b"") - (1 << 64 if hash_of(b"") >> 63 else 0)
    own = words.where(F.col("hash") != end)
    first = own.orderBy(F.col("n").desc(), "hash").limit(SYMBOL_WORDS).collect()
    named = F.col("hash").isin([r.hash for r in first]) if first else F.lit(False)
    rest = own.where(~named)
    by_ending = rest.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    endings = by_ending.orderBy(F.col("n").desc(), "ending").limit(SYMBOL_ENDINGS).collect()
    whole = rest.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    # the least count of which at most ``known_words`` words have more: found in the counts of counts
    often = own.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count(F.lit(1)).alias("kinds")).orderBy(F.col("n").desc())
    least, held = 1 << 62, 0
    for r in often.toLocalIterator():  # at most 2**20 rows
        held += r.kinds
        if held > known_words:
            break
        least = r.n
    known = own.where((F.col("n") >= least) | named).select("hash", "ending", "n").toArrow()
    hashes, ending, n = (known[c].to_numpy() for c in ("hash", "ending", "n"))
    order = np.argsort(hashes.view(np.uint64))
    hashes, ending, n = hashes[order], ending[order], n[order]
    size = 2 + len(first) + len(endings)
    ending_symbol = {r.ending: 1 + len(first) + k for k, r in enumerate(endings)}
    symbols = _replaced(ending, ending_symbol, np.full(len(hashes), size - 1, dtype=np.uint16))
    symbols = _replaced(hashes, {r.hash: 1 + k for k, r in enumerate(first)}, symbols)
    weight, counts = np.zeros(size), np.zeros(size, dtype=np.int64)
    for r in endings:
        counts[ending_symbol[r.ending]], weight[ending_symbol[r.ending]] = r.n, r.n + 0.5 * (r.kinds + 1)
    counts[-1] = (whole.n or 0) - sum(r.n for r in endings)
    weight[-1] = counts[-1] + 0.5 * (whole.kinds - sum(r.kinds for r in endings) + 1)
    counts[1 : 1 + len(first)] = [r.n for r in first]
    counts[END] = (total.n or 0) - counts.sum()
    return Vocabulary(total.n or 0, total.kinds, least, hashes.view(np.uint64), n, symbols, ending_symbol, weight, counts)


def _replaced(keys: np.ndarray, by: dict[int, int], otherwise: np.ndarray) -> np.ndarray:
    """The value of each key; where ``by`` has none, that of ``otherwise``."""
    if not by or not len(keys):
        return otherwise
    known = np.array(sorted(by), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, np.array([by[k] for k in known.tolist()], dtype=np.uint16)[at], otherwise)


# the model -------------------------------------------------------------------------------------------------------------


@dataclass
class Weights:
    """Vectors of symbols as context (the last row: before a text begins) and as output, biases, and a matrix for each place."""

    context: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @staticmethod
    def new(counts: np.ndarray) -> Weights:
        rng = np.random.default_rng([SEED, 1])
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        size = len(counts)
        return Weights(small(size + 1, DIMS), small(size, DIMS), np.log(noise_of(counts)).astype(np.float32), *(np.eye(DIMS, dtype=np.float32) * s for s in (1.0, 0.5)))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def like(self, flat: np.ndarray) -> Weights:
        made, at = [], 0
        for f in fields(self):
            old = getattr(self, f.name)
            made.append(flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return Weights(*made)


def noise_of(counts: np.ndarray) -> np.ndarray:
    return (counts + 0.5) / (counts + 0.5).sum()


def _add_rows(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows of each index."""
    width = rows.shape[1]
    return np.bincount((at[:, None] * width + np.arange(width)).ravel(), rows.ravel(), size * width).reshape(size, width).astype(np.float32)


class Trainer:
    """Noise-contrastive estimation in minibatches: all tokens of one share their noise symbols."""

    def __init__(self, weights: Weights, counts: np.ndarray, seed: int):
        self.w = weights.like(weights.flat())
        noise = noise_of(counts)
        self._log_noise, self._cumulated = np.log(NOISE * noise).astype(np.float32), np.cumsum(noise)
        self._rng = np.random.default_rng([SEED, seed])
        self._squares = {f.name: np.full(getattr(weights, f.name).shape, 1e-6, dtype=np.float32) for f in fields(weights)}

    def step(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> float:
        """One minibatch; returns the objective per token."""
        w, n = self.w, len(word)
        noise = np.minimum(np.searchsorted(self._cumulated, self._rng.random(NOISE)), len(self._cumulated) - 1)
        r_far, r_near = w.context[far], w.context[near]
        predicted = r_far @ w.far + r_near @ w.near
        out, out_noise = w.output[word], w.output[noise]
        own = np.einsum("ij,ij->i", predicted, out) + w.bias[word] - self._log_noise[word]
        others = predicted @ out_noise.T + (w.bias[noise] - self._log_noise[noise])
        own, others = np.clip(own, -30, 30), np.clip(others, -30, 30)
        up, down = 1 / (1 + np.exp(own)), -1 / (1 + np.exp(-others))
        back = up[:, None] * out + down @ out_noise
        at = np.concatenate([word, noise])
        self._move("output", _add_rows(at, np.concatenate([up[:, None] * predicted, down.T @ predicted]), len(w.output)) / n)
        self._move("bias", (np.bincount(at, np.concatenate([up, down.sum(axis=0)]), len(w.bias)) / n).astype(np.float32))
        context = _add_rows(np.concatenate([far, near]), np.concatenate([back @ w.far.T, back @ w.near.T]), len(w.context)) / n
        self._move("far", r_far.T @ back / n)
        self._move("near", r_near.T @ back / n)
        self._move("context", context)
        return float(-np.log1p(np.exp(-own)).mean() - np.log1p(np.exp(others)).sum(axis=1).mean())

    def _move(self, name: str, up: np.ndarray) -> None:
        squares = self._squares[name]
        squares += up * up
        getattr(self.w, name)[...] += STEP * up / np.sqrt(squares)


def places(symbols: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens of some texts: the symbol two before, the one before, and the token's own."""
    word = np.concatenate(symbols).astype(np.int64)
    first = np.cumsum([0, *map(len, symbols[:-1])])
    near = np.concatenate([[begin], word[:-1]])
    near[first] = begin
    far = np.concatenate([[begin], near[:-1]])
    far[first] = begin
    return far, near, word


def _symbols(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column]


def warm_start(encoded: DataFrame, counts: np.ndarray) -> Weights:
    """Trained on minibatches drawn from the ``WARM_DOCUMENTS`` teaching texts with the smallest hashes."""
    weights = Weights.new(counts)
    sample = encoded.where("not held_out").orderBy(F.xxhash64("row"), "row").limit(WARM_DOCUMENTS).select("symbols").toPandas()
    if not len(sample):
        return weights
    far, near, word = places(_symbols(sample["symbols"]), len(counts))
    trainer, rng = Trainer(weights, counts, 0), np.random.default_rng([SEED, 2])
    for _ in range(WARM_BATCHES):
        at = rng.integers(0, len(word), BATCH)
        trainer.step(far[at], near[at], word[at])
    return trainer.w


def train(encoded: DataFrame, counts: np.ndarray) -> Weights:
    """One pass over every text that teaches, from the warm start; the tasks' copies are averaged."""
    start = warm_start(encoded, counts)
    spark, begin = encoded.sparkSession, len(counts)
    shared = spark.sparkContext.broadcast((start, counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, seen = shared.value
        part = TaskContext.get().partitionId()
        trainer, rng, tokens = Trainer(weights, seen, part + 1), np.random.default_rng([SEED, 3, part]), 0
        waiting: list[np.ndarray] = []
        size = 0

        def learn() -> None:
            far, near, word = places(waiting, begin)
            order = rng.permutation(len(word))
            for at in np.array_split(order, max(1, round(len(order) / BATCH))):
                trainer.step(far[at], near[at], word[at])

        for batch in batches:
            for symbols in _symbols(batch["symbols"]):
                waiting.append(symbols)
                size += len(symbols)
                if size >= 32 * BATCH:
                    learn()
                    tokens, size = tokens + size, 0
                    waiting.clear()
        if waiting:
            learn()
            tokens += size
        if tokens:
            flat = np.array_split(trainer.w.flat().astype(np.float64) * tokens, SLICES)
            yield pd.DataFrame({"slice": np.arange(SLICES), "tokens": tokens, "w": [x.tobytes() for x in flat]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for k, tokens, w in zip(batch["slice"], batch["tokens"], batch["w"]):
                old = held.setdefault(k, [0, 0.0])
                held[k] = [old[0] + tokens, old[1] + np.frombuffer(w)]
        for k, (tokens, w) in held.items():
            yield pd.DataFrame({"slice": [k], "tokens": [tokens], "w": [w.tobytes()]})

    schema = "slice int, tokens long, w binary"
    copies = encoded.where("not held_out").select("symbols").mapInPandas(run, schema)
    some = copies.withColumn("to", F.spark_partition_id() % 32).repartition(common.tasks(encoded), "slice", "to").select("slice", "tokens", "w").mapInPandas(add, schema)
    rows = sorted(some.repartition(SLICES, "slice").mapInPandas(add, schema).collect(), key=lambda r: r.slice)
    shared.destroy()
    return start.like(np.concatenate([np.frombuffer(r.w) / r.tokens for r in rows])) if rows else start


class Tables:
    """What scoring looks up. A token's score is near[before, word] + far[two before, word] (with the bias), minus the
    normaliser of both symbols before it; the normalisers of all pairs are one product of two matrices."""

    def __init__(self, weights: Weights):
        out = weights.output.astype(np.float64).T
        near, far = (weights.context @ weights.near) @ out + weights.bias, (weights.context @ weights.far) @ out
        top_near, top_far = near.max(axis=1, keepdims=True), far.max(axis=1, keepdims=True)
        total = np.exp(far - top_far) @ np.exp(near - top_near).T
        self.normaliser = np.log(total) + top_far + top_near.T
        self.near, self.far = near, far

    def log(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token."""
        return self.near[near, word] + self.far[far, word] - self.normaliser[far, near]


# scoring ---------------------------------------------------------------------------------------------------------------


def encode(rows: DataFrame, vocabulary) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, symbols, rare (hashes of words that tasks do not know), and sums over the
    text: base (of known tokens) and inside (of a word's share of its class, without the counts of rare words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v: Vocabulary = common.held(("vocabulary", id(vocabulary)), lambda: vocabulary.value)
        log_weight = np.log10(np.where(v.weight > 0, v.weight, 1))
        for batch in batches:
            texts = [t.encode("utf-8", "replace") for t in batch["text"]]
            ends = np.cumsum([len(t) for t in texts]) // CHUNK_BYTES
            for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                yield _encoded(batch.iloc[at], [texts[k].lower().split() for k in at], v, log_weight)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, symbols binary, rare array<long>"
    return rows.mapInPandas(run, schema)


def _encoded(batch: pd.DataFrame, words: list[list[bytes]], v: Vocabulary, log_weight: np.ndarray) -> pd.DataFrame:
    sizes = np.array([len(x) for x in words], dtype=np.int64)
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
    hashes, n, symbol = v.look_up(list(numbers))
    known = n >= 0
    log_n = np.log10(np.where(known, n, 0.5) + 0.5)  # 0 where the count is not known
    share = np.where(v.weight[symbol] > 0, log_n - log_weight[symbol], 0.0)
    text_of = np.repeat(np.arange(len(words)), sizes)
    add = lambda x: np.bincount(text_of, x[ids], len(words))
    stops = np.cumsum(sizes)
    token_symbols = np.insert(symbol[ids], stops, END).astype("<u2")
    rare = ~known[ids]
    split = lambda x, at: np.split(x, at[:-1])
    return pd.DataFrame({
        "row": batch["row"].to_numpy(), "doc_id": batch["doc_id"].astype("Int64").array, "held_out": batch["held_out"].to_numpy(), "n_tokens": sizes + 1,
        "n_known": add(known.astype(float)).astype(np.int64) + int(v.counts[END] > 0), "base": add(log_n) + np.log10(v.counts[END] + 0.5), "inside": add(share),
        "symbols": [x.tobytes() for x in split(token_symbols, stops + np.arange(1, len(words) + 1))],
        "rare": split(hashes[ids[rare]].view(np.int64), np.cumsum(np.bincount(text_of[rare], minlength=len(words)))),
    })


def score(df: DataFrame, key: str = "doc_id", text: str = "text", known_words: int = KNOWN_WORDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty and still has its end mark. A null key is neither held out nor merged with others; repeated rows
    are scored, and teach, each. Where no text teaches, every count is 0 and the model is the untrained one. Only key and
    text are read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("doc_id"), common.text_or_empty(text).alias("text"), held_out(F.col(key)).alias("held_out"))
    words = common.shared_table(count_words(rows.where("not held_out").select("text")), "words")
    v = vocabulary(words, known_words)
    shared = spark.sparkContext.broadcast(v)
    encoded = common.shared_table(encode(rows.withColumn("row", F.monotonically_increasing_id()), shared), "encoded")
    tables = spark.sparkContext.broadcast(Tables(train(encoded, v.counts)))
    begin = v.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros(len(batch))
            symbols = _symbols(batch["symbols"])
            ends = np.cumsum([len(x) for x in symbols]) // CHUNK_BYTES
            for at in np.split(np.arange(len(symbols)), np.flatnonzero(np.diff(ends)) + 1) if len(symbols) else []:
                part = [symbols[k] for k in at]
                out[at] = np.bincount(np.repeat(np.arange(len(part)), [len(x) for x in part]), tables.value.log(*places(part, begin)), len(part))
            yield batch.drop(columns="symbols").assign(doc_id=batch["doc_id"].astype("Int64"), model=out / np.log(10))

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, model double"
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "symbols").mapInPandas(run, schema)
    rare = encoded.select("row", F.explode("rare").alias("hash")).join(words.where(F.col("n") < v.least).select("hash", "n"), "hash", "left")
    n = F.coalesce("n", F.lit(0))
    sums = rare.groupBy("row").agg(F.sum(F.log10(n + 0.5)).alias("rare"), F.count_if(n > 0).alias("rare_known"))
    joined = scored.join(sums, "row", "left").withColumns({"rare": F.coalesce("rare", F.lit(0.0)), "rare_known": F.coalesce("rare_known", F.lit(0))})
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare") - F.col("n_tokens") * float(np.log10(v.smoothed))).alias("base_score"), (F.col("model") + F.col("inside") + F.col("rare")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir))
