"""Quality rules: word and line counts, and a perplexity band for each language.

The model is a modified Kneser-Ney model (Chen and Goodman, 1999) of n-grams of characters, order 5: every character
counts as it is, with its case and its marks; a run of white space is one space. Spark counts the n-grams over all
documents that pass the base rule and hold few marks, so that junk does not teach the model what is usual, and estimates
all orders by grouping and joining the n-gram tables. The log-probability of every n-gram that any document holds ends in
sorted hash arrays, dealt to ranges of the hash in the shared folder; tasks open the ranges that they need.

A document's perplexity is per character. A language's band spans the middle half of the log-perplexities of its
documents that pass the base rule, widened on either side by ``WIDTH`` times that half's range; documents outside are
rejected.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 5
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Texts with more marks than this share of their characters are not counted for the model; they are judged by it.
COUNTED_MARKS_PERCENT = 2
#: How far the band reaches beyond the quartiles, in interquartile ranges; the README has the reject rates.
WIDTH = 6.0
#: Characters that are worked on together, and different n-grams that a task holds before it hands them on.
CHUNK_CHARS = 300_000
HELD_GRAMS = 600_000
#: n-grams in one sorted hash array, and in all arrays that a process keeps open.
SHARD_ROWS = 1_000_000
OPEN_ROWS = 8_000_000
_CACHE = 1 << 19
_MARKS = re.compile(r"[#*$%&|<>]")
#: Stands before a text; no text holds these two code points once ``codes_of`` is done.
_BEGIN, _NULL = 0x10FFFF, 0xFFFF
_WHITE = np.zeros(0x110000, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = True
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 marks of its beginning, and how many characters each text has."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    white = _WHITE[raw]
    again = np.zeros(len(raw), dtype=bool)
    again[1:] = white[1:] & white[:-1] & (text_of[1:] == text_of[:-1])
    code = np.where(white, np.uint32(32), raw)
    code = np.where((code == 0) | (code == _BEGIN), np.uint32(_NULL), code)[~again]
    counts = np.bincount(text_of[~again], minlength=len(texts))
    out = np.full(len(code) + (ORDER - 1) * len(texts), _BEGIN, dtype=np.uint32)
    place = np.arange(len(code)) + np.repeat((ORDER - 1) * np.arange(1, len(texts) + 1), counts)
    out[place] = code
    return out, counts


def grams(texts: list[str], salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each character, characters of each text, where each n-gram begins in the codes, and
    the codes; ``salt`` is the language's."""
    codes, counts = codes_of(texts)
    if not len(codes):
        return np.zeros(0, np.uint64), counts, np.zeros(0, np.int64), codes
    with np.errstate(over="ignore"):
        h = np.full(len(codes) - ORDER + 1, salt, dtype=np.uint64)
        for k in range(ORDER):
            h = (h + codes[k : len(codes) - ORDER + 1 + k]) * _TIMES
            h ^= h >> np.uint64(29)
    at = np.arange(int(counts.sum())) + np.repeat((ORDER - 1) * np.arange(len(texts)), counts)  # where the n-gram begins
    return _mixed(h[at]), counts, at, codes


def salt_of(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang)


def _chunks(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_CHARS:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


class _Counts:
    """Different n-grams of one language in one task: hash, codes, and how often texts that teach hold them."""

    def __init__(self):
        self._parts: list[tuple] = []
        self.size = 0

    def add(self, texts: list[str], salt: int, weight: int) -> None:
        for part in _chunks(texts):
            h, _, at, codes = grams(texts[part], salt)
            keys, first, n = np.unique(h, return_index=True, return_counts=True)
            begin = at[first]
            self._parts.append((keys, codes[begin[:, None] + np.arange(ORDER)], n * weight))
            self.size += len(keys)
            if len(self._parts) >= 12:
                self._parts = [self._merged()]
                self.size = len(self._parts[0][0])

    def _merged(self) -> tuple:
        keys, first, at = np.unique(np.concatenate([p[0] for p in self._parts]), return_index=True, return_inverse=True)
        n = np.bincount(at, np.concatenate([p[2] for p in self._parts]), len(keys)).astype(np.int64)
        return keys, np.concatenate([p[1] for p in self._parts])[first], n

    def rows(self, lang: str) -> Iterator[pd.DataFrame]:
        if not self._parts:
            return
        keys, codes, n = self._merged()
        for k in range(0, len(keys), 50_000):
            part = slice(k, k + 50_000)
            text = np.ascontiguousarray(codes[part].astype("<u4")).view(f"<U{ORDER}").ravel()
            yield pd.DataFrame({"lang": lang, "gram": text.astype(object), "h": keys[part].view(np.int64), "n": n[part]})


def count_ngrams(df: DataFrame) -> DataFrame:
    """(lang, gram, h, n) for every n-gram of every text; n counts the texts that the model learns from. Each task adds
    up its own n-grams before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.make_room()
        held: dict[str, _Counts] = {}
        for batch in batches:
            for lang, group in batch.groupby("lang", sort=False):
                teach = [_teaches(t) for t in group["text"]]
                counts = held.setdefault(lang, _Counts())
                counts.add([t for t, x in zip(group["text"], teach) if x], salt_of(lang), 1)
                counts.add([t for t, x in zip(group["text"], teach) if not x], salt_of(lang), 0)
            if sum(c.size for c in held.values()) > HELD_GRAMS:
                for lang, counts in held.items():
                    yield from counts.rows(lang)
                held = {}
        for lang, counts in held.items():
            yield from counts.rows(lang)

    return df.mapInPandas(run, "lang string, gram string, h long, n long").groupBy("lang", "gram").agg(F.min("h").alias("h"), F.sum("n").alias("n"))


def estimate(counted: DataFrame) -> DataFrame:
    """(h, logp): natural log-probability of the last character of each n-gram of ``counted``, a written table.

    Lower orders count distinct left neighbours, or occurrences where the n-gram begins a document. A discount that the
    counts of counts leave undefined falls back to half its count. The lowest order shares its rest evenly among all
    characters of the language and one more, so n-grams that no taught text holds have a probability as well. A language
    without a taught text has no rows.
    """
    begin = chr(_BEGIN)
    levels = {ORDER: counted.select("lang", "gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        low = F.substring("gram", 2, k)
        seen, times = F.sum((F.col("n") > 0).cast("long")), F.sum("n")
        made = levels[k + 1].groupBy("lang", low.alias("g")).agg(seen.alias("seen"), times.alias("times"))
        levels[k] = common.shared_table(made.select("lang", F.col("g").alias("gram"), F.when(F.col("g").startswith(begin), F.col("times")).otherwise(F.col("seen")).alias("n")), f"grams{k}")
    lower = None
    for k in range(1, ORDER + 1):
        t = levels[k].groupBy("lang").agg(*[F.count_if(F.col("n") == x).cast("double").alias(f"t{x}") for x in (1, 2, 3, 4)], F.count(F.lit(1)).alias("kinds"))
        y = F.when(F.col("t1") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(F.lit(0.0))
        d = [F.when((F.col(f"t{x}") > 0) & (F.col(f"t{x + 1}") > 0), x - (x + 1) * y * F.col(f"t{x + 1}") / F.col(f"t{x}")).otherwise(F.lit(x / 2)) for x in (1, 2, 3)]
        t = t.select("lang", "kinds", *[F.when((v > 0) & (v < x), v).otherwise(F.lit(x / 2)).alias(f"d{x}") for x, v in zip((1, 2, 3), d)])
        cut = F.when(F.col("n") >= 3, F.col("d3")).when(F.col("n") == 2, F.col("d2")).when(F.col("n") == 1, F.col("d1")).otherwise(F.lit(0.0))
        t = common.shared_table(t, "discounts")
        own = levels[k].join(common.bounded(t), "lang").select("lang", "gram", "n", "kinds", cut.alias("cut"), F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("rest"))
        contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("mass"))
        joined = own.join(contexts, ["lang", "context"])
        if lower is None:
            joined = joined.where("total > 0").withColumn("low", 1 / (F.col("kinds") + 1))
        else:
            joined = joined.join(lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("low")), ["lang", "rest"])
        p = F.when(F.col("total") > 0, (F.col("n") - F.col("cut") + F.col("mass") * F.col("low")) / F.col("total")).otherwise(F.col("low"))
        lower = joined.select("lang", "gram", p.alias("p"))
        if k == 3:
            lower = common.shared_table(lower, "lower")  # the plan so far ends here
    return counted.select("lang", "gram", "h").join(lower, ["lang", "gram"]).select("h", F.log("p").alias("logp"))


def hash_arrays(logs: DataFrame, rows: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The model as sorted hash arrays: low and high hash, hashes and values as binary, one row for each range."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [b for b in batches if len(b)]
        if whole:
            t = pd.concat(whole)
            h = t["h"].to_numpy("<i8")
            yield pd.DataFrame({"low": [h[0]], "high": [h[-1]], "hashes": [h.tobytes()], "values": [t["logp"].to_numpy("<f4").tobytes()]})

    dealt = logs.repartitionByRange(rows // shard_rows + 1, "h").sortWithinPartitions("h")
    return common.shared_table(dealt.mapInPandas(pack, "low long, high long, hashes binary, values binary"), "hash-arrays")


class Model:
    """Looks n-grams up in sorted hash arrays. ``shards``: (low, high, path of a Parquet file, row in it), ascending. A process
    keeps the recently used ones, of ``OPEN_ROWS`` n-grams together, and a direct-mapped cache of frequent n-grams."""

    def __init__(self, shards: list[tuple[int, int, str, int]]):
        self._shards = shards
        self._lows = np.array([s[0] for s in shards], dtype=np.int64)
        self._open: OrderedDict = OrderedDict()
        self._rows = 0
        self._key, self._value = np.zeros(_CACHE, dtype=np.int64), np.full(_CACHE, np.nan, dtype=np.float32)

    def _arrays(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._open:
            import pyarrow as pa
            import pyarrow.parquet as pq

            _, _, path, row = self._shards[k]
            store, inner = common.open_store(path)
            with store.open_input_file(inner) as source:
                found = pq.ParquetFile(source, memory_map=False).read(columns=["hashes", "values"], use_threads=False)
            self._open[k] = np.frombuffer(found["hashes"][row].as_py(), "<i8"), np.frombuffer(found["values"][row].as_py(), "<f4")
            self._rows += len(self._open[k][0])
            while self._rows > OPEN_ROWS and len(self._open) > 1:
                self._rows -= len(self._open.popitem(last=False)[1][0])
            del found
            pa.default_memory_pool().release_unused()
        self._open.move_to_end(k)
        return self._open[k]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Values of ascending keys, NaN where the model has none."""
        out = np.full(len(keys), np.nan, dtype=np.float32)
        if not self._shards:
            return out
        home = np.maximum(np.searchsorted(self._lows, keys, side="right") - 1, 0)
        for k in np.unique(home):
            part = slice(*np.searchsorted(home, [k, k + 1]))
            hashes, values = self._arrays(int(k))
            at = np.minimum(np.searchsorted(hashes, keys[part]), len(hashes) - 1)
            out[part] = np.where(hashes[at] == keys[part], values[at], np.float32(np.nan))
        return out

    def log(self, keys: np.ndarray) -> np.ndarray:
        """Natural log-probability for each n-gram's hash."""
        keys = keys.view(np.int64)
        slot = keys & (_CACHE - 1)
        out = self._value[slot]
        miss = np.flatnonzero((self._key[slot] != keys) | np.isnan(out))
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            found = self._find(new)
            out[miss] = found[back]
            slots = new & (_CACHE - 1)
            last = np.unique(slots[::-1], return_index=True)[1]
            pick = len(slots) - 1 - last
            self._key[slots[pick]], self._value[slots[pick]] = new[pick], found[pick]
        return out


def counts_of(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Words are runs without ASCII white space."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    white = sum(map(text.count, " \t\n\v\f\r"))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        full = [x for x in lines if x.strip(" \t\n\v\f\r")]
        dup = len(full) - len(set(full))
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen: dict = {}
            ids = np.array([seen.setdefault(w, k) for k, w in enumerate(windows)])
            often = np.bincount(ids, minlength=len(ids))[ids] > 1
            inside = np.zeros(n, dtype=bool)
            for k in range(3):
                inside[k : n - 2 + k] |= often
            repeat = int(inside.sum())
    return n, len(text) - white, len(_MARKS.findall(text)), dup, repeat


def _base_failed(n_words, n_repeat_words):
    """Of numbers or columns."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def _teaches(text: str) -> bool:
    n_words, word_chars, n_symbols, _, n_repeat_words = counts_of(text)
    return 100 * n_symbols <= COUNTED_MARKS_PERCENT * word_chars and not _base_failed(n_words, n_repeat_words)


def score(df: DataFrame, arrays: DataFrame) -> DataFrame:
    """Counts and log-perplexity of each row of doc_id, text, lang and text_hash."""
    found = arrays.select("low", "high", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    shards = [(r.low, r.high, r.path, r.row) for r in found.orderBy("low", "high").collect()]  # one short row for each array

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = common.held(("model", *shards), lambda: Model(shards))
        for batch in batches:
            out = np.full(len(batch), np.nan)
            texts = batch["text"].tolist()
            for lang, at in batch.groupby("lang", sort=False).indices.items():
                own = [texts[k] for k in at]
                for part in _chunks(own):
                    h, n, _, _ = grams(own[part], salt_of(lang))
                    ends = np.concatenate([[0], np.cumsum(model.log(h), dtype=np.float64)])
                    stop = np.cumsum(n)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        out[at[part]] = -(ends[stop] - ends[stop - n]) / n
            base = np.array([counts_of(t) for t in texts], dtype=np.int64).reshape(-1, 5)
            made = {"doc_id": batch["doc_id"].astype("Int64"), "lang": batch["lang"], "text_hash": batch["text_hash"]}
            made |= {name: base[:, k] for k, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
            yield pd.DataFrame(made | {"log_ppl": pd.array(out, dtype="Float64")})

    schema = "doc_id long, lang string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"
    return df.mapInPandas(run, schema)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", width: float = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and lang, perplexity, text_hash (of lang and text).

    Null text has no words and fails the base rule; null lang is a language of its own. An empty text has no
    perplexity, nor has one in a language without a text to learn from. Repeated rows are judged alike. Only key, text and lang are read.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), common.text_or_empty(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"))
    rows = rows.withColumn("text_hash", _digest("text", "lang"))
    counted = common.shared_table(count_ngrams(rows.select("lang", "text")), "ngrams")
    arrays = hash_arrays(estimate(counted), counted.count())
    scored = common.shared_table(score(rows, arrays), "scores")
    failed = _base_failed(F.col("n_words"), F.col("n_repeat_words"))
    quarters = scored.groupBy("lang").agg(F.percentile_approx(F.when(~failed & ~F.isnan("log_ppl"), F.col("log_ppl")), F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias("q"))
    reach = width * (F.col("q")[1] - F.col("q")[0])
    band = common.shared_table(quarters.select("lang", (F.col("q")[0] - reach).alias("low"), (F.col("q")[1] + reach).alias("high")), "bands")
    inside = F.coalesce(F.isnan("log_ppl") | F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return scored.join(common.bounded(band), "lang").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & inside).alias("kept"), "lang", F.exp("log_ppl").alias("perplexity"), "text_hash",
    )


def _digest(text: str, lang: str):
    return F.xxhash64(common.text_or_empty(text), F.coalesce(F.col(lang), F.lit("")))


def keep_good(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose text is kept, with all their columns. Rejected rows are told by key, text and language."""
    bad = common.shared_table(judge(df, key, text, lang).where(~F.col("kept")).select("doc_id", "text_hash").distinct(), "rejected")
    return common.among(df, key, _digest(text, lang), bad, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir))
