"""Token counts that follow edits.

A document is kept as a segment tree: its leaves are runs of whole pre-token units with their text and token count, and
each inner node holds the sums of characters and tokens below it. An edit finds the leaves it touches by descending
the sums, re-encodes those leaves with one neighbouring leaf on either side, and updates the sums on the way up. Leaves
end only where the units of the tokenizer end whatever comes next, so the counts always equal those of the whole text.

Trees are kept: ``build_trees`` encodes the texts once and gives a table of leaves with their counts, to be written.
``apply_edits`` reads such a table, encodes nothing but the regions of the edits, and gives the table of the new trees,
which the next edits start from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import WHITE, encoder

TOKENIZER = "byte_bpe_50k.json"
#: A leaf ends at the first safe place after so many characters.
LEAF_CHARS = 256
#: Edited documents whose edits are broadcast at most.
BROADCAST_EDITED = 100_000
#: A safe place: after a character that is not white space, before white space. A unit ends there in any context.
_CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


class CountTree:
    """Segment tree of one document's token counts."""

    def __init__(self, text: str, count):
        self._count = count  # texts -> token counts
        self._build(self._leaves(text))

    @classmethod
    def kept(cls, leaves: list[str], tokens: list[int], count) -> CountTree:
        """The tree of stored leaves and counts; nothing is encoded."""
        tree = cls.__new__(cls)
        tree._count = count
        tree._build(leaves, tokens)
        return tree

    def counts(self) -> list[int]:
        """Token counts of the leaves."""
        return self._tokens[self._size : self._size + len(self.leaves)].tolist()

    @staticmethod
    def _leaves(text: str) -> list[str]:
        out, start = [], 0
        while start < len(text):
            cut = _CUT.search(text, start + LEAF_CHARS) if start + LEAF_CHARS < len(text) else None
            stop = cut.start() if cut else len(text)
            out.append(text[start:stop])
            start = stop
        return out

    def _build(self, leaves: list[str], tokens: list[int] | None = None) -> None:
        self.leaves = leaves
        self._size = 1
        while self._size < max(1, len(leaves)):
            self._size *= 2
        self._chars = np.zeros(2 * self._size, dtype=np.int64)
        self._tokens = np.zeros(2 * self._size, dtype=np.int64)
        self._chars[self._size : self._size + len(leaves)] = [len(x) for x in leaves]
        self._tokens[self._size : self._size + len(leaves)] = self._count(leaves) if tokens is None else tokens
        for level in (self._chars, self._tokens):
            k = self._size
            while k > 1:
                level[k // 2 : k] = level[k : 2 * k].reshape(-1, 2).sum(axis=1)
                k //= 2

    @property
    def n_tokens(self) -> int:
        return int(self._tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self._chars[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place`` (the last one for the end), and the place inside it."""
        node = 1
        while node < self._size:
            node *= 2
            if place >= self._chars[node] and self._chars[node + 1] > 0:
                place -= int(self._chars[node])
                node += 1
        return node - self._size, place

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self._size
        more = len(text) - int(self._chars[node]), tokens - int(self._tokens[node])
        while node:
            self._chars[node] += more[0]
            self._tokens[node] += more[1]
            node //= 2

    def edit(self, start: int, delete: int, insert: str) -> int:
        """Replace ``delete`` characters from ``start`` by ``insert``; both are cut to the text. Returns the number of
        characters that were encoded again."""
        start = min(max(start, 0), self.n_chars)
        delete = min(max(delete, 0), self.n_chars - start)
        if not self.leaves:
            self._build(self._leaves(insert))
            return len(insert)
        (first, at), (last, stop) = self._find(start), self._find(start + delete)
        left, right = max(first - 1, 0), min(last + 1, len(self.leaves) - 1)
        middle = "".join(self.leaves[left:first]) + self.leaves[first][:at] + insert + self.leaves[last][stop:] + "".join(self.leaves[last + 1 : right + 1])
        # the region must end in a safe place again: if its edges turned unsafe it grows, a leaf at a time
        while left > 0 and not _CUT.match(self.leaves[left - 1][-1:] + middle[:1], 1):
            left -= 1
            middle = self.leaves[left] + middle
        while right + 1 < len(self.leaves) and not (middle and _CUT.match(middle[-1:] + self.leaves[right + 1][:1], 1)):
            right += 1
            middle += self.leaves[right]
        fresh = self._leaves(middle)
        counts = self._count(fresh)
        if len(fresh) <= right - left + 1:
            for k in range(right - left + 1):
                self._set(left + k, fresh[k] if k < len(fresh) else "", int(counts[k]) if k < len(fresh) else 0)
            if not self.n_chars:
                self._build([])
        else:  # more leaves than places: the tree is laid out anew, nothing else is encoded
            old = self._tokens[self._size : self._size + len(self.leaves)].tolist()
            leaves = self.leaves[:left] + fresh + self.leaves[right + 1 :]
            tokens = old[:left] + [int(c) for c in counts] + old[right + 1 :]
            kept = [(x, n) for x, n in zip(leaves, tokens) if x]
            self._build([x for x, _ in kept], [n for _, n in kept])
        return len(middle)


def counter(tokenizer: str = TOKENIZER):
    def count(texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in encoder(tokenizer).encode(texts)]

    return count


TREES = "doc_id long, row long, leaves array<string>, tokens array<int>"


def build_trees(docs: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The tree of each row of ``docs``: doc_id, row (a number of its own), leaves (their texts) and tokens (their counts).
    Null text counts as empty. Write the table before it is read twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for batch in batches:
            leaves = [CountTree._leaves(t) for t in batch["text"]]
            flat = count([x for part in leaves for x in part])
            ends = np.cumsum([0, *map(len, leaves)])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "row": batch["row"], "leaves": leaves, "tokens": [flat[a:b] for a, b in zip(ends, ends[1:])]})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), common.text_or_empty(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInPandas(run, TREES)


def apply_edits(trees: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The trees after their edits. ``trees``: a table of ``build_trees`` with a column edits, an array of (seq, start, delete,
    insert) or null. Besides the new tree: n_tokens before, n_tokens_after, n_edits, chars_encoded again, n_chars_after and
    text_crc32_after."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for batch in batches:
            out = []
            for doc_id, row, leaves, tokens, edits in batch[["doc_id", "row", "leaves", "tokens", "edits"]].itertuples(index=False):
                tree = CountTree.kept(list(leaves), list(tokens), count)
                before, again = tree.n_tokens, 0
                edits = [] if edits is None else list(edits)
                for e in edits:
                    again += tree.edit(int(e["start"]), int(e["delete"]), e["insert"])
                crc = 0
                for leaf in tree.leaves:
                    crc = zlib.crc32(leaf.encode("utf-8", "replace"), crc)
                out.append((doc_id, row, tree.leaves, tree.counts(), before, tree.n_tokens, len(edits), again, tree.n_chars, crc))
            names = ["doc_id", "row", "leaves", "tokens", "n_tokens", "n_tokens_after", "n_edits", "chars_encoded", "n_chars_after", "text_crc32_after"]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    more = "n_tokens long, n_tokens_after long, n_edits long, chars_encoded long, n_chars_after long, text_crc32_after long"
    return trees.select("doc_id", "row", "leaves", "tokens", "edits").mapInPandas(run, f"{TREES}, {more}")


def with_edits(trees: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``trees`` with the edits of their documents, of which there are few beside the documents: only trees with edits are
    touched by them, and where the edits are few enough to broadcast no tree is shuffled.

    ``edits``: key, seq, start, delete, insert; a document's edits apply in the order of seq, start and insert, each to
    the text left by those before it. Places beyond the text are cut to it; null insert is empty, other nulls are 0.
    Rows with a null key have no edits; rows that repeat a key are edited alike.
    """
    grouped = edits.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("__k")).agg(
        F.array_sort(F.collect_list(F.struct(
            F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("start", F.lit(0)).cast("long").alias("start"),
            F.coalesce("delete", F.lit(0)).cast("long").alias("delete"), F.coalesce("insert", F.lit("")).alias("insert"),
        ))).alias("edits")
    )
    grouped = common.shared_table(grouped, "edits")
    return trees.join(common.bounded(grouped, BROADCAST_EDITED), F.col("doc_id") == F.col("__k"), "left").drop("__k")


RESULT = ["doc_id", "n_tokens", "n_tokens_after", "n_edits", "chars_encoded", "n_chars_after", "text_crc32_after"]


def count_with_edits(docs: DataFrame, edits: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens before, n_tokens_after all edits, n_edits, chars_encoded again,
    n_chars_after and text_crc32_after. Trees are built and written, then edited; see ``with_edits`` for the edits."""
    trees = common.shared_table(build_trees(docs, tokenizer, key, text), "trees")
    return apply_edits(with_edits(trees, edits, key), tokenizer).select(RESULT)


def sample_edits(trees: DataFrame) -> DataFrame:
    """``trees`` with three edits each from a rule on key and length: a word changed, a passage cut, a line put in."""
    n = F.aggregate(F.transform("leaves", lambda x: F.length(x)), F.lit(0), lambda acc, x: acc + x)
    spot = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.col("__n") + 1)
    one = lambda seq, start, delete, insert: F.struct(F.lit(seq).alias("seq"), start.alias("start"), F.lit(delete).cast("long").alias("delete"), insert.alias("insert"))
    made = F.array(
        one(1, spot("word"), 4, F.lit("edited")),
        one(2, spot("cut"), 120, F.lit("")),
        one(3, spot("line"), 0, F.concat(F.lit("\nnote "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(": it's new.\n"))),
    )
    return trees.withColumn("__n", n).withColumn("edits", made).drop("__n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents from their kept trees, before and after ``sample_edits``."""
    trees = common.shared_table(build_trees(common.documents(spark, sf_dir)), "trees")
    return apply_edits(sample_edits(trees)).select(RESULT)
