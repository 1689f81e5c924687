"""Log-bilinear scoring: counts against brute force, normalised probabilities, held-out gain, odd rows."""

import re
from binascii import crc32
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm import logbilinear as L


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    """(held_out, n_tokens, n_known, base) of each row, and the tokens that teach."""
    held = [crc32(str(k).encode() if k is not None else b"") % 5 == 1 for k, _ in rows]
    seen = Counter(t for (_, text), h in zip(rows, held) if not h for t in tokens(text))
    total, kinds = sum(seen.values()), len(seen)
    out = []
    for (_, text), h in zip(rows, held):
        own = tokens(text)
        out.append((h, len(own), sum(seen[t] > 0 for t in own), sum(log10((seen[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in own)))
    return out, seen


@pytest.mark.parametrize("known_words", [L.KNOWN_WORDS, 40])
def test_base_and_gain(spark, sf, known_words):
    docs = common.documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, seen = brute(rows)
    got = {r.doc_id: r for r in L.score(docs, known_words=known_words).collect()}
    assert len(got) == len(rows)
    for (key, _), (held, n, known, base) in zip(rows, want):
        r = got[key]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, sum(seen.values()))
        assert r.base_score == pytest.approx(base, rel=1e-9)
    fresh = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh) + 0.2 * sum(r.n_tokens for r in fresh)


def vocabulary():
    words = [f"w{k}".encode() for k in range(50)]
    hashes = np.array(sorted(map(L.hash_of, words)), dtype=np.uint64)
    return L.Vocabulary(1000, 51, 1, hashes, np.arange(1, 51), np.arange(1, 51), {}, np.array([0.0] * 51 + [9.0]), np.arange(20, 72))


def test_probabilities_are_normalised():
    counts = vocabulary().counts
    rng = np.random.default_rng(0)
    weights = L.Weights.new(counts)
    weights.output += rng.standard_normal(weights.output.shape).astype(np.float32)
    tables, size = L.Tables(weights), len(counts)
    for far, near in ((size, size), (size, 3), (0, 7), (11, 11)):
        p = np.exp(tables.log(np.full(size, far), np.full(size, near), np.arange(size)))
        assert p.sum() == pytest.approx(1, abs=1e-9)
        score = (weights.context[near] @ weights.near + weights.context[far] @ weights.far) @ weights.output.T + weights.bias
        assert np.allclose(p, np.exp(score - score.max()) / np.exp(score - score.max()).sum(), atol=1e-6)


def test_training_learns_what_follows():
    rng = np.random.default_rng(1)
    text = np.zeros(40_000, dtype="<u2")
    for k in range(1, len(text)):
        text[k] = (text[k - 1] * 7 + 3) % 20 if rng.random() < 0.9 else rng.integers(20)
    counts = np.bincount(text, minlength=20)
    far, near, word = L.places([text], 20)
    trainer = L.Trainer(L.Weights.new(counts), counts, 1)
    for _ in range(40):
        for at in np.split(rng.permutation(len(word)), 10):
            last = trainer.step(far[at], near[at], word[at])
    assert np.isfinite(last)
    got = L.Tables(trainer.w).log(far, near, word).mean()
    best = 0.9 * np.log(0.905) + 0.1 * np.log(0.005)
    assert best - 0.15 < got < best + 0.1
    assert got > np.log(counts / counts.sum())[word].mean() + 1.5


def test_places():
    far, near, word = L.places([np.array([5, 6, 0]), np.array([0]), np.array([7, 0])], 9)
    assert list(word) == [5, 6, 0, 0, 7, 0] and list(near) == [9, 5, 6, 9, 9, 7] and list(far) == [9, 9, 5, 9, 9, 9]


def test_odd_rows(spark):
    rows = [(5, "Some words HERE"), (5, "Some words HERE"), (None, "some"), (7, None), (8, ""), (9, "x" * 50_000), (10, "word " * 30_000), (11, "\x1cÉ漢字\x85 <b>\n\t\x0b"), (1, "new new new"), (6, "here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("1") for c in ("row", "hash", "symbols", "n", "held_out", "base")})
    want, seen = brute(rows)
    got = L.score(df, known_words=3).collect()
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got), key=key) == sorted(((k, h, n, known, round(base, 4)) for (k, _), (h, n, known, base) in zip(rows, want)), key=key)
    assert {r.train_tokens for r in got} == {sum(seen.values())} and all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert L.score(df.limit(0)).collect() == []
    alone = next(k for k in range(100) if crc32(str(k).encode()) % 5 == 1)
    one = L.score(spark.createDataFrame([(alone, "no text teaches")], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in one] == [(True, 4, 0, 0, 0.0)] and np.isfinite(one[0].score)
