"""Phrase mining against SQL and brute force, and the sketches alone."""

import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.llm import collocations as C


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.execute(C.SQL)
    names = [d[0] for d in found.description]
    got = C.query(spark, sf)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


def brute(rows, least, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang, text = lang if lang is not None else "und", text or ""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                for k in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[k : k + m])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        found = []
        for p, a in frequent.items():
            inside = [q for q in frequent if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q)))]
            if any(100 * frequent[q] >= 80 * a for q in inside):
                continue
            score, _, left, rest = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, rest))
        found.sort()
        out += [(lang, k + 1, p.decode(), -a, left, rest, totals[lang], -s) for k, (s, a, p, left, rest) in enumerate(found[:top])]
    return sorted(out)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    word = lambda: "abcdeéß漢\x1cZ"[rng.integers(10)] * rng.integers(1, 3)
    texts = ["".join(word() + " \t,.\n\v:;!? "[rng.integers(11)] + " " for _ in range(300)) for _ in range(30)]
    rows = [(t, ["en", None, "und", "", "de"][k % 5]) for k, t in enumerate(texts)]
    rows += [(None, "en"), ("", None), (" .. ", "fr"), ("same old words", "en")] + [("the same old words again", "en")] * 60 + [("x " * 20_000, "en"), ("y" * 100_000, "en")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("n", "phrase", "words", "rank", "k")})
    for least, top in ((5, 2_000), (30, 7), (2, 40)):
        got = C.mine(df, least=least, top=top).collect()
        assert sorted(map(tuple, got)) == brute(rows, least, top)
    assert C.mine(df.limit(0)).collect() == []


def test_chunks_end_between_pieces(monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 50)
    texts = ["One two, three FOUR. " * 9, "z" * 400, "", "a\nb", "no end here " * 20]
    got = [chunk for _, chunk in C.chunks(pd.DataFrame({"lang": "en", "text": texts}))]
    pieces = lambda data: [p for p in data.split(b".") if p]
    assert [p for c in got for p in pieces(c)] == pieces(".".join(texts).lower().replace(",", ".").replace("\n", ".").encode())
    assert len(got) > 5 and b"z" * 400 in got


@pytest.mark.parametrize("bits_of_cells", [12, 28])
def test_sketch_never_underestimates(monkeypatch, bits_of_cells):
    monkeypatch.setattr(C, "HELD_CELLS", 500)
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 3_000).astype(np.uint64))
    n = rng.integers(1, 50, len(keys))
    cells = 1 << bits_of_cells
    held, dense = C._Cells(cells), np.zeros(2 * cells, dtype=np.int64)
    blocks = []
    for part in np.array_split(np.arange(len(keys)), 20):
        held.add(keys[part], n[part])
        if held.full():
            blocks += held.blocks()
    for frame in [*blocks, *held.blocks()]:
        for block, at, counts in zip(frame["block"], frame["cells"], frame["counts"]):
            dense[block * (2 * cells // C.BLOCKS) + np.cumsum(C._unpacked(at), dtype=np.int64)] += C._unpacked(counts)
    assert len(blocks) > 1 and dense.sum() == 2 * n.sum()
    estimate = dense[C.cells_of(keys, cells)].min(axis=0)
    assert (estimate >= n).all()
    bits = C.Bits(cells, np.packbits(dense >= 30))
    assert (bits.hold(keys) == (estimate >= 30)).all()
