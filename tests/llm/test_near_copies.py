"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random
import re

import corpus_pipeline
from gridloom.llm import common, nearcopies, simhash

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(texts):
    sets = {}
    for k, text in texts.items():
        words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * both >= 4 * every:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_stage_against_brute_force(spark, sf):
    docs = common.documents(spark, sf)
    want = brute({r.doc_id: r.text or "" for r in docs.collect()})
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_links_beyond_the_first_of_a_band(spark):
    words = [f"w{k}" for k in range(200)]
    changed = lambda *at: " ".join(f"x{k}" if k in at else w for k, w in enumerate(words))
    texts = {1: changed(), 2: changed(10, 60), 3: changed(10, 60, 110, 160), 4: changed(10, 60, 110, 160, 35, 85), 5: " ".join(words[:150]), 6: "Two Words", 7: "two  words", 8: "", 9: "\n"}
    frame = spark.createDataFrame([*texts.items(), (None, "two words"), (7, "two words")], "doc_id long, text string").selectExpr("*", "1 as h", "2 as s", "3 as n")
    got = nearcopies.groups(frame).collect()
    want = brute(texts)
    assert len(set(want.values())) == 4  # 1 to 4 are a chain, 1 and 4 are not alike themselves
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == want and len(got) == len(texts) + 2
    assert sorted(r.doc_id or 0 for r in nearcopies.one_of_each(frame).collect()) == [0, 1, 5, 6, 8]


def test_rows_of_one_key_and_other_texts_stay(spark):
    rows = [(1, "one text of its own"), (1, "quite another text"), (1, "one text of its own"), (2, "One text of its own"), (None, "one text of its own"), (3, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __key", "2 as __digest")
    for keep in (nearcopies.one_of_each, simhash.one_of_each):
        got = keep(frame)
        assert got.columns == frame.columns
        assert sorted(((r.doc_id or 0), (r.text or "").lower()) for r in got.collect()) == [(0, rows[0][1]), (1, rows[0][1]), (1, rows[1][1]), (3, "")]


def test_large_group_of_near_copies_and_of_one_passage(spark, monkeypatch):
    draw = random.Random(7)
    words = [f"w{k}" for k in range(140)]
    texts = {1_000: " ".join(words)}
    for k in range(300):  # copies of one text, some of them alike only by way of another, some not at all
        own = words[: draw.randint(120, 140)]
        for at in draw.sample(range(len(own)), draw.randint(1, 6)):
            own[at] = f"x{k}-{at}"
        texts[k] = " ".join(own)
    for k in range(300, 420):  # half of each text is the same passage
        texts[k] = " ".join([f"y{k}-{j}" for j in range(45)] + [f"p{j}" for j in range(60)])
    monkeypatch.setattr(nearcopies, "CROWD", 8, raising=False)
    pairs = []
    confirmed = nearcopies._confirmed
    monkeypatch.setattr(nearcopies, "_confirmed", lambda p, t: pairs.append(p.count()) or confirmed(p, t))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.groups(frame).collect()}
    want = brute(texts)
    assert got == want and 250 < len(set(want.values())) < 350
    assert sum(pairs) < 10 * len(texts)  # 2,910; 42,308 when bands gave all their pairs
