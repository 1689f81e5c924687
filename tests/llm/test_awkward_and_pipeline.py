"""Nulls, empty and long texts, repeats, empty tables and clashing columns; and the pipeline."""

import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import common, counting, html, nearcopies, packing, quality, sampling, secrets, sharding, simhash, tokenfile, vectors

LONG = "the quick brown fox jumps over 17 lazy dogs. " * 3000
ROWS = [(5, "some words here", "en"), (5, "some words here", "en"), (None, "some words here", "en"), (7, None, None), (7, "", "en"), (8, LONG, "en"), (9, "x" * 50_000, "de"), (10, "\n\n \t", None), (-3, "É漢字 \x01\x02   <b>", "fr")]


@pytest.fixture(scope="module")
def odd(spark):
    extra = ["1 as fp", "2 as piece", "3 as length", "4 as __bucket", "5 as row", "6 as n", "'s' as source", "0L as n_chars", "7 as file_no", "8 as score", "9 as batch"]
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", *extra)


OPERATORS = {
    "quality": quality.judge,
    "sampling": sampling.encode,
    "packing": packing.pack_documents,
    "sharding": sharding.shard_documents,
    "token files": lambda d: tokenfile.read_documents(tokenfile.write_token_files(d)),
    "counts": lambda d: counting.count_with_edits(d, counting.sample_edits(counting.build_trees(d)).where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", F.explode("edits").alias("e")).select("doc_id", "e.*")),
    "simhash": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(odd, name):
    rows = OPERATORS[name](odd).collect()
    if name == "packing":
        rows = [r for r in rows if r.piece == 0]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(odd, name):
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_other_empty_tables(spark, odd):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert vectors.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    model = secrets.train(secrets.labelled_findings(spark))
    assert secrets.scan(odd.limit(0), model).collect() == []
    assert secrets.redact(odd.limit(0), model).collect() == []
    assert quality.keep_good(odd.limit(0)).collect() == [] and simhash.one_of_each(odd.limit(0)).collect() == []


def test_one_of_each(odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [-3, 5, 7, 8, 9]


def test_ranks_are_gapless(spark):
    rows = spark.range(100_000).selectExpr("if(id % 3 = 0, id % 7, 9) as k", "id % 2 as v")  # two thirds share a key
    got = common.ranked(rows, "k", [F.col("v")], "at", 100_000).toPandas()
    for _, g in got.groupby("k"):
        assert (g.sort_values("at")["at"].to_numpy() == range(len(g))).all() and g.sort_values("at")["v"].is_monotonic_increasing


def test_running_totals(spark):
    rows = common.shared_table(spark.range(20_000).selectExpr("cast(id * 3 as int) as n", "id % 5 as v"), "test")
    at = 0
    for r in common.running_total(rows, "n", "v", "before").orderBy("n").collect():
        assert r.before == at
        at += r.v


def test_pipeline(spark, sf):
    docs = common.documents(spark, sf)
    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.shared_table(stage(spark, now, sf), name)
        assert now.columns == docs.columns
        counts.append(now.count())
    assert docs.count() > counts[0] > counts[1] == counts[2] > 0
    judged = quality.judge(docs)
    assert counts[0] == judged.where("kept").count()
    before = {r.doc_id for r in docs.collect()}
    good = quality.keep_good(docs)
    assert counts[1] == nearcopies.groups(good).select("component_id").distinct().count()
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()} <= before


def test_optional_part(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and "gridloom.llm" in sys.modules
