"""Reject rates of the perplexity band for labelled documents."""

from gridloom.llm import quality


def test_junk_goes_and_good_stays(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    fine = [r for r in quality.query(spark, sf).collect() if not r.base_failed]
    bad, good = ([r.kept for r in fine if label.get(r.doc_id) == x] for x in (0, 1))
    assert bad and sum(bad) <= 0.02 * len(bad)
    assert sum(good) >= 0.98 * len(good)
