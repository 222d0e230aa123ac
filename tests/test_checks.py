"""Inputs of the retrieval queries."""

from catalog import checks
from catalog.core import Inputs


def test_pairs_hold_every_contained_item(spark, tmp_path):
    items = {0: "alpha beta gamma delta epsilon zeta eta", 1: "beta gamma delta", 2: "gamma delta", 3: "delta", 4: "ta-ga", 5: "", 6: None,
             7: "one two, three four five", 8: "a b c d", 9: "...", 10: "wo, th"}
    docs = [(40, "xalpha beta gamma delta epsilon zeta etax"), (41, "Here a b c d. One delta-ta-gax"), (42, "one two, three four five"), (43, ""),
            (44, None), (None, "none two, three four fives ... and alpha beta gamma delta epsilon zeta eta"), (45, "xbeta gamma deltas"), (45, "a b  c d")]
    spark.createDataFrame(list(items.items()), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(k, d) for d, text in docs for k, item in items.items() if text is not None and item is not None and item in text}
    want |= {(k, d) for d, _ in docs for k in items if d is not None and d % 40 == k}
    rows = checks.pairs(Inputs(spark, str(tmp_path))).collect()
    assert {(r.claim_key, r.source_key) for r in rows} == want and len(rows) == len(want)


def test_pairs_without_long_or_short_items(spark, tmp_path):
    for name, items in (("long", ["one two three four five six"]), ("short", ["three"])):
        folder = tmp_path / name
        spark.createDataFrame(list(enumerate(items, 1)), "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
        spark.createDataFrame([(7, "zone two three four five sixty")], "doc_id bigint, text string").write.parquet(str(folder / "documents.parquet"))
        assert [tuple(r) for r in checks.pairs(Inputs(spark, str(folder))).collect()] == [(1, 7)]
