"""Mixing, and the pipeline stage by stage on a small folder."""

import math
import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from evidence.llm import mixing as M
from evidence.llm import simhash as S

FOLDER = "/root/testdata/sf0.001"


def test_table_of_the_distribution(spark):
    for mean in (0.0, 0.3, 1.0, 7.5, 31.0):
        cdf = spark.range(1).select(M._poisson_table(M.F.lit(mean)).alias("c")).first().c
        want, total, term = [], 0.0, math.exp(-mean)
        for k in range(len(cdf)):
            total += term
            want.append(total)
            term *= mean / (k + 1)
        assert max(abs(a - b) for a, b in zip(cdf, want, strict=True)) < 1e-12 and abs(cdf[-1] - 1) < 1e-12


def test_shares_follow_the_weights(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'word word' AS text", "CASE WHEN id % 10 = 0 THEN 'b' WHEN id % 10 = 1 THEN NULL ELSE 'a' END AS source", "'mine' AS rate")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), (None, 2.0), ("absent", 9.0), ("a", 0.0)], "source string, weight double")
    mixed = M.mix(docs, weights, epochs=2.0)
    found = Counter(r.source for r in mixed.select("row.source").collect())
    total = sum(found.values())
    assert abs(total / 40_000 - 1) < 0.03 and abs(found["a"] / total - 0.25) < 0.02 and abs(found[None] / total - 0.5) < 0.02
    assert mixed.select("row.*").columns == docs.columns
    heavy = M.mix(docs.where("doc_id < 40"), epochs=150.0)  # a mean of more than one draw
    assert abs(heavy.count() / 6000 - 1) < 0.1
    assert sorted(map(str, mixed.collect())) == sorted(map(str, M.mix(docs.repartition(3), weights, epochs=2.0).collect()))


def test_mixing_odd_rows(spark, odd, none):
    mixed = M.mix(odd, epochs=5.0)
    assert mixed.select("row.*").columns == odd.columns and mixed.count() > 0 and M.mix(none).count() == 0
    nothing = spark.createDataFrame([("s", 0.0)], "source string, weight double")
    assert M.mix(odd, nothing).count() == 0


def stored(spark, df, tmp_path, k):
    df.write.parquet(f"{tmp_path}/{k}")
    return spark.read.parquet(f"{tmp_path}/{k}")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stored(spark, stage(spark, docs, FOLDER), tmp_path, k)
        seen.append(docs)
        assert k == len(P.STAGES) - 1 or docs.columns == columns
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen[0].collect()}
    good = [i for i, q in quality.items() if q == 1]
    assert sum(i in kept for i in good) / len(good) > 0.95
    first = {}
    for r in seen[0].collect():
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[text] = min(first.get(text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in seen[1].collect()) == sorted(first.values())
    assert {r.doc_id for r in seen[3].collect()} <= {r.doc_id for r in seen[2].collect()} <= {r.doc_id for r in seen[1].collect()}
    assert seen[4].where("NOT same").count() == 0 and seen[4].count() == seen[3].count()


def test_near_dedup_is_by_fingerprints(spark):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(reversed(words)), "", None, " ".join(words[:40]), " ".join(words[:48])]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    prints = [S.simhash(t or "") for t in texts]
    linked = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2
    want = [k for k in range(len(texts)) if not any(linked(k, j) for j in range(k))]
    kept = sorted(r.doc_id for r in dict(P.STAGES)["near dedup"](spark, docs, FOLDER).collect())
    assert kept == want and 4 not in kept


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_with_odd_rows(spark, tmp_path, request, rows):
    docs = request.getfixturevalue(rows)
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stored(spark, stage(spark, docs, FOLDER), tmp_path, k)
    assert docs.count() == 0 or rows == "odd"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_registered_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, FOLDER).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
