"""Held-out accuracy of the two classifiers, gradients against differences, and rows with nothing in them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence.llm import langid as L
from evidence.llm import quality as Q
from evidence.llm.queries import op2_language, op10_quality

FOLDER = "/root/testdata/sf0.01"


def close(loss, weights, grads, names, step):
    rng = np.random.default_rng(3)
    for name in names:
        flat, want = weights[name].ravel(), grads[name].ravel()
        for i in rng.choice(len(flat), min(5, len(flat)), replace=False):
            was = flat[i]
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * step) - want[i]) < 2e-3 + 0.05 * abs(want[i]), name


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    rows, target = rng.integers(97, 123, (6, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net = {k: v.astype(np.float64) for k, v in L.new_network(3).items()}
    grads = L.gradients(net, rows, target)
    close(lambda: -np.log(L.probabilities(net, rows)[np.arange(6), target]).mean(), net, grads, ("out", "bias", "shift"), 1e-5)
    where = np.flatnonzero(L.reach().ravel())[:20]
    for i in where:
        flat = net["filters"].reshape(-1)
        was = flat[i]
        flat[i] = was + 1e-5
        up = -np.log(L.probabilities(net, rows)[np.arange(6), target]).mean()
        flat[i] = was - 1e-5
        down = -np.log(L.probabilities(net, rows)[np.arange(6), target]).mean()
        flat[i] = was
        assert abs((up - down) / 2e-5 - grads["filters"].ravel()[i]) < 1e-3


def test_gradients_of_the_attention():
    rng = np.random.default_rng(2)
    x, first, label = rng.normal(size=(9, Q.FEATURES)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    model = {k: v.astype(np.float64) for k, v in Q.new_model(np.zeros(Q.FEATURES), np.ones(Q.FEATURES)).items()}

    def loss():
        z = Q.forward(model, x, first)["logit"]
        return np.mean(np.log1p(np.exp(-z)) * label + np.log1p(np.exp(z)) * (1 - label))

    close(loss, model, Q.gradients(model, x, first, label), ("score", "bias", "attend", "tanh", "gate", "encode"), 1e-5)


def test_language_of_held_out_documents(spark):
    found = op2_language(spark, FOLDER)
    lang = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    held = found.join(lang, "doc_id").where("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert found.count() == lang.count() and held[1] > 100 and held[0] > 0.95


def test_quality_of_held_out_documents(spark):
    found = op10_quality(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    held = found.join(labels, "doc_id").where("held_out")
    right = held.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    lost = held.where("quality = 1").agg(F.avg(1 - F.col("predicted"))).first()[0]
    assert right > 0.95 and lost < 0.03
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_labels_of_the_rest_are_never_seen(spark):
    """The model is the same whatever the held-out labels say."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(rest, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (Q.fit(docs, x.where(~rest), epochs=1) for x in (labels, turned))
    assert all(np.array_equal(a[k], b[k]) for k in a)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, documents, odd, none, empty):
    rows = none if empty else odd
    model = L.fit(documents, epochs=1)
    found = L.predict(rows, model).collect()
    assert len(found) == rows.count()
    assert all((r.lang_pred == "und" and r.score == 0) == (r.doc_id in (3, 4, 5, 9)) for r in found if r.doc_id)
    assert all(0 <= r.score <= 1 for r in found)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    judge = Q.fit(documents, labels, epochs=1)
    assert len(Q.score(rows, judge).collect()) == rows.count()
    kept = Q.keep_good(rows, judge, threshold=0.0)
    assert kept.columns == rows.columns and sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))


def test_nothing_to_learn_from(odd, none, spark):
    assert {r.lang_pred for r in L.predict(odd, L.fit(none)).collect()} == {"und"}
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0)], "doc_id bigint, quality int")
    assert Q.fit(odd, labels) is None
    assert {(r.score, r.predicted) for r in Q.score(odd, None).collect()} == {(0.5, 1)}


def test_windows_hold_every_byte():
    texts = [b"", b"abc", bytes(range(256)) * 3, b"x" * 256]
    rows, first, used = L.windows(texts, 256)
    assert [bytes(rows[a:b].tobytes()[: len(t)]) for t, a, b in zip(texts, first, [*first[1:], len(rows)], strict=True)] == texts
    assert used.sum() == sum(map(len, texts))
