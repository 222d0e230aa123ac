"""Retrieval against a direct fit of every pair."""

import math
import random
import re
from collections import Counter

from evidence.operators import retrieval as R
from evidence.plans import runs

STOP = ("the", "of", "and")


def terms(text):
    words = [w for w in re.findall(r"\w{2,}", text.lower()) if w not in STOP]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def direct(claim, chunks, cap):
    """Weights of the claim and its chunks from one fit over all of them."""
    counts = [Counter(terms(t)) for t in [claim, *chunks]]
    total = sum(counts, Counter())
    vocabulary = [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:cap]]
    n = len(counts)
    idf = {t: math.log((1 + n) / (1 + sum(t in c for c in counts))) + 1 for t in vocabulary}
    vectors = [{t: c[t] * idf[t] for t in vocabulary if c[t]} for c in counts]
    norms = [math.sqrt(sum(v * v for v in vec.values())) for vec in vectors]
    return [
        sum(vectors[0][t] * vec.get(t, 0) for t in vectors[0]) / (norms[0] * norm) if norms[0] and norm else 0.0
        for vec, norm in zip(vectors[1:], norms[1:])
    ]


def fixture(spark):
    rng = random.Random(11)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh", "the", "of"]
    sentence = lambda n: " ".join(rng.choice(words) + rng.choice(["", "x", "y"]) for _ in range(n))
    sources = {k: ". ".join(sentence(rng.randint(3, 30)) for _ in range(rng.randint(1, 40))) for k in range(12)}
    sources[12] = "The of. And the."
    sources[13] = "  \n "
    claims = {k: sentence(rng.randint(2, 12)) for k in range(6)}
    claims[6] = "the of"
    pairs = [(c, s) for c in claims for s in sources]
    frames = (
        spark.createDataFrame(pairs, "claim_key bigint, source_key bigint"),
        spark.createDataFrame(list(claims.items()), "claim_key bigint, claim_text string"),
        spark.createDataFrame(list(sources.items()), "source_key bigint, source_text string"),
    )
    return claims, sources, pairs, frames


def test_similarity_equals_direct_fit(spark):
    claims, sources, pairs, (p, c, s) = fixture(spark)
    index = R.index_sources(s, STOP)
    chunks = {}
    for r in index.chunks.orderBy("source_key", "chunk_no").collect():
        chunks.setdefault(r.source_key, []).append(r.chunk_text)
    for cap in (1000, 60, 25):
        got = {(r.claim_key, r.source_key, r.chunk_no): r.score for r in R.similarity(p, c, index, STOP, cap).collect()}
        for a, b in pairs:
            for no, want in enumerate(direct(claims[a], chunks.get(b, []), cap)):
                assert math.isclose(got.get((a, b, no), 0.0), want, abs_tol=1e-9), (cap, a, b, no)


def test_evidence_and_fallback(spark):
    claims, sources, pairs, (p, c, s) = fixture(spark)
    index = R.index_sources(s, STOP, store=False)
    found = R.retrieve(p, c, index, STOP)
    rows = {}
    for r in found.orderBy("rank").collect():
        rows.setdefault((r.claim_key, r.source_key), []).append((r.rank, r.score))
    assert all(len(v) <= 3 and [k for k, _ in v] == list(range(1, len(v) + 1)) for v in rows.values())
    assert rows[(6, 12)] == [(1, 0.5)]
    outcome = {(r.claim_key, r.source_key): r.outcome for r in R.retrieval_outcome(p, index, found).collect()}
    assert len(outcome) == len(pairs)
    assert outcome[(0, 13)] == "empty_source" and outcome[(0, 12)] == "nothing_relevant" and outcome[(6, 12)] == "evidence"


def test_terms_are_not_shuffled(spark, monkeypatch):
    """Texts move by their key; rows of terms stay where they are made, whatever is counted on them."""
    claims, sources, pairs, (p, c, s) = fixture(spark)
    monkeypatch.setattr(R, "COPY_PAIRS", 2)  # several copies of each source
    index = R.index_sources(s, STOP)
    fit = R.vocab_cap(R.pair_terms(p, c, index, STOP), 25).groupBy(*R.PAIR).count()
    for df in (R.term_freq(s, ["source_key"], "source_text", STOP), fit):
        plan = df._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("Generate explode(")]
        assert "Exchange" not in above, plan
    chunks = {}
    for r in index.chunks.orderBy("source_key", "chunk_no").collect():
        chunks.setdefault(r.source_key, []).append(r.chunk_text)
    got = {(r.claim_key, r.source_key, r.chunk_no): r.score for r in R.similarity(p, c, index, STOP, 25).collect()}
    for a, b in pairs:
        for no, want in enumerate(direct(claims[a], chunks.get(b, []), 25)):
            assert math.isclose(got.get((a, b, no), 0.0), want, abs_tol=1e-9), (a, b, no)
    totals = {}
    for r in R.pair_terms(p, c, index, STOP).collect():
        totals.setdefault((r.claim_key, r.source_key), {})[r.term] = (r.total, r.df)
    for a, b in pairs:
        counts = [Counter(terms(t)) for t in [claims[a], *chunks.get(b, [])]]
        want = {t: (n, sum(t in x for x in counts)) for t, n in sum(counts, Counter()).items()}
        assert totals.get((a, b), {}) == want, (a, b)


def test_ground_with_model(spark):
    def model(batch):
        assert batch["excerpts"].str.startswith("[Chunk 1, similarity=").all()
        return batch.assign(passed=True, confidence=0.9, explanation="ok", supporting_quotes=[["q"]] * len(batch))

    p = spark.createDataFrame([(1, 1), (2, 1)], "claim_key bigint, source_key bigint")
    c = spark.createDataFrame([(1, "blue whales sing"), (2, "unrelated matter")], "claim_key bigint, claim_text string")
    s = spark.createDataFrame([(1, "Blue whales sing. Songs carry far.")], "source_key bigint, source_text string")
    got = {r.claim_key: (r.outcome, r.passed, r.confidence) for r in runs.ground(p, c, s, model).collect()}
    assert got == {1: ("evidence", True, 0.9), 2: ("nothing_relevant", False, 0.0)}


def test_stop_words_are_spark_s_own(spark):
    from pyspark.ml.feature import StopWordsRemover

    from evidence import constants as K

    assert list(K.STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")
