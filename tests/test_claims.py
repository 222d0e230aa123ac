"""Claims: parsing answers, location, order, groups, routing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions import spans
from evidence.operators import claims as C
from evidence.operators import routing
from evidence.operators import setjoin
from evidence.operators.setjoin import most_similar_sets, similar_sets


def claims(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id bigint, claim_id string, seq bigint, text string, claim_type string, citation_id string, citation_found boolean")


def test_normalize_answers(spark):
    answers = [
        (1, 0, '{"claims": [{"claim_text": "a", "claim_type": "quantitative", "citation_marker": "[1]", "is_original": false}, {}]}'),
        (1, 1, ' [{"claim_text": "b", "citation_marker": null}, {"claim_text": "c", "citation_marker": "null", "is_original": true}]'),
        (1, 2, "no json"), (1, 3, ""), (1, 4, None),
    ]
    df = spark.createDataFrame(answers, "doc_id bigint, chunk_id int, answer string")
    got = [tuple(r) for r in C.normalize_claim_json(df).orderBy("claim_id").select(
        "claim_id", "text", "claim_type", "citation_text", "citation_found", "is_original").collect()]
    assert got == [
        ("claim_0_0", "a", "quantitative", "[1]", True, False), ("claim_0_1", "", "qualitative", None, False, False),
        ("claim_1_0", "b", "qualitative", None, False, False), ("claim_1_1", "c", "qualitative", None, False, True),
    ]


def test_location(spark):
    text = "Tides were low. Gulls eat crabs. Later. Gulls  eat\ncrabs. (a+b)* = c|d."
    cases = [
        ("Gulls eat crabs.", 0, (16, 32)), ("Gulls eat crabs.", 30, (16, 32)), ("Gulls eat  crabs.", 30, (40, 57)),
        ("crabs eat gulls", 0, (None, None)), ("", 0, (None, None)), ("  ", 999, (45, 47)), ("   ", 0, (None, None)),
        ("(a+b)*  = c|d.", 3, (58, 71)), ("Gulls", -5, (16, 21)),
    ]
    df = spark.createDataFrame([(1, i, c, h) for i, (c, h, _) in enumerate(cases)], "doc_id bigint, n int, text string, hint int")
    paper = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = {r.n: (r.start, r.end) for r in C.locate_claims(df, paper).collect()}
    for i, (claim, _, want) in enumerate(cases):
        assert got[i] == want, (claim, got[i])
        if want[0] is not None:
            assert text[want[0]:want[1]].split() == claim.split()


def plain_span(text, claim, hint, loose):
    """By find, then by a pattern of the claim's words."""
    hint = max(0, hint or 0)
    if not claim:
        return None
    at = text.find(claim, hint)
    at = text.find(claim) if at < 0 else at
    if at >= 0:
        return at, at + len(claim)
    words = [re.escape(w) for w in re.split(f"[{K.SPACE_CHARS}]+", claim) if w]
    if not loose or not words:
        return None
    pattern = re.compile(f"[{K.SPACE_CHARS}]+".join(words))
    hit = pattern.search(text, hint) or pattern.search(text)
    return hit.span() if hit else None


def test_many_spans_by_brute_force():
    rng = random.Random(5)
    parts = ["a", "b", "ab", " ", "  ", "\n", "\u2003 ", "é", "\U0001f600", "abab", "the cat ", "x.y"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        wanted = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 4))), rng.choice([None, -3, 0, 5, 20, 999])) for _ in range(8)]
        for _ in range(8):
            a = rng.randint(0, len(text))
            piece = text[a : a + rng.randint(0, 50)]
            wanted.append((re.sub(r"\s+", lambda m: rng.choice([" ", "  ", "\t"]), piece) if rng.random() < 0.5 else piece, rng.randint(0, 70)))
        for loose in (False, True):
            assert spans.locate(text, [*wanted, (None, 0)], loose) == [plain_span(text, w, h, loose) for w, h in wanted] + [None]


def test_hashes_that_collide_are_told_apart(monkeypatch):
    monkeypatch.setattr(spans, "whole_hash", lambda text: spans.np.uint64(0))
    monkeypatch.setattr(spans.Finder, "hashes", lambda self, places, width: spans.np.zeros(len(places), spans.np.uint64))
    assert spans.locate("one two one", [("two", 0), ("one", 2), ("six", 0)], True) == [(4, 7), (8, 11), None]


def test_claims_of_a_long_paper_are_dealt_out(spark):
    text = " ".join(f"sentence number {n}." for n in range(3000))
    df = spark.createDataFrame([(1, f"c{n}", f"sentence  number {n}.", 0) for n in range(3000)], "doc_id bigint, claim_id string, text string, hint int")
    paper = spark.createDataFrame([(1, text), (2, "no claims")], "doc_id bigint, text string")
    got = C.locate_claims(df, paper, listed=100).collect()
    assert len(got) == 3000 and all(text[r.start : r.end] == r.text.replace("  ", " ") for r in got)


def test_constraint_splits_rows(spark):
    df = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, True)], "claim_id string, is_original boolean, citation_found boolean")
    good, bad = C.claim_constraint(df)
    assert sorted(r.claim_id for r in good.collect()) == ["b", "c"]
    assert [r.claim_id for r in bad.collect()] == ["a"]


def test_order_groups_and_routes(spark):
    rng = random.Random(3)
    rows = []
    for doc in range(3):
        for seq in range(200):
            cite = rng.choice([None, None, "1", "10", "2", "Smith"])
            rows.append((doc, f"claim_0_{seq}", seq * 70_000, "t", rng.choice(["qualitative", "quantitative", "other"]), cite, cite is not None))
    df = claims(spark, rows)
    got = {(r.doc_id, r.claim_id): r.position for r in C.order_claims(df).collect()}
    for doc in range(3):
        mine = [r for r in rows if r[0] == doc]
        want = sorted(mine, key=lambda r: ((r[5] is not None) * 2 + (r[4] != "qualitative"), r[5] or "", r[2]))
        assert [got[(doc, r[1])] for r in want] == list(range(1, 201))
    groups = {(r.doc_id, r.group_key): r.n_claims for r in C.group_by_citation(df).collect()}
    assert sum(groups.values()) == len(rows)
    assert groups[(0, "_no_citation")] == sum(r[0] == 0 and r[5] is None for r in rows)
    routed = routing.route_claims(df).groupBy("result_class").count().collect()
    assert sum(r["count"] for r in routed) == len(rows)
    assert {r.result_class for r in routed} == {
        None, "qualitative_cited", "qualitative_uncited", "quantitative_cited", "quantitative_uncited"}


def test_rating_modes(spark):
    ratings = ["True", "Incorrect", "Untrue", "Half", "Mostly true", "Inaccurate", "Verified"]
    df = spark.createDataFrame([(r,) for r in ratings], "textual_rating string")
    both = {
        r.textual_rating: (r.a, r.b)
        for r in df.select("textual_rating", routing.rating_passes(F.col("textual_rating")).alias("a"),
                           routing.rating_passes(F.col("textual_rating"), "word").alias("b")).collect()
    }
    assert both == {
        "True": (True, True), "Incorrect": (True, False), "Untrue": (True, False), "Half": (False, False),
        "Mostly true": (True, True), "Inaccurate": (True, False), "Verified": (True, True)}


def test_context_is_whole_unless_bounded(spark):
    chunks = spark.createDataFrame([(1, 0, "t")], "doc_id bigint, chunk_id int, text string")
    facts = spark.createDataFrame([(1, "T", "x" * 500)], "doc_id bigint, title string, abstract string")
    book = spark.createDataFrame([(1, str(n), "e" * 200, n) for n in range(15)], "doc_id bigint, citation_id string, citation_text string, pos int")
    whole = C.claim_context(chunks, facts, book).first()
    assert whole.abstract_preview == "x" * 500
    assert whole.citation_list.split("\n") == [f"{n}: " + "e" * 200 for n in range(15)]
    row = C.claim_context(chunks, facts, book, entries=10, entry_chars=100, abstract_chars=400).first()
    assert len(row.abstract_preview) == 403 and row.citation_list.split("\n")[9] == "9: " + "e" * 100 + "..."
    assert len(row.citation_list.split("\n")) == 10


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("block_rows", [2, 4096])
def test_similar_sets_equal_brute_force(spark, threshold, block_rows):
    pick = random.Random(5)
    drawn = lambda: sorted({f"w{int(pick.paretovariate(0.7)) % 60}" for _ in range(pick.randint(1, 14))})
    left, right = {f"l{k}": drawn() for k in range(80)}, {f"r{k}": drawn() for k in range(80)}
    right |= {f"x{k}": [*left["l0"], f"own{k % 7}"] for k in range(30)}
    left["none"] = right["none"] = []
    frames = [spark.createDataFrame(list(sets.items()), "pid string, words array<string>") for sets in (left, right)]
    got = {(r.a, r.b): r.similarity for r in similar_sets(*frames, threshold, block_rows).collect()}
    want = {}
    for a, x in left.items():
        for b, y in right.items():
            shared = len({*x} & {*y})
            if shared and shared / (len(x) + len(y) - shared) >= threshold:
                want[a, b] = shared / (len(x) + len(y) - shared)
    assert got == want


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_most_similar_sets_hold_every_best_pair(spark, threshold):
    pick = random.Random(9)
    drawn = lambda: sorted({f"w{int(pick.paretovariate(0.7)) % 30}" for _ in range(pick.randint(1, 14))})
    left, right = {f"l{k}": drawn() for k in range(60)}, {f"r{k}": drawn() for k in range(90)}
    frames = [spark.createDataFrame(list(sets.items()), "pid string, words array<string>") for sets in (left, right)]
    best = lambda pairs: {(a, b, s) for a, b, s in pairs if s == max(t for c, _, t in pairs if c == a)}
    got = [tuple(r) for r in most_similar_sets(*frames, threshold, 2).collect()]
    every = [tuple(r) for r in similar_sets(*frames, threshold).collect()]
    assert len(set(got)) == len(got) and set(got) <= set(every)
    assert best(got) == best(every)


def test_only_prefixes_of_sets_become_rows(spark):
    sets = spark.createDataFrame([(f"p{k}", [f"w{n}" for n in range(k, k + 100)]) for k in range(20)], "pid string, words array<string>")
    counts = spark.sparkContext.broadcast(setjoin._held(sets))
    rows = setjoin._ordered(sets, counts, 0.8)
    assert rows.count() == 20 * 21 and dict(rows.dtypes) == {"key": "bigint", "n": "int", "pos": "int", "word": "bigint"}
    assert setjoin._parities(sets).count() == 20


def test_most_similar_review(spark):
    claims = spark.createDataFrame(
        [(1, "A b c d e"), (2, "a  B c d e f"), (3, "nothing alike"), (4, None), (5, " "), (2, "a  B c d e f")], "doc_id int, text string")
    reviews = spark.createDataFrame(
        [(9, "e d c b a", "False", "p", "u9"), (8, "a b c d e", "True", "p", "u8"), (7, "a b c d e g", None, None, None), (6, None, "x", "p", "u"), (5, "a b c d f", "x", "p", "u5")],
        "review_id int, claim_text string, textual_rating string, publisher string, url string")
    rows = [(r.doc_id, r.review_id, r.url, r.similarity) for r in routing.factcheck_similar(claims, reviews).collect()]
    assert sorted(rows, key=str) == [(1, 8, "u8", 1.0), (2, 5, "u5", 5 / 6), (2, 5, "u5", 5 / 6), (3, None, None, None), (4, None, None, None), (5, None, None, None)]
    assert routing.factcheck_similar(claims, reviews.limit(0)).where("review_id IS NOT NULL").count() == 0
    assert routing.factcheck_similar(claims.limit(0), reviews).count() == 0
