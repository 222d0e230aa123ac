"""Patterns, guess costs against all ways to cut a value, and whole tables against a plain program."""

import hashlib
import math
import random
import re
from collections import Counter

from evidence.llm import secrets as S

WORDS = {"password": 11.0, "summer": 13.0, "horse": 14.0, "the": 5.0, "correct": 13.0, "sum": 9.0}


def least(value, words):
    """Every way to cut a value into the listed spans and brute force, one by one."""
    spans = list(S.patterns(value, words))

    def rest(i, brute):
        if i == len(value):
            return 0.0
        ways = [S.char_bits(value[i]) + (0 if brute else S.SEGMENT) + rest(i + 1, True)]
        ways += [bits + S.SEGMENT + rest(j, False) for a, j, bits, _ in spans if a == i]
        return min(ways)

    return rest(0, False)


def test_cost_is_the_least_of_all_ways():
    pick = random.Random(1)
    parts = ["password", "Summer", "2024", "19840623", "xx", "abab", "qwerty", "7", "#", "h0rse", "THE", "é"]
    for value in ["".join(pick.choice(parts) for _ in range(pick.randint(1, 3)))[:14] for _ in range(60)]:
        bits, cut = S.guess_cost(value, WORDS)
        assert math.isclose(bits, least(value, WORDS)) and "".join(s for _, s in cut) == value


def test_kinds_of_segments():
    kinds = lambda v: [k for k, _ in S.guess_cost(v, WORDS)[1]]
    assert kinds("Summer2024") == ["word", "date"] and kinds("p4ssw0rd") == ["word"] and kinds("31.12.1999") == ["date"]
    assert kinds("zzzzzzzzzzzz") == ["repeat"] and kinds("qwertyuiop") == ["walk"] and kinds("k8#Vq!2x") == ["brute"]
    assert S.guess_cost("correcthorse", WORDS)[0] < S.THRESHOLD < S.guess_cost("x7#kQ9!vLp2s", WORDS)[0]
    assert S.guess_cost("x" * 100_000, WORDS)[0] < S.THRESHOLD


def test_patterns():
    text = 'Password: "abcdefghijkl" api_key=short TOKEN = zzzzzzzzzzzz AKIA' + "A" * 14 + " AKIAB " + "0f" * 8 + " ſecret: abcdefghijklmnop"
    found = [(S.KINDS[k], text[a:b]) for a, k, b in S.base_spans(text)]
    assert found == [("assign", 'Password: "abcdefghijkl'), ("assign", "TOKEN = zzzzzzzzzzzz"), ("access", "AKIA" + "A" * 14), ("hex", "0f" * 8)]
    # A match that fails takes its text with it.
    assert S.base_spans("password: token = abcdefghijklmnop") == []
    values = [v for _, _, v in S.values_of("password is k8#Vq!2xQ. Authorization: Bearer abc.def-ghijk; pwd=short secretary said nothing")]
    assert values == ["k8#Vq!2xQ", "abc.def-ghijk"]


def expected(texts):
    texts = [t or "" for t in texts]
    counts = Counter(w for t in texts for w in re.findall("[a-z]{3,}", S.without(t, S.values_of(t)).lower()) if len(w) <= 24)
    total = sum(counts.values()) or 1
    words = {w: math.log2(total / n) for w, n in counts.items()}
    made = []
    for t in texts:
        base = S.base_spans(t)
        guess = [(a, 3, b) for a, b, v in S.values_of(t) if S.guess_cost(v, words)[0] >= S.THRESHOLD]
        every = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + guess))
        sha = hashlib.sha256(",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        made.append((*[sum(k == x for _, k, _ in base) for x in range(3)], len(guess), sha, every))
    return made


COLUMNS = ["n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]


def test_whole_table(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "SUMMED", 500)
    docs = documents.collect()
    extra = ["the password is abcdefgh", "password=k8#Vq!2xQz", "pwd: k8#Vq!2xQz, again", "secret: " + docs[0].text[:3].strip() * 9]
    more = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(extra)], "doc_id bigint, text string")
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in S.find_secrets(documents.select("doc_id", "text").unionByName(more)).collect()}
    want = expected([r.text for r in docs] + extra)
    assert found == dict(zip([r.doc_id for r in docs] + [10**6 + k for k in range(len(extra))], want, strict=True))
    assert sum(r[3] for r in found.values()) >= 2


def test_odd_rows(spark, odd, none):
    rows = odd.collect()
    found = Counter((r.doc_id, *[r[c] for c in COLUMNS]) for r in S.find_secrets(odd).collect())
    assert found == Counter((r.doc_id, *w) for r, w in zip(rows, expected([r.text for r in rows]), strict=True))
    assert S.find_secrets(none).count() == 0
