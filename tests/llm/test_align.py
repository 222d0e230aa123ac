"""Alignment against sets of ends, and corpus counts against a plain program."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from evidence.llm import align as A

DEFINITION = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


@pytest.fixture(scope="module")
def aligner():
    return A.Aligner(DEFINITION, MODEL)


def test_stretch_and_segments():
    pick = random.Random(1)
    for _ in range(400):
        total = pick.randint(1, 60)
        a = sorted({*pick.sample(range(1, total + 1), pick.randint(0, total)), total})
        b = sorted({*pick.sample(range(1, total + 1), pick.randint(0, total)), total}) if pick.random() < 0.7 else list(a)
        ends = []
        for i, p, j, q, one in A.segments(a, b):
            assert a[p - 1] == b[q - 1] and (not one or a[i:p] == b[j:q])
            ends += a[i:p] if one else [a[p - 1]]
        assert ends == sorted(set(a) & set(b))


def groups(aligner, text):
    """Groups of one text by sets of ends."""
    said = (" " + (text or "")).encode()
    if not text:
        return [], [], []
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text)
    if b"".join(aligner.a_bytes[i] for i in a) != said or b"".join(aligner.b_bytes[i] for i in b) != said:
        return [], [], []

    def ends(ids, spelled):
        at, found = 0, []
        for i in ids:
            at += len(spelled[i])
            found.append(at)
        return found

    x, y = ends(a, aligner.a_bytes), ends(b, aligner.b_bytes)
    common = sorted(set(x) & set(y))
    made, low = [], 0
    for high in common:
        made.append(([i for i, e in zip(a, x, strict=True) if low < e <= high], [i for i, e in zip(b, y, strict=True) if low < e <= high]))
        low = high
    return a, b, made


def expected(aligner, docs):
    found = [groups(aligner, t) for _, t in docs]
    links = [Counter((x, y) for g in made for x in g[0] for y in g[1]) for _, _, made in found]
    count = Counter(p for c in links for p in c)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for (doc_id, _), (a, b, made), c in zip(docs, found, links, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in made)
        rows.append((
            doc_id, len(a), len(b), len(made), sum(c.values()), sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()),
            hashlib.sha256(said.encode()).hexdigest() if a else "",
        ))
    return Counter(rows)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [0, 50, A.HOT])
def test_counts_over_all_documents(spark, aligner, hot, monkeypatch):
    monkeypatch.setattr(A, "SUMMED", 100)
    monkeypatch.setattr(A, "LISTED", 300)
    pick = random.Random(2)
    parts = ["the", "ing", " ", "  ", "\n", "été", "日本語", "12", ".", "!!", "http://", "\U0001f600", "tion", "<|endoftext|>", "<s>", "x" * 90, "İ", "\x00"]
    docs = [(k, "".join(pick.choice(parts) for _ in range(pick.randint(0, 60)))) for k in range(60)] + [(1, "a ▁ b"), (2, None), (None, "twice"), (None, "twice"), (3, "日本語" * 200 + "x")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id bigint, text string, pairs string").repartition(3)
    found = Counter(tuple(r[c] for c in COLUMNS) for r in A.link_tokens(df, DEFINITION, MODEL, hot=hot).collect())
    assert found == expected(aligner, docs)


def test_odd_rows(odd, none, aligner):
    docs = [(r.doc_id, r.text if len(r.text or "") < 5000 else None) for r in odd.collect()]
    found = A.link_tokens(odd, DEFINITION, MODEL).collect()
    assert len(found) == len(docs) and {r.n_a > 0 for r in found if r.doc_id in (6, 7, 8)} == {True}
    assert A.link_tokens(none, DEFINITION, MODEL).count() == 0
