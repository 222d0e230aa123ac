"""Quotient filters, exact groups and fingerprint components against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash

from evidence.llm import exact_dedup as E
from evidence.llm import simhash as S


def rows_of(df):
    return sorted(map(str, df.collect()))


# ---- exact ----

@pytest.mark.parametrize("n", [1, 2, 100, 5000])
def test_filters_lose_nothing(n):
    rng = np.random.default_rng(n)
    shard = 5
    prints = np.unique((rng.integers(0, 1 << 54, n).astype(np.uint64)) | np.uint64(shard << 54))
    counts = rng.integers(1, 600, len(prints))
    back = E.unpack(E.pack(prints, counts, 10), shard)
    assert np.array_equal(back[0], prints) and np.array_equal(back[1], counts)
    parts = [E.unpack(E.pack(p, np.ones(len(p), np.int64), 10), shard) for p in (prints[::2], prints[::3], prints)]
    merged = dict(zip(*(x.tolist() for x in E.merge(parts)), strict=True))
    assert merged == {int(p): 1 + (k % 2 == 0) + (k % 3 == 0) for k, p in enumerate(prints)}


def test_groups_by_hand(spark, odd):
    found = E.exact_duplicates(odd, shard_bits=3, filter_rows=2).collect()
    texts = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in odd.collect()]
    assert len(found) == len(texts)
    want = []
    for i, t in texts:
        ids = [j for j, u in texts if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        want.append(str((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())))
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in found) == sorted(want)


def test_one_row_stays(odd, none):
    kept = E.drop_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in odd.collect()})
    assert {r._fp for r in kept.collect()} == {"a"}
    assert E.drop_duplicates(none).count() == 0 and E.exact_duplicates(none).count() == 0


def test_rows_stay_where_they_are_beside_few_groups(spark, monkeypatch):
    once = [(k, f"text {k % 40}") for k in range(60)]
    docs = spark.createDataFrame(once + once[:5], "doc_id bigint, text string")
    monkeypatch.setattr(E, "BROADCAST_GROUPS", 0)
    many = rows_of(E.drop_duplicates(docs))
    monkeypatch.undo()
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = E.drop_duplicates(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert rows_of(kept) == many and len(many) == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)


def test_copies_over_many_partitions(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE concat('text ', id % 700) END AS text").repartition(17)
    found = E.exact_duplicates(df)
    assert found.where("text = 'x' OR group_size = 1000" if "text" in found.columns else "group_size = 1000").count() == 1000
    assert E.drop_duplicates(df).count() == found.where("kept").count()


# ---- near ----

def plain_simhash(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints, bits):
    prints, root = list(prints), {}
    for p in prints:
        root[p] = p

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(prints):
        for b in prints[:k]:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


def test_fingerprints_as_written(documents, monkeypatch):
    texts = [r.text for r in documents.limit(60).collect()] + ["", " ", "One", "ONE two", "İ É ß A", "a" * 100, "x y z " * 40]
    assert [S.simhash(t or "") for t in texts] == [plain_simhash(t) for t in texts]
    monkeypatch.setattr(S, "BLOCK", 7)
    assert [S.simhash(t or "") for t in texts] == [plain_simhash(t) for t in texts]
    assert S.simhash("a b c d e f", 5) == plain_simhash("a b c d e f", 5)


def close_prints(n, seed):
    pick = random.Random(seed)
    prints = {0, (1 << 64) - 1}
    while len(prints) < n:
        p = pick.choice(list(prints)) if pick.random() < 0.5 else pick.getrandbits(64)
        prints.add(p ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 4))))
    return sorted(prints)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_of_the_tree(bits, monkeypatch):
    monkeypatch.setattr(S, "LEAF", 8)
    prints = close_prints(500, bits)
    a = np.array(prints, np.uint64)
    want = {(i, j) for i in range(500) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits}
    got = {(max(x, y), min(x, y)) for i, j in S.links(a, bits) for x, y in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == want
    roots = components_of(prints, bits)
    assert [prints[r] for r in S.local_roots(a, bits)] == [roots[p] for p in prints]


def test_sharded_components(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAF", 8)
    prints = close_prints(600, 9)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(k, p) for k, p in enumerate(signed)] + [(1000 + k, p) for k, p in enumerate(signed[:50])], "doc_id bigint, _fp bigint")
    for shard_rows in (20, 10_000):
        found = {r._fp: r.component_id for r in S.classes_of(df, shard_rows=shard_rows, sample=200).collect()}
        roots = components_of(prints, 2)
        least = {}
        for k, p in enumerate(prints):
            least[roots[p]] = min(least.get(roots[p], k), k)
        assert found == {s: least[roots[p]] for s, p in zip(signed, prints, strict=True)}


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_full_shards_are_parted(spark, monkeypatch, bits):
    """Many fingerprints a few bits around one, which no tree parts: components as by all pairs, and no task gets them all."""
    whole = S.local_roots

    def bounded(prints, *rest):
        assert len(prints) <= 80
        return whole(prints, *rest)

    monkeypatch.setattr(S, "local_roots", bounded)
    pick, near = random.Random(bits), set()
    while len(near) < 700:
        near.add(sum(1 << b for b in pick.sample(range(64), pick.randint(2, 6))))
    prints = sorted(near | set(close_prints(200, 5)))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id bigint, _fp bigint")
    found = {r._fp: r.component_id for r in S.classes_of(df, max_bits=bits, shard_rows=20, max_levels=3).collect()}
    roots, least = components_of(prints, bits), {}
    for k, p in enumerate(prints):
        least.setdefault(roots[p], k)
    assert found == {s: least[roots[p]] for s, p in zip(signed, prints, strict=True)}


def test_pairs_are_not_listed(monkeypatch):
    def blocks(prints, *_):
        for k in range(100):
            yield np.full(100_000, k), np.full(100_000, k + 1)

    monkeypatch.setattr(S, "links", blocks)
    tracemalloc.start()
    assert S.local_roots(np.arange(101, dtype=np.uint64), 2).max() == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # all blocks are 160 MB


def test_long_chains_and_stars(spark):
    pick = random.Random(7)
    chain = list(range(200))
    edges = [(b, a) for a, b in zip(chain, chain[1:], strict=False)] + [(500 + k, 499) for k in range(300)] + [(2000, 2001), (2001, 2002), (2002, 2000), (2000, 2001)]
    pick.shuffle(edges)
    found = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{k: 0 for k in chain}, **{k: 499 for k in range(499, 800)}, 2000: 2000, 2001: 2000, 2002: 2000}
    assert S.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_by_hand(documents, odd, none):
    for rows in (documents, odd.select("doc_id", "text")):
        texts = [(r.doc_id, r.text) for r in rows.collect()]
        print_of = [plain_simhash(t) if len(t or "") < 50_000 else S.simhash(t) for _, t in texts]
        roots = components_of(sorted(set(print_of)), 2)
        least = {}
        for (i, _), p in zip(texts, print_of, strict=True):
            if i is not None:
                least[roots[p]] = min(least.get(roots[p], i), i)
        want = sorted(str((i, f"{p:016x}", least.get(roots[p]))) for (i, _), p in zip(texts, print_of, strict=True))
        assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in S.near_duplicates(rows).collect()) == want
    kept = S.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 3, None}
    assert S.near_duplicates(none).count() == 0 and S.drop_near_duplicates(none).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_sketches_whatever_the_block(documents, monkeypatch):
    texts = [r.text for r in documents.limit(40).collect()] + ["", "one", "a b c d", "a b c d e", "x y z " * 40]
    whole = [S.sketch(t or "", {}) for t in texts]
    monkeypatch.setattr(S, "BLOCK", 7)
    monkeypatch.setattr(S, "KEPT_WORDS", 3)
    assert [S.sketch(t or "", {}) for t in texts] == whole


def test_similar_documents(spark):
    """Nearly all pairs with 0.8 of their shingles in common end in one component, and no text joins one it has little in common with."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0 OR doc_id < 3000").select("doc_id", "text")
    texts = {r.doc_id: shingles(r.text) for r in docs.collect()}
    component = {r.doc_id: r.component_id for r in S.similar_documents(docs, shard_rows=500).collect()}
    assert component.keys() == texts.keys()
    by_shingle: dict = {}
    for i, s in texts.items():
        for x in sorted(s)[:12]:
            by_shingle.setdefault(x, []).append(i)
    pairs = {(a, b) for v in by_shingle.values() if len(v) < 100 for a in v for b in v if a < b}
    alike = [(a, b) for a, b in pairs if len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])]
    assert len(alike) > 50 and sum(component[a] == component[b] for a, b in alike) >= 0.95 * len(alike)
    groups: dict = {}
    for i, c in component.items():
        groups.setdefault(c, []).append(i)
    for c, members in groups.items():
        assert c == min(members)
        for i in members[:20]:
            others = [texts[j] for j in members if j != i]
            assert len(members) == 1 or not texts[i] or max(len(texts[i] & o) / len(texts[i] | o) for o in others) >= 0.45  # told by an estimate


def jaccard_roots(texts):
    """The smallest place of each text's component, by all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(k), find(j)))
                root[y] = x
    return [find(k) for k in range(len(texts))]


def appended_and_edited(seed):
    """Texts of distinct words and such that repeat words: one text appended to another, and scattered edits, about 0.8."""
    pick, texts = random.Random(seed), []
    for k in range(60):
        word = (lambda k=k: f"w{k}x{pick.getrandbits(40)}") if k % 2 else (lambda: f"w{int(pick.paretovariate(0.9)) % 5000}")
        base = [word() for _ in range(pick.choice([3, 8, 30, 100, 200]))]
        more = base + [word() for _ in range(round(len(base) * pick.uniform(0.18, 0.30)))]
        edited = list(base)
        for at in pick.sample(range(len(base)), max(1, round(len(base) * pick.uniform(0.015, 0.03)))):
            edited[at] = word()
        texts += [" ".join(base), " ".join(more), " ".join(edited)]
    return texts


@pytest.mark.parametrize("options", [{}, {"free_pairs": 0, "shard_rows": 3, "sample": 20}])
def test_similar_is_exact(spark, options):
    pick, texts = random.Random(3), appended_and_edited(1)
    passage, hot = " ".join(f"p{k}" for k in range(60)), [f"h{k}" for k in range(90)]
    texts += [f"{passage} {' '.join(f'u{pick.getrandbits(30)}' for _ in range(pick.randint(8, 30)))}" for _ in range(60)]
    for _ in range(120):
        copy = list(hot)
        for at in pick.sample(range(90), pick.randint(0, 3)):
            copy[at] = f"e{pick.getrandbits(30)}"
        texts.append(" ".join(copy))
    found = S.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5), **options)
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(jaccard_roots(texts)))


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 150, 2000):
        a = rng.integers(0, 1 << 64, size, np.uint64, endpoint=False)
        for lost in (0, size // 9, size):
            b = np.concatenate([a[lost:], rng.integers(0, 1 << 64, lost // 2, np.uint64)])
            differing = int(np.bitwise_count((S._parity(a) ^ S._parity(b)).view(np.uint64)).sum())
            assert differing <= lost + lost // 2
            assert (differing == 0) or lost


def test_similar_odd_rows(odd, none):
    kept = S.drop_similar(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 3, None} and 7 not in {r.doc_id for r in kept.collect()}
    assert S.drop_similar(none).count() == 0
