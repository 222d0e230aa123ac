"""Spans against the patterns as written, disclosures against a count by hand."""

import hashlib
import math
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from evidence.llm import sanitise as S
from evidence.llm.queries import op6_personal_data


def plain(text):
    """The patterns exactly as given, leftmost and non-overlapping."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = [2 * x - 9 * (x > 4) for x in d[-2::-2]]
        if 12 <= len(d) <= 19 and (sum(odd) + sum(d[-1::-2])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="ab@._-+ 0123456789().\nÉ", max_size=60))
def test_patterns_as_written(text):
    assert S.base_spans(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["x@y.zz", "a.b@c@d.e", "10.0.0.1", "0256.1.1.1.1", "4111 1111 1111 1111", "+49 (0) 30-123.456", "é", " ", "@", ".", "-", "9"]), max_size=12))
def test_patterns_in_pieces(parts):
    assert S.base_spans("".join(parts)) == plain("".join(parts))


def test_long_runs_are_fast():
    for text in ("a" * 200_000, "1" * 200_000, "1 " * 100_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000):
        S.base_spans(text)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = op6_personal_data(spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        base = plain(texts[r.doc_id])
        said = [f"{S.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == said


def by_hand(texts, support, threshold):
    """Disclosing (document, begin, end) by counting contexts one after the other."""
    n, n_e, n_t, n_et, wordings, places = 0, defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set), []
    for i, text in texts:
        spans = plain(text)
        for a, b in S.contexts(text):
            n += 1
            inside = {S.entity(text, s) for s in spans if a <= s[0] < b}
            words = [m for m in S.WORD.finditer(text, a, b)]
            for t in {m[0].lower() for m in words}:
                n_t[t] += 1
            free = [m for m in words if not any(s < m.end() and m.start() < e for s, _, e in spans)]
            for e in inside:
                n_e[e] += 1
                for t in {m[0].lower() for m in free}:
                    n_et[e, t] += 1
                    wordings[e, t].add(text[a:b])
                places += [(e, m[0].lower(), i, m.start(), m.end()) for m in free]
    found = set()
    for e, t, i, a, b in places:
        if len(wordings[e, t]) >= support and n_e[e] < n:
            if math.log2(n_et[e, t] * n / (n_e[e] * n_t[t])) / math.log2(n / n_e[e]) >= threshold:
                found.add((i, a, b))
    return found


def corpus():
    texts = [(i, f"The Quokka team, at {k} desk\ncall zeb@mail.org for the Quokka number {i} today") for i, k in enumerate("abcdefgh")]
    texts += [(20 + i, "the quick team of the day and the number for today\nthe desk") for i in range(30)]
    return texts + [(90, "for the zeb@mail.org and for lone@x.io only Wallaby"), (91, "only Wallaby lone@x.io"), (92, None), (93, "")]


def test_disclosures_by_hand(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    for support, threshold in ((2, 0.5), (3, 0.6), (1, 0.9)):
        found = {(r.doc_id, *map(int, s.split(":")[1:])) for r in S.find_personal_data(df, support=support, threshold=threshold).collect() for s in r.spans.split(",") if s.startswith("term")}
        assert found == by_hand([(i, t or "") for i, t in corpus()], support, threshold)
        assert found


def test_every_term_counted_when_there_are_many(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    few = sorted(map(str, S.find_personal_data(df).collect()))
    monkeypatch.setattr(S, "KNOWN_TERMS", 1)
    assert sorted(map(str, S.find_personal_data(df).collect())) == few


def test_sanitised_texts(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in corpus()], "doc_id bigint, text string, _row string, _spans string")
    out = S.sanitise(df)
    assert out.columns == df.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text.split("\n")[1].startswith("[WORD] [EMAIL] for the ") or "[EMAIL]" in rows[0].text
    assert "zeb" not in "".join(r.text or "" for r in rows.values()) and "Quokka number" not in rows[0].text
    assert rows[92].text is None and rows[93].text == "" and rows[20]._row == "x"


def test_contexts_cover_every_word():
    text = "a b\n\n" + " ".join(f"w{i}" for i in range(100)) + "\n x \n"
    words = [w for a, b in S.contexts(text) for w in text[a:b].split()]
    assert words == text.split() and S.n_contexts(text) == len(list(S.contexts(text))) == 1 + 4 + 1


def test_odd_rows(odd, none):
    assert S.find_personal_data(odd).count() == odd.count() and S.find_personal_data(none).count() == 0
    assert S.sanitise(odd).columns == odd.columns and S.sanitise(none).count() == 0
    assert sorted(str(r.doc_id) for r in S.sanitise(odd).collect()) == sorted(str(r.doc_id) for r in odd.collect())
