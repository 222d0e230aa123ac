"""Encoding against the library, on whole texts and across chunks; decoding as a round trip."""

import random

import public_tokenizers
import pytest
import sentencepiece

from evidence.llm import pieces as P

MODEL = P.read_model(public_tokenizers.path("piece_bpe_32k.model"))
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def random_texts(n, size, seed):
    pick = random.Random(seed)
    parts = ["the", "ing", "a", "aa", " ", "  ", "\n", "été", "ß", "日本語", "12", ".", "!!", "http://", "\U0001f600", "tion", "er", "▁", "<s>", "x" * 9]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, size))) for _ in range(n)]


def test_whole_texts_as_the_library():
    own = P.Pieces(MODEL)
    for text in random_texts(500, 60, 1) + ["", " ", "a" * 400, " " * 99, "ab" * 300]:
        assert own.encode(text) == LIBRARY.encode(text)
        assert own.decode(own.encode(text)) == text.replace("▁", " ")


def test_product_is_associative_and_keeps_the_best_path():
    own = P.Pieces(MODEL)
    text = P.SPACE + "internationalisation" * 20
    cut = [own.matrix(text[max(0, a - 16) : a], text[a : a + 64], text[a + 64 : a + 80]) for a in range(0, len(text), 64)]
    left = P.times(P.times(cut[0], cut[1]), cut[2])
    right = P.times(cut[0], P.times(cut[1], cut[2]))
    assert left == right
    total = cut[0]
    for c in cut[1:]:
        total = P.times(total, c)
    assert max(total[2]) == own.word(text)[1]


def test_certain_words_of_a_chunk_are_not_searched():
    own = P.Pieces(MODEL)
    text = P._signed(" ".join(f"wörd{i}" for i in range(2000)))[0]
    before, body, after = text[:16], text[16:-16], text[-16:]
    n_in, n_out, weights = own.matrix(before, body, after)
    assert len(own.words) < 20 and not own.trie  # all 2,000 words were solved for weights that are the same on every path
    entry, leave = divmod(weights.index(max(weights)), n_out)
    ids, begin, end = own.backtrace(before, body, after, entry, leave)
    assert own.spell(ids) == text[begin:end].replace(P.SPACE, " ")


def test_ids_of_words_are_kept_packed():
    own = P.Pieces(MODEL)
    texts = random_texts(200, 60, 3)
    assert list(map(own.decode, own.encode_all(texts))) == [t.replace("▁", " ") for t in texts]
    assert all(type(x) is bytes for x in own.packed.values()) and len(own.words) < len(own.packed)


def test_chunked_documents_as_the_library(spark):
    texts = random_texts(40, 400, 2) + ["", None, "a" * 3000, " " * 500, "é" * 700, "internationalisation" * 300, "ab" * 32, "a b" * 1000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id bigint, text string")
    for size in (32, 37, 64, 1000):
        found = P.encode(docs, MODEL, chunk_chars=size).collect()
        assert len(found) == len(texts) + 1
        for r in found:
            assert r.ids == LIBRARY.encode(texts[r.doc_id] or ""), (size, r.doc_id)
        assert max(r.n_chunks for r in found) > 5


def test_deep_tree(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN", 3)
    docs = spark.createDataFrame([(1, "abcde" * 400)], "doc_id bigint, text string")
    assert P.encode(docs, MODEL, chunk_chars=32).first().ids == LIBRARY.encode("abcde" * 400)


def test_odd_rows(odd, none):
    found = P.round_trip(odd, MODEL).collect()
    texts = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    assert len(found) == odd.count()
    for r in found:
        if r.doc_id is not None:
            assert r.ids == LIBRARY.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
            assert r.same == ("▁" not in (texts[r.doc_id] or ""))
    assert P.round_trip(none, MODEL).count() == 0


def test_decode_replaces_the_column(spark):
    tokens = spark.createDataFrame([(1, [1, 259, 3], "x"), (2, [], "y"), (3, None, "z")], "doc_id bigint, ids array<int>, text string")
    found = {r.doc_id: r.text for r in P.decode(tokens, MODEL).collect()}
    assert found == {1: " \x00", 2: "", 3: ""}


def test_small_chunks_are_refused(odd):
    with pytest.raises(ValueError):
        P.encode(odd, MODEL, chunk_chars=8)
