import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from evidence.llm import token_counts as T
from evidence.session import scratch_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(text):
    return len(tokenizers.Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_counts_of_the_library(spark, documents, odd, none):
    cache = scratch_dir(spark, "cache")
    both = documents.select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    texts = {r.doc_id: r.text for r in both.collect()}
    found = T.count_tokens(both, PATH, cache).collect()
    assert len(found) == both.count()
    for r in found:
        if r.doc_id is not None:
            want = plain(texts[r.doc_id])
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((texts[r.doc_id] or "").encode()), want > 2048)
    assert T.count_tokens(none, PATH, cache).count() == 0


def test_more_copies_than_are_listed(spark, odd, monkeypatch):
    few = T.count_tokens(odd, PATH, scratch_dir(spark, "cache")).collect()
    monkeypatch.setattr(T, "KNOWN_COPIES", 0)
    cache = scratch_dir(spark, "cache")
    assert sorted(map(str, T.count_tokens(odd, PATH, cache).collect())) == sorted(map(str, few))
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count()


def test_only_misses_are_encoded_and_appended(spark, odd, monkeypatch):
    cache = scratch_dir(spark, "cache")
    first = T.count_tokens(odd, PATH, cache)
    n = spark.read.parquet(cache).count()
    assert n == odd.select(T.squeezed(F.col("text"))).distinct().count()
    again = T.count_tokens(odd, PATH, cache)
    assert spark.read.parquet(cache).count() == n and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    for extra in (1, 40):  # few misses among many hits, then few hits among many misses
        more = odd.select("doc_id", "text").unionByName(spark.range(extra).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"new {extra} "), F.col("id")).alias("text")))
        T.count_tokens(more, PATH, cache)
        n += extra
        assert spark.read.parquet(cache).count() == n
    T.count_tokens(odd, PATH, cache, by_words=False)  # another digest, so nothing is shared
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_whole_texts_where_white_space_counts(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in T.count_tokens(documents, path, scratch_dir(spark, "cache"), by_words=False).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
