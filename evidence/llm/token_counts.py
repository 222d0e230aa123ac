"""Token counts behind a cache of digests.

The cache is a table of (content digest, tokenizer digest, count). Documents
are reduced to digests first; only contents that the cache does not hold are
encoded, each of them once, and appended. All counts then come from the cache.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import squeezed, texts_of
from evidence.session import materialize

CACHE = "content binary, tokenizer string, n_tokens bigint"
LIMIT = 2048
#: Characters encoded at a time, and words whose counts a task keeps.
BLOCK_CHARS = 1 << 22
KEPT_WORDS = 1 << 20
#: Digests of repeated contents that are broadcast (32 bytes each) to spare other texts the shuffle.
KNOWN_COPIES = 1 << 19


def tokenizer_digest(definition: str, by_words: bool) -> str:
    """What a count depends on besides the text: definition, library version, way of counting."""
    said = f"{definition}\n{tokenizers.__version__}\n{by_words}"
    return hashlib.sha256(said.encode()).hexdigest()


def _content(text: Column, by_words: bool) -> Column:
    """The text as it is counted: white space squeezed where it only separates words."""
    return squeezed(text) if by_words else F.coalesce(text, F.lit(""))


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counting(definition: str, by_words: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = tokenizers.Tokenizer.from_str(definition)
        sizes: dict[str, int] = {}

        def of(texts: list[str]) -> list[int]:
            return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        for batch in batches:
            found: list[int] = []
            for block in _blocks(texts_of(batch, "_text")):
                if not by_words:
                    found += of(block)
                    continue
                words = [t.split(" ") for t in block]
                if len(sizes) > KEPT_WORDS:
                    sizes.clear()
                new = [w for w in {w for ws in words for w in ws} if w not in sizes]
                sizes.update(zip(new, of(new), strict=True))
                found += [sum(map(sizes.__getitem__, ws)) for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(found, pa.int64())], ["content", "n_tokens"])

    return count


def _encode_misses(rows: DataFrame, keys: DataFrame, cached: DataFrame, definition: str, by_words: bool) -> DataFrame | None:
    """``content`` and ``n_tokens`` of the contents of ``keys`` that ``cached`` lacks; None if there are none.

    Which rows to encode is told by the smaller list, of hits or of misses. Up
    to ``KNOWN_COPIES`` repeated misses are listed too: only their texts move,
    combined on their whole text, and all others are encoded where they were
    read. With more repeats than a broadcast should hold, all misses are
    combined so, in one shuffle of their texts.
    """
    counted = keys.groupBy("content").agg(F.count(F.lit(1)).alias("_n"))
    hits = counted.join(cached.select("content", F.lit(True).alias("_hit")), "content", "left")
    hits = materialize(hits, "contents")
    known = hits.where("_hit").select("content")
    missing = hits.where("_hit IS NULL")
    n_known, n_missing = hits.agg(F.count_if("_hit"), F.count_if(F.col("_hit").isNull())).first()
    if not n_missing:
        return None
    if n_known:
        by_hits = n_known <= n_missing
        list_ = materialize((known if by_hits else missing).select("content"), "asked")
        rows = rows.join(list_, "content", "left_anti" if by_hits else "left_semi")
    repeated = materialize(missing.where("_n > 1").select("content"), "repeated")
    if repeated.count() <= KNOWN_COPIES:
        listed = F.broadcast(repeated)
        lone = rows.join(listed, "content", "left_anti")
        once = lone.unionByName(rows.join(listed, "content", "left_semi").distinct())
    else:
        once = rows.distinct()
    counting = _counting(definition, by_words)
    return once.mapInArrow(counting, "content binary, n_tokens bigint")


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, doc_id: str = "doc_id", text: str = "text",
    limit: int = LIMIT, by_words: bool = True,
) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``tokenizer`` is the path of a tokenizer definition on the driver;
    ``cache`` a folder that all executors share, made where it is missing and
    appended to. ``by_words`` is for tokenizers that drop white space: texts
    are then told apart with white space squeezed, and the count of a text is
    the sum over its words, each of which the library encodes once in a task.
    No begin, end or added special tokens are counted; special strings inside
    texts are what the library makes of them. Null is the empty text, of 0
    tokens. Repeated rows keep a row each; other columns are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    digest = tokenizer_digest(definition, by_words)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_raw"))
    rows = rows.withColumn("_text", _content(F.col("_raw"), by_words)).withColumn("content", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    n_bytes = F.octet_length(F.coalesce("_raw", F.lit(""))).cast("bigint")
    keys = materialize(rows.select("doc_id", n_bytes.alias("n_bytes"), "content"), "keys")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        found = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == digest)
        return found.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    new = _encode_misses(rows.select("content", "_text"), keys, stored(), definition, by_words)
    if new is not None:
        new.select("content", F.lit(digest).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return keys.join(stored(), "content", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
