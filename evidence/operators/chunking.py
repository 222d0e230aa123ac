"""Sentences, tokens and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions.chunks import char_chunks, token_chunks
from evidence.functions.text import sentences, token_count


def sentence_split(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.posexplode(sentences(F.col(text))).alias("sentence_no", "sentence"))


def count_tokens(
    docs: DataFrame, text: str = "text", key: str = "doc_id",
    tokens: Callable[[Column], Column] = token_count,
) -> DataFrame:
    return docs.select(key, tokens(F.col(text)).alias("token_count"))


def chunk_by_tokens(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    size: int = K.CHUNK_TOKENS,
    overlap: int = K.CHUNK_OVERLAP_CHARS,
    tokens: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """One row per chunk. An empty text yields one empty chunk."""
    chunk = F.explode(token_chunks(F.col(text), size, overlap, tokens))
    return docs.select(key, chunk.alias("_chunk")).select(key, "_chunk.*")


def chunk_by_chars(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = K.CHUNK_CHARS
) -> DataFrame:
    """One row per chunk. An empty text yields none."""
    chunk = F.posexplode(char_chunks(F.col(text), size))
    return docs.select(key, chunk.alias("chunk_no", "chunk_text"))
