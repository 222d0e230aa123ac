"""Evidence retrieval: TF-IDF similarity of a claim to the chunks of its source.

Every claim/source pair is weighted on its own fit (the claim plus the chunks
of the source), but the work is shared: a source is counted once in a task,
however many claims cite it, and a pair only touches the terms of its claim.
The length of a chunk vector is taken from the source and corrected for the
claim's terms. What moves are texts, never their terms: rows of terms are made
and added up where the text of a source lies.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions.text import bind
from evidence.operators.chunking import chunk_by_chars
from evidence.operators.ranking import top_k
from evidence.session import by_key, materialize

PAIR = ["claim_key", "source_key"]
TERMS = "array<struct<term:string,total:bigint,df:bigint>>"
#: Pairs of one source that are compared with one copy of it, and result rows handed over at once.
COPY_PAIRS, OUT_ROWS = 4096, 8192
#: Texts grow some twenty times when they become rows of terms: they go to so many times the usual partitions.
FINER = 4


def default_stop_words() -> tuple[str, ...]:
    """Spark's English list; every function here takes another list as well."""
    return K.STOP_WORDS


def words_of(text: Column, stop_words: tuple[str, ...] | None = None) -> Column:
    """Lower-case words of two or more characters without stop words."""
    stop = default_stop_words() if stop_words is None else stop_words
    words = F.regexp_extract_all(F.lower(text), F.lit(K.WORD + "{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def terms_of(text: Column, stop_words: tuple[str, ...] | None = None) -> Column:
    """Words as in ``words_of``, then their neighbours in pairs."""
    def with_pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(
            w, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
        )

    return bind(words_of(text, stop_words), with_pairs)


def term_freq(texts: DataFrame, keys: list[str], text: str, stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """``tf`` of every term of each key. Texts of one key are brought together first, so no term is shuffled."""
    return (
        by_key(texts.select(*keys, text), *keys, times=FINER)
        .select(*keys, F.explode(terms_of(F.col(text), stop_words)).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


@dataclass(frozen=True)
class SourceIndex:
    """Chunks of all sources; terms are counted where they are used, from the chunks of a source in one task.

    ``lexicon`` has one row per source and term: total count ``c`` and chunk
    count ``df``. ``sizes`` has the number of chunks of each source.
    """

    chunks: DataFrame
    stop_words: tuple[str, ...] | None
    stored: bool

    @property
    def lexicon(self) -> DataFrame:
        tf = (
            by_key(self.chunks, "source_key", times=FINER)
            .select("source_key", "chunk_no", F.explode(terms_of(F.col("chunk_text"), self.stop_words)).alias("term"))
            .groupBy("source_key", "chunk_no", "term")
            .agg(F.count(F.lit(1)).alias("tf"))
        )
        return tf.groupBy("source_key", "term").agg(F.sum("tf").alias("c"), F.count(F.lit(1)).alias("df"))

    def sizes(self) -> DataFrame:
        return self.chunks.groupBy("source_key").agg(F.count(F.lit(1)).alias("n_chunks"))


def index_sources(
    sources: DataFrame, stop_words: tuple[str, ...] | None = None, store: bool = True
) -> SourceIndex:
    """Chunk ``sources(source_key, source_text)``; with ``store`` the chunks are written to the shared folder."""
    chunks = chunk_by_chars(sources, "source_text", "source_key")
    return SourceIndex(materialize(chunks, "chunks") if store else chunks, stop_words, store)


def _idf(n_chunks: Column, df: Column) -> Column:
    """Smoothed idf of a fit on the chunks and the claim."""
    return F.log((F.lit(2.0) + n_chunks) / (F.lit(1.0) + df)) + F.lit(1.0)


def _claim_terms(claims: DataFrame, stop_words) -> DataFrame:
    """One row per claim with a term: ``own``, its terms with their counts."""
    counted = term_freq(claims, ["claim_key"], "claim_text", stop_words)
    own = F.struct("term", F.col("tf").alias("total"), F.lit(1).cast("bigint").alias("df"))
    return counted.groupBy("claim_key").agg(F.collect_list(own).alias("own"))


def pair_terms(pairs: DataFrame, claims: DataFrame, index: SourceIndex, stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """All terms of the fit of each pair: ``total`` occurrences and ``df`` texts holding the term.

    Pairs go to the task that holds the terms of their source and stay there.
    """
    held = index.lexicon.groupBy("source_key").agg(
        F.collect_list(F.struct("term", F.col("c").alias("total"), "df")).alias("held"))
    asked = pairs.join(_claim_terms(claims, stop_words), "claim_key", "left")
    none = F.array().cast(TERMS)
    return (
        asked.join(held, "source_key", "left")
        .select(*PAIR, F.explode(F.concat(F.coalesce("own", none), F.coalesce("held", none))).alias("_t"))
        .groupBy(*PAIR, F.col("_t.term").alias("term"))
        .agg(F.sum("_t.total").alias("total"), F.sum("_t.df").alias("df"))
    )


def vocab_cap(terms: DataFrame, size: int = K.VOCABULARY_SIZE) -> DataFrame:
    """The most frequent terms of each fit; ties go to the smaller term."""
    return top_k(terms, PAIR, [F.col("total").desc(), F.col("term")], size, "term_rank")


def idf_weight(vocabulary: DataFrame, index: SourceIndex) -> DataFrame:
    return vocabulary.join(index.sizes(), "source_key").withColumn("idf", _idf(F.col("n_chunks"), F.col("df")))


def _weight(n_chunks: int, df: int) -> float:
    return math.log((2.0 + n_chunks) / (1.0 + df)) + 1.0


class _Source:
    """Counts of one source; ``score`` compares a claim with its chunks."""

    def __init__(self):
        self.n_chunks, self.counts, self.total, self.order = 0, {}, None, None

    def add(self, chunk_no: int, words: list[str]) -> None:
        self.n_chunks += 1
        found = self.counts.setdefault(chunk_no, Counter())
        found.update(words)
        found.update([f"{a} {b}" for a, b in zip(words, words[1:])])

    def _count(self) -> None:
        self.total, self.chunks_of = Counter(), {}
        for no, found in self.counts.items():
            self.total.update(found)
            for term in found:
                self.chunks_of.setdefault(term, []).append(no)
        weights = {t: _weight(self.n_chunks, len(x)) ** 2 for t, x in self.chunks_of.items()}
        self.squares = {no: {t: tf * tf * weights[t] for t, tf in found.items()} for no, found in self.counts.items()}
        self.lengths = {no: sum(x.values()) for no, x in self.squares.items()}

    def _places(self) -> None:
        """Place of each term by count, then term; sums of the squared weights of a chunk in that order."""
        self.order = sorted(self.total, key=lambda t: (-self.total[t], t))
        self.place = {t: k for k, t in enumerate(self.order, 1)}
        self.sums = {}
        for no, squares in self.squares.items():
            placed = sorted((self.place[t], w) for t, w in squares.items())
            self.sums[no] = np.array([k for k, _ in placed]), np.cumsum([0.0, *(w for _, w in placed)])

    def _cut(self, own: list[tuple[str, int]], size: int) -> tuple[list[tuple[str, int]], int | None]:
        """The claim's terms in the vocabulary and the last place of the source that is in it, None where all fit.

        The claim can only move the border by as many places as it has terms, so
        just the source's terms that close to the border are looked at.
        """
        if len(self.total) + sum(t not in self.total for t, _ in own) <= size:
            return own, None
        if self.order is None:
            self._places()
        border, mine = max(size - len(own), 0), {t for t, _ in own}
        near = [(-self.total[t], t, k) for k, t in enumerate(self.order[border:size], border + 1) if t not in mine]
        moved = [(-(self.total.get(t, 0) + q), t, 0) for t, q in own]
        before = sum(self.place.get(t, border + 1) <= border for t, _ in own)
        inside = sorted(near + moved)[: size - (border - before)]
        kept = {t for _, t, _ in inside}
        return [(t, q) for t, q in own if t in kept], max([border, *(k for _, _, k in inside)])

    def score(self, own: list[tuple[str, int]], size: int) -> list[tuple[int, float]]:
        """Chunks that share a term of the vocabulary with the claim, and their cosines."""
        if self.total is None:
            self._count()
        terms, last = self._cut(own, size)
        claim2, dots, corrected = 0.0, {}, {}
        for term, q in terms:
            held = self.chunks_of.get(term, ())
            idf = _weight(self.n_chunks, len(held) + 1)
            claim2 += (q * idf) ** 2
            counted = last is None or not held or self.place[term] <= last
            for no in held:
                tf = self.counts[no][term]
                dots[no] = dots.get(no, 0.0) + tf * idf * q * idf
                corrected[no] = corrected.get(no, 0.0) + (tf * idf) ** 2 - (self.squares[no][term] if counted else 0.0)
        found = []
        for no, dot in dots.items():
            length2 = self.lengths[no]
            if last is not None:
                places, sums = self.sums[no]
                length2 = float(sums[np.searchsorted(places, last, side="right")])
            found.append((no, dot / (math.sqrt(claim2) * math.sqrt(length2 + corrected[no]))))
        return found


def _scoring(schema: pa.Schema, size: int):
    """Rows of a (source, part) in order, its chunks before the pairs, to the scores of each pair."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, source, made = None, _Source(), ([], [], [], [])

        def handed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, schema, strict=True)], schema=schema)
            for x in made:
                x.clear()
            return batch

        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                rows = batch.slice(begin, 1024).to_pydict()
                for key, part, no, words, claim, terms, counts in zip(*[rows[c] for c in ("source_key", "part", "chunk_no", "words", "claim_key", "terms", "counts")], strict=True):
                    if (key, part) != at:
                        at, source = (key, part), _Source()
                    if no is not None:
                        source.add(no, words)
                        continue
                    for found, score in source.score(list(zip(terms, counts, strict=True)), size):
                        for x, v in zip(made, (claim, key, found, score), strict=True):
                            x.append(v)
                    if len(made[0]) >= OUT_ROWS:
                        yield handed()
        if made[0]:
            yield handed()

    return scored


def similarity(
    pairs: DataFrame, claims: DataFrame, index: SourceIndex,
    stop_words: tuple[str, ...] | None = None, vocabulary: int = K.VOCABULARY_SIZE,
) -> DataFrame:
    """Cosine of every claim/chunk pair that shares a term: ``claim_key, source_key, chunk_no, score``.

    Chunks and pairs of a source meet in one task; a source with more than
    ``COPY_PAIRS`` pairs is copied for each such part of them.
    """
    asked = (
        pairs.where("source_key IS NOT NULL").join(_claim_terms(claims, stop_words), "claim_key")
        .groupBy(*PAIR).agg(F.flatten(F.collect_list("own")).alias("own"))
    )
    if index.stored:
        asked = materialize(asked, "asked")
    parts = asked.groupBy("source_key").agg(F.ceil(F.count(F.lit(1)) / COPY_PAIRS).cast("int").alias("parts"))
    claim, number = asked.schema["claim_key"].dataType, index.chunks.schema["chunk_no"].dataType
    strings = "array<string>"
    texts = index.chunks.join(parts, "source_key").select(
        "source_key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "chunk_no", "chunk_text",
        F.lit(None).cast(claim).alias("claim_key"), F.lit(None).cast(strings).alias("terms"), F.lit(None).cast("array<bigint>").alias("counts"))
    wanted = asked.join(parts, "source_key").select(
        "source_key", F.pmod(F.xxhash64("claim_key"), F.col("parts")).cast("int").alias("part"),
        F.lit(None).cast(number).alias("chunk_no"), F.lit(None).cast("string").alias("chunk_text"),
        "claim_key", F.col("own.term").alias("terms"), F.col("own.total").alias("counts"))
    rows = by_key(texts.unionByName(wanted), "source_key", "part").sortWithinPartitions("source_key", "part", F.col("claim_key").isNotNull())
    words = F.when(F.col("chunk_no").isNotNull(), words_of(F.col("chunk_text"), index.stop_words)).alias("words")
    kind = f"claim_key {claim.simpleString()}, source_key {asked.schema['source_key'].dataType.simpleString()}, chunk_no {number.simpleString()}, score double"
    shape = pairs.sparkSession.createDataFrame([], kind).toArrow().schema
    return rows.select("source_key", "part", "chunk_no", words, "claim_key", "terms", "counts").mapInArrow(_scoring(shape, vocabulary), kind)


def cosine_topk(
    pairs: DataFrame, claims: DataFrame, index: SourceIndex,
    stop_words: tuple[str, ...] | None = None, k: int = K.EVIDENCE_TOP_K,
    threshold: float = K.MIN_SIMILARITY, vocabulary: int = K.VOCABULARY_SIZE,
) -> DataFrame:
    """The best ``k`` chunks per pair at or above the threshold; equal scores keep chunk order."""
    close = similarity(pairs, claims, index, stop_words, vocabulary).where(F.col("score") >= threshold)
    return top_k(close, PAIR, [F.round("score", 9).desc(), F.col("chunk_no")], k)


def retrieval_fallback(
    pairs: DataFrame, claims: DataFrame, index: SourceIndex,
    stop_words: tuple[str, ...] | None = None, k: int = K.EVIDENCE_TOP_K,
) -> DataFrame:
    """Pairs without a single term in claim or source: the first chunks at a fixed score."""
    wordless_claims = claims.where(F.size(terms_of(F.col("claim_text"), stop_words)) == 0).select("claim_key")
    with_terms = index.chunks.where(F.size(words_of(F.col("chunk_text"), index.stop_words)) > 0).select("source_key").distinct()
    return (
        pairs.join(wordless_claims, "claim_key", "left_semi")
        .join(with_terms, "source_key", "left_anti")
        .join(index.chunks.where(F.col("chunk_no") < k), "source_key")
        .select(
            *PAIR, "chunk_no", F.lit(K.FALLBACK_SCORE).alias("score"), (F.col("chunk_no") + 1).alias("rank")
        )
    )


def retrieve(
    pairs: DataFrame, claims: DataFrame, index: SourceIndex,
    stop_words: tuple[str, ...] | None = None, **options,
) -> DataFrame:
    """Evidence rows with their chunk text, including the fallback."""
    found = cosine_topk(pairs, claims, index, stop_words, **options)
    spare = retrieval_fallback(pairs, claims, index, stop_words)
    return found.unionByName(spare).join(index.chunks, ["source_key", "chunk_no"]).select(
        *PAIR, "rank", "chunk_no", "score", "chunk_text"
    )


def evidence_prompt(evidence: DataFrame) -> DataFrame:
    """Per pair, its (at most ``k``) chunks numbered and joined by blank lines."""
    shown = F.format_string("[Chunk %d, similarity=%.2f]:\n%s", F.col("rank"), F.col("score"), F.col("chunk_text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank"), shown.alias("s"))))
    return evidence.groupBy(*PAIR).agg(
        F.array_join(F.transform(ordered, lambda x: x["s"]), "\n\n").alias("excerpts"),
        F.max("score").alias("best_score"),
        F.min_by("chunk_text", "rank").alias("best_chunk"),
        F.count(F.lit(1)).alias("n_chunks_found"),
    )


def retrieval_outcome(pairs: DataFrame, index: SourceIndex, evidence: DataFrame) -> DataFrame:
    """evidence, nothing relevant, or an empty source, with the fixed messages."""
    has_chunks = index.chunks.where(F.col("chunk_no") == 0).select("source_key", F.lit(True).alias("has_chunks"))
    return (
        pairs.join(has_chunks, "source_key", "left")
        .join(evidence_prompt(evidence), PAIR, "left")
        .withColumn(
            "outcome",
            F.when(F.col("has_chunks").isNull(), F.lit("empty_source"))
            .when(F.col("best_score").isNull(), F.lit("nothing_relevant"))
            .otherwise(F.lit("evidence")),
        )
        .withColumn(
            "explanation",
            F.when(F.col("outcome") == "empty_source", F.lit("Source text is empty or could not be chunked")).when(
                F.col("outcome") == "nothing_relevant", F.lit("No relevant chunks found in source")
            ),
        )
        .withColumn(
            "error",
            F.when(F.col("outcome") == "empty_source", F.lit("No content to validate against")).when(
                F.col("outcome") == "nothing_relevant", F.lit("Low similarity scores")
            ),
        )
        .drop("has_chunks")
    )
