"""Routing of claims, fact-check lookup and the decisions on uncited claims."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions.ratings import rating_confidence, rating_passes
from evidence.functions.text import not_empty, squeeze
from evidence.operators.hook import score
from evidence.operators.setjoin import most_similar_sets, set_key, word_set
from evidence.session import materialize


def is_cited() -> Column:
    return F.coalesce(F.col("citation_id") != "", F.lit(False))


def result_class() -> Column:
    """One of the four classes; null for a claim type that is neither of the two known ones."""
    suffix = F.when(is_cited(), F.lit("_cited")).otherwise(F.lit("_uncited"))
    return F.when(F.col("claim_type").isin("qualitative", "quantitative"), F.concat("claim_type", suffix))


def route_claims(claims: DataFrame) -> DataFrame:
    return claims.withColumn("result_class", result_class())


def fact_key(text: Column) -> Column:
    """The whole text in lower case with white space squeezed; equal keys share a review."""
    return F.lower(squeeze(text))


def factcheck_lookup(claims: DataFrame, reviews: DataFrame, similarity: Column | None = None) -> DataFrame:
    """Claims with the first review of the same normalised text.

    Reviews are reduced to one per key before the join, so the join never multiplies claims.
    """
    columns = ["textual_rating", "publisher", "url"]
    first = reviews.groupBy(fact_key(F.col("claim_text")).alias("_key")).agg(
        F.min("review_id").alias("review_id"),
        F.min_by(F.struct(*columns), "review_id").alias("_review"),
    )
    return (
        claims.withColumn("_key", fact_key(F.col("text")))
        .join(first, "_key", "left")
        .select(
            *[F.col(c) for c in claims.columns],
            "review_id",
            *[F.col(f"_review.{c}").alias(c) for c in columns],
            F.when(
                F.col("review_id").isNotNull(),
                similarity if similarity is not None else F.lit(K.DEFAULT_SIMILARITY),
            ).alias("similarity"),
        )
    )


def factcheck_similar(claims: DataFrame, reviews: DataFrame, threshold: float = K.DEFAULT_SIMILARITY) -> DataFrame:
    """Claims with the review whose words are most like theirs, and that ``similarity``.

    It is the Jaccard similarity of the sets of lower-case words; reviews below
    ``threshold`` are none, equal ones go to the smaller ``review_id``. Equal sets meet by
    their key alone; only the other claims are searched, each distinct set once. Claims
    without words, and such without a review, keep nulls.
    """
    columns = ["textual_rating", "publisher", "url"]
    worded = lambda df, text: df.withColumn("_words", word_set(fact_key(F.col(text)))).withColumn("_pid", set_key(F.col("_words")))
    said = materialize(worded(claims, "text"), "claims")
    some = F.size("_words") > 0
    held = materialize(
        worded(reviews, "claim_text").where(some).groupBy(F.col("_pid").alias("pid")).agg(
            F.first("_words").alias("words"),
            F.min("review_id").alias("review_id"),
            F.min_by(F.struct(*columns), "review_id").alias("review"),
        ),
        "reviews",
    )
    equal = held.select("pid", "review_id", "review", F.lit(1.0).alias("similarity"))
    asked = said.where(some).withColumnRenamed("_pid", "pid").join(held.select("pid"), "pid", "left_anti")
    found = most_similar_sets(materialize(asked.groupBy("pid").agg(F.first("_words").alias("words")), "asked"), held, threshold)
    near = (
        found.join(held.select(F.col("pid").alias("b"), "review_id", "review"), "b")
        .groupBy(F.col("a").alias("pid"))
        .agg(F.min_by(F.struct("review_id", "review", "similarity"), F.struct(-F.col("similarity"), "review_id")).alias("best"))
        .select("pid", "best.*")
    )
    best = equal.unionByName(near).withColumnsRenamed({"review_id": "_review_id", "similarity": "_similarity"})
    return said.join(best, F.col("_pid") == F.col("pid"), "left").select(
        *[F.col(c) for c in claims.columns],
        F.col("_review_id").alias("review_id"),
        *[F.col(f"review.{c}").alias(c) for c in columns],
        F.col("_similarity").alias("similarity"),
    )


def factcheck_outcome(matches: DataFrame, enabled: bool = True) -> DataFrame:
    """found, confidence, explanation and sources of every claim after the lookup."""
    rated = F.col("textual_rating").isNotNull()
    matched = F.col("review_id").isNotNull()
    publisher = F.coalesce("publisher", F.lit("Unknown"))
    message = (
        F.when(~F.lit(enabled), F.lit("No API key configured"))
        .when(~matched, F.lit("No matching fact checks found"))
        .when(~rated, F.lit("Claim found but no review available"))
        .otherwise(F.concat(F.lit("Fact check found: '"), F.col("textual_rating"), F.lit("' by "), publisher))
    )
    found = F.lit(enabled) & matched & rated
    return (
        matches.withColumn("found", found)
        .withColumn(
            "fact_confidence",
            F.when(found, rating_confidence(F.col("textual_rating"), F.col("similarity"))).otherwise(F.lit(0.0)),
        )
        .withColumn("fact_explanation", message)
        .withColumn("fact_rating_passes", F.when(found, rating_passes(F.col("textual_rating"))))
        .withColumn(
            "fact_sources",
            F.when(found & (F.coalesce("url", F.lit("")) != ""), F.array("url")).otherwise(
                F.array().cast("array<string>")
            ),
        )
    )


def interpret_rating(reviews: DataFrame, mode: str = "reference") -> DataFrame:
    return reviews.withColumn("rating_passes", rating_passes(F.col("textual_rating"), mode))


def rating_scores(reviews: DataFrame, similarity: float = K.DEFAULT_SIMILARITY) -> DataFrame:
    return reviews.withColumn("confidence", rating_confidence(F.col("textual_rating"), F.lit(similarity)))


def plausibility(claims: DataFrame, model: Callable) -> DataFrame:
    """Model judgement per claim; a failed call is not plausible, has confidence 0 and an error."""
    asked = score(
        claims, model, ["text"], "plausible boolean, confidence double, reasoning string", task="plausibility_check"
    )
    failed = F.col("error").isNotNull()
    return (
        asked.withColumn("plausible", F.coalesce("plausible", F.lit(False)))
        .withColumn(
            "plausible_confidence",
            F.when(failed, F.lit(0.0)).otherwise(F.coalesce("confidence", F.lit(K.DEFAULT_MODEL_CONFIDENCE))),
        )
        .withColumn(
            "reasoning",
            F.when(failed, F.concat(F.lit("Verification error: "), "error")).otherwise(
                F.coalesce("reasoning", F.lit("No reasoning provided"))
            ),
        )
        .drop("confidence")
    )


def _verdict(honour_rating: bool) -> list[Column]:
    supported = F.col("found")
    if honour_rating:
        supported = supported & F.coalesce("fact_rating_passes", F.lit(False))
    return [
        (supported | F.col("plausible")).alias("passed"),
        F.greatest("fact_confidence", "plausible_confidence").alias("confidence"),
        F.concat(F.lit("Truth Table: "), "fact_explanation", F.lit(". LLM Check: "), "reasoning").alias("explanation"),
        F.col("fact_sources").alias("sources_used"),
    ]


def combine_uncited(scored: DataFrame, honour_rating: bool = False) -> DataFrame:
    """Results of uncited qualitative claims: either check is enough, the higher confidence counts."""
    return scored.select(
        "doc_id", "claim_id", "claim_type",
        F.lit(False).alias("originally_uncited"),
        F.lit(True).alias("validated"),
        F.lit("truth_table+llm_check").alias("validation_method"),
        *_verdict(honour_rating),
        F.lit(None).cast("string").alias("errors"),
    )


def triage_quant_uncited(
    scored: DataFrame, found_sources: DataFrame, honour_rating: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Uncited quantitative claims split into (claims to check on data, finished results).

    A strong check ends the search; only the other claims are joined to the datasets found for them.
    """
    strong = (F.col("found") & (F.col("fact_confidence") > K.STRONG_CONFIDENCE)) | (
        F.col("plausible") & (F.col("plausible_confidence") > K.STRONG_CONFIDENCE)
    )
    accepted = scored.where(strong).select(
        "doc_id", "claim_id", "claim_type",
        F.lit(False).alias("originally_uncited"),
        F.lit(True).alias("validated"),
        F.lit("truth_table+llm_only").alias("validation_method"),
        *_verdict(honour_rating),
        F.lit(None).cast("string").alias("errors"),
    )
    open_claims = scored.where(~strong)
    sources = found_sources.select("doc_id", "claim_id", "found_source")
    searched = open_claims.join(sources, ["doc_id", "claim_id"], "left")
    missing = searched.where(F.col("found_source").isNull()).select(
        "doc_id", "claim_id", "claim_type",
        F.lit(True).alias("originally_uncited"),
        F.lit(False).alias("validated"),
        F.lit("source_not_found").alias("validation_method"),
        F.lit(False).alias("passed"),
        F.lit(0.0).alias("confidence"),
        F.lit("No dataset source could be located for this uncited quantitative claim.").alias("explanation"),
        F.array().cast("array<string>").alias("sources_used"),
        F.lit(None).cast("string").alias("errors"),
    )
    return searched.where(F.col("found_source").isNotNull()), accepted.unionByName(missing)


def promote_found_source(claims: DataFrame) -> DataFrame:
    """Claims with a found dataset rewritten as cited by it."""
    source = F.col("found_source")
    return claims.withColumns(
        {
            "originally_uncited": F.lit(True),
            "citation_found": F.lit(True),
            "citation_id": F.concat(F.lit("found_"), "claim_id"),
            "citation_text": F.concat(F.lit("[Found: "), source["source_type"], F.lit("]")),
            "citation_details": F.struct(
                F.concat(F.lit("Dataset from "), source["source_type"]).alias("title"),
                F.lit(None).cast("array<string>").alias("authors"),
                F.lit(None).cast("int").alias("year"),
                source["source_url"].alias("url"),
                F.lit(None).cast("string").alias("doi"),
                F.concat(F.lit("Found dataset: "), source["source_url"]).alias("raw_text"),
            ),
        }
    )


def union_quant_cited(promoted: DataFrame, cited: DataFrame) -> DataFrame:
    """Promoted claims first, then claims cited in the paper; ``origin_rank`` keeps that order."""
    left = promoted.withColumn("origin_rank", F.lit(0))
    right = cited.withColumn("origin_rank", F.lit(1))
    return left.unionByName(right, allowMissingColumns=True)


def split_backing(claims: DataFrame) -> DataFrame:
    return claims.withColumn(
        "backing", F.when(F.col("found_source").isNull(), F.lit("paper")).otherwise(F.lit("dataset"))
    )


def cited_key() -> Column:
    return not_empty(F.col("citation_id"))
