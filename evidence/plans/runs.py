"""The three entry points: read papers into claims, validate claims, check claims on one set of sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.session import materialize
from evidence.operators import chunking, claims as C, discovery as D, documents, fetch, reporting, retrieval, routing, verdicts


@dataclass(frozen=True)
class Extraction:
    claims: DataFrame
    citations: DataFrame


def extract(
    papers: DataFrame, citation_model: Callable | None = None, claim_model: Callable | None = None,
    size: int = K.CHUNK_TOKENS, overlap: int = K.CHUNK_OVERLAP_CHARS,
) -> Extraction:
    """Papers to located claims mapped to their bibliographies. Models are optional; rules stand in."""
    listed = documents.extract_citations(papers, citation_model, positions=True)
    citations = listed.drop("pos")
    bodies = documents.body_text(papers)
    chunks = chunking.chunk_by_tokens(bodies, "body", "doc_id", size, overlap)
    if claim_model is None:
        found = C.extract_claims(chunks)
    else:
        facts = papers.select(
            "doc_id", documents.title_of(F.col("text")).alias("title"), documents.abstract_of(F.col("text")).alias("abstract")
        )
        found = C.extract_claims_model(C.claim_context(chunks, facts, listed), claim_model)
    valid, _ = C.claim_constraint(found)
    located = C.locate_claims(valid, bodies.withColumnRenamed("body", "text"))
    return Extraction(C.map_citations(located, citations), citations)


def coverage(papers: DataFrame) -> DataFrame:
    """How many claims of each class are backed by a bibliography entry, per paper and in total."""
    citations = documents.extract_citations(papers)
    chunks = documents.body_text(papers).select(
        "doc_id", F.lit(0).alias("chunk_id"), F.col("body").alias("text"), F.lit(0).alias("start_pos")
    )
    routed = routing.route_claims(C.map_citations(C.extract_claims(chunks), citations))
    doc, cls = F.col("doc_id"), F.col("result_class")
    return (
        routed.groupingSets([[doc, cls], [cls], []], doc, cls)
        .agg(
            F.count(F.lit(1)).alias("n_claims"),
            F.count_if(F.col("citation_id").isNotNull()).alias("n_backed"),
            F.grouping_id("doc_id", "result_class").alias("gid"),
        )
        .select("gid", "doc_id", "result_class", "n_claims", "n_backed")
    )


def ground(
    pairs: DataFrame, claims: DataFrame, sources: DataFrame,
    model: Callable | None = None, threshold: float = 0.5, store: bool = True, **options,
) -> DataFrame:
    """Verdict of every claim/source pair from the text of the source."""
    index = retrieval.index_sources(sources, store=store)
    evidence = retrieval.retrieve(pairs, claims, index, **options)
    outcome = retrieval.retrieval_outcome(pairs, index, evidence)
    if model is None:
        return verdicts.grounded_verdict(outcome, threshold)
    return verdicts.grounded_verdict_model(outcome, claims, model)


@dataclass(frozen=True)
class Validation:
    results: DataFrame
    batches: DataFrame
    stats: DataFrame
    rejects: DataFrame


def validate(
    claims: DataFrame, reviews: DataFrame, found_sources: DataFrame, attempts: DataFrame,
    texts: DataFrame, checks: DataFrame, plausibility_model: Callable,
    grounding_model: Callable | None = None, store: bool = True, similarity: float | None = None,
) -> Validation:
    """All four classes of claims, from claims to one results table.

    ``attempts`` and ``texts(doc_id, citation_id, source_text)`` are what was
    fetched for each citation; ``checks`` are outcomes of ``quant_check`` for
    claims with a dataset; ``found_sources`` are datasets found for uncited claims.
    Every claim has a row in ``results``, or in ``rejects`` if its type is unknown.
    With ``similarity`` a claim takes the review whose words are most like its own, from
    that Jaccard similarity on; without, a review of the same text.
    With ``store`` the claims and the model's answers are written once and read
    by every branch, so no claim is scored twice.
    """
    keep = materialize if store else (lambda df, name: df)
    every = keep(routing.route_claims(claims), "routed")
    routed = every.where(F.col("result_class").isNotNull())
    rejects = every.where(F.col("result_class").isNull()).withColumn(
        "reject_reason", F.concat(F.lit("Unknown claim type: "), F.coalesce("claim_type", F.lit("none"))))
    uncited = routed.where(~routing.is_cited())
    reviewed = routing.factcheck_lookup(uncited, reviews) if similarity is None else routing.factcheck_similar(uncited, reviews, similarity)
    scored = keep(
        routing.plausibility(
            routing.factcheck_outcome(reviewed),
            plausibility_model,
        ),
        "scored",
    )
    qual_uncited = routing.combine_uncited(scored.where(F.col("claim_type") == "qualitative"))
    with_data, quant_direct = routing.triage_quant_uncited(
        scored.where(F.col("claim_type") == "quantitative"), found_sources
    )
    promoted = routing.promote_found_source(with_data).select(*claims.columns, "found_source", "originally_uncited")
    cited = routed.where(routing.is_cited())
    sourced = keep(
        routing.split_backing(routing.union_quant_cited(promoted, cited.select(*claims.columns))), "sourced"
    )

    outcome = fetch.first_success(attempts)
    batches = fetch.citation_batch(sourced, outcome)
    paper_claims = sourced.where(F.col("backing") == "paper")
    data_claims = sourced.where(F.col("backing") == "dataset")
    failed = fetch.fail_batch(paper_claims, batches, "rag_search", "text source").unionByName(
        fetch.fail_batch(data_claims, batches, "table_check", "dataset")
    ).drop("citation_id")

    fetched = batches.where("downloaded").select(*fetch.BATCH)
    ready = paper_claims.join(fetched, fetch.BATCH, "left_semi")
    with_text = ready.join(texts.select(*fetch.BATCH), fetch.BATCH, "left_semi")
    keyed = with_text.select(
        F.concat_ws("/", "doc_id", "claim_id").alias("claim_key"),
        F.concat_ws("/", "doc_id", "citation_id").alias("source_key"),
        "doc_id", "claim_id", F.col("text").alias("claim_text"),
    )
    judged = ground(
        keyed.select("claim_key", "source_key"),
        keyed.select("claim_key", "claim_text"),
        texts.select(F.concat_ws("/", "doc_id", "citation_id").alias("source_key"), "source_text"),
        grounding_model, store=store,
    ).join(keyed.select("claim_key", "doc_id", "claim_id"), "claim_key")
    no_text = ready.join(texts.select(*fetch.BATCH), fetch.BATCH, "left_anti")
    grounded = verdicts.qualitative_result(
        ready, judged, routing.plausibility(no_text.drop("found_source"), plausibility_model)
    )
    measured = verdicts.quantitative_result(data_claims.join(fetched, fetch.BATCH, "left_semi"), checks)

    def classed(frame: DataFrame, name: str | None) -> DataFrame:
        label = F.lit(name) if name else F.concat("claim_type", F.lit("_cited"))
        return frame.withColumn("result_class", label)

    results = classed(qual_uncited, K.RESULT_CLASSES[0])
    for frame, name in (
        (quant_direct, K.RESULT_CLASSES[1]), (failed, None), (grounded, None), (measured, None),
    ):
        results = results.unionByName(classed(frame, name))
    return Validation(results, batches, reporting.result_stats(results), rejects)
