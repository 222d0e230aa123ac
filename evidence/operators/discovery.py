"""Choosing sources: catalog search, candidate ranking, resolution order, links, paywalls."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions.text import bind, contains_any, ends_with_any, head, not_empty, squeeze, word_keys
from evidence.operators.hook import score
from evidence.operators.postings import block_topk
from evidence.operators.ranking import nest_parts, rank_in_groups, top_k
from evidence.session import by_key, materialize

HOT_TOKEN_ITEMS = 1000


def overlap_topk(
    queries: DataFrame, items: DataFrame, query_key: list[str], item_key: str, k: int,
    hot_items: int = HOT_TOKEN_ITEMS, store: bool = True,
) -> DataFrame:
    """The ``k`` items sharing most distinct words with each query (ties: smaller item key).

    Both inputs need a ``words`` array. Exact, without pairing every query with
    every item that holds a common word:

    * queries with the same catalog words are searched once;
    * a word held by more than ``hot_items`` items is *hot*. Items sharing a
      rarer word with a query are scored on all their words; the overlap of the
      ``k``-th best of them is the bound ``b`` that other items have to reach;
    * an item sharing hot words only is matched through the set of hot words it
      holds. A set with ``b`` or more of a query's ``n`` hot words holds one of
      its ``n - b + 1`` rarest ones, so only those are joined, and none at all
      where ``n < b``. Of the items with one such set, only the ``k`` smallest
      keys can be among the best ``k``, so each set carries no more than those.

    With ``store`` the word sets of both sides are written once to the shared
    folder instead of being built anew in every branch.
    """
    keep = materialize if store else (lambda df, name: df)
    words = items.select(item_key, F.explode("words").alias("word"))
    frequency = words.groupBy("word").agg(F.count(F.lit(1)).alias("held_by"))
    frequency = keep(frequency.withColumn("is_hot", F.col("held_by") > hot_items), "frequency")
    graded = words.join(frequency, "word").groupBy(item_key).agg(
        F.sort_array(F.collect_set(F.when(F.col("is_hot"), F.col("word")))).alias("hot_set"),
        F.collect_set(F.when(~F.col("is_hot"), F.col("word"))).alias("rare_words"),
    )
    sets = keep(graded, "sets")

    # Distinct profiles, rarest word first, get a compact exact id: the smallest query that has the profile.
    profiles = keep(
        queries.select(*query_key, F.explode("words").alias("word"))
        .join(frequency, "word")
        .groupBy(*query_key)
        .agg(F.sort_array(F.collect_set(F.struct("held_by", "word", "is_hot"))).alias("profile")),
        "profiles",
    )
    hot_part = F.transform(F.filter("profile", lambda x: x["is_hot"]), lambda x: x["word"])
    distinct = profiles.groupBy("profile").agg(F.min(F.struct(*query_key)).alias("pid"))
    distinct = keep(distinct.withColumn("own_hot", hot_part), "distinct")
    own_rare = F.transform(F.filter("profile", lambda x: ~x["is_hot"]), lambda x: x["word"])

    rare = sets.select(item_key, "hot_set", F.explode("rare_words").alias("word"))
    by_rare = (
        distinct.select("pid", "own_hot", F.explode(own_rare).alias("word"))
        .join(rare, "word")
        .select("pid", item_key, F.size(F.array_intersect("own_hot", "hot_set")).alias("hot_overlap"))
        .groupBy("pid", item_key)
        .agg((F.count(F.lit(1)) + F.max("hot_overlap")).alias("overlap"))
    )
    best_rare = keep(top_k(by_rare, ["pid"], [F.col("overlap").desc(), F.col(item_key)], k, "_place"), "best_rare")
    bound = best_rare.where(F.col("_place") == k).select("pid", F.col("overlap").alias("bound"))

    hot_sets = sets.where(F.size("hot_set") > 0).select(item_key, "hot_set")
    named = keep(hot_sets.groupBy("hot_set").agg(F.min(item_key).alias("set_id")), "named")
    carriers = top_k(hot_sets, ["hot_set"], [F.col(item_key)], k, "_carrier").join(named, "hot_set").select(
        "set_id", item_key
    )
    needed = F.greatest(F.coalesce("bound", F.lit(1)), F.lit(1)).cast("int")
    asking = distinct.join(bound, "pid", "left").select("pid", "own_hot", needed.alias("needed"))
    prefix = F.slice("own_hot", F.lit(1), F.greatest(F.size("own_hot") - F.col("needed") + 1, F.lit(0)))
    met = (
        asking.select("pid", F.explode(prefix).alias("word"))
        .join(named.select("set_id", F.explode("hot_set").alias("word")), "word")
        .select("pid", "set_id").distinct()
    )
    shared = (
        met.join(named, "set_id").join(asking, "pid")
        .select("pid", "set_id", "needed", F.size(F.array_intersect("own_hot", "hot_set")).alias("overlap"))
        .where(F.col("overlap") >= F.col("needed"))
    )
    # The best items lie in the best sets, a set ranking by its smallest item.
    best_sets = top_k(shared, ["pid"], [F.col("overlap").desc(), F.col("set_id")], k, "_set_rank")
    by_hot = best_sets.join(carriers, "set_id").select("pid", item_key, F.col("overlap").cast("bigint").alias("overlap"))

    scored = best_rare.select("pid", item_key, "overlap").unionByName(by_hot).groupBy("pid", item_key).agg(F.max("overlap").alias("overlap"))
    best = top_k(scored, ["pid"], [F.col("overlap").desc(), F.col(item_key)], k)
    return profiles.join(distinct.select("profile", "pid").join(best, "pid"), "profile").select(*query_key, item_key, "overlap", "rank")


def catalog_search(
    claims: DataFrame, catalog: DataFrame, k: int = K.CATALOG_TOP_K, hot_items: int = HOT_TOKEN_ITEMS, chars: int | None = None
) -> DataFrame:
    """Up to ``k`` catalog datasets for each claim, searched by its whole text or its first ``chars`` characters."""
    asked = F.col("text") if chars is None else head(F.col("text"), chars)
    queries = claims.select("doc_id", "claim_id", word_keys(asked).alias("words"))
    entries = catalog.select("dataset_id", word_keys(F.concat_ws(" ", "title", "notes")).alias("words"))
    return overlap_topk(queries, entries, ["doc_id", "claim_id"], "dataset_id", k, hot_items)


def text_source_search(
    claims: DataFrame, sources: DataFrame, k: int = K.TEXT_TOP_K, chars: int | None = None
) -> DataFrame:
    """The best text source for each claim, of ``k`` candidates, searched by its whole text or its first ``chars`` characters."""
    asked = F.col("text") if chars is None else head(F.col("text"), chars)
    queries = claims.select("doc_id", "claim_id", word_keys(asked).alias("words"))
    entries = sources.select("source_id", word_keys(F.col("text")).alias("words"))
    hits = block_topk(queries, entries, ["doc_id", "claim_id"], "source_id", k)
    return hits.groupBy("doc_id", "claim_id").agg(
        F.min_by("source_id", "rank").alias("source_id"),
        F.max("overlap").alias("overlap"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.first(F.lit(K.TEXT_SCORE)).alias("relevance_score"),
    )


def pick_resource(resources: DataFrame) -> DataFrame:
    """Per dataset: its first tabular resource, else its landing page."""
    tabular = F.lower(F.coalesce("format", F.lit(""))).isin(*K.TABULAR_FORMATS)
    return (
        resources.groupBy("dataset_id")
        .agg(
            F.min(F.when(tabular, F.struct("pos", "resource_url")))["resource_url"].alias("table_url"),
            F.min(F.struct("pos", "landing_url"))["landing_url"].alias("landing_url"),
        )
        .select("dataset_id", F.coalesce(not_empty(F.col("table_url")), F.col("landing_url")).alias("url"))
    )


def union_repositories(primary: list[DataFrame], fallback: list[DataFrame], fallback_k: int | None = None) -> DataFrame:
    """Candidates of the first repositories; those of the others only for claims without any.

    ``fallback_k`` keeps that many candidates of each of the others. Frames need ``doc_id, claim_id, url, source, pos``.
    """
    tiers = []
    for tier, frames in enumerate((primary, fallback)):
        points = K.CATALOG_SCORE if tier == 0 else K.WEB_CATALOG_SCORE
        for order, frame in enumerate(frames):
            kept = frame if tier == 0 or fallback_k is None else frame.where(F.col("pos") <= fallback_k)
            tiers.append(
                kept.select("doc_id", "claim_id", "url", "source", "pos").withColumns(
                    {"tier": F.lit(tier), "repository": F.lit(order), "score": F.lit(points)}
                )
            )
    everything = tiers[0]
    for frame in tiers[1:]:
        everything = everything.unionByName(frame)
    best = everything.groupBy("doc_id", "claim_id").agg(F.min("tier").alias("tier"))
    return everything.join(best, ["doc_id", "claim_id", "tier"], "left_semi")


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """The candidate with the highest score per claim, the earliest on ties."""
    best = F.max_by(
        F.struct("url", "source", "score"),
        F.struct(F.col("score"), -F.col("repository"), -F.col("pos")),
    )
    return candidates.groupBy("doc_id", "claim_id").agg(best.alias("_best")).select("doc_id", "claim_id", "_best.*")


def dataset_reuse(
    claims: DataFrame, threshold: float = K.REUSE_CONFIDENCE
) -> DataFrame:
    """Datasets chosen claim by claim in paper order, reusing one found earlier where it fits.

    ``claims`` holds ``doc_id, claim_id, seq``, the claim's own best candidate
    (``url``, ``source``, ``score``; null when the search found none) and
    ``reuse``: array of ``struct(url, confidence)``, how well known datasets fit
    the claim. The first earlier dataset with the highest confidence above the
    threshold is reused. Rows stream through in order; only the datasets found
    so far in the current paper are held.
    """
    schema = (
        "doc_id bigint, claim_id string, seq bigint, source_url string, source_type string, "
        "relevance_score double, found_by_claim_id string, is_reused boolean, reuse_no int"
    )
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
    shape = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paper, found = None, {}
        for batch in batches:
            rows: list[list] = [[] for _ in shape]
            *own, fits = batch.columns
            known_urls, points_of = (fits.values.field(c).to_pylist() for c in ("url", "confidence"))
            places = fits.offsets.to_pylist()
            for n, (doc, claim, seq, url, source, points) in enumerate(zip(*[c.to_pylist() for c in own], strict=True)):
                if doc is None or doc != paper:
                    paper, found = doc, {}
                near = [k for k in range(places[n], places[n + 1]) if known_urls[k] in found]
                known = min(((-points_of[k], found[known_urls[k]]["order"], known_urls[k]) for k in near), default=None)
                if known:
                    chosen = found[known[2]]
                    chosen["used"] += 1
                    row = (doc, claim, seq, *chosen["row"], True, chosen["used"])
                elif url is not None:
                    found.setdefault(url, {"order": len(found), "used": 0, "row": (url, source, points, claim)})
                    row = (doc, claim, seq, url, source, points, claim, False, 0)
                else:
                    continue
                for column, value in zip(rows, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, shape)], schema=shape)

    # Only what can be reused goes to the walk; a null or NaN is no confidence.
    fit = F.filter("reuse", lambda x: (x["confidence"] > threshold) & ~F.isnan(x["confidence"]))
    rows = claims.select("doc_id", "claim_id", "seq", "url", "source", "score", fit.alias("reuse"))
    return by_key(rows, "doc_id", times=4).sortWithinPartitions("doc_id", "seq").mapInArrow(walk, schema)


def dataset_reuse_waves(
    claims: DataFrame, ask: Callable | None = None, inputs: Sequence[str] = (), threshold: float = K.REUSE_CONFIDENCE,
    waves: int | None = None, cache: str | None = None,
) -> DataFrame:
    """``dataset_reuse`` without walking a paper: claims are decided wave by wave, wherever they lie.

    A dataset is found by the first claim that searched it out and reused
    nothing. Each wave bounds that place from both sides: claims known to search
    give the latest it can be, claims not yet decided the earliest. A claim that
    fits a dataset surely found before it reuses; one for which no fitting
    dataset can lie before it searches. The earliest open claim of every paper is
    decided in each wave, so the waves end; there are as many as decisions hang
    on one another. After ``waves`` of them the claims still open are walked
    in order, which gives the same rows (not with ``ask``, which goes on to the end).

    Confidences come from the claims' ``reuse`` arrays, or from ``ask``: a model
    for the hook, from ``inputs`` (columns of the claims) and ``known_url`` to
    ``confidence``. It sees a pair of a claim and a dataset only when that dataset
    is surely found before the claim, each pair once; ``cache`` keeps the answers.
    A failed answer counts as no fit. Null urls find nothing; ``seq`` is
    distinct within a paper. Result as of ``dataset_reuse``.
    """
    own = claims.select("doc_id", "claim_id", "seq", "url", "source", "score", *[c for c in inputs if c not in _CLAIM])
    fit_type = "doc_id bigint, seq bigint, known_url string, confidence double"
    state = materialize(own.withColumns({"decided": F.lit(None).cast("string"), "turn": F.lit(None).cast("int")}), "wave")
    if ask is None:
        searched = state.where(F.col("url").isNotNull()).select("doc_id", F.col("url").alias("known_url")).distinct()
        every = claims.select("doc_id", "seq", F.explode(F.filter("reuse", lambda x: x["confidence"] > threshold)).alias("_fit")).select(
            "doc_id", "seq", F.col("_fit.url").alias("known_url"), F.col("_fit.confidence").alias("confidence"))
        fits = materialize(
            every.join(searched, ["doc_id", "known_url"], "left_semi").select("doc_id", "seq", "known_url", "confidence"), "fits")
        fitting = fits
    else:
        fits = fitting = own.sparkSession.createDataFrame([], fit_type)
    done: list[DataFrame] = []
    turn = 0
    while True:
        turn += 1
        firsts = _first_found(state)
        if ask is not None and turn > 1:  # nothing is found before the first wave
            answers = materialize(_asked(state, firsts.where(F.col("turn") == turn - 1), ask, inputs, cache).where(F.col("confidence") > threshold), "answers")
            fits, fitting = fits.unionByName(answers), fitting.unionByName(answers)
        bounds = (
            fitting.join(firsts, ["doc_id", "known_url"])
            .groupBy("doc_id", "seq")
            .agg(F.max(F.col("high") < F.col("seq")).alias("sure"), F.max(F.col("low") < F.col("seq")).alias("maybe"))
        )
        maybe = F.coalesce("maybe", F.lit(False))
        bounded = state.join(bounds, ["doc_id", "seq"], "left")
        if ask is not None:
            # Behind the first dataset whose place is open, one could still be found that was never asked about.
            unsure = firsts.where(~F.col("low").eqNullSafe(F.col("high"))).groupBy("doc_id").agg(F.min("low").alias("unsure"))
            bounded = bounded.join(unsure, "doc_id", "left")
            maybe = F.coalesce(F.col("unsure") < F.col("seq"), F.lit(False))
        decided = (
            F.when(F.col("decided").isNotNull(), F.col("decided"))
            .when(F.col("sure"), F.lit("reused"))
            .when(~maybe, F.lit("searched"))
        )
        now = bounded.withColumn("decided", decided).withColumn("turn", F.coalesce("turn", F.when(F.col("decided").isNotNull(), F.lit(turn))))
        state = materialize(now.select(*state.columns), "wave")
        left = materialize(state.where("decided IS NULL").select("doc_id").distinct(), "open")
        if left.isEmpty():
            break
        # Papers whose claims are all decided take no part in later waves.
        done.append(state.join(left, "doc_id", "left_anti"))
        state = state.join(left, "doc_id", "left_semi")
        fitting = fits.join(left, "doc_id", "left_semi")
        if ask is None and waves is not None and turn >= waves:
            state = materialize(_walk_open(state, fitting), "wave")
            break
    for part in done:
        state = state.unionByName(part)
    if ask is not None:  # claims that reuse must have seen the datasets of the last wave of their paper
        last = state.groupBy("doc_id").agg(F.max("turn").alias("turn"))
        answers = _asked(state, _first_found(state).join(last, ["doc_id", "turn"], "left_semi"), ask, inputs, cache)
        fits = fits.unionByName(materialize(answers, "answers"))
    return _reused(state, fits.where(F.col("confidence") > threshold))


def _asked(state: DataFrame, found: DataFrame, ask: Callable, inputs: Sequence[str], cache: str | None) -> DataFrame:
    """Answers for the datasets of ``found`` and the claims behind them that are open or reuse.

    The place of a found dataset is final where a model is asked, so each pair
    comes once: in the wave after the one that found the dataset.
    """
    claims = state.where("decided IS NULL OR decided = 'reused'").select("doc_id", "seq", *inputs)
    parts = claims.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / REUSE_CLAIMS).alias("_parts"))
    dealt = claims.join(parts, "doc_id").withColumn("_part", F.pmod(F.xxhash64("seq"), F.col("_parts")))
    copied = found.where(F.col("high").isNotNull()).join(parts, "doc_id").select(
        "doc_id", "known_url", "high", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part"))
    due = dealt.join(copied, ["doc_id", "_part"]).where("high < seq").select("doc_id", "seq", *inputs, "known_url")
    answered = score(due, ask, [*inputs, "known_url"], "confidence double", task="dataset_reuse", cache=cache)
    return answered.select("doc_id", "seq", "known_url", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


#: A paper's claims are dealt into parts of about so many when they meet the datasets found in it.
REUSE_CLAIMS = 4096
_CLAIM = ("doc_id", "claim_id", "seq", "url", "source", "score")


def _first_found(state: DataFrame) -> DataFrame:
    """Of each dataset of a paper the earliest place it can have been found (``low``), the latest (``high``) and the wave that found the latest."""
    searching = F.col("decided") == "searched"
    return (
        state.where(F.col("url").isNotNull() & (F.col("decided").isNull() | searching))
        .groupBy("doc_id", F.col("url").alias("known_url"))
        .agg(
            F.min("seq").alias("low"), F.min(F.when(searching, F.col("seq"))).alias("high"),
            F.min_by(F.when(searching, F.col("turn")), F.when(searching, F.col("seq"))).alias("turn"),
        )
    )


def _walk_open(state: DataFrame, fits: DataFrame) -> DataFrame:
    """Open claims decided one after the other in each paper; what is decided comes in as bounds on their fits."""
    found = _first_found(state.where("decided IS NOT NULL")).select("doc_id", "known_url", F.col("high").alias("found_at"))
    open_ = state.where("decided IS NULL")
    fitting = (
        fits.join(open_.select("doc_id", "seq"), ["doc_id", "seq"])
        .join(found, ["doc_id", "known_url"], "left")
        .groupBy("doc_id", "seq")
        .agg(F.collect_set("known_url").alias("fitting"), F.min("found_at").alias("found_at"))
    )
    rows = open_.join(fitting, ["doc_id", "seq"]).select("doc_id", "seq", "url", "fitting", "found_at")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paper, seen = None, set()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.doc_id != paper:
                    paper, seen = r.doc_id, set()
                reuses = r.found_at < r.seq or not seen.isdisjoint(r.fitting)
                if not reuses and r.url is not None:
                    seen.add(r.url)
                out.append((r.doc_id, r.seq, "reused" if reuses else "searched"))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "_late"])

    late = (
        rows.repartition("doc_id").sortWithinPartitions("doc_id", "seq")
        .mapInPandas(walk, "doc_id bigint, seq bigint, _late string")
    )
    return state.join(late, ["doc_id", "seq"], "left").withColumn("decided", F.coalesce("decided", "_late")).select(*state.columns)


def _reused(state: DataFrame, fits: DataFrame) -> DataFrame:
    """Chosen datasets of decided claims: the best fit found earlier, else the claim's own."""
    founders = (
        state.where((F.col("decided") == "searched") & F.col("url").isNotNull())
        .groupBy("doc_id", F.col("url").alias("known_url"))
        .agg(F.min_by(F.struct("url", "source", "score", "claim_id", "seq"), "seq").alias("_row"))
    )
    best = (
        fits.join(state.where("decided = 'reused'").select("doc_id", "seq"), ["doc_id", "seq"])
        .join(founders, ["doc_id", "known_url"])
        .where(F.col("_row.seq") < F.col("seq"))
        .groupBy("doc_id", "seq")
        .agg(F.max_by("_row", F.struct("confidence", -F.col("_row.seq"))).alias("_row"))
    )
    chosen = state.where("decided = 'reused'").select("doc_id", "claim_id", "seq").join(best, ["doc_id", "seq"]).select(
        "doc_id", "claim_id", "seq", F.col("_row.url").alias("source_url"), F.col("_row.source").alias("source_type"),
        F.col("_row.score").alias("relevance_score"), F.col("_row.claim_id").alias("found_by_claim_id"),
        F.lit(True).alias("is_reused"))
    numbered = rank_in_groups(
        chosen, ["doc_id", "source_url"], [F.col("seq")], [F.floor(F.col("seq") / F.lit(10_000))], "reuse_no"
    ).withColumn("reuse_no", F.col("reuse_no").cast("int"))
    fresh = state.where((F.col("decided") == "searched") & F.col("url").isNotNull()).select(
        "doc_id", "claim_id", "seq", F.col("url").alias("source_url"), F.col("source").alias("source_type"),
        F.col("score").alias("relevance_score"), F.col("claim_id").alias("found_by_claim_id"),
        F.lit(False).alias("is_reused"), F.lit(0).alias("reuse_no"))
    return numbered.unionByName(fresh)


def found_source_struct() -> Column:
    return F.struct(
        "source_url", "source_type", "relevance_score", "found_by_claim_id",
        F.lit(0).alias("reused_count"),
    )


def reuse_counts(chosen: DataFrame) -> DataFrame:
    """Found datasets of each paper with the number of later claims that reused them."""
    return chosen.groupBy("doc_id", "source_url").agg(
        F.min_by("found_by_claim_id", "seq").alias("found_by_claim_id"),
        F.min_by("source_type", "seq").alias("source_type"),
        F.min_by("relevance_score", "seq").alias("relevance_score"),
        F.count_if("is_reused").alias("reused_count"),
    )


def discovery_records(found: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Per paper: the count and the records found, as JSON arrays of bounded size."""
    parts = nest_parts(found, [key], [order], F.struct(*columns), F.col(order), "records")
    return parts.select(key, "part", F.col("group_size").alias("count"), F.to_json("records").alias("records_json"))


def discovery_documents(
    found: DataFrame, run_ts: str, stem: str = "stem", columns: Sequence[str] = ("claim_id", "search_query", "url", "source", "score"),
    order: str = "claim_id",
) -> DataFrame:
    """What a run found for each document, as JSON under a heading of run stamp, stem and count.

    ``found`` has a row for each record, ``stem`` naming its document. A document
    with very many records takes several, with the same heading and a ``part``.
    """
    parts = nest_parts(found, [stem], list(columns), F.struct(*columns), F.col(order), "records")
    heading = F.struct(
        F.lit(run_ts).alias("run_timestamp"), F.col(stem).alias("run_stem"), F.col("group_size").alias("count"), "part", "records")
    return parts.select(F.col(stem).alias("stem"), "part", F.to_json(heading).alias("document"))


def rank_oa_locations(locations: DataFrame) -> DataFrame:
    """Open-access URLs of each DOI: repository before publisher, PDF before landing page."""
    is_repo = F.when(F.col("host_type") == "repository", F.lit(0)).otherwise(F.lit(1))
    pdf = not_empty(F.col("url_for_pdf"))
    has_pdf = F.when(pdf.isNotNull(), F.lit(0)).otherwise(F.lit(1))
    other = [not_empty(F.col("url"))] if "url" in locations.columns else []
    usable = (
        locations.withColumn("best_url", F.coalesce(pdf, not_empty(F.col("url_for_landing_page")), *other))
        .withColumn("is_repo", is_repo)
        .withColumn("has_pdf", has_pdf)
        .where(F.col("best_url").isNotNull())
    )
    ranked = rank_in_groups(
        usable, ["doi"], [F.col("is_repo"), F.col("has_pdf"), F.col("pos")],
        [F.col("is_repo"), F.col("has_pdf"), F.floor(F.col("pos") / F.lit(10_000))],
    )
    return ranked.select("doi", "rank", F.col("best_url").alias("url"))


def with_best_location(ranked: DataFrame, best_locations: DataFrame) -> DataFrame:
    """DOIs whose location list gave no URL fall back to their best location."""
    spare = best_locations.select(
        "doi", F.lit(1).cast("bigint").alias("rank"),
        F.coalesce(not_empty(F.col("url_for_pdf")), not_empty(F.col("url_for_landing_page"))).alias("url"),
    ).where(F.col("url").isNotNull())
    return ranked.unionByName(spare.join(ranked.select("doi").distinct(), "doi", "left_anti"))


def crossref_pdf_links(works: DataFrame) -> DataFrame:
    """Links of ``links ARRAY<STRUCT<content_type,url>>`` that are PDFs by type or by URL."""
    return (
        works.select("doi", F.posexplode("links").alias("pos", "_link"))
        .select("doi", "pos", "_link.url", F.coalesce("_link.content_type", F.lit("")).alias("content_type"))
        .where(
            (F.coalesce("url", F.lit("")) != "")
            & (F.contains("content_type", F.lit("pdf")) | F.contains(F.lower("url"), F.lit("pdf")))
        )
        .select("doi", "pos", "url")
    )


def title_search_recover_doi(hits: DataFrame, k: int | None = None) -> DataFrame:
    """From the hits of a title search, or the first ``k``: the open-access URLs and the first DOI seen."""
    shown = hits if k is None else hits.where(F.col("pos") <= k)
    order = F.array_sort(
        F.collect_list(F.when(F.coalesce("oa_url", F.lit("")) != "", F.struct("pos", "oa_url")))
    )
    return shown.groupBy("citation_key").agg(
        F.min(F.when(F.coalesce("doi", F.lit("")) != "", F.struct("pos", "doi")))["doi"].alias("recovered_doi"),
        F.transform(order, lambda x: x["oa_url"]).alias("urls"),
    )


def resolve_doi_merge(*apis: DataFrame) -> DataFrame:
    """URLs of several services for one DOI, in the order the services are given.

    Frames need ``doi, pos, url``; ``pos`` becomes the position within all services.
    """
    merged = None
    for api_rank, frame in enumerate(apis):
        part = frame.select("doi", F.lit(api_rank).alias("api_rank"), F.col("pos").cast("bigint").alias("api_pos"), "url")
        merged = part if merged is None else merged.unionByName(part)
    return merged


def resolve_cascade(steps: list[DataFrame], keys: list[str]) -> DataFrame:
    """Candidates of the first step that has any, per citation. Frames need the keys, ``pos`` and ``url``.

    Each frame is read once and its rows move once, to their citation.
    """
    tagged = None
    for step, frame in enumerate(steps, start=1):
        part = frame.where(F.coalesce("url", F.lit("")) != "").select(
            *keys, F.lit(step).alias("step"), F.col("pos").cast("bigint").alias("pos"), "url"
        )
        tagged = part if tagged is None else tagged.unionByName(part)
    known = tagged.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).repartition(*keys)
    distinct = dedupe_ordered(known, [*keys, "step"])
    first = F.min("step").over(W.partitionBy(*keys))
    return distinct.withColumn("_first", first).where(F.col("step") == F.col("_first")).drop("_first")


def dedupe_ordered(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Non-empty distinct URLs; each keeps its first position."""
    return (
        candidates.where(F.coalesce("url", F.lit("")) != "")
        .groupBy(*keys, "url")
        .agg(F.min("pos").alias("pos"))
    )


def best_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.groupBy(*keys).agg(F.min_by("url", "pos").alias("url"))


def parsed_citation_once(citations: DataFrame, model: Callable) -> DataFrame:
    """Title, author, year, journal and DOI of each entry; equal texts are parsed once."""
    return score(
        citations, model, ["citation_text"],
        "title string, first_author string, year int, journal string, doi string", task="reference_parsing",
    )


def bibliographic_query(parsed: DataFrame) -> DataFrame:
    """Search strings: title, author and year when the title is known, else the raw text."""
    title = not_empty(F.col("title"))
    tail = [not_empty(F.col("first_author")), F.when(F.col("year") != 0, F.col("year").cast("string"))]
    raw = F.col("citation_text")
    return parsed.withColumns(
        {
            "bibliographic_query": F.when(title.isNotNull(), F.concat_ws(" ", title, *tail)).otherwise(raw),
            "scholar_query": F.when(
                title.isNotNull(), F.concat_ws(" ", F.concat(F.lit('"'), title, F.lit('"')), *tail)
            ).otherwise(raw),
        }
    )


def paywall_domains_needed(texts: DataFrame, domains: tuple[str, ...] = K.PAYWALL_DOMAINS) -> DataFrame:
    """Per paper, the known paywall domains that occur in its texts (``doc_id, text``)."""
    low = F.lower("text")
    present = F.filter(
        F.array(*[F.when(F.contains(low, F.lit(d)), F.lit(d)) for d in domains]), lambda d: d.isNotNull()
    )
    return texts.select("doc_id", F.explode(present).alias("domain")).distinct()


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def paywall_host(urls: DataFrame, hosts: tuple[str, ...] = K.PUBLISHER_HOSTS) -> DataFrame:
    return urls.withColumn("is_paywall_host", ends_with_any(url_host(F.col("url")), hosts))


def paywall_page(pages: DataFrame) -> DataFrame:
    """Pages that want a login: by the address, or by a phrase anywhere in the text shown."""
    shown = F.lower("body")
    return pages.withColumn(
        "is_paywalled",
        contains_any(F.lower("url"), K.LOGIN_URL_WORDS) | contains_any(shown, K.PAYWALL_PHRASES),
    )


def login_page(pages: DataFrame) -> DataFrame:
    """HTML pages that speak of a login."""
    html = F.contains(F.coalesce("content_type", F.lit("")), F.lit("text/html"))
    return pages.withColumn("is_login_page", html & F.contains(F.lower("html"), F.lit("login")))


def strip_elements(html: Column, tags: tuple[str, ...]) -> Column:
    return F.regexp_replace(html, rf"(?is)<({'|'.join(tags)})\b[^>]*>.*?</\1\s*>", "")


def _plain_text(html: Column) -> Column:
    return squeeze(decode_entities(F.regexp_replace(html, r"(?s)<[^>]*>", " ")))


def candidate_links(
    pages: DataFrame, skip: tuple[str, ...] = K.SKIP_DOMAINS, limit: int | None = None, context: bool = False
) -> DataFrame:
    """Absolute links of a page outside its navigation, one row per link, without a shuffle.

    Of links to one address the first counts. ``limit`` keeps the first so many
    of a page; by default all are kept. ``context`` adds the text of the block
    (paragraph, division, list item or cell) that the link stands in.
    """
    html = strip_elements(F.col("html"), K.LINK_BOILERPLATE)
    pattern = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"

    def links_in(block: Column) -> Column:
        found = F.arrays_zip(
            F.regexp_extract_all(block, F.lit(pattern), F.lit(1)).alias("url"),
            F.regexp_extract_all(block, F.lit(pattern), F.lit(2)).alias("title"),
        )
        around = _plain_text(block) if context else F.lit("")
        return F.transform(found, lambda x: F.struct(
            F.btrim(x["url"]).alias("url"), _plain_text(x["title"]).alias("title"), around.alias("context")))

    def wanted(x: Column) -> Column:
        host = F.regexp_replace(url_host(x["url"]), r"^www\.", "")
        return x["url"].startswith("http") & ~ends_with_any(host, skip) & (F.length(x["title"]) >= K.MIN_ANCHOR_CHARS)

    def firsts(links: Column) -> Column:
        return bind(
            F.transform(links, lambda x: x["url"]),
            lambda urls: F.filter(links, lambda x, i: F.array_position(urls, x["url"]) == i + 1),
        )

    blocks = F.split(html, rf"(?i)</?(?:{'|'.join(K.LINK_BLOCKS)})\b[^>]*>") if context else F.array(html)
    kept = bind(F.filter(F.flatten(F.transform(blocks, links_in)), wanted), firsts)
    rows = pages.select("page_id", F.posexplode(kept if limit is None else F.slice(kept, 1, limit)).alias("pos", "_link"))
    more = [F.col("_link.context").alias("context")] if context else []
    return rows.select(
        "page_id", (F.col("pos") + 1).alias("link_no"), F.col("_link.url").alias("url"), F.col("_link.title").alias("title"), *more
    )


def decode_entities(c: Column) -> Column:
    for name, char in (
        ("&nbsp;", "\xa0"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
        ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    ):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def rank_links(links: DataFrame, queries: DataFrame, model: Callable, k: int = K.WEB_CATALOG_TOP_K) -> DataFrame:
    """Links chosen by a model: 1-based picks in order; invalid picks are dropped, a failed call keeps the first ``k``.

    All links of a page are one list, as the model picks by number.
    """
    listed = links.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("link_no", "url", "title"))).alias("links")
    )
    asked = score(
        queries.join(listed, "page_id"), model, ["query", "links"], "selected array<int>", task="browser_link_ranking"
    )
    picks = F.when(F.col("error").isNotNull(), F.sequence(F.lit(1), F.least(F.lit(k), F.size("links")))).otherwise(
        F.coalesce("selected", F.array().cast("array<int>"))
    )
    valid = F.slice(F.filter(picks, lambda i: (i >= 1) & (i <= F.size("links"))), 1, k)
    return asked.select("page_id", "query", "links", F.posexplode(valid).alias("pos", "pick")).select(
        "page_id", "query", (F.col("pos") + 1).alias("rank"), F.element_at("links", F.col("pick"))["url"].alias("url")
    )
