"""Claims: extraction, location in the text, mapping to the bibliography, order and groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence import constants as K
from evidence.functions import citations as C
from evidence.functions.spans import locate
from evidence.functions.text import head, not_empty, sentences, strip
from evidence.operators.hook import score
from evidence.operators.ranking import rank_in_groups, top_k
from evidence.session import materialize

SEQ_BUCKET = 100_000
#: Claims that are searched beside one copy of their paper's text.
CLAIMS_LISTED = 4096

_CLAIM = "struct<claim_text:string,claim_type:string,citation_marker:string,is_original:boolean>"


def _with_ids(claims: DataFrame) -> DataFrame:
    return claims.select(
        "doc_id",
        F.format_string("claim_%d_%d", "chunk_id", "idx").alias("claim_id"),
        "chunk_id",
        "idx",
        (F.col("chunk_id").cast("bigint") * F.lit(1 << 32) + F.col("idx")).alias("seq"),
        "text",
        "claim_type",
        "citation_text",
        F.col("citation_text").isNotNull().alias("citation_found"),
        "is_original",
        "hint",
    )


def extract_claims(chunks: DataFrame) -> DataFrame:
    """Rule baseline: every sentence of a chunk is a claim, quantitative when it holds a digit.

    Digits of citation markers do not count.
    """
    text = F.col("text")
    unmarked = F.regexp_replace(text, f"{K.NUMERIC_MARKER}|{K.AUTHOR_MARKER}", "")
    return _with_ids(
        chunks.select(
            "doc_id",
            "chunk_id",
            F.col("start_pos").alias("hint"),
            F.posexplode(F.filter(sentences(text), lambda s: strip(s) != "")).alias("idx", "text"),
        ).select(
            "doc_id", "chunk_id", "idx", "hint", "text",
            F.when(unmarked.rlike(K.DIGIT), F.lit("quantitative")).otherwise(F.lit("qualitative")).alias("claim_type"),
            C.first_marker(text).alias("citation_text"),
            F.lit(False).alias("is_original"),
        )
    )


def normalize_claim_json(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Rows of a model answer: ``{"claims": [...]}`` or a bare array, with defaults filled in.

    The marker text "null" counts as no marker. An answer that is no JSON gives no rows.
    """
    wrapped = F.from_json(F.col(answer), f"struct<claims:array<{_CLAIM}>>")["claims"]
    bare = F.from_json(F.col(answer), f"array<{_CLAIM}>")
    items = F.when(F.ltrim(F.col(answer), F.lit(K.SPACE_CHARS)).startswith("{"), wrapped).otherwise(bare)
    keep = [c for c in ("hint",) if c in answers.columns]
    rows = answers.select("doc_id", "chunk_id", *keep, F.posexplode(items).alias("idx", "_claim"))
    marker = F.col("_claim.citation_marker")
    return _with_ids(
        rows.select(
            "doc_id", "chunk_id", "idx",
            F.col("hint") if keep else F.lit(0).alias("hint"),
            F.coalesce("_claim.claim_text", F.lit("")).alias("text"),
            F.coalesce("_claim.claim_type", F.lit("qualitative")).alias("claim_type"),
            F.when(F.lower(strip(marker)) != "null", marker).alias("citation_text"),
            F.coalesce("_claim.is_original", F.lit(False)).alias("is_original"),
        )
    )


def extract_claims_model(context: DataFrame, model: Callable) -> DataFrame:
    """Claims read by a model from chunks with their paper context."""
    asked = score(
        context.withColumnRenamed("start_pos", "hint"),
        model,
        ["text", "title", "abstract_preview", "citation_list"],
        "answer string",
        task="claim_extraction",
    )
    return normalize_claim_json(asked)


def claim_context(
    chunks: DataFrame, facts: DataFrame, citations: DataFrame,
    entries: int | None = None, entry_chars: int | None = None, abstract_chars: int | None = None,
) -> DataFrame:
    """Chunks with title, abstract and bibliography of their paper, one line an entry.

    ``entries``, ``entry_chars`` and ``abstract_chars`` bound what a model is
    shown; by default it is shown all. Shortened texts end in three dots.
    """

    def shown(text: Column, chars: int | None) -> Column:
        if chars is None:
            return text
        return F.when(F.length(text) > chars, F.concat(head(text, chars), F.lit("..."))).otherwise(text)

    order = [F.col("pos"), F.col("citation_id")]
    first = citations if entries is None else top_k(citations, ["doc_id"], order, entries)
    line = F.concat(F.col("citation_id"), F.lit(": "), shown(F.col("citation_text"), entry_chars))
    lists = first.groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n",
        ).alias("citation_list")
    )
    per_paper = facts.join(lists, "doc_id", "left").select(
        "doc_id", "title", shown(F.col("abstract"), abstract_chars).alias("abstract_preview"), "citation_list"
    )
    return chunks.join(per_paper, "doc_id", "left")


def claim_constraint(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid claims and rejects; a claim cannot be both original and cited."""
    broken = F.col("is_original") & F.col("citation_found")
    reason = F.concat(
        F.lit("Claim "), F.col("claim_id"),
        F.lit(" cannot be both original (is_original=True) and have an external citation (citation_found=True)."),
    )
    return claims.where(~broken), claims.where(broken).withColumn("reject_reason", reason)


def _locating(loose: bool):
    def locating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a text and a bounded list of its claims
                claims = batch.column("_claims").slice(at, 1).flatten()
                wanted = zip(claims.field("text").to_pylist(), claims.field("hint").to_pylist(), strict=True)
                found = locate(batch.column("_text")[at].as_py() or "", wanted, loose)
                ends = [pa.array([f and f[k] for f in found], pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*claims.flatten(), *ends], [*[f.name for f in claims.type], "start", "end"])

    return locating


def locate_claims(claims: DataFrame, papers: DataFrame, loose: bool = True, listed: int = CLAIMS_LISTED) -> DataFrame:
    """Claims with ``start`` and ``end`` in the text of their paper, null when not found.

    All claims of a list are found in one pass over the text, see
    ``evidence.functions.spans``. A paper with more than about ``listed`` claims
    is dealt out in several rows, each with its text and one list of claims.
    """
    names = [c for c in claims.columns if c not in ("start", "end")]
    claims = materialize(claims.select(*names), "claims")  # read twice below, but extracted once
    lists = claims.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / listed).alias("_lists"))
    dealt = claims.select(*names).join(lists, "doc_id").withColumn("_list", F.pmod(F.xxhash64(*names), "_lists"))
    rows = dealt.groupBy("doc_id", "_list").agg(F.collect_list(F.struct(*names)).alias("_claims"))
    texts = papers.select("doc_id", F.col("text").alias("_text"))
    shape = T.StructType([*claims.select(*names).schema.fields, T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return rows.join(texts, "doc_id").select("_text", "_claims").mapInArrow(_locating(loose), shape)


def citation_markers(texts: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return texts.select(*keys, F.explode(C.markers(F.col(text))).alias("marker"))


def marker_to_citation_id(markers: DataFrame) -> DataFrame:
    return markers.withColumn("citation_id", C.marker_id(F.col("marker")))


def map_citations(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Attach ``citation_id`` and parsed details when the marker names a bibliography entry."""
    wanted = claims.withColumn(
        "_marker_id", F.when(F.col("citation_found"), not_empty(C.marker_id(F.col("citation_text"))))
    )
    book = citations.select(
        "doc_id",
        F.col("citation_id").alias("_marker_id"),
        F.col("citation_id"),
        F.col("citation_text").alias("raw_citation_text"),
    )
    return (
        wanted.join(book, ["doc_id", "_marker_id"], "left")
        .drop("_marker_id")
        .withColumn("citation_details", F.when(F.col("citation_id").isNotNull(), C.details(F.col("raw_citation_text"))))
    )


def citation_details(citations: DataFrame) -> DataFrame:
    return citations.select("doc_id", "citation_id", C.details(F.col("citation_text")).alias("_details")).select(
        "doc_id", "citation_id", "_details.*"
    )


def doi_extract(citations: DataFrame) -> DataFrame:
    return citations.select("doc_id", "citation_id", C.doi(F.col("citation_text")).alias("doi"))


def class_rank() -> Column:
    """0 to 3: qualitative before quantitative, uncited before cited; any other type is quantitative."""
    cited = F.col("citation_id").isNotNull() & (F.col("citation_id") != "")
    qualitative = F.col("claim_type") == "qualitative"
    return cited.cast("int") * 2 + F.when(qualitative, F.lit(0)).otherwise(F.lit(1))


def order_claims(claims: DataFrame) -> DataFrame:
    """Claims with ``position``, their 1-based place in the processing order of their paper."""
    ranked = claims.withColumn("class_rank", class_rank())
    key = F.coalesce(F.col("citation_id"), F.lit(""))
    order = [F.col("class_rank"), key, F.col("seq")]
    bucket = [F.col("class_rank"), key, F.floor(F.col("seq") / F.lit(SEQ_BUCKET))]
    return rank_in_groups(ranked, ["doc_id"], order, bucket, "position")


def with_group_key(claims: DataFrame) -> DataFrame:
    return claims.withColumn("group_key", F.coalesce(not_empty(F.col("citation_id")), F.lit(K.NO_CITATION_KEY)))


def group_by_citation(claims: DataFrame) -> DataFrame:
    """One row per citation of a paper; the claims themselves stay rows (see ``with_group_key``)."""
    return (
        with_group_key(claims)
        .groupBy("doc_id", "group_key")
        .agg(
            F.count(F.lit(1)).alias("n_claims"),
            F.min_by("claim_id", "seq").alias("first_claim_id"),
            F.max_by("claim_id", "seq").alias("last_claim_id"),
        )
    )


def extraction_summary(claims: DataFrame) -> DataFrame:
    """Counts per paper, and for the corpus in the row whose ``doc_id`` is null."""
    return claims.rollup("doc_id").agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(F.col("claim_type") == "quantitative").alias("quantitative_claims"),
        F.count_if(F.col("claim_type") == "qualitative").alias("qualitative_claims"),
        F.count_if("citation_found").alias("claims_with_citations"),
    )
