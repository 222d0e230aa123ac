"""Claims, their mapping, routing and fact-checks."""

from pyspark.sql import functions as F

from catalog.documents import ABSTRACT_SQL, TITLE_SQL
from catalog.core import CTES, Inputs, WS, any_of, lit, marker_id, oracle, squeeze, strip
from evidence import constants as K
from evidence.operators import claims as C
from evidence.operators import documents, reporting, routing
from evidence.plans import runs


def bodies(i: Inputs):
    return documents.body_text(i.papers)


def chunks(i: Inputs):
    """Each body as one chunk, so claim numbers count the sentences of the paper."""
    return bodies(i).select(
        "doc_id", F.lit(0).alias("chunk_id"), F.col("body").alias("text"), F.lit(0).alias("start_pos")
    )


def raw_claims(i: Inputs):
    return C.extract_claims(chunks(i))


def citations(i: Inputs):
    return documents.extract_citations(i.papers)


def mapped(i: Inputs):
    return C.map_citations(raw_claims(i), citations(i))


def routed(i: Inputs):
    return routing.route_claims(mapped(i))


CLAIM_COLS = ["doc_id", "claim_id", "text", "claim_type", "citation_text"]


def claim_context(i):
    sections = documents.with_sections(i.papers)
    entries = documents.citation_last_wins(documents.parse_refs(sections))
    facts = i.view("abstract_papers").select(
        "doc_id", documents.title_of(F.col("text")).alias("title"), documents.abstract_of(F.col("text")).alias("abstract")
    )
    return C.claim_context(chunks(i), facts, entries).select("doc_id", "chunk_id", "title", "abstract_preview", "citation_list")


def model_answers(i):
    """Model answers made from each claim: wrapped, bare and broken ones."""
    return i.table("documents").select(
        "doc_id",
        F.lit(3).alias("chunk_id"),
        F.when(
            F.col("doc_id") % 3 == 0,
            F.to_json(F.struct(F.array(
                F.struct(F.col("text").alias("claim_text"), F.lit("quantitative").alias("claim_type"), F.lit("[1]").alias("citation_marker")),
                F.struct(F.col("lang").alias("claim_text"), F.lit(None).cast("string").alias("claim_type"), F.lit("null").alias("citation_marker")),
            ).alias("claims"))),
        )
        .when(F.col("doc_id") % 3 == 1, F.to_json(F.array(F.struct(F.col("text").alias("claim_text"), F.lit(True).alias("is_original")))))
        .otherwise(F.col("text"))
        .alias("answer"),
    )


def flagged(i):
    """Mapped claims where the measured shares are called original, which breaks the rule for cited ones."""
    return raw_claims(i).withColumn("is_original", F.contains("text", F.lit("percent was measured")))


def claim_constraint(i):
    good, bad = C.claim_constraint(flagged(i))
    keep = ["doc_id", "claim_id"]
    return good.select(*keep, F.lit("valid").alias("side")).unionByName(bad.select(*keep, F.lit("reject").alias("side")))


def located(i, loose=True):
    """Claims searched from 50 characters into the paper, with their line ends changed for the loose form."""
    claims = raw_claims(i).withColumn("hint", F.lit(50))
    if loose:
        claims = claims.withColumn("text", F.regexp_replace("text", WS + "+", "  "))
    return C.locate_claims(claims, bodies(i).withColumnRenamed("body", "text"), loose).select(
        "doc_id", "claim_id", "start", "end")


def reviews_claims(i):
    return routing.factcheck_lookup(i.view("lead_claims"), i.view("fact_reviews"))


def outcomes(i):
    return routing.factcheck_outcome(reviews_claims(i))


def plausible_stub(batch):
    """Longer claims sound more plausible; one length in 97 makes the call fail."""
    n = batch["text"].str.len()
    if (n % 97 == 0).any():
        raise RuntimeError("503 UNAVAILABLE")
    return batch.assign(plausible=n % 2 == 0, confidence=(n % 100) / 100.0, reasoning="Length " + n.astype(str))


def scored(i):
    """Fact-check outcome plus a plausibility that depends on the claim's length alone."""
    n = F.length("text")
    return outcomes(i).withColumns(
        {
            "plausible": n % 2 == 0,
            "plausible_confidence": (n % 100) / F.lit(100.0),
            "reasoning": F.concat(F.lit("Length "), n.cast("string")),
        }
    )


def found_sources(i):
    """Datasets found for two claims in three."""
    return i.view("lead_claims").where(F.col("doc_id") % 9 != 0).select(
        "doc_id", "claim_id",
        F.struct(
            F.concat(F.lit("https://data.example.org/"), "doc_id").alias("source_url"),
            F.lit("data.gov").alias("source_type"),
            F.lit(0.7).alias("relevance_score"),
            F.col("claim_id").alias("found_by_claim_id"),
            F.lit(0).alias("reused_count"),
        ).alias("found_source"),
    )


def triage(i):
    return routing.triage_quant_uncited(scored(i).where(F.col("claim_type") == "quantitative"), found_sources(i))


RESULT_COLS = ["doc_id", "claim_id", "claim_type", "originally_uncited", "validated", "validation_method",
               "passed", "confidence", "explanation"]


def triage_rows(i):
    searched, direct = triage(i)
    return direct.select(*RESULT_COLS).unionByName(
        searched.select("doc_id", "claim_id", "claim_type", F.lit("routed").alias("validation_method")),
        allowMissingColumns=True,
    )


def promoted(i):
    return routing.promote_found_source(triage(i)[0])


def quant_cited(i):
    """Promoted claims and, as cited in the paper, the quantitative claims of ``papers``."""
    base = ["doc_id", "claim_id", "citation_id", "citation_text", "found_source"]
    cited = mapped(i).where((F.col("claim_type") == "quantitative") & F.col("citation_id").isNotNull())
    return routing.union_quant_cited(
        promoted(i).select(*base), cited.select("doc_id", "claim_id", "citation_id", "citation_text")
    )


KEY = f"lower({squeeze('%s')})"
FACTS = {
    "matches": (
        ("lead_claims", "fact_reviews"),
        f"""SELECT c.*, r.review_id, r.textual_rating, r.publisher, r.url, CASE WHEN r.review_id IS NOT NULL THEN 0.8::DOUBLE END AS similarity
FROM (SELECT *, {KEY % 'text'} AS k FROM lead_claims) c
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {KEY % 'claim_text'} ORDER BY review_id) AS rn, {KEY % 'claim_text'} AS k FROM fact_reviews) r
 ON r.k = c.k AND r.rn = 1""",
    ),
    "similar_matches": (
        ("reworded_claims", "fact_reviews"),
        f"""SELECT c.*, r.review_id, r.textual_rating, r.publisher, r.url, b.similarity
FROM reworded_claims c LEFT JOIN (
 SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY similarity DESC, review_id) AS rn FROM (
  SELECT claim_id, review_id, count(*) / (any_value(n) + any_value(m) - count(*))::DOUBLE AS similarity
  FROM (SELECT claim_id, len(w) AS n, unnest(w) AS t FROM (SELECT claim_id, list_distinct(string_split({KEY % 'text'}, ' ')) AS w FROM reworded_claims)) x
  JOIN (SELECT review_id, len(w) AS m, unnest(w) AS t FROM (SELECT review_id, list_distinct(string_split({KEY % 'claim_text'}, ' ')) AS w FROM fact_reviews)) y USING (t)
  WHERE t <> '' GROUP BY claim_id, review_id) WHERE similarity >= 0.8) b ON b.claim_id = c.claim_id AND b.rn = 1
LEFT JOIN fact_reviews r ON r.review_id = b.review_id""",
    ),
    "outcomes": (
        ("matches",),
        f"""SELECT *, review_id IS NOT NULL AS found,
 CASE WHEN review_id IS NOT NULL THEN least(similarity * CASE WHEN {any_of('lower(textual_rating)', K.CLEAR_RATINGS)} THEN 0.9::DOUBLE WHEN {any_of('lower(textual_rating)', K.HEDGED_RATINGS)} THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END, 1.0) ELSE 0.0::DOUBLE END AS fact_confidence,
 CASE WHEN review_id IS NULL THEN 'No matching fact checks found' ELSE concat('Fact check found: ''', textual_rating, ''' by ', publisher) END AS fact_explanation
FROM matches""",
    ),
    "scored": (
        ("outcomes",),
        """SELECT *, length(text) % 2 = 0 AS plausible, (length(text) % 100) / 100.0::DOUBLE AS plausible_confidence, concat('Length ', length(text)) AS reasoning FROM outcomes""",
    ),
    "strong": (
        ("scored",),
        """SELECT *, (found AND fact_confidence > 0.8) OR (plausible AND plausible_confidence > 0.8) AS is_strong FROM scored WHERE claim_type = 'quantitative'""",
    ),
    "promoted": (
        ("strong",),
        """SELECT doc_id, claim_id, concat('found_', claim_id) AS citation_id, '[Found: data.gov]' AS citation_text, 'Dataset from data.gov' AS title,
 concat('https://data.example.org/', doc_id) AS url, concat('Found dataset: https://data.example.org/', doc_id) AS raw_text
FROM strong WHERE NOT is_strong AND doc_id % 9 <> 0""",
    ),
}

CTES.update(FACTS)
CTES["titles"] = (
    ("abstract_papers",),
    f"SELECT t.doc_id, title, abstract FROM ({TITLE_SQL}) t JOIN ({ABSTRACT_SQL}) a ON a.doc_id = t.doc_id",
)

_SPAN = """SELECT c.doc_id, claim_id, {exact} AS start, {exact} + length(c.text) AS "end"
FROM raw_claims c JOIN sections s ON s.doc_id = c.doc_id"""
_EXACT = "CASE WHEN strpos(substring(s.body, 51), c.text) > 0 THEN strpos(substring(s.body, 51), c.text) + 49 WHEN strpos(s.body, c.text) > 0 THEN strpos(s.body, c.text) - 1 END"
# In RE2 the words of a claim, quoted and joined by a whitespace class, find the same span.
_PATTERN = f"array_to_string(list_transform(list_filter(regexp_split_to_array({strip('c.text')}, {lit(WS + '+')}), lambda x: x <> ''), lambda x: regexp_escape(x)), {lit(WS + '+')})"
_LOOSE = f"""
SELECT doc_id, claim_id, CASE WHEN hit <> '' THEN strpos(tail, hit) + 49 WHEN again <> '' THEN strpos(body, again) - 1 END AS start,
 CASE WHEN hit <> '' THEN strpos(tail, hit) + 49 + length(hit) WHEN again <> '' THEN strpos(body, again) - 1 + length(again) END AS "end"
FROM (SELECT *, regexp_extract(tail, p, 0) AS hit, regexp_extract(body, p, 0) AS again FROM (
 SELECT c.doc_id, claim_id, {_PATTERN} AS p, s.body, substring(s.body, 51) AS tail FROM raw_claims c JOIN sections s ON s.doc_id = c.doc_id))"""
_CONTEXT = f"""
SELECT s.doc_id, 0::BIGINT AS chunk_id, title, abstract AS abstract_preview, citation_list
FROM sections s LEFT JOIN titles t ON t.doc_id = s.doc_id LEFT JOIN (
 SELECT doc_id, string_agg(concat(citation_id, ': ', citation_text), chr(10) ORDER BY rn) AS citation_list
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, citation_id) AS rn FROM book) GROUP BY doc_id) l ON l.doc_id = s.doc_id"""

QUERIES = {
    "claim_coverage": (
        lambda i: runs.coverage(i.papers).select("doc_id", "result_class", "n_claims", "n_backed", F.col("gid").alias("level")),
        oracle(
            """SELECT doc_id, result_class, count(*) AS n_claims, count(citation_id) AS n_backed, cast(grouping(doc_id, result_class) AS bigint) AS level
FROM claims GROUP BY GROUPING SETS ((doc_id, result_class), (result_class), ())""",
            "claims",
        ),
    ),
    "extract_claims": (
        lambda i: raw_claims(i).select(*CLAIM_COLS),
        oracle("SELECT doc_id, claim_id, text, claim_type, citation_text FROM raw_claims", "raw_claims"),
    ),
    "claim_context": (
        claim_context,
        oracle(_CONTEXT, "sections", "book", "titles"),
    ),
    "normalize_claim_json": (
        lambda i: C.normalize_claim_json(model_answers(i)).select(
            "doc_id", "claim_id", "text", "claim_type", "citation_text", "citation_found", "is_original"),
        """SELECT doc_id, 'claim_3_0' AS claim_id, text, CASE doc_id % 3 WHEN 0 THEN 'quantitative' ELSE 'qualitative' END AS claim_type,
 CASE doc_id % 3 WHEN 0 THEN '[1]' END AS citation_text, doc_id % 3 = 0 AS citation_found, doc_id % 3 = 1 AS is_original FROM documents WHERE doc_id % 3 < 2
UNION ALL SELECT doc_id, 'claim_3_1', lang, 'qualitative', NULL, false, false FROM documents WHERE doc_id % 3 = 0""",
    ),
    "claim_constraint": (
        claim_constraint,
        oracle(
            """SELECT doc_id, claim_id, CASE WHEN contains(text, 'percent was measured') AND citation_text IS NOT NULL THEN 'reject' ELSE 'valid' END AS side FROM raw_claims""",
            "raw_claims",
        ),
    ),
    "locate_claim_exact": (
        lambda i: located(i, loose=False),
        oracle(_SPAN.format(exact=_EXACT), "raw_claims", "sections"),
    ),
    "locate_claim_ws": (
        lambda i: located(i, loose=True),
        oracle(_LOOSE, "raw_claims", "sections"),
    ),
    "citation_markers": (
        lambda i: C.citation_markers(i.papers),
        oracle(
            f"""SELECT DISTINCT doc_id, unnest(list_concat(regexp_extract_all(text, {lit(K.NUMERIC_MARKER)}), regexp_extract_all(text, {lit(K.AUTHOR_MARKER)}))) AS marker FROM papers""",
            "papers",
        ),
    ),
    "marker_to_citation_id": (
        lambda i: C.marker_to_citation_id(
            C.citation_markers(i.papers).unionByName(
                i.table("documents").select("doc_id", F.concat(F.lit("["), "source", F.lit("]")).alias("marker")))),
        oracle(
            f"""SELECT doc_id, marker, {marker_id('marker')} AS citation_id FROM (
 SELECT DISTINCT doc_id, unnest(list_concat(regexp_extract_all(text, {lit(K.NUMERIC_MARKER)}), regexp_extract_all(text, {lit(K.AUTHOR_MARKER)}))) AS marker FROM papers
 UNION ALL SELECT doc_id, concat('[', source, ']') FROM documents)""",
            "papers",
        ),
    ),
    "map_citations": (
        lambda i: mapped(i).select(
            "doc_id", "claim_id", "citation_text", "citation_id", "raw_citation_text",
            F.col("citation_details.year").alias("year"), F.col("citation_details.doi").alias("doi")),
        oracle(
            r"""SELECT doc_id, claim_id, citation_text, citation_id, raw_citation_text,
 try_cast(nullif(regexp_extract(raw_citation_text, '([0-9]{4})', 1), '') AS bigint) AS year,
 rtrim(nullif(regexp_extract(raw_citation_text, '(?i)doi[:\s]*(10\.\S+)', 1), ''), '.') AS doi FROM claims""",
            "claims",
        ),
    ),
    "citation_details": (
        lambda i: C.citation_details(citations(i)).select(
            "doc_id", "citation_id", "year", "doi", "url", F.element_at("authors", 1).alias("author"), "raw_text"),
        oracle(
            r"""SELECT doc_id, citation_id, citation_text AS raw_text, try_cast(nullif(regexp_extract(citation_text, '([0-9]{4})', 1), '') AS bigint) AS year,
 rtrim(nullif(regexp_extract(citation_text, '(?i)doi[:\s]*(10\.\S+)', 1), ''), '.') AS doi,
 rtrim(nullif(regexp_extract(citation_text, 'https?://\S+', 0), ''), '.,;') AS url,
 CASE WHEN regexp_matches(citation_text, '[0-9]{4}') THEN rtrim(trim(string_split_regex(trim(regexp_extract(citation_text, '(?s)^(.*?)(?:\([0-9]{4}\)|[0-9]{4})', 1)), '[,;&]')[1]), '.') END AS author
FROM citations""",
            "citations",
        ),
    ),
    "doi_extract": (
        lambda i: C.doi_extract(citations(i)),
        oracle(
            r"""SELECT doc_id, citation_id, rtrim(nullif(regexp_extract(citation_text, '(?i)\b(10\.[0-9]{4,}/\S+?)(?:[,\s)\]}]|$)', 1), ''), '.') AS doi FROM citations""",
            "citations",
        ),
    ),
    "order_claims": (
        lambda i: C.order_claims(mapped(i)).select("doc_id", "claim_id", "class_rank", "position"),
        oracle(
            """SELECT doc_id, claim_id, class_rank, row_number() OVER (PARTITION BY doc_id ORDER BY class_rank, coalesce(citation_id, ''), seq) AS position
FROM (SELECT *, cast(CASE WHEN citation_id IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN claim_type = 'qualitative' THEN 0 ELSE 1 END AS bigint) AS class_rank FROM claims)""",
            "claims",
        ),
    ),
    "group_by_citation": (
        lambda i: C.group_by_citation(mapped(i)),
        oracle(
            """SELECT doc_id, coalesce(citation_id, '_no_citation') AS group_key, count(*) AS n_claims, arg_min(claim_id, seq) AS first_claim_id, arg_max(claim_id, seq) AS last_claim_id
FROM claims GROUP BY 1, 2""",
            "claims",
        ),
    ),
    "extraction_summary": (
        lambda i: C.extraction_summary(raw_claims(i)),
        oracle(
            """SELECT doc_id, count(*) AS total_claims, count(*) FILTER (WHERE claim_type = 'quantitative') AS quantitative_claims,
 count(*) FILTER (WHERE claim_type = 'qualitative') AS qualitative_claims, count(citation_text) AS claims_with_citations FROM raw_claims GROUP BY ROLLUP (doc_id)""",
            "raw_claims",
        ),
    ),
    "route_claims": (
        lambda i: routed(i).select("doc_id", "claim_id", "citation_id", "result_class"),
        oracle("SELECT doc_id, claim_id, citation_id, result_class FROM claims", "claims"),
    ),
    "factcheck_lookup": (
        lambda i: reviews_claims(i),
        oracle("SELECT doc_id, claim_id, text, claim_type, review_id, textual_rating, publisher, url, similarity FROM matches", "matches"),
    ),
    "factcheck_similar": (
        lambda i: routing.factcheck_similar(i.view("reworded_claims"), i.view("fact_reviews")).withColumn("similarity", F.round("similarity", 6)),
        oracle("SELECT doc_id, claim_id, text, review_id, textual_rating, publisher, url, round(similarity, 6) AS similarity FROM similar_matches", "similar_matches"),
    ),
    "factcheck_outcome": (
        lambda i: outcomes(i).select("doc_id", "claim_id", "found", "fact_confidence", "fact_explanation"),
        oracle("SELECT doc_id, claim_id, found, fact_confidence, fact_explanation FROM outcomes", "outcomes"),
    ),
    "interpret_rating": (
        lambda i: routing.interpret_rating(i.view("fact_reviews")).select("review_id", "textual_rating", "rating_passes"),
        oracle(f"SELECT review_id, textual_rating, {any_of('lower(textual_rating)', K.POSITIVE_RATINGS)} AS rating_passes FROM fact_reviews", "fact_reviews"),
    ),
    "rating_confidence": (
        lambda i: routing.rating_scores(i.view("fact_reviews")).select("review_id", F.round("confidence", 6).alias("confidence")),
        oracle(
            f"""SELECT review_id, round(least(0.8::DOUBLE * CASE WHEN {any_of('lower(textual_rating)', K.CLEAR_RATINGS)} THEN 0.9 WHEN {any_of('lower(textual_rating)', K.HEDGED_RATINGS)} THEN 0.6 ELSE 0.4 END, 1.0), 6) AS confidence FROM fact_reviews""",
            "fact_reviews",
        ),
    ),
    "plausibility": (
        lambda i: routing.plausibility(i.view("lead_claims"), plausible_stub).select(
            "doc_id", "claim_id", "plausible", "plausible_confidence", "reasoning", "error"),
        oracle(
            """SELECT doc_id, claim_id, n % 97 <> 0 AND n % 2 = 0 AS plausible, CASE WHEN n % 97 = 0 THEN 0.0 ELSE (n % 100) / 100.0::DOUBLE END AS plausible_confidence,
 CASE WHEN n % 97 = 0 THEN 'Verification error: 503 UNAVAILABLE' ELSE concat('Length ', n) END AS reasoning, CASE WHEN n % 97 = 0 THEN '503 UNAVAILABLE' END AS error
FROM (SELECT *, length(text) AS n FROM lead_claims)""",
            "lead_claims",
        ),
    ),
    "combine_uncited": (
        lambda i: routing.combine_uncited(scored(i)).select(*RESULT_COLS),
        oracle(
            """SELECT doc_id, claim_id, claim_type, false AS originally_uncited, true AS validated, 'truth_table+llm_check' AS validation_method, found OR plausible AS passed,
 greatest(fact_confidence, plausible_confidence) AS confidence, concat('Truth Table: ', fact_explanation, '. LLM Check: ', reasoning) AS explanation FROM scored""",
            "scored",
        ),
    ),
    "triage_quant_uncited": (
        triage_rows,
        oracle(
            """SELECT doc_id, claim_id, claim_type, false AS originally_uncited, true AS validated, 'truth_table+llm_only' AS validation_method, found OR plausible AS passed,
 greatest(fact_confidence, plausible_confidence) AS confidence, concat('Truth Table: ', fact_explanation, '. LLM Check: ', reasoning) AS explanation FROM strong WHERE is_strong
UNION ALL SELECT doc_id, claim_id, claim_type, CASE WHEN doc_id % 9 = 0 THEN true END, CASE WHEN doc_id % 9 = 0 THEN false END, CASE WHEN doc_id % 9 = 0 THEN 'source_not_found' ELSE 'routed' END,
 CASE WHEN doc_id % 9 = 0 THEN false END, CASE WHEN doc_id % 9 = 0 THEN 0.0 END, CASE WHEN doc_id % 9 = 0 THEN 'No dataset source could be located for this uncited quantitative claim.' END FROM strong WHERE NOT is_strong""",
            "strong",
        ),
    ),
    "promote_found_source": (
        lambda i: promoted(i).select(
            "doc_id", "claim_id", "citation_id", "citation_text", F.col("citation_details.title").alias("title"),
            F.col("citation_details.url").alias("url"), F.col("citation_details.raw_text").alias("raw_text")),
        oracle("SELECT * FROM promoted", "promoted"),
    ),
    "union_quant_cited": (
        lambda i: quant_cited(i).select("doc_id", "claim_id", "citation_id", "citation_text", "origin_rank"),
        oracle(
            """SELECT doc_id, claim_id, citation_id, citation_text, 0::BIGINT AS origin_rank FROM promoted
UNION ALL SELECT doc_id, claim_id, citation_id, citation_text, 1 FROM claims WHERE result_class = 'quantitative_cited'""",
            "promoted", "claims",
        ),
    ),
    "split_backing": (
        lambda i: routing.split_backing(quant_cited(i)).groupBy("backing", "doc_id").agg(F.count(F.lit(1)).alias("n_claims")),
        oracle(
            """SELECT backing, doc_id, count(*) AS n_claims FROM (SELECT 'dataset' AS backing, doc_id FROM promoted
 UNION ALL SELECT 'paper', doc_id FROM claims WHERE result_class = 'quantitative_cited') GROUP BY 1, 2""",
            "promoted", "claims",
        ),
    ),
}
