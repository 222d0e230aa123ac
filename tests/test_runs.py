"""Whole runs on a small corpus."""

from pyspark.sql import functions as F

from evidence.plans import runs

TEXT = (
    "Whales sing at night [1]. Songs last 20 minutes [1]. Nobody hears them (Brown, 2019). "
    "Water is wet. Prices rose 5 percent. Boats make 9 kinds of noise [2].\n"
    "References\n1. Smith J. Songs of blue whales in winter. Nature. 2020.\n2. Brown A. Noise of boats and harbours. Sea. 2019.\n"
)


def test_extract_and_validate(spark):
    papers = spark.createDataFrame([(7, TEXT)], "doc_id bigint, text string")
    got = runs.extract(papers)
    claims = {r.claim_id: r for r in got.claims.collect()}
    assert len(claims) == 7 and claims["claim_0_0"].citation_id == "1" and claims["claim_0_2"].citation_id is None
    assert TEXT[claims["claim_0_1"].start:claims["claim_0_1"].end] == "Songs last 20 minutes [1]."

    frame = got.claims.where(F.col("text") != "References\n")
    reviews = spark.createDataFrame([(1, "Water  is wet.", "Incorrect", "P", "u")], "review_id bigint, claim_text string, textual_rating string, publisher string, url string")
    found = spark.createDataFrame(
        [(7, "claim_0_4", ("https://d.org", "data.gov", 0.7, "claim_0_4", 0))],
        "doc_id bigint, claim_id string, found_source struct<source_url:string,source_type:string,relevance_score:double,found_by_claim_id:string,reused_count:int>")
    attempts = spark.createDataFrame(
        [(7, "1", 1, "u1", "direct", True, None), (7, "2", 1, "u2", "direct", False, "403 Forbidden"), (7, "found_claim_0_4", 1, "d", "found_dataset", True, None)],
        "doc_id bigint, citation_id string, attempt_no int, url string, source string, downloaded boolean, error string")
    texts = spark.createDataFrame([(7, "1", "Whales sing at night. They rest by day.")], "doc_id bigint, citation_id string, source_text string")
    checks = spark.createDataFrame(
        [(7, "claim_0_4", True, True, 1.0, "measured", "d", None)],
        "doc_id bigint, claim_id string, validated boolean, passed boolean, confidence double, explanation string, dataset string, error string")

    def model(batch):
        return batch.assign(plausible=False, confidence=0.3, reasoning="unsure")

    done = runs.validate(frame, reviews, found, attempts, texts, checks, model)
    rows = {r.claim_id: (r.result_class, r.validation_method, r.passed) for r in done.results.collect()}
    assert rows == {
        "claim_0_0": ("qualitative_cited", "rag_search", True),
        "claim_0_1": ("quantitative_cited", "rag_search", False),
        "claim_0_2": ("qualitative_uncited", "truth_table+llm_check", False),
        "claim_0_3": ("qualitative_uncited", "truth_table+llm_check", True),
        "claim_0_4": ("quantitative_cited", "table_check", True),
        "claim_0_5": ("quantitative_cited", "rag_search", False),
    }
    stats = {r.result_class: (r["count"], r.passed) for r in done.stats.collect()}
    assert stats == {"qualitative_uncited": (2, 1), "quantitative_uncited": (0, 0), "qualitative_cited": (1, 1), "quantitative_cited": (3, 1)}
    assert done.batches.count() == 3
