"""Schemas of the persisted tables."""

CITATION_DETAILS = "struct<title:string,authors:array<string>,year:int,url:string,doi:string,raw_text:string>"
LOCATION = "struct<start:int,end:int,chunk_id:int>"
FOUND_SOURCE = (
    "struct<source_url:string,source_type:string,relevance_score:double,found_by_claim_id:string,"
    "reused_count:int,search_query:string,found_at:string>"
)
CLAIM = (
    "struct<claim_id:string,text:string,claim_type:string,citation_found:boolean,citation_id:string,"
    f"citation_text:string,citation_details:{CITATION_DETAILS},is_original:boolean,originally_uncited:boolean,"
    f"found_source:{FOUND_SOURCE},location_in_text:{LOCATION}>"
)
SUMMARY = (
    "struct<total_claims:bigint,quantitative_claims:bigint,qualitative_claims:bigint,claims_with_citations:bigint>"
)
CLAIMS_FILE = f"claims array<{CLAIM}>, citations map<string,string>, summary {SUMMARY}"
RESULT = (
    "claim_id string, claim_type string, originally_uncited boolean, validated boolean, validation_method string, "
    "confidence double, passed boolean, explanation string, sources_used array<string>, errors string, "
    "validation_metadata map<string,string>, validated_at timestamp"
)
ATTEMPT = "doc_id bigint, citation_id string, attempt_no int, url string, source string, downloaded boolean, error string"
MANIFEST_EVENT = (
    "doc_id bigint, citation_id string, seq bigint, kind string, at timestamp, winning_url string, "
    "batch_num_claims bigint, batch_download_successful boolean"
)
CHUNK = "doc_id bigint, chunk_id int, text string, start_pos int, end_pos int, token_count int"
EMPTY_SOURCE = f"CAST(NULL AS {FOUND_SOURCE})"
EMPTY_DETAILS = f"CAST(NULL AS {CITATION_DETAILS})"
EMPTY_LOCATION = f"CAST(NULL AS {LOCATION})"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
