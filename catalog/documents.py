"""Sources, documents and chunks."""

from pyspark.sql import functions as F

from catalog.core import Inputs, SPACES, any_of, lit, oracle, sentences, strip, tokens, upper_case
from evidence import constants as K
from evidence.operators import chunking, documents as D


def _sections(i: Inputs):
    return D.with_sections(i.papers).select("doc_id", "text", "ref_section", "style", "body")


def _parsed(i: Inputs):
    return D.citation_last_wins(D.parse_refs(_sections(i)))


def assemble_pages(i):
    return D.assemble_pages(i.table("conversations"), "conv_id", "turn", "text")


def parse_refs_model(i):
    """The stand-in model returns two entries made from the length of what it reads."""

    def stub(batch):
        n = batch["model_input"].str.len().astype(str)
        return batch.assign(answer='{"citations": {"1": "Entry of ' + n + ' characters", "Smith": "Another entry"}}')

    s = _sections(i)
    return D.parse_refs_model(D.citation_route(s, D.validate_bibliography(_parsed(i))), stub)


_L = "list_transform(string_split(text, chr(10)), lambda x: " + strip("x") + ")"
_STOP = f"(({upper_case('x')} AND length(x) > 5) OR {any_of('lower(x)', K.ABSTRACT_STOPS)})"
_FOLLOW = "list_filter(l[i + 1:], lambda x: x <> '')"
_AT = f"list_position(list_transform(f, lambda x: {_STOP}), true)"

def char_chunks_of(table: str, key: str, text: str) -> str:
    fold = f"""
list_reduce(
 list_transform(list_filter(list_transform(string_split(replace({text}, chr(10), ' '), '. '), lambda x: {strip('x')}), lambda x: x <> ''),
  lambda x: {{'done': []::VARCHAR[], 'cur': [x], 'used': length(x)}}),
 lambda a, x: CASE WHEN a.used + x.used > {K.CHUNK_CHARS} AND len(a.cur) > 0
  THEN {{'done': list_append(a.done, array_to_string(a.cur, '. ') || '.'), 'cur': [a.cur[-1], x.cur[1]], 'used': length(a.cur[-1]) + x.used}}
  ELSE {{'done': a.done, 'cur': list_append(a.cur, x.cur[1]), 'used': a.used + x.used}} END,
 {{'done': []::VARCHAR[], 'cur': []::VARCHAR[], 'used': 0::BIGINT}})"""
    return f"""
SELECT {key}, unnest(l) AS chunk_text, generate_subscripts(l, 1) - 1 AS chunk_no FROM (
 SELECT {key}, CASE WHEN len(r.cur) > 0 THEN list_append(r.done, array_to_string(r.cur, '. ') || '.') ELSE r.done END AS l
 FROM (SELECT {key}, {fold} AS r FROM {table}))"""


# Token chunks as a recursive walk over numbered sentences: one row per document and step.
_TOKEN_CHUNKS = f"""
WITH RECURSIVE parts AS (
 SELECT doc_id, list_transform({sentences('text')}, lambda x: {{'s': x, 'n': {tokens('x')}}}) AS l FROM documents),
walk AS (
 SELECT doc_id, l, 1::BIGINT AS first, 1::BIGINT AS nxt, l[1].n AS used, 0::BIGINT AS pos, 0::BIGINT AS chunk_id,
  NULL::STRUCT(t VARCHAR, p BIGINT, u BIGINT, c BIGINT) AS emit FROM parts
 UNION ALL
 SELECT doc_id, l,
  CASE WHEN full_ THEN first + keep ELSE first END, nxt + 1,
  CASE WHEN full_ THEN cast(list_sum(list_transform(l[first + keep:nxt + 1], lambda z: z.n)) AS BIGINT) ELSE used + coalesce(l[nxt + 1].n, 0) END,
  CASE WHEN full_ THEN pos + length(body) - back ELSE pos END,
  CASE WHEN full_ THEN chunk_id + 1 ELSE chunk_id END,
  CASE WHEN full_ THEN {{'t': body, 'p': pos, 'u': used, 'c': chunk_id}} END
 FROM (SELECT *, CASE WHEN length(body) >= {K.CHUNK_OVERLAP_CHARS} THEN length(array_to_string(list_transform(l[first + keep:nxt], lambda z: z.s), ' ')) ELSE -1 END AS back
  FROM (SELECT *, CASE WHEN NOT full_ THEN 0 WHEN length(body) < {K.CHUNK_OVERLAP_CHARS} THEN nxt - first + 1
    ELSE nxt - first + 1 - len(list_filter(range(first, nxt + 1), lambda k: length(array_to_string(list_transform(l[k:nxt], lambda z: z.s), ' ')) <= {K.CHUNK_OVERLAP_CHARS})) END AS keep
   FROM (SELECT *, nxt = len(l) OR used + l[nxt + 1].n > 120 AS full_, array_to_string(list_transform(l[first:nxt], lambda z: z.s), ' ') AS body
    FROM walk WHERE nxt <= len(l))))
)
SELECT doc_id, emit.c AS chunk_id, emit.t AS text, emit.p AS start_pos, emit.p + length(emit.t) AS end_pos, emit.u AS token_count
FROM walk WHERE emit IS NOT NULL"""

TITLE_SQL = f"SELECT doc_id, list_filter({_L}, lambda x: length(x) > 10 AND NOT {upper_case('x')})[1] AS title FROM abstract_papers"
ABSTRACT_SQL = f"""SELECT doc_id, array_to_string(arg_min(b, i) FILTER (WHERE len(b) > 0), ' ') AS abstract FROM (
 SELECT doc_id, i, CASE WHEN {_AT} IS NULL OR {_AT} = 0 THEN f ELSE f[1:{_AT} - 1] END AS b FROM (
  SELECT doc_id, i, CASE WHEN {any_of('lower(l[i])', K.ABSTRACT_WORDS)} THEN {_FOLLOW} ELSE [] END AS f FROM (
   SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_L} AS l FROM abstract_papers))))
GROUP BY doc_id"""

QUERIES = {
    "assemble_pages": (
        assemble_pages,
        "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id",
    ),
    "paper_title": (
        lambda i: D.paper_title(i.view("abstract_papers").unionByName(
            i.papers.withColumn("doc_id", -F.col("doc_id") - 1))),
        oracle(
            f"""SELECT doc_id, list_filter({_L}, lambda x: length(x) > 10 AND NOT {upper_case('x')})[1] AS title
FROM (SELECT * FROM abstract_papers UNION ALL SELECT -doc_id - 1, text FROM papers)""",
            "abstract_papers", "papers",
        ),
    ),
    "paper_abstract": (
        lambda i: D.paper_abstract(i.view("abstract_papers")),
        oracle(
            ABSTRACT_SQL,
            "abstract_papers",
        ),
    ),
    "reference_section": (
        lambda i: D.reference_section(i.papers), oracle("SELECT doc_id, ref_section FROM sections", "sections")),
    "body_text": (lambda i: D.body_text(i.papers), oracle("SELECT doc_id, body FROM sections", "sections")),
    "citation_style": (
        lambda i: D.citation_style(_sections(i)), oracle("SELECT doc_id, style FROM sections", "sections")),
    "parse_refs_numeric": (
        lambda i: D.parse_refs_numeric(_sections(i)),
        oracle("SELECT doc_id, cast(pos AS bigint) AS pos, citation_id, citation_text FROM numeric_entries", "numeric_entries")),
    "parse_refs_bracket": (
        lambda i: D.parse_refs_bracket(_sections(i)),
        oracle("SELECT doc_id, cast(pos AS bigint) AS pos, citation_id, citation_text FROM bracket_entries", "bracket_entries")),
    "parse_refs_apa": (
        lambda i: D.parse_refs_apa(_sections(i)),
        oracle("SELECT doc_id, cast(pos AS bigint) AS pos, citation_id, citation_text FROM apa_entries", "apa_entries")),
    "citation_last_wins": (
        _parsed, oracle("SELECT doc_id, citation_id, citation_text, cast(pos AS bigint) AS pos, n_entries FROM book", "book")),
    "validate_bibliography": (
        lambda i: D.validate_bibliography(_parsed(i)), oracle("SELECT * FROM validity", "validity")),
    "parse_refs_model": (
        parse_refs_model,
        oracle(
            """SELECT doc_id, cast(pos AS bigint) AS pos, citation_id, CASE pos WHEN 0 THEN concat('Entry of ', length(model_input), ' characters') ELSE 'Another entry' END AS citation_text
FROM (SELECT s.doc_id, coalesce(nullif(ref_section, ''), text) AS model_input FROM sections s LEFT JOIN validity v ON v.doc_id = s.doc_id WHERE NOT coalesce(is_valid, false))
CROSS JOIN (VALUES (0, '1'), (1, 'Smith')) e(pos, citation_id)""",
            "sections", "validity",
        ),
    ),
    "citation_extract_route": (
        lambda i: D.citation_route(_sections(i), D.validate_bibliography(_parsed(i))),
        oracle(
            """SELECT s.doc_id, style, CASE WHEN coalesce(is_valid, false) THEN 'parsed' ELSE 'model' END AS route,
 CASE WHEN NOT coalesce(is_valid, false) THEN coalesce(nullif(ref_section, ''), text) END AS model_input
FROM sections s LEFT JOIN validity v ON v.doc_id = s.doc_id""",
            "sections", "validity",
        ),
    ),
    "sentence_split": (
        lambda i: chunking.sentence_split(i.table("documents")),
        f"SELECT doc_id, unnest(l) AS sentence, cast(generate_subscripts(l, 1) - 1 AS bigint) AS sentence_no FROM (SELECT doc_id, {sentences('text')} AS l FROM documents)",
    ),
    "count_tokens": (
        lambda i: chunking.count_tokens(i.table("documents")),
        f"SELECT doc_id, cast({tokens('text')} AS bigint) AS token_count FROM documents",
    ),
    "chunk_by_tokens": (
        lambda i: chunking.chunk_by_tokens(i.table("documents"), size=120), _TOKEN_CHUNKS),
    "chunk_by_chars": (lambda i: chunking.chunk_by_chars(i.table("documents")), char_chunks_of("documents", "doc_id", "text")),
}
