"""Inputs derived from the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from evidence import constants as K
from evidence.session import materialize, spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TEXT_TABLES = ("documents", "pages")

VIEWS = {
    # Papers with markers, a reference section in three styles, a quarter without references.
    "papers": """
SELECT d.doc_id, concat(d.text, chr(10), chr(10), 'Share number ', d.doc_id % 100, ' percent was measured [1]. ',
 'Prior work agrees with this (Brown et al., 2019). ', 'No source is given for this one.', chr(10),
 CASE d.doc_id % 4
  WHEN 0 THEN concat('References', chr(10), '1. Smith AB. ', b.title, '. Nature. 2020. doi: 10.1234/d', d.doc_id, '.', chr(10), '2. Brown C. Trends. Science. 2019. https://example.com/p', d.doc_id, ';')
  WHEN 1 THEN concat('REFERENCES', chr(10), '[1] Smith AB. ', b.title, '. Nature. 2020.', chr(10), '[2] Brown C. Trends. Science. 2019.')
  WHEN 2 THEN concat('Bibliography', chr(10), 'Smith, J. (2020). ', b.title, '. Nature.', chr(10), 'Brown, A. (2019). Trends in one', chr(10), 'and two. Science.', chr(10), 'Brown, A. (2021). A second entry of one author. Cell.')
  ELSE '' END) AS text
FROM {documents} d JOIN (SELECT item_id, replace(replace(text, '.', ''), chr(10), ' ') AS title FROM {benchmark}) b ON b.item_id = d.doc_id % 40""",
    # Papers that open with a title and an abstract.
    "abstract_papers": """
SELECT d.doc_id, concat('A title of paper ', d.doc_id, chr(10), CASE d.doc_id % 3 WHEN 0 THEN 'Abstract' WHEN 1 THEN 'EXECUTIVE SUMMARY' ELSE 'Synopsis:' END, chr(10),
 replace(d.text, '. ', concat('.', chr(10))), chr(10), CASE d.doc_id % 2 WHEN 0 THEN 'KEYWORDS' ELSE '1. Background' END, chr(10), d.text) AS text
FROM {documents} d""",
    "fact_reviews": """
SELECT d.doc_id AS review_id, d.text AS claim_text,
 CASE WHEN l.quality = 1 AND d.doc_id % 2 = 0 THEN 'True' WHEN l.quality = 1 THEN 'Mostly true' WHEN l.toxic = 1 THEN 'Incorrect' WHEN d.doc_id % 2 = 0 THEN 'Partly supported' ELSE 'Unproven' END AS textual_rating,
 d.source AS publisher, concat('https://reviews.example.org/', d.doc_id) AS url
FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id""",
    # All documents as claims, to be looked up among the reviews.
    "lead_claims": """
SELECT doc_id, concat('claim_0_', doc_id) AS claim_id, text,
 CASE WHEN doc_id % 3 = 0 THEN 'quantitative' ELSE 'qualitative' END AS claim_type
FROM {documents}""",
    # The same claims, two in three of them reworded.
    "reworded_claims": """
SELECT doc_id, concat('claim_0_', doc_id) AS claim_id,
 CASE doc_id % 3 WHEN 0 THEN concat('  ', translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) WHEN 1 THEN concat('Reported in ', source, ': ', replace(text, '. ', ' ')) ELSE concat(text, chr(10), 'Nobody has disputed claim ', doc_id) END AS text
FROM {documents}""",
    "attempts": """
SELECT doc_id, citation_id, cast(row_number() OVER (PARTITION BY doc_id, citation_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS int) AS attempt_no,
 concat('https://mirror', l_suppkey, '.example.org/', l_partkey) AS url, CASE WHEN l_linenumber = 1 THEN 'direct' ELSE 'open_access' END AS source,
 l_returnflag = 'R' AS downloaded, CASE l_returnflag WHEN 'R' THEN NULL WHEN 'A' THEN '403 Forbidden' ELSE '503 UNAVAILABLE' END AS error
FROM (SELECT l_orderkey AS doc_id, concat('', l_suppkey % 3) AS citation_id, * FROM {lineitem}) x""",
    "oa_locations": """
SELECT doi, cast(row_number() OVER (PARTITION BY doi ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS int) AS pos, host_type, url_for_pdf, url_for_landing_page
FROM (SELECT concat('10.1234/', l_orderkey) AS doi, CASE l_returnflag WHEN 'R' THEN 'repository' ELSE 'publisher' END AS host_type,
 CASE WHEN l_linestatus = 'O' THEN concat('https://h', l_suppkey, '.example.org/', l_partkey, '.pdf') END AS url_for_pdf,
 CASE WHEN l_partkey % 5 <> 0 THEN concat('https://h', l_suppkey, '.example.org/', l_partkey) END AS url_for_landing_page, * FROM {lineitem}) x""",
    "usage": """
SELECT event_id, ts, concat('task_', event_type) AS task, cast(floor(abs(value) * 100) AS bigint) AS input_tokens, cast(floor(abs(value) * 20) AS bigint) AS output_tokens FROM {events}""",
    "dataset_catalog": """
SELECT p_partkey AS dataset_id, p_name AS title, concat(p_type, ' ', p_brand) AS notes, CASE p_size % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' WHEN 2 THEN 'json' ELSE NULL END AS format,
 concat('https://data.example.org/', p_partkey) AS resource_url FROM {part}""",
    # One claim per order line, worded with the part it is about.
    "data_claims": """
SELECT l_orderkey AS doc_id, concat('claim_', l_linenumber, '_', seq) AS claim_id, seq,
 concat('Sales of the ', p_name, ' in ', lower(p_type), ' rose by ', cast(l_quantity AS int), ' percent.') AS text, 'quantitative' AS claim_type
FROM (SELECT *, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS bigint) AS seq FROM {lineitem}) x
JOIN {part} ON p_partkey = l_partkey""",
    # Each document with one benchmark item as its claim.
    "pairs_assigned": """
SELECT b.item_id, d.doc_id FROM {benchmark} b JOIN {documents} d ON d.doc_id % 40 = b.item_id""",
    # Fetched payloads: one branch of the sniffers per document, over its whole text.
    "payloads": """
SELECT doc_id,
 CASE doc_id % 14 WHEN 0 THEN 'https://a.example.org/data.csv' WHEN 1 THEN 'https://a.example.org/t.JSON' WHEN 2 THEN 'https://a.example.org/book.xlsx' WHEN 3 THEN 'https://a.example.org/book.xls' WHEN 4 THEN 'https://a.example.org/p.pdf' WHEN 5 THEN 'https://a.example.org/x.htm' ELSE concat('https://a.example.org/', doc_id) END AS url,
 CASE doc_id % 14 WHEN 6 THEN 'text/html; charset=utf-8' WHEN 7 THEN 'application/pdf' WHEN 8 THEN 'text/csv' WHEN 9 THEN 'application/vnd.ms-excel' WHEN 10 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' ELSE 'text/plain' END AS content_type,
 CASE doc_id % 14 WHEN 4 THEN concat('%PDF-1.7 ', text) WHEN 5 THEN concat('  <!DOCTYPE HTML><p>', text) WHEN 11 THEN concat('{{"id": ', doc_id, ', "n": [1, 2]}}') WHEN 12 THEN concat('[not json', text) ELSE text END AS content
FROM {documents}""",
}


@dataclass
class Inputs:
    """The tables of one folder and the views over them."""

    spark: SparkSession
    folder: str
    _seen: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._seen:
            read = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            self._seen[name] = spread(read) if name in TEXT_TABLES else read
        return self._seen[name]

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def stored(self, name: str) -> DataFrame:
        """A view that a query uses several times, made once."""
        if "stored " + name not in self._seen:
            self._seen["stored " + name] = materialize(self.view(name), name)
        return self._seen["stored " + name]

    @cached_property
    def papers(self) -> DataFrame:
        return self.view("papers")


# ---- the checking side ----

def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPACES = lit(K.SPACE_CHARS)
WS = K.SPACE
D = K.DIGIT
W_ = K.WORD


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, {lit(WS + '+')}, ' ', 'g')")


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, {lit('([.!?])' + WS + '+')}, '\\1' || chr(1), 'g'), chr(1))"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def upper_case(x: str) -> str:
    return f"({x} = upper({x}) AND {x} <> lower({x}))"


def marker(x: str) -> str:
    return f"nullif(regexp_extract({x}, {lit(K.NUMERIC_MARKER + '|' + K.AUTHOR_MARKER)}, 0), '')"


def marker_id(x: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({x}, {lit(r'\[(' + D + r'+)\]')}, 1), ''), "
        f"nullif(regexp_extract({x}, '\\(([A-Z][a-z]+)', 1), ''), {strip(f'trim({x}, ' + lit('[]()') + ')')})"
    )


def tokens(x: str) -> str:
    return f"length(regexp_extract_all({x}, {lit(K.TOKEN_PATTERN)}))"


def _section() -> str:
    cases = "".join(
        f" WHEN regexp_matches(text, {lit(f'(?im)^{w}{WS}*$')}) THEN "
        + strip(f"regexp_extract(text, {lit(f'(?ims)^{w}{WS}*$(.*)')}, 1)")
        for w in K.REFERENCE_HEADINGS
    )
    tail = "substring(text, cast(floor(length(text) * 0.7::DOUBLE) AS bigint) + 1)"
    cases += "".join(
        f" WHEN contains(lower({tail}), {lit(w)}) THEN substring({tail}, strpos(lower({tail}), {lit(w)}))"
        for w in K.REFERENCE_HEADINGS
    )
    return f"CASE{cases} END"


_NB = f"array_to_string(list_filter(string_split(ref_section, chr(10)), lambda x: {strip('x')} <> ''), chr(10))"
_STYLE = "CASE " + " ".join(
    f"WHEN regexp_matches({_NB}, {lit('(?m)' + p)}) THEN {lit(n)}" for n, p in K.CITATION_STYLES
) + " END"


def _entries(split_at: str, keep: str, item: str) -> str:
    pieces = f"string_split(regexp_replace(ref_section, {lit(split_at)}, chr(1) || '\\1', 'g'), chr(1))"
    return (
        f"list_filter(list_transform({pieces}, lambda x: {strip('x')}), lambda x: regexp_matches(x, {lit(keep)}))"
    )


_NUM = rf"(?s)^({D}+)\.?{WS}+(.+)"
_BRA = rf"(?s)^\[({D}+)\]{WS}+(.+)"
_APA = rf"({W_}+,{K.SPACE_INLINE}+{W_}\.)"
_TRIMMED = f"array_to_string(list_filter(list_transform(string_split(ref_section, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), chr(10))"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "sections_0": (("papers",), f"SELECT doc_id, text, {_section()} AS ref_section FROM papers"),
    "sections": (
        ("sections_0",),
        f"""SELECT *, {_STYLE} AS style, CASE WHEN ref_section IS NOT NULL AND ref_section <> ''
 THEN substring(text, 1, strpos(text, ref_section) - 1) ELSE text END AS body
FROM sections_0""",
    ),
    "numeric_entries": (
        ("sections",),
        f"""SELECT doc_id, cast(i AS int) AS pos, regexp_extract(e, {lit(_NUM)}, 1) AS citation_id, {squeeze(f'regexp_extract(e, {lit(_NUM)}, 2)')} AS citation_text
FROM (SELECT doc_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, {_entries(rf'\n({D}+\.?{WS}+[A-Z])', _NUM, '')} AS l FROM sections WHERE style IN ('numeric', 'vancouver')))""",
    ),
    "bracket_entries": (
        ("sections",),
        f"""SELECT doc_id, cast(i AS int) AS pos, regexp_extract(e, {lit(_BRA)}, 1) AS citation_id, {squeeze(f'regexp_extract(e, {lit(_BRA)}, 2)')} AS citation_text
FROM (SELECT doc_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, {_entries(rf'\n(\[{D}+\]{WS})', _BRA, '')} AS l FROM sections WHERE style = 'bracket_numeric'))""",
    ),
    "apa_entries": (
        ("sections",),
        f"""SELECT doc_id, cast(i AS int) AS pos, string_split(e, ',')[1] AS citation_id, replace(e, chr(10), ' ') AS citation_text
FROM (SELECT doc_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace({_TRIMMED}, {lit(chr(92) + 'n' + _APA)}, chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, {lit('^' + _APA)})) AS l FROM sections WHERE style = 'apa'))""",
    ),
    "entries": (
        ("numeric_entries", "bracket_entries", "apa_entries"),
        "SELECT * FROM numeric_entries UNION ALL SELECT * FROM bracket_entries UNION ALL SELECT * FROM apa_entries",
    ),
    "book": (
        ("entries",),
        """SELECT doc_id, citation_id, arg_max(citation_text, pos) AS citation_text, max(pos) AS pos, count(*) AS n_entries
FROM entries GROUP BY ALL""",
    ),
    "validity": (
        ("book",),
        f"""SELECT doc_id, count(*) AS n_citations, count(*) FILTER (WHERE length(citation_text) BETWEEN {K.MIN_ENTRY_CHARS} AND {K.MAX_ENTRY_CHARS}) AS n_plausible,
 count(*) >= 1 AND count(*) FILTER (WHERE length(citation_text) BETWEEN {K.MIN_ENTRY_CHARS} AND {K.MAX_ENTRY_CHARS}) >= greatest(1.0, count(*) * 0.8) AS is_valid FROM book GROUP BY doc_id""",
    ),
    "citations": (
        ("book", "validity"),
        "SELECT book.doc_id, citation_id, citation_text, is_valid FROM book JOIN validity USING (doc_id)",
    ),
    "raw_claims": (
        ("sections",),
        f"""SELECT doc_id, concat('claim_0_', i) AS claim_id, cast(i AS bigint) AS seq, text,
 CASE WHEN regexp_matches(regexp_replace(text, {lit(K.NUMERIC_MARKER + '|' + K.AUTHOR_MARKER)}, '', 'g'), {lit(D)}) THEN 'quantitative' ELSE 'qualitative' END AS claim_type, {marker('text')} AS citation_text
FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, list_filter({sentences('body')}, lambda x: {strip('x')} <> '') AS l FROM sections))""",
    ),
    "claims": (
        ("raw_claims", "citations"),
        f"""SELECT r.*, c.citation_id, c.citation_text AS raw_citation_text,
 CASE WHEN c.citation_id IS NULL OR c.citation_id = '' THEN claim_type || '_uncited' ELSE claim_type || '_cited' END AS result_class
FROM (SELECT *, {marker_id('citation_text')} AS mid FROM raw_claims) r LEFT JOIN citations c ON c.doc_id = r.doc_id AND c.citation_id = r.mid""",
    ),
}


def _needed(names: tuple[str, ...], order: list[str]) -> None:
    for name in names:
        if name in order:
            continue
        if name in CTES:
            _needed(CTES[name][0], order)
        order.append(name)


def oracle(body: str, *names: str) -> str:
    """``body`` behind the common table expressions it needs."""
    order: list[str] = []
    _needed(names, order)
    parts = []
    for name in order:
        text = CTES[name][1] if name in CTES else VIEWS[name].format_map({t: t for t in TABLES})
        parts.append(f"{name} AS MATERIALIZED ({text})")
    return (f"WITH {', '.join(parts)} " if parts else "") + body
