"""Discovery of sources, fetch results, batches and manifests."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.claims import mapped
from catalog.core import CTES, Inputs, SPACES, any_of, lit, oracle, squeeze, strip
from evidence import constants as K
from evidence.functions.text import word_keys
from evidence.operators import discovery as D
from evidence.operators import fetch, reporting
from evidence.session import materialize
from evidence.sources import html


def words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), {lit(K.WORD + '{2,}')}))"


def catalog_hits(i: Inputs):
    return D.catalog_search(i.view("data_claims"), i.view("dataset_catalog"))


def pick_resource(i):
    rows = i.view("dataset_catalog").select(
        F.pmod("dataset_id", F.lit(700)).alias("dataset_id"),
        F.col("dataset_id").cast("int").alias("pos"),
        "format",
        "resource_url",
        F.concat(F.lit("https://catalog.example.org/"), F.pmod("dataset_id", F.lit(700))).alias("landing_url"),
    )
    return D.pick_resource(rows)


def repositories(i):
    """Three repositories that know different parts of the claims, two of them asked only when the first fails."""
    claims = i.view("lead_claims")

    def answers(source, known, n):
        return claims.where(known).select(
            "doc_id", "claim_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("pos"), F.lit(source).alias("source")
        ).withColumn("url", F.concat(F.lit(f"https://{source}.example.org/"), "doc_id", F.lit("/"), "pos"))

    d = F.col("doc_id")
    return D.union_repositories(
        [answers("data.gov", d % 3 == 0, 2), answers("kaggle", d % 5 == 0, 1)],
        [answers("zenodo", d % 2 == 0, 4), answers("figshare", d % 7 == 0, 1)],
    )


def reuse_inputs(i):
    """Claims of each order with the dataset their part names, and how well the parts of its colour fit.

    The fit of a dataset is high when colour and noun agree, lower otherwise.
    """
    lines = i.view("data_claims").select("doc_id", "claim_id", "seq", F.regexp_extract("text", r"Sales of the (\w+ \w+) in", 1).alias("name"))
    lines = lines.withColumn("parts", F.split("name", " ")).withColumns({"colour": F.element_at("parts", 1), "noun": F.element_at("parts", 2)})
    url = F.concat(F.lit("https://data.example.org/"), F.replace("name", F.lit(" "), F.lit("-")))
    colour, noun = F.col("colour"), F.col("noun")
    nouns = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
    fits = F.array(*[
        F.struct(
            F.concat(F.lit("https://data.example.org/"), colour, F.lit(f"-{n}")).alias("url"),
            F.when(noun == n, F.lit(0.95)).when(F.lit(n) < noun, F.lit(0.8)).otherwise(F.lit(0.6)).alias("confidence"),
        )
        for n in nouns
    ])
    return lines.select(
        "doc_id", "claim_id", "seq",
        F.when(F.col("seq") % 11 != 0, url).alias("url"),
        F.lit("data.gov").alias("source"), F.lit(0.7).alias("score"), fits.alias("reuse"),
    )


def reuse_asked(i):
    """The same choice by a model that sees a claim and a dataset found before it."""
    claims = reuse_inputs(i).join(i.view("data_claims").select("doc_id", "claim_id", "text"), ["doc_id", "claim_id"])

    def fit(batch):
        name = batch["text"].str.extract(r"Sales of the (\w+) (\w+) in")
        known = batch["known_url"].str.extract(r"/(\w+)-(\w+)$")
        near = known[1] < name[1]
        answer = near.map({True: 0.8, False: 0.6}).where(known[1] != name[1], 0.95).where(known[0] == name[0], 0.1)
        return batch.assign(confidence=answer)

    return D.dataset_reuse_waves(claims, fit, ["text"])


def oa(i):
    return D.rank_oa_locations(i.stored("oa_locations"))


def crossref(i):
    link = lambda ct, c: F.struct(F.lit(ct).alias("content_type"), F.col(c).alias("url"))
    return i.stored("oa_locations").groupBy("doi").agg(
        F.min("url_for_landing_page").alias("a"), F.max("url_for_pdf").alias("b"), F.max("url_for_landing_page").alias("c")
    ).select("doi", F.array(link("application/pdf", "a"), link("text/html", "b"), link("text/html", "c")).alias("links"))


def title_hits(i):
    return i.stored("oa_locations").select(
        F.col("doi").alias("citation_key"), "pos",
        F.when(F.col("pos") % 2 == 0, F.concat("doi", F.lit("/v"), "pos")).alias("doi"),
        F.col("url_for_pdf").alias("oa_url"),
    )


def doi_merge(i):
    second = i.stored("oa_locations").where(F.col("url_for_landing_page").isNotNull()).groupBy("doi").agg(
        F.max("url_for_landing_page").alias("url")).withColumn("pos", F.lit(1))
    return D.resolve_doi_merge(
        oa(i).withColumnRenamed("rank", "pos"), second, D.crossref_pdf_links(crossref(i)))


def cascade(i):
    """DOI services, then a title search, then a page search, for the claims of each order."""
    merged = doi_merge(i).withColumn("n", F.substring_index("doi", "/", -1).cast("bigint"))
    by_doi = merged.where(F.col("n") % 3 == 0).select(
        "doi", (F.col("api_rank") * 1_000_000 + F.col("api_pos")).alias("pos"), "url")
    titled = title_hits(i).where(F.substring_index("citation_key", "/", -1).cast("bigint") % 2 == 0).select(
        F.col("citation_key").alias("doi"), F.col("pos"), F.col("oa_url").alias("url"))
    web = i.stored("oa_locations").select("doi", "pos", F.col("url_for_landing_page").alias("url"))
    return D.resolve_cascade([by_doi, titled, web], ["doi"])


def parsed_stub(batch):
    text = batch["citation_text"]
    return batch.assign(
        title=text.str.extract(r"\. ([^.]+)\.")[0], first_author=text.str.extract(r"^(\w+)")[0],
        year=text.str.extract(r"(\d{4})")[0].astype("Int32"), journal=None, doi=None,
    )


def raw_citations(i):
    """Bibliography entries of all papers; many papers share an entry."""
    from catalog.claims import citations

    return citations(i).select("doc_id", "citation_id", "citation_text")


def parsed(i):
    return D.parsed_citation_once(raw_citations(i), parsed_stub)


def link_pages(i):
    """Pages with their relative links made absolute on a few domains."""
    host = F.when(F.col("page_id") % 5 == 0, F.lit("www.w3.org")).otherwise(F.lit("docs.example.org"))
    body = F.replace("html", F.lit("<article>"), F.concat(
        F.lit('<article><p>See <a href="/first/one">the <b>first</b> source</a>, <a class="x" href="/second">second source</a>, <a href="/first/one">the first again</a> and <a href="/z">z</a>.</p>')))
    return i.table("pages").select("page_id", "url", F.replace(body, F.lit('href="/'), F.concat(F.lit('href="https://'), host, F.lit("/"))).alias("html"))


def rank_stub(batch):
    return batch.assign(selected=[[len(l), 1, 99, 2] for l in batch["links"]])


def ranked_links(i):
    links = D.candidate_links(link_pages(i))
    return D.rank_links(links, i.table("pages").select("page_id", F.col("url").alias("query")), rank_stub)


def paywall_texts(i):
    """Whole document texts with a publisher address appended."""
    domains = F.array(*[F.lit(x) for x in (*K.PAYWALL_DOMAINS, "example.com", "example.net")])
    pick = F.element_at(domains, (F.col("doc_id") % 17 + 1).cast("int"))
    return i.table("documents").select("doc_id", F.concat("text", F.lit(" https://www."), F.upper(pick), F.lit("/x")).alias("text"))


def publisher_urls(i):
    hosts = F.array(*[F.lit(x) for x in ("onlinelibrary.wiley.com", "example.com", "WWW.NATURE.COM", "notcell.com", "pnas.org.example.net")])
    return i.table("pages").select(
        "page_id", F.concat(F.lit("https://"), F.element_at(hosts, (F.col("page_id") % 5 + 1).cast("int")), F.lit("/a?b=nature.com")).alias("url"))


def paywall_pages(i):
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Please SIGN IN to read. "), "html")).otherwise(F.col("html"))
    url = F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("/Login?next=/"))).otherwise(F.col("url"))
    return i.table("pages").select("page_id", url.alias("url"), body.alias("body"))


def login_pages(i):
    page = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<p>LogIn</p>"), "html")).when(
        F.col("page_id") % 4 == 1, F.concat("html", F.lit("<p>login</p>"))).otherwise(F.col("html"))
    return i.table("pages").select(
        "page_id", page.alias("html"), F.when(F.col("page_id") % 3 == 0, F.lit("application/pdf")).otherwise(F.lit("text/html; charset=utf-8")).alias("content_type"))


def payloads(i):
    return i.view("payloads").withColumn("content", F.encode("content", "UTF-8"))


def direct_and_open(i):
    a = i.view("attempts")
    direct = a.where(F.col("attempt_no") == 1).select(
        "doc_id", "citation_id", F.when(F.col("doc_id") % 4 != 0, F.col("url")).alias("url"),
        (F.col("doc_id") % 2 == 0).alias("is_found_dataset"))
    return fetch.candidate_urls(direct, a.select("doc_id", "citation_id", F.col("attempt_no").alias("pos"), "url"))


def outcome(i):
    return fetch.first_success(i.view("attempts"))


def batch_claims(i):
    """One claim per order line, cited under the same keys as the attempts."""
    return i.table("lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat(F.lit(""), F.col("l_suppkey") % 4).alias("citation_id"),
        F.concat_ws("_", F.lit("claim"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice")).alias("claim_id"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"),
        F.when(F.col("l_quantity") > 25, F.lit("quantitative")).otherwise(F.lit("qualitative")).alias("claim_type"),
        F.concat(F.lit("["), F.col("l_suppkey") % 4, F.lit("]")).alias("citation_text"),
    )


def batches(i):
    return fetch.citation_batch(batch_claims(i), outcome(i))


def failed(i):
    return fetch.fail_batch(batch_claims(i), batches(i), "rag_search", "text source")


def batch_json(i):
    tried = i.stored("attempts")
    got = materialize(fetch.first_success(tried), "outcome")
    made = materialize(fetch.citation_batch(batch_claims(i), got), "batches")
    results = fetch.fail_batch(batch_claims(i), made, "rag_search", "text source")
    text = fetch.batch_json(made, results, fetch.attempts_made(tried, got))
    shape = "citation_id string, download_successful boolean, source_url string, resolution_attempts array<struct<url:string>>, claim_results array<struct<claim_id:string>>, batch_notes string"
    return text.select("doc_id", "part", F.from_json("batch", shape).alias("_b")).select(
        "doc_id", "part", "_b.citation_id", "_b.download_successful", "_b.source_url", "_b.batch_notes",
        F.size("_b.resolution_attempts").alias("n_attempts"), F.size("_b.claim_results").alias("n_results"))


def manifest(i):
    return fetch.manifest_rows(batches(i), fetch.attempts_made(i.view("attempts"), outcome(i)))


def manifest_of_files(i):
    """Full manifest records: details of the citation, and format, name and time of the file that was fetched."""
    details = F.struct(F.col("citation_text").alias("raw_text"), F.length("citation_text").alias("year"))
    got = outcome(i)
    made = fetch.citation_batch(batch_claims(i).withColumn("citation_details", details), got)
    stored = got.where("downloaded").select(
        "doc_id", "citation_id", F.lit("html").alias("source_format"), F.regexp_extract("winning_url", "[^/]*$", 0).alias("file_name"),
        F.timestamp_seconds("doc_id").alias("downloaded_at"))
    rows = fetch.manifest_rows(made, fetch.attempts_made(i.view("attempts"), got), stored)
    return rows.withColumn("citation_details", F.col("citation_details.raw_text"))


def found_documents(i):
    found = D.rank_candidates(repositories(i)).withColumns({
        "stem": F.concat(F.lit("paper_"), F.pmod("doc_id", F.lit(10))), "search_query": F.concat(F.lit("data for "), "claim_id")})
    shape = "run_timestamp string, run_stem string, count bigint, records array<struct<claim_id:string,search_query:string,url:string,source:string,score:double>>"
    doc = F.from_json("document", shape)
    out = D.discovery_documents(found, "20240101_000000").select(doc.alias("_d"))
    return out.select("_d.run_timestamp", "_d.run_stem", "_d.count", F.explode("_d.records").alias("_r")).select(
        "run_timestamp", "run_stem", "count", "_r.*")


def manifest_events(i):
    """Every attempt appends a record; every attempt that worked is followed by a deletion, some by two."""
    a = i.view("attempts")
    at = lambda n: F.timestamp_seconds(F.col("seq") + n)
    base = a.withColumn("seq", F.col("attempt_no").cast("bigint") * 10)
    event = lambda n, kind: F.struct((F.col("seq") + n).alias("seq"), F.lit(kind).alias("kind"), at(n).alias("at"))
    one = F.when(F.col("downloaded"), event(1, "delete"))
    two = F.when(F.col("downloaded") & (F.col("attempt_no") % 2 == 0), event(2, "delete"))
    events = F.filter(F.array(event(0, "append"), one, two), lambda x: x.isNotNull())
    return base.select("doc_id", "citation_id", F.inline(events))


def discovery_records(i):
    found = D.rank_candidates(repositories(i)).withColumn("grp", F.pmod("doc_id", F.lit(10)))
    out = D.discovery_records(found, "grp", ["claim_id", "url", "source", "score"], "doc_id")
    return out.groupBy("grp").agg(
        F.first("count").alias("count"),
        F.sum(F.size(F.from_json("records_json", "array<struct<url:string>>"))).alias("n_listed"))


def run_names(i):
    e = i.table("events")
    stem = F.concat(F.lit("paper__"), "user_id")
    return e.select("event_id", F.when(F.col("event_type") == "error", F.concat(F.lit("bad_"), "user_id")).otherwise(
        reporting.run_name(stem, F.col("ts"))).alias("name"))


def run_layout(i):
    good, bad = reporting.run_layout(run_names(i))
    return good.unionByName(bad, allowMissingColumns=True)


def usable_gate(i):
    fetched = i.table("documents").select("doc_id", F.concat(F.lit(" \n"), "text", F.lit("\n\n")).alias("text_content"), F.lit("html").alias("format"))
    return fetch.usable_text_gate(fetched)


# ---- the checking side ----

_TOPK = """
SELECT doc_id, claim_id, item AS {item}, overlap, rank FROM (
 SELECT q.doc_id, q.claim_id, h.item, h.overlap, h.rank FROM q JOIN (
  SELECT p.profile, i.item, count(*) AS overlap, row_number() OVER (PARTITION BY p.profile ORDER BY count(*) DESC, i.item) AS rank
  FROM (SELECT profile, unnest(profile) AS word FROM (SELECT DISTINCT profile FROM q)) p
  JOIN (SELECT item, unnest(words) AS word FROM items) i ON i.word = p.word GROUP BY p.profile, i.item) h ON h.profile = q.profile)
WHERE rank <= {k}"""


def _topk(k: int, item: str, claims: str, items_sql: str, *needs: str) -> str:
    q = f"SELECT doc_id, claim_id, list_sort({words('text')}) AS profile FROM {claims}"
    CTES[f"q_{item}"] = (needs, q)
    CTES[f"items_{item}"] = (needs, items_sql)
    body = _TOPK.format(item=item, k=k).replace("FROM q JOIN", f"FROM q_{item} q JOIN").replace(
        "FROM q)", f"FROM q_{item})").replace("FROM items)", f"FROM items_{item})")
    return body, (f"q_{item}", f"items_{item}")


_cat, _cat_needs = _topk(
    5, "dataset_id", "data_claims",
    "SELECT dataset_id AS item, " + words("concat_ws(' ', title, notes)") + " AS words FROM dataset_catalog",
    "data_claims", "dataset_catalog",
)
_txt, _txt_needs = _topk(
    3, "source_id", "lead_claims",
    "SELECT conv_id * 1000 + turn AS item, " + words("text") + " AS words FROM conversations",
    "lead_claims",
)

CTES["repo"] = (
    ("lead_claims",),
    """SELECT *, min(tier) OVER (PARTITION BY doc_id, claim_id) AS best FROM (
 SELECT doc_id, claim_id, pos, source, concat('https://', source, '.example.org/', doc_id, '/', pos) AS url, tier, repository, CASE tier WHEN 0 THEN 0.7 ELSE 0.65 END::DOUBLE AS score
 FROM lead_claims JOIN (VALUES ('data.gov', 3, 2, 0, 0), ('kaggle', 5, 1, 0, 1), ('zenodo', 2, 4, 1, 0), ('figshare', 7, 1, 1, 1)) s(source, every, n, tier, repository) ON doc_id % every = 0,
 LATERAL (SELECT unnest(range(1, n + 1)) AS pos))""",
)
CTES["chosen"] = (
    ("repo",),
    "SELECT doc_id, claim_id, arg_min({'url': url, 'source': source, 'score': score}, repository * 100 + pos) AS b FROM repo WHERE tier = best GROUP BY ALL",
)
CTES["oa_ranked"] = (
    ("oa_locations",),
    """SELECT doi, row_number() OVER (PARTITION BY doi ORDER BY host_type <> 'repository', url_for_pdf IS NULL, pos) AS rank, coalesce(url_for_pdf, url_for_landing_page) AS url
FROM oa_locations WHERE coalesce(url_for_pdf, url_for_landing_page) IS NOT NULL""",
)
CTES["pdf_links"] = (
    ("oa_locations",),
    """SELECT doi, pos, url FROM (SELECT doi, 0 AS pos, 'application/pdf' AS ct, min(url_for_landing_page) AS url FROM oa_locations GROUP BY doi
 UNION ALL SELECT doi, 1, 'text/html', max(url_for_pdf) FROM oa_locations GROUP BY doi UNION ALL SELECT doi, 2, 'text/html', max(url_for_landing_page) FROM oa_locations GROUP BY doi)
WHERE url IS NOT NULL AND (contains(ct, 'pdf') OR contains(lower(url), 'pdf'))""",
)
CTES["title_hits"] = (
    ("oa_locations",),
    "SELECT doi AS citation_key, pos, CASE WHEN pos % 2 = 0 THEN concat(doi, '/v', pos) END AS doi, url_for_pdf AS oa_url FROM oa_locations",
)
CTES["merged"] = (
    ("oa_ranked", "oa_locations", "pdf_links"),
    """SELECT doi, 0::BIGINT AS api_rank, rank AS api_pos, url FROM oa_ranked
UNION ALL SELECT doi, 1, 1, max(url_for_landing_page) FROM oa_locations WHERE url_for_landing_page IS NOT NULL GROUP BY doi
UNION ALL SELECT doi, 2, pos, url FROM pdf_links""",
)
CTES["steps"] = (
    ("merged", "title_hits", "oa_locations"),
    """SELECT doi, 1::BIGINT AS step, api_rank * 1000000 + api_pos AS pos, url FROM merged WHERE cast(split_part(doi, '/', 2) AS bigint) % 3 = 0
UNION ALL SELECT citation_key, 2, pos, oa_url FROM title_hits WHERE cast(split_part(citation_key, '/', 2) AS bigint) % 2 = 0 AND oa_url IS NOT NULL
UNION ALL SELECT doi, 3, pos, url_for_landing_page FROM oa_locations WHERE url_for_landing_page IS NOT NULL""",
)
CTES["cascade"] = (
    ("steps",),
    "SELECT doi, step, url, cast(min(pos) AS bigint) AS pos FROM (SELECT *, min(step) OVER (PARTITION BY doi) AS first FROM steps) WHERE step = first GROUP BY doi, step, url",
)
CTES["parsed"] = (
    ("citations",),
    r"""SELECT doc_id, citation_id, citation_text, nullif(regexp_extract(citation_text, '\. ([^.]+)\.', 1), '') AS title, nullif(regexp_extract(citation_text, '^([\p{L}\p{N}_]+)', 1), '') AS first_author,
 cast(nullif(regexp_extract(citation_text, '([0-9]{4})', 1), '') AS bigint) AS year FROM citations""",
)
CTES["link_pages"] = (
    (),
    """SELECT page_id, url, replace(replace(html, '<article>', '<article><p>See <a href="/first/one">the <b>first</b> source</a>, <a class="x" href="/second">second source</a>, <a href="/first/one">the first again</a> and <a href="/z">z</a>.</p>'),
 'href="/', concat('href="https://', CASE page_id % 5 WHEN 0 THEN 'www.w3.org' ELSE 'docs.example.org' END, '/')) AS html FROM pages""",
)


def _without(x: str, tags) -> str:
    for t in tags:
        x = f"regexp_replace({x}, {lit(rf'(?is)<{t}\b[^>]*>.*?</{t}\s*>')}, '', 'g')"
    return x


def _entities(x: str) -> str:
    for a, b in (("&nbsp;", "chr(160)"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&#x27;", "''''"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        x = f"replace({x}, '{a}', {b})"
    return x


_LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
def _link_list(blocks: str) -> str:
    """Wanted links of each page by place, first of each address; ``blocks`` gives page_id, place and html of a block."""
    return f"""SELECT page_id, url, min(i) AS i, arg_min(title, i) AS title, arg_min(context, i) AS context FROM (
 SELECT page_id, unnest(u) AS url, {squeeze(_entities("regexp_replace(unnest(t), '(?s)<[^>]*>', ' ', 'g')"))} AS title, context, place * 1000000 + generate_subscripts(u, 1) AS i FROM (
  SELECT page_id, place, regexp_extract_all(h, {lit(_LINK)}, 1) AS u, regexp_extract_all(h, {lit(_LINK)}, 2) AS t,
   {squeeze(_entities("regexp_replace(h, '(?s)<[^>]*>', ' ', 'g')"))} AS context FROM ({blocks})))
WHERE starts_with(url, 'http') AND length(title) >= 5 AND NOT contains(url, 'w3.org') GROUP BY page_id, url"""


_BARE = f"SELECT page_id, {_without('html', K.LINK_BOILERPLATE)} AS h FROM link_pages"
_CUT = lit(r"(?i)</?(?:" + "|".join(K.LINK_BLOCKS) + r")\b[^>]*>")
CTES["links"] = (("link_pages",), _link_list(f"SELECT page_id, 0 AS place, h FROM ({_BARE})"))
CTES["link_rows"] = (("links",), "SELECT page_id, url, title, row_number() OVER (PARTITION BY page_id ORDER BY i) AS link_no FROM links")
CTES["block_links"] = (
    ("link_pages",),
    _link_list(f"SELECT page_id, unnest(b) AS h, generate_subscripts(b, 1) AS place FROM (SELECT page_id, regexp_split_to_array(h, {_CUT}) AS b FROM ({_BARE}))"),
)

_COLON = "https?://([^/?#]*)"
_HEAD = "ltrim(substr(content, 1, 512))"
_HTML_HEAD = f"(starts_with(lower({_HEAD}), '<!doctype html') OR starts_with(lower({_HEAD}), '<html'))"
_SNIFF = f"""
SELECT doc_id, url, content_type, CASE
 WHEN starts_with(content, '%PDF-') OR contains(content_type, 'application/pdf') THEN '/application/pdf'
 WHEN contains(content_type, 'spreadsheetml') THEN 'xlsx/application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
 WHEN contains(content_type, 'ms-excel') THEN 'xls/application/vnd.ms-excel'
 WHEN {_HTML_HEAD} OR contains(content_type, 'text/html') THEN '/text/html'
 WHEN contains(lower(url), '.csv') OR contains(content_type, 'text/csv') THEN 'csv/text/csv'
 WHEN contains(lower(url), '.json') THEN 'json/application/json'
 WHEN contains(lower(url), '.xlsx') THEN 'xlsx/application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
 WHEN contains(lower(url), '.xls') THEN 'xls/application/vnd.ms-excel'
 WHEN json_valid(content) AND regexp_matches(content, '^\\s*[{{\\[]') THEN 'json/application/json (sniffed)'
 WHEN try(decode(encode(content)[1:512])) IS NOT NULL AND contains(list_filter(string_split(substr(content, 1, 512), chr(10)), lambda x: {strip('x')} <> '')[1], ',') THEN 'csv/text/csv (sniffed)' ELSE concat('/', content_type)
END AS r FROM payloads"""

_PLAIN = _entities(
    f"regexp_replace(regexp_extract(regexp_replace({_without('html', K.ARTICLE_BOILERPLATE)}, '(?s)<!--.*?-->', '', 'g'), '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1), '(?s)<[^>]*>', chr(10), 'g')"
)
_ARTICLE = f"""SELECT page_id, array_to_string(list_filter(list_transform(flatten(list_transform(string_split({_PLAIN}, chr(10)), lambda x: string_split({strip('x')}, '  '))), lambda x: {strip('x')}), lambda x: x <> ''), chr(10)) AS text FROM pages"""

CTES["outcome"] = (
    ("attempts",),
    """SELECT doc_id, citation_id, bool_or(downloaded) AS downloaded, arg_min(url, attempt_no) FILTER (WHERE downloaded) AS winning_url,
 cast(min(attempt_no) FILTER (WHERE downloaded) AS bigint) AS winning_attempt, CASE WHEN NOT bool_or(downloaded) THEN arg_max(error, attempt_no) END AS error, count(*) AS n_recorded
FROM attempts GROUP BY ALL""",
)
CTES["batch_claims"] = (
    (),
    """SELECT l_orderkey AS doc_id, concat('', l_suppkey % 4) AS citation_id, l_partkey * 1000 + l_suppkey AS seq,
 CASE WHEN l_quantity > 25 THEN 'quantitative' ELSE 'qualitative' END AS claim_type, concat('[', l_suppkey % 4, ']') AS citation_text, l_linenumber, l_extendedprice FROM lineitem""",
)
CTES["batches"] = (
    ("batch_claims", "outcome"),
    f"""SELECT b.*, coalesce(o.downloaded, false) AS downloaded, winning_url, winning_attempt,
 CASE WHEN NOT coalesce(o.downloaded, false) THEN coalesce(error, '{K.NO_URL_TEXT}') END AS error
FROM (SELECT doc_id, citation_id, count(*) AS n_claims, any_value(citation_text) AS citation_text FROM batch_claims GROUP BY doc_id, citation_id) b
LEFT JOIN outcome o ON o.doc_id = b.doc_id AND o.citation_id = b.citation_id""",
)
CTES["made"] = (
    ("attempts", "outcome"),
    """SELECT a.* FROM attempts a JOIN outcome o ON o.doc_id = a.doc_id AND o.citation_id = a.citation_id
WHERE winning_attempt IS NULL OR attempt_no <= winning_attempt""",
)
# Newest undeleted record first, walked event by event.
MANIFEST_SQL = """, events_ AS (
 SELECT doc_id, citation_id, attempt_no * 10::BIGINT AS seq, 'append' AS kind FROM attempts
 UNION ALL SELECT doc_id, citation_id, attempt_no * 10 + 1, 'delete' FROM attempts WHERE downloaded
 UNION ALL SELECT doc_id, citation_id, attempt_no * 10 + 2, 'delete' FROM attempts WHERE downloaded AND attempt_no % 2 = 0),
walked AS (SELECT doc_id, citation_id, list_reduce(list_prepend({'k': 'start', 'seq': 0::BIGINT, 'open': []::BIGINT[], 'gone': []::STRUCT(s BIGINT, d BIGINT)[]},
  list({'k': kind, 'seq': seq, 'open': []::BIGINT[], 'gone': []::STRUCT(s BIGINT, d BIGINT)[]} ORDER BY seq)),
  lambda a, x: CASE WHEN x.k = 'append' THEN {'k': '', 'seq': 0::BIGINT, 'open': list_append(a.open, x.seq), 'gone': a.gone}
   WHEN len(a.open) = 0 THEN a
   ELSE {'k': '', 'seq': 0::BIGINT, 'open': a.open[1:len(a.open) - 1], 'gone': list_append(a.gone, {'s': a.open[-1], 'd': x.seq})} END) AS r
 FROM events_ GROUP BY doc_id, citation_id)
SELECT doc_id, citation_id, seq, epoch_ms(seq * 1000) AS appended_at, epoch_ms(d * 1000) AS deleted_at FROM (
 SELECT doc_id, citation_id, unnest(r.open) AS seq, NULL::BIGINT AS d FROM walked
 UNION ALL SELECT doc_id, citation_id, g.s, g.d FROM (SELECT doc_id, citation_id, unnest(r.gone) AS g FROM walked))"""

CTES["reuse_in"] = (
    ("data_claims",),
    r"""SELECT doc_id, claim_id, seq, CASE WHEN seq % 11 <> 0 THEN concat('https://data.example.org/', colour, '-', noun) END AS url, colour, noun
FROM (SELECT *, regexp_extract(text, 'Sales of the (\w+) (\w+) in', 1) AS colour, regexp_extract(text, 'Sales of the (\w+) (\w+) in', 2) AS noun FROM data_claims)""",
)
_REUSE = """, walked AS (SELECT doc_id, list_reduce(list_prepend({'c': '', 's': 0::BIGINT, 'u': NULL::VARCHAR, 'colour': '', 'noun': '', 'found': []::STRUCT(u VARCHAR, colour VARCHAR, noun VARCHAR, by_ VARCHAR)[], 'out': []::STRUCT(c VARCHAR, s BIGINT, u VARCHAR, by_ VARCHAR, r BOOLEAN)[]},
  list({'c': claim_id, 's': seq, 'u': url, 'colour': colour, 'noun': noun, 'found': []::STRUCT(u VARCHAR, colour VARCHAR, noun VARCHAR, by_ VARCHAR)[], 'out': []::STRUCT(c VARCHAR, s BIGINT, u VARCHAR, by_ VARCHAR, r BOOLEAN)[]} ORDER BY seq)),
  lambda a, x: CASE
   WHEN len(list_filter(a.found, lambda f: f.colour = x.colour AND f.noun = x.noun)) > 0 THEN
    {'c': '', 's': 0::BIGINT, 'u': NULL::VARCHAR, 'colour': '', 'noun': '', 'found': a.found, 'out': list_append(a.out, {'c': x.c, 's': x.s, 'u': list_filter(a.found, lambda f: f.colour = x.colour AND f.noun = x.noun)[1].u, 'by_': list_filter(a.found, lambda f: f.colour = x.colour AND f.noun = x.noun)[1].by_, 'r': true})}
   WHEN len(list_filter(a.found, lambda f: f.colour = x.colour AND f.noun < x.noun)) > 0 THEN
    {'c': '', 's': 0::BIGINT, 'u': NULL::VARCHAR, 'colour': '', 'noun': '', 'found': a.found, 'out': list_append(a.out, {'c': x.c, 's': x.s, 'u': list_filter(a.found, lambda f: f.colour = x.colour AND f.noun < x.noun)[1].u, 'by_': list_filter(a.found, lambda f: f.colour = x.colour AND f.noun < x.noun)[1].by_, 'r': true})}
   WHEN x.u IS NOT NULL THEN
    {'c': '', 's': 0::BIGINT, 'u': NULL::VARCHAR, 'colour': '', 'noun': '', 'found': list_append(a.found, {'u': x.u, 'colour': x.colour, 'noun': x.noun, 'by_': x.c}), 'out': list_append(a.out, {'c': x.c, 's': x.s, 'u': x.u, 'by_': x.c, 'r': false})}
   ELSE a END).out AS o FROM reuse_in GROUP BY doc_id)
SELECT doc_id, e.c AS claim_id, e.u AS source_url, e.by_ AS found_by_claim_id, e.r AS is_reused FROM (SELECT doc_id, unnest(o) AS e FROM walked)"""

_PAYDOMS = ", ".join(lit(x) for x in (*K.PAYWALL_DOMAINS, "example.com", "example.net"))

QUERIES = {
    "catalog_search": (catalog_hits, oracle(_cat, *_cat_needs)),
    "text_source_search": (
        lambda i: D.text_source_search(
            i.view("lead_claims"),
            i.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("source_id"), "text")),
        oracle(
            f"SELECT doc_id, claim_id, arg_min(source_id, rank) AS source_id, max(overlap) AS overlap, count(*) AS n_candidates, 0.8::DOUBLE AS relevance_score FROM ({_txt}) GROUP BY doc_id, claim_id",
            *_txt_needs,
        ),
    ),
    "pick_resource": (
        pick_resource,
        oracle(
            """SELECT dataset_id % 700 AS dataset_id, coalesce(arg_min(resource_url, dataset_id) FILTER (WHERE format IN ('csv', 'json', 'xlsx', 'xls')), concat('https://catalog.example.org/', dataset_id % 700)) AS url FROM dataset_catalog GROUP BY dataset_id % 700""",
            "dataset_catalog",
        ),
    ),
    "union_repositories": (
        lambda i: repositories(i).select("doc_id", "claim_id", "url", "source", "score"),
        oracle("SELECT doc_id, claim_id, url, source, score FROM repo WHERE tier = best", "repo"),
    ),
    "rank_candidates": (
        lambda i: D.rank_candidates(repositories(i)),
        oracle("SELECT doc_id, claim_id, b.url AS url, b.source AS source, b.score AS score FROM chosen", "chosen"),
    ),
    "dataset_reuse": (
        lambda i: D.dataset_reuse(reuse_inputs(i)).select("doc_id", "claim_id", "source_url", "found_by_claim_id", "is_reused"),
        oracle("@", "reuse_in").replace(" @", _REUSE),
    ),
    "dataset_reuse_waves": (
        lambda i: D.dataset_reuse_waves(reuse_inputs(i)).select("doc_id", "claim_id", "source_url", "found_by_claim_id", "is_reused"),
        oracle("@", "reuse_in").replace(" @", _REUSE),
    ),
    "dataset_reuse_asked": (
        lambda i: reuse_asked(i).select("doc_id", "claim_id", "source_url", "found_by_claim_id", "is_reused"),
        oracle("@", "reuse_in").replace(" @", _REUSE),
    ),
    "discovery_records": (
        discovery_records,
        oracle("SELECT doc_id % 10 AS grp, count(*) AS count, count(*) AS n_listed FROM chosen GROUP BY 1", "chosen"),
    ),
    "rank_oa_locations": (oa, oracle("SELECT * FROM oa_ranked", "oa_ranked")),
    "crossref_pdf_links": (
        lambda i: D.crossref_pdf_links(crossref(i)), oracle("SELECT doi, cast(pos AS bigint) AS pos, url FROM pdf_links", "pdf_links")),
    "title_search_recover_doi": (
        lambda i: D.title_search_recover_doi(title_hits(i)).select("citation_key", "recovered_doi", F.array_join("urls", " ").alias("urls")),
        oracle(
            """SELECT citation_key, arg_min(doi, pos) FILTER (WHERE doi IS NOT NULL) AS recovered_doi, coalesce(string_agg(oa_url, ' ' ORDER BY pos), '') AS urls FROM title_hits GROUP BY citation_key""",
            "title_hits",
        ),
    ),
    "resolve_doi_merge": (doi_merge, oracle("SELECT doi, api_rank, cast(api_pos AS bigint) AS api_pos, url FROM merged", "merged")),
    "resolve_cascade": (cascade, oracle("SELECT * FROM cascade", "cascade")),
    "best_candidate": (
        lambda i: D.best_candidate(cascade(i), ["doi"]),
        oracle("SELECT doi, arg_min(url, pos) AS url FROM cascade GROUP BY doi", "cascade"),
    ),
    "dedupe_ordered": (
        lambda i: D.dedupe_ordered(
            i.view("attempts").select("doc_id", F.when(F.col("citation_id") != "0", F.col("url")).alias("url"), F.col("attempt_no").alias("pos")), ["doc_id"]),
        oracle(
            "SELECT doc_id, url, cast(min(attempt_no) AS bigint) AS pos FROM attempts WHERE citation_id <> '0' GROUP BY doc_id, url", "attempts"),
    ),
    "parsed_citation_once": (
        lambda i: parsed(i).select("doc_id", "citation_id", "title", "first_author", "year"),
        oracle("SELECT doc_id, citation_id, title, first_author, year FROM parsed", "parsed"),
    ),
    "bibliographic_query": (
        lambda i: D.bibliographic_query(parsed(i)).select("doc_id", "citation_id", "bibliographic_query", "scholar_query"),
        oracle(
            """SELECT doc_id, citation_id, CASE WHEN title IS NOT NULL THEN concat_ws(' ', title, first_author, year) ELSE citation_text END AS bibliographic_query,
 CASE WHEN title IS NOT NULL THEN concat_ws(' ', '"' || title || '"', first_author, year) ELSE citation_text END AS scholar_query FROM parsed""",
            "parsed",
        ),
    ),
    "paywall_domains_needed": (
        lambda i: D.paywall_domains_needed(paywall_texts(i), (*K.PAYWALL_DOMAINS, "example.com")),
        f"""SELECT DISTINCT doc_id, domain FROM (SELECT doc_id, lower(concat(text, ' https://www.', upper(list_extract([{_PAYDOMS}], doc_id % 17 + 1)), '/x')) AS t FROM documents)
JOIN (SELECT unnest([{_PAYDOMS}][1:16]) AS domain) ON contains(t, domain)""",
    ),
    "paywall_host": (
        lambda i: D.paywall_host(publisher_urls(i)),
        """SELECT page_id, concat('https://', h, '/a?b=nature.com') AS url, h IN ('onlinelibrary.wiley.com', 'WWW.NATURE.COM', 'notcell.com') AS is_paywall_host
FROM (SELECT page_id, ['onlinelibrary.wiley.com', 'example.com', 'WWW.NATURE.COM', 'notcell.com', 'pnas.org.example.net'][page_id % 5 + 1] AS h FROM pages)""",
    ),
    "paywall_page": (
        lambda i: D.paywall_page(paywall_pages(i)).select("page_id", "url", "is_paywalled"),
        f"""SELECT page_id, url, {any_of('lower(url)', K.LOGIN_URL_WORDS)} OR {any_of('lower(body)', K.PAYWALL_PHRASES)} AS is_paywalled FROM (
 SELECT page_id, CASE WHEN page_id % 7 = 0 THEN concat(url, '/Login?next=/') ELSE url END AS url, CASE WHEN page_id % 3 = 0 THEN concat('Please SIGN IN to read. ', html) ELSE html END AS body FROM pages)""",
    ),
    "login_page": (
        lambda i: D.login_page(login_pages(i)).select("page_id", "is_login_page"),
        """SELECT page_id, page_id % 3 <> 0 AND contains(lower(h), 'login') AS is_login_page FROM (
 SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('<p>LogIn</p>', html) WHEN 1 THEN concat(html, '<p>login</p>') ELSE html END AS h FROM pages)""",
    ),
    "candidate_links": (
        lambda i: D.candidate_links(link_pages(i)),
        oracle("SELECT page_id, url, title, link_no FROM link_rows", "link_rows"),
    ),
    "candidate_links_context": (
        lambda i: D.candidate_links(link_pages(i), context=True),
        oracle("SELECT page_id, url, title, context, row_number() OVER (PARTITION BY page_id ORDER BY i) AS link_no FROM block_links", "block_links"),
    ),
    "rank_links": (
        ranked_links,
        oracle(
            """SELECT page_id, query, url, row_number() OVER (PARTITION BY page_id ORDER BY o) AS rank FROM (
 SELECT l.page_id, p.url AS query, l.url, o FROM pages p JOIN (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM link_rows) l ON l.page_id = p.page_id
 JOIN (VALUES (1, -1), (2, 1), (3, 99), (4, 2)) k(o, pick) ON l.link_no = CASE pick WHEN -1 THEN n ELSE pick END) QUALIFY rank <= 3""",
            "link_rows",
        ),
    ),
    "sniff_tabular_format": (
        lambda i: fetch.sniff_tabular_format(payloads(i)),
        oracle(
            f"SELECT doc_id, url, content_type, nullif(split_part(r, '/', 1), '') AS format, substr(r, strpos(r, '/') + 1) AS kind FROM ({_SNIFF})",
            "payloads",
        ),
    ),
    "sniff_text_format": (
        lambda i: fetch.sniff_text_format(payloads(i)),
        oracle(
            f"""SELECT doc_id, url, content_type, CASE WHEN starts_with(content, '%PDF-') THEN 'pdf' WHEN {_HTML_HEAD} THEN 'html' WHEN contains(content_type, 'application/pdf') THEN 'pdf'
 WHEN contains(content_type, 'text/html') THEN 'html' WHEN contains(lower(url), '.pdf') THEN 'pdf' WHEN contains(lower(url), '.htm') THEN 'html' ELSE 'txt' END AS format FROM payloads""",
            "payloads",
        ),
    ),
    "candidate_urls": (
        direct_and_open,
        oracle(
            """SELECT doc_id, citation_id, url, cast(min(pos) AS bigint) AS pos, arg_min(source, pos) AS source FROM (
 SELECT doc_id, citation_id, url, -1 AS pos, CASE WHEN doc_id % 2 = 0 THEN 'found_dataset' ELSE 'direct' END AS source FROM attempts WHERE attempt_no = 1 AND doc_id % 4 <> 0
 UNION ALL SELECT doc_id, citation_id, url, attempt_no, 'open_access' FROM attempts) GROUP BY doc_id, citation_id, url""",
            "attempts",
        ),
    ),
    "first_success": (outcome, oracle("SELECT * FROM outcome", "outcome")),
    "attempts_made": (
        lambda i: fetch.attempts_made(i.view("attempts"), outcome(i)),
        oracle("SELECT doc_id, citation_id, cast(attempt_no AS bigint) AS attempt_no, url, source, downloaded, error FROM made", "made"),
    ),
    "usable_text_gate": (
        usable_gate,
        f"""SELECT doc_id, 'html' AS format, n >= 200 AS downloaded, CASE WHEN n < 200 THEN concat('Extraction produced ', n, ' usable chars (<200); format=html') END AS error, CASE WHEN n >= 200 THEN t END AS text_content
FROM (SELECT doc_id, concat(' ', chr(10), text, chr(10), chr(10)) AS t, length({strip('text')}) AS n FROM documents)""",
    ),
    "article_text": (lambda i: html.article_text(i.table("pages")), _ARTICLE),
    "article_text_sql": (
        lambda i: fetch.article_text_sql(i.table("pages")),
        _ARTICLE,
    ),
    "citation_batch": (
        lambda i: batches(i).select("doc_id", "citation_id", "n_claims", "citation_text", "downloaded", "winning_url", "error"),
        oracle("SELECT doc_id, citation_id, n_claims, citation_text, downloaded, winning_url, error FROM batches", "batches"),
    ),
    "fail_batch": (
        lambda i: failed(i).groupBy("doc_id", "citation_id", "claim_type", "explanation", "errors", "confidence", "passed").agg(F.count(F.lit(1)).alias("n")),
        oracle(
            """SELECT c.doc_id, c.citation_id, claim_type, 'Batch failed: text source download unsuccessful' AS explanation, b.error AS errors, 0.0::DOUBLE AS confidence, false AS passed, count(*) AS n
FROM batch_claims c JOIN batches b ON b.doc_id = c.doc_id AND b.citation_id = c.citation_id WHERE NOT b.downloaded GROUP BY ALL""",
            "batch_claims", "batches",
        ),
    ),
    "batch_json": (
        batch_json,
        oracle(
            """SELECT b.doc_id, 0::BIGINT AS part, b.citation_id, downloaded AS download_successful, winning_url AS source_url,
 CASE WHEN downloaded THEN concat('Successfully validated ', n_claims, ' claims') ELSE concat('Download failed: ', error) END AS batch_notes, coalesce(n_attempts, 0) AS n_attempts, CASE WHEN downloaded THEN 0 ELSE n_claims END AS n_results FROM batches b
 LEFT JOIN (SELECT doc_id, citation_id, count(*) AS n_attempts FROM made GROUP BY ALL) m ON m.doc_id = b.doc_id AND m.citation_id = b.citation_id""",
            "batches", "made",
        ),
    ),
    "manifest_rows": (
        manifest,
        oracle(
            """SELECT b.doc_id, b.citation_id, citation_text, coalesce(n, 0) AS n_attempts, winning_url, n_claims AS batch_num_claims, downloaded AS batch_download_successful
FROM batches b LEFT JOIN (SELECT doc_id, citation_id, count(*) AS n FROM made GROUP BY ALL) m ON m.doc_id = b.doc_id AND m.citation_id = b.citation_id""",
            "batches", "made",
        ),
    ),
    "manifest_rows_files": (
        manifest_of_files,
        oracle(
            """SELECT b.doc_id, b.citation_id, citation_text, citation_text AS citation_details, CASE WHEN downloaded THEN 'html' END AS source_format,
 CASE WHEN downloaded THEN regexp_extract(winning_url, '[^/]*$') END AS file_name, CASE WHEN downloaded THEN epoch_ms(b.doc_id * 1000) END AS downloaded_at,
 coalesce(n, 0) AS n_attempts, winning_url, n_claims AS batch_num_claims, downloaded AS batch_download_successful
FROM batches b LEFT JOIN (SELECT doc_id, citation_id, count(*) AS n FROM made GROUP BY ALL) m ON m.doc_id = b.doc_id AND m.citation_id = b.citation_id""",
            "batches", "made",
        ),
    ),
    "discovery_documents": (
        found_documents,
        oracle(
            """SELECT '20240101_000000' AS run_timestamp, concat('paper_', doc_id % 10) AS run_stem, count(*) OVER (PARTITION BY doc_id % 10) AS count,
 claim_id, concat('data for ', claim_id) AS search_query, b.url AS url, b.source AS source, b.score AS score FROM chosen""",
            "chosen",
        ),
    ),
    "manifest_current": (
        lambda i: reporting.manifest_current(manifest_events(i), F.floor(F.col("seq") / 20)),
        oracle("@", "attempts").replace(" @", MANIFEST_SQL),
    ),
    "run_layout": (
        run_layout,
        """SELECT event_id, name, CASE WHEN good THEN regexp_extract(name, '^(.*)__(.*)$', 1) END AS stem, CASE WHEN good THEN regexp_extract(name, '^(.*)__(.*)$', 2) END AS timestamp,
 CASE WHEN NOT good THEN concat('Run directory name ''', name, ''' does not match the expected format') END AS reject_reason
FROM (SELECT *, contains(name, '__') AS good FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN concat('bad_', user_id) ELSE concat('paper__', user_id, '__', strftime(ts, '%Y%m%d_%H%M%S')) END AS name FROM events))""",
    ),
}
