"""Structure of papers: literal cases."""

from pyspark.sql import functions as F

from evidence.functions import citations as C
from evidence.operators import documents as D

PAPER = """
Feeding habits of harbour seals

Abstract
Seals were watched for three winters.
Herring makes up 61% of what they eat.

Introduction
What seals eat depends on the season [1].

References
1. Okafor, B., & Lind, T. (2011). Seals of the outer bay. Marine Notes, 8(2), 14-30.
2. Vargas, P. (2008). Herring in cold water. Fisheries, 77,
12: 301-318.
3. Ito, K. (2015). Counting animals from the air. Proceedings of Field Methods, 41-52.
"""


def papers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def column(df, name):
    return [r[name] for r in df.orderBy("doc_id").collect()]


def test_title_and_abstract(spark):
    df = papers(
        spark, PAPER, "SHOUTING TITLE LINE\nshort\nA proper title here", "no", "",
        "x\nSummary\n\nIntroduction\nText\nAbstract line\nkept\nMORE CAPS HERE\nnot kept",
        "abstract\nvalue 21.5 stops\nnever",
    )
    assert column(D.paper_title(df), "title") == [
        "Feeding habits of harbour seals", "A proper title here", None, None, "Introduction", "value 21.5 stops"]
    assert column(D.paper_abstract(df), "abstract") == [
        "Seals were watched for three winters. Herring makes up 61% of what they eat.", None, None, None, "kept", None]


def test_reference_section_and_body(spark):
    df = papers(
        spark,
        "body\nreferences\n1. A b.",
        "body\nBibliography  \n\n x ",
        "nothing here at all",
        "a" * 80 + " references inline",
        "contents\nReferences\nbody\nReferences\nlist",
        "text\nReferences\n",
    )
    sections = column(D.reference_section(df), "ref_section")
    assert sections == ["1. A b.", "x", None, "references inline", "body\nReferences\nlist", ""]
    bodies = column(D.body_text(df), "body")
    assert bodies[0] == "body\nreferences\n" and bodies[2] == "nothing here at all"
    assert column(D.body_text(df, share=0.7), "body")[2] == "nothing here at all"[:13]
    assert bodies[4] == "contents\nReferences\n" and bodies[5] == "text\nReferences\n"
    assert column(D.body_text(df, share=1), "body")[2] == "nothing here at all"


def test_styles(spark):
    refs = [
        "1. Smith went", "[1] Smith went", "Smith, J. (2020) went", "Smith, John. \"Title", "Smith, John, and Bo",
        "plain words only", "", None, "\n\n  \n2 Smith",
    ]
    df = spark.createDataFrame(list(enumerate(refs)), "doc_id bigint, ref_section string")
    assert column(D.citation_style(df), "style") == [
        "numeric", "bracket_numeric", "apa", "mla", "chicago", None, None, None, "numeric"]


def test_parse_entries(spark):
    refs = {
        0: ("numeric", "1. Smith, J. (2020).\n  Title\n73: 3210\n2. Brown"),
        1: ("bracket_numeric", "[1] Smith\n[12] Brown  and\nco"),
        2: ("apa", "lost line\nSmith, J. (2020). One\n continues\n\nBrown, A. (2019). Two\nSmith, K. (2021). Three\nMüller,\nX."),
    }
    df = spark.createDataFrame([(k, s, t) for k, (s, t) in refs.items()], "doc_id bigint, style string, ref_section string")
    got = {(r.doc_id, r.pos): (r.citation_id, r.citation_text) for r in D.parse_refs(df).collect()}
    assert got == {
        (0, 0): ("1", "Smith, J. (2020). Title 73: 3210"), (0, 1): ("2", "Brown"),
        (1, 0): ("1", "Smith"), (1, 1): ("12", "Brown and co"),
        (2, 0): ("Smith", "Smith, J. (2020). One continues"), (2, 1): ("Brown", "Brown, A. (2019). Two"),
        (2, 2): ("Smith", "Smith, K. (2021). Three Müller, X."),
    }
    last = {(r.doc_id, r.citation_id): (r.citation_text, r.n_entries) for r in D.citation_last_wins(D.parse_refs(df)).collect()}
    assert last[(2, "Smith")] == ("Smith, K. (2021). Three Müller, X.", 2)


def test_validate_bibliography(spark):
    good, short, long = "A citation of a decent length.", "Too short", "x" * 3000
    rows = [(0, "1", short), (1, "1", long), (2, "1", good), (2, "2", short), (3, "1", good)]
    rows += [(4, str(n), good) for n in range(4)] + [(4, "9", short)]
    df = spark.createDataFrame(rows, "doc_id bigint, citation_id string, citation_text string")
    got = {r.doc_id: r.is_valid for r in D.validate_bibliography(df).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: True}


def test_details_and_ids(spark):
    rows = [
        (0, "Okafor, B. (2011). Seals. Notes. doi: 10.7766/seal.8"), (1, "Vargas. Herring 2008. https://fish.example.net/h."),
        (2, "no facts"), (3, "(2021) starts with a year"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, t string").select("doc_id", C.details(F.col("t")).alias("d")).select("doc_id", "d.*")
    got = {r.doc_id: (r.year, r.doi, r.url, r.authors) for r in df.collect()}
    assert got == {
        0: (2011, "10.7766/seal.8", None, ["Okafor"]), 1: (2008, None, "https://fish.example.net/h", ["Vargas. Herring"]),
        2: (None, None, None, None), 3: (2021, None, None, None),
    }
    markers = ["[7]", "[4056]", "(Okafor, 2011)", "note a", "[3][9]", "[3, 9]", "( x )"]
    ids = spark.createDataFrame(list(enumerate(markers)), "doc_id bigint, m string").select("doc_id", C.marker_id(F.col("m")).alias("i"))
    assert column(ids, "i") == ["7", "4056", "Okafor", "note a", "3", "3, 9", "x"]


def test_markers(spark):
    texts = ["Seals dive deep (Okafor et al., 2011) at dusk.", "a [4] b [4]", "[5][6][7]", "(okafor, 2011) [x]"]
    df = papers(spark, *texts).select("doc_id", C.markers(F.col("text")).alias("m"))
    assert column(df, "m") == [["(Okafor et al., 2011)"], ["[4]"], ["[5]", "[6]", "[7]"], []]


def test_doi(spark):
    texts = ["see 10.1000/xyz.", "doi:10.12345/a(b) end", "10.99/no", "", "(10.5555/ab]c)"]
    df = papers(spark, *texts).select("doc_id", C.doi(F.col("text")).alias("d"))
    assert column(df, "d") == ["10.1000/xyz", "10.12345/a(b", None, None, "10.5555/ab"]


def test_pages_and_model_fallback(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 10, "c"), (2, 1, "z")], "doc_id bigint, page_no int, text string")
    assert {r.doc_id: r.text for r in D.assemble_pages(pages).collect()} == {1: "a\n\nb\n\nc", 2: "z"}

    def model(batch):
        return batch.assign(answer=['{"1": "An entry from the model"}' if "prose" in t else "not json" for t in batch.model_input])

    df = papers(spark, PAPER, "prose only", "neither")
    got = sorted((r.doc_id, r.citation_id) for r in D.extract_citations(df, model).collect())
    assert got == [(0, "1"), (0, "2"), (0, "3"), (1, "1")]
