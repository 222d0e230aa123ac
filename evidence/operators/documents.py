"""Structure of a paper: title, abstract, reference section, bibliography."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions import citations as C
from evidence.functions.text import (
    bind, contains_any, first_match, is_upper, lines, not_empty, strip, stripped_lines,
)
from evidence.operators.hook import score


def assemble_pages(pages: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """One text per document: its pages in order, separated by a blank line.

    The result is one value per document by definition, so its size is bounded
    by what one text may hold; page texts are only sorted within a document.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page), F.col(text))))
    return pages.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda p: p[text]), "\n\n").alias("text")
    )


def title_of(text: Column, within: int | None = None) -> Column:
    """The first line, of the first ``within`` (default all), that is longer than 10 characters and not all upper case."""
    shown = lines(text) if within is None else F.slice(lines(text), 1, within)
    return F.try_element_at(
        F.filter(F.transform(shown, strip), lambda x: (F.length(x) > 10) & ~is_upper(x)), F.lit(1)
    )


def abstract_of(text: Column, within: int | None = None, following: int | None = None) -> Column:
    """Lines after the first heading that names an abstract and is followed by any text, up to a line that stops it.

    ``within`` bounds the lines that may hold the heading, ``following`` those
    after it that are read; by default neither is bounded.
    """

    def stops(x: Column) -> Column:
        return (is_upper(x) & (F.length(x) > 5)) | contains_any(F.lower(x), K.ABSTRACT_STOPS)

    def collect(filled: Column) -> Column:
        # Lines that are not blank, with their numbers, whether they name an abstract and whether they stop one.
        at = lambda k: F.element_at(filled, k.cast("int"))
        near = lambda k: F.lit(True) if following is None else at(k + 1)["no"] <= at(k)["no"] + following
        early = lambda k: F.lit(True) if within is None else at(k)["no"] < within
        heading = F.when(F.size(filled) > 1, F.try_element_at(F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(filled) - 1, F.lit(1))),
            lambda k: at(k)["names"] & early(k) & ~at(k + 1)["stops"] & near(k)), F.lit(1)))

        def rest(k: Column) -> Column:
            after = F.slice(filled, k + 1, F.size(filled))
            if following is not None:
                after = F.filter(after, lambda x: x["no"] <= at(k)["no"] + following)
            return bind(after, lambda xs: bind(
                F.array_position(F.transform(xs, lambda x: x["stops"]), True),
                lambda p: F.array_join(F.transform(F.when(p == 0, xs).otherwise(F.slice(xs, 1, (p - 1).cast("int"))), lambda x: x["line"]), " ")))

        return bind(heading, lambda k: F.when(k.isNotNull(), rest(k)))

    numbered = F.transform(F.transform(lines(text), strip), lambda x, no: F.struct(
        x.alias("line"), no.alias("no"), contains_any(F.lower(x), K.ABSTRACT_WORDS).alias("names"), stops(x).alias("stops")))
    return bind(F.filter(numbered, lambda x: x["line"] != ""), collect)


def reference_section_of(text: Column, search_from: float = K.BODY_SHARE) -> Column:
    """Text after the first heading line; else from a heading word behind ``search_from`` of the text; else null.

    Without a heading line, words like "references" nearer the begin are taken
    for prose; ``search_from=0`` searches all of the text.
    """
    after_heading = [
        strip(first_match(text, rf"(?imsd)^{word.replace(' ', '[ ]')}{K.SPACE}*$(.*)", 1))
        for word in K.REFERENCE_HEADINGS
    ]
    tail = F.substring(text, (F.floor(F.length(text) * search_from) + 1).cast("int"), F.length(text))

    def from_word(t: Column) -> Column:
        low = F.lower(t)
        options = []
        for word in K.REFERENCE_HEADINGS:
            at = F.locate(word, low)
            options.append(F.when(at > 0, F.substring(t, at, F.length(t))))
        return F.coalesce(*options)

    return F.coalesce(*after_heading, bind(tail, from_word))


def body_of(text: Column, section: Column, share: float = 1) -> Column:
    """Text before the reference section; without one the first ``share`` of the text, by default all of it."""
    rest = text if share >= 1 else F.substring(text, F.lit(1), F.floor(F.length(text) * share).cast("int"))
    return F.when(
        section.isNotNull() & (section != ""),
        F.substring(text, F.lit(1), F.instr(text, section) - 1),
    ).otherwise(rest)


def style_of(section: Column, within: int | None = None) -> Column:
    """First citation style that matches in the non-blank lines, or in the first ``within`` of them."""
    filled = F.filter(lines(section), lambda x: strip(x) != "")
    shown = F.array_join(filled if within is None else F.slice(filled, 1, within), "\n")

    def detect(t: Column) -> Column:
        style = F.lit(None).cast("string")
        for name, pattern in reversed(K.CITATION_STYLES):
            style = F.when(t.rlike("(?md)" + pattern), F.lit(name)).otherwise(style)
        return style

    return bind(shown, detect)


def paper_title(papers: DataFrame, within: int | None = None) -> DataFrame:
    return papers.select("doc_id", title_of(F.col("text"), within).alias("title"))


def paper_abstract(papers: DataFrame, within: int | None = None, following: int | None = None) -> DataFrame:
    return papers.select("doc_id", abstract_of(F.col("text"), within, following).alias("abstract"))


def reference_section(papers: DataFrame) -> DataFrame:
    return papers.select("doc_id", reference_section_of(F.col("text")).alias("ref_section"))


def with_sections(papers: DataFrame) -> DataFrame:
    """Papers with ``ref_section``, ``style`` and ``body``; all later parsing starts from here."""
    return (
        papers.withColumn("ref_section", reference_section_of(F.col("text")))
        .withColumn("style", style_of(F.col("ref_section")))
        .withColumn("body", body_of(F.col("text"), F.col("ref_section")))
    )


def body_text(papers: DataFrame, share: float = 1) -> DataFrame:
    return papers.select(
        "doc_id", body_of(F.col("text"), reference_section_of(F.col("text")), share).alias("body")
    )


def citation_style(sections: DataFrame, within: int | None = None) -> DataFrame:
    return sections.select("doc_id", style_of(F.col("ref_section"), within).alias("style"))


def _explode_entries(sections: DataFrame, styles: tuple[str, ...], entries: Column) -> DataFrame:
    return (
        sections.where(F.col("style").isin(*styles))
        .select("doc_id", F.posexplode(entries).alias("pos", "_entry"))
        .select("doc_id", "pos", "_entry.citation_id", "_entry.citation_text")
    )


def parse_refs_numeric(sections: DataFrame) -> DataFrame:
    return _explode_entries(sections, ("numeric", "vancouver"), C.numeric_entries(F.col("ref_section")))


def parse_refs_bracket(sections: DataFrame) -> DataFrame:
    return _explode_entries(sections, ("bracket_numeric",), C.bracket_entries(F.col("ref_section")))


def parse_refs_apa(sections: DataFrame) -> DataFrame:
    trimmed = F.array_join(stripped_lines(F.col("ref_section")), "\n")
    return _explode_entries(sections, ("apa",), C.author_entries(trimmed))


def parse_refs(sections: DataFrame) -> DataFrame:
    """All entries in one pass over the sections, whichever style each has."""
    ref = F.col("ref_section")
    entries = (
        F.when(F.col("style").isin("numeric", "vancouver"), C.numeric_entries(ref))
        .when(F.col("style") == "bracket_numeric", C.bracket_entries(ref))
        .when(F.col("style") == "apa", C.author_entries(F.array_join(stripped_lines(ref), "\n")))
    )
    return sections.select("doc_id", F.posexplode(entries).alias("pos", "_entry")).select(
        "doc_id", "pos", "_entry.citation_id", "_entry.citation_text"
    )


def citation_last_wins(entries: DataFrame) -> DataFrame:
    """One row per key; the later entry replaces the earlier, and ``n_entries`` shows collisions."""
    return entries.groupBy("doc_id", "citation_id").agg(
        F.max_by("citation_text", "pos").alias("citation_text"),
        F.max("pos").alias("pos"),
        F.count(F.lit(1)).alias("n_entries"),
    )


def validate_bibliography(citations: DataFrame, min_citations: int = 1) -> DataFrame:
    """Per document: does the bibliography have enough entries of plausible length?"""
    plausible = F.length("citation_text").between(K.MIN_ENTRY_CHARS, K.MAX_ENTRY_CHARS)
    return (
        citations.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n_citations"), F.count_if(plausible).alias("n_plausible"))
        .withColumn(
            "is_valid",
            (F.col("n_citations") >= min_citations)
            & (F.col("n_plausible") >= F.greatest(F.lit(1.0), F.col("n_citations") * K.VALID_SHARE)),
        )
    )


def citation_route(sections: DataFrame, validity: DataFrame) -> DataFrame:
    """Per paper ``parsed`` or ``model``, with the text the model has to read."""
    usable = not_empty(F.col("ref_section"))
    return (
        sections.join(validity.select("doc_id", "is_valid"), "doc_id", "left")
        .withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))
        .withColumn("route", F.when(F.col("is_valid"), F.lit("parsed")).otherwise(F.lit("model")))
        .withColumn("model_input", F.when(~F.col("is_valid"), F.coalesce(usable, F.col("text"))))
        .select("doc_id", "style", "route", "model_input")
    )


def citations_from_answer(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Entries of a model answer: an object of id to text, bare or wrapped in ``citations``."""
    mapping = "map<string,string>"
    wrapped = F.from_json(F.get_json_object(answer, "$.citations"), mapping)
    bare = F.from_json(F.col(answer), mapping)
    entries = F.map_entries(F.coalesce(wrapped, bare))
    return answers.select("doc_id", F.posexplode(entries).alias("pos", "_pair")).select(
        "doc_id", "pos", F.col("_pair.key").alias("citation_id"), F.col("_pair.value").alias("citation_text")
    )


def parse_refs_model(route: DataFrame, model: Callable) -> DataFrame:
    """Send only the papers the rules could not parse to the model."""
    todo = route.where(F.col("route") == "model").select("doc_id", "model_input")
    answered = score(todo, model, ["model_input"], "answer string", task="reference_parsing")
    return citations_from_answer(answered)


def extract_citations(papers: DataFrame, model: Callable | None = None, positions: bool = False) -> DataFrame:
    """Bibliographies of all papers, with ``is_valid``: whether the rules found enough plausible entries in the paper.

    Without a model every entry the rules found is kept, valid or not. A model
    reads the papers whose bibliography is not valid instead of the rules; its
    entries have a null ``is_valid``. ``positions`` adds ``pos``, the place of
    each entry in its list.
    """
    columns = ["doc_id", "citation_id", "citation_text", "is_valid", *(["pos"] if positions else [])]
    sections = papers.withColumn("ref_section", reference_section_of(F.col("text"))).withColumn(
        "style", style_of(F.col("ref_section"))
    )
    parsed = citation_last_wins(parse_refs(sections))
    validity = validate_bibliography(parsed)
    flagged = parsed.join(validity.select("doc_id", "is_valid"), "doc_id").select(*columns)
    if model is None:
        return flagged
    asked = citation_last_wins(parse_refs_model(citation_route(sections, validity), model))
    return flagged.where("is_valid").unionByName(asked.withColumn("is_valid", F.lit(None).cast("boolean")).select(*columns))
