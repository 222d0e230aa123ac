"""Citation markers, bibliography entries and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions.text import first_match, not_empty, strip


def markers(text: Column) -> Column:
    """Distinct ``[n]`` and ``(Name, year)`` markers."""
    return F.array_distinct(
        F.concat(
            F.regexp_extract_all(text, F.lit(K.NUMERIC_MARKER), F.lit(0)),
            F.regexp_extract_all(text, F.lit(K.AUTHOR_MARKER), F.lit(0)),
        )
    )


def first_marker(text: Column) -> Column:
    return not_empty(F.regexp_extract(text, f"{K.NUMERIC_MARKER}|{K.AUTHOR_MARKER}", 0))


def marker_id(marker: Column) -> Column:
    """``[12]`` gives 12, ``(Smith, 2020)`` gives Smith, anything else loses its brackets."""
    return F.coalesce(
        not_empty(F.regexp_extract(marker, rf"\[({K.DIGIT}+)\]", 1)),
        not_empty(F.regexp_extract(marker, r"\(([A-Z][a-z]+)", 1)),
        strip(F.btrim(marker, F.lit("[]()"))),
    )


def details(raw: Column) -> Column:
    """Year, DOI, URL and first author of a bibliography entry, as a struct."""
    year_text = not_empty(F.regexp_extract(raw, rf"({K.DIGIT}{{4}})", 1))
    # A bracketed year is found one character earlier, so the text before it is shorter.
    before = F.regexp_extract(raw, rf"(?s)^(.*?)(?:\({K.DIGIT}{{4}}\)|{K.DIGIT}{{4}})", 1)
    author = F.element_at(F.split(strip(before), "[,;&]"), 1)
    doi = F.rtrim(
        not_empty(F.regexp_extract(raw, r"(?i)doi[:\t-\r\x1c-\x1f\x85\p{Z}]*(10\.[^\t-\r\x1c-\x1f\x85\p{Z}]+)", 1)),
        F.lit("."),
    )
    url = F.rtrim(
        not_empty(F.regexp_extract(raw, r"https?://[^\t-\r\x1c-\x1f\x85\p{Z}]+", 0)), F.lit(".,;")
    )
    return F.struct(
        F.lit(None).cast("string").alias("title"),
        F.when(
            year_text.isNotNull() & (author != ""), F.array(F.rtrim(strip(author), F.lit(".")))
        ).alias("authors"),
        year_text.try_cast("int").alias("year"),
        url.alias("url"),
        doi.alias("doi"),
        raw.alias("raw_text"),
    )


def doi(text: Column) -> Column:
    """First DOI anywhere in the text, with trailing full stops removed."""
    return F.rtrim(not_empty(F.regexp_extract(text, K.DOI_PATTERN, 1)), F.lit("."))


def entry_parts(entries: Column, key_pattern: str) -> Column:
    """Turn numbered raw entries into structs of key and squeezed text; others are dropped."""
    body = rf"(?s)^{key_pattern}{K.SPACE}+(.+)"

    def part(entry: Column) -> Column:
        return F.struct(
            not_empty(F.regexp_extract(entry, body, 1)).alias("citation_id"),
            strip(F.regexp_replace(F.regexp_extract(entry, body, 2), K.SPACE + "+", " ")).alias(
                "citation_text"
            ),
        )

    parts = F.transform(F.transform(entries, strip), part)
    return F.filter(parts, lambda p: p["citation_id"].isNotNull())


def numeric_entries(section: Column) -> Column:
    split_at = rf"\n(?={K.DIGIT}+\.?{K.SPACE}+[A-Z])"
    return entry_parts(F.split(section, split_at), rf"({K.DIGIT}+)\.?")


def bracket_entries(section: Column) -> Column:
    split_at = rf"\n(?=\[{K.DIGIT}+\]{K.SPACE})"
    return entry_parts(F.split(section, split_at), rf"\[({K.DIGIT}+)\]")


def author_entries(trimmed_section: Column) -> Column:
    """Entries that start with ``Surname, I.``; following lines belong to the entry before them.

    Takes a section whose lines are trimmed and non-blank.
    """
    start = rf"{K.WORD}+,{K.SPACE_INLINE}+{K.WORD}\."
    groups = F.filter(F.split(trimmed_section, rf"\n(?={start})"), lambda g: g.rlike("^" + start))
    return F.transform(
        groups,
        lambda g: F.struct(
            F.substring_index(g, ",", 1).alias("citation_id"),
            F.replace(g, F.lit("\n"), F.lit(" ")).alias("citation_text"),
        ),
    )
