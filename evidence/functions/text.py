"""Text helpers that follow Python string semantics on Spark columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence import constants as K


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(K.SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """Whitespace runs become one space; ends are trimmed."""
    return strip(F.regexp_replace(c, K.SPACE + "+", " "))


def not_empty(c: Column) -> Column:
    return F.when(c != "", c)


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def stripped_lines(c: Column) -> Column:
    """Trimmed lines without the blank ones."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def is_upper(c: Column) -> Column:
    """At least one cased character and none in lower case."""
    return (c == F.upper(c)) & (c != F.lower(c))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(c, F.lit(word))
    return found


def ends_with_any(c: Column, suffixes: Iterable[str]) -> Column:
    found = F.lit(False)
    for suffix in suffixes:
        found = found | c.endswith(suffix)
    return found


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null (``regexp_extract`` alone cannot tell '' from no match)."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(1))


def sentences(c: Column) -> Column:
    """Pieces between sentence ends; the end mark stays with its sentence."""
    return F.split(c, rf"(?<=[.!?]){K.SPACE}+")


def token_count(c: Column) -> Column:
    """Words plus punctuation marks; the default for every ``tokens`` parameter."""
    return F.size(F.regexp_extract_all(c, F.lit(K.TOKEN_PATTERN), F.lit(0)))


def word_keys(c: Column) -> Column:
    """Distinct lower-case words of two or more characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(K.WORD + "{2,}"), F.lit(0)))


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_json(c: Column) -> Column:
    """Whether the whole text is one JSON value.

    The parser stops after the first value, so the text is tried inside an
    array and inside an object: what follows a value would have to fit both.
    """
    in_array = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.coalesce((F.size(in_array) == 1) & in_object.isNotNull(), F.lit(False))
