"""Fact-check ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions.text import contains_any


def rating_passes(rating: Column, mode: str = "reference") -> Column:
    """Whether a textual rating supports the claim.

    ``reference`` tests positive words as substrings, so "incorrect" passes;
    ``word`` matches whole words only.
    """
    low = F.lower(rating)
    if mode == "reference":
        return contains_any(low, K.POSITIVE_RATINGS)
    if mode == "word":
        return low.rlike(r"\b(" + "|".join(K.POSITIVE_RATINGS) + r")\b") & ~low.rlike(r"\bnot\b")
    raise ValueError(f"unknown mode: {mode}")


def rating_confidence(rating: Column, similarity: Column) -> Column:
    low = F.lower(rating)
    base = (
        F.when(contains_any(low, K.CLEAR_RATINGS), F.lit(K.CLEAR_CONFIDENCE))
        .when(contains_any(low, K.HEDGED_RATINGS), F.lit(K.HEDGED_CONFIDENCE))
        .otherwise(F.lit(K.OTHER_CONFIDENCE))
    )
    return F.least(base * similarity, F.lit(1.0))
