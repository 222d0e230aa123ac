"""Greedy chunkers: a fold over the sentences of one text, inside the JVM, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions.text import bind, sentences, strip, token_count

_STRINGS = "array<string>"
_TOKEN_CHUNKS = "array<struct<chunk_id:int,text:string,start_pos:int,end_pos:int,token_count:int>>"


def char_chunks(text: Column, size: int = K.CHUNK_CHARS) -> Column:
    """Sentences packed up to ``size`` characters; each chunk repeats the last sentence before it."""
    parts = F.filter(
        F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\. "), strip), lambda s: s != ""
    )

    def close(cur: Column) -> Column:
        return F.concat(F.array_join(cur, ". "), F.lit("."))

    def step(acc: Column, s: Column) -> Column:
        n = F.length(s)
        last = F.try_element_at(acc["cur"], F.lit(-1))
        full = (acc["used"] + n > size) & (F.size(acc["cur"]) > 0)
        return F.when(
            full,
            F.struct(
                F.concat(acc["done"], F.array(close(acc["cur"]))).alias("done"),
                F.array(last, s).alias("cur"),
                (F.length(last) + n).alias("used"),
            ),
        ).otherwise(
            F.struct(
                acc["done"].alias("done"),
                F.concat(acc["cur"], F.array(s)).alias("cur"),
                (acc["used"] + n).alias("used"),
            )
        )

    start = F.struct(
        F.array().cast(_STRINGS).alias("done"),
        F.array().cast(_STRINGS).alias("cur"),
        F.lit(0).alias("used"),
    )
    return F.aggregate(
        parts,
        start,
        step,
        lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(close(acc["cur"]))))
        .otherwise(acc["done"]),
    )


def token_chunks(
    text: Column,
    size: int = K.CHUNK_TOKENS,
    overlap: int = K.CHUNK_OVERLAP_CHARS,
    tokens: Callable[[Column], Column] = token_count,
) -> Column:
    """Sentences packed up to ``size`` tokens.

    The next chunk starts with the trailing sentences of the one before that
    fit in ``overlap`` characters. Offsets count one space between sentences.
    """
    parts = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), tokens(s).alias("n")))
    kind = "array<struct<s:string,n:int>>"

    def joined(cur: Column) -> Column:
        return F.array_join(F.transform(cur, lambda x: x["s"]), " ")

    def total(cur: Column) -> Column:
        return F.aggregate(cur, F.lit(0), lambda a, x: a + x["n"])

    def chunk(acc: Column, body: Column) -> Column:
        return F.struct(
            F.size(acc["done"]).alias("chunk_id"),
            body.alias("text"),
            acc["pos"].alias("start_pos"),
            (acc["pos"] + F.length(body)).alias("end_pos"),
            acc["used"].alias("token_count"),
        )

    def carried(acc: Column, body: Column) -> Column:
        cur = acc["cur"]
        fits = F.filter(
            cur,
            lambda _, i: F.length(joined(F.slice(cur, i + 1, F.size(cur)))) <= overlap,
        )
        return F.when((F.lit(overlap) > 0) & (F.length(body) >= overlap), fits).otherwise(
            F.array().cast(kind)
        )

    def closed(acc: Column, s: Column) -> Column:
        def with_body(body: Column) -> Column:
            def with_carry(carry: Column) -> Column:
                cur = F.concat(carry, F.array(s))
                back = F.when(
                    (F.lit(overlap) > 0) & (F.length(body) >= overlap), F.length(joined(carry))
                ).otherwise(F.lit(-1))
                return F.struct(
                    F.concat(acc["done"], F.array(chunk(acc, body))).alias("done"),
                    cur.alias("cur"),
                    total(cur).alias("used"),
                    (acc["pos"] + F.length(body) - back).alias("pos"),
                )

            return bind(carried(acc, body), with_carry)

        return bind(joined(acc["cur"]), with_body)

    def step(acc: Column, s: Column) -> Column:
        return F.when((acc["used"] + s["n"] > size) & (F.size(acc["cur"]) > 0), closed(acc, s)).otherwise(
            F.struct(
                acc["done"].alias("done"),
                F.concat(acc["cur"], F.array(s)).alias("cur"),
                (acc["used"] + s["n"]).alias("used"),
                acc["pos"].alias("pos"),
            )
        )

    start = F.struct(
        F.array().cast(_TOKEN_CHUNKS).alias("done"),
        F.array().cast(kind).alias("cur"),
        F.lit(0).alias("used"),
        F.lit(0).alias("pos"),
    )

    def finish(acc: Column) -> Column:
        return F.when(
            F.size(acc["cur"]) > 0,
            F.concat(acc["done"], F.array(bind(joined(acc["cur"]), lambda body: chunk(acc, body)))),
        ).otherwise(acc["done"])

    return F.aggregate(parts, start, step, finish)
