"""The JVM folds against plain loops over many texts."""

import random
import re

from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions.chunks import char_chunks, token_chunks


def tokens(s):
    import regex

    return len(regex.findall(K.TOKEN_PATTERN, s))


def loop_chars(text, size):
    """Chunks as lists of sentence indices, built from prefix bounds."""
    parts = [p.strip() for p in text.replace("\n", " ").split(". ")]
    parts = [p for p in parts if p]
    spans, first, used = [], 0, 0
    for i, part in enumerate(parts):
        if i > first and used + len(part) > size:
            spans.append((first, i))
            first, used = i - 1, len(parts[i - 1])
        used += len(part)
    if parts:
        spans.append((first, len(parts)))
    return [". ".join(parts[a:b]) + "." for a, b in spans]


def loop_tokens(text, size, overlap):
    parts = re.split(r"(?<=[.!?])\s+", text)
    out, first, used, pos = [], 0, 0, 0
    for i, part in enumerate(parts):
        n = tokens(part)
        if i > first and used + n > size:
            body = " ".join(parts[first:i])
            out.append((len(out), body, pos, pos + len(body), used))
            if 0 < overlap <= len(body):
                keep = i
                while keep > first and len(" ".join(parts[keep - 1:i])) <= overlap:
                    keep -= 1
                pos += len(body) - len(" ".join(parts[keep:i]))
                first = keep
                used = sum(tokens(p) for p in parts[first:i])
            else:
                pos, first, used = pos + len(body) + 1, i, 0
        used += n
    body = " ".join(parts[first:])
    return out + [(len(out), body, pos, pos + len(body), used)]


def texts():
    rng = random.Random(7)
    marks = [". ", "! ", "? ", ".\n", "; ", " .", ".  "]
    out = ["", " ", ".", "one", "a. b. c. d.", "é ü. ñ! ok?"]
    for _ in range(300):
        out.append("".join("".join(rng.choice("abcé ,") for _ in range(rng.randint(0, 40))) + rng.choice(marks)
                           for _ in range(rng.randint(1, 40))))
    return out


def test_char_chunks_equal_loop(spark):
    data = texts()
    df = spark.createDataFrame(list(enumerate(data)), "i int, t string")
    for size in (20, 60, 500):
        got = {r.i: list(r.c) for r in df.select("i", char_chunks(F.col("t"), size).alias("c")).collect()}
        assert all(got[i] == loop_chars(t, size) for i, t in enumerate(data))


def test_token_chunks_equal_loop(spark):
    data = texts()
    df = spark.createDataFrame(list(enumerate(data)), "i int, t string")
    for size, overlap in ((5, 30), (20, 100), (40, 0)):
        got = {
            r.i: [tuple(c) for c in r.c]
            for r in df.select("i", token_chunks(F.col("t"), size, overlap).alias("c")).collect()
        }
        wrong = [i for i, t in enumerate(data) if got[i] != loop_tokens(t, size, overlap)]
        assert not wrong, (wrong[0], got[wrong[0]], loop_tokens(data[wrong[0]], size, overlap))


def test_empty_text(spark):
    df = spark.createDataFrame([("",)], "t string")
    row = df.select(char_chunks(F.col("t")).alias("c"), token_chunks(F.col("t")).alias("k")).first()
    assert row.c == [] and [x.text for x in row.k] == [""]
