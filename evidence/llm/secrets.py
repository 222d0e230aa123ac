"""Secrets: keys by pattern, and values beside words like "password" by what it costs to guess them.

The cost of a value, in bits, is the least over all ways to cut it into words,
dates, repeats, keyboard walks and brute-force spans, found by dynamic
programming over the places of the value. A word costs the logarithm of its
rarity among all words of the corpus, credential values left out, so prose and
place holders are cheap and random strings are not.

Three Spark steps: texts give patterns, values and sums of words; the letter
runs of distinct values meet the counts of words; every distinct value is cut
once, and the costly ones are marked wherever they stand.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import texts_of
from evidence.session import materialize

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of hex digits is one match, so shorter ones need no look
#: What every credential word holds, in lower case; texts without any have no values.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_-]?key|credentials?|auth(?:orization)?|bearer)[A-Za-z0-9_-]{0,32}"""
    r"""(?:["']?\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+|(?i:(?<=bearer))\x20+)["'`]?([^\s"'`<>,;]{8,})""",
    re.ASCII,
)
#: Bits from which a value counts as a secret.
THRESHOLD = 40.0
SHORTEST, LONGEST = 3, 24
WORD = re.compile(rf"[a-z]{{{SHORTEST},}}")
#: Distinct words a task sums up before it emits them, and rows of a batch that are Python objects at a time.
SUMMED, ROWS = 1 << 17, 256

LEET = str.maketrans("013457@$!", "oleastasi")
KEYS = ("1234567890", "qwertyuiop", "asdfghjkl;", "zxcvbnm,./")
PLACE = {c: (x, y) for y, row in enumerate(KEYS) for x, c in enumerate(row)}
DATE = re.compile(
    r"(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\3(?:19|20)\d\d))"
)
YEAR = re.compile(r"(?=((?:19|20)\d\d))")
YEARS, DAYS, UNIT = 120, 365, 8
SEGMENT = 1.0  # bits for saying what kind of segment comes


def char_bits(c: str) -> float:
    """Bits of one character tried by brute force."""
    if not c.isascii():
        return 7.0
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)


def plain_form(value: str) -> str:
    """Lower case with digits and signs that stand for letters replaced, place by place."""
    return "".join(c.lower() if c.isascii() else "\0" for c in value).translate(LEET)


def word_places(value: str) -> Iterator[tuple[int, int, str]]:
    """Begin, end and letters of every span that may be a word."""
    for form in {plain_form(value), "".join(c.lower() if c.isascii() else "\0" for c in value)}:
        for run in WORD.finditer(form):
            for i in range(run.start(), run.end() - SHORTEST + 1):
                for j in range(i + SHORTEST, min(run.end(), i + LONGEST) + 1):
                    if any(c.isalpha() for c in value[i:j]):
                        yield i, j, form[i:j]


def case_bits(span: str) -> float:
    """Bits for upper case: one for a first or all letters, else the choice of places."""
    letters = sum(c.isalpha() for c in span)
    upper = sum(c.isupper() for c in span)
    if upper == 0:
        return 0.0
    return 1.0 if upper == letters or (upper == 1 and span[0].isupper()) else math.log2(math.comb(letters, upper)) + 1


def step(a: str, b: str) -> tuple[int, int] | None:
    """The way from a key to a neighbour of it; None if they are none."""
    p, q = PLACE.get(a), PLACE.get(b)
    if p is None or q is None:
        return None
    move = q[0] - p[0], q[1] - p[1]
    return move if max(map(abs, move)) <= 1 and move != (0, 0) else None


def patterns(value: str, words: dict[str, float]) -> Iterator[tuple[int, int, float, str]]:
    """Begin, end, bits and kind of every span that is cheaper than brute force may be."""
    n, low = len(value), "".join(c.lower() if c.isascii() else "\0" for c in value)
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + char_bits(c))
    for i, j, word in word_places(value):
        bits = words.get(word)
        if bits is not None:
            swapped = sum(a != b for a, b in zip(low[i:j], word, strict=True))
            yield i, j, bits + case_bits(value[i:j]) + (swapped + 1 if swapped else 0), "word"
    for m in DATE.finditer(value):
        yield m.start(), m.end(1), math.log2(YEARS * DAYS) + 2, "date"
    for m in YEAR.finditer(value):
        yield m.start(), m.end(1), math.log2(YEARS), "date"
    for u in range(1, min(UNIT, n // 2) + 1):
        same = 0
        for i in range(n - u - 1, -1, -1):
            same = same + 1 if value[i] == value[i + u] else 0
            if same >= max(u, 2):
                unit = value[i : i + u]
                bits = min(brute[i + u] - brute[i], words.get(unit.lower(), math.inf))
                yield i, i + u + same, bits + math.log2((u + same) / u), "repeat"
    end, turns, before = n, 0, None  # the longest walk from each key, from the last one backwards
    for i in range(n - 2, -1, -1):
        move = step(low[i], low[i + 1])
        if move is None:
            end, turns, before = i + 1, 0, None
            continue
        turns, before = turns + (before is not None and move != before), move
        if end - i >= 4:
            shifted = case_bits(value[i:end])
            yield i, end, math.log2(len(PLACE)) + 3 * (turns + 1) + math.log2(end - i) + shifted, "walk"


def guess_cost(value: str, words: dict[str, float]) -> tuple[float, list[tuple[str, str]]]:
    """The least bits to guess a value, and the segments that cost them; ``words`` gives the bits of known words."""
    n = len(value)
    ending: dict[int, list[tuple[int, float, str]]] = {}
    for i, j, bits, kind in patterns(value, words):
        ending.setdefault(j, []).append((i, bits + SEGMENT, kind))
    best, way = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    for j in range(1, n + 1):
        begun = j > 1 and way[j - 1][1] == "brute"
        best[j], way[j] = best[j - 1] + char_bits(value[j - 1]) + (0 if begun else SEGMENT), (j - 1, "brute")
        for i, bits, kind in ending.get(j, ()):
            if best[i] + bits < best[j]:
                best[j], way[j] = best[i] + bits, (i, kind)
    cut, j = [], n
    while j:
        i, kind = way[j]
        while kind == "brute" and i and way[i][1] == "brute":
            i = way[i][0]
        cut.append((kind, value[i:j]))
        j = i
    return best[n], cut[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Begin, number of the kind and end of what the patterns find, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def values_of(text: str) -> list[tuple[int, int, str]]:
    """Begin, end and text of values beside credential words; marks that end a sentence do not belong to them."""
    made = []
    for m in CONTEXT.finditer(text):
        value = m.group(1).rstrip(".:!?)]}")
        if len(value) >= 8:
            made.append((m.start(1), m.start(1) + len(value), value))
    return made


def without(text: str, values: list[tuple[int, int, str]]) -> str:
    """The text with its values blanked out, so that they do not count as words."""
    ends = [0, *(b for _, b, _ in values)]
    return " ".join(text[a:b] for a, b in zip(ends, [*(a for a, _, _ in values), len(text)], strict=True))


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = "struct<start:int,kind:int,end:int>"
FOUND = f"n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base array<{SPAN}>, found array<struct<start:int,end:int,value:string>>, words array<string>, times array<bigint>"


def _finding(schema: pa.Schema):
    """A row for each text, and rows without a number that hold the sums of words of a task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sums() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if len(w) <= LONGEST]
            return pa.RecordBatch.from_pylist([{"words": [w for w, _ in kept], "times": [n for _, n in kept]}], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, made = batch.slice(at, ROWS), []
                for row, doc_id, text in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), texts_of(part, "_text"), strict=True):
                    low = text.lower()
                    hinted = any(h in low for h in HINTS)
                    values = values_of(text) if hinted else []
                    counts.update(WORD.findall(without(text, values).lower() if values else low))
                    base = base_spans(text)
                    kinds = [k for _, k, _ in base]
                    made.append({
                        "row": row, "doc_id": doc_id, "n_assign": kinds.count(0), "n_access": kinds.count(1), "n_hex": kinds.count(2),
                        "base_sha256": hashlib.sha256(said(base).encode()).hexdigest(),
                        "base": [{"start": a, "kind": k, "end": b} for a, k, b in base],
                        "found": [{"start": a, "end": b, "value": v} for a, b, v in values],
                    })
                    if len(counts) > SUMMED:
                        yield sums()
                        counts.clear()
                yield pa.RecordBatch.from_pylist(made, schema=schema)
        if counts:
            yield sums()

    return find


def _spreading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values to the words that may be in them."""
    for batch in batches:
        for digest, value in zip(batch.column("digest").to_pylist(), batch.column("value").to_pylist(), strict=True):
            words = sorted({w for _, _, w in word_places(value)})
            yield pa.RecordBatch.from_arrays([pa.array([digest] * len(words), pa.binary()), pa.array(words, pa.string())], ["digest", "word"])


def _costing(total: int):
    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value, known in zip(batch.column("value").to_pylist(), batch.column("known").to_pylist(), strict=True):
                words = {k["word"]: math.log2(total / k["n"]) for k in known or ()}
                made.append(guess_cost(value, words)[0])
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(made, pa.float64())], ["digest", "bits"])

    return cost


def value_costs(values: DataFrame, words: DataFrame) -> DataFrame:
    """``digest`` and ``bits`` of distinct values (``digest``, ``value``), from ``word`` and ``n`` of the corpus."""
    total = words.agg(F.sum("n")).first()[0] or 1
    parts = values.mapInArrow(_spreading, "digest binary, word string")
    known = parts.join(words, "word").groupBy("digest").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return values.join(known, "digest", "left").mapInArrow(_costing(total), "digest binary, bits double")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_guess``, ``base_sha256``, ``spans``.

    ``spans`` lists ``kind:start:end``, in code points, by start and kind: what
    the patterns find, and as ``guess`` every value beside a credential word
    that takes ``threshold`` bits or more to guess; such a value may lie inside
    an ``assign`` span. Words count over all texts, their credential values left
    out. Null is the empty text. Repeated rows keep a row each; other columns
    are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = f"row bigint, doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FOUND}"
    shape = docs.sparkSession.createDataFrame([], kind).toArrow().schema
    table = materialize(rows.mapInArrow(_finding(shape), kind), "secrets")
    texts = table.where("row IS NOT NULL")
    sums = table.where("row IS NULL").select(F.explode(F.arrays_zip("words", "times")).alias("x"))
    words = materialize(sums.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.times").alias("n")), "words")
    placed = texts.select("row", F.explode("found").alias("x")).select("row", "x.*").withColumn("digest", F.unhex(F.sha2(F.col("value").cast("binary"), 256)))
    values = materialize(placed.groupBy("digest").agg(F.min("value").alias("value")), "values")
    costly = materialize(value_costs(values, words).where(F.col("bits") >= threshold).select("digest"), "costly")
    span = F.struct("start", F.lit(KINDS.index("guess")).alias("kind"), "end")
    marked = placed.join(costly, "digest").groupBy("row").agg(F.collect_list(span).alias("guess"))
    guess = F.coalesce("guess", F.array().cast(f"array<{SPAN}>"))
    every = F.array_sort(F.concat("base", guess))
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])
    return texts.join(marked, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", F.size(guess).cast("bigint").alias("n_guess"),
        "base_sha256", F.array_join(F.transform(every, one), ",").alias("spans"),
    )
