"""Personal data, and the terms that give it away.

Patterns find mail and network addresses, card and phone numbers in whole
texts. These are the protected entities. How strongly a term reveals an entity
is estimated from the corpus: the pointwise mutual information of both, over
contexts, as a share of what there is to know about the entity. A term at or
above a threshold is a disclosure wherever it stands with that entity: it is
generalised, or removed if it tells nearly all.

A context is a piece of a line of at most ``CONTEXT`` words. Only pairs within
one context are ever formed, so their number grows with the text, not with the
square of any group.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import texts_of
from evidence.session import materialize

# Fixed values of the task: the kinds in their order, and what each of them looks like.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a start inside of a number can match no better than its begin
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TERM = len(KINDS)
WORD = re.compile(r"[^\W\d_]{3,}")
CONTEXT = 32
#: Different contexts a pair has to occur in; shares of an entity's information that are generalised and removed.
SUPPORT = 3
GENERALISE, REMOVE = 0.6, 0.9
#: Terms that tasks are told to count; with more of them every term is counted.
KNOWN_TERMS = 1 << 17

Span = tuple[int, int, int]  # begin, kind, end


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every address has one @, so each @ is looked at once, with the characters before it."""
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            free = found.end()
            yield begin, free
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The spans of all kinds, by begin and kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def contexts(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of every context of a text."""
    at = 0
    for line in text.split("\n"):
        if len(line) < 2 * CONTEXT or len(line.split()) <= CONTEXT:
            if line and not line.isspace():
                yield at, at + len(line)
        else:
            words = [(m.start(), m.end()) for m in re.finditer(r"\S+", line)]
            for k in range(0, len(words), CONTEXT):
                yield at + words[k][0], at + words[min(k + CONTEXT, len(words)) - 1][1]
        at += len(line) + 1


def n_contexts(text: str) -> int:
    return sum(-(-len(line.split()) // CONTEXT) for line in text.split("\n"))


def entity(text: str, span: Span) -> int:
    """A number for a protected value, the same wherever the value stands."""
    begin, kind, end = span
    value = text[begin:end].lower() if kind < 2 else _digits(text[begin:end])
    return xxhash.xxh64_intdigest(f"{KINDS[kind]}:{value}".encode("utf-8", "surrogatepass")) - (1 << 63)


def protected_contexts(text: str, spans: list[Span]) -> list[dict]:
    """The contexts that hold an entity: a digest, the entities, and the terms with their places."""
    found, k = [], 0
    for begin, end in contexts(text) if spans else ():
        inside = []
        while k < len(spans) and spans[k][0] < end:
            inside.append(spans[k])
            k += 1
        if not inside:
            continue
        taken = [(a, b) for a, _, b in spans[max(0, k - len(inside) - 2) : k + 2]]
        terms = [
            {"term": m[0].lower(), "begin": m.start(), "end": m.end()} for m in WORD.finditer(text, begin, end)
            if not any(a < m.end() and m.start() < b for a, b in taken)
        ]
        digest = xxhash.xxh64_intdigest(text[begin:end].encode("utf-8", "surrogatepass")) - (1 << 63)
        found.append({"digest": digest, "entities": sorted({entity(text, s) for s in inside}), "terms": terms})
    return found


SPANS = "array<struct<begin:int,kind:int,end:int>>"
CONTEXTS = "array<struct<digest:bigint,entities:array<bigint>,terms:array<struct<term:string,begin:int,end:int>>>>"


def _arrow(kind: str) -> pa.DataType:
    spans = pa.struct([("begin", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    terms = pa.struct([("term", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])
    context = pa.struct([("digest", pa.int64()), ("entities", pa.list_(pa.int64())), ("terms", pa.list_(terms))])
    return pa.list_(spans if kind == "spans" else context)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, counted, near = [], [], []
        for text in texts_of(batch, "_text"):
            found = base_spans(text)
            spans.append([{"begin": a, "kind": k, "end": b} for a, k, b in found])
            counted.append(n_contexts(text))
            near.append(protected_contexts(text, found))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), pa.array(spans, _arrow("spans")), pa.array(counted, pa.int64()), pa.array(near, _arrow("contexts"))],
            ["_row", "_spans", "_n", "_contexts"],
        )


def _counting(known: frozenset | None):
    """Contexts that hold each of the ``known`` terms (or any term), summed up by batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for text in texts_of(batch, "_text"):
                if known is not None and known.isdisjoint({w.lower() for w in set(WORD.findall(text))}):
                    continue
                for begin, end in contexts(text):
                    terms = {m.lower() for m in WORD.findall(text, begin, end)}
                    n.update(terms if known is None else terms & known)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "_n"])

    return count


def disclosures(scanned: DataFrame, texts: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """``entity``, ``term`` and ``share`` of all pairs at or above ``threshold``, stored.

    ``share`` is log2(n_et N / (n_e n_t)) / log2(N / n_e), where N counts all
    contexts, n_e, n_t and n_et those with the entity, the term and both. A
    pair needs ``support`` contexts of different wording: copies of a text are
    one piece of evidence, though they count like others in the estimate.
    """
    seen = scanned.select(F.explode("_contexts").alias("_c")).select(F.col("_c.digest").alias("_d"), F.explode("_c.entities").alias("entity"), F.col("_c.terms.term").alias("_t"))
    pairs = seen.select("entity", "_d", F.explode(F.array_distinct("_t")).alias("term"))
    by_wording = pairs.groupBy("entity", "term", "_d").agg(F.count(F.lit(1)).alias("_k"))
    both = by_wording.groupBy("entity", "term").agg(F.sum("_k").alias("_both"), F.count(F.lit(1)).alias("_wordings")).where(F.col("_wordings") >= support)
    both = materialize(both, "pairs")
    terms = both.select("term").distinct()
    some = [r["term"] for r in terms.limit(KNOWN_TERMS + 1).collect()]
    known = frozenset(some) if len(some) <= KNOWN_TERMS else None
    counted = texts.mapInArrow(_counting(known), "term string, _n bigint").groupBy("term").agg(F.sum("_n").alias("_term"))
    entities = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("_entity"))
    total = float(scanned.agg(F.sum("_n")).first()[0] or 0)
    tells = F.log2(F.col("_both") * total / (F.col("_entity") * F.col("_term"))) / F.log2(F.lit(total) / F.col("_entity"))
    found = both.join(entities, "entity").join(counted, "term").where(F.col("_entity") < total)
    return materialize(found.select("entity", "term", tells.alias("share")).where(F.col("share") >= threshold), "disclosures")


def _joined(spans: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, (*KINDS, "term"))), spans["kind"] + 1)
    return F.concat_ws(":", name, spans["begin"].cast("string"), spans["end"].cast("string"))


def _all_spans(docs: DataFrame, row: Column, text: str, support: int, threshold: float) -> DataFrame:
    """``_row``, ``_spans`` (patterns) and ``_terms`` (begin, end, share) of every document."""
    rows = docs.select(row.alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    scanned = rows.mapInArrow(_scan, f"_row {kind}, _spans {SPANS}, _n bigint, _contexts {CONTEXTS}")
    scanned = materialize(scanned.withColumn("_no", F.monotonically_increasing_id()), "scanned")
    telling = disclosures(scanned, rows.select("_text"), support, threshold)
    here = scanned.select("_no", F.explode("_contexts").alias("_c")).select("_no", F.explode("_c.entities").alias("entity"), F.col("_c.terms").alias("_t"))
    places = here.select("_no", "entity", F.inline("_t")).join(telling, ["entity", "term"]).groupBy("_no", "begin", "end").agg(F.max("share").alias("share"))
    terms = places.groupBy("_no").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "share"))).alias("_terms"))
    return scanned.select("_no", "_row", "_spans").join(terms, "_no", "left")


def find_personal_data(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, threshold: float = GENERALISE
) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``n_term``, ``base_sha256``, ``spans``.

    Spans are kind:begin:end in code points, end exclusive, by begin, then by
    kind, joined by commas; ``base_sha256`` digests those of the patterns.
    Null is the empty text and has none. Repeated rows keep a row each and
    count as contexts of their own; other columns are not read.
    """
    found = _all_spans(docs, F.col(doc_id), text, support, threshold)
    terms = F.transform(F.coalesce("_terms", F.array().cast("array<struct<begin:int,end:int,share:double>>")), lambda t: F.struct(
        t["begin"].alias("begin"), F.lit(TERM).alias("kind"), t["end"].alias("end")))
    every = F.array_sort(F.concat("_spans", terms.cast(SPANS)))
    n = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("bigint")
    text_of = lambda spans: F.array_join(F.transform(spans, _joined), ",")
    return found.select(
        F.col("_row").alias("doc_id"), *[n(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.size(terms).cast("bigint").alias("n_term"),
        F.sha2(text_of(F.col("_spans")).cast("binary"), 256).alias("base_sha256"), text_of(every).alias("spans"),
    )


def cleaned(text: str, spans: list[Span], terms: list[tuple[int, int, float]], remove: float = REMOVE) -> str:
    """A text with spans replaced by their kind, and telling terms by their class or by nothing."""
    marks = [(a, b, f"[{KINDS[k].upper()}]") for a, k, b in spans]
    marks += [(a, b, "" if share >= remove else "[NAME]" if text[a].isupper() else "[WORD]") for a, b, share in terms]
    out, at = [], 0
    for begin, end, mark in sorted(marks):
        if begin >= at:
            out += (text[at:begin], mark)
        at = max(at, end)
    return "".join((*out, text[at:]))


def _cleaning(text: str, remove: float):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row, spans, terms in zip(*(batch.column(c).to_pylist() for c in ("_row", "_spans", "_terms")), strict=True):
                made.append(None if row[text] is None else cleaned(
                    row[text], [(s["begin"], s["kind"], s["end"]) for s in spans], [(t["begin"], t["end"], t["share"]) for t in terms or ()], remove))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(made, pa.string())], ["_row", "_clean"])

    return clean


def sanitise(docs: DataFrame, text: str = "text", support: int = SUPPORT, threshold: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The documents with personal data masked and telling terms generalised or removed, all other columns as they were."""
    found = _all_spans(docs, F.struct("*"), text, support, threshold).select("_row", "_spans", "_terms")
    kind = found.schema["_row"].dataType.simpleString()
    done = found.mapInArrow(_cleaning(text, remove), f"_row {kind}, _clean string")
    return done.select(*[F.col("_clean").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
