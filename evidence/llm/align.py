"""Alignment of two tokenizers' tokens, and links of their ids over a corpus.

Both tokenizers spell the same bytes, so tokens are compared by the places
where they end. While both end arrays agree at the current shift of indexes,
tokens stand one to one: probes of doubling width jump over such a stretch and
narrow down on its end. An irregular group, where one side ends more often than
the other, is resolved by advancing the side that is behind, and the shift
changes. Documents of a block are laid end to end, for all of them end together.

The tokens of a group are linked. How many documents hold a pair of ids linked
is counted over the corpus: tasks emit sums of their own documents, Spark adds
them up. The ``HOT`` most frequent pairs, a bounded table, go to all tasks; links
of other pairs are joined to their counts.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import texts_of
from evidence.session import materialize

SIGN = "▁"
BLOCK_CHARS, BLOCK_TEXTS = 1 << 20, 1 << 11
#: Pairs whose counts are sent to all tasks: 13 bytes each, 7 MB.
HOT = 1 << 19
#: Pairs a task sums up before it emits them, and links of irregular groups that are listed at a time.
SUMMED, LISTED = 1 << 20, 1 << 22


#: Fixed value: how byte-level vocabularies part a text before they merge bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PROBE = " It's 12 o'clock,\t\n  naïve 日本語 <|x|> \U0001f600  aaaaaaaa\n\n"


def byte_signs() -> dict[str, int]:
    """The printable sign that byte-level vocabularies write for each byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def stretch(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many tokens from ``a[i]`` and ``b[j]`` on end alike one to one, by probes of doubling width."""
    if i >= len(a) or j >= len(b) or a[i] != b[j]:
        return 0
    same, width = 1, 2
    while True:
        left = a[i + same : i + same + width]
        if left != b[j + same : j + same + width]:
            break
        if len(left) < width:
            return same + len(left)
        same += width
        width *= 2
    while width > 2:  # the first difference lies within the last probe
        width //= 2
        if a[i + same : i + same + width] == b[j + same : j + same + width]:
            same += width
    p, q = i + same, j + same
    return same + 1 if p < len(a) and q < len(b) and a[p] == b[q] else same


def segments(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int, bool]]:
    """Begin and end in ``a`` and in ``b`` of every one-to-one stretch (true) and every irregular group (false)."""
    i, j, n = 0, 0, len(a)
    while i < n:
        p, q, x, y = i, j, a[i], b[j]
        if x == y:
            same = stretch(a, b, i, j)
            yield i, i + same, j, j + same, True
            i, j = i + same, j + same
            continue
        while x != y:
            if x < y:
                p += 1
                x = a[p]
            else:
                q += 1
                y = b[q]
        yield i, p + 1, j, q + 1, False
        i, j = p + 1, q + 1


class Aligner:
    """Two tokenizers, built in the task from their definitions."""

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_str(definition)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        signs = byte_signs()
        special = {i for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = token.encode() if i in special else bytes(signs[c] for c in token)
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SIGN, " ").encode()
            for i in range(self.b.get_piece_size())
        ]
        self.n_b = len(self.b_bytes)
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        size = max(len(self.a_bytes), self.n_b)
        self.names = np.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], object).reshape(3, size)
        ranks = {x: i for i, x in enumerate(self.a_bytes) if x and i not in special}
        self.ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self.ranked.encode_ordinary(PROBE) != self.a.encode(PROBE, add_special_tokens=False).ids:
            self.ranked = None  # another kind of definition

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both tokenizers; none where either does not spell a space and the text."""
        filled = [k for k, t in enumerate(texts) if t]
        spaced = [" " + texts[k] for k in filled]
        if self.ranked:  # the vocabulary's own ranks, merged four times as fast
            a = list(map(self.ranked.encode_ordinary, spaced))
        else:
            a = [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode([texts[k] for k in filled], num_threads=1)
        found: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        for k, x, y in zip(filled, a, b, strict=True):
            said = (" " + texts[k]).encode()
            if b"".join(map(self.a_bytes.__getitem__, x)) == said and b"".join(map(self.b_bytes.__getitem__, y)) == said:
                found[k] = x, y
        return found

    def block(self, texts: list[str]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
        """For each text its numbers, and its distinct linked pairs (``a * n_b + b``) with how often they are linked."""
        tokens = self.tokens(texts)
        a, b = (np.array(array("i", chain.from_iterable(t[k] for t in tokens)), np.int64) for k in (0, 1))
        a_end, b_end = np.cumsum([len(x) for x, _ in tokens]), np.cumsum([len(y) for _, y in tokens])
        irregular, runs = array("q"), array("q")
        for i, p, j, q, one in segments(np.cumsum(self.a_length[a]).tolist(), np.cumsum(self.b_length[b]).tolist()):
            if one:
                runs.extend((i, j, p - i))
            else:
                irregular.extend((i, p, j, q))
        at, to, long = np.array(runs, np.int64).reshape(-1, 3).T
        i0, i1, j0, j1 = np.array(irregular, np.int64).reshape(-1, 4).T
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)  # tokens that end a group
        a_last[np.concatenate([spans(at, long), i1 - 1])] = True
        b_last[np.concatenate([spans(to, long), j1 - 1])] = True
        ended = np.concatenate([[0], np.cumsum(a_last)])
        said = self.spelled(a, b, a_last, b_last)
        text_of = np.repeat(np.arange(len(texts)), np.diff(a_end, prepend=0))
        pairs, times = self.links(a, b, text_of, (at, to, long), (i0, i1, j0, j1))
        wide = len(self.a_bytes) * self.n_b
        place = np.searchsorted(pairs, np.arange(len(texts) + 1) * wide)
        for k, (x, y) in enumerate(tokens):
            end = int(a_end[k] + b_end[k])
            mine = slice(place[k], place[k + 1])
            digest = hashlib.sha256("".join(said[end - len(x) - len(y) : end])[:-1].encode()).hexdigest() if x else ""
            n_groups = int(ended[a_end[k]] - ended[a_end[k] - len(x)])
            numbers = {"n_a": len(x), "n_b": len(y), "n_groups": n_groups, "n_links": int(times[mine].sum()), "groups_sha256": digest}
            yield numbers, pairs[mine] - k * wide, times[mine]

    def spelled(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> list[str]:
        """Ids with the mark behind each, in groups: those of A, a bar, those of B, a semicolon."""
        a_stop, b_stop = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        made = np.empty(len(a) + len(b), object)
        made[np.arange(len(a)) + np.concatenate([[0], b_stop])[a_group]] = self.names[a_last.astype(int), a]
        made[np.arange(len(b)) + a_stop[b_group]] = self.names[2 * b_last.astype(int), b]
        return made.tolist()

    def links(self, a: np.ndarray, b: np.ndarray, text_of: np.ndarray, runs: tuple, irregular: tuple) -> tuple[np.ndarray, np.ndarray]:
        """All linked pairs as ``(text * ids of A + a) * ids of B + b``, sorted and distinct, with how often each is linked."""
        left = (text_of * len(self.a_bytes) + a) * self.n_b
        at, to, long = runs
        found = [counted(left[spans(at, long)] + b[spans(to, long)])]
        i0, i1, j0, j1 = irregular
        n_left, n_right = i1 - i0, j1 - j0
        size = n_left * n_right
        for k in np.flatnonzero(size > LISTED):  # one group of very many links: only its distinct ids are paired
            x, nx = counted(left[i0[k] : i1[k]])
            y, ny = counted(b[j0[k] : j1[k]])
            step = max(1, LISTED // len(y))
            found += [((x[s : s + step, None] + y).ravel(), (nx[s : s + step, None] * ny).ravel()) for s in range(0, len(x), step)]
        some = np.flatnonzero(size <= LISTED)
        for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(size[some]) // LISTED)) + 1):
            count = size[part]
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            width = np.repeat(n_right[part], count)
            found.append(counted(left[np.repeat(i0[part], count) + nth // width] + b[np.repeat(j0[part], count) + nth % width]))
        return counted(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one behind the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)


def counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``times`` (1 each) of every one."""
    if times is None:
        found, n = np.unique(keys, return_counts=True)
        return found, n.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and (size + len(text) > BLOCK_CHARS or len(held) == BLOCK_TEXTS):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


SHAPE = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
LISTS = pa.list_(pa.int64())


def _aligning(definition: str, model: bytes, kind: pa.DataType):
    """A row for each text, and rows without a number that hold the sums of pairs over the texts of a task."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(definition, model)
        names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        schema = pa.schema([("row", pa.int64()), ("doc_id", kind), *[(n, pa.int64()) for n in names[:4]], (names[4], pa.string()), ("pairs", LISTS), ("times", LISTS)])
        summed = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"pairs": summed[0], "times": summed[1]}], schema=schema)

        for batch in batches:
            begin = 0
            for block in _blocks(texts_of(batch, "_text")):
                made, pairs, times = [], [], []
                for numbers, keys, n in aligner.block(block):
                    made.append(numbers)
                    pairs.append(keys)
                    times.append(n)
                part = batch.slice(begin, len(block))
                begin += len(block)
                every = np.concatenate(pairs)
                summed = counted(*map(np.concatenate, zip(summed, counted(every), strict=True)))
                ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (every, np.concatenate(times))]
                columns = [pa.array([m[n] for m in made], schema.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *columns, *lists], schema=schema)
                if len(summed[0]) > SUMMED:
                    yield sums()
                    summed = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(summed[0]):
            yield sums()

    return align


def _weighing(hot: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Sums over the links whose pair is among ``hot``, and the other pairs."""
    keys, counts, best = hot

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, times = batch.column("pairs").flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            size = batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), size)
            at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
            known = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            at, some, n = at[known], row[known], times[known]
            # Sums of whole numbers, not of floats: counts may be large.
            ends = np.concatenate([[0], np.cumsum(np.bincount(some, minlength=batch.num_rows))])
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            rest = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=batch.num_rows))]), pa.int32())
            lists = [pa.ListArray.from_arrays(rest, pa.array(x[~known], pa.int64())) for x in (flat, times)]
            sums = [pa.array(total(n * best[at]), pa.int64()), pa.array(total(n * counts[at]), pa.int64())]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *sums, *lists], [*names, "n_best", "count_sum", "pairs", "times"])

    return weigh


def aligned(docs: DataFrame, definition: str, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored alignment: a row for each document with its linked pairs, and rows (``row`` null) of pairs summed over documents."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    key = rows.select("doc_id").schema["doc_id"].dataType
    empty = docs.sparkSession.createDataFrame([], rows.select("doc_id").schema).toArrow().schema
    made = rows.mapInArrow(_aligning(definition, model, empty.field("doc_id").type), f"row bigint, doc_id {key.simpleString()}, {SHAPE}")
    return materialize(made, "aligned")


def pair_counts(table: DataFrame, n_b: int) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked) and ``best``: whether no other pair of the same id of A has more."""
    sums = table.where("row IS NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = materialize(sums.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "pairs")
    most = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.expr(f"pair div {n_b}")).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_tokens(
    docs: DataFrame, definition: str, model: bytes, doc_id: str = "doc_id", text: str = "text", hot: int = HOT,
) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A is a byte-level definition, which gets a space and the text, B a model
    that puts the space itself. Null and empty texts, and those that either
    does not spell byte by byte, have no tokens: zeros and an empty digest. A
    pair counts once for a document, copies and repeated rows included, which
    keep a row each. Other columns are not read; an empty table gives no rows.
    """
    n_b = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    table = aligned(docs, definition, model, doc_id, text)
    counts = materialize(pair_counts(table, n_b), "counts")
    top = counts.orderBy(F.desc("n"), "pair").limit(hot).orderBy("pair").toArrow()
    known = tuple(top.column(c).to_numpy() for c in ("pair", "n", "best"))
    key = table.select("doc_id").schema["doc_id"].dataType.simpleString()
    names = ["n_a bigint", "n_b bigint", "n_groups bigint", "n_links bigint", "groups_sha256 string", "n_best bigint", "count_sum bigint"]
    weighed = table.where("row IS NOT NULL").mapInArrow(_weighing(known), f"row bigint, doc_id {key}, {', '.join(names)}, pairs array<bigint>, times array<bigint>")
    weighed = materialize(weighed, "weighed")
    rest = weighed.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    more = rest.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    zero = F.lit(0).cast("bigint")
    return weighed.join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", zero)).alias("count_sum"), "groups_sha256",
    )
