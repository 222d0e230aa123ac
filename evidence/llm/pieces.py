"""SentencePiece encoding and decoding by a max-plus scan.

The model's pieces form a lattice over the text. A path takes the score of its
pieces; two neighbours that the model's merges would have joined otherwise have
the weight minus infinity. A segmentation is the model's own exactly when every
two neighbours are what merging their joint text gives, so the best path is
the library's result.

A state at a place of the text is the piece that covers the character before
it. A chunk of a giant document maps the states at its begin to those at its
end by a matrix of path weights. Matrices combine associatively under (max, +):
they are multiplied up a tree of ``FAN`` neighbours, the best states are handed
down the same tree, and every chunk is traced back alone between its two
states. Documents of one chunk need no matrix.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import texts_of
from evidence.session import materialize

SPACE = "▁"
CHUNK_CHARS = 1 << 15
FAN = 64
#: Words, and pairs of pieces, whose results a task keeps: some 160 and 100 bytes each, some 50 MB together.
KEPT_WORDS = 1 << 18
KEPT_PAIRS = 1 << 17
#: Longer words are searched and not kept, so that the number of kept words bounds their bytes.
KEPT_CHARS = 64
#: Rows of a batch that are Python objects at a time.
ROWS = 128
LOW = -math.inf


class Pieces:
    """The lattice of one model; not sent to tasks but built there from the model's bytes."""

    def __init__(self, model: bytes):
        library = self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids, self.score, self.byte, self.out = {}, {}, [0] * 256, []
        self.trie: dict = {}  # character -> [the piece that ends here or -1, next characters]; made for the first long word
        self.names: list[str] = []
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            self.names.append(piece)
            if library.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(i) or library.is_unknown(i) or library.is_unused(i):
                self.out.append(b"")
            else:
                self.ids[piece] = i
                self.score[piece] = library.get_score(i)
                self.out.append(piece.replace(SPACE, " ").encode())
        self.size = len(self.names)
        self.weights = [self.score.get(x, 0.0) for x in self.names]
        self.longest = max(map(len, self.ids))
        self.words: dict[str, tuple[tuple[int, ...], float]] = {}
        self.packed: dict[str, bytes] = {}  # ids of whole words as 32-bit numbers, spaces as in the text
        self.pairs: dict[int, bool] = {}
        self.chars: dict[str, int] = {}  # numbers of characters that are no pieces
        signs = "".join(sorted({c for p in self.ids for c in p if c.isnumeric() and not c.isalpha()} | {"_"}))
        letter, mark = rf"[^\W\d{signs}]", rf"(?:[\W\d{signs}](?<!{SPACE}))"
        self.split = re.compile(f"{SPACE}*{letter}+|{SPACE}*{mark}+|{SPACE}+")
        self.opening = re.compile(f"(?<=[^{SPACE}])(?={SPACE})|(?<={letter})(?={mark})|(?<={mark})(?={letter})")
        gap, other = f"[ {SPACE}]", rf"[\W\d{signs}](?<![ {SPACE}])"  # the same split of a text whose spaces are not signed yet
        self.spaced = re.compile(rf"{gap}*(?:{letter}+|(?:[\x00-\x1f!-@\[-`{{-\x7f]+|{other})+)|{gap}+")
        self.plain = re.compile(f" [^ {SPACE}].{{0,{KEPT_CHARS - 2}}}\\Z", re.DOTALL)
        if any(self.opening.search(p) for p in self.ids):  # pieces that join letters and marks: only spaces part words
            self.spaced = re.compile(f"{gap}*[^ {SPACE}]+|{gap}+")
            self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
            self.opening = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
        probe = "One  more\ttest, été 12\n"
        if any(self.opening.search(p) for p in self.ids) or library.encode(probe) != self.encode(probe):
            raise ValueError("only merge (BPE) models that keep white space and do not join words are supported")

    def number(self, piece: str) -> int:
        """The id of a piece, or a number beyond the ids for a character that is none."""
        i = self.ids.get(piece)
        if i is None:
            i = self.chars.get(piece)
            if i is None:
                i = self.chars[piece] = len(self.names)
                self.names.append(piece)
        return i

    def merged(self, text: str) -> list[str]:
        """The model's pieces of a short text, by merging the best pair, the first of equal ones, again and again."""
        parts, score = list(text), self.score.get
        joint = [score(a + b, LOW) for a, b in zip(parts, parts[1:], strict=False)]
        while joint:
            best = max(joint)
            if best == LOW:
                break
            i = joint.index(best)
            piece = parts[i] = parts[i] + parts.pop(i + 1)
            del joint[i]
            if i:
                joint[i - 1] = score(parts[i - 1] + piece, LOW)
            if i < len(joint):
                joint[i] = score(piece + parts[i + 1], LOW)
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may follow ``a``; with ``a`` = -1, whether ``b`` may stand at all."""
        key = (a + 1) << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            left = [self.names[a]] if a >= 0 else []
            known = self.pairs[key] = self.merged("".join(left) + self.names[b]) == [*left, self.names[b]]
        return known

    def fits(self, a: str, b: str) -> bool:
        return self.follows(self.number(a) if a else -1, self.number(b))

    def weigh(self, piece: str) -> float:
        return self.score.get(piece, 0.0)

    def ids_of(self, piece: str) -> tuple[int, ...]:
        i = self.ids.get(piece)
        return (i,) if i is not None else tuple(self.byte[b] for b in piece.encode("utf-8", "surrogatepass"))

    def word(self, word: str) -> tuple[tuple[int, ...], float]:
        """Ids and weight of the best path through a word, which no piece leaves.

        The one path of a finite weight is what merging gives, so a short word
        is merged; through a long one the path is searched piece by piece.
        """
        found = self.words.get(word)
        if found is not None:
            return found
        if len(word) > KEPT_CHARS:
            return self.path(word)
        found = self.solved(tuple(i for part in self.merged(word) for i in self.ids_of(part)))
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        self.words[word] = found
        return found

    def solved(self, ids: tuple[int, ...]) -> tuple[tuple[int, ...], float]:
        return ids, sum(map(self.weights.__getitem__, ids))

    def learn(self, words: Iterable[str]) -> None:
        """Solves new words in one call of the library, which merges faster; it puts the space sign before a word itself."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        new = [w for w in set(words) if w not in self.words and len(w) <= KEPT_CHARS and w[0] == SPACE and w[1:2] not in ("", SPACE)]
        for word, ids in zip(new, self.library.encode([w[1:] for w in new], num_threads=1), strict=True):
            self.words[word] = self.solved(tuple(ids))

    def grow(self) -> dict:
        for piece, i in self.ids.items():
            here = self.trie
            for c in piece:
                node = here.setdefault(c, [-1, {}])
                here = node[1]
            node[0] = i
        return self.trie

    def path(self, word: str) -> tuple[tuple[int, ...], float]:
        """Ids and weight of the path through a long word: the first piece found to end at a place is the one."""
        n, trie, known, follows = len(word), self.trie or self.grow(), self.pairs.get, self.follows
        last, back = [-1] + [None] * n, [0] * (n + 1)
        for start in range(n):
            before, here, end = last[start], trie, start
            shifted = (before + 1) << 32
            for c in word[start : start + self.longest]:
                node = here.get(c)
                if node is None:
                    break
                i, here = node
                end += 1
                if i >= 0 and last[end] is None:
                    fits = known(shifted | i)
                    if fits or (fits is None and follows(before, i)):
                        last[end], back[end] = i, start
            if last[start + 1] is None and follows(before, i := self.number(word[start])):
                last[start + 1], back[start + 1] = i, start
        path, weight, end, weights = [], 0.0, n, self.weights
        while end:
            i = last[end]
            path.append((i,) if i < self.size else self.ids_of(self.names[i]))
            weight += weights[i] if i < self.size else 0.0
            end = back[end]
        return tuple(i for ids in reversed(path) for i in ids), weight

    def encode(self, text: str) -> list[int]:
        """The ids of a text of one chunk."""
        return self.encode_all([text])[0]

    def pack(self, word: str) -> bytes:
        return array("i", self.word(word.replace(" ", SPACE))[0]).tobytes()

    def learn_packed(self, words: set[str]) -> None:
        """Packs new words; those with one space before them in one call of the library, which puts that space itself."""
        if len(self.packed) > KEPT_WORDS:
            self.packed.clear()
        new = words.difference(self.packed)
        plain = list(filter(self.plain.match, new))
        ids = self.library.encode([w[1:] for w in plain], num_threads=1)
        self.packed.update(zip(plain, map(bytes, map(partial(array, "i"), ids)), strict=True))
        self.packed.update((w, self.pack(w)) for w in new.difference(plain) if len(w) <= KEPT_CHARS)

    def pack_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts of one chunk as 32-bit numbers, one text after the other."""
        return self.pack_words([self.spaced.findall(" " + text) if text else [] for text in texts])

    def pack_words(self, words: list[list[str]]) -> Iterator[bytes]:
        self.learn_packed(set().union(*words))
        known = self.packed
        for ws in words:
            try:
                yield b"".join(map(known.__getitem__, ws))
            except KeyError:  # long words are not kept
                yield b"".join([known[w] if w in known else self.pack(w) for w in ws])

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [array("i", x).tolist() for x in self.pack_all(texts)]

    def spell(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids: Sequence[int]) -> str:
        return self.spell(ids).removeprefix(" ")

    # ---- chunks of giant documents ----

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """The pieces (begin, end) that cover the character before ``at``; ``text`` shows enough on both sides."""
        return [
            (s, e)
            for s in range(max(0, at - self.longest), at)
            for e in range(at, min(len(text), s + self.longest) + 1)
            if (e - s == 1 or text[s:e] in self.ids) and self.fits("", text[s:e])
        ]

    def sweep(self, text: str, lo: int, hi: int, entries: list, trace: dict | None = None) -> dict:
        """Weights of all states behind ``hi`` from each entry state: place -> state -> list by entry.

        Only pieces that begin in [lo, hi) are added. At the begin of a word, which no piece crosses, all
        states become one (None), and whole words are taken in one step.
        ``trace`` gets the way back, for a single entry.
        """
        self.learn(self.split.findall(text, lo, hi))
        front: dict[int, dict] = {}
        for k, state in enumerate(entries):
            at = front.setdefault(state[1] if state else lo, {})
            at.setdefault(state, [LOW] * len(entries))[k] = 0.0
        starts = [0, *(m.start() for m in self.opening.finditer(text))]
        following = dict(zip(starts, starts[1:], strict=False))
        openings = set(starts)
        for pos in range(lo, hi):
            here = front.pop(pos, None)
            if not here:
                continue
            if pos in openings and set(here) != {None}:
                best = max(here, key=lambda s: max(here[s]))
                if trace is not None:
                    trace[(pos, None)] = (pos, best, ())
                here = {None: [max(x) for x in zip(*here.values(), strict=True)]}
            end = following.get(pos)
            if None in here and end is not None and end < hi:
                ids, weight = self.word(text[pos:end])
                front.setdefault(end, {})[None] = [x + weight for x in here[None]]
                if trace is not None:
                    trace[(end, None)] = (pos, None, ids)
                continue
            for end in range(pos + 1, min(len(text), pos + self.longest) + 1):
                piece = text[pos:end]
                if end - pos > 1 and piece not in self.ids:
                    continue
                weights, way = None, None
                for state, values in here.items():
                    if self.fits(text[state[0] : state[1]] if state else "", piece):
                        if weights is None or max(values) > max(weights):
                            way = state
                        weights = values if weights is None else [max(x) for x in zip(weights, values, strict=True)]
                if weights is not None and max(weights) > LOW:
                    w = self.weigh(piece)
                    front.setdefault(end, {})[(pos, end)] = [x + w for x in weights]
                    if trace is not None:
                        trace[(end, (pos, end))] = (pos, way, self.ids_of(piece))
        return front

    def certain(self, text: str, lo: int, hi: int) -> tuple[int | None, int | None]:
        """The first and the last begin of a word in [lo, hi): what lies between is the same on every path."""
        first = self.opening.search(text, lo, hi) if lo else re.match("", text)
        if not first:
            return None, None
        reach = 4 * self.longest
        while True:
            begin = max(first.start() + 1, hi - reach)
            found = [m.start() for m in self.opening.finditer(text, begin, hi)]
            if found or begin == first.start() + 1:
                return first.start(), found[-1] if found else first.start()
            reach *= 4

    def matrix(self, before: str, body: str, after: str) -> tuple[int, int, list[float]]:
        """Numbers of entry and exit states of a chunk and the weights between them, row by row.

        Words between the first and the last begin of one add the same to every path, so they are left out.
        """
        text, lo, hi = before + body + after, len(before), len(before) + len(body)
        entries = self.states(text, lo) if before else [None]
        meet, tail = self.certain(text, lo, hi)
        if meet is not None:
            reached = [0.0]
            if before:
                head = self.sweep(text[: meet + self.longest], lo, meet, entries)[meet]
                reached = [max(x) for x in zip(*head.values(), strict=True)]
            cut = max(0, min(tail, hi - self.longest) - 1)
            exits = self.states(text[cut:], hi - cut)
            front = self.sweep(text[cut:], tail - cut, hi - cut, [None])
            columns = [[x + y for x in reached for y in front.get(e, {}).get((s, e), [LOW])] for s, e in exits]
        else:
            exits = self.states(text, hi)
            front = self.sweep(text, lo, hi, entries)
            columns = [front.get(e, {}).get((s, e)) or [LOW] * len(entries) for s, e in exits]
        return len(entries), len(exits), [c[k] for k in range(len(entries)) for c in columns]

    def way(self, text: str, lo: int, hi: int, first: tuple[int, int] | None, state: tuple[int, int] | None) -> list[int]:
        """The ids of the pieces that begin in [lo, hi), from a state to another, or to the best at ``hi``."""
        trace: dict = {}
        front = self.sweep(text, lo, hi, [first], trace)
        if state is None:
            here = front[hi]
            state = max(here, key=lambda s: max(here[s]))
        at, found = (state[1] if state else hi, state), []
        while at in trace and at != (lo, first):
            pos, way, ids = trace[at]
            found.append(ids)
            at = (pos, way)
        return [i for ids in reversed(found) for i in ids]

    def backtrace(self, before: str, body: str, after: str, entry: int, leave: int) -> tuple[list[int], int, int]:
        """The ids of the pieces that begin in a chunk, between two chosen states, and the places they reach from and to."""
        text, lo, hi = before + body + after, len(before), len(before) + len(body)
        first = self.states(text, lo)[entry] if before else None
        state = self.states(text, hi)[leave]
        ends = first[1] if first else lo, state[1]
        meet, tail = self.certain(text, lo, hi)
        if meet is None:
            return self.way(text, lo, hi, first, state), *ends
        head = self.way(text[: meet + self.longest], lo, meet, first, None) if ends[0] < meet else []
        (words,) = self.pack_words([self.spaced.findall(text[meet:tail].replace(SPACE, " "))])
        cut = max(0, min(tail, hi - self.longest) - 1)
        rest = self.way(text[cut:], tail - cut, hi - cut, None, (state[0] - cut, state[1] - cut))
        return [*head, *array("i", words), *rest], *ends


def times(a: tuple, b: tuple) -> tuple[int, int, list[float]]:
    """Two chunks in a row: the max-plus product of their matrices."""
    (n, m, left), (_, p, right) = a, b
    rows = [left[i * m : (i + 1) * m] for i in range(n)]
    columns = [right[j::p] for j in range(p)]
    return n, p, [max(map(sum, zip(r, c, strict=True))) for r in rows for c in columns]


def _whole(model: bytes, check: bool):
    """Ids of texts of one chunk and, with ``check``, whether they decode to the text; the text itself stays in the task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = texts_of(part, "_text")
                packed = list(pieces.pack_all(texts))
                ends = pa.array(np.cumsum([0, *(len(x) // 4 for x in packed)]), pa.int32())
                ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), np.int32)))
                same = [pieces.decode(array("i", x)) == text if check else None for x, text in zip(packed, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(same, pa.bool_())], ["doc_id", "ids", "same"])

    return encode


def _chunk_rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """The chunks of a batch one by one: text before, of and behind it, and the values of ``columns``."""
    for at in range(batch.num_rows):
        yield tuple(batch.column(c)[at].as_py() for c in ("before", "body", "after", *columns))


def _signed(*texts: str) -> list[str]:
    return [t.replace(" ", SPACE) for t in texts]


def _matrices(model: bytes):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            made = list(zip(*[pieces.matrix(*_signed(*chunk)) for chunk in _chunk_rows(batch)], strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("no"), *(pa.array(list(x), t) for x, t in zip(made, (pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True))],
                ["digest", "no", "n_in", "n_out", "weights"],
            )

    return compute


def _tracing(model: bytes):
    """Ids of chunks between their two states, and whether they decode to the characters they cover."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            ids, same = [], []
            for before, body, after, entry, leave in _chunk_rows(batch, "entry", "leave"):
                found, begin, end = pieces.backtrace(*_signed(before, body, after), entry, leave)
                ids.append(found)
                same.append(pieces.spell(found) == (before + body + after)[begin:end])
            columns = [batch.column("digest"), batch.column("no"), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "no", "ids", "same"])

    return compute


def _product(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("no")
    total = None
    for n, m, w in zip(rows["n_in"], rows["n_out"], rows["weights"], strict=True):
        total = (n, m, list(w)) if total is None else times(total, (n, m, list(w)))
    return pd.DataFrame({"digest": [rows["digest"].iloc[0]], "no": [rows["up"].iloc[0]], "n_in": [total[0]], "n_out": [total[1]], "weights": [total[2]]})


def _handed_down(rows: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit state of every child, given those of the parent: a backtrace over at most ``FAN`` matrices."""
    rows = rows.sort_values("no")
    entry, leave = int(rows["entry"].iloc[0]), int(rows["leave"].iloc[0])
    best, ways = {entry: 0.0}, []
    for m, w in zip(rows["n_out"], rows["weights"], strict=True):
        w, way, reached = list(w), {}, {}
        for j in range(m):
            value, i = max((best[i] + w[i * m + j], -i) for i in best)
            if value > LOW:
                reached[j], way[j] = value, -i
        best = reached
        ways.append(way)
    states = [leave]
    for way in reversed(ways):
        states.append(way[states[-1]])
    states.reverse()
    return pd.DataFrame({"digest": rows["digest"], "no": rows["no"], "entry": states[:-1], "leave": states[1:]})


def _scan(matrices: DataFrame) -> DataFrame:
    """``digest``, ``no``, ``entry``, ``leave``: the states of every chunk on the best path of its document."""
    levels, shape = [matrices], "digest binary, no bigint, n_in int, n_out int, weights array<double>"
    while levels[-1].agg(F.max("no")).first()[0]:
        grouped = levels[-1].withColumn("up", F.expr(f"no div {FAN}")).groupBy("digest", "up")
        levels.append(materialize(grouped.applyInPandas(_product, shape), "matrices"))
    best = F.array_position("weights", F.array_max("weights")).cast("int") - 1
    states = levels[-1].select("digest", F.col("no").cast("bigint").alias("no"), F.lit(0).alias("entry"), best.alias("leave"))
    for level in reversed(levels[:-1]):
        above = states.withColumnRenamed("no", "up")
        both = level.withColumn("up", F.expr(f"no div {FAN}")).join(above, ["digest", "up"])
        states = both.groupBy("digest", "up").applyInPandas(_handed_down, "digest binary, no bigint, entry int, leave int")
        states = materialize(states, "states")
    return states


def _chunks(texts: DataFrame, size: int, reach: int) -> DataFrame:
    """``digest``, ``no`` and the text of every chunk, a space put first, with ``reach`` characters on both sides."""
    last = F.floor((F.length("_text")) / size).cast("bigint")
    cut = lambda begin, n: F.substring(F.col("_text"), begin, n)
    begin = (F.col("no") * size + 1).cast("int")
    return (
        texts.select("digest", F.concat(F.lit(" "), "_text").alias("_text"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("no"))
        .select(
            "digest", "no",
            F.when(F.col("no") > 0, cut(begin - reach, F.lit(reach))).otherwise("").alias("before"),
            cut(begin, F.lit(size)).alias("body"), cut(begin + size, F.lit(reach)).alias("after"),
        )
    )


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _coded(docs: DataFrame, model: bytes, doc_id: str, text: str, chunk_chars: int, check: bool) -> DataFrame:
    """``doc_id``, ``ids``, ``same``, ``n_chunks``."""
    reach = Pieces(model).longest
    if chunk_chars < 2 * reach:
        raise ValueError(f"chunks need {2 * reach} characters or more")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    long = F.length("_text") >= chunk_chars
    whole = rows.where(~long).mapInArrow(_whole(model, check), f"doc_id {kind}, ids array<int>, same boolean")
    whole = whole.withColumn("n_chunks", F.lit(1).cast("bigint"))
    giant = rows.where(long).withColumn("digest", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    chunks = materialize(_chunks(giant.select("digest", "_text").dropDuplicates(["digest"]), chunk_chars, reach), "chunks")
    shape = "digest binary, no bigint, n_in int, n_out int, weights array<double>"
    states = _scan(materialize(chunks.mapInArrow(_matrices(model), shape), "matrices"))
    traced = chunks.join(states, ["digest", "no"]).mapInArrow(_tracing(model), "digest binary, no bigint, ids array<int>, same boolean")
    joined = traced.groupBy("digest").agg(
        F.collect_list(F.struct("no", "ids")).alias("_parts"), F.bool_and("same").alias("same")
    ).select("digest", F.flatten(F.array_sort("_parts")["ids"]).alias("ids"), "same", F.size("_parts").cast("bigint").alias("n_chunks"))
    joined = materialize(joined, "ids")
    return whole.unionByName(giant.select("doc_id", "digest").join(joined, "digest").drop("digest"))


def encode(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row for each document: ``doc_id``, ``ids`` (array of int), ``n_tokens``, ``n_chunks``.

    Texts of less than ``chunk_chars`` characters are one chunk; longer ones are
    made distinct, cut once, scanned and traced back chunk by chunk. The ids
    are those of the library for the whole text. Null and empty texts have no
    ids. Repeated rows keep a row each; other columns are not read.
    """
    coded = _coded(docs, model, doc_id, text, chunk_chars, check=False)
    return coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "n_chunks")


def _decoding(model: bytes):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [pieces.decode(ids or []) for ids in part.column("_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string())], ["_row", "text"])

    return decode


def decode(tokens: DataFrame, model: bytes, ids: str = "ids", to: str = "text") -> DataFrame:
    """``tokens`` with the text of ``ids`` as column ``to`` (replaced, if there is one).

    Control ids give nothing, byte ids their byte (broken sequences the
    replacement character); null and empty ids give the empty text.
    """
    rows = tokens.select(F.struct("*").alias("_row"), F.col(ids).alias("_ids"))
    kind = rows.schema["_row"].dataType.simpleString()
    decoded = rows.mapInArrow(_decoding(model), f"_row {kind}, text string")
    kept = [c for c in tokens.columns if c != to]
    return decoded.select(*[F.col("_row")[c].alias(c) for c in kept], F.col("text").alias(to))


def round_trip(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Encoded documents and whether decoding gives their text again: ``doc_id``, ``ids``, ``n_tokens``, ``n_chunks``, ``same``.

    A text is encoded, decoded and compared in one step, a giant text chunk by
    chunk. ``same`` is false only for texts that hold the model's own space
    sign. Rows are as those of ``encode``.
    """
    coded = _coded(docs, model, doc_id, text, chunk_chars, check=True)
    return coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "n_chunks", "same")
