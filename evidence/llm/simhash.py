"""Near duplicates: SimHash fingerprints, compared through vantage-point trees.

The upper levels of one tree, fitted on a bounded sample of fingerprints, cut
the Hamming space into shards. At a vantage point the fingerprints within the
radius go to the near side, the others to the far side. Two fingerprints at
distance ``d`` or less can only be parted when the nearer one lies in the last
``d`` steps of the radius (triangle inequality), so those, and no others, are
sent to the far side as well. Each shard then runs the same tree further down
to small leaves. Every link is thus seen in at least one leaf.

Similar texts are found without fingerprints: by the exact similarity of their
sets of shingles, through a prefix filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import texts_of, unsigned
from evidence.operators.ranking import top_k
from evidence.session import materialize

WORDS = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints in a shard, about; the levels of the upper tree; how many times as many a shard may hold
#: in one task; the sample that the tree is fitted on.
SHARD_ROWS = 8192
MAX_LEVELS = 16
FULL = 4
SAMPLE = 32768
LEAF = 256
BLOCK = 1 << 16
#: For sketches: fingerprints over single words. For similar texts: words of a shingle, words held with
#: their hashes, texts counted for the order and shingles whose counts give it, bits that mark nodes,
#: rows of a block of pairs, and the open pairs for each row of a shingle that are compared at once.
TABLES = 4
CONFIRM_WORDS = 5
KEPT_WORDS = 1 << 18
COUNTED = 4096
COMMON = 1 << 17
MARKS = 1 << 24
BLOCK_ROWS = 2048
FREE_PAIRS = 32
#: Texts of a crowded shingle that others are compared with in a turn.
STARS = 8
#: 64-bit words that hold the parity of a set, and their columns.
PARITY = 4
ODD = [f"odd_{k}" for k in range(PARITY)]
MIX = np.uint64(0x9E3779B97F4A7C15)


def simhash(text: str, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a whole text; 0 without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z only; ASCII white space only
    if not found:
        return 0
    joined = memoryview(b" ".join(found))
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    ends = starts + size - 1
    n = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):  # bounded memory, however long the text
        part = range(at, min(n, at + BLOCK))
        first, last = starts[part.start : part.stop].tolist(), ends[min(part.start + words, len(found)) - 1 :][: len(part)].tolist()
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t, words) for t in texts_of(batch, "_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "_fp"])

    return prints


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id`` and the fingerprint ``_fp`` (its 64 bits as a bigint) of every document, stored."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(_fingerprints(words), f"doc_id {kind}, _fp bigint"), "fingerprints")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _split(points: np.ndarray, tries: int = 5) -> tuple[np.uint64, int]:
    """A vantage point and radius that halve ``points`` best among a few points spread over them."""
    best = (2.0, points[0], 0)
    for point in points[np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int)]:
        far = apart(points, point)
        middle = int(np.median(far))
        for radius in {max(0, middle - 1), middle}:
            near = np.mean(far <= radius)
            best = min(best, (abs(near - 0.5), point, radius), key=lambda x: x[0])
    return best[1], best[2]


def upper_tree(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a full tree of ``levels`` levels, by node; children of ``i`` are ``2i+1`` and ``2i+2``."""
    nodes = (1 << levels) - 1
    points, radii = np.zeros(nodes, np.uint64), np.full(nodes, 64, np.int64)
    members = {0: sample}
    for node in range(nodes):
        here = members.pop(node, sample[:0])
        if len(here) > 1:
            points[node], radii[node] = _split(here)
            near = apart(here, points[node]) <= radii[node]
            members |= {2 * node + 1: here[near], 2 * node + 2: here[~near]}
    return points, radii


def route(prints: np.ndarray, points: np.ndarray, radii: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``prints`` and the leaves they are sent to; a row near a boundary has several."""
    rows, node = np.arange(len(prints)), np.zeros(len(prints), np.int64)
    for _ in range((len(points) + 1).bit_length() - 1):
        far = apart(prints[rows], points[node])
        near, edge = far <= radii[node], (far <= radii[node]) & (far > radii[node] - max_bits)
        rows, node = np.append(rows, rows[edge]), np.append(2 * node + np.where(near, 1, 2), 2 * node[edge] + 2)
    return rows, node - len(points)


def _routing(points: np.ndarray, radii: np.ndarray, max_bits: int, names: list[str]):
    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaf = route(unsigned(batch.column("_fp").to_numpy(zero_copy_only=False)), points, radii, max_bits)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *(taken.column(n) for n in names)], ["shard", *names])

    return routed


def into_shards(points: DataFrame, max_bits: int, shard_rows: int, max_levels: int, sample: int) -> DataFrame:
    """The rows of ``points`` (``_fp`` and other columns) with the ``shard`` they are sent to, or several.

    The upper tree has a leaf for each ``shard_rows`` rows, but no more than
    ``2 ** max_levels``: beyond that the shards grow. Its vantage points come
    from ``sample`` fingerprints; all rows are routed.
    """
    levels = min(max_levels, max(0, int(np.ceil(np.log2(max(1, points.count()) / shard_rows)))))
    chosen = points.select("_fp").orderBy(F.xxhash64(F.col("_fp"), F.lit(1)), "_fp").limit(sample if levels else 0)
    tree = upper_tree(unsigned([r[0] for r in chosen.collect()]), levels)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(_routing(*tree, max_bits, points.columns), f"shard int, {shape}")


def links(prints: np.ndarray, max_bits: int, confirm: np.ndarray | None = None, confirm_bits: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs at ``max_bits`` or less, by a vantage-point tree; some twice.

    With ``confirm``, more bits of each place, only pairs that differ in
    ``confirm_bits`` of those or fewer.
    """
    waiting = [np.arange(len(prints))]
    while waiting:
        at = waiting.pop()
        here = prints[at]
        if len(at) > LEAF:
            point, radius = _split(here)
            far = apart(here, point)
            near, beyond = at[far <= radius], at[far > radius - max_bits]
            if max(len(near), len(beyond)) < 0.95 * len(at):
                waiting += [near, beyond]
                continue
        for start in range(0, len(at), LEAF):  # a leaf, or points that no vantage point parts: all, in blocks
            a, b = np.nonzero(apart(here[start : start + LEAF, None], here[None, start:]) <= max_bits)
            kept = a < b
            a, b = at[start + a[kept]], at[start + b[kept]]
            if confirm is not None:
                kept = apart(confirm[a], confirm[b]).sum(axis=1) <= confirm_bits
                a, b = a[kept], b[kept]
            if len(a):
                yield a, b


def local_roots(prints: np.ndarray, max_bits: int, *confirm) -> np.ndarray:
    """For each place the smallest one that links lead to; pairs are folded in as they come, never listed."""
    root = np.arange(len(prints))
    for a, b in links(prints, max_bits, *confirm):
        a, b = root[a], root[b]
        parted = a != b
        a, b = a[parted], b[parted]
        while len(a):
            low = np.minimum(root[a], root[b])
            was = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            np.minimum.at(root, was, root)  # what a root learns, all below it learn
            root = root[root]
            if np.array_equal(root, was):
                break
    return root


def _sharded(max_bits: int):
    def stars(rows: pd.DataFrame) -> pd.DataFrame:
        prints = np.unique(unsigned(rows["_fp"].to_numpy()))
        root = local_roots(prints, max_bits)
        moved = np.flatnonzero(root != np.arange(len(prints)))
        return pd.DataFrame({"a": prints[moved].view(np.int64), "b": prints[root[moved]].view(np.int64)})

    return stars


def _balls(max_bits: int):
    """Every fingerprint with all values within half of ``max_bits`` of it; ``_near`` where the rest reaches as far again."""
    half = (max_bits + 1) // 2
    masks = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(64), k)]
    masks = np.array(masks, np.uint64)
    near = np.bitwise_count(masks) <= max_bits - half
    step = max(1, BLOCK // len(masks))

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = unsigned(batch.column("_fp").to_numpy(zero_copy_only=False))
            for at in range(0, len(prints), step):
                part = prints[at : at + step]
                keys = (part[:, None] ^ masks[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.repeat(part, len(masks)).view(np.int64)), pa.array(np.tile(near, len(part)))], ["_key", "_fp", "_near"])

    return balls


def ball_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Edges (``a``, ``b``) that give distinct fingerprints the components of all links at ``max_bits`` or less.

    Two of them link where their balls share a value. A value is in the balls
    of no more fingerprints than a ball has values, so however many lie close
    together, no group grows, and no pairs are made.
    """
    met = prints.mapInArrow(_balls(max_bits), "_key bigint, _fp bigint, _near boolean").groupBy("_key")
    met = met.agg(F.min(F.when(F.col("_near"), F.col("_fp"))).alias("b"), F.collect_list("_fp").alias("_all")).where("b IS NOT NULL AND size(_all) > 1")
    return met.select(F.explode("_all").alias("a"), "b").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node of ``edges`` (``a``, ``b``); nodes that edges connect have one root.

    Each round every node is folded into its smallest neighbour, which at
    least halves the nodes of a component; what is left is a smaller graph.
    Neighbours are only ever combined as minima, so a node with very many
    edges is no large group. Every round is stored.
    """
    left, folds = materialize(edges.select("a", "b"), "edges"), []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        fold = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        fold = materialize(fold.withColumn("root", F.least("node", "root")), "fold")
        up = fold.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        fold = materialize(fold.join(up, "root").select("node", F.col("_up").alias("root")), "fold")
        folds.append(fold)
        for end in ("a", "b"):
            to = fold.select(F.col("node").alias(end), F.col("root").alias("_to"))
            left = left.join(to, end).withColumn(end, F.col("_to")).drop("_to")
        left = materialize(left.where("a <> b").distinct(), "edges")
    if not folds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = folds[0]
    for fold in folds[1:]:
        up = fold.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        roots = roots.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
    return materialize(roots, "roots")


def print_roots(
    distinct: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS, max_levels: int = MAX_LEVELS, sample: int = SAMPLE
) -> DataFrame:
    """``node`` and ``root`` of every fingerprint of ``distinct`` (``_fp``) that has a link to another one.

    Shards of more than ``FULL`` times ``shard_rows``, which the tree could not
    part, are linked through ``ball_links`` instead of in one task each.
    """
    routed = materialize(into_shards(distinct.select("_fp"), max_bits, shard_rows, max_levels, sample), "routed")
    full = [r.shard for r in routed.groupBy("shard").count().where(F.col("count") > FULL * shard_rows).collect()]
    edges = routed.where(~F.col("shard").isin(full)).groupBy("shard").applyInPandas(_sharded(max_bits), "a bigint, b bigint")
    if full:
        edges = edges.unionByName(ball_links(routed.where(F.col("shard").isin(full)).select("_fp").distinct(), max_bits))
    return components(edges)


def classes_of(prints: DataFrame, **options: int) -> DataFrame:
    """``_fp`` and the smallest ``doc_id`` of its component, for every fingerprint, stored."""
    distinct = materialize(prints.groupBy("_fp").agg(F.min("doc_id").alias("_min")), "distinct")
    roots = print_roots(distinct, **options).select(F.col("node").alias("_fp"), "root")
    rooted = distinct.join(roots, "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    least = rooted.groupBy("root").agg(F.min("_min").alias("component_id"))
    return materialize(rooted.join(least, "root").select("_fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, **options: int) -> DataFrame:
    """One row for each document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Fingerprints of ``words``-word shingles link at ``max_bits`` differing bits
    or fewer, components are what links reach. Texts that are null or have no
    word share fingerprint zero; a text with fewer words is one shingle. Equal
    fingerprints are compared once, so copies are never paired. ``component_id``
    is the smallest id, null only where all ids are null; rows that repeat an
    id keep a row each. No rows give no rows. Other columns are not read.
    """
    prints = fingerprints(docs, doc_id, text, words)
    return prints.join(classes_of(prints, **options), "_fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, **options: int) -> DataFrame:
    """The documents with the smallest id of their component, with all their columns.

    Rows that repeat that id are all kept, as are documents without an id.
    """
    return _without(docs, doc_id, near_duplicates(docs, doc_id, text, words, **options))


def _without(docs: DataFrame, doc_id: str, found: DataFrame) -> DataFrame:
    """``docs`` without those that are not the first of their component."""
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    rows = docs.select(F.struct("*").alias("_row"))  # whole rows, whatever their columns are called
    return rows.join(gone, F.col("_row")[doc_id] == F.col("_gone"), "left_anti").select("_row.*")


# ---- similar texts ----

def _ones(hashes: list[bytes], bits: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, bits // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def sketch(text: str, known: dict[bytes, bytes]) -> tuple[list[int], bytes]:
    """``TABLES`` fingerprints over single words, and 256 bits over ``CONFIRM_WORDS``-word shingles; zeros without words.

    An estimate, which ``similar_documents`` does not rest on.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return [0] * TABLES, bytes(32)
    single, joint, n = np.zeros(64 * TABLES, np.int64), np.zeros(256, np.int64), max(1, len(found) - CONFIRM_WORDS + 1)
    for at in range(0, len(found), BLOCK):
        part = found[at : at + BLOCK]
        for w in set(part):
            if w not in known:
                known[w] = b"".join(xxhash.xxh3_128_digest(w, k) for k in range(TABLES // 2))
        single += _ones([known[w] for w in part], 64 * TABLES)
        if len(known) > KEPT_WORDS:
            known.clear()
    for at in range(0, n, BLOCK):
        part = found[at : min(n, at + BLOCK) + CONFIRM_WORDS - 1]
        view, ends = memoryview(b" ".join(part)), np.cumsum([len(w) + 1 for w in part]).tolist()
        last = range(min(CONFIRM_WORDS, len(part)) - 1, len(part))
        runs = [view[(ends[k - CONFIRM_WORDS] if k >= CONFIRM_WORDS else 0) : ends[k] - 1] for k in last]
        joint += _ones([xxhash.xxh3_128_digest(r) + xxhash.xxh3_128_digest(r, 1) for r in runs], 256)
    prints = np.packbits(single * 2 > len(found), bitorder="little").view("<i8").tolist()
    return prints, np.packbits(joint * 2 > n, bitorder="little").tobytes()


class _Words(dict):
    """Hashes of words, counted out once each."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str, known: _Words) -> np.ndarray:
    """The distinct hashes of all ``CONFIRM_WORDS``-word shingles, sorted; of a shorter text one, without words none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    width = min(CONFIRM_WORDS, len(found))
    n = len(found) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ words[k : k + n]) * MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _node(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else 0


def _sets(marks: np.ndarray | None = None):
    """Nodes and their shingles; with ``marks`` of the nodes that are looked for, few others."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            found = [shingle_set(t, known) for t in texts_of(batch, "_text")]
            nodes = np.array([_node(f) for f in found], np.int64)
            if marks is not None:
                at = nodes.view(np.uint64) % np.uint64(MARKS)
                kept = np.flatnonzero(marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                found, nodes = [found[k] for k in kept], nodes[kept]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), _lists(found)], ["node", "shingles"])

    return sets


def _marks(nodes: DataFrame) -> np.ndarray:
    """``MARKS`` bits, one of which is set for each node: what has none is not among them."""
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MARKS // 8, np.uint8)
        for batch in batches:
            at = unsigned(batch.column("node").to_numpy(zero_copy_only=False)) % np.uint64(MARKS)
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(MARKS // 8, np.uint8)
    for row in nodes.coalesce(16).mapInArrow(marked, "bits binary").collect():
        bits |= np.frombuffer(row.bits, np.uint8)
    return bits


def _parity(found: np.ndarray) -> np.ndarray:
    """``PARITY`` words: of each bit, whether an odd number of shingles falls on it.

    Where two sets differ in d shingles their words differ in d bits at most.
    """
    odd = np.bincount((found % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _prefixes(common: np.ndarray, counts: np.ndarray):
    """The shingles of which two similar texts share one: all but 0.8 of a text's and one more, seldom ones first."""
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            nodes, sizes, firsts, odd = [], [], [], []
            for text in texts_of(batch, "_text"):
                found = shingle_set(text, known)
                n = len(found)
                nodes.append(_node(found))
                sizes.append(n)
                odd.append(_parity(found))
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    found = found[np.argsort(np.where(common[at] == found, counts[at], 0), kind="stable")]
                firsts.append(found[: n - (4 * n + 4) // 5 + 1])
            words = np.array(odd, np.int64).reshape(-1, PARITY)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _lists(firsts), *[pa.array(words[:, k]) for k in range(PARITY)]],
                ["doc_id", "node", "n", "prefix", *ODD])

    return prefixes


def _common(rows: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in about ``sample`` texts, and their counts there: they only decide an order."""
    share = max(1, rows.count() // max(1, sample))
    seen = rows.where(F.pmod(F.xxhash64("_text"), F.lit(share)) == 0).select("_text").mapInArrow(_sets(), "node bigint, shingles array<bigint>")
    counted = seen.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 2")
    found = counted.orderBy(F.desc("c"), "s").limit(COMMON).collect()
    common, counts = unsigned([r.s for r in found]), np.array([r.c for r in found], np.int64)
    order = np.argsort(common)
    return common[order], counts[order]


def _fits(n: str, m: str, i: str, j: str) -> str:
    """What sizes and places in the order leave room for, at the first shingle that two texts with 0.8 in common share."""
    return f"5 * least({n}, {m}) >= 4 * greatest({n}, {m}) AND 9 * least({n} - {i}, {m} - {j}) >= 4 * ({n} + {m})"


def _alike(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets have 0.8 or more in common, stored; sets are made again for texts with a pair."""
    pairs = materialize(pairs.distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = rows.select("_text").mapInArrow(_sets(_marks(nodes)), "node bigint, shingles array<bigint>")
    sets = materialize(sets.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")
    of = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return materialize(both.where("9 * size(array_intersect(_a, _b)) >= 4 * (size(_a) + size(_b))").select("a", "b"), "alike")


def _stars(live: DataFrame, open_: DataFrame, turn: int) -> DataFrame:
    """Pairs of ``STARS`` texts of every open shingle, the same for as many shingles as can be, and others that hold it.

    A text is paired with at most ``STARS`` others a turn, those it shares most
    such shingles with: the pairs grow with the texts of a group, not with its
    square.
    """
    live = live.join(open_.select("token"), "token", "left_semi")
    chance = F.xxhash64("node", F.lit(turn))
    first = live.groupBy("token", F.pmod(F.xxhash64("node", F.lit(-2)), F.lit(STARS)).alias("deal")).agg(
        F.min_by(F.struct("node", "label", "n", "pos"), F.struct(chance, "node")).alias("r"))
    found = live.join(first, "token").where("label <> r.label").where(_fits("n", "r.n", "pos", "r.pos"))
    votes = found.groupBy("node", F.col("r.node").alias("star")).agg(F.count(F.lit(1)).alias("votes"))
    best = top_k(votes, ["node"], [F.col("votes").desc(), F.col("star")], STARS, "_place")
    return best.select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b"))


def _crosses(live: DataFrame, open_: DataFrame, odd: DataFrame, block_rows: int) -> DataFrame:
    """Pairs of texts of different labels that share an open shingle, in blocks of ``block_rows`` against each other.

    Sets with 0.8 in common differ in a ninth of their sizes at most. Pairs whose
    parity words (``odd``, by node) differ in more bits than that are left out: none of them is alike.
    """
    held = live.join(open_.select("token", "major", F.ceil(F.col("rows") / block_rows).alias("k")), "token").join(odd, "node")
    own, every = F.pmod(F.xxhash64("node", F.lit(-1)), "k"), F.explode(F.expr("sequence(0L, k - 1)"))
    sides = ["node", "label", "n", "pos", *ODD]
    left = held.where("label <> major").select("token", *sides, own.alias("i"), every.alias("j"))
    right = held.select("token", F.expr("label = major").alias("first"), every.alias("i"), own.alias("j"), *[F.col(c).alias(f"_{c}") for c in sides])
    differing = " + ".join(f"bit_count({c} ^ _{c})" for c in ODD)
    found = left.join(right, ["token", "i", "j"]).where("label <> _label AND (first OR node < _node)").where(
        f"{_fits('n', '_n', 'pos', '_pos')} AND 9 * ({differing}) <= n + _n")
    return found.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"))


#: Turns of comparing one text of each shingle before all pairs still open are compared.
TURNS = 64


def similar_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_rows: int = BLOCK_ROWS, sample: int = COUNTED, free_pairs: int = FREE_PAIRS,
) -> DataFrame:
    """One row for each document: ``doc_id`` and ``component_id``, the smallest id among those that links lead to.

    Texts link where the sets of their five-word shingles (as 64-bit hashes)
    have a Jaccard similarity of 0.8 or more; every such pair ends in one
    component and nothing below links. Two such texts share a shingle among the
    first fifth of each in any common order (prefix filter). Of every shingle with
    more than ``free_pairs`` open pairs for each of its rows one text is
    compared with all that hold it, as long as that closes a fifth of such pairs, and pairs within a component found so far
    are no longer open; then, and after ``TURNS`` such turns at the latest, all
    open pairs are compared, in blocks of ``shard_rows``; the parity of how many
    shingles fall on each of 256 bits first rules out pairs that differ too much. Equal sets are compared once. The order, seldom shingles
    first, comes from about ``sample`` texts and changes no result. Rows without
    words are one component; null ids stay null.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    shape = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node bigint, n bigint, prefix array<bigint>, " + ", ".join(f"{c} bigint" for c in ODD)
    made = materialize(rows.mapInArrow(_prefixes(*_common(rows, sample)), shape), "prefixes")
    distinct = made.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    postings = distinct.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    odd = made.groupBy("node").agg(*[F.first(c).alias(c) for c in ODD])
    shared = postings.groupBy("token").count().where("count > 1").select("token")
    whole = materialize(postings.join(shared, "token"), "postings")
    live, edges, roots, last = whole.withColumn("label", F.col("node")), None, None, None
    for turn in range(TURNS):
        each = live.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
        counted = each.groupBy("token").agg(F.sum("c").alias("rows"), F.sum(F.expr("c * CAST(c AS double)")).alias("q"), F.max_by("label", F.struct("c", "label")).alias("major"))
        open_ = materialize(counted.withColumn("open", F.expr("(rows * CAST(rows AS double) - q) / 2")).where("open > 0"), "open")
        wide = open_.where(F.col("open") > free_pairs * F.col("rows"))
        n, pairs = open_.agg(F.count(F.lit(1)), F.sum(F.when(F.col("open") > free_pairs * F.col("rows"), F.col("open")))).first()
        if not n:
            break
        rest = turn == TURNS - 1 or pairs is None or (last is not None and pairs > 0.8 * last)
        last = pairs
        found = _alike(_crosses(live, open_, odd, shard_rows) if rest else _stars(live, wide, turn), rows)
        edges = found if edges is None else edges.unionByName(found)
        roots = components(edges)
        if rest:
            break
        live = whole.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    if roots is not None:
        made = made.join(roots, "node", "left")
    rooted = made.select("doc_id", (F.coalesce("root", "node") if roots is not None else F.col("node")).alias("root"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The documents with the smallest id of their component of similar texts, with all their columns.

    Rows that repeat that id are all kept, as are documents without an id.
    """
    return _without(docs, doc_id, similar_documents(docs, doc_id, text, **options))
