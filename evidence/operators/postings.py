"""Word-overlap search by blocks of postings with upper bounds.

Items are dealt into blocks of like numbers of words. How many of its words a
block holds (counted in buckets of words), and the most words of an item in it,
bound the overlap of a query with any item of it. Every query first goes
to the few blocks of the highest bounds; of the others only those follow whose
bound reaches the ``k``-th best overlap found there. In a task the postings of
one block are arrays; those of a query's words are added up for all items at
once. The result is exact, and no row is made for a word that a query and an
item share.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence.operators.ranking import top_k
from evidence.session import materialize

#: Items of a block, queries that meet one copy of it, and blocks a query meets before bounds decide.
BLOCK_ITEMS, BLOCK_QUERIES, FIRST_BLOCKS = 131072, 32768, 1
#: Buckets of words that the bounds are counted in (a power of two).
BUCKETS = 1 << 18


class Block:
    """The postings of one block; items come in the order of their keys."""

    def __init__(self):
        self.keys: list = []
        self.lists: dict[str, array] = {}
        self.postings: dict[str, np.ndarray] | None = None

    def add(self, key, words: list[str]) -> None:
        for word in words:
            self.lists.setdefault(word, array("i")).append(len(self.keys))
        self.keys.append(key)

    def best(self, words: list[str], k: int) -> list[tuple]:
        """The ``k`` items with most of the words, and how many; equal ones by key."""
        if self.postings is None:
            self.postings = {w: np.array(x, np.int32) for w, x in self.lists.items()}
            self.lists = {}
        held = [p for p in map(self.postings.get, words) if p is not None]
        if not held:
            return []
        n = len(self.keys)
        shared = np.bincount(np.concatenate(held), minlength=n)
        order = shared * n + np.arange(n - 1, -1, -1)  # more words first, then the smaller key
        top = np.argpartition(order, n - k)[n - k :] if n > k else np.arange(n)
        top = top[np.argsort(-order[top])]
        return [(self.keys[i], int(shared[i])) for i in top.tolist() if shared[i]]


def _scoring(schema: pa.Schema, k: int):
    """Rows of a (block, part) in order, its items before the queries, to the best items of each query."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, Block()
        for batch in batches:
            made: list[dict] = []
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                for number, deal, pid, item, words in zip(*[part.column(c).to_pylist() for c in ("block", "part", "pid", "item", "words")], strict=True):
                    if (number, deal) != at:
                        at, block = (number, deal), Block()
                    words = words.split("\n")
                    if pid is None:
                        block.add(item, words)
                    else:
                        made += [{"pid": pid, "item": i, "overlap": n} for i, n in block.best(words, k)]
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=schema)

    return score


def _meet(asked: DataFrame, profiles: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The best items of each block for the queries of ``asked`` (pid, block); a block is copied for each part of its queries."""
    sizes = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int").alias("part")
    queries = asked.join(sizes, "block").join(profiles, "pid").select("block", part, "pid", F.lit(None).cast(blocks.schema["item"].dataType).alias("item"), "words")
    items = blocks.join(sizes, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("pid"), "item", "words")
    rows = items.unionByName(queries).repartition("block", "part").sortWithinPartitions("block", "part", F.col("pid").isNotNull(), "item")
    kind = f"pid binary, item {blocks.schema['item'].dataType.simpleString()}, overlap bigint"
    shape = asked.sparkSession.createDataFrame([], kind).toArrow().schema
    return rows.mapInArrow(_scoring(shape, k), kind)


def _text(words: str) -> Column:
    """Words as one text, in order, which takes a third of the room of an array."""
    return F.array_join(F.array_sort(words), "\n")


def _buckets() -> Column:
    return F.transform(F.split("words", "\n"), lambda w: F.xxhash64(w).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).alias("buckets")


def _held(blocks: DataFrame) -> dict[int, tuple[np.ndarray, int]]:
    """Of each block the buckets its words fall into, one bit each, and the most words of an item."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        most: dict[int, int] = {}
        for batch in batches:
            numbers, lists = batch.column("block").to_numpy(), batch.column("buckets")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            of, values = np.repeat(numbers, sizes), lists.flatten().to_numpy(zero_copy_only=False)
            for b in np.unique(numbers).tolist():
                held.setdefault(b, np.zeros(BUCKETS, bool))[values[of == b]] = True
                most[b] = max(most.get(b, 0), int(sizes[numbers == b].max()))
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(list(held), pa.int32()), "bits": pa.array([np.packbits(h).tobytes() for h in held.values()], pa.binary()),
            "most": pa.array([most[b] for b in held], pa.int32())})

    found: dict[int, tuple[np.ndarray, int]] = {}
    for r in blocks.select("block", _buckets()).mapInArrow(bits, "block int, bits binary, most int").toLocalIterator():
        before, most = found.get(r.block, (0, 0))
        found[r.block] = np.frombuffer(bytes(r.bits), np.uint8) | before, max(most, r.most)
    return found


def _bounds(profiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks that may share words with a query: ``pid, block``, the ``bound`` on the overlap and the block's place by it."""
    held = blocks.sparkSession.sparkContext.broadcast(_held(blocks))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sorted(held.value)
        for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            sizes = pc.list_value_length(batch.column("buckets")).to_numpy(zero_copy_only=False)
            values, starts = batch.column("buckets").flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            bound = np.zeros((batch.num_rows, len(numbers)), np.int32)
            for k, b in enumerate(numbers):
                bits, most = held.value[b]
                bound[:, k] = np.minimum(np.add.reduceat(np.unpackbits(bits)[values], starts, dtype=np.int32), most)
            order = np.argsort(-bound, axis=1, kind="stable")
            place = np.empty_like(bound)
            np.put_along_axis(place, order, np.arange(1, len(numbers) + 1, dtype=np.int32)[None, :], axis=1)
            row, k = np.nonzero(bound)
            yield pa.RecordBatch.from_pydict({
                "pid": batch.column("pid").take(pa.array(row)), "block": pa.array(np.array(numbers, np.int32)[k]),
                "bound": pa.array(bound[row, k].astype(np.int64)), "_place": pa.array(place[row, k])})

    return profiles.select("pid", _buckets()).mapInArrow(bounds, "pid binary, block int, bound bigint, _place int")


def block_topk(
    queries: DataFrame, items: DataFrame, query_key: list[str], item_key: str, k: int,
    block_items: int = BLOCK_ITEMS, first_blocks: int = FIRST_BLOCKS,
) -> DataFrame:
    """The ``k`` items sharing most distinct words with each query (ties: smaller item key), with ``overlap`` and ``rank``.

    Both inputs need a ``words`` array of distinct words without line breaks. Queries with the same
    words are searched once. An item that shares no word is never found; items
    without words take no part.
    """
    listed = items.select(F.col(item_key).alias("item"), "words").where(F.size("words") > 0)
    n_blocks = max(1, -(-listed.count() // block_items))
    by_size = listed.repartitionByRange(n_blocks, F.size("words").desc(), F.col("item"))
    blocks = materialize(by_size.select("item", _text("words").alias("words"), F.spark_partition_id().alias("block")), "blocks")
    asked = queries.where(F.size("words") > 0).select(*query_key, _text("words").alias("words"))
    named = F.unhex(F.substring(F.sha2("words", 256), 1, 32))
    keyed = materialize(asked.withColumn("pid", named), "queries")
    profiles = materialize(keyed.groupBy("pid").agg(F.first("words").alias("words")), "profiles")
    bounds = materialize(_bounds(profiles, blocks), "bounds")
    found = materialize(_meet(bounds.where(F.col("_place") <= first_blocks).select("pid", "block"), profiles, blocks, k), "found")
    if n_blocks > first_blocks:
        order = [F.col("overlap").desc(), F.col("item")]
        reached = top_k(found, ["pid"], order, k, "_n").where(F.col("_n") == k).select("pid", F.col("overlap").alias("reached"))
        rest = bounds.where(F.col("_place") > first_blocks).join(reached, "pid", "left").where(F.col("bound") >= F.coalesce("reached", F.lit(1)))
        found = found.unionByName(_meet(rest.select("pid", "block"), profiles, blocks, k))
    best = top_k(found, ["pid"], [F.col("overlap").desc(), F.col("item")], k)
    return keyed.select(*query_key, "pid").join(best, "pid").select(*query_key, F.col("item").alias(item_key), "overlap", "rank")
