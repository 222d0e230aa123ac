"""Exact duplicates by counting quotient filters.

Every partition counts the 64-bit fingerprints of its texts in quotient
filters, one for each shard of the fingerprint space. A filter splits a
fingerprint into a quotient, told by two bitmaps, and a remainder, stored in
sorted order with a counter. Nothing is lost, so the filters of a shard merge
by their sorted remainders into exact counts. Fingerprints counted once are
unique texts; only the others are sent to the comparison of whole texts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence.llm.common import runs_of, squeezed, unsigned
from evidence.session import materialize

SHARD_BITS = 10
FILTER_ROWS = 1 << 20
LOAD = 0.75
#: Groups of equal texts that go to all tasks; with more of them the documents' rows are joined as Spark sees fit.
BROADCAST_GROUPS = 1 << 17
HEAD = "<BBQ"


def pack(prints: np.ndarray, counts: np.ndarray, shard_bits: int) -> bytes:
    """A counting quotient filter of sorted, distinct fingerprints that share their top ``shard_bits`` bits."""
    n = len(prints)
    q = max(1, int(np.ceil(np.log2(max(1, n) / LOAD))))
    r = 64 - shard_bits - q
    quotients = ((prints >> np.uint64(r)) & np.uint64((1 << q) - 1)).astype(np.int64)
    rest = prints & np.uint64((1 << r) - 1)
    occupied = np.zeros(1 << q, np.uint8)
    occupied[quotients] = 1
    ends = np.append(quotients[1:] != quotients[:-1], True).astype(np.uint8)
    width = (r + 7) // 8
    remainders = rest.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<u8")
    return b"".join(
        (struct.pack(HEAD, shard_bits, q, n), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
         remainders.tobytes(), small.tobytes(), large.tobytes())
    )


def unpack(blob: bytes, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter and their counts."""
    shard_bits, q, n = struct.unpack_from(HEAD, blob)
    r = 64 - shard_bits - q
    at = struct.calcsize(HEAD)
    take = lambda size: np.frombuffer(blob, np.uint8, size, at)
    size = ((1 << q) + 7) // 8
    quotients = np.flatnonzero(np.unpackbits(take(size))[: 1 << q])
    at += size
    size = (n + 7) // 8
    ends = np.unpackbits(take(size))[:n]
    at += size
    run = np.cumsum(ends) - ends  # the run each slot belongs to
    width = (r + 7) // 8
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :width] = take(n * width).reshape(n, width)
    at += n * width
    counts = take(n).astype(np.int64)
    at += n
    counts[counts == 255] = np.frombuffer(blob, "<u8", -1, at).astype(np.int64)
    high = np.uint64((shard << (64 - shard_bits)) if shard_bits else 0)
    return high | (quotients[run].astype(np.uint64) << np.uint64(r)) | rest.view("<u8").ravel(), counts


def merge(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts added up over several filters; each comes sorted, so this is a merge of sorted runs."""
    prints = np.concatenate([p for p, _ in filters])
    counts = np.concatenate([c for _, c in filters])
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[first], np.add.reduceat(counts, first)


def _building(shard_bits: int, filter_rows: int):
    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        prints, counts = np.unique(np.concatenate(held), return_counts=True)
        shards = (prints >> np.uint64(64 - shard_bits)).astype(np.int64)
        first = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
        parts = zip(np.split(prints, first[1:]), np.split(counts, first[1:]), strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(shards[first].astype(np.int32)), pa.array([pack(p, c, shard_bits) for p, c in parts], pa.binary())],
            ["shard", "filter"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(unsigned(batch.column(0).to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= filter_rows:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return build


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, blobs in runs_of(batches, "shard", "filter"):
        prints, counts = merge([unpack(b, shard) for b in blobs])
        yield pa.RecordBatch.from_arrays([pa.array(prints[counts > 1].view(np.int64))], ["_fp"])


def repeated_fingerprints(prints: DataFrame, shard_bits: int = SHARD_BITS, filter_rows: int = FILTER_ROWS) -> DataFrame:
    """The values of the one bigint column that occur in more than one row, stored, as ``_fp``.

    A partition holds ``filter_rows`` fingerprints at a time and a merging task
    the filters of one of the ``2 ** shard_bits`` shards: raise the bits beyond
    some 10**10 rows.
    """
    filters = prints.mapInArrow(_building(shard_bits, filter_rows), "shard int, filter binary")
    merged = filters.repartition("shard").sortWithinPartitions("shard")
    return materialize(merged.mapInArrow(_repeated, "_fp bigint"), "repeated")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    norm = squeezed(docs[text])
    return docs.withColumns({"_norm": norm, "_fp": F.xxhash64(norm), "_sha": F.sha2(norm.cast("binary"), 256)})


def groups_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **filters: int) -> DataFrame:
    """Groups of two or more equal texts, stored: ``_fp``, ``_sha``, ``keep_id``, ``group_size``.

    Whole normalised texts are the grouping key of the comparison, so a
    fingerprint or digest shared by different texts joins nothing; two texts
    with one SHA-256 digest, of which none are known, end the job. Copies are
    combined before the shuffle: a text held by a third of all rows travels
    once for each task that read it.
    """
    keyed = _keyed(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text")
    repeated = repeated_fingerprints(keyed.select("_fp"), **filters)
    # The stored table is broadcast where Spark finds it small, and joined by a shuffle where it is not.
    same = (
        keyed.join(repeated, "_fp", "left_semi").groupBy("_fp", "_sha", "_norm")
        .agg(F.min("_id").alias("_min"), F.count(F.lit(1)).alias("_n"))
    )
    split = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("different texts with one SHA-256 digest")))
    groups = same.groupBy("_fp", "_sha").agg(F.min("_min").alias("keep_id"), F.coalesce(split.cast("bigint"), F.sum("_n")).alias("group_size"))
    return materialize(groups.where("group_size > 1"), "groups")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **filters: int) -> DataFrame:
    """One row for each document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Equal are texts that are identical after white space is squeezed; null is
    the empty text, and empty texts are equal. The smallest ``doc_id`` of a
    group stays, null ids last. Rows that repeat both id and text all count in
    ``group_size`` and are all marked as kept: they are one document. No rows
    give no rows. Other columns are not read.
    """
    groups = groups_of(docs, doc_id, text, **filters)
    keys = _keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text").select("doc_id", "_fp", "_sha")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return keys.join(groups, ["_fp", "_sha"], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **filters: int) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text one stays.

    Whole rows move only where there are more than ``BROADCAST_GROUPS`` groups,
    and for ids that are kept more than once.
    """
    stored = groups_of(docs, doc_id, text, **filters).select("_fp", "_sha", F.col("keep_id").alias("_keep"), F.lit(True).alias("_copied"))
    few = stored.count() <= BROADCAST_GROUPS
    groups = F.broadcast(stored) if few else stored
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))  # whole rows, whatever their columns are called
    marked = _keyed(rows, "_text").select("_row", "_fp", "_sha").join(groups, ["_fp", "_sha"], "left")
    kept = marked.where(F.col("_copied").isNull() | F.col("_row")[doc_id].eqNullSafe(F.col("_keep")))
    again = (
        kept.where("_copied").groupBy("_fp", "_sha").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    )
    again = materialize(again, "again")
    if again.isEmpty():
        return kept.select("_row.*")
    again = F.broadcast(again) if few else again
    once = kept.join(again, ["_fp", "_sha"], "left_anti").select("_row")
    repeats = kept.join(again, ["_fp", "_sha"], "left_semi").dropDuplicates(["_fp", "_sha"])
    return once.union(repeats.select("_row")).select("_row.*")
