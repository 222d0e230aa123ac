"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidence.session import materialize

SPACE = r"\x20\x09-\x0D"


def squeezed(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as the empty text.

    Single spaces are left to themselves, which saves most replacements.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]{{2,}}|[\x09-\x0D]", " ")


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch as Python strings, nulls as empty ones."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def runs_of(batches: Iterator[pa.RecordBatch], key: str, value: str) -> Iterator[tuple[int, list]]:
    """Values of equal neighbouring keys, one run at a time, from rows sorted by key."""
    at, held = None, []
    for batch in batches:
        for k, v in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist(), strict=True):
            if k != at and held:
                yield at, held
                held = []
            at = k
            held.append(v)
    if held:
        yield at, held


def slots(df: DataFrame, *order: str) -> DataFrame:
    """``df`` dealt out by ranges of ``order`` and stored, with the number of its range as ``_slot``.

    Ranges of higher numbers hold larger keys. The stored table keeps later
    steps on one and the same cut, whatever is computed again.
    """
    ranged = df.repartitionByRange(*order).withColumn("_slot", F.spark_partition_id())
    return materialize(ranged, "slots")


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``_rank``, the place of each row in the total order, counted from 0 without a single task for all."""
    table = slots(df, *order)
    sizes = table.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    starts = sizes.select("_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("_slot").orderBy(*order))
    return table.withColumn("_rank", place - 1).join(starts, "_slot").withColumn("_rank", F.col("_rank") + F.col("_start")).drop("_slot", "_start")


def unsigned(values) -> np.ndarray:
    """Spark's signed longs as unsigned ones, bit by bit."""
    return np.asarray(values, dtype=np.int64).view(np.uint64)


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a batch in UTF-8, nulls as empty ones."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts as rows of ``size`` bytes, the last padded with zeros; an empty text has one row of zeros.

    Also the first row of every text and the number of bytes in each row.
    """
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = np.maximum(1, -(-length // size))
    first = np.cumsum(rows) - rows
    flat = np.zeros(int(rows.sum()) * size, np.uint8)
    for text, at in zip(texts, (first * size).tolist(), strict=True):
        flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
    used = np.full(len(flat) // size, size, np.int64)
    used[first + rows - 1] = length - (rows - 1) * size
    return flat.reshape(-1, size), first, used


def blocks(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Texts in order, in lists of about ``most`` bytes; a longer text is a list of its own."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


class Adam:
    """Adam steps over a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.n = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k, g in grads.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            mean, square = self.mean[k] / (1 - 0.9**self.n), self.square[k] / (1 - 0.999**self.n)
            self.weights[k] -= (self.rate * mean / (np.sqrt(square) + 1e-8)).astype(self.weights[k].dtype)
