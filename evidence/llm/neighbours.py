"""Approximate nearest neighbours along shifted space-filling curves.

Vectors are projected to a few dimensions in several random directions, shifted
at random, and ordered along a Hilbert curve for each projection. Neighbours in
space tend to be neighbours on some curve. The curves are sorted by ranges and
cut into blocks; a query is sent to all blocks that its window on a curve
touches, and meets their vectors there. What the windows find on all curves is
merged and ranked by the exact distance.

How wide a window must be depends on the data. It is measured on a few queries
whose true neighbours are known from a full search: the width within which
the wanted share of them lies on the curve that holds them closest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidence.llm.common import ranked
from evidence.session import materialize

K = 10
CURVES = 4
DIMENSIONS = 4
BITS = 12
#: Share of true neighbours that windows are made for; queries it is measured on; vectors that projections are fitted on.
TARGET = 0.97
MEASURED = 96
SAMPLE = 4096
#: Vectors in a block, and queries that meet one in a task.
BLOCK = (2048, 65536)
QUERIES = 65536
SEED = 9


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of grid cells (n x d, each below ``2 ** bits``), as one integer."""
    x = cells.astype(np.int64).copy()
    n, d = x.shape
    for level in range(bits - 1, 0, -1):  # undo the turns and mirrorings of the sub-cubes, from the largest
        low = (1 << level) - 1
        for i in range(d):
            mirrored = (x[:, i] >> level & 1).astype(bool)
            swap = np.where(mirrored, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(mirrored, low, swap)
            x[:, i] ^= swap
    for i in range(1, d):  # Gray code over the dimensions
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    place = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            place = place << 1 | (x[:, i] >> level & 1)
    return place


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def fit_curves(sample: np.ndarray, curves: int, dims: int, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Projection, origin and width of the grid of each curve, from a sample of vectors."""
    rng, size, found = np.random.default_rng(seed), sample.shape[1], []
    for _ in range(curves):
        axes = np.linalg.qr(rng.normal(size=(size, size)))[0][:, : min(dims, size)]
        shown = sample @ axes
        low, width = shown.min(axis=0), np.ptp(shown, axis=0) + 1e-12
        found.append((axes, low - rng.uniform(0, 1, axes.shape[1]) * width, 2 * width))
    return found


def _keys(curves: list, bits: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"))
            for c, (axes, low, width) in enumerate(curves):
                cell = np.clip((x @ axes - low) / width * (1 << bits), 0, (1 << bits) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert(cell, bits)), batch.column("cls")], ["curve", "place", "cls"])

    return keys


def closest(x: np.ndarray, q: np.ndarray, first: np.ndarray, own: np.ndarray, cls: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``q``, row of ``x`` and distance of the ``k`` vectors nearest to each query, not counting its own.

    A few more than ``k`` are picked by products, and ranked by exact differences.
    """
    spare = min(len(x), k + 8)
    rows, near, away = [], [], []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        rough = (x**2).sum(axis=1) - 2 * part @ x.T
        rough[own[at : at + 256, None] == cls] = np.inf
        pick = np.argpartition(rough, spare - 1, axis=1)[:, :spare]
        seen = np.sort(np.take_along_axis(rough, pick, axis=1), axis=1)
        if len(x) > spare and (seen[:, -1] - seen[:, min(k, spare) - 1] < 1e-6 * (1 + np.abs(seen[:, -1]))).any():
            pick = np.broadcast_to(np.arange(len(x)), rough.shape)  # more equal distances than were picked: all are compared exactly
        exact = np.stack([np.sqrt(((p - x[i]) ** 2).sum(axis=1)) for p, i in zip(part, pick, strict=True)])
        exact[np.take_along_axis(rough, pick, axis=1) == np.inf] = np.inf
        order = np.lexsort((first[pick], exact), axis=1)[:, :k]
        rows.append(np.repeat(np.arange(at, at + len(part)), order.shape[1]))
        near.append(np.take_along_axis(pick, order, axis=1).ravel())
        away.append(np.take_along_axis(exact, order, axis=1).ravel())
    rows, near, away = (np.concatenate(v) for v in (rows, near, away))
    return rows[away < np.inf], near[away < np.inf], away[away < np.inf]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id`` and ``vector`` of the rows that take part, each once.

    Left out are null ids, and vectors that are null, zero, hold a null or
    non-finite component or have another length than most.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)
    whole = rows.where(F.col("vec_id").isNotNull() & F.forall("vector", number) & F.exists("vector", lambda x: x != 0))
    size = whole.groupBy(F.size("vector").alias("_s")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_s").first()
    return whole.where(F.size("vector") == (size[0] if size else 0)).distinct()


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Equal vectors as one: ``cls``, ``vector``, ``first`` (smallest id) and ``ids`` (the ``k + 1`` smallest), stored."""
    least = rows.withColumn("_r", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    grouped = least.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return materialize(grouped.select(F.monotonically_increasing_id().alias("cls"), "vector", F.col("ids")[0].alias("first"), "ids"), "vectors")


def _true_neighbours(classes: DataFrame, asked: list, k: int) -> DataFrame:
    """``q`` (class of the query) and ``cls`` of the nearest other vectors, by comparing ``asked`` with every vector in blocks."""
    queries, own = np.array([r["vector"] for r in asked], np.float64), np.array([r["cls"] for r in asked])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "first"))
            rows, near, away = closest(matrix(batch.column("vector")), queries, first, own, cls, k)
            yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(cls[near]), pa.array(away)], ["q", "cls", "away"])

    found = classes.select("cls", "vector", "first").mapInArrow(search, "q bigint, cls bigint, away double")
    return found.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy("away", "cls"))).where(F.col("_r") <= k)


def measured_window(classes: DataFrame, places: DataFrame, asked: list, k: int, target: float) -> int:
    """Rows on either side of a query within which ``target`` of the true neighbours lie on some curve."""
    pairs = [(r["q"], r["cls"]) for r in _true_neighbours(classes, asked, k).select("q", "cls").collect()]  # asked x k
    if not pairs:
        return 1
    wanted = list({c for pair in pairs for c in pair})
    at: dict[int, dict[int, int]] = {}
    for r in places.where(F.col("cls").isin(wanted)).select("cls", "curve", "_rank").collect():
        at.setdefault(r["cls"], {})[r["curve"]] = r["_rank"]
    gaps = [min(abs(at[a][c] - at[b][c]) for c in at[a]) for a, b in pairs]
    return int(np.quantile(gaps, target, method="higher")) + 1


def _meeting(k: int):
    def meet(key, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(queries):
            return pd.DataFrame({"q": [], "cls": [], "away": [], "first": []})
        x, q = (np.stack(v.to_numpy()).astype(np.float64) for v in (members["vector"], queries["asked"]))
        cls, first = members["cls"].to_numpy(), members["first"].to_numpy()
        rows, near, away = closest(x, q, first, queries["q"].to_numpy(), cls, k)
        return pd.DataFrame({"q": queries["q"].to_numpy()[rows], "cls": cls[near], "away": away, "first": first[near]})

    return meet


def nearest(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K,
    curves: int = CURVES, dims: int = DIMENSIONS, bits: int = BITS, target: float = TARGET,
    measured: int = MEASURED, sample: int = SAMPLE,
) -> DataFrame:
    """The ``k`` nearest found for every query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (Euclidean distance).

    ``is_query`` may use the column ``vec_id``. All rows but those that
    ``usable`` leaves out are indexed and are candidates, but not a query's own
    id. Equal vectors are indexed once, so that a vector with any number of
    copies is no large group; of its ids the smallest ``k + 1`` are enough for
    any answer. Ties go to the smaller id. Rows that repeat id and vector count
    once. No queries or no other vectors give no rows.

    ``sample`` vectors fit the projections and ``measured`` queries the window:
    these, and nothing that grows with the input, reach the driver.
    """
    rows = materialize(usable(vectors, vec_id, vector), "usable")
    classes = _classes(rows, k)
    queries = materialize(
        rows.where(is_query).join(classes.select("vector", "cls"), "vector").select(F.col("vec_id").alias("query_id"), F.col("cls").alias("q")), "queries")
    by_hash = lambda df, n: df.orderBy(F.xxhash64(F.lit(3), "cls"), "cls").limit(n)
    chosen = np.array([r["vector"] for r in by_hash(classes, sample).select("vector").collect()], np.float64)
    asked_by = queries.select(F.col("q").alias("cls")).distinct()
    asked = by_hash(asked_by, measured).join(classes, "cls").select("cls", "vector").collect()
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    if not asked:
        return vectors.sparkSession.createDataFrame([], shape)
    keys = classes.select("cls", "vector").mapInArrow(_keys(fit_curves(chosen, curves, dims), bits), "curve int, place bigint, cls bigint")
    places = materialize(ranked(keys, "curve", "place", "cls").select("curve", "cls", "_rank"), "places")
    window = measured_window(classes, places, asked, k, target)
    size = min(max(window // 4, BLOCK[0]), BLOCK[1])

    block = lambda x: F.floor(x / size).cast("bigint")
    windows = (
        places.join(asked_by, "cls")
        .select(F.col("cls").alias("q"), F.explode(F.sequence(block(F.greatest(F.col("_rank") - window, F.lit(0))), block(F.col("_rank") + window))).alias("block"))
        .distinct()
    )
    fullest = windows.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    parts = -(-fullest // QUERIES)
    left = (
        places.select("cls", block(F.col("_rank")).alias("block")).distinct().join(classes.select("cls", "vector", "first"), "cls")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    )
    right = windows.join(classes.select(F.col("cls").alias("q"), F.col("vector").alias("asked")), "q").withColumn("part", F.pmod(F.hash("q"), F.lit(parts)))
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(_meeting(k), "q bigint, cls bigint, away double, first bigint")
    best = met.distinct().withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy("away", "first"))).where(F.col("_r") <= k)
    # Ids of the classes found, and of the query's own class, in order; one more than asked, as the query itself may be among them.
    found = best.select("q", "cls", "away").unionByName(asked_by.select(F.col("cls").alias("q"), "cls", F.lit(0.0).alias("away")))
    ids = found.join(classes.select("cls", "ids"), "cls").select("q", "away", F.explode("ids").alias("vec_id"))
    lists = (
        ids.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy("away", "vec_id"))).where(F.col("_r") <= k + 1)
        .groupBy("q").agg(F.sort_array(F.collect_list(F.struct("away", "vec_id"))).alias("_list"))
    )
    own = queries.join(lists, "q").select("query_id", F.filter("_list", lambda x: x["vec_id"] != F.col("query_id")).alias("_list"))
    return own.select("query_id", F.posexplode(F.slice("_list", 1, k)).alias("_at", "_hit")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_hit.vec_id").alias("vec_id"), F.col("_hit.away").alias("score"))
