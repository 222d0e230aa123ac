"""Mixing sources to target weights by Poisson replication.

A source of size ``s`` that is to make up the share ``w`` of ``epochs`` times
the corpus has to be repeated ``epochs * total * w / s`` times on average.
Every document gets a number of copies by inverting the Poisson distribution of
that mean at a number hashed from its id: no state, no order, the same result
on every run. The copies are then dealt out and sorted by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence.session import materialize

SEED = "mix"
#: A larger mean is made of several draws, so that the distribution's table stays short.
PART = 32.0


def _hash(digits: int, *parts: Column) -> Column:
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def _poisson_table(mean: Column) -> Column:
    """The cumulative distribution, as far as a double tells it from 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    begin = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def more(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), begin, more)["cdf"]


def rates(sizes: DataFrame, weights: DataFrame, epochs: float = 1.0) -> DataFrame:
    """``source``, ``rate`` (mean number of copies), ``parts`` and ``cdf`` of each source, stored.

    ``sizes`` has ``source`` and ``size``, ``weights`` ``source`` and
    ``weight``. Sources without a positive weight have the rate 0. Weights of
    sources that have no documents are left out before weights are scaled to 1.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    given = weights.select(F.col("source").alias("_of"), weight.cast("double").alias("_weight")).groupBy("_of").agg(F.sum("_weight").alias("_weight"))
    both = sizes.join(given, F.col("source").eqNullSafe(F.col("_of")), "left").withColumn("_weight", F.coalesce("_weight", F.lit(0.0)))
    all_ = both.agg(F.sum("size").alias("_total"), F.sum("_weight").alias("_weights"))
    total, weighed = all_.first()
    share = F.lit(0.0) if not weighed else F.lit(float(epochs)) * F.lit(float(total)) * (F.col("_weight") / F.lit(float(weighed))) / F.col("size")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int"))
    table = (
        both.withColumn("rate", share).withColumn("parts", parts)
        .select("source", "rate", "parts", _poisson_table(F.col("rate") / F.col("parts")).alias("cdf"))
    )
    return materialize(table, "rates")


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Characters of each source, and one for each document, so that no size is zero."""
    size = F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint") + 1
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("size"))


def smoothed_weights(sizes: DataFrame, power: float = 0.5) -> DataFrame:
    """Weights that flatten the differences between sources: their size to a power."""
    return sizes.select("source", F.pow(F.col("size").cast("double"), F.lit(power)).alias("weight"))


def mix(
    docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, seed: str = SEED, power: float = 0.5,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """Documents repeated and shuffled: ``row`` (all columns of ``docs``), ``copy_no``, ``n_copies``, ``rate``, ``shuffle_key``.

    Without ``weights`` sources weigh their size to ``power``. Null is a source
    of its own. Rows that repeat an id get as many copies as each other;
    documents without an id are drawn by a digest of their text. Drawing no
    copy is part of sampling; a source of weight zero disappears. The rates
    (one row for each source) are stored and joined as their size allows. The
    shuffle key decides task and place: hashing is the global shuffle, and no
    source, however large, meets in one task.
    """
    sizes = materialize(source_sizes(docs, source, text), "sizes")
    table = rates(sizes, smoothed_weights(sizes, power) if weights is None else weights, epochs)
    table = table.select(F.col("source").alias("_source"), "rate", "parts", "cdf")
    row = docs.select(F.struct("*").alias("row"))
    own = F.coalesce(F.col("row")[doc_id].cast("string"), F.sha2(F.coalesce(F.col("row")[text], F.lit("")).cast("binary"), 256))

    def draw(j: Column) -> Column:
        u = (_hash(13, F.lit(seed), F.col("_own"), j) + 0.5) / F.lit(float(1 << 52))
        return F.size(F.filter("cdf", lambda c: c < u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, j: n + draw(j))
    drawn = (
        row.withColumn("_own", own).join(table, F.col("row")[source].eqNullSafe(F.col("_source")))
        .withColumn("n_copies", copies).where("n_copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    )
    keyed = drawn.withColumn("shuffle_key", _hash(15, F.lit(seed), F.lit("copy"), F.col("_own"), F.col("copy_no")))
    return keyed.select("row", "copy_no", "n_copies", "rate", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
