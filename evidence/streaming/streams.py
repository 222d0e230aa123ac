"""Structured Streaming twins; each has a batch operator that gives the same rows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from evidence import constants as K
from evidence.operators.hook import score
from evidence.operators.routing import result_class


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, pattern: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of ``folder`` that match ``pattern``, as they arrive.

    A pattern without wildcards names one table, which may be a file or a folder of files.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if not set(pattern) & set("*?[{"):
        return arriving.parquet(f"{folder}/{{{pattern}}}")
    return arriving.option("pathGlobFilter", pattern).parquet(folder)


def stream_route(claims: DataFrame) -> DataFrame:
    """Claims with their class; stateless, so it scales with the input partitions."""
    return claims.withColumn("result_class", result_class())


def stream_token_cost(
    usage: DataFrame, length: str = "1 day", slide: str | None = None, delay: str = "1 hour", gap: str | None = None
) -> DataFrame:
    """Tokens and cost per task and time window.

    Tumbling by default, sliding with ``slide``, per session with ``gap``. In
    append mode a window appears once the watermark has passed it, its state is
    dropped, and later rows are not counted. In complete mode every window is
    kept and every row counts: for runs over what there is, not for endless ones.
    """
    if gap:
        window = F.session_window("ts", gap)
    else:
        window = F.window("ts", length, slide) if slide else F.window("ts", length)
    tokens_in, tokens_out = F.sum("input_tokens"), F.sum("output_tokens")
    return (
        usage.withWatermark("ts", delay)
        .groupBy(window.alias("_window"), "task")
        .agg(
            tokens_in.alias("input_tokens"),
            tokens_out.alias("output_tokens"),
            (
                tokens_in / 1_000_000 * K.INPUT_PRICE_PER_MILLION + tokens_out / 1_000_000 * K.OUTPUT_PRICE_PER_MILLION
            ).alias("total_cost"),
        )
        .select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"),
                "task", "input_tokens", "output_tokens", "total_cost")
    )


def stream_manifest(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append manifest events to a table; ``manifest_current`` over it gives the present state."""
    return (
        events.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


#: Keys of the manifest state: citations share one, so that its store is called once for many of them.
STATE_BUCKETS = 1024


class OpenRecords(StatefulProcessor):
    """Records that are not deleted, of the citations of one bucket: an event touches only the newest of its citation.

    The state of a bucket is read and written once a micro-batch. Of each
    citation it holds its open records, oldest first, and how many others have
    left it by age.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", "citations binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[int, list]] = pickle.loads(self.kept.get()[0]) if self.kept.exists() else {}
        now = timer_values.getCurrentProcessingTimeInMs() if self.ttl_ms is not None else 0
        if self.ttl_ms is not None:
            for citation, (aged, records) in held.items():
                young = [r for r in records if r[2] > now - self.ttl_ms]
                held[citation] = aged + len(records) - len(young), young
        changed: dict[tuple, tuple[int, int | None]] = {}
        arrived = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for doc, citation, seq, kind, at in zip(*[arrived[c].tolist() for c in ("doc_id", "citation_id", "seq", "kind", "at")], strict=True):
            aged, records = held.get((doc, citation), (0, []))
            if kind == "append":
                records.append((seq, at, now))
                changed[doc, citation, seq] = at, None
            elif records:
                record, appended, _ = records.pop()
                changed[doc, citation, record] = appended, at
            else:
                aged = max(aged - 1, 0)
            held[doc, citation] = aged, records
        self.kept.update((pickle.dumps({c: x for c, x in held.items() if x[0] or x[1]}),))
        yield pd.DataFrame({
            "doc_id": pd.Series([d for d, _, _ in changed], dtype=object), "citation_id": pd.Series([c for _, c, _ in changed], dtype=object),
            "seq": pd.Series([s for _, _, s in changed], dtype="int64"),
            "appended_at": pd.Series([a for a, _ in changed.values()], dtype="int64"),
            "deleted_at": pd.array([d for _, d in changed.values()], dtype="Int64"),
        })

    def close(self) -> None:
        pass


def stream_manifest_state(events: DataFrame, ttl_ms: int | None = None, buckets: int = STATE_BUCKETS) -> DataFrame:
    """Present records of the manifest as the events arrive, by state keyed on buckets of citations.

    Update mode: a row for a record when it is appended, and a row with
    ``deleted_at`` when the deletion that belongs to it comes, in whatever later
    micro-batch. Events of a micro-batch are taken by ``seq``; between
    micro-batches the order of arrival counts. A deletion without an open record
    does nothing. The state holds open records alone; with ``ttl_ms`` those
    untouched for so long leave it, and their deletion then finds nothing. The
    state of a bucket that has events is rewritten; ``buckets`` must stay as it
    is over the life of a checkpoint.
    Needs RocksDB as the state store (``manifest_state_to_table`` sets it).
    """
    slim = events.select(
        F.pmod(F.xxhash64("doc_id", "citation_id"), F.lit(buckets)).alias("bucket"),
        F.col("doc_id").cast("string").alias("doc_id"), "citation_id", "seq", "kind", F.unix_micros("at").alias("at"))
    kept = slim.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=OpenRecords(ttl_ms),
        outputStructType="doc_id string, citation_id string, seq bigint, appended_at bigint, deleted_at bigint",
        outputMode="Update",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )
    return kept.withColumns({"doc_id": F.col("doc_id").cast("bigint"), **{c: F.timestamp_micros(c) for c in ("appended_at", "deleted_at")}})


def manifest_state_to_table(events: DataFrame, path: str, checkpoint: str, ttl_ms: int | None = None) -> None:
    """Run ``stream_manifest_state`` over what is there; a micro-batch that runs again replaces its own folder."""
    conf, key = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, ROCKSDB)
    try:
        run_to_table(stream_manifest_state(events, ttl_ms), path, checkpoint, "update")
    finally:
        conf.set(key, before)


def read_manifest_state(spark: SparkSession, path: str) -> DataFrame:
    """Present records from the rows ``manifest_state_to_table`` wrote: a record's deletion replaces it."""
    return spark.read.parquet(path).groupBy("doc_id", "citation_id", "seq").agg(
        F.max("appended_at").alias("appended_at"), F.max("deleted_at").alias("deleted_at"))


def stream_parse_once(citations: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each citation text once within the watermark, ready for the model hook."""
    return citations.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["raw_text"])


def parse_in_batches(citations: DataFrame, model, path: str, checkpoint: str) -> StreamingQuery:
    """Parse arriving citation texts with the model, micro-batch by micro-batch, into a table.

    The folder of a batch is named after it, so a batch that runs again replaces its own rows.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        parsed = score(
            batch, model, ["raw_text"],
            "title string, first_author string, year int, journal string, doi string", task="reference_parsing",
        )
        parsed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream_parse_once(citations).writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now into parquet files and stop.

    ``complete`` and ``update`` results are written per micro-batch; each batch replaces its own folder.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(
            lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}" if mode == "update" else path)
        ).start()
    query.awaitTermination()
