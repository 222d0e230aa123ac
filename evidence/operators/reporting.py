"""Summaries, costs, model routing, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions.text import contains_any, strip
from evidence.session import by_key

SEQ_BUCKET = 100_000


def _classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(K.RESULT_CLASSES)], "step int, result_class string")


def result_stats(results: DataFrame) -> DataFrame:
    """count, passed, failed and mean confidence per class; empty classes show up with zeros."""
    stats = results.groupBy("result_class").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"),
    )
    return _classes(results.sparkSession).join(stats, "result_class", "left").select(
        "result_class",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("count", "passed", "failed")],
        "avg_confidence",
    )


def run_summary(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Claims and results per paper and class, per class, and in total.

    ``level`` says which; both inputs carry ``result_class``, and each is aggregated once.
    """
    def levels(df: DataFrame, *aggs: Column) -> DataFrame:
        doc, cls = F.col("doc_id"), F.col("result_class")
        return (
            df.groupingSets([[doc, cls], [cls], []], doc, cls)
            .agg(*aggs, F.grouping_id("doc_id", "result_class").alias("gid"))
        )

    asked = levels(claims, F.count(F.lit(1)).alias("input_claims"))
    got = levels(
        results,
        F.count(F.lit(1)).alias("count"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"),
    )
    same = (
        F.col("a.doc_id").eqNullSafe(F.col("g.doc_id"))
        & F.col("a.result_class").eqNullSafe(F.col("g.result_class"))
        & (F.col("a.gid") == F.col("g.gid"))
    )
    level = (
        F.when(F.col("gid") == 0, F.lit("paper")).when(F.col("gid") == 2, F.lit("class")).otherwise(F.lit("corpus"))
    )
    return (
        asked.alias("a")
        .join(got.alias("g"), same, "full")
        .select(
            F.coalesce("a.gid", "g.gid").alias("gid"),
            F.coalesce("a.doc_id", "g.doc_id").alias("doc_id"),
            F.coalesce("a.result_class", "g.result_class").alias("result_class"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("input_claims", "count", "passed", "failed")],
            "avg_confidence",
        )
        .select(level.alias("level"), "doc_id", "result_class", "input_claims", "count", "passed", "failed", "avg_confidence")
    )


def cost_columns(
    input_price: float = K.INPUT_PRICE_PER_MILLION, output_price: float = K.OUTPUT_PRICE_PER_MILLION
) -> list[Column]:
    tokens_in, tokens_out = F.sum("input_tokens"), F.sum("output_tokens")
    cost_in = tokens_in / F.lit(1_000_000) * F.lit(input_price)
    cost_out = tokens_out / F.lit(1_000_000) * F.lit(output_price)
    return [
        tokens_in.alias("input_tokens"),
        tokens_out.alias("output_tokens"),
        (tokens_in + tokens_out).alias("total_tokens"),
        cost_in.alias("input_cost"),
        cost_out.alias("output_cost"),
        (cost_in + cost_out).alias("total_cost"),
    ]


def token_cost(usage: DataFrame, by: list[str] | None = None) -> DataFrame:
    return usage.groupBy(*(by or [])).agg(*cost_columns())


def task_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(K.TASKS),
        "task string, model string, strength string, cost_tier string, temperature double, "
        "daily_budget_usd double, escalate_to string, escalate_if_confidence_below double",
    )


def task_routing(calls: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Calls with model and temperature of their task; unknown tasks use ``generic``.

    A ``temperature_override`` of the call wins over the table.
    """
    config = config if config is not None else task_table(calls.sparkSession)
    known = config.select("task").withColumn("config_task", F.col("task"))
    settings = config.withColumnRenamed("task", "config_task")
    routed = (
        calls.join(known, "task", "left")
        .withColumn("config_task", F.coalesce("config_task", F.lit("generic")))
        .join(settings, "config_task", "left")
    )
    if "temperature_override" in calls.columns:
        routed = routed.withColumn("temperature", F.coalesce("temperature_override", "temperature"))
    return routed


def transient_error(errors: DataFrame, message: str = "error") -> DataFrame:
    """Whether a failed call is worth another try."""
    code = F.element_at(F.split(strip(F.col(message)), K.SPACE + "+"), 1)
    return errors.withColumn(
        "is_transient",
        F.coalesce(code.isin(*K.RETRYABLE_CODES) | contains_any(F.col(message), K.RETRYABLE_WORDS), F.lit(False)),
    )


def manifest_current(events: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Appended manifest records with the deletion that belongs to each.

    ``events``: ``doc_id, citation_id, seq, kind ('append' or 'delete'), at``. A
    deletion stamps the newest record of its citation that is not yet deleted;
    with none left it does nothing. Records and deletions pair up like brackets:
    the deletion of a record is the next event on the record's own level.

    Levels and pairs are found inside buckets of ``seq`` and carried over from
    bucket to bucket, so the history of one citation is not one task's work.
    ``bucket`` must not decrease with ``seq``.
    """
    keys = ["doc_id", "citation_id"]
    in_bucket = W.partitionBy(*keys, "bucket").orderBy("seq")
    earlier = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    step = F.when(F.col("kind") == "append", F.lit(1)).otherwise(F.lit(-1))

    bucketed = events.withColumn("bucket", F.floor(F.col("seq") / SEQ_BUCKET) if bucket is None else bucket)
    local = by_key(bucketed, *keys, "bucket", times=4).withColumn("run", F.sum(step).over(in_bucket))
    whole = W.partitionBy(*keys).orderBy("bucket")
    sums = (
        local.groupBy(*keys, "bucket")
        .agg(F.max_by("run", "seq").alias("net"), F.min("run").alias("low"))
        .withColumn("start", F.coalesce(F.sum("net").over(earlier), F.lit(0)))
        .withColumn("low_before", F.least(F.lit(0), F.min(F.col("start") + F.col("low")).over(earlier)))
        .withColumn("several", F.lag(F.lit(1)).over(whole).isNotNull() | F.lead(F.lit(1)).over(whole).isNotNull())
        .select(*keys, "bucket", "start", "low_before", "several")
    )
    lowest = F.min("run").over(in_bucket.rowsBetween(W.unboundedPreceding, -1))
    leveled = (
        local.withColumn("lowest", lowest)
        .join(by_key(sums, *keys, "bucket", times=4), [*keys, "bucket"])
        .withColumn("balance", F.col("start") + F.col("run"))
        .withColumn("floor", F.least("low_before", F.col("start") + F.col("lowest")))
        # A deletion that falls below everything before it finds no record.
        .where((F.col("kind") == "append") | (F.col("balance") >= F.col("floor")))
        .withColumn("level", F.col("balance") - F.col("floor") + F.when(F.col("kind") == "append", 0).otherwise(1))
    )

    event = F.struct("kind", "at")
    on_level = W.partitionBy(*keys, "level", "bucket").orderBy("seq")
    # Only citations of more than one bucket carry anything.
    firsts = (
        leveled.where("several").groupBy(*keys, "level", "bucket")
        .agg(F.min_by(event, "seq").alias("first"))
        .withColumn("carried", F.lead("first").over(W.partitionBy(*keys, "level").orderBy("bucket")))
        .drop("first")
    )
    following = F.coalesce(F.col("following"), F.col("carried"))
    return (
        by_key(leveled, *keys, "level", "bucket", times=4).withColumn("following", F.lead(event).over(on_level))
        .where(F.col("kind") == "append")
        .join(firsts, [*keys, "level", "bucket"], "left")
        .select(
            *keys, "seq", F.col("at").alias("appended_at"),
            F.when(following["kind"] == "delete", following["at"]).alias("deleted_at"),
        )
    )


def manifest_counts(current: DataFrame) -> DataFrame:
    return current.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("deleted_at").isNull()).alias("n_live")
    )


def run_layout(runs: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Run folder names taken apart at the last ``__``; names without it go to the rejects."""
    good = F.contains(F.col(name), F.lit("__"))
    parsed = runs.where(good).withColumns(
        {
            "stem": F.regexp_extract(name, r"(?s)^(.*)__(.*)$", 1),
            "timestamp": F.regexp_extract(name, r"(?s)^(.*)__(.*)$", 2),
        }
    )
    reason = F.concat(F.lit("Run directory name '"), F.col(name), F.lit("' does not match the expected format"))
    return parsed, runs.where(~good).withColumn("reject_reason", reason)


def run_name(stem: Column, at: Column) -> Column:
    return F.concat(stem, F.lit("__"), F.date_format(at, "yyyyMMdd_HHmmss"))
