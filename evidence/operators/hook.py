"""The one place where user-supplied Python scores rows: the model hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence.session import materialize

#: Types whose equal values, and no others, have one digest.
PLAIN = (T.StringType, T.IntegralType, T.BooleanType)
ACCOUNTING = "input_tokens bigint, output_tokens bigint, error string"


def score(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    input_cols: list[str],
    out_schema: str,
    task: str = "generic",
    keep_once: bool = True,
    cache: str | None = None,
    version: str = "1",
) -> DataFrame:
    """Add the columns of ``out_schema`` computed by ``fn`` from ``input_cols``.

    Each distinct input is scored once and joined back, so repeated texts cost
    one call. ``fn`` takes and returns a pandas frame with equal row counts; it
    may also return ``input_tokens``, ``output_tokens`` and ``error``. When a
    batch raises, its rows are tried one by one and only the failing rows get
    null outputs and an ``error``. ``keep_once`` writes the answers to the
    shared folder, so that neither a second use of the result nor a lost
    executor asks the model again; without it every action does.

    ``cache`` is a folder in shared storage that keeps answers between runs, by
    the digest of the inputs, under the task and the ``version`` of the model.
    Inputs found there are not asked; new answers are appended, failed ones are
    not kept, so a later run asks those again. Tokens of answers found there are
    0 in this run. Two runs at once may both ask an
    input; one of the answers is then used from there on.
    """
    inputs = df.select(*input_cols).distinct()
    wanted = T.StructType.fromDDL(out_schema)
    extra = T.StructType([f for f in T.StructType.fromDDL(ACCOUNTING) if f.name not in wanted.names])
    schema = T.StructType([*inputs.schema.fields, *wanted.fields, *extra.fields])
    names = [f.name for f in schema.fields]
    outputs = names[len(input_cols):]

    def one_batch(batch: pd.DataFrame) -> pd.DataFrame:
        answer = fn(batch.copy())
        answer.index = batch.index
        result = batch.copy()
        for name in outputs:
            result[name] = answer[name] if name in answer else None
        return result[names]

    def failed(row: pd.DataFrame, exc: Exception) -> pd.DataFrame:
        result = row.copy()
        for name in outputs:
            result[name] = None
        result["error"] = str(exc) or type(exc).__name__
        return result[names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield one_batch(batch)
            except Exception:
                for i in range(len(batch)):
                    row = batch.iloc[i : i + 1]
                    try:
                        yield one_batch(row)
                    except Exception as exc:
                        yield failed(row, exc)

    plain = all(isinstance(f.dataType, PLAIN) for f in inputs.schema.fields)
    if cache:
        kept = ["_digest", *outputs] if plain else names
        answers = _through_cache(inputs, lambda part: part.mapInPandas(run, schema), schema, f"{cache.rstrip('/')}/task={task}/version={version}", kept, df.select(*input_cols))
        answers = answers.withColumn("task", F.lit(task))
    else:
        answers = inputs.mapInPandas(run, schema).withColumn("task", F.lit(task))
    if keep_once and not cache:
        answers = materialize(answers, "answers")
    condition = None
    left, right = df.alias("l"), answers.alias("r")
    if cache and plain:  # by digest: neither side of the join carries inputs that nobody asks for
        left = left.select(F.struct("l.*").alias("_row"), _digest(input_cols).alias("_asked"))
        joined = left.join(right, F.col("_asked") == F.col("r._digest"), "inner")
        return joined.select(*[F.col("_row")[c].alias(c) for c in df.columns], *[F.col(f"r.{n}") for n in outputs], "r.task")
    for c in input_cols:
        same = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        condition = same if condition is None else condition & same
    return left.join(right, condition, "inner").select("l.*", *[F.col(f"r.{n}") for n in outputs], "r.task")


def _digest(inputs: list) -> Column:
    return F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256)


def _through_cache(
    inputs: DataFrame, ask: Callable[[DataFrame], DataFrame], schema: T.StructType, folder: str, kept: list[str], rows: DataFrame
) -> DataFrame:
    """Answers of ``inputs``, the distinct ``rows`` (columns ``kept``): those of the folder, else asked now and, unless they failed, appended to it."""
    spark = inputs.sparkSession
    stored = T.StructType([T.StructField("_digest", T.StringType()), *schema.fields])
    spark.createDataFrame([], stored).write.mode("ignore").parquet(folder)  # the folder exists from here on
    digest = _digest(inputs.columns)
    keyed = inputs.withColumn("_digest", digest)
    before = spark.read.schema(stored).parquet(folder).dropDuplicates(["_digest"])
    # Both sides are large in the long run: Spark prunes the cache with a bloom filter of the asked digests.
    known = materialize(before.join(rows.select(digest.alias("_digest")).distinct(), "_digest", "left_semi").select("_digest", *(c for c in kept if c != "_digest")), "known")
    fresh = ask(keyed.join(known.select("_digest"), "_digest", "left_anti").drop("_digest"))
    asked = materialize(fresh.withColumn("_digest", digest), "answers")
    asked.where(F.col("error").isNull()).select(*stored.names).write.mode("append").parquet(folder)
    spent = {c: F.lit(0).cast("bigint") for c in ("input_tokens", "output_tokens")}
    return known.withColumns(spent).select(*kept).unionByName(asked.select(*kept))


def usage_of(scored: DataFrame, input_cols: list[str]) -> DataFrame:
    """Token usage of a scored table, counted once per distinct input."""
    return (
        scored.select(*input_cols, "task", "input_tokens", "output_tokens")
        .distinct()
        .select(
            "task",
            F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
            F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
        )
    )
