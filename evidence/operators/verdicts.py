"""Verdicts: claims against evidence, claims against data, and the result rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence import constants as K
from evidence.functions.text import is_json, strip
from evidence.operators.hook import score

EMPTY = "array<string>"


def grounded_verdict(outcome: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rule verdict: the claim holds when its best chunk is at least this similar."""
    has_evidence = F.col("outcome") == "evidence"
    passed = has_evidence & (F.round("best_score", 9) >= threshold)
    return outcome.withColumns(
        {
            "passed": passed,
            "confidence": F.when(has_evidence, F.least("best_score", F.lit(1.0))).otherwise(F.lit(0.0)),
            "explanation": F.when(
                has_evidence,
                F.format_string("Best excerpt has similarity %.2f with the claim", F.col("best_score")),
            ).otherwise(F.col("explanation")),
            "supporting_quotes": F.when(passed, F.array("best_chunk")).otherwise(F.array().cast(EMPTY)),
        }
    )


def grounded_verdict_model(outcome: DataFrame, claims: DataFrame, model: Callable) -> DataFrame:
    """Model verdict on the retrieved excerpts; pairs without evidence never reach the model."""
    ready = outcome.where(F.col("outcome") == "evidence").join(claims, "claim_key")
    asked = score(
        ready.drop("explanation", "error"),
        model,
        ["claim_text", "excerpts"],
        "passed boolean, confidence double, explanation string, supporting_quotes array<string>",
        task="source_grounded_verification",
    )
    failed = F.col("error").isNotNull()
    judged = asked.select(
        "claim_key", "source_key", "outcome", "best_score",
        F.coalesce("passed", F.lit(False)).alias("passed"),
        F.when(failed, F.lit(0.0)).otherwise(F.coalesce("confidence", F.lit(K.DEFAULT_MODEL_CONFIDENCE))).alias("confidence"),
        F.when(failed, F.concat(F.lit("LLM verification failed: "), "error"))
        .otherwise(F.coalesce("explanation", F.lit("No explanation provided"))).alias("explanation"),
        F.coalesce("supporting_quotes", F.array().cast(EMPTY)).alias("supporting_quotes"),
        "error",
    )
    rest = outcome.where(F.col("outcome") != "evidence").select(
        "claim_key", "source_key", "outcome", "best_score",
        F.lit(False).alias("passed"), F.lit(0.0).alias("confidence"), "explanation",
        F.array().cast(EMPTY).alias("supporting_quotes"), "error",
    )
    return judged.unionByName(rest)


def qualitative_result(claims: DataFrame, verdicts: DataFrame, plausible: DataFrame) -> DataFrame:
    """Result rows of claims judged on text.

    With a verdict on a source the method is ``rag_search``; without source
    text the plausibility of the claim decides (``llm_check``).
    """
    grounded = F.col("outcome").isNotNull()
    v = verdicts.select(
        "doc_id", "claim_id", "outcome",
        F.col("passed").alias("v_passed"), F.col("confidence").alias("v_confidence"),
        F.col("explanation").alias("v_explanation"), F.col("supporting_quotes"), F.col("error").alias("v_error"),
    )
    p = plausible.select("doc_id", "claim_id", "plausible", "plausible_confidence", "reasoning")
    uncited = (
        F.coalesce("originally_uncited", F.lit(False)) if "originally_uncited" in claims.columns else F.lit(False)
    )
    return (
        claims.join(v, ["doc_id", "claim_id"], "left")
        .join(p, ["doc_id", "claim_id"], "left")
        .select(
            "doc_id", "claim_id", "claim_type",
            uncited.alias("originally_uncited"),
            (~grounded | F.col("v_error").isNull()).alias("validated"),
            F.when(grounded, F.lit("rag_search")).otherwise(F.lit("llm_check")).alias("validation_method"),
            F.when(grounded, F.col("v_passed")).otherwise(F.coalesce("plausible", F.lit(False))).alias("passed"),
            F.when(grounded, F.col("v_confidence"))
            .otherwise(F.coalesce("plausible_confidence", F.lit(K.DEFAULT_MODEL_CONFIDENCE))).alias("confidence"),
            F.when(grounded, F.col("v_explanation"))
            .otherwise(F.coalesce("reasoning", F.lit("No reasoning provided"))).alias("explanation"),
            F.when(grounded, F.col("supporting_quotes")).otherwise(F.array().cast(EMPTY)).alias("sources_used"),
            F.when(grounded, F.col("v_error")).alias("errors"),
        )
    )


def column_statistics(dataset: DataFrame, columns: list[str], filters: list[str], distinct: list[str] = ()) -> DataFrame:
    """count, sum, avg, min, max of numeric columns, overall and per value of each filter column.

    One scan with grouping sets: the plan grows with the schema, never with the
    number of claims. Returns ``filter_col, filter_val, column, agg, value``;
    overall rows have a null filter.
    """
    spread = [("count", F.count), ("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max)]
    aggs = [f(c).cast("double").alias(f"{name}|{c}") for c in columns for name, f in spread]
    aggs += [F.count_distinct(c).cast("double").alias(f"n_distinct|{c}") for c in distinct]
    flags = [F.grouping(f).alias(f"all|{f}") for f in filters]
    if filters:
        sets = [[F.col(f)] for f in filters] + [[]]
        grouped = dataset.groupingSets(sets, *[F.col(f) for f in filters]).agg(*aggs, *flags)
        filter_col = F.coalesce(*[F.when(F.col(f"`all|{f}`") == 0, F.lit(f)) for f in filters])
        filter_val = F.coalesce(*[F.when(F.col(f"`all|{f}`") == 0, F.col(f).cast("string")) for f in filters])
    else:
        grouped = dataset.agg(*aggs)
        filter_col = filter_val = F.lit(None).cast("string")
    names = [f"{name}|{c}" for c in columns for name, _ in spread] + [f"n_distinct|{c}" for c in distinct]
    measured = F.array(
        *[
            F.struct(
                F.lit(n.split("|")[1]).alias("column"), F.lit(n.split("|")[0]).alias("agg"), F.col(f"`{n}`").alias("value")
            )
            for n in names
        ]
    )
    return grouped.select(
        filter_col.alias("filter_col"), filter_val.alias("filter_val"), F.explode(measured).alias("_measured")
    ).select("filter_col", "filter_val", "_measured.*")


def quant_check(specs: DataFrame, statistics: DataFrame) -> DataFrame:
    """Numeric claims against measured values.

    ``specs``: ``claim_id, dataset, agg, column, filter_col, filter_val,
    comparator, expected, tolerance`` and for relative claims ``base_val``, the
    filter value to compare with. ``statistics``: ``column_statistics`` plus
    ``dataset``. Comparators: ``eq``, ``gt``, ``lt``, ``pct_change``, ``ratio``.
    """
    keys = ["dataset", "column", "agg"]
    stats = statistics.select(*keys, F.coalesce("filter_col", F.lit("")).alias("_col"),
                              F.coalesce("filter_val", F.lit("")).alias("_val"), "value")
    base = "base_val" in specs.columns
    wanted = (specs if base else specs.withColumn("base_val", F.lit(None).cast("string"))).withColumns(
        {"_col": F.coalesce("filter_col", F.lit("")), "_val": F.coalesce("filter_val", F.lit(""))}
    )
    measured = (
        wanted.join(stats, [*keys, "_col", "_val"], "left")
        .withColumnRenamed("value", "actual")
        .join(
            stats.withColumnsRenamed({"_val": "base_val", "value": "base"}), [*keys, "_col", "base_val"], "left"
        )
    )
    comparator, expected = F.col("comparator"), F.col("expected")
    observed = (
        F.when(comparator == "pct_change", (F.col("actual") - F.col("base")) / F.nullif("base", F.lit(0.0)) * 100)
        .when(comparator == "ratio", F.col("actual") / F.nullif("base", F.lit(0.0)))
        .otherwise(F.col("actual"))
    )
    near = F.abs(F.col("observed") - expected) <= F.col("tolerance")
    passed = (
        F.when(comparator == "gt", F.col("observed") > expected)
        .when(comparator == "lt", F.col("observed") < expected)
        .otherwise(near)
    )
    return measured.withColumn("observed", observed).select(
        "claim_id",
        "dataset",
        F.col("observed"),
        F.col("observed").isNotNull().alias("validated"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        F.when(F.col("observed").isNull(), F.lit(0.0)).otherwise(F.lit(1.0)).alias("confidence"),
        F.when(F.col("observed").isNull(), F.lit("No data for this claim"))
        .otherwise(
            F.format_string(
                "%s of %s is %.4f, claim says %s %.4f", "agg", "column", F.round("observed", 4), "comparator", "expected"
            )
        ).alias("explanation"),
        F.when(F.col("observed").isNull(), F.lit("No matching rows in dataset")).alias("error"),
    )


def parse_verdict_text(outputs: DataFrame, text: str = "output") -> DataFrame:
    """Verdicts printed among other output: the text from the first ``{`` to the last ``}``."""
    raw = strip(F.col(text))
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "passed boolean, confidence double, explanation string")
    ok = (body != "") & is_json(body)
    problem = F.when(~F.contains(raw, F.lit("{")), F.lit("No JSON output found")).otherwise(F.lit("Invalid JSON"))
    return outputs.withColumn("_p", parsed).withColumn("validated", F.coalesce(ok, F.lit(False))).select(
        *[F.col(c) for c in outputs.columns if c != text],
        "validated",
        (F.col("validated") & F.coalesce("_p.passed", F.lit(False))).alias("passed"),
        F.when(F.col("validated"), F.coalesce("_p.confidence", F.lit(K.DEFAULT_MODEL_CONFIDENCE)))
        .otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("validated"), F.coalesce("_p.explanation", F.lit("No explanation provided")))
        .otherwise(F.lit("Failed to parse script output")).alias("explanation"),
        F.when(~F.col("validated"), F.concat(F.lit("Parse error: "), problem, F.lit(". Output: "), F.col(text))).alias("error"),
    )


def quantitative_result(claims: DataFrame, checks: DataFrame, method: str = "table_check") -> DataFrame:
    """Result rows of claims checked on data, one for each claim; ``checks`` has at most one row per claim.

    A claim without a check is a failed result that says so.
    """
    keys = [c for c in ("doc_id", "claim_id") if c in checks.columns and c in claims.columns]
    uncited = (
        F.coalesce("originally_uncited", F.lit(False)) if "originally_uncited" in claims.columns else F.lit(False)
    )
    missing = F.col("_checked").isNull()
    sources = F.when(missing, F.array().cast("array<string>")).otherwise(F.array("dataset"))
    return claims.join(checks.withColumn("_checked", F.lit(True)), keys, "left").select(
        *keys, "claim_type", uncited.alias("originally_uncited"), F.coalesce("validated", F.lit(False)).alias("validated"),
        F.lit(method).alias("validation_method"), F.when(missing, F.lit(False)).otherwise(F.col("passed")).alias("passed"),
        F.when(missing, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"), "explanation",
        sources.alias("sources_used"), F.when(missing, F.lit("No check for this claim")).otherwise(F.col("error")).alias("errors"),
    )


def valid_confidence() -> Column:
    return F.col("confidence").between(0.0, 1.0)
