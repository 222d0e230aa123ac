"""Sinks and streams: written to the shared folder, read back."""

from pyspark.sql import functions as F

from catalog.claims import citations, mapped, routed
from catalog.core import oracle
from catalog.checks import results
from catalog.sources import MANIFEST_SQL, batch_claims, manifest_events
from evidence import schemas as S
from evidence.operators import fetch, reporting
from evidence.session import materialize, scratch_dir
from evidence.sources import files
from evidence.streaming import streams

CLAIM_COLUMNS = ["doc_id", "claim_id", "text", "claim_type", "citation_found", "citation_id", "citation_text"]


def written_claims(i):
    claims, book = materialize(mapped(i), "mapped"), citations(i)
    path = scratch_dir(i.spark, "claims")
    files.write_claims(claims, book, path, "20240101_000000")
    back, _ = files.read_claims(i.spark, path)
    return back.select(*CLAIM_COLUMNS, F.col("citation_details.year").alias("year"), "run_ts")


def loaded_claims(i):
    """Claims of each document stored as one JSON object per line, then parsed."""
    claims = mapped(i)
    text = claims.select(
        "doc_id",
        F.to_json(F.struct(
            F.array(files.claim_struct(claims)).alias("claims"),
            F.create_map(F.coalesce("citation_id", F.lit("-")), F.coalesce("raw_citation_text", F.lit(""))).alias("citations"),
        )).alias("value"),
    )
    back, _ = files.parse_claims_json(text)
    return back.select(*CLAIM_COLUMNS, "is_original")


def results_by_class(i):
    path = scratch_dir(i.spark, "results")
    files.write_results_by_class(results(i), path)
    back = i.spark.read.schema("doc_id bigint, claim_id string, passed boolean, confidence double, result_class string").json(path)
    return back.select("doc_id", "claim_id", "passed", "confidence", "result_class")


def class_outputs(i):
    """Claims of order lines by class: cited ones stored in batches of their source, read back with their results."""
    path = scratch_dir(i.spark, "classes")
    claims = batch_claims(i).withColumn("result_class", F.concat("claim_type", F.lit("_cited")))
    tried = i.stored("attempts")
    got = materialize(fetch.first_success(tried), "outcome")
    made = materialize(fetch.citation_batch(batch_claims(i), got), "batches")
    results = materialize(fetch.fail_batch(batch_claims(i), made, "rag_search", "text source"), "failed").withColumn("result_class", F.concat("claim_type", F.lit("_cited")))
    loose = results.withColumns({"citation_id": F.lit(None).cast("string"), "result_class": F.concat("claim_type", F.lit("_uncited"))})
    attempts = materialize(fetch.attempts_made(tried, got), "made")
    files.write_class_outputs(claims, results.unionByName(loose), got, attempts, path)
    shape = ("doc_id bigint, batch struct<citation_id:string,download_successful:boolean,"
             "resolution_attempts:array<struct<url:string>>,claim_results:array<struct<claim_id:string>>>, result_class string")
    batches = i.spark.read.schema(shape).json(f"{path}/batches").groupBy("result_class", "doc_id", "batch.citation_id").agg(
        F.bool_or("batch.download_successful").alias("downloaded"), F.sum(F.size("batch.claim_results")).alias("n_results"),
        F.sum(F.size("batch.resolution_attempts")).alias("n_attempts"))
    rows = i.spark.read.schema("doc_id bigint, claim_id string, result_class string").json(f"{path}/claims")
    return batches.unionByName(rows.groupBy("result_class", "doc_id").agg(F.count(F.lit(1)).alias("n_results")), allowMissingColumns=True)


def claim_files(i):
    """Claims of each document written to files of their own, found and read by the loader."""
    path = scratch_dir(i.spark, "claim-files")
    files.write_claim_files(materialize(mapped(i), "mapped"), path)
    back, _ = files.load_claims(i.spark, path)
    return back.select(F.regexp_extract("file", r"doc_id=(\d+)", 1).cast("bigint").alias("doc_id"), *CLAIM_COLUMNS[1:], "is_original")


def appended_manifest(i):
    path = scratch_dir(i.spark, "manifest")
    events = manifest_events(i)
    files.manifest_append(events.where(F.col("kind") == "append"), path)
    files.manifest_append(events.where(F.col("kind") == "delete"), path)
    return i.spark.read.parquet(path).groupBy("doc_id", "citation_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def tabular(i):
    """The parts written as CSV, loaded by their sniffed format."""
    path = scratch_dir(i.spark, "csv")
    i.table("part").write.option("header", True).csv(path)
    table = files.load_tabular(i.spark, path, "csv")
    return table.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("avg_price"), F.max("p_size").alias("max_size"))


def mixed_files(i):
    """The parts in four forms, with records that do not parse and pages among them, loaded by what each file holds."""
    path = scratch_dir(i.spark, "mixed")
    part = i.table("part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    form = F.pmod("p_partkey", F.lit(4))
    part.where(form == 0).write.option("header", True).csv(f"{path}/a")
    part.where(form == 1).select("p_retailprice", "p_type", "p_partkey", "p_size").write.option("header", True).csv(f"{path}/b")
    lines = part.where(form == 2).select(F.to_json(F.struct("*")).alias("value"))
    broken = part.where((form == 2) & (F.col("p_size") % 10 == 0)).select(F.concat(F.lit('{"p_partkey": '), "p_type").alias("value"))
    lines.unionByName(broken).write.text(f"{path}/c.json")
    blocks = part.where(form == 3).groupBy(F.floor(F.col("p_partkey") / 5000).alias("block")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.to_json(F.struct("p_partkey", "p_type", "p_size", "p_retailprice"))), ",\n"), F.lit("\n]")).alias("value"))
    blocks.repartition("block").write.partitionBy("block").text(f"{path}/d")
    i.table("pages").select(F.concat(F.lit("<html>"), "html").alias("value")).write.text(f"{path}/e")
    rows, rejects = files.load_tabular_files(i.spark, path, "p_partkey bigint, p_type string, p_size int, p_retailprice double")
    loaded = rows.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("avg_price"), F.max("p_size").cast("bigint").alias("max_size"))
    lost = rejects.groupBy("error").agg(F.count("record").alias("n")).select(
        F.col("error").alias("p_type"), "n", F.lit(None).cast("double").alias("avg_price"), F.lit(None).cast("bigint").alias("max_size"))
    return loaded.unionByName(lost)


def _stream(i, name, schema):
    return streams.read_stream(i.spark, i.folder, f"{name}.parquet", schema)


def _run(i, stream, mode="append"):
    path, checkpoint = scratch_dir(i.spark, "stream"), scratch_dir(i.spark, "progress")
    streams.run_to_table(stream, path, checkpoint, mode)
    return i.spark.read.parquet(path)


def routed_stream(i):
    """Documents as arriving claims, routed without state."""
    docs = _stream(i, "documents", "doc_id bigint, text string, lang string, source string, n_chars bigint")
    claims = docs.select(
        "doc_id", F.when(F.col("text").rlike(r"\p{Nd}"), F.lit("quantitative")).otherwise(F.lit("qualitative")).alias("claim_type"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("citation_id"))
    return _run(i, streams.stream_route(claims))


def usage_stream(i):
    e = _stream(i, "events", S.EVENTS)
    return e.select(
        "ts", F.concat(F.lit("task_"), "event_type").alias("task"), F.floor(F.abs("value") * 100).alias("input_tokens"),
        F.floor(F.abs("value") * 20).alias("output_tokens"))


def cost_stream(i, **window):
    done = _run(i, streams.stream_token_cost(usage_stream(i), **window), "complete")
    return done.withColumn("total_cost", F.round("total_cost", 8))


def manifest_stream(i):
    """Manifest events streamed into a table; the current state is a batch view of it."""
    source, path = scratch_dir(i.spark, "events"), scratch_dir(i.spark, "manifest")
    manifest_events(i).write.parquet(source)
    stream = streams.read_stream(i.spark, source, "*.parquet", "doc_id bigint, citation_id string, seq bigint, kind string, at timestamp")
    streams.stream_manifest(stream, path, scratch_dir(i.spark, "progress")).awaitTermination()
    return reporting.manifest_counts(reporting.manifest_current(i.spark.read.parquet(path)))


def manifest_state_stream(i):
    """Manifest events in four micro-batches, deletions often in a later one than their record; state keeps them."""
    source, path = scratch_dir(i.spark, "events"), scratch_dir(i.spark, "manifest")
    events = manifest_events(i)
    for low, high in ((0, 20), (20, 31), (31, 42), (42, 1 << 40)):
        # All events of a citation in one file, so a micro-batch holds them together.
        some = events.where((F.col("seq") >= low) & (F.col("seq") < high))
        some.repartition("doc_id", "citation_id").write.mode("append").parquet(source)
    most = int(i.spark.conf.get("spark.sql.shuffle.partitions"))
    stream = streams.read_stream(i.spark, source, "*.parquet", "doc_id bigint, citation_id string, seq bigint, kind string, at timestamp", most)
    streams.manifest_state_to_table(stream, path, scratch_dir(i.spark, "progress"))
    return streams.read_manifest_state(i.spark, path)


def parse_once_stream(i):
    """Distinct props of all events, each let through once."""
    e = _stream(i, "events", S.EVENTS).select("ts", F.col("props").alias("raw_text"))
    return _run(i, streams.stream_parse_once(e, "60 days")).select("raw_text")


_COST = """SELECT {start} AS window_start, {start} + INTERVAL {length} AS window_end, task, cast(sum(input_tokens) AS bigint) AS input_tokens, cast(sum(output_tokens) AS bigint) AS output_tokens,
 round(sum(input_tokens) / 1e6 * 0.1 + sum(output_tokens) / 1e6 * 0.4, 8) AS total_cost FROM {source} GROUP BY 1, 2, 3"""

QUERIES = {
    "write_claims": (
        written_claims,
        oracle(
            """SELECT doc_id, claim_id, text, claim_type, citation_text IS NOT NULL AS citation_found, citation_id, citation_text,
 try_cast(nullif(regexp_extract(raw_citation_text, '([0-9]{4})', 1), '') AS bigint) AS year, '20240101_000000' AS run_ts FROM claims""",
            "claims",
        ),
    ),
    "load_claims": (
        loaded_claims,
        oracle("SELECT doc_id, claim_id, text, claim_type, citation_text IS NOT NULL AS citation_found, citation_id, citation_text, false AS is_original FROM claims", "claims"),
    ),
    "write_results_by_class": (
        results_by_class, oracle("SELECT doc_id, claim_id, passed, confidence, result_class FROM results", "results")),
    "write_class_outputs": (
        class_outputs,
        oracle(
            """, lines AS (SELECT l_orderkey AS doc_id, concat('', l_suppkey % 4) AS citation_id, CASE WHEN l_quantity > 25 THEN 'quantitative' ELSE 'qualitative' END AS claim_type FROM lineitem),
 held AS (SELECT c.*, downloaded FROM lines c JOIN batches b ON b.doc_id = c.doc_id AND b.citation_id = c.citation_id)
SELECT claim_type || '_cited' AS result_class, h.doc_id, h.citation_id, downloaded, cast(count(*) FILTER (WHERE NOT downloaded) AS bigint) AS n_results, cast(coalesce(any_value(n), 0) AS bigint) AS n_attempts
 FROM held h LEFT JOIN (SELECT doc_id, citation_id, count(*) AS n FROM made GROUP BY ALL) m ON m.doc_id = h.doc_id AND m.citation_id = h.citation_id GROUP BY claim_type, h.doc_id, h.citation_id, downloaded
 HAVING count(*) FILTER (WHERE NOT downloaded) > 0 OR any_value(n) > 0
UNION ALL SELECT claim_type || '_uncited', doc_id, NULL, NULL, count(*), NULL FROM held WHERE NOT downloaded GROUP BY claim_type, doc_id""".replace(", lines AS", "@, lines AS", 1),
            "batches", "made",
        ).replace(" @", ""),
    ),
    "load_claims_files": (
        claim_files,
        oracle("SELECT doc_id, claim_id, text, claim_type, citation_text IS NOT NULL AS citation_found, citation_id, citation_text, false AS is_original FROM claims", "claims"),
    ),
    "manifest_append": (
        appended_manifest,
        oracle(
            """SELECT doc_id, citation_id, kind, count(*) AS n, cast(max(seq) AS bigint) AS last_seq FROM (
 SELECT doc_id, citation_id, attempt_no * 10 AS seq, 'append' AS kind FROM attempts UNION ALL SELECT doc_id, citation_id, attempt_no * 10 + 1, 'delete' FROM attempts WHERE downloaded
 UNION ALL SELECT doc_id, citation_id, attempt_no * 10 + 2, 'delete' FROM attempts WHERE downloaded AND attempt_no % 2 = 0) GROUP BY doc_id, citation_id, kind""",
            "attempts",
        ),
    ),
    "load_tabular": (
        tabular,
        "SELECT p_type, count(*) AS n, round(avg(p_retailprice), 4) AS avg_price, cast(max(p_size) AS bigint) AS max_size FROM part GROUP BY p_type",
    ),
    "load_tabular_files": (
        mixed_files,
        """SELECT p_type, count(*) AS n, round(avg(p_retailprice), 4) AS avg_price, cast(max(p_size) AS bigint) AS max_size FROM part GROUP BY p_type
 UNION ALL SELECT 'Record is not a row of the schema', count(*), NULL, NULL FROM part WHERE p_partkey % 4 = 2 AND p_size % 10 = 0 HAVING count(*) > 0
 UNION ALL SELECT 'URL is not tabular data (detected: text/html)', 0, NULL, NULL FROM pages HAVING count(*) > 0""",
    ),
    "stream_route": (
        routed_stream,
        """SELECT doc_id, claim_type, citation_id, claim_type || CASE WHEN citation_id IS NULL THEN '_uncited' ELSE '_cited' END AS result_class FROM (
 SELECT doc_id, CASE WHEN regexp_matches(text, '\\p{Nd}') THEN 'quantitative' ELSE 'qualitative' END AS claim_type, CASE WHEN doc_id % 3 = 0 THEN source END AS citation_id FROM documents)""",
    ),
    "stream_token_cost": (
        lambda i: cost_stream(i),
        oracle(_COST.format(start="date_trunc('day', ts)", length="1 DAY", source="usage"), "usage"),
    ),
    "stream_token_cost_sliding": (
        lambda i: cost_stream(i, length="1 day", slide="6 hours"),
        oracle(
            _COST.format(
                start="w", length="1 DAY",
                source="(SELECT *, time_bucket(INTERVAL 6 HOURS, ts) - to_hours(6 * k) AS w FROM usage, (SELECT unnest(range(4)) AS k))"),
            "usage",
        ),
    ),
    "stream_token_cost_session": (
        lambda i: cost_stream(i, gap="10 minutes"),
        oracle(
            """SELECT min(ts) AS window_start, max(ts) + INTERVAL 10 MINUTES AS window_end, task, cast(sum(input_tokens) AS bigint) AS input_tokens, cast(sum(output_tokens) AS bigint) AS output_tokens,
 round(sum(input_tokens) / 1e6 * 0.1 + sum(output_tokens) / 1e6 * 0.4, 8) AS total_cost FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY task ORDER BY ts, event_id) AS session FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY task ORDER BY ts, event_id) <= INTERVAL 10 MINUTES THEN 0 ELSE 1 END AS fresh FROM usage)) GROUP BY task, session""",
            "usage",
        ),
    ),
    "stream_manifest": (
        manifest_stream,
        oracle("@", "attempts").replace(
            " @", MANIFEST_SQL.replace("SELECT doc_id, citation_id, seq, epoch_ms", ", state AS (SELECT doc_id, citation_id, seq, epoch_ms")
        ) + ") SELECT doc_id, count(*) AS count, count(*) FILTER (WHERE deleted_at IS NULL) AS n_live FROM state GROUP BY doc_id",
    ),
    "stream_manifest_state": (
        manifest_state_stream,
        oracle("@", "attempts").replace(" @", MANIFEST_SQL),
    ),
    "stream_parse_once": (parse_once_stream, "SELECT DISTINCT props AS raw_text FROM events"),
}
