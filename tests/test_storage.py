"""Files, payloads, pages and streams."""

import json

import pandas as pd
from pyspark.sql import functions as F

from evidence.operators import discovery, fetch, reporting
from evidence.sources import files, html
from evidence.streaming import streams


def test_load_claims_file(spark, tmp_path):
    doc = {
        "claims": [
            {"claim_id": "claim_0_0", "text": "t", "claim_type": "qualitative", "citation_found": True, "citation_id": "1", "citation_text": "[1]",
             "citation_details": {"year": 2020, "raw_text": "R"}, "location_in_text": {"start": 0, "end": 1, "chunk_id": 0}},
            {"claim_id": "claim_0_1", "text": "u", "claim_type": "quantitative", "citation_found": False, "is_original": True},
        ],
        "citations": {"1": "R", "2": "S"},
        "summary": {"total_claims": 2},
    }
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    claims, citations = files.load_claims(spark, str(tmp_path))
    rows = claims.orderBy("file", "seq").collect()
    assert [r.claim_id for r in rows] == ["claim_0_0", "claim_0_1"] * 2
    assert rows[0].citation_details.year == 2020 and rows[0].is_original is False and rows[1].is_original is True
    assert citations.count() == 4


def test_write_and_read_back(spark, tmp_path):
    claims = spark.createDataFrame(
        [(1, "claim_0_0", "t", "qualitative", True, "1", "[1]", False), (1, "claim_0_1", "u", "quantitative", False, None, None, True)],
        "doc_id bigint, claim_id string, text string, claim_type string, citation_found boolean, citation_id string, citation_text string, is_original boolean")
    book = spark.createDataFrame([(1, "1", "R")], "doc_id bigint, citation_id string, citation_text string")
    files.write_claims(claims, book, str(tmp_path / "run"), "20240101_000000")
    back, citations = files.read_claims(spark, str(tmp_path / "run"))
    assert sorted((r.claim_id, r.citation_id, r.is_original) for r in back.collect()) == [("claim_0_0", "1", False), ("claim_0_1", None, True)]
    assert citations.first().citation_text == "R"
    summary = spark.read.json(str(tmp_path / "run" / "summary")).where("doc_id is null").first()
    assert (summary.total_claims, summary.claims_with_citations) == (2, 1)
    results = claims.withColumn("result_class", F.concat("claim_type", F.lit("_cited")))
    files.write_results_by_class(results, str(tmp_path / "results"))
    assert {p.name for p in (tmp_path / "results").iterdir() if p.is_dir()} == {"result_class=qualitative_cited", "result_class=quantitative_cited"}


def test_sniffers(spark):
    cases = [
        ("http://x/a", "", b"%PDF-1.4", None, "pdf"), ("http://x/a.xlsx", "", b"PK\x03\x04zz", "xlsx", "txt"),
        ("http://x/a", "", b"PK\x03\x04zz", None, "txt"), ("http://x/a", "", b"\xd0\xcf\x11\xe0zz", "xls", "txt"),
        ("http://x/a.csv", "text/html", b"a,b\n1,2", None, "html"), ("http://x/a.CSV", "", b"x", "csv", "txt"),
        ("http://x/a", "", b"  <!DOCTYPE HTML><p>", None, "html"), ("http://x/a", "", b'{"a": [1]}', "json", "txt"),
        ("http://x/a", "", b"{nope", None, "txt"), ("http://x/a", "", b"\n a,b\n1,2", "csv", "txt"),
        ("http://x/a", "application/json", b"zz", "json", "txt"), ("http://x/a", "", b"\xff\xfe,1", None, "txt"),
        ("http://x/a.pdf", "", b"text", None, "pdf"), ("http://x/a.htm", "", b"text", None, "html"), ("http://x/a", "", b"", None, "txt"),
        ("http://x/a", "", b"[1, 2", "csv", "txt"), ("http://x/a.xls", "", b"zz", "xls", "txt"),
    ]
    df = spark.createDataFrame([(n, *c[:3]) for n, c in enumerate(cases)], "n int, url string, content_type string, content binary")
    tab = {r.n: r.format for r in fetch.sniff_tabular_format(df).collect()}
    text = {r.n: r.format for r in fetch.sniff_text_format(df).collect()}
    assert [tab[n] for n in range(len(cases))] == [c[3] for c in cases]
    assert [text[n] for n in range(len(cases))] == [c[4] for c in cases]


def test_payload_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    payloads = files.read_payloads(spark, str(tmp_path))
    bad = files.not_tabular(payloads).collect()
    assert [r.error for r in bad] == ["URL is not tabular data (detected: application/pdf)"]
    assert files.load_tabular(spark, str(tmp_path / "a.csv"), "csv").first().y == 2


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y,name\n1,2,"a, ""b"""\n3,no,c\n4,5\n')
    (tmp_path / "b.dat").write_text('name,extra,x\n"two\nlines",9,6\n')
    (tmp_path / "c.json").write_text('{"x": 7, "name": "n"}\n\n{"x": 8, "y":\n')
    (tmp_path / "d.dat").write_text(json.dumps([{"x": 9, "y": 1}, {"x": 10}], indent=1))
    (tmp_path / "e.dat").write_text(json.dumps({"x": 11, "name": "é"}, indent=1))
    (tmp_path / "f.dat").write_text("<!doctype html><p>a,b")
    (tmp_path / "g.xls").write_bytes(b"\xd0\xcf\x11\xe0zz")
    (tmp_path / "h.csv").write_text("")
    (tmp_path / "h2.dat").write_text("q,r\n1,2\n")
    (tmp_path / "i j.csv").write_text("x\n12\n")
    rows, rejects = files.load_tabular_files(spark, str(tmp_path), "x bigint, y int, name string")
    got = {(r.x, r.y, r.name) for r in rows.collect()}
    assert got == {(1, 2, 'a, "b"'), (6, None, "two\nlines"), (7, None, "n"), (9, 1, None), (10, None, None), (11, None, "é"), (12, None, None)}
    bad = sorted((r.file.rsplit("/", 1)[1], r.error) for r in rejects.collect())
    assert [b[0] for b in bad] == ["a.csv", "a.csv", "c.json", "f.dat", "g.xls", "h2.dat"]
    assert bad[0][1] == "Not of the column's type: y" and bad[1][1] == "Row does not fit the header"
    assert bad[4][1] == "Unhandled format: xls"
    names, lost = files.load_tabular_files(spark, str(tmp_path / "a.csv"), "name string")
    assert names.count() == 2 and lost.groupBy("error").count().first()["error"] == "Row does not fit the header"
    # Nothing is opened: names decide, and a json file is taken as lines.
    rows, rejects = files.load_tabular_files(spark, str(tmp_path / "c.json"), "x bigint", sniffed_bytes=0)
    assert [r.x for r in rows.collect()] == [7] and rejects.count() == 1


PAGE = """<html><body><nav><a href="https://a.org/nav">navigation link</a></nav>
<div class="Cookie-Banner">accept <p>all</p></div>
<article><h1>Title  here</h1><p>One &amp; two<br>three</p><div id="share-box">share</div><script>var t = "</p>";</script>
<ul><li>See <a href="https://www.w3.org/x">skipped link</a> and <a href="https://b.org/d">the <b>data</b> set</a>, <a href="https://b.org/d">again here</a> <a href="/rel">relative</a> <a href="https://b.org/s">abc</a></li></ul></article>
<footer>foot</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>no article"), (3, "")], "page_id bigint, html string")
    text = {r.page_id: r.text for r in html.article_text(pages).collect()}
    assert text[1].split("\n")[:4] == ["Title", "here", "One & two", "three"] and "share" not in text[1] and "accept" not in text[1]
    assert text[2] == "no article" and text[3] == ""
    links = discovery.candidate_links(pages, context=True).collect()
    assert [(r.link_no, r.url, r.title) for r in links] == [(1, "https://b.org/d", "the data set")]
    assert links[0].context == "See skipped link and the data set , again here relative abc"


def test_late_rows_are_dropped_and_windows_agree(spark, tmp_path):
    day = 86_400
    first = [(n * 600, "a", 10, 1) for n in range(300)]
    late = [(100, "a", 1000, 1), (299 * 600, "b", 5, 0)]
    schema = "s bigint, task string, input_tokens bigint, output_tokens bigint"
    stamp = lambda rows: spark.createDataFrame(rows, schema).select(F.timestamp_seconds("s").alias("ts"), "task", "input_tokens", "output_tokens")
    source = str(tmp_path / "in")
    stamp(first).coalesce(1).write.parquet(source)
    stream = streams.read_stream(spark, source, "*.parquet", "ts timestamp, task string, input_tokens bigint, output_tokens bigint")
    done, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    cost = streams.stream_token_cost(stream)
    streams.run_to_table(cost, done, mark)
    stamp(late).coalesce(1).write.mode("append").parquet(source)
    streams.run_to_table(cost, done, mark)
    got = {(r.window_start.day, r.task): r.input_tokens for r in spark.read.parquet(done).collect()}
    want = {}
    for s, task, n, _ in first:
        want[(s // day + 1, task)] = want.get((s // day + 1, task), 0) + n
    assert got == {k: v for k, v in want.items() if k[0] < 3}


def test_stream_manifest_and_parse(spark, tmp_path):
    events = spark.createDataFrame(
        [(1, "1", 1, "append"), (1, "1", 2, "delete"), (1, "2", 3, "append")], "doc_id bigint, citation_id string, seq bigint, kind string"
    ).withColumn("at", F.timestamp_seconds("seq"))
    events.write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), "*.parquet", "doc_id bigint, citation_id string, seq bigint, kind string, at timestamp")
    streams.stream_manifest(stream, str(tmp_path / "table"), str(tmp_path / "mark")).awaitTermination()
    counts = reporting.manifest_counts(reporting.manifest_current(spark.read.parquet(str(tmp_path / "table")))).first()
    assert (counts["count"], counts.n_live) == (2, 1)

    texts = spark.createDataFrame([(n, f"text {n % 3}") for n in range(12)], "s bigint, raw_text string").select(F.timestamp_seconds("s").alias("ts"), "raw_text")
    texts.write.parquet(str(tmp_path / "texts"))
    arriving = streams.read_stream(spark, str(tmp_path / "texts"), "*.parquet", "ts timestamp, raw_text string")

    def model(batch):
        return batch.assign(title=batch["raw_text"].str.upper(), first_author=None, year=None, journal=None, doi=None)

    streams.parse_in_batches(arriving, model, str(tmp_path / "parsed"), str(tmp_path / "mark2")).awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "parsed")).collect()
    assert sorted(r.title for r in got) == ["TEXT 0", "TEXT 1", "TEXT 2"]


def test_manifest_state_over_late_deletions(spark, tmp_path):
    schema = "doc_id bigint, citation_id string, seq bigint, kind string"
    batches = [
        [(1, "1", 1, "append"), (1, "1", 2, "append"), (1, "2", 3, "delete"), (2, "1", 4, "append")],
        [(1, "1", 5, "delete"), (1, "2", 6, "append"), (2, "1", 7, "delete"), (2, "1", 8, "delete")],
        [(1, "1", 10, "delete"), (1, "1", 9, "append"), (2, "1", 11, "append"), (1, "1", 12, "delete")],
    ]
    source, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    every = spark.createDataFrame([e for b in batches for e in b], schema).withColumn("at", F.timestamp_seconds("seq"))
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).withColumn("at", F.timestamp_seconds("seq")).coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_stream(spark, source, "*.parquet", f"{schema}, at timestamp", 1)
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        streams.manifest_state_to_table(stream, table, mark)  # goes on from the checkpoint
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
        so_far = every.where(F.col("seq") <= max(e[2] for e in batch))
        rows = lambda df: sorted((r.doc_id, r.citation_id, r.seq, r.appended_at, str(r.deleted_at)) for r in df.collect())
        assert rows(streams.read_manifest_state(spark, table)) == rows(reporting.manifest_current(so_far)), n


def test_stream_of_a_table_in_one_file_or_many(spark, tmp_path):
    rows = spark.range(40).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    rows.repartition(4).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for kind in ("many", "one"):
        rows.selectExpr("doc_id", "doc_id AS other").write.parquet(str(tmp_path / kind / "labels.parquet"))
        stream = streams.read_stream(spark, str(tmp_path / kind), "documents.parquet", "doc_id bigint, text string", 3)
        streams.run_to_table(stream, str(tmp_path / f"{kind}-out"), str(tmp_path / f"{kind}-progress"))
        got = spark.read.parquet(str(tmp_path / f"{kind}-out")).collect()
        assert sorted((r.doc_id, r.text) for r in got) == [(k, str(k)) for k in range(40)]


def test_manifest_state_is_called_once_for_many_citations(monkeypatch):
    """Thousands of citations of a bucket cost one read and one write of state; records leave it by age."""
    calls = []

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            calls.append("get")
            return (self.held,)

        def update(self, value):
            calls.append("update")
            self.held = value[0]

    class Handle:
        def getValueState(self, *_):
            return Value()

    class Time:
        def getCurrentProcessingTimeInMs(self):
            return now

    rows = lambda kind, seq: pd.DataFrame({
        "doc_id": [str(n) for n in range(5000)], "citation_id": [None if n % 2 else "1" for n in range(5000)], "seq": seq, "kind": kind, "at": seq})
    records = streams.OpenRecords(ttl_ms=100)
    records.init(Handle())
    now = 0
    (first,) = records.handleInputRows((0,), iter([rows("append", 1), rows("append", 2)]), Time())
    assert len(first) == 10000 and calls == ["update"]
    now = 50
    (second,) = records.handleInputRows((0,), iter([rows("delete", 3)]), Time())
    assert set(second["seq"]) == {2} and set(second["deleted_at"]) == {3} and calls == ["update", "get", "update"]
    now = 100
    (third,) = records.handleInputRows((0,), iter([rows("delete", 4), rows("append", 5)]), Time())
    assert set(third["seq"]) == {5} and len(third) == 5000 and third["deleted_at"].isna().all()


def test_claim_files_are_put_in_place_by_their_tasks(spark, tmp_path, monkeypatch):
    claims = spark.createDataFrame(
        [(d, "claim_0_0", "t", "qualitative", True, "1", "[1]", False) for d in range(3)],
        "doc_id bigint, claim_id string, text string, claim_type string, citation_found boolean, citation_id string, citation_text string, is_original boolean"
    ).withColumn("raw_citation_text", F.lit("R"))
    given = {}
    option = type(claims.write).option
    monkeypatch.setattr(type(claims.write), "option", lambda self, key, value: (given.update({key: value}), option(self, key, value))[1])
    files.write_claim_files(claims, str(tmp_path / "files"))
    assert given["mapreduce.fileoutputcommitter.algorithm.version"] == "2"
    assert len(list((tmp_path / "files").glob("doc_id=*/part=0/*.txt"))) == 3
    assert files.load_claims(spark, str(tmp_path / "files"))[0].count() == 3


def test_class_outputs_are_stored_compressed(spark, tmp_path):
    claims = spark.createDataFrame(
        [(1, "1", f"k{n}", n, "qualitative", "qualitative_cited") for n in range(200)],
        "doc_id bigint, citation_id string, claim_id string, seq bigint, claim_type string, result_class string").withColumn("citation_text", F.lit("[1]"))
    attempts = spark.createDataFrame([(1, "1", 1, "u1", "direct", False, "403")],
                                     "doc_id bigint, citation_id string, attempt_no int, url string, source string, downloaded boolean, error string")
    got = fetch.first_success(attempts)
    failed = fetch.fail_batch(claims, fetch.citation_batch(claims, got), "rag_search", "text source").withColumn("result_class", F.lit("qualitative_cited"))
    files.write_class_outputs(claims, failed, got, fetch.attempts_made(attempts, got), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out" / "batches"))
    assert [r.n for r in back.select(F.size("batch.claim_results").alias("n")).collect()] == [200]
    stored = [f.stat().st_size for f in (tmp_path / "out" / "batches").rglob("part-*")]
    assert 0 < sum(stored) < sum(len(r.value) for r in spark.read.text(str(tmp_path / "out" / "batches")).collect()) / 5


def test_claim_files_are_many_small_ones(spark, tmp_path):
    claims = spark.range(400).select(
        F.when(F.col("id") > 0, F.concat(F.lit("a/b="), "id")).otherwise(F.lit("")).alias("doc_id"), F.concat(F.lit("c"), "id").alias("claim_id"),
        F.lit("téxt").alias("text"), F.lit(None).cast("string").alias("citation_id"), F.lit(None).cast("string").alias("raw_citation_text"))
    path = tmp_path / "files of claims"
    for mode, times in (("overwrite", 1), ("ignore", 1), ("append", 2), ("overwrite", 1)):
        files.write_claim_files(claims, f"file://{path}", mode)
        found = [p for p in path.rglob("*") if p.is_file() and p.parent != path]
        assert len(found) == 400 * times and all(p.name.startswith("part-") for p in found)  # nothing is stored beside them
    named = {r.doc_id for r in spark.read.text(str(path)).select("doc_id").distinct().collect()}
    assert named == {None, *[f"a/b={n}" for n in range(1, 400)]}
    back, _ = files.load_claims(spark, f"file://{path}")
    assert back.rdd.getNumPartitions() <= 8
    assert {(r.claim_id, r.text) for r in back.collect()} == {(f"c{n}", "téxt") for n in range(400)}
