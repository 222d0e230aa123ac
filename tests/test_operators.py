"""Ranking, search, hook, verdicts, reports."""

import random
from collections import Counter

from pyspark.sql import functions as F

from evidence.operators import discovery as D
from evidence.operators import fetch, postings, ranking, reporting, routing, verdicts
from evidence.operators.hook import score, usage_of


def test_overlap_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{n}" for n in range(30)]
    pick = lambda n: sorted({vocabulary[min(int(rng.expovariate(0.15)), 29)] for _ in range(n)})
    items = {k: pick(5) for k in range(200)}
    queries = {(d, f"c{n}"): pick(6) + ["zz"] for d in range(5) for n in range(20)}
    q = spark.createDataFrame([(d, c, w) for (d, c), w in queries.items()], "doc_id bigint, claim_id string, words array<string>")
    i = spark.createDataFrame(list(items.items()), "item bigint, words array<string>")
    searches = {hot: D.overlap_topk(q, i, ["doc_id", "claim_id"], "item", 4, hot) for hot in (0, 10, 40, 1000)}
    searches |= {f"{n} an item block": postings.block_topk(q, i, ["doc_id", "claim_id"], "item", 4, n) for n in (9, 70, 8192)}
    for hot, search in searches.items():
        got = {}
        for r in search.collect():
            got.setdefault((r.doc_id, r.claim_id), {})[r["rank"]] = (r.item, r.overlap)
        for key, words in queries.items():
            ranked = sorted(((-len(set(words) & set(v)), k) for k, v in items.items() if set(words) & set(v)))[:4]
            assert [got.get(key, {}).get(n + 1) for n in range(len(ranked))] == [(k, -o) for o, k in ranked], (hot, key)


def test_bounds_of_blocks(spark):
    rng = random.Random(6)
    pick = lambda n: sorted({f"w{rng.randint(0, 40)}" for _ in range(n)})
    items = [(n, n // 50, pick(1 + n // 10)) for n in range(200)]
    queries = {f"q{n}".encode(): pick(rng.randint(1, 60)) for n in range(30)} | {b"none": ["zz"]}
    made = lambda rows, kind: spark.createDataFrame(rows, kind).withColumn("words", postings._text("words"))
    got = postings._bounds(
        made(list(queries.items()), "pid binary, words array<string>"), made(items, "item int, block int, words array<string>").repartition(3)).collect()
    bounds = {(bytes(r.pid), r.block): r.bound for r in got}
    most = [max(len(w) for _, b, w in items if b == block) for block in range(4)]
    for pid, words in queries.items():
        for block in range(4):
            best = max(len(set(words) & set(w)) for _, b, w in items if b == block)
            assert best <= bounds.get((pid, block), 0) <= min(len(words), most[block])
        places = sorted((r["_place"], -r.bound) for r in got if bytes(r.pid) == pid)
        assert [p for p, _ in places] == [*range(1, len(places) + 1)] and places == sorted(places, key=lambda x: x[1])
    assert not any(pid == b"none" for pid, _ in bounds)


def test_rank_in_groups_equals_sort(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), rng.randint(0, 3), n) for n in range(1000)]
    df = spark.createDataFrame(rows, "g string, c int, n bigint")
    ranked = ranking.rank_in_groups(df, ["g"], [F.col("c"), F.col("n")], [F.col("c"), F.floor(F.col("n") / 50)])
    got = {(r.g, r.c, r.n): r["rank"] for r in ranked.collect()}
    assert len(got) == 1000
    for g in ("hot", "a", None):
        mine = sorted([r for r in rows if r[0] == g], key=lambda r: r[1:])
        assert [got[r] for r in mine] == list(range(1, len(mine) + 1))


def test_nest_parts_keeps_everything(spark):
    df = spark.createDataFrame([("hot", n) for n in range(500)] + [("small", n) for n in range(3)], "g string, n int")
    parts = ranking.nest_parts(df, ["g"], ["n"], F.struct("n"), F.col("n"), "items", 50).collect()
    sizes = Counter()
    for r in parts:
        sizes[r.g] += len(r["items"])
        assert [x.n for x in r["items"]] == sorted(x.n for x in r["items"])
    assert sizes == {"hot": 500, "small": 3} and sum(r.g == "hot" for r in parts) == 10


def test_hook_scores_once_and_isolates_errors(spark):
    df = spark.createDataFrame([(n, f"text {n % 4}") for n in range(20)] + [(99, None)], "id int, text string").repartition(5)

    def model(batch):
        if batch["text"].eq("text 2").any():
            raise ValueError("bad text")
        return batch.assign(size=batch["text"].str.len().astype("Int64"), input_tokens=10)

    scored = score(df, model, ["text"], "size bigint", task="generic")
    rows = scored.collect()
    assert len(rows) == 21
    assert {r.text for r in rows if r.error} == {"text 2"} and all(r["size"] is None for r in rows if r.error)
    usage = reporting.token_cost(usage_of(scored, ["text"])).first()
    assert usage.input_tokens == 40 and usage.total_tokens == 40


def test_reuse_follows_order(spark):
    fit = lambda u, c: {"url": u, "confidence": c}
    rows = [
        (1, "a", 1, "u1", [fit("u1", 0.9)]), (1, "b", 2, "u2", [fit("u1", 0.75)]), (1, "c", 3, "u3", [fit("u1", 0.8), fit("u2", 0.8)]),
        (1, "d", 4, None, []), (1, "e", 5, "u5", [fit("u1", 0.8), fit("u2", 0.95), fit("u9", 1.0)]), (2, "a", 1, None, [fit("u1", 0.9)]),
    ]
    df = spark.createDataFrame(
        [(d, c, s, u, "data.gov", 0.7, r) for d, c, s, u, r in rows],
        "doc_id bigint, claim_id string, seq bigint, url string, source string, score double, reuse array<struct<url:string,confidence:double>>")
    chosen = D.dataset_reuse(df)
    got = {(r.doc_id, r.claim_id): (r.source_url, r.is_reused) for r in chosen.collect()}
    assert got == {(1, "a"): ("u1", False), (1, "b"): ("u2", False), (1, "c"): ("u1", True), (1, "e"): ("u2", True)}
    assert {r.source_url: r.reused_count for r in D.reuse_counts(chosen).collect()} == {"u1": 1, "u2": 1}


def test_attempts_and_batches(spark):
    a = spark.createDataFrame(
        [(1, "1", 1, "u1", "direct", False, "403"), (1, "1", 2, "u2", "open_access", True, None), (1, "1", 3, "u3", "open_access", False, "x"),
         (1, "2", 1, "u4", "direct", False, "503 UNAVAILABLE")],
        "doc_id bigint, citation_id string, attempt_no int, url string, source string, downloaded boolean, error string")
    outcome = fetch.first_success(a)
    got = {r.citation_id: (r.downloaded, r.winning_url, r.error) for r in outcome.collect()}
    assert got == {"1": (True, "u2", None), "2": (False, None, "503 UNAVAILABLE")}
    assert fetch.attempts_made(a, outcome).count() == 3
    claims = spark.createDataFrame(
        [(1, c, f"k{c}{n}", n, "qualitative") for c in ("1", "2", "3") for n in range(3)],
        "doc_id bigint, citation_id string, claim_id string, seq bigint, claim_type string")
    batches = fetch.citation_batch(claims, outcome)
    failed = fetch.fail_batch(claims, batches, "rag_search", "text source")
    assert Counter(r.errors for r in failed.collect()) == {
        "503 UNAVAILABLE": 3, "No URL found via open-access APIs or institutional cookies": 3}
    docs = fetch.batch_json(batches.withColumn("citation_text", F.lit("[1]")), failed, fetch.attempts_made(a, outcome), 1).collect()
    import json

    nested = [json.loads(r.batch) for r in docs]
    assert sum(len(d["claim_results"]) for d in nested) == 6 and sum(len(d["resolution_attempts"]) for d in nested) == 3
    assert {d["batch_notes"] for d in nested if d["citation_id"] == "1"} == {"Successfully validated 3 claims"}


def test_manifest_is_a_stack(spark):
    events = [("append", 1), ("delete", 2), ("delete", 3), ("append", 4), ("append", 5), ("delete", 6), ("append", 7), ("delete", 8), ("delete", 9)]
    df = spark.createDataFrame([(1, "1", s, k, s) for k, s in events], "doc_id bigint, citation_id string, seq bigint, kind string, at bigint")
    got = {r.seq: r.deleted_at for r in reporting.manifest_current(df).collect()}
    assert got == {1: 2, 4: 9, 5: 6, 7: 8}


def test_manifest_buckets_do_not_matter(spark):
    rng = random.Random(9)
    events = [(d, c, n, rng.choice(["append", "delete"]), n) for d in range(3) for c in ("1", "2") for n in range(150)]
    df = spark.createDataFrame(events, "doc_id bigint, citation_id string, seq bigint, kind string, at bigint")
    want = {}
    for d in range(3):
        for c in ("1", "2"):
            live = []
            for _, _, n, kind, _ in (e for e in events if e[:2] == (d, c)):
                if kind == "append":
                    live.append(n)
                    want[(d, c, n)] = None
                elif live:
                    want[(d, c, live.pop())] = n
    for width in (1, 7, 40, 1000):
        current = reporting.manifest_current(df, F.floor(F.col("seq") / width))
        assert {(r.doc_id, r.citation_id, r.seq): r.deleted_at for r in current.collect()} == want


def test_union_of_copartitioned_inputs(spark):
    """A union of inputs that share a partitioning must not multiply rows."""
    base = spark.range(4000).selectExpr("id % 50 AS doc_id", "cast(id % 3 AS string) AS citation_id", "id AS at")
    numbered = base.selectExpr("*", "row_number() OVER (PARTITION BY doc_id, citation_id ORDER BY at) AS n")
    add = numbered.selectExpr("doc_id", "citation_id", "n * 10L AS seq", "'append' AS kind", "at")
    drop = numbered.where("n % 2 = 0").selectExpr("doc_id", "citation_id", "n * 10L + 1 AS seq", "'delete' AS kind", "at")
    current = reporting.manifest_current(add.unionByName(drop), F.floor(F.col("seq") / 20))
    assert current.count() == 4000 and current.where("deleted_at IS NOT NULL").count() == drop.count()


def test_manifest_is_dealt_into_bounded_tasks(spark):
    events = [(d, "1", n, "append" if n % 3 else "delete", n) for d in range(40) for n in range(10)]
    df = spark.createDataFrame(events, "doc_id bigint, citation_id string, seq bigint, kind string, at bigint")
    current = reporting.manifest_current(df, F.floor(F.col("seq") / 4))
    assert current.rdd.getNumPartitions() >= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_quant_checks(spark):
    data = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), (None, 2.0)], "g string, x double")
    stats = verdicts.column_statistics(data, ["x"], ["g"], ["g"]).withColumn("dataset", F.lit("d"))
    rows = [
        ("1", "avg", None, None, "eq", 4.0, 0.01, None, True), ("2", "max", "g", "a", "gt", 3.0, 0.0, None, False),
        ("3", "sum", "g", "b", "ratio", 2.5, 0.01, "a", True), ("4", "sum", "g", "b", "pct_change", 150.0, 0.1, "a", True),
        ("5", "n_distinct", None, None, "eq", 2.0, 0.0, None, True), ("6", "sum", "g", "none", "lt", 5.0, 0.0, None, False),
    ]
    specs = spark.createDataFrame(
        [(c, "d", a, "g" if a == "n_distinct" else "x", fc, fv, k, e, t, b) for c, a, fc, fv, k, e, t, b, _ in rows],
        "claim_id string, dataset string, agg string, column string, filter_col string, filter_val string, comparator string, expected double, tolerance double, base_val string")
    got = {r.claim_id: (r.passed, r.validated) for r in verdicts.quant_check(specs, stats).collect()}
    assert got == {r[0]: (r[-1], r[0] != "6") for r in rows}


def test_parse_verdicts(spark):
    outputs = ['noise {"passed": true, "confidence": 0.9, "explanation": "x"} end', '{"passed": true}', "nothing", "{broken", '{"a": {"b": 1}} tail}']
    df = spark.createDataFrame(list(enumerate(outputs)), "id int, output string")
    got = {r.id: (r.validated, r.passed, r.confidence) for r in verdicts.parse_verdict_text(df).collect()}
    assert got == {0: (True, True, 0.9), 1: (True, True, 0.5), 2: (False, False, 0.0), 3: (False, False, 0.0), 4: (False, False, 0.0)}


def test_result_stats_show_empty_classes(spark):
    df = spark.createDataFrame([("qualitative_cited", True, 0.9), ("qualitative_cited", False, 0.2)], "result_class string, passed boolean, confidence double")
    got = {r.result_class: (r["count"], r.passed, r.failed, r.avg_confidence) for r in reporting.result_stats(df).collect()}
    assert got["qualitative_cited"] == (2, 1, 1, 0.55) and got["quantitative_uncited"] == (0, 0, 0, None) and len(got) == 4


def test_task_routing_and_errors(spark):
    calls = spark.createDataFrame([("claim_extraction", None), ("unknown", None), ("plausibility_check", 0.7)], "task string, temperature_override double")
    got = {r.task: (r.config_task, r.temperature) for r in reporting.task_routing(calls).collect()}
    assert got == {"claim_extraction": ("claim_extraction", 0.1), "unknown": ("generic", 0.2), "plausibility_check": ("plausibility_check", 0.7)}
    errors = spark.createDataFrame([("503 UNAVAILABLE",), ("404 nope 503",), ("x DEADLINE_EXCEEDED",), ("",), (None,)], "error string")
    assert [r.is_transient for r in reporting.transient_error(errors).collect()] == [True, False, True, False, False]


def test_dedupe_is_idempotent_and_cascade_stops(spark):
    c = spark.createDataFrame([("k", 3, "b"), ("k", 1, "a"), ("k", 2, "b"), ("k", 4, ""), ("k", 5, None)], "k string, pos int, url string")
    once = D.dedupe_ordered(c, ["k"])
    assert sorted((r.pos, r.url) for r in once.collect()) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, D.dedupe_ordered(once, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    empty = c.where("false")
    got = D.resolve_cascade([empty, c, c.withColumn("url", F.lit("z"))], ["k"]).collect()
    assert {(r.step, r.url) for r in got} == {(2, "a"), (2, "b")}


def test_cascade_moves_candidates_once(spark):
    rows = [("k", 1, "a"), ("k", None, "a"), ("k", 2, "b"), (None, 1, "n"), ("m", 1, None), ("m", 4, "c")]
    c = spark.createDataFrame(rows, "k string, pos int, url string")
    late = spark.createDataFrame([("k", 0, "a"), ("m", 9, "z"), ("o", 3, "y"), ("o", 1, "y")], "k string, pos int, url string")
    got = D.resolve_cascade([c, late], ["k"])
    assert sorted(map(tuple, got.collect())) == [("k", 1, "a", 1), ("k", 1, "b", 2), ("m", 1, "c", 4), ("o", 2, "y", 1)]
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_cached_answers_leave_the_inputs_behind(spark, tmp_path):
    rows = [(1, "a"), (2, None), (3, "a"), (4, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    for _ in range(2):
        got = score(df, lambda b: b.assign(n=b["text"].str.len().fillna(-1)), ["text"], "n int", "t", cache=str(tmp_path / "c"))
        assert got.columns == ["id", "text", "n", "input_tokens", "output_tokens", "error", "task"]
        assert sorted((r.id, r.text, r.n) for r in got.collect()) == [(1, "a", 1), (2, None, -1), (3, "a", 1), (4, "", 0)]
        plan = got.select("id", "n")._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Project [" in x and "text#" in x and "sha2(" not in x], plan


def test_triage_parts_are_complete(spark):
    rows = [(1, f"c{n}", "quantitative", n % 2 == 0, 0.72, n % 3 == 0, n / 20) for n in range(20)]
    scored = spark.createDataFrame(rows, "doc_id bigint, claim_id string, claim_type string, found boolean, fact_confidence double, plausible boolean, plausible_confidence double").withColumns(
        {"fact_explanation": F.lit("f"), "reasoning": F.lit("r"), "fact_sources": F.array().cast("array<string>")})
    found = spark.createDataFrame([(1, f"c{n}", ("u", "data.gov")) for n in range(0, 20, 4)], "doc_id bigint, claim_id string, found_source struct<source_url:string,source_type:string>")
    searched, direct = routing.triage_quant_uncited(scored, found)
    assert searched.count() + direct.count() == 20
    strong = {f"c{n}" for n in range(20) if n % 3 == 0 and n / 20 > 0.8}
    assert {r.claim_id for r in direct.where("validation_method = 'truth_table+llm_only'").collect()} == strong
    assert routing.promote_found_source(searched).first().citation_id.startswith("found_c")




def test_answers_are_kept_between_runs(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(batch):
        calls.add(len(batch))
        if (batch["text"] == "bad").any():
            raise ValueError("no")
        return batch.assign(size=batch["text"].str.len().fillna(-1))

    def run(rows, **more):
        df = spark.createDataFrame(rows, "id int, text string, other string")
        got = score(df, model, ["text", "other"], "size int", "t", cache=str(tmp_path / "c"), **more).collect()
        n, calls.value = calls.value, 0
        return {(r.id, r.size, r.error) for r in got}, n

    rows = [(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, "a", None)]
    first, asked = run(rows)
    assert first == {(1, 1, None), (2, 1, None), (3, -1, None), (4, 1, None)} and asked == 3
    assert run(rows) == (first, 0)
    mixed, asked = run([*rows, (5, "bad", "x"), (6, "ccc", "x")])
    assert mixed == first | {(5, None, "no"), (6, 3, None)} and asked >= 2
    again, asked = run([(5, "bad", "x"), (6, "ccc", "x")])
    assert again == {(5, None, "no"), (6, 3, None)} and asked >= 1
    assert run(rows, version="2") == (first, 3)
    assert run([]) == (set(), 0)


def test_reuse_by_waves_equals_the_walk(spark):
    rng = random.Random(11)
    fit, rows = {}, []
    for doc, n in ((1, 40), (2, 12), (3, 1)):
        for seq in rng.sample(range(1000), n):
            urls = [f"u{k}" for k in range(9)]
            for u in urls:
                fit[f"{doc}/{seq}", u] = rng.choice([0.1, 0.5, 0.71, 0.9]) if rng.random() < 0.35 else 0.2
            own = rng.choice([*urls, None])
            rows.append((doc, f"c{seq}", seq, own, "data.gov", rng.random(), [(u, fit[f"{doc}/{seq}", u]) for u in urls], f"{doc}/{seq}"))
    schema = ("doc_id bigint, claim_id string, seq bigint, url string, source string, score double, "
              "reuse array<struct<url:string,confidence:double>>, text string")
    df = spark.createDataFrame(rows, schema).repartition(4)
    seen = lambda got: sorted(map(tuple, got.collect()))
    want = seen(D.dataset_reuse(df))
    assert seen(D.dataset_reuse_waves(df)) == want
    assert seen(D.dataset_reuse_waves(df, waves=1)) == want
    place = {r[7]: (r[0], r[2]) for r in rows}
    found = {}
    for r in want:
        if not r[7]:
            found[r[0], r[3]] = min(r[2], found.get((r[0], r[3]), r[2]))

    def ask(batch):
        for t, u in zip(batch["text"], batch["known_url"]):
            doc, seq = place[t]
            assert found[doc, u] < seq  # only datasets found before the claim are asked about
        return batch.assign(confidence=[fit[k] for k in zip(batch["text"], batch["known_url"])])

    assert seen(D.dataset_reuse_waves(df, ask, ["text"])) == want
    none = spark.createDataFrame([], schema)
    assert seen(D.dataset_reuse_waves(none)) == [] and seen(D.dataset_reuse_waves(none, ask, ["text"])) == []


def test_decided_papers_leave_the_waves(spark, monkeypatch):
    rows = [(d, f"c{n}", n, f"u{n}", "data.gov", 0.7, [(f"u{n - 1}", 0.9)] if d == 1 else [], "t") for d in range(1, 6) for n in range(1, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, claim_id string, seq bigint, url string, source string, score double, "
                                     "reuse array<struct<url:string,confidence:double>>, text string")
    want = sorted(map(tuple, D.dataset_reuse(df).collect()))
    sizes, made = [], D.materialize

    def counted(frame, name="table"):
        stored = made(frame, name)
        if name == "wave":
            sizes.append(stored.count())
        return stored

    monkeypatch.setattr(D, "materialize", counted)
    assert sorted(map(tuple, D.dataset_reuse_waves(df).collect())) == want
    assert sizes[0] == 25 and sizes[-1] == 5


def test_walk_of_reuse_is_dealt_into_bounded_tasks(spark):
    rows = [(d, "c1", 1, "u1", "s", 0.5, [("u1", None), ("u2", 0.9)]) for d in range(50)] + [(None, "c1", 1, "u1", "s", 0.5, None), (None, "c2", 2, "u2", "s", 0.5, [("u1", 0.9)])]
    df = spark.createDataFrame(rows, "doc_id bigint, claim_id string, seq bigint, url string, source string, score double, reuse array<struct<url:string,confidence:double>>")
    chosen = D.dataset_reuse(df)
    assert chosen.rdd.getNumPartitions() == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert chosen.count() == 52 and chosen.where("is_reused").count() == 0
