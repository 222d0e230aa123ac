"""Retrieval, verdicts and reports."""

from pyspark.sql import functions as F

from catalog.claims import citations, mapped, routed
from catalog.core import CTES, Inputs, lit, oracle
from catalog.documents import char_chunks_of
from evidence import constants as K
from evidence.operators import reporting, retrieval as R, verdicts
from evidence.operators.hook import score
from evidence.plans import runs
from evidence.session import materialize, scratch_dir

GRAM = 4


def pairs(i: Inputs):
    """Every document with one benchmark item, and every document that contains an item.

    Containment is found through an item's inner words, from the second to the
    last but one, four at most: inside a longer text they are whole words, so they
    must occur there in a row. Only documents sharing that run are compared with
    the item. Items of fewer than three words have no such run and are compared
    with all documents.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(K.WORD + "+"), F.lit(0))
    inner = F.least(F.greatest(F.size(words("text")) - 2, F.lit(0)), F.lit(GRAM))
    items = i.table("benchmark").where(F.col("text").isNotNull()).select(
        "item_id", F.col("text").alias("claim_text"), inner.alias("n"), F.array_join(F.slice(words("text"), F.lit(2), inner), " ").alias("run"))
    sizes = sorted(r.n for r in items.select("n").distinct().collect())
    docs = i.table("documents").where(F.col("text").isNotNull()).select("doc_id", "text")

    def runs_of(n: int):
        last = F.greatest(F.size("_w") - n + 1, F.lit(0))
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda p: F.array_join(F.slice("_w", p, n), " "))).otherwise(F.array().cast("array<string>"))

    found = i.view("pairs_assigned")
    if any(sizes):
        met = (
            docs.withColumn("_w", words("text"))
            .select("doc_id", F.explode(F.array_distinct(F.concat(*[runs_of(n) for n in sizes if n]))).alias("run"))
            .join(items.where("n > 0").drop("n"), "run")
        )
        same = F.col("m.doc_id").eqNullSafe(F.col("d.doc_id"))
        hits = met.alias("m").join(docs.alias("d"), same).where(F.contains("d.text", F.col("m.claim_text")))
        found = found.unionByName(hits.select("m.item_id", "m.doc_id"))
    if 0 in sizes:
        short = items.where("n = 0").select("item_id", "claim_text")
        found = found.unionByName(docs.join(short, F.contains("text", F.col("claim_text"))).select("item_id", "doc_id"))
    return found.distinct().select(F.col("item_id").alias("claim_key"), F.col("doc_id").alias("source_key"))


def claim_texts(i):
    return i.table("benchmark").select(F.col("item_id").alias("claim_key"), F.col("text").alias("claim_text"))


def source_texts(i):
    """Whole documents, and with negative keys some that hold nothing to search."""
    docs = i.table("documents")
    blank = F.when(docs.doc_id % 2 == 0, F.lit(" \n ")).otherwise(F.lit("The of. And a."))
    return docs.select(F.col("doc_id").alias("source_key"), F.col("text").alias("source_text")).unionByName(
        docs.select((-F.col("doc_id") - 1).alias("source_key"), blank.alias("source_text")))


def all_pairs(i):
    """The pairs, plus a wordless claim and real claims against the blank sources."""
    docs = i.table("documents")
    return pairs(i).unionByName(
        docs.select((F.col("doc_id") % 40).alias("claim_key"), (-F.col("doc_id") - 1).alias("source_key"))
    ).unionByName(docs.select(F.least(F.col("doc_id"), F.lit(-1)).alias("claim_key"), (-F.col("doc_id") - 1).alias("source_key")))


def all_claims(i):
    one = i.spark.createDataFrame([(-1, "the of and")], "claim_key bigint, claim_text string")
    return claim_texts(i).unionByName(one)


def index(i, store=True):
    return R.index_sources(source_texts(i), store=store)


def terms(i):
    ix = R.chunk_by_chars(i.table("documents"))
    return ix.select("doc_id", "chunk_no", F.array_join(F.array_sort(R.terms_of(F.col("chunk_text"))), "|").alias("terms"))


def _joined(rows, keys, *cells):
    """Terms with their numbers, one text per key: all of the result in few rows."""
    cell = F.concat_ws(":", *cells)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_terms"), F.array_join(F.array_sort(F.collect_list(cell)), "|").alias("terms"))


def term_freq(i):
    return _joined(
        R.term_freq(R.chunk_by_chars(i.table("documents")), ["doc_id", "chunk_no"], "chunk_text"),
        ["doc_id", "chunk_no"], "term", F.col("tf").cast("string"))


def vocabulary(i):
    return R.vocab_cap(R.pair_terms(pairs(i), claim_texts(i), index(i)))


def vocab_cap(i):
    return _joined(vocabulary(i), R.PAIR, "term", F.col("total").cast("string"))


def idf_weight(i):
    w = R.idf_weight(vocabulary(i), index(i))
    return w.groupBy(*R.PAIR).agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("idf"), 6).alias("sum_idf"), F.round(F.max("idf"), 6).alias("max_idf"),
        F.round(F.sum(F.col("idf") * F.col("total")), 6).alias("weighted"))


def cosine_topk(i):
    return R.cosine_topk(pairs(i), claim_texts(i), index(i)).withColumn("score", F.round("score", 6))


def retrieved(i):
    ix, asked = index(i), materialize(all_pairs(i), "all-pairs")
    return ix, asked, R.retrieve(asked, all_claims(i), ix)


def fallback(i):
    return R.retrieval_fallback(all_pairs(i), all_claims(i), index(i))


def outcome(i):
    ix, asked, found = retrieved(i)
    return R.retrieval_outcome(asked, ix, found)


def verdict(i):
    return verdicts.grounded_verdict(outcome(i))


def keyed_verdict(i):
    v = verdict(i)
    return v.withColumnsRenamed({"claim_key": "claim_id", "source_key": "doc_id"}).withColumn("claim_id", F.col("claim_id").cast("string"))


def qualitative(i):
    """Pairs as claims of a paper; those against blank sources with no content fall back to plausibility."""
    base = all_pairs(i).select(F.col("source_key").alias("doc_id"), F.col("claim_key").cast("string").alias("claim_id"), F.lit("qualitative").alias("claim_type"))
    v = keyed_verdict(i).where(F.col("outcome") != "empty_source")
    n = F.length("claim_id")
    p = base.select("doc_id", "claim_id", (n % 2 == 0).alias("plausible"), (n / 10).alias("plausible_confidence"), F.lit("by length").alias("reasoning"))
    return verdicts.qualitative_result(base, v, p)


def statistics(i):
    line = verdicts.column_statistics(
        i.table("lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], ["l_returnflag", "l_linestatus"], ["l_suppkey"])
    orders = verdicts.column_statistics(i.table("orders"), ["o_totalprice"], ["o_orderpriority"], ["o_custkey"])
    part = verdicts.column_statistics(i.table("part"), ["p_retailprice", "p_size"], ["p_type"], ["p_brand"])
    customer = verdicts.column_statistics(i.table("customer"), ["c_acctbal"], ["c_mktsegment"])
    return (
        line.withColumn("dataset", F.lit("lineitem"))
        .unionByName(orders.withColumn("dataset", F.lit("orders")))
        .unionByName(part.withColumn("dataset", F.lit("part")))
        .unionByName(customer.withColumn("dataset", F.lit("customer")))
    )


# claim, dataset, agg, column, filter column, filter value, comparator, expected, tolerance, base value
SPECS = [
    ("q1", "lineitem", "avg", "l_quantity", None, None, "eq", 25.5, 1.0, None),
    ("q2", "lineitem", "avg", "l_quantity", None, None, "eq", 40.0, 1.0, None),
    ("q3", "lineitem", "max", "l_discount", "l_returnflag", "R", "eq", 0.1, 0.001, None),
    ("q4", "lineitem", "n_distinct", "l_suppkey", None, None, "gt", 5.0, 0.0, None),
    ("q5", "orders", "sum", "o_totalprice", "o_orderpriority", "1-URGENT", "lt", 1000.0, 0.0, None),
    ("q6", "orders", "count", "o_totalprice", None, None, "gt", 100.0, 0.0, None),
    ("q7", "part", "min", "p_retailprice", None, None, "eq", 900.0, 0.5, None),
    ("q8", "part", "n_distinct", "p_brand", None, None, "eq", 5.0, 0.0, None),
    ("q9", "customer", "avg", "c_acctbal", "c_mktsegment", "BUILDING", "gt", 0.0, 0.0, None),
    ("q10", "customer", "avg", "c_acctbal", "c_mktsegment", "NO SUCH SEGMENT", "gt", 0.0, 0.0, None),
]
RELATIVE = [
    ("r1", "lineitem", "sum", "l_extendedprice", "l_returnflag", "R", "ratio", 1.0, 0.1, "A"),
    ("r2", "lineitem", "count", "l_quantity", "l_linestatus", "O", "pct_change", 50.0, 10.0, "F"),
    ("r3", "lineitem", "avg", "l_discount", "l_returnflag", "N", "pct_change", 0.0, 5.0, "A"),
    ("r4", "part", "avg", "p_retailprice", "p_type", "SMALL", "ratio", 2.0, 0.1, "ECONOMY"),
    ("r5", "orders", "count", "o_totalprice", "o_orderpriority", "1-URGENT", "ratio", 1.0, 0.2, "5-LOW"),
    ("r6", "orders", "count", "o_totalprice", "o_orderpriority", "1-URGENT", "ratio", 1.0, 0.2, "NONE"),
]
SPEC_SCHEMA = ("claim_id string, dataset string, agg string, column string, filter_col string, filter_val string, "
               "comparator string, expected double, tolerance double, base_val string")


def checked(i, specs):
    return verdicts.quant_check(i.spark.createDataFrame(specs, SPEC_SCHEMA), statistics(i)).withColumn("observed", F.round("observed", 4))


_AGG = {"n_distinct": "count(DISTINCT {c})"}


def _check_sql(specs) -> str:
    rows = []
    for claim, dataset, agg, col, fcol, fval, comp, exp, tol, base in specs:
        call = _AGG.get(agg, agg + "({c})").format(c=col)

        def measured(v):
            where = f" WHERE {fcol} = {lit(v)}" if fcol else ""
            # A value nobody has yields no row at all, so no count either.
            return f"(SELECT {call}::DOUBLE FROM {dataset}{where} HAVING count(*) > 0)"

        a, b = measured(fval), measured(base) if base else "NULL"
        seen = {"ratio": f"{a} / {b}", "pct_change": f"({a} - {b}) / {b} * 100"}.get(comp, a)
        test = {"gt": f"x > {exp}", "lt": f"x < {exp}"}.get(comp, f"abs(x - {exp}) <= {tol}")
        rows.append(
            f"SELECT '{claim}' AS claim_id, '{dataset}' AS dataset, round(x, 4) AS observed, x IS NOT NULL AS validated, coalesce({test}, false) AS passed, "
            f"CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN x IS NULL THEN 'No data for this claim' ELSE printf('{agg} of {col} is %.4f, claim says {comp} %.4f', round(x, 4), {exp}::DOUBLE) END AS explanation, "
            f"CASE WHEN x IS NULL THEN 'No matching rows in dataset' END AS error FROM (SELECT ({seen})::DOUBLE AS x)")
    return " UNION ALL ".join(rows)


def verdict_outputs(i):
    """Printed output around each document: a verdict, a verdict with gaps, no JSON, broken JSON."""
    d = F.col("doc_id")
    clean = F.regexp_replace("text", r"[{}]", " ")
    return i.table("documents").select(
        "doc_id",
        F.when(d % 4 == 0, F.concat(F.lit("log line\n"), F.to_json(F.struct((d % 8 == 0).alias("passed"), F.lit(0.75).alias("confidence"), F.col("text").alias("explanation"))), F.lit("\ndone")))
        .when(d % 4 == 1, F.concat(clean, F.lit('{"passed": true}')))
        .when(d % 4 == 2, clean)
        .otherwise(F.concat(F.lit("{oops "), clean, F.lit("}")))
        .alias("output"),
    )


def results(i):
    """Results of all claims: pass and confidence follow from length and class."""
    n = F.length("text")
    return routed(i).select(
        "doc_id", "claim_id", "result_class", (n % 3 != 0).alias("passed"), ((n % 97) / F.lit(97.0)).alias("confidence"))


CTES["results"] = (("claims",), "SELECT doc_id, claim_id, result_class, length(text) % 3 <> 0 AS passed, (length(text) % 97) / 97.0::DOUBLE AS confidence FROM claims")


def calls(i):
    """Model calls of known and unknown tasks, some with their own temperature."""
    names = F.array(*[F.lit(t[0]) for t in K.TASKS], F.lit("browser_link_ranking"))
    return i.table("events").select(
        "event_id", F.element_at(names, (F.col("event_id") % 8 + 1).cast("int")).alias("task"),
        F.when(F.col("event_id") % 5 == 0, F.lit(0.9)).alias("temperature_override"))


def errors(i):
    u = i.table("events")
    return u.select("event_id", F.when(F.col("user_id") % 6 == 0, F.concat(F.lit(" 503 "), "props")).when(
        F.col("user_id") % 6 == 1, F.concat(F.lit("403 Forbidden "), "props")).when(
        F.col("user_id") % 6 == 2, F.concat(F.lit("x RESOURCE_EXHAUSTED "), "props")).when(
        F.col("user_id") % 6 == 3, F.lit("")).otherwise(F.concat(F.lit("status 429 "), "props")).alias("error"))


def scored_twice(i):
    """Two runs with one answer cache: the second asks only for what failed in the first, and says so."""
    docs, cache = i.table("documents").select("doc_id", "text"), scratch_dir(i.spark, "cache")

    def model(run):
        def answer(batch):
            n = batch["text"].str.len()
            if run == "first" and (n % 7 == 0).any():
                raise ValueError("model overloaded")
            return batch.assign(n=n, asked_in=run, input_tokens=n)

        return answer

    one, two = (score(docs, model(run), ["text"], "n bigint, asked_in string", "length", cache=cache) for run in ("first", "second"))
    before = one.select("doc_id", F.col("error").alias("first_error"))
    return two.join(before, "doc_id").select("doc_id", "n", "asked_in", "input_tokens", "first_error", "error")


def validated(i):
    """The whole validation over the papers: rule claims, reviews, datasets, attempts and texts."""
    claims = materialize(mapped(i), "claims")
    docs = i.table("documents")
    found = claims.where(F.col("citation_id").isNull() & (F.col("claim_type") == "quantitative") & (F.col("doc_id") % 2 == 0)).select(
        "doc_id", "claim_id",
        F.struct(
            F.concat(F.lit("https://data.example.org/"), "doc_id").alias("source_url"), F.lit("data.gov").alias("source_type"),
            F.lit(0.7).alias("relevance_score"), F.col("claim_id").alias("found_by_claim_id"), F.lit(0).alias("reused_count"),
        ).alias("found_source"))
    bound = citations(i).select("doc_id", "citation_id").unionByName(
        found.select("doc_id", F.concat(F.lit("found_"), "claim_id").alias("citation_id")))
    attempts = bound.select(
        "doc_id", "citation_id", F.lit(1).alias("attempt_no"), F.concat(F.lit("https://m.example.org/"), "doc_id").alias("url"),
        F.lit("direct").alias("source"), (F.col("doc_id") % 3 != 0).alias("downloaded"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("403 Forbidden")).alias("error"))
    texts = citations(i).where(F.col("doc_id") % 3 == 1).join(docs, "doc_id").select("doc_id", "citation_id", F.col("text").alias("source_text"))
    checks = found.select(
        "doc_id", "claim_id", F.lit(True).alias("validated"), (F.col("doc_id") % 4 == 0).alias("passed"), F.lit(1.0).alias("confidence"),
        F.lit("measured").alias("explanation"), F.lit("d").alias("dataset"), F.lit(None).cast("string").alias("error"))

    def stub(batch):
        n = batch["text"].str.len()
        return batch.assign(plausible=n % 2 == 0, confidence=(n % 80) / 100.0, reasoning="by length")

    return runs.validate(claims, i.view("fact_reviews"), found, attempts, texts, checks, stub)


# ---- the checking side ----

_STOP = ", ".join(lit(w) for w in K.STOP_WORDS)
_UNI = f"list_filter(regexp_extract_all(lower({{x}}), {lit(K.WORD.replace('{', '{{').replace('}', '}}') + '{{2,}}')}), lambda w: w NOT IN ({_STOP}))"
_SPLIT = "list_concat(u, list_transform(range(1, greatest(len(u), 1)), lambda k: u[k] || ' ' || u[k + 1]))"


def _terms(x: str, source: str, keys: str) -> str:
    return f"SELECT {keys}, {_SPLIT} AS terms FROM (SELECT {keys}, {_UNI.format(x=x)} AS u FROM {source})"


CTES["doc_chunks"] = ((), char_chunks_of("documents", "doc_id", "text"))
CTES["doc_terms"] = (("doc_chunks",), _terms("chunk_text", "doc_chunks", "doc_id, chunk_no"))
CTES["all_sources"] = (
    (),
    "SELECT doc_id AS source_key, text AS source_text FROM documents UNION ALL SELECT -doc_id - 1, CASE WHEN doc_id % 2 = 0 THEN concat(' ', chr(10), ' ') ELSE 'The of. And a.' END FROM documents",
)
CTES["chunks"] = (("all_sources",), char_chunks_of("all_sources", "source_key", "source_text"))
CTES["chunk_terms"] = (("chunks",), _terms("chunk_text", "chunks", "source_key, chunk_no"))
CTES["pairs_0"] = (
    ("pairs_assigned",),
    "SELECT item_id AS claim_key, doc_id AS source_key FROM pairs_assigned UNION SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
)
CTES["pairs_1"] = (
    ("pairs_0",),
    "SELECT * FROM pairs_0 UNION ALL SELECT doc_id % 40, -doc_id - 1 FROM documents UNION ALL SELECT -1, -doc_id - 1 FROM documents",
)
CTES["claim_texts"] = ((), "SELECT item_id AS claim_key, text AS claim_text FROM benchmark UNION ALL SELECT -1, 'the of and'")
CTES["claim_terms"] = (("claim_texts",), _terms("claim_text", "claim_texts", "claim_key"))
# Each pair is fitted by itself: text 0 is the claim, the others are the chunks.
CTES["fit"] = (
    ("pairs_1", "claim_terms", "chunk_terms"),
    """SELECT claim_key, source_key, chunk_no, term, count(*) AS tf FROM (
 SELECT p.claim_key, p.source_key, -1 AS chunk_no, unnest(terms) AS term FROM pairs_1 p JOIN claim_terms c ON c.claim_key = p.claim_key
 UNION ALL SELECT p.claim_key, p.source_key, chunk_no, unnest(terms) FROM pairs_1 p JOIN chunk_terms t ON t.source_key = p.source_key) GROUP BY ALL""",
)
CTES["vocab"] = (
    ("fit",),
    f"""SELECT claim_key, source_key, term, cast(sum(tf) AS bigint) AS total, count(*) AS df FROM fit GROUP BY claim_key, source_key, term
QUALIFY row_number() OVER (PARTITION BY claim_key, source_key ORDER BY sum(tf) DESC, term) <= {K.VOCABULARY_SIZE}""",
)
CTES["sizes"] = (("chunks",), "SELECT source_key, count(*) AS n_chunks FROM chunks GROUP BY source_key")
CTES["idf"] = (
    ("vocab", "sizes"),
    "SELECT v.*, n_chunks, ln((2.0::DOUBLE + n_chunks) / (1.0::DOUBLE + df)) + 1.0 AS idf FROM vocab v JOIN sizes s ON s.source_key = v.source_key",
)
CTES["weights"] = (
    ("fit", "idf"),
    "SELECT f.claim_key, f.source_key, chunk_no, f.term, tf * idf AS w FROM fit f JOIN idf i ON i.claim_key = f.claim_key AND i.source_key = f.source_key AND i.term = f.term",
)
CTES["cosines"] = (
    ("weights",),
    """SELECT c.claim_key, c.source_key, c.chunk_no, sum(c.w * q.w) / (any_value(qn.n) * any_value(cn.n)) AS score
FROM (SELECT * FROM weights WHERE chunk_no >= 0) c JOIN (SELECT * FROM weights WHERE chunk_no = -1) q ON q.claim_key = c.claim_key AND q.source_key = c.source_key AND q.term = c.term
JOIN (SELECT claim_key, source_key, sqrt(sum(w * w)) AS n FROM weights WHERE chunk_no = -1 GROUP BY ALL) qn ON qn.claim_key = c.claim_key AND qn.source_key = c.source_key
JOIN (SELECT claim_key, source_key, chunk_no, sqrt(sum(w * w)) AS n FROM weights WHERE chunk_no >= 0 GROUP BY ALL) cn ON cn.claim_key = c.claim_key AND cn.source_key = c.source_key AND cn.chunk_no = c.chunk_no
GROUP BY c.claim_key, c.source_key, c.chunk_no""",
)
CTES["topk"] = (
    ("cosines",),
    f"""SELECT *, row_number() OVER (PARTITION BY claim_key, source_key ORDER BY round(score, 9) DESC, chunk_no) AS rank FROM cosines
WHERE score >= {K.MIN_SIMILARITY} QUALIFY rank <= {K.EVIDENCE_TOP_K}""",
)
CTES["spare"] = (
    ("pairs_1", "fit", "chunks"),
    """SELECT p.claim_key, p.source_key, c.chunk_no, 0.5::DOUBLE AS score, c.chunk_no + 1 AS rank FROM pairs_1 p JOIN chunks c ON c.source_key = p.source_key AND c.chunk_no < 3
WHERE NOT EXISTS (SELECT 1 FROM fit f WHERE f.claim_key = p.claim_key AND f.source_key = p.source_key)""",
)
CTES["evidence"] = (
    ("topk", "spare", "chunks"),
    """SELECT e.*, chunk_text FROM (SELECT claim_key, source_key, chunk_no, score, rank FROM topk UNION ALL SELECT * FROM spare) e
JOIN chunks c ON c.source_key = e.source_key AND c.chunk_no = e.chunk_no""",
)
CTES["found"] = (
    ("pairs_1", "sizes", "evidence"),
    """SELECT p.claim_key, p.source_key, excerpts, best_score, best_chunk, n_chunks_found,
 CASE WHEN n_chunks IS NULL THEN 'empty_source' WHEN best_score IS NULL THEN 'nothing_relevant' ELSE 'evidence' END AS outcome,
 CASE WHEN n_chunks IS NULL THEN 'Source text is empty or could not be chunked' WHEN best_score IS NULL THEN 'No relevant chunks found in source' END AS explanation,
 CASE WHEN n_chunks IS NULL THEN 'No content to validate against' WHEN best_score IS NULL THEN 'Low similarity scores' END AS error
FROM pairs_1 p LEFT JOIN sizes s ON s.source_key = p.source_key LEFT JOIN (
 SELECT claim_key, source_key, string_agg(concat('[Chunk ', rank, ', similarity=', printf('%.2f', score), ']:', chr(10), chunk_text), chr(10) || chr(10) ORDER BY rank) AS excerpts,
  max(score) AS best_score, arg_min(chunk_text, rank) AS best_chunk, count(*) AS n_chunks_found FROM evidence GROUP BY ALL) e ON e.claim_key = p.claim_key AND e.source_key = p.source_key""",
)
CTES["verdicts"] = (
    ("found",),
    """SELECT claim_key, source_key, outcome, error, outcome = 'evidence' AND round(best_score, 9) >= 0.5 AS passed, CASE WHEN outcome = 'evidence' THEN least(best_score, 1.0) ELSE 0.0 END AS confidence,
 CASE WHEN outcome = 'evidence' THEN printf('Best excerpt has similarity %.2f with the claim', best_score) ELSE explanation END AS explanation,
 CASE WHEN outcome = 'evidence' AND round(best_score, 9) >= 0.5 THEN best_chunk ELSE '' END AS quotes FROM found""",
)

QUERIES = {
    "terms": (terms, oracle("SELECT doc_id, chunk_no, array_to_string(list_sort(terms), '|') AS terms FROM doc_terms", "doc_terms")),
    "term_freq": (
        term_freq,
        oracle(
            """SELECT doc_id, chunk_no, count(*) AS n_terms, array_to_string(list_sort(list(concat(term, ':', tf))), '|') AS terms FROM (
 SELECT doc_id, chunk_no, term, count(*) AS tf FROM (SELECT doc_id, chunk_no, unnest(terms) AS term FROM doc_terms) GROUP BY ALL) GROUP BY doc_id, chunk_no""",
            "doc_terms",
        ),
    ),
    "vocab_cap": (
        vocab_cap,
        oracle(
            """SELECT claim_key, source_key, count(*) AS n_terms, array_to_string(list_sort(list(concat(term, ':', total))), '|') AS terms
FROM vocab WHERE source_key >= 0 GROUP BY claim_key, source_key""",
            "vocab",
        ),
    ),
    "idf_weight": (
        idf_weight,
        oracle(
            """SELECT claim_key, source_key, count(*) AS n_terms, round(sum(idf), 6) AS sum_idf, round(max(idf), 6) AS max_idf, round(sum(idf * total), 6) AS weighted
FROM idf WHERE source_key >= 0 GROUP BY claim_key, source_key""",
            "idf",
        ),
    ),
    "cosine_topk": (
        cosine_topk,
        oracle("SELECT claim_key, source_key, chunk_no, round(score, 6) AS score, rank FROM topk WHERE source_key >= 0", "topk"),
    ),
    "retrieval_fallback": (fallback, oracle("SELECT * FROM spare", "spare")),
    "retrieval_outcome": (
        lambda i: outcome(i).select("claim_key", "source_key", "outcome", "explanation", "error", F.round("best_score", 6).alias("best_score")),
        oracle("SELECT claim_key, source_key, outcome, explanation, error, round(best_score, 6) AS best_score FROM found", "found"),
    ),
    "evidence_prompt": (
        lambda i: R.evidence_prompt(retrieved(i)[2]).select("claim_key", "source_key", "excerpts", "n_chunks_found"),
        oracle("SELECT claim_key, source_key, excerpts, n_chunks_found FROM found WHERE excerpts IS NOT NULL", "found"),
    ),
    "grounded_verdict": (
        lambda i: verdict(i).select(
            "claim_key", "source_key", "outcome", "passed", F.round("confidence", 6).alias("confidence"), "explanation",
            F.array_join("supporting_quotes", "|").alias("quotes")),
        oracle("SELECT claim_key, source_key, outcome, passed, round(confidence, 6) AS confidence, explanation, quotes FROM verdicts", "verdicts"),
    ),
    "qualitative_result": (
        lambda i: qualitative(i).select(
            "doc_id", "claim_id", "validated", "validation_method", "passed", F.round("confidence", 6).alias("confidence"), "explanation", "errors"),
        oracle(
            """SELECT source_key AS doc_id, cast(claim_key AS varchar) AS claim_id, outcome = 'empty_source' OR error IS NULL AS validated, CASE outcome WHEN 'empty_source' THEN 'llm_check' ELSE 'rag_search' END AS validation_method,
 CASE outcome WHEN 'empty_source' THEN length(cast(claim_key AS varchar)) % 2 = 0 ELSE passed END AS passed, CASE outcome WHEN 'empty_source' THEN length(cast(claim_key AS varchar)) / 10.0::DOUBLE ELSE round(confidence, 6) END AS confidence,
 CASE outcome WHEN 'empty_source' THEN 'by length' ELSE explanation END AS explanation, CASE WHEN outcome <> 'empty_source' THEN error END AS errors FROM verdicts""",
            "verdicts",
        ),
    ),
    "score_cached": (
        scored_twice,
        """SELECT doc_id, length(text) AS n, CASE WHEN length(text) % 7 = 0 THEN 'second' ELSE 'first' END AS asked_in, CASE WHEN length(text) % 7 = 0 THEN length(text) ELSE 0 END AS input_tokens,
 CASE WHEN length(text) % 7 = 0 THEN 'model overloaded' END AS first_error, NULL::VARCHAR AS error FROM documents""",
    ),
    "quant_check": (lambda i: checked(i, SPECS), _check_sql(SPECS)),
    "quant_compare_claims": (lambda i: checked(i, RELATIVE), _check_sql(RELATIVE)),
    "quantitative_result": (
        lambda i: _quant_results(i),
        f"SELECT claim_id, 'quantitative' AS claim_type, validated, 'table_check' AS validation_method, passed, confidence, dataset AS source, error AS errors FROM ({_check_sql(SPECS + RELATIVE)})",
    ),
    "parse_verdict_text": (
        lambda i: verdicts.parse_verdict_text(verdict_outputs(i)).select("doc_id", "validated", "passed", "confidence", "explanation", F.substring_index("error", ". Output", 1).alias("error")),
        """SELECT doc_id, doc_id % 4 < 2 AS validated, CASE doc_id % 4 WHEN 0 THEN doc_id % 8 = 0 WHEN 1 THEN true ELSE false END AS passed,
 CASE doc_id % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'No explanation provided' ELSE 'Failed to parse script output' END AS explanation,
 CASE doc_id % 4 WHEN 2 THEN 'Parse error: No JSON output found' WHEN 3 THEN 'Parse error: Invalid JSON' END AS error FROM documents""",
    ),
    "result_stats": (
        lambda i: reporting.result_stats(results(i)),
        oracle(
            """SELECT c AS result_class, count(claim_id) AS count, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, round(avg(confidence), 3) AS avg_confidence
FROM (SELECT unnest(['qualitative_uncited', 'quantitative_uncited', 'qualitative_cited', 'quantitative_cited']) AS c) LEFT JOIN results ON result_class = c GROUP BY c""",
            "results",
        ),
    ),
    "run_summary": (
        lambda i: reporting.run_summary(routed(i), results(i)),
        oracle(
            """SELECT CASE grouping(doc_id, result_class) WHEN 0 THEN 'paper' WHEN 2 THEN 'class' ELSE 'corpus' END AS level, doc_id, result_class, count(*) AS input_claims, count(*) AS count,
 count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, round(avg(confidence), 3) AS avg_confidence
FROM results GROUP BY GROUPING SETS ((doc_id, result_class), (result_class), ())""",
            "results",
        ),
    ),
    "token_cost": (
        lambda i: _rounded_cost(reporting.token_cost(i.view("usage"), ["task"])),
        oracle(
            """SELECT task, cast(sum(input_tokens) AS bigint) AS input_tokens, cast(sum(output_tokens) AS bigint) AS output_tokens, cast(sum(input_tokens + output_tokens) AS bigint) AS total_tokens,
 round(sum(input_tokens) / 1e6 * 0.1, 8) AS input_cost, round(sum(output_tokens) / 1e6 * 0.4, 8) AS output_cost, round(sum(input_tokens) / 1e6 * 0.1 + sum(output_tokens) / 1e6 * 0.4, 8) AS total_cost FROM usage GROUP BY task""",
            "usage",
        ),
    ),
    "task_routing": (
        lambda i: reporting.task_routing(calls(i)).select("event_id", "task", "config_task", "model", "temperature", "escalate_to"),
        """SELECT event_id, task, config_task, model, coalesce(CASE WHEN event_id % 5 = 0 THEN 0.9 END, t)::DOUBLE AS temperature, escalate_to
FROM (SELECT event_id, ['claim_extraction', 'reference_parsing', 'plausibility_check', 'source_grounded_verification', 'quant_script_generation', 'dataset_reuse_decision', 'generic', 'browser_link_ranking'][event_id % 8 + 1] AS task FROM events) e
JOIN (VALUES """ + ", ".join(
            f"('{n}', '{c[0]}', '{c[1]}', {c[4]}, {lit(c[6]) if c[6] else 'NULL'})"
            for n, c in [(c[0], c) for c in K.TASKS] + [("browser_link_ranking", K.TASKS[-1])]
        ) + ") k(name, config_task, model, t, escalate_to) ON name = task",
    ),
    "transient_error": (
        lambda i: reporting.transient_error(errors(i)),
        """SELECT event_id, CASE user_id % 6 WHEN 0 THEN concat(' 503 ', props) WHEN 1 THEN concat('403 Forbidden ', props) WHEN 2 THEN concat('x RESOURCE_EXHAUSTED ', props) WHEN 3 THEN '' ELSE concat('status 429 ', props) END AS error,
 user_id % 6 IN (0, 2) AS is_transient FROM events""",
    ),
    "validate_run": (
        lambda i: validated(i).stats,
        None,
    ),
}


def _quant_results(i):
    checks = checked(i, SPECS + RELATIVE)
    claims = checks.select("claim_id", F.lit("quantitative").alias("claim_type"))
    return verdicts.quantitative_result(claims, checks).select(
        "claim_id", "claim_type", "validated", "validation_method", "passed", "confidence",
        F.element_at("sources_used", 1).alias("source"), "errors")


def _rounded_cost(df):
    return df.withColumns({c: F.round(c, 8) for c in ("input_cost", "output_cost", "total_cost")})
