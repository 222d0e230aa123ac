"""Repairs against enumeration of all edits, and whole tables against a plain program."""

import hashlib
import itertools
import random
import re
import zlib

from evidence.llm import repair as R

FOLDER = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")


def every_way(items):
    """All edits of a few rows, with up to two rows put in at each place: least (cost, audit)."""
    choices = []
    for item in items:
        if isinstance(item, int):
            choices.append([("D" * item, "", 4 * item)])
        else:
            cut = 3 * item[1]
            choices.append([("D", "", 4), ("K", item[0], cut), ("R", "u", 3 + cut), ("R", "a", 3 + cut)])
        choices.append([("", "", 0), ("I", "u", 3), ("I", "a", 3), ("II", "ua", 6), ("II", "au", 6)])
    first = [("", "", 0), ("I", "u", 3), ("I", "a", 3), ("II", "ua", 6), ("II", "au", 6)]
    found = []
    for way in itertools.product(first, *choices):
        if GOOD.fullmatch("".join(w[1] for w in way)):
            found.append((sum(w[2] for w in way), "".join(w[0] for w in way)))
    return min(found)


def test_search_finds_the_least_of_all_ways():
    pick = random.Random(3)
    for _ in range(60):
        items = [pick.choice([("u", False), ("a", False), ("s", False), ("u", True), ("a", True), ("x", False), ("x", True), 1, 2]) for _ in range(pick.randint(0, 3))]
        assert R.search(items, 0, [R.DONE])[0][:2] == every_way(items), items


def plain_search(items):
    """Every state with its least (cost, audit), row by row."""
    here = {0: (0, "")}
    for item in [*items, None]:
        for _ in range(4):
            for q, (c, a) in list(here.items()):
                to = {0: 2, 1: 2, 2: 3, 3: 2}[q]
                here[to] = min(here.get(to, (10**9, "")), (c + 3, a + "I"))
        if item is None:
            break
        new = {}
        for q, (c, a) in here.items():
            ways = [(q, c + 4 * item, a + "D" * item)] if isinstance(item, int) else [
                (q, c + 4, a + "D"), ({0: 2, 1: 2, 2: 3, 3: 2}[q], c + 3 + 3 * item[1], a + "R")]
            if not isinstance(item, int):
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(item[0], {}).get(q)
                if to:
                    ways.append((to, c + 3 * item[1], a + "K"))
            for to, cost, audit in ways:
                new[to] = min(new.get(to, (10**9, "")), (cost, audit))
        here = new
    return min(here[q] for q in (0, 3) if q in here)


def random_items(pick, n):
    return [pick.choice([("u", False), ("a", False), ("u", True), ("a", True), ("s", False), ("x", False), 1, 3]) for _ in range(n)]


def test_bounds_never_exceed_the_cost():
    pick = random.Random(4)
    for _ in range(300):
        items = random_items(pick, pick.randint(0, 14))
        want = plain_search(items)
        assert R.bounds(items)[0] <= want[0]
        assert R.search(items, 0, [R.DONE])[0][:2] == want


def test_long_rows_and_blocks():
    pick = random.Random(5)
    for n in (14, 40, 400, 1500):
        items = random_items(pick, n)
        want = plain_search(items)
        blocks = [R.ways(items[k : k + 13]) for k in range(0, n, 13)]
        assert R.best_of(R.folded(blocks)) == want


def expected(rows):
    """A plain program over (turn, role, text) rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, items, blank, duplicate, cut = set(), [], 0, 0, 0
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not body:
            blank += 1
            items.append(1)
        elif (role, text) in seen:
            duplicate += 1
            items.append(1)
        else:
            cut += body[-1] not in ".!?"
            items.append((role[:1], body[-1] not in ".!?"))
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = [r[0] for r in rows if r[0] is not None]
    cost, audit = plain_search(items)
    lines, state, k = [], 0, 0
    for edit in audit:
        if edit == "K":
            state = {"s": 1, "u": 2, "a": 3}[rows[k][1][:1]]
            lines.append(f"{rows[k][1]}:{rows[k][2]}")
        elif edit in "RI":
            state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            lines.append(("user:" if state == 2 else "assistant:") + (rows[k][2] if edit == "R" else ""))
        k += edit != "I"
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, blank, duplicate, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def grouped(rows):
    made = {}
    for conv, turn, role, text in rows:
        made.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: expected(r) for c, r in made.items()}


def result(df):
    found = df.collect()
    made = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in found}
    assert len(made) == len(found)
    return made


def test_whole_table(spark):
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    damaged, all_ids = [], set()
    for r in table.collect():
        all_ids.add(r.conv_id)
        role, text = (" " if x is None else x for x in (r.role, r.text))
        kind = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [(r.conv_id, r.turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = grouped(damaged)
    want |= {c: expected([]) for c in all_ids - set(want)}
    assert result(R.repair_damaged(table)) == want


def test_odd_rows_and_a_conversation_over_all_ranges(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    pick = random.Random(6)
    texts = ["One.", "Two!", "three", " ", "", None, "Ünë?", "four. \n", "five" * 50 + "."]
    rows = [(9, pick.choice([None, *range(400)]), pick.choice(["user", "assistant", "system", None, "", "tool"]), pick.choice(texts) and pick.choice(texts)) for _ in range(900)]
    rows += [(9, t, pick.choice(["user", "assistant"]), f"text {t}.") for t in range(0, 400, 2)]
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (1, None, "user", "x."), (1, None, "user", "x."), (2, -5, None, None), (3, 7, "assistant", "z.")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string, copies string").repartition(5)
    key = "spark.sql.adaptive.enabled"
    spark.conf.set(key, "false")  # keeps the ranges apart, small as they are
    try:
        assert result(R.repair(df)) == grouped(rows)
    finally:
        spark.conf.set(key, "true")
    assert result(R.repair(df)) == grouped(rows)
    assert R.repair(df.limit(0)).count() == 0 and R.repair_damaged(df.limit(0)).count() == 0
