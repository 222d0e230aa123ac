"""Structure of conversations: faults, and the cheapest repair by depth-first branch-and-bound.

A repaired conversation reads ``(s?(ua)+)?`` by the initials of its roles. Each
row is kept, given another role or deleted, and rows without text may be put in
anywhere. The search walks an explicit stack of prefixes. A lower bound for
every suffix cuts off prefixes that cannot beat the incumbent, a pair (cost,
audit); a table for each node, a place in the rows and a state of the pattern,
drops prefixes that a cheaper or equally cheap and earlier one dominates. It
ends when the stack is empty: then the incumbent is proved best.

Rows are sorted by conversation and turn in ranges, which move each row once. A
range finishes the conversations within it and hands on those at its two ends.
A conversation is searched in blocks of ``BLOCK`` rows: the best (cost, audit) from each state to each
state. Blocks combine associatively, inside a task and, where a conversation
reaches over several ranges, between tasks, so none has to fit in one task. Only
the digest of the repaired text runs through such a conversation row by row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evidence.llm.common import SPACE
from evidence.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows searched at a time; the search grows faster than its rows (1 ms for 16, 10 ms for 28), so longer conversations are joined from blocks.
BLOCK = 16
#: Rows of a batch that are Python objects at a time.
ROWS = 512
LEGAL = {"su", "ua", "au"}
#: States by what came last: nothing, s, u, a. What may be kept, and the one role that may be given or put in.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
GIVEN = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
DONE = (0, 3)
WORDY = re.compile(rf"[^{SPACE}]")
ENDED = re.compile(rf"[.!?][{SPACE}]*\Z")

#: A row to be searched: (initial of its role, truncated), or the number of rows that must be deleted.
Item = tuple[str, bool] | int
#: Best ways between states: (from, to) -> (cost, audit).
Ways = dict[tuple[int, int], tuple[int, str]]


def bounds(items: list[Item]) -> list[int]:
    """For every suffix a cost that no repair of it stays under.

    Rows that must go cost their deletion, truncated ones what keeping them
    adds, roles that are never legal an edit. Neighbours that may not follow
    each other need an edit more; disjoint such pairs add up, and the best choice
    of them is taken.
    """
    base, pairs, one, two, after = 0, [0], 0, 0, None
    total = [0]
    for item in reversed(items):
        if isinstance(item, int):
            base += DELETE * item
        else:
            initial, cut = item
            odd = initial not in ("s", "u", "a")
            base += min(DELETE, REROLE + TRUNCATED) if odd and cut else REROLE if odd else TRUNCATED if cut else 0
            extra = 0
            if after and not odd and after[0] in ("s", "u", "a") and initial + after[0] not in LEGAL:
                extra = DELETE - TRUNCATED if cut or after[1] else min(INSERT, REROLE)
            one, two, after = max(one, two + extra), one, item
        total.append(base + one)
    return total[::-1]


def search(items: list[Item], entry: int, goals: list[tuple[int, ...]]) -> list[tuple[int, str, int] | None]:
    """For each goal, a set of last states, the least (cost, audit) from ``entry`` through all items, and its last state."""
    n, rest = len(items), bounds(items)
    found: list[tuple[int, str, int] | None] = [None] * len(goals)
    table: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    table[0][entry] = (0, "")
    stack = [(0, entry, 0, "")]
    while stack:
        i, q, cost, audit = stack.pop()
        if table[i][q] != (cost, audit):
            continue  # dominated since it was put there
        least = cost + rest[i]
        if all(f and (least > f[0] or (least == f[0] and audit > f[1][: len(audit)])) for f in found):
            continue
        if i == n:
            for k, goal in enumerate(goals):
                if q in goal and (found[k] is None or (cost, audit) < found[k][:2]):
                    found[k] = (cost, audit, q)
        nodes = [(i, GIVEN[q], cost + INSERT, audit + "I")]
        if i < n:
            item = items[i]
            if isinstance(item, int):
                nodes.append((i + 1, q, cost + DELETE * item, audit + "D" * item))
            else:
                more = cost + TRUNCATED * item[1]
                nodes += [(i + 1, q, cost + DELETE, audit + "D"), (i + 1, GIVEN[q], more + REROLE, audit + "R")]
                if (q, item[0]) in KEPT:
                    nodes.append((i + 1, KEPT[q, item[0]], more + KEEP, audit + "K"))
        nodes.sort(key=lambda x: (x[2] + rest[x[0]], x[3]), reverse=True)
        for node in nodes:
            at, known = node[:2], table[node[0]].get(node[1])
            if known is None or node[2:] < known:
                table[at[0]][at[1]] = node[2:]
                stack.append(node)
    return found


def ways(items: list[Item]) -> Ways:
    """The best ways through a block between any two states."""
    made = {}
    for entry in range(4):
        for leave, found in enumerate(search(items, entry, [(0,), (1,), (2,), (3,)])):
            if found:
                made[entry, leave] = found[:2]
    return made


def joined(a: Ways, b: Ways) -> Ways:
    """Ways through two neighbouring blocks.

    Of equal cost neither audit of one and the same rows begins with the other,
    so the least audit of the whole has the least ones of the parts.
    """
    made: Ways = {}
    for (p, q), (c, x) in a.items():
        for (r, s), (d, y) in b.items():
            if q == r and ((p, s) not in made or (c + d, x + y) < made[p, s]):
                made[p, s] = (c + d, x + y)
    return made


def folded(parts: list[Ways]) -> Ways:
    while len(parts) > 1:
        parts = [joined(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def best_of(through: Ways) -> tuple[int, str]:
    return min(through[0, q] for q in DONE if (0, q) in through)


class Spelling:
    """Digest of a repaired conversation, row by row as the audit says."""

    def __init__(self):
        self.digest, self.state, self.begun = hashlib.sha256(), 0, False
        self.audit, self.at = "", 0

    def put(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) * self.begun}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.begun = True

    def follow(self, audit: str) -> None:
        """The edits of the next part; those of the part before have been used up."""
        self.finish()
        self.audit, self.at = audit, 0

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = GIVEN[self.state]
            self.put(ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state, role[:1]]
            self.put(role, text)
        elif edit == "R":
            self.state = GIVEN[self.state]
            self.put(ROLE[self.state], text)

    def finish(self) -> None:
        self.insert()


class Part:
    """What one range holds of a conversation."""

    def __init__(self):
        self.items: list[Item] = []
        self.blocks: list[Ways] = []
        self.rows: list[tuple[str, str]] = []
        self.seen: set = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None  # initials of roles
        self.low = self.high = None  # turns

    def add(self, turn, role: str, text: str, earlier: bool = False, keep: bool = True) -> None:
        initial, key = role[:1], hashlib.sha256(f"{role}\0{text}".encode("utf-8", "surrogatepass")).digest()
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        blank = not WORDY.search(text)
        again = not blank and (earlier or key in self.seen)
        self.blank += blank
        self.duplicate += again
        if blank or again:  # rows that must go are one item as long as no other comes between
            if self.items and isinstance(self.items[-1], int):
                self.items[-1] += 1
            else:
                self.items.append(1)
        else:
            cut = not ENDED.search(text)
            self.truncated += cut
            self.items.append((initial, cut))
        self.seen.add(key)
        if keep:
            self.rows.append((role, text))
        if len(self.items) >= BLOCK:
            self.blocks.append(ways(self.items))
            self.items = []

    def through(self) -> Ways:
        return folded([*self.blocks, ways(self.items)] if self.items or not self.blocks else self.blocks)

    def best(self) -> tuple[int, str]:
        if self.blocks:
            return best_of(self.through())
        return search(self.items, 0, [DONE])[0][:2]


ORDER = ("conv", "turn", "role", "digest", "salt")
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
PART = "slot int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, first string, last string, froms array<int>, tos array<int>, costs array<bigint>, audits array<string>"


def _rows_of(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)


def _result(conv, part: Part) -> dict:
    """The row of a whole conversation."""
    cost, audit = part.best()
    spelling = Spelling()
    spelling.follow(audit)
    for row in part.rows:
        spelling.row(*row)
    spelling.finish()
    return {
        "conv": conv, "gaps": part.high - part.low + 1 - part.turns if part.low is not None else 0,
        "blank": part.blank, "duplicate": part.duplicate, "truncated": part.truncated, "illegal": part.illegal,
        "cost": cost, "audit": audit, "repaired_sha256": spelling.digest.hexdigest(),
    }


def _sweeping(schema: pa.Schema):
    """Sorted rows of a range to results of the conversations within it.

    The first and the last one may go on in a neighbouring range: their rows
    are handed on as they are, the first one's without holding them.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, part, held, made = None, True, Part(), [], []
        for batch in batches:
            for row in _rows_of(batch, [*ORDER, "text", "_slot"]):
                conv, turn, role, _, _, text, _ = row
                if at is None:
                    at = (conv,)
                elif conv != at[0]:
                    if not first:
                        made.append(_result(at[0], part))
                    at, first, part, held = (conv,), False, Part(), []
                if first:
                    made.append(dict(zip((*ORDER, "text", "_slot"), row, strict=True)))
                else:
                    part.add(turn, role, text)
                    held.append(row)
                if len(made) >= ROWS:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
                    made = []
        made += [dict(zip((*ORDER, "text", "_slot"), row, strict=True)) for row in held]
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return compute


def _summing(schema: pa.Schema):
    """Sorted rows of conversations at the ends of ranges: a result, or of those in several ranges what this one holds."""

    def close(conv, slot, wide, part: Part) -> dict:
        if not wide:
            return _result(conv, part)
        through = part.through()
        states = sorted(through)
        return {
            "conv": conv, "slot": slot, "blank": part.blank, "duplicate": part.duplicate, "truncated": part.truncated, "illegal": part.illegal,
            "turns": part.turns, "low": part.low, "high": part.high, "first": part.first, "last": part.last,
            "froms": [s[0] for s in states], "tos": [s[1] for s in states],
            "costs": [through[s][0] for s in states], "audits": [through[s][1] for s in states],
        }

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, Part()
        for batch in batches:
            made = []
            for slot, conv, turn, role, text, wide, earlier in _rows_of(batch, ["_slot", "conv", "turn", "role", "text", "wide", "earlier"]):
                if (slot, conv, wide) != at:
                    if at is not None:
                        made.append(close(at[1], at[0], at[2], part))
                    at, part = (slot, conv, wide), Part()
                part.add(turn, role, text, earlier, not wide)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([close(at[1], at[0], at[2], part)], schema=schema)

    return compute


def _chosen(parts: pd.DataFrame) -> pd.DataFrame:
    """The parts of one wide conversation, at most one for each range: its counts, and the edits of every part."""
    parts = parts.sort_values("slot")
    through = [
        {(int(p), int(q)): (int(c), a) for p, q, c, a in zip(r.froms, r.tos, r.costs, r.audits, strict=True)} for r in parts.itertuples()
    ]
    reach: dict[int, tuple[int, str, tuple[str, ...]]] = {0: (0, "", ())}
    for w in through:
        here: dict[int, tuple[int, str, tuple[str, ...]]] = {}
        for (p, q), (c, a) in w.items():
            if p in reach:
                way = (reach[p][0] + c, reach[p][1] + a, (*reach[p][2], a))
                if q not in here or way[:2] < here[q][:2]:
                    here[q] = way
        reach = here
    cost, _, audits = min(reach[q] for q in DONE if q in reach)
    illegal, turns, last, high = 0, 0, None, None
    for r in parts.itertuples():
        illegal += int(r.illegal) + (last is not None and last + r.first not in LEGAL)
        last = r.last
        if r.turns:
            turns += int(r.turns) - (high is not None and r.low == high)
            high = r.high
    low, high = parts["low"].min(), parts["high"].max()
    gaps = int(high) - int(low) + 1 - turns if turns else 0
    n = len(parts)
    return pd.DataFrame({
        "conv": parts["conv"], "slot": parts["slot"], "gaps": [gaps] * n, "blank": [int(parts["blank"].sum())] * n,
        "duplicate": [int(parts["duplicate"].sum())] * n, "truncated": [int(parts["truncated"].sum())] * n, "illegal": [illegal] * n,
        "cost": [cost] * n, "audit": list(audits),
    })


def _spelling(schema: pa.Schema):
    """Rows of wide conversations in order, each part led by its edits, to the digest of each."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, spelling, begun = None, Spelling(), False
        for batch in batches:
            made = []
            for conv, audit, role, text in _rows_of(batch, ["conv", "audit", "role", "text"]):
                if begun and conv != at:
                    spelling.finish()
                    made.append({"conv": at, "repaired_sha256": spelling.digest.hexdigest()})
                    spelling = Spelling()
                at, begun = conv, True
                if audit is not None:
                    spelling.follow(audit)
                else:
                    spelling.row(role, text)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=schema)
        if begun:
            spelling.finish()
            yield pa.RecordBatch.from_pylist([{"conv": at, "repaired_sha256": spelling.digest.hexdigest()}], schema=schema)

    return compute


def _arrow(df: DataFrame, more: str) -> tuple[pa.Schema, str]:
    kind = f"conv {df.schema['conv'].dataType.simpleString()}, {more}"
    return to_arrow_schema(df.sparkSession.createDataFrame([], kind).schema), kind


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Rows are taken by turn, nulls first, then by role and digest of the text;
    repeated rows are neighbours. A null role or text is one space. Rows
    without a conversation id are one conversation, whose id is null. Every
    row's first fault counts: blank, seen earlier, or not ended. ``gaps`` are
    the turns missing between the first and the last, ``illegal`` the neighbours
    whose roles may not follow each other. ``audit`` lists the edits of the
    cheapest repair (K, R, D, I), the ASCII-least of equal ones. An empty table
    gives no rows; other columns are not read.
    """
    plain = rows.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    # The salt parts rows that are alike in all, however many, over ranges.
    plain = plain.withColumns({"digest": F.md5("text"), "salt": F.xxhash64(F.monotonically_increasing_id())})
    ranges = plain.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("_slot", F.spark_partition_id())
    schema, kind = _arrow(plain, f"{RESULT}, turn bigint, role string, digest string, salt bigint, text string, _slot int")
    swept = materialize(ranges.mapInArrow(_sweeping(schema), kind), "swept")
    names = [x.split()[0] for x in RESULT.split(", ")]
    within = swept.where("_slot IS NULL").select(F.col("conv").alias("conv_id"), *names)
    table = swept.where("_slot IS NOT NULL").select(*ORDER, "text", "_slot")  # at most two conversations of each range
    spans = table.groupBy("conv").agg(F.min("_slot").alias("_low"), F.max("_slot").alias("_high")).where("_low < _high").select(F.col("conv").alias("_conv"))
    spans = materialize(spans, "wide")  # at most one for each range
    wide = table.join(F.broadcast(spans), F.col("conv").eqNullSafe(F.col("_conv")), "left_semi")
    keys = wide.groupBy("conv", "role", "digest", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    first = keys.groupBy("conv", "role", "digest").agg(F.min("_slot").alias("_first")).select(
        *[F.col(c).alias(f"_{c}") for c in ("conv", "role", "digest")], "_first")
    same = lambda *names: [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    again = keys.join(first, same("conv", "role", "digest")).where("_slot > _first").select(
        "_conv", "_role", "_digest", F.col("_slot").alias("_in"), F.lit(True).alias("earlier"))  # texts that an earlier range holds
    flagged = (
        table.join(F.broadcast(spans.withColumn("wide", F.lit(True))), F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")
        .join(again, [*same("conv", "role", "digest"), F.col("_slot") == F.col("_in")], "left")
        .select(*ORDER, "text", "_slot", F.coalesce("wide", F.lit(False)).alias("wide"), F.coalesce("earlier", F.lit(False)).alias("earlier"))
    )
    ordered = flagged.repartition("_slot").sortWithinPartitions("_slot", *ORDER)
    schema, kind = _arrow(table, f"{RESULT}, " + ", ".join(x for x in PART.split(", ") if x not in RESULT.split(", ")))
    parts = materialize(ordered.mapInArrow(_summing(schema), kind), "parts")
    whole = within.unionByName(parts.where("slot IS NULL").select(F.col("conv").alias("conv_id"), *names))
    edits_kind = f"conv {table.schema['conv'].dataType.simpleString()}, slot int, " + RESULT.removesuffix(", repaired_sha256 string")
    edits = parts.where("slot IS NOT NULL").select("conv", *[x.split()[0] for x in PART.split(", ")]).groupBy("conv").applyInPandas(_chosen, edits_kind)
    edits = materialize(edits, "edits")
    lines = edits.select("conv", F.col("slot").alias("_slot"), F.lit(0).alias("_kind"), "audit").unionByName(
        wide.select(*ORDER, "_slot", F.lit(1).alias("_kind"), "text"), allowMissingColumns=True)
    schema, kind = _arrow(table, "repaired_sha256 string")
    spelled = lines.repartition("conv").sortWithinPartitions("conv", "_slot", "_kind", *ORDER[1:]).select("conv", "audit", "role", "text")
    digests = spelled.mapInArrow(_spelling(schema), kind).select(F.col("conv").alias("_conv"), "repaired_sha256")
    totals = edits.groupBy("conv", *names[:6]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    long = totals.join(digests, F.col("conv").eqNullSafe(F.col("_conv"))).select(F.col("conv").alias("conv_id"), *names)
    return whole.unionByName(long)


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults put in by a hash of ``conv_id:turn``: dropped, emptied, without end marks, repeated, or of role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_id), F.lit(":"), said(turn)).cast("binary")) % 20
    plain = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), kind.alias("_kind"))
    changed = plain.where("_kind <> 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
    )
    return changed.drop("_copy")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """``repair`` of damaged conversations, with a row of zeros for those that lost all their rows."""
    found = repair(damage(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in zero], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
