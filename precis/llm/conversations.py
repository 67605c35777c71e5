"""Repair of conversation structure at least cost, by Hirschberg's divide and conquer.

A repaired conversation has the role initials ``(s?(ua)+)?``. Four states say what stands already: nothing, a system
turn, a user turn last, an assistant turn last. Each row is kept, given another role or deleted, and turns without text
are inserted; a row is one step of a shortest path over the four states. The path is found in linear space: the vector of
four forward costs and the vector of four backward costs meet in the middle of the rows; of the crossings that are
cheapest in sum the one with the ASCII-least edits is taken, and both halves are solved alone.

Two partial edit strings of equal cost over the same rows are never one the start of the other (an insertion stands right
before the row that needs it, as no other place gives a smaller string). So the order of the least strings at a crossing
decides, and a forward step carries it as a rank beside each cost.

Rows are sorted by range, so a conversation of any length spreads over partitions, and is cut into parts of bounded size.
A part's effect is a 4 x 4 table of costs and ranks; the tables of a conversation's parts chain to the states between
them, and each part is then solved alone. Equal rows of one turn come as one row with a count: the further ones are
duplicates that change no state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import settle, shuffle_partitions

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3  # costs; the last for an undeleted truncated row
LEGAL = ("su", "ua", "au")
INF = 1 << 60
BLANK = r"^[ \x09-\x0D]*$"
TRUNCATED = r"[^.!? \x09-\x0D][ \x09-\x0D]*$"
PART_ROWS, PART_BYTES = 4096, 1 << 20
_NAME = {"u": "user", "a": "assistant"}
_AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}  # state, initial written -> state
_END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))  # cost and edits that finish from each state


def _steps(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[int, str, int]]]:
    """For each state after a row: (state before, edits, cost)."""
    into = [[(x, "D", DELETE)] for x in range(4)]
    if must_go:
        return into
    extra = UNFINISHED if truncated else 0
    for x, after in _AFTER.items():
        ways = [(x, "", 0)] + [(after[c], "I", INSERT) for c in "ua" if c in after]
        for y, before, cost in ways:
            for c, z in _AFTER[y].items():
                if c == initial:
                    into[z].append((x, before + "K", cost + KEEP + extra))
                elif c in _NAME:
                    into[z].append((x, before + "R", cost + REROLE + extra))
    return into


_KINDS = {(c, go, cut): _steps(c, go, cut) for c in ("s", "u", "a", "") for go in (False, True) for cut in (False, True)}


def kind(initial: str, must_go: bool, truncated: bool):
    return _KINDS[initial if initial in ("s", "u", "a") else "", must_go, truncated and not must_go]


def _ranks(order: list) -> list[int]:
    """Places of the four states' least strings in their order; a state out of reach comes last."""
    rank = [4] * 4
    for i, y in enumerate(sorted((y for y in range(4) if order[y] is not None), key=lambda y: order[y])):
        rank[y] = i
    return rank


def forward(rows, cost, rank):
    """(cost, rank) of the four states after ``rows`` (their steps), from those before. Ranks order the least edit
    strings; a state out of reach costs INF."""
    for into in rows:
        got, order = [INF] * 4, [None] * 4
        for y in range(4):
            best = min(((cost[x] + c, rank[x], e) for x, e, c in into[y] if cost[x] < INF), default=None)
            if best:
                got[y], order[y] = best[0], best[1:]
        cost, rank = got, _ranks(order)
    return cost, rank


def backward(rows, cost):
    """Least cost from each state before ``rows`` to the end, from those after."""
    for into in reversed(rows):
        got = [INF] * 4
        for y in range(4):
            for x, _, c in into[y]:
                got[x] = min(got[x], c + cost[y])
        cost = got
    return cost


def hirschberg(rows, first: int, last: int) -> list[str]:
    """Edits of each row on the cheapest way from state ``first`` to state ``last``, ASCII-least of those."""
    if not rows:
        return []
    if len(rows) == 1:
        return [min((c, e) for x, e, c in rows[0][last] if x == first)[1]]
    mid = len(rows) // 2
    cost, rank = forward(rows[:mid], [0 if s == first else INF for s in range(4)], [0] * 4)
    rest = backward(rows[mid:], [0 if s == last else INF for s in range(4)])
    cross = min((cost[s] + rest[s], rank[s], s) for s in range(4))[2]
    return hirschberg(rows[:mid], first, cross) + hirschberg(rows[mid:], cross, last)


def table(rows) -> tuple[list[int], list[int]]:
    """Costs and ranks after ``rows`` from each state before, 16 each."""
    parts = [forward(rows, [0 if s == first else INF for s in range(4)], [0] * 4) for first in range(4)]
    return [c for p in parts for c in p[0]], [r for p in parts for r in p[1]]


class Chain:
    """Cost of a conversation and the state after each of its parts, from the parts' tables in order."""

    def __init__(self):
        self.cost, self.rank, self.came = [0, INF, INF, INF], [0] * 4, []

    def add(self, costs: list[int], ranks: list[int]) -> None:
        got, order, back = [INF] * 4, [None] * 4, [0] * 4
        for y in range(4):
            best = min(((self.cost[x] + costs[4 * x + y], self.rank[x], ranks[4 * x + y], x) for x in range(4)
                        if self.cost[x] < INF and costs[4 * x + y] < INF), default=None)
            if best:
                got[y], order[y], back[y] = best[0], best[1:3], best[3]
        self.cost, self.rank = got, _ranks(order)
        self.came.append(bytes(back))

    def states(self) -> tuple[int, list[int]]:
        total, _, state = min((self.cost[s] + _END[s][0], self.rank[s], s) for s in range(4))
        states = []
        for back in reversed(self.came):
            states.append(state)
            state = back[state]
        return total, states[::-1]


def _written(state: int, edits: str, role: str, text: str) -> tuple[int, list[tuple[str, str]]]:
    """State after a row's edits and the turns that they write."""
    out = []
    for e in edits:
        if e == "D":
            continue
        initial = role[:1] if e == "K" else next(c for c in "ua" if c in _AFTER[state])
        out.append((role, text) if e == "K" else (_NAME[initial], text if e == "R" else ""))
        state = _AFTER[state][initial]
    return state, out


def _flagged(turns: DataFrame) -> DataFrame:
    """Distinct rows (_conv, _turn, _role, _text) with their number n and the flags blank, seen, cut."""
    rows = turns.groupBy("_conv", "_turn", "_role", "_text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("_key", F.md5(F.concat_ws("\n", F.length("_role"), "_role", "_text")))
    turn = F.struct(F.col("_turn").isNotNull().alias("some"), "_turn")
    first = rows.groupBy(F.col("_conv").alias("c"), F.col("_key").alias("k")).agg(F.min(turn).alias("first"))
    rows = rows.join(first, F.col("_conv").eqNullSafe(F.col("c")) & (F.col("_key") == F.col("k")))
    return rows.select("_conv", "_turn", "_role", "_text", "n", F.col("_text").rlike(BLANK).alias("blank"),
                       (~F.col("first").eqNullSafe(turn)).alias("seen"), F.col("_text").rlike(TRUNCATED).alias("cut"))


_PART = [("part", "bigint"), ("roles", "array<string>"), ("texts", "array<string>"), ("ns", "array<bigint>"),
         ("goes", "array<boolean>"), ("cuts", "array<boolean>"), ("costs", "array<bigint>"), ("ranks", "array<int>"),
         ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"), ("illegal", "bigint"), ("fixed", "bigint")]


def _schema(conv: T.StructField, fields) -> T.StructType:
    return T.StructType([T.StructField("_conv", conv.dataType)] + [
        T.StructField(n, T.DataType.fromDDL(t)) for n, t in fields])


def _parts(turns: DataFrame) -> DataFrame:
    """Parts of conversations in order, with their tables and counts. ``fixed``: cost of copies beyond the first."""
    schema = _schema(turns.schema["_conv"], _PART)
    arrow = to_arrow_schema(schema)

    def close(conv, number, rows):
        steps = [kind(r[:1], b or s, c) for r, _, _, b, s, c in rows]
        costs, ranks = table(steps)
        more = sum(n - 1 for _, _, n, b, _, _ in rows if not b)
        blank = sum(n for _, _, n, b, _, _ in rows if b)
        seen = sum(1 for *_, b, s, _ in rows if s and not b)
        cut = sum(1 for *_, b, s, c in rows if c and not b and not s)
        illegal = sum(n - 1 for _, _, n, *_ in rows) + sum(
            x[0][:1] + y[0][:1] not in LEGAL for x, y in zip(rows, rows[1:]))
        fixed = DELETE * sum(n - 1 for _, _, n, *_ in rows)
        return {"_conv": conv, "part": number, "roles": [r[0] for r in rows], "texts": [r[1] for r in rows],
                "ns": [r[2] for r in rows], "goes": [r[3] or r[4] for r in rows], "cuts": [r[5] for r in rows],
                "costs": costs, "ranks": ranks, "blank": blank, "duplicate": seen + more, "truncated": cut,
                "illegal": illegal, "fixed": fixed}

    def run(batches: Iterator[pa.RecordBatch]):
        conv, rows, size, number, done = None, [], 0, 0, []
        for b in batches:
            for at, c, *row in zip(*(col.to_pylist() for col in b.columns)):
                if rows and (c != conv or len(rows) >= PART_ROWS or size >= PART_BYTES):
                    done.append(close(conv, number, rows))
                    rows, size, number = [], 0, number + 1
                number = max(number, at << 32)
                conv = c
                rows.append(row)
                size += len(row[1])
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        if rows:
            yield pa.RecordBatch.from_pylist([close(conv, number, rows)], arrow)

    order = ("_conv", "_turn", "_role", "_text")
    dealt = _flagged(turns).repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select(F.spark_partition_id().alias("at"), "_conv", "_role", "_text", "n", "blank", "seen",
                        "cut").mapInArrow(run, schema)


_CHAIN = [("part", "bigint"), ("first", "int"), ("last", "int"), ("ends", "boolean"), ("cost", "bigint"), ("illegal", "bigint")]


def _chained(parts: DataFrame) -> DataFrame:
    """Per part: the states before and after it, whether it ends its conversation, and its share of the cost and of the
    illegal neighbours. A part is some bytes here, so a conversation's parts go by in order in one task, each with
    its four candidate states kept."""
    schema = _schema(parts.schema["_conv"], _CHAIN)
    arrow = to_arrow_schema(schema)

    def run(batches):
        mine, walk, last, done = [], None, "", []

        def close():
            total, states = walk.states()
            before = 0
            for i, ((conv, part, illegal, fixed), after) in enumerate(zip(mine, states)):
                ends = i == len(mine) - 1
                done.append({"_conv": conv, "part": part, "first": before, "last": after, "ends": ends,
                             "cost": fixed + (total if ends else 0), "illegal": illegal})
                before = after

        for b in batches:
            for conv, part, opens, costs, ranks, illegal, fixed, head, tail in zip(*(c.to_pylist() for c in b.columns)):
                if opens:
                    if mine:
                        close()
                    mine, walk = [], Chain()
                walk.add(costs, ranks)
                mine.append((conv, part, illegal + (not opens and last + head not in LEGAL), fixed))
                last = tail
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done.clear()
        if mine:
            close()
            yield pa.RecordBatch.from_pylist(done, arrow)

    opens = F.row_number().over(Window.partitionBy("_conv").orderBy("part")) == 1
    small = parts.select("_conv", "part", "costs", "ranks", "illegal", "fixed", F.expr("left(roles[0], 1)").alias("head"),
                         F.expr("left(roles[size(roles) - 1], 1)").alias("tail")).withColumn("opens", opens)
    return small.select("_conv", "part", "opens", "costs", "ranks", "illegal", "fixed", "head", "tail").mapInArrow(run, schema)


_SOLVED = [("part", "bigint"), ("audit", "string"), ("turns", "array<struct<role: string, text: string>>")]


def _solved(parts: DataFrame) -> DataFrame:
    """(_conv, part, audit, turns) of parts with the states ``first`` and ``last`` and the flag ``ends``."""
    schema = _schema(parts.schema["_conv"], _SOLVED)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            out = []
            for p in b.to_pylist():
                edits = hirschberg([kind(r[:1], g, c) for r, g, c in zip(p["roles"], p["goes"], p["cuts"])],
                                   p["first"], p["last"])
                state, audit, turns = p["first"], [], []
                for e, role, text, n in zip(edits, p["roles"], p["texts"], p["ns"]):
                    state, new = _written(state, e, role, text)
                    audit.append(e + "D" * (n - 1))
                    turns += new
                if p["ends"]:
                    _, new = _written(state, _END[state][1], "", "")
                    audit.append(_END[state][1])
                    turns += new
                out.append({"_conv": p["_conv"], "part": p["part"], "audit": "".join(audit),
                            "turns": [{"role": r, "text": t} for r, t in turns]})
            yield pa.RecordBatch.from_pylist(out, arrow)

    return parts.select("_conv", "part", "roles", "texts", "ns", "goes", "cuts", "first", "last", "ends").mapInArrow(run, schema)


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, parts). report: one row per conversation, with gaps, blank, duplicate, truncated, illegal and cost.
    parts: (conversation, part, audit, turns); a conversation's parts in order hold its edits and its repaired turns.

    Rows of a conversation go by turn, null turns first, equal turns by role and text. A null role or text is one space. A row's
    first fault counts: blank (no character but white space), duplicate (role and text seen earlier), truncated
    (the last such character is no ``.``, ``!`` or ``?``). Blank and duplicate rows are deleted; what is left and inserted
    has the role initials ``(s?(ua)+)?`` at least cost, of equal cost with the ASCII-least edits (D, I, K, R). A role
    counts by its first character. Repeated rows are duplicates, a null conversation id is a conversation of its own,
    an empty table gives two empty results; columns beside the four named are not looked at."""
    turns = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"),
                         F.coalesce(role_col, F.lit(" ")).alias("_role"), F.coalesce(text_col, F.lit(" ")).alias("_text"))
    parts = settle(_parts(turns))
    chained = settle(_chained(parts))
    counts = parts.drop("illegal", "cost").join(chained.drop("_conv"), "part").groupBy("_conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    gaps = (turns.groupBy("_conv", "_turn").agg(F.lit(1)).groupBy("_conv").agg(
        F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.count("_turn"), F.lit(0)).cast("bigint").alias("gaps")))
    report = counts.alias("a").join(gaps.alias("b"), F.col("a._conv").eqNullSafe(F.col("b._conv"))).select(
        F.col("a._conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    solved = _solved(parts.join(chained.select("part", "first", "last", "ends"), "part"))
    return report, solved.withColumnRenamed("_conv", conv_col)


def repaired_digests(parts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conversation, audit, repaired_sha256) of ``repair_conversations``'s parts, hashed as they stream by in order:
    ``role:text`` of the repaired turns, joined by newlines."""
    schema = T.StructType([T.StructField("_conv", parts.schema[conv_col].dataType), T.StructField("audit", T.StringType()),
                           T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import hashlib
        state, done = None, []

        def close():
            if state:
                done.append({"_conv": state[0], "audit": "".join(state[1]), "repaired_sha256": state[2].hexdigest()})

        for b in batches:
            for conv, opens, audit, text, some in zip(*(c.to_pylist() for c in b.columns)):
                if opens:
                    close()
                    state = [conv, [], hashlib.sha256(), False]
                state[1].append(audit)
                if some:
                    state[2].update((b"\n" if state[3] else b"") + text.encode())
                    state[3] = True
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    lines = F.expr("array_join(transform(turns, t -> concat(t.role, ':', t.text)), '\n')")
    rows = parts.select(F.col(conv_col).alias("_conv"), "part", "audit", lines.alias("text"), (F.size("turns") > 0).alias("some"))
    opens = F.row_number().over(Window.partitionBy("_conv").orderBy("part")) == 1
    dealt = rows.withColumn("opens", opens)  # leaves each conversation in one partition, its parts in order
    return dealt.select("_conv", "opens", "audit", "text", "some").mapInArrow(run, schema).withColumnRenamed("_conv", conv_col)
