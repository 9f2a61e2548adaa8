"""Repair of conversation structure by a rank-compressed dynamic program.

The cheapest edits that make a conversation's roles read `(s?(ua)+)?` are found over its turns in order. A turn's macro edit
is an insert run and then the turn's own edit, written I*D, I*K or I*R. No such code begins another, so two strings of as
many codes compare by the first code that differs, and a layer needs to know only the rank of each state's string among
those of the layer, not the string. Ranks and parent pointers are kept; the strings are read off at the end.

Blank turns and repeats can only be deleted. That changes no state, and an insertion beside it reads least after the D, so
the program runs over the other turns alone. It runs in pieces: a task has a range of turns, and finishes what lies within;
of a conversation that goes over a task's ends it gives the costs and ranks from every state to every other, which are
chained, so that a conversation with a third of all turns is worked on by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casebench.llm.common import materialize

SPACE = " \t\n\x0b\x0c\r"
#: What has been put out so far: nothing, s, an odd or an even number of u and a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
INITIALS = "sua"
#: Macro edits in ASCII order. Longer insert runs than 1 are never cheapest: two insertions lead to where none would, but after
#: s at the end, where it is cheaper to delete that turn.
CODES = ("D", "ID", "IK", "IR", "K", "R")
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
NONE = -1
PLANNED = "conv_id long, turn long, digest binary, code int, tail boolean, piece int, kind int, legs array<long>"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"
TURNS = "conv_id long, position long, edit string, role string, text string"


def next_role(state: int) -> int:
    """The state after the user or assistant turn that may follow."""
    return ASSISTANT if state == USER else USER


def after(state: int, code: str, initial: str) -> int | None:
    """The state after a macro edit of a turn with that initial; None if it isn't allowed."""
    for _ in range(code.count("I")):
        state = next_role(state)
    if code[-1] == "D":
        return state
    if code[-1] == "R":
        return next_role(state)
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    return next_role(state) if initial and initial == " sua"[next_role(state)] else None


def price(code: str, cut: bool) -> int:
    own = {"K": KEEP, "R": REROLE, "D": DELETE}[code[-1]]
    return own + INSERT * code.count("I") + (CUT if cut and code[-1] != "D" else 0)


#: A layer: for each state (cost over the layer's least, rank), or None where no string leads to it.
Layer = tuple[tuple[int, int] | None, ...]


@lru_cache(1 << 16)
def step(layer: Layer, kind: int) -> tuple[Layer, int, tuple[tuple[int, int] | None, ...]]:
    """The next layer, by how much its least cost is more, and for each state its parent and macro edit.

    kind: 2 * place of the turn's initial in `sua` (3: any other), and 1 if it is cut off. Only finitely many layers occur, so
    a turn costs a look-up.
    """
    initial, cut = (INITIALS + " ")[kind >> 1].strip(), bool(kind & 1)
    best: list[tuple[int, int, int, int] | None] = [None] * len(layer)
    for state, at in enumerate(layer):
        if at is None:
            continue
        for c, code in enumerate(CODES):
            to = after(state, code, initial)
            if to is not None:
                found = (at[0] + price(code, cut), at[1], c, state)
                best[to] = min(best[to] or found, found)
    least = min(b[0] for b in best if b)
    ranks = {b: i for i, b in enumerate(sorted({(b[1], b[2]) for b in best if b}))}
    new = tuple((b[0] - least, ranks[b[1], b[2]]) if b else None for b in best)
    return new, least, tuple((b[3], b[2]) if b else None for b in best)


def start(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in STATES)


def forward(kinds: list[int], state: int) -> tuple[Layer, int, list]:
    """The last layer of the turns from a state, the cost to add to it, and the parents of all layers."""
    layer, base, parents = start(state), 0, []
    for kind in kinds:
        layer, more, pick = step(layer, kind)
        base += more
        parents.append(pick)
    return layer, base, parents


def back(parents: list, state: int) -> list[int]:
    """The macro edits that lead to a state of the last layer."""
    codes = []
    for pick in reversed(parents):
        state, code = pick[state]
        codes.append(code)
    return codes[::-1]


def ending(layer: list[tuple[int, int] | None]) -> tuple[int, bool]:
    """The best last state, and whether an assistant is inserted after it; of equal strings none is left to compare."""
    options = [(layer[s][0] + (INSERT if s == USER else 0), layer[s][1], s) for s in (EMPTY, USER, ASSISTANT) if layer[s]]
    state = min(options)[2]
    return state, state == USER


def chained(pieces: list[list[int]]) -> list[tuple[int, int, bool]]:
    """First state, last state and whether to insert at the end, of each of a conversation's pieces in order.

    A piece: cost and rank (NONE: no way) from each state to each. Strings of different first states differ before the piece;
    those of the same one are ranked in it.
    """
    layer: list[tuple[int, int] | None] = list(start(EMPTY))
    parents = []
    for legs in pieces:
        best: list[tuple[int, int, int, int] | None] = [None] * len(STATES)
        for p in STATES:
            for q in STATES:
                cost, rank = legs[8 * p + 2 * q : 8 * p + 2 * q + 2]
                if layer[p] and cost != NONE:
                    found = (layer[p][0] + cost, layer[p][1], rank, p)
                    best[q] = min(best[q] or found, found)
        ranks = {b: i for i, b in enumerate(sorted({b[1:3] for b in best if b}))}
        layer = [(b[0], ranks[b[1:3]]) if b else None for b in best]
        parents.append([b[3] if b else None for b in best])
    state, tail = ending(layer)
    out = []
    for pick in reversed(parents):
        out.append((pick[state], state, tail and not out))
        state = pick[state]
    return out[::-1]


def legs_of(kinds: list[int]) -> list[int]:
    out = []
    for p in STATES:
        layer, base, _ = forward(kinds, p)
        for at in layer:
            out += [base + at[0], at[1]] if at else [NONE, NONE]
    return out


class Rows:
    """Gathers rows of a schema and gives them out in batches."""

    def __init__(self, schema: str, most: int = 20_000):
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
        self.schema = pa.schema([(n, types[t]) for n, t in (f.split(" ") for f in schema.split(", "))])
        self.most, self.rows, self.bytes = most, [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size

    def ready(self) -> bool:
        return len(self.rows) >= self.most or self.bytes > 1 << 24

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Macro edits of the turns of conversations that lie within the task's range, which comes in order.

    Of the first and the last conversation, which may go on elsewhere, the turns are passed on with the number of the piece
    (kind set, code null), and a row without digest has their legs.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out = Rows(PLANNED)

    def decided(conv, turns):
        kinds = [t[2] for t in turns]
        layer, _, parents = forward(kinds, EMPTY)
        state, tail = ending(list(layer))
        for i, (t, code) in enumerate(zip(turns, back(parents, state), strict=True)):
            out.add((conv, t[0], t[1], code, tail and i == len(turns) - 1, None, None, None))

    def left_open(conv, turns):
        for t in turns:
            out.add((conv, t[0], t[1], None, None, part, t[2], None))
        out.add((conv, None, None, None, None, part, None, legs_of([t[2] for t in turns])))

    own, turns, first = None, [], True
    for conv, turn, digest, kind in each(batches):
        if turns and conv != own:
            (left_open if first else decided)(own, turns)
            turns, first = [], False
            if out.ready():
                yield out.taken()
        own = conv
        turns.append((turn, digest, kind))
    if turns:
        left_open(own, turns)
    yield out.taken()


def chain_group(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    ways = chained([r["legs"] for r in rows])
    return pa.table(
        {
            "conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()),
            "piece": pa.array([r["piece"] for r in rows], pa.int32()),
            "first": pa.array([w[0] for w in ways], pa.int32()),
            "last": pa.array([w[1] for w in ways], pa.int32()),
            "tail": pa.array([w[2] for w in ways], pa.bool_()),
        }
    )


def completed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Macro edits of the turns of open pieces, whose first and last states are known by now."""
    out = Rows("conv_id long, turn long, digest binary, code int, tail boolean")

    def decided(key, turns, way):
        codes = back(forward([t[2] for t in turns], way[0])[2], way[1])
        for i, (t, code) in enumerate(zip(turns, codes, strict=True)):
            out.add((key[0], t[0], t[1], code, way[2] and i == len(turns) - 1))

    own, turns, way = None, [], None
    for conv, piece, turn, digest, kind, *its_way in each(batches):
        if turns and (conv, piece) != own:
            decided(own, turns, way)
            turns = []
            if out.ready():
                yield out.taken()
        own, way = (conv, piece), its_way
        turns.append((turn, digest, kind))
    if turns:
        decided(own, turns, way)
    yield out.taken()


def prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, blank, cut and digest; a null role or text is one space, null copies are none."""
    copies = F.coalesce(F.col("copies").cast("int"), F.lit(0)) if "copies" in rows.columns else F.lit(1)
    given = rows.select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")], *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], copies.alias("copies"))
    bare = F.btrim(F.col("text"), F.lit(SPACE))
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256), 1, 32))
    return given.withColumns({"blank": bare == "", "cut": ~F.right(bare, F.lit(1)).isin(".", "!", "?"), "digest": digest})


def decisions(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, macro edit and tail of each turn that isn't blank or a repeat; rows: prepared()."""
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    open_ = rows.filter((F.col("copies") > 0) & ~F.col("blank")).select("conv_id", "turn", "digest", (2 * place + F.col("cut").cast("int")).alias("kind"))
    # the first of equal turns; the pair's order is that of turns with nulls first
    firsts = open_.groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("at"), F.min("kind").alias("kind"))
    ordered = firsts.select("conv_id", F.col("at.turn").alias("turn"), "digest", "kind").repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")
    plan = materialize(ordered.mapInArrow(planned, PLANNED), "planned")
    # at most two pieces a task
    ways = plan.filter(F.col("legs").isNotNull()).select("conv_id", "piece", "legs").groupBy("conv_id").applyInArrow(chain_group, "conv_id long, piece int, first int, last int, tail boolean")
    ways = materialize(ways.select(F.col("conv_id").alias("__conv"), F.col("piece").alias("__piece"), "first", "last", F.col("tail").alias("__tail")), "ways")
    pieces = plan.filter(F.col("kind").isNotNull()).join(ways, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("piece") == F.col("__piece")))
    dealt = pieces.select("conv_id", "piece", "turn", "digest", "kind", "first", "last", F.col("__tail").alias("tail")).repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "turn", "digest")
    done = plan.filter(F.col("code").isNotNull()).select("conv_id", "turn", "digest", "code", "tail")
    return done.unionByName(dealt.mapInArrow(completed, "conv_id long, turn long, digest binary, code int, tail boolean"))


class Repair:
    """One conversation as its turns come in order; holds no turn, but the audit, and the text if it is wanted."""

    def __init__(self, conv: int | None, emit: Callable[[int, str, str, str], None] | None, whole: bool):
        self.conv, self.emit, self.hash = conv, emit, hashlib.sha256()
        self.text: list[str] | None = [] if whole else None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.n = self.distinct = 0
        self.low = self.high = self.initial = None
        self.audit: list[str] = []
        self.state, self.plan, self.tail = EMPTY, None, False

    def put(self, edit: str, role: str, text: str) -> None:
        line = ("\n" if self.n else "") + f"{role}:{text}"
        self.hash.update(line.encode())
        if self.text is not None:
            self.text.append(line)
        if self.emit:
            self.emit(self.n, edit, role, text)
        self.n += 1
        self.audit.append(edit)

    def insert(self) -> None:
        self.state = next_role(self.state)
        self.cost += INSERT
        self.put("I", "assistant" if self.state == ASSISTANT else "user", "")

    def decide(self, turn: int | None, digest: bytes, code: int, tail: bool) -> None:
        self.plan, self.tail = (turn, digest, CODES[code]), self.tail or tail

    def turn(self, turn: int | None, digest: bytes, role: str, text: str, blank: bool, cut: bool) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        if blank or self.plan is None or self.plan[:2] != (turn, digest):
            self.blank, self.duplicate = self.blank + blank, self.duplicate + (not blank)
            self.cost += DELETE
            self.audit.append("D")
            return
        code, self.plan = self.plan[2], None
        self.truncated += cut
        for _ in range(code.count("I")):
            self.insert()
        self.cost += price(code[-1], cut)
        if code[-1] == "D":
            self.audit.append("D")
            return
        self.state = after(self.state, code[-1], initial)
        self.put(code[-1], role if code[-1] == "K" else "assistant" if self.state == ASSISTANT else "user", text)

    def row(self) -> tuple:
        if self.tail:
            self.insert()
        gaps = self.high - self.low + 1 - self.distinct if self.low is not None else 0
        text = "".join(self.text) if self.text is not None else None
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest(), text)


def applied(batches: Iterator[pa.RecordBatch], whole: bool, turns: bool) -> Iterator[pa.RecordBatch]:
    """Decisions and turns in order, a turn's decision before it, become a row a conversation or (turns) a row a turn."""
    out, own = Rows(TURNS if turns else SUMMARY), None

    def closed():
        row = own.row()
        if not turns:
            out.add(row, len(row[7]) + len(row[9] or ""))

    for conv, turn, digest, code, tail, role, text, copies, blank, cut in each(batches):
        if own is None or conv != own.conv:
            if own:
                closed()
            own = Repair(conv, (lambda n, edit, r, t, conv=conv: out.add((conv, n, edit, r, t), len(t))) if turns else None, whole)
        if code is not None:
            own.decide(turn, digest, code, tail)
        for _ in range(copies or 0):
            own.turn(turn, digest, role, text, blank, cut)
        if out.ready():
            yield out.taken()
    if own:
        closed()
    yield out.taken()


def _repaired(rows: DataFrame, whole: bool, turns: bool) -> DataFrame:
    given = prepared(rows)
    plan = decisions(given).select("conv_id", "turn", "digest", "code", "tail")
    kinds = {"role": "string", "text": "string", "copies": "int", "blank": "boolean", "cut": "boolean"}
    both = plan.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()}).unionByName(
        given.withColumns({"code": F.lit(None).cast("int"), "tail": F.lit(None).cast("boolean"), "text": F.when((F.col("copies") > 0) & ~F.col("blank"), F.col("text")), "digest": F.when(F.col("copies") > 0, F.col("digest"))})
    )  # a decision's copies are null, which sort first
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest", F.col("copies").isNotNull())
    return ordered.select("conv_id", "turn", "digest", "code", "tail", "role", "text", "copies", "blank", "cut").mapInArrow(lambda it: applied(it, whole, turns), TURNS if turns else SUMMARY)


def repair(rows: DataFrame, whole: bool = True) -> DataFrame:
    """A row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and the repaired text.

    rows: conv_id, turn, role, text and, if there, copies (how often the turn stands; 0: only its conv_id counts). Other columns
    are ignored. Turns go by number, nulls first; those of one number by a digest of role and text, so that repeats stand
    together. Rows without conv_id are one conversation. A null role or text is one space: such a text is blank, such a role
    has no legal initial. A conversation without turns has zeros, an empty audit and the hash of an empty text; an empty
    table gives an empty one. Texts are taken whole. Costs and the ASCII-least audit are exact.

    Costs are found by many tasks, whatever a conversation's length. Its audit and its hash are one string each, read off its
    turns in order, so that last step passes a conversation through one task; it holds the audit alone, and the text where it is
    asked for (whole). turns() has the repaired turns as rows.
    """
    return _repaired(rows, whole, False)


def turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, position from 0, edit (K, R or I), role, text. Takes what repair() takes."""
    return _repaired(rows, False, True)


def damaged(table: DataFrame) -> DataFrame:
    """The table with faults by crc32("conv_id:turn") % 20: 0 drops a row, 1 empties its text, 2 takes its [.!?], 3 repeats it, 4 sets role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = table.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), whole=False).drop("repaired")
