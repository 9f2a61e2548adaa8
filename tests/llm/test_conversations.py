import hashlib
import itertools
import random
import zlib

import pytest

from casebench.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
ORDER = "DIKR"


def cheapest(turns):
    """(cost, audit, repaired) by a plain program over whole strings; turns: (role, text, must go, cut off). Any insert runs up to 3."""
    states = {0: (0, "", [])}
    allowed = {0: "su", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}
    full = {"u": "user", "a": "assistant"}

    def inserted(table):
        out = dict(table)
        for _ in range(3):
            for s, (cost, audit, kept) in list(out.items()):
                for r in allowed[s].replace("s", ""):
                    new = (cost + 2, audit + "I", [*kept, full[r] + ":"])
                    out[to[r]] = min(out.get(to[r], new), new, key=lambda x: x[:2])
        return out

    for role, text, gone, cut in turns:
        new = {}

        def offer(state, value):
            new[state] = min(new.get(state, value), value, key=lambda x: x[:2])

        # all ways with insertions are kept apart by state; strings compare as wholes, as they are never prefixes of each other here
        for s, (cost, audit, kept) in inserted(states).items():
            offer(s, (cost + 3, audit + "D", kept))
            if gone:
                continue
            if role[:1] and role[:1] in allowed[s]:
                offer(to[role[:1]], (cost + cut, audit + "K", [*kept, f"{role}:{text}"]))
            for r in allowed[s].replace("s", ""):
                offer(to[r], (cost + 2 + cut, audit + "R", [*kept, f"{full[r]}:{text}"]))
        states = new
    cost, audit, kept = min((v for s, v in inserted(states).items() if s in (0, 3)), key=lambda x: x[:2])
    return cost, audit, "\n".join(kept)


def faults(turns):
    """(role, text, must go, cut off) of (role, text) in order, and the counts of blank, duplicate, truncated."""
    seen, out, counts = set(), [], [0, 0, 0]
    for role, text in turns:
        bare = text.strip(c.SPACE)
        blank, duplicate = not bare, (role, text) in seen
        cut = bool(bare) and bare[-1] not in ".!?"
        seen.add((role, text))
        kind = 0 if blank else 1 if duplicate else 2 if cut else None
        if kind is not None:
            counts[kind] += 1
        out.append((role, text, blank or duplicate, int(cut and kind == 2)))
    return out, counts


def expected(rows):
    """conv_id -> the row that the operator gives, of rows (conv_id, turn, role, text) after damage (role None: dropped)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv and r[2] is not None), key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()[:16]))
        turns, counts = faults([r[2:] for r in own])
        cost, audit, text = cheapest(turns)
        numbers = {r[1] for r in own} - {None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f == 0:
            out.append((conv, turn, None, None))
            continue
        text = "" if f == 1 else "".join(x for x in text if x not in ".!?") if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def random_turns(rng, n, roles=("system", "user", "assistant", "tool", "")):
    return [(rng.choice(roles), rng.choice(["One.", "Two!", "three", " ", f"t{i}.", f"u{i}"])) for i in range(n)]


def kinds_of(turns):
    return [2 * ("sua".find(r[:1]) if r[:1] and r[:1] in "sua" else 3) + cut for r, _, _, cut in turns]


def all_edits(turns):
    """(cost, audit) by trying every string of edits of a few turns, with up to 3 insertions in a row."""
    best = None
    for plan in itertools.product(*[[i * "I" + e for i in range(4) for e in ("D" if t[2] else "DKR")] for t in turns], ["", "I", "II", "III"]):
        for roles in [0]:
            state, cost = 0, 0
            for code, t in zip(plan, [*turns, None], strict=True):
                for _ in range(code.count("I")):
                    state, cost = (3 if state == 2 else 2), cost + 2
                edit = code[-1:] if code[-1:] != "I" else ""
                if edit == "D":
                    cost += 3
                elif edit == "K":
                    to = {"s": 1, "u": 2, "a": 3}.get(t[0][:1])
                    if to is None or to not in {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}[state]:
                        break
                    state, cost = to, cost + t[3]
                elif edit == "R":
                    state, cost = (3 if state == 2 else 2), cost + 2 + t[3]
            else:
                if state in (0, 3):
                    best = min(best or (cost, "".join(plan)), (cost, "".join(plan)))
    return best


def test_the_plain_program_by_trying_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 3, 3, 4, 4):
        for _ in range(6 if n < 4 else 2):
            turns, _ = faults(random_turns(rng, n))
            assert cheapest(turns)[:2] == all_edits(turns)


def test_ranks_by_whole_strings_and_in_pieces():
    rng = random.Random(2)
    for k in range(300):
        turns = [t for t in faults(random_turns(rng, rng.randrange(0, 25)))[0] if not t[2]]
        kinds = kinds_of(turns)
        want = cheapest(turns)
        layer, base, parents = c.forward(kinds, c.EMPTY)
        state, tail = c.ending(list(layer))
        assert base + layer[state][0] + 2 * tail == want[0]
        assert "".join(c.CODES[x] for x in c.back(parents, state)) + "I" * tail == want[1]
        cuts = sorted({0, len(kinds), *(rng.randrange(len(kinds) + 1) for _ in range(k % 5))})
        pieces = [kinds[a:b] for a, b in itertools.pairwise(cuts)]
        ways = c.chained([c.legs_of(p) for p in pieces])
        codes = [x for p, (first, last, _) in zip(pieces, ways, strict=True) for x in c.back(c.forward(p, first)[2], last)]
        assert "".join(c.CODES[x] for x in codes) + "I" * any(w[2] for w in ways) == want[1]


def test_query_by_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(c.op11_conversation_repair(spark, sf)) == expected(damage(rows))


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_one_conversation_over_many_tasks(spark, parts):
    rng = random.Random(3)
    rows = [(5, i, *t) for i, t in enumerate(random_turns(rng, 400))] + [(conv, i, *t) for conv in (4, 6, None) for i, t in enumerate(random_turns(rng, 9))]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert found(c.repair(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    rows = [
        (None, None, "user", "Hi."), (None, 3, "assistant", "Yes."), (None, None, "user", "Hi."), (1, 1, None, "A."), (1, 2, "user", None),
        (2, 1, "user", "x " * 90_000 + "."), (2, 9, "assistant", "ok!\n\t "), (3, 1, "system", "S."), (4, 7, "assistant", "A"), (4, 7, "assistant", "A"), (4, 7, "user", "B"),
        (5, 1, "User", "Capital."), (5, 2, "usr", "short."), (6, 1, "assistant", "1."), (6, 2, "assistant", "2."), (6, None, "sys", "\n"), (7, -4, "user", "é?"), (7, 5, "assistant", "漢字"),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    filled = [(a, b, " " if r is None else r, " " if t is None else t) for a, b, r, t in rows]
    assert found(c.repair(frame)) == expected(filled)
    assert found(c.repair(c.damaged(frame), whole=False)) == expected(damage(rows))
    assert c.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dropped_rows_leave_their_conversation(spark):
    frame = spark.createDataFrame([(1, 0, "user", "A.", 0), (2, 0, "user", "A.", 1), (2, 1, "assistant", "B.", None)], "conv_id long, turn long, role string, text string, copies int")
    got = {r.conv_id: r for r in c.repair(frame).collect()}
    assert (got[1].audit, got[1].cost, got[1].repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())
    assert (got[2].audit, got[2].cost, got[2].repaired) == ("KI", 2, "user:A.\nassistant:")


def test_turns_are_what_the_text_says(spark, sf):
    rows = c.damaged(spark.read.parquet(f"{sf}/conversations.parquet"))
    by = {}
    for r in c.turns(rows).orderBy("conv_id", "position").collect():
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {k: "\n".join(v) for k, v in by.items()} == {r.conv_id: r.repaired for r in c.repair(rows).collect() if r.repaired}
