"""Conversation repair against an exhaustive search, whole and cut into parts."""

import hashlib
import random
import zlib

import pytest

from pseudospark.llm import alignment
from pseudospark.llm.conversations import applied, damaged, repair_one, repaired, repaired_turns

COLUMNS = "conv_id long, turn long, role string, text string, key string, part long, n long, present_before string"


def every_audit(turns, most):
    """All audits of at most ``most`` in cost whose result fits the grammar."""
    letters = {"": "su", "s": "u", "u": "a", "a": "u"}
    open_ends = [(0, "", 0, "", 0)]
    while open_ends:
        cost, audit, used, last, length = open_ends.pop()
        if cost > most:
            continue
        if used == len(turns) and (last == "a" or length == 0):
            yield cost, audit
        for letter in letters[last]:
            if letter != "s":
                open_ends.append((cost + 2, audit + "I", used, letter, length + 1))
            if used < len(turns) and turns[used] != "x":
                role = turns[used].lower()
                extra = role != turns[used]
                if role == letter:
                    open_ends.append((cost + extra, audit + "K", used + 1, letter, length + 1))
                if letter != "s":
                    open_ends.append((cost + 2 + extra, audit + "R", used + 1, letter, length + 1))
        if used < len(turns):
            open_ends.append((cost + 3, audit + "D", used + 1, last, length))


def in_parts(turns, size):
    """The same by parts, chained by plain search over the places between them."""
    cut = [turns[i : i + size] for i in range(0, len(turns), size)]
    options = [alignment.part(p, i == len(cut) - 1) for i, p in enumerate(cut)]

    def chains(k, place):
        if k == len(options):
            return [(0, "")] if place in (alignment.START, alignment.ASSISTANT) else []
        found = []
        for (before, after), (cost, audit) in options[k].items():
            if before == place:
                found += [(cost + c, audit + a) for c, a in chains(k + 1, after)]
        return found

    return min(chains(0, alignment.START))


@pytest.mark.parametrize("letters", ["uasoUASOx", "uaua", "uauax", "sua", "suaUAx"])
def test_alignment_is_the_cheapest_and_least(letters):
    rng = random.Random(letters)
    for _ in range(60):
        turns = "".join(rng.choices(letters, k=rng.randrange(7)))
        cost, audit = alignment.whole(turns)
        assert (cost, audit) == min(every_audit(turns, cost)), turns
        if turns:
            assert (cost, audit) == in_parts(turns, rng.choice([1, 2, 3])), turns


def test_long_alignments_in_parts():
    rng = random.Random(5)
    for _ in range(20):
        turns = "".join(rng.choice("uaxUAos") if rng.random() < 0.2 else "ua"[i % 2] for i in range(70))
        cut = [alignment.part(turns[i : i + 20], i + 20 >= len(turns)) for i in range(0, len(turns), 20)]
        best = {alignment.START: (0, "")}
        for options in cut:
            found = {}
            for (before, after), (cost, audit) in options.items():
                if before in best:
                    one = (best[before][0] + cost, best[before][1] + audit)
                    found[after] = min(found.get(after, one), one)
            best = found
        ends = [best[p] for p in (alignment.START, alignment.ASSISTANT) if p in best]
        assert min(ends) == alignment.whole(turns)


def expected(rows):
    """What a reader of the contract would do by hand."""
    if not rows:
        return 0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    kinds, seen = [], set()
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    letters = "".join(
        "x" if k in "bd" and k else (i if k == "" else i.upper())
        for k, i in zip(kinds, [r[1][:1] if r[1][:1] in ("u", "a", "s") else "o" for r in rows])
    )
    cost, audit = alignment.whole(letters)
    out, left, last = [], list(rows), ""
    for edit in audit:
        row = left.pop(0) if edit != "I" else None
        if edit == "D":
            continue
        if edit == "K":
            out.append(f"{row[1]}:{row[2]}")
            last = row[1][:1]
        else:
            last = "a" if last == "u" else "u"
            out.append({"u": "user:", "a": "assistant:"}[last] + (row[2] if row else ""))
    numbers = {r[0] for r in rows if r[0] is not None}
    pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:])]
    return (
        max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        *[kinds.count(k) for k in "bdt"],
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        len(rows),
        audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def conversations():
    rng = random.Random(11)
    texts = ["Yes.", "no", "", " \t\x0b", "Why? ", "ünï ß!", "a\nb.", "x" * 30_000 + "."]
    rows = []
    for conv in [*range(40), None]:
        for i in range(rng.choice([0, 1, 2, 5, 9, 30])):
            turn = rng.choice([i, i, i, None, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn, role, rng.choice([*texts, f"Say {i}.", f"Say {i}."])))
    for i in range(300):  # one conversation holds a large part of all rows, and one text a large part of it
        rows.append((77, rng.choice([i, None]), ["user", "assistant"][i % 2], rng.choice(["Same.", f"Turn {i}."])))
    rows += [(78, 5, "user", "Again."), (78, 5, "user", "Again."), (79, -(1 << 62), "user", "Far."), (79, 1 << 62, "assistant", "Off.")]
    return rows


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, "clash", 1, 2, "x") for r in conversations()], COLUMNS)


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "n_turns", "audit", "repaired_sha256"]


def by_id(frame):
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in rows}


def filled(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


@pytest.mark.parametrize("long_turns, part_turns", [(1024, 256), (8, 5), (0, 1), (20, 64)])
def test_repaired(talks, workspace, long_turns, part_turns):
    found = by_id(repaired(talks, workspace, long_turns=long_turns, part_turns=part_turns))
    assert found == {conv: expected(rows) for conv, rows in filled(conversations()).items()}


def test_long_by_bytes(talks, workspace):
    found = by_id(repaired(talks, workspace, long_bytes=1000, part_turns=3))
    assert found == {conv: expected(rows) for conv, rows in filled(conversations()).items()}


def test_damaged(talks, workspace):
    rows = {}
    for conv, turn, role, text in conversations():
        kept = rows.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    wanted = {conv: expected(kept) for conv, kept in rows.items()}
    assert by_id(repaired(damaged(talks), workspace)) == wanted
    assert by_id(repaired(damaged(talks), workspace, long_turns=3, part_turns=4)) == wanted


def test_repaired_turns(talks, workspace):
    repairs = workspace.save(repaired(talks, workspace), "repairs")
    lines = {}
    for r in sorted(repaired_turns(talks, repairs, workspace).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.place == len(lines[r.conv_id])
    for r in repairs.collect():
        text = "\n".join(lines.get(r.conv_id, []))
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256


def test_all_rows_dropped(spark, workspace):
    none = spark.createDataFrame([(1, None, None, None, False)], "conv_id long, turn long, role string, text string, present boolean")
    assert by_id(repaired(none, workspace)) == {1: expected([])}


def test_empty_table(spark, workspace):
    empty = spark.createDataFrame([], COLUMNS)
    assert repaired(damaged(empty), workspace).count() == 0
    assert repaired(empty, workspace, long_turns=0).count() == 0


def test_one_conversation_by_hand():
    turns = [(0, "system", "Be kind."), (1, "assistant", "Hello."), (3, "assistant", "Hello."), (4, "user", "so")]
    result = repair_one(turns)
    assert result[:7] == (4, 1, 0, 1, 1, 1 + 1, 2 + 3 + 1 + 2)
    assert result[7] == "KIKDD"  # costs what KIKDKI does, and comes before it
    turns = [t[1:] for t in turns]
    assert applied(turns, result[7]) == [("system", "Be kind."), ("user", ""), ("assistant", "Hello.")]
    assert applied(turns, "KIKDKI")[3:] == [("user", "so"), ("assistant", "")]
