"""Cheapest edits that turn a row of turns into one that fits the grammar of a conversation, ``(s?(ua)+)?``.

Turns are told by one letter each: the initial of their role (``u``, ``a``, ``s``, ``o`` for any other), in upper case if the
turn is truncated, or ``x`` if it has to go. Wagner-Fischer aligns them to every feasible length of the alternating target:
targets of all lengths end alike, so one table over (turns left, letters left) serves them all. Ukkonen's bands leave out
cells that would need more insertions or deletions than an alignment that is known already can cost.
"""

from __future__ import annotations

from functools import lru_cache

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: Places in the grammar: nothing yet, after ``s``, after ``u``, after ``a``.
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 60
GONE = "x"

Alignment = tuple[int, str]


def greedy_cost(turns: str, expected: str) -> int:
    """What it costs to insert the expected letter before a turn that skips it, and to rerole others."""
    cost = 0
    for turn in turns:
        if turn == GONE:
            cost += DELETE
            continue
        role = turn.lower()
        cost += turn != role
        if role == expected:
            expected = "a" if expected == "u" else "u"
        elif role in "ua":
            cost += INSERT
        else:
            cost += REROLE
            expected = "a" if expected == "u" else "u"
    return cost


class Table:
    """Least cost of aligning the turns from each one on to the last letters of the alternating string that ends in ``end``.

    With ``padded`` letters may be inserted behind the last turn. ``bound`` is the cost of some alignment, or more.
    """

    def __init__(self, turns: str, end: str, bound: int, padded: bool):
        self.turns, self.end, self.padded = turns, end, padded
        n = len(turns)
        spare = bound - DELETE * turns.count(GONE)
        self.low, self.rows = [0] * (n + 1), [[]] * (n + 1)
        live = 0
        for r in range(n, -1, -1):
            if r < n and turns[r] != GONE:
                live += 1
            low, high = max(0, live - spare // DELETE), live + spare // INSERT
            self.low[r] = low
            self.rows[r] = self._last(low, high) if r == n else self._row(r, low, high)

    def letter(self, left: int) -> str:
        """The next letter of a target of which so many letters are left."""
        return self.end if left % 2 else ("u" if self.end == "a" else "a")

    def _last(self, low: int, high: int) -> list[int]:
        return [INSERT * m if self.padded or m == 0 else _FAR for m in range(low, high + 1)]

    def cost(self, r: int, m: int) -> int:
        at = m - self.low[r]
        return self.rows[r][at] if 0 <= at < len(self.rows[r]) else _FAR

    def kept(self, r: int, m: int) -> tuple[int, int]:
        """Costs of keeping and of reroling turn ``r`` as the next of ``m`` letters."""
        turn = self.turns[r]
        if turn == GONE or m == 0:
            return _FAR, _FAR
        after = self.cost(r + 1, m - 1) + (turn.lower() != turn)
        return (after if turn.lower() == self.letter(m) else _FAR), after + REROLE

    def _row(self, r: int, low: int, high: int) -> list[int]:
        row: list[int] = []
        before = _FAR
        for m in range(low, high + 1):
            before = min(DELETE + self.cost(r + 1, m), before + INSERT, *self.kept(r, m))
            row.append(before)
        return row

    def audit(self, r: int, m: int) -> str:
        """Initials of the cheapest edits from turn ``r`` on, the least in ASCII order."""
        letters = []
        while r < len(self.turns) or m:
            least = self.cost(r, m)
            keep, rerole = self.kept(r, m) if r < len(self.turns) else (_FAR, _FAR)
            if r < len(self.turns) and DELETE + self.cost(r + 1, m) == least:
                letters.append("D")
                r += 1
            elif m and INSERT + self.cost(r, m - 1) == least:
                letters.append("I")
                m -= 1
            else:
                letters.append("K" if keep == least else "R")
                r, m = r + 1, m - 1
        return "".join(letters)

    def best(self, parity: int, least: int = 0, behind_system: bool = False) -> Alignment | None:
        """The cheapest alignment of all turns to a length of one parity, ties to the least audit.

        ``behind_system`` keeps some system turn first and deletes all before it.
        """
        starts = [(0, 0, "")]
        if behind_system:
            starts = [
                (i + 1, DELETE * i + (t == "S"), "D" * i + "K") for i, t in enumerate(self.turns) if t in ("s", "S")
            ]
        found: list[tuple[int, int, int, str]] = []
        for r, cost, audit in starts:
            first = self.low[r]
            for m in range(first, first + len(self.rows[r])):
                if m % 2 == parity and m >= least and self.cost(r, m) < _FAR:
                    found.append((cost + self.cost(r, m), r, m, audit))
        if not found:
            return None
        cost = min(f[0] for f in found)
        return cost, min(audit + self.audit(r, m) for c, r, m, audit in found if c == cost)


def whole(turns: str) -> Alignment:
    """Cost and audit of the cheapest repair of a conversation."""
    return _short(turns) if len(turns) <= 64 else _whole(turns)


def _whole(turns: str) -> Alignment:
    nothing = (DELETE * len(turns), "D" * len(turns))
    if not turns.strip(GONE):
        return nothing
    # A target of odd length takes one letter more.
    bound = min(nothing[0], greedy_cost(turns, "u") + INSERT)
    table = Table(turns, "a", bound, padded=True)
    options = [nothing, table.best(0, least=2), table.best(0, least=2, behind_system=True)]
    return min(o for o in options if o is not None)


_short = lru_cache(maxsize=1 << 14)(_whole)


def part(turns: str, last: bool) -> dict[tuple[int, int], Alignment]:
    """The cheapest alignment of some turns within a conversation, for each place in the grammar before and after them.

    Letters inserted between two parts belong to the later one. Audits of one part then differ in a letter before either
    ends, so the least audit of a conversation is made of least audits of its parts.
    """
    n = len(turns)
    # One turn more deleted, or one letter more inserted, gives any other end.
    bound = max(greedy_cost(turns, "u"), greedy_cost(turns, "a")) + DELETE + INSERT
    ends = {USER: Table(turns, "u", bound, last), ASSISTANT: Table(turns, "a", bound, last)}
    found: dict[tuple[int, int], Alignment | None] = {
        (START, START): (DELETE * n, "D" * n),
        (SYSTEM, SYSTEM): (DELETE * n, "D" * n),
    }
    kept = [(DELETE * (n - 1) + (t == "S"), "D" * i + "K" + "D" * (n - 1 - i)) for i, t in enumerate(turns) if t in ("s", "S")]
    found[START, SYSTEM] = min(kept, default=None)
    for end, table in ends.items():
        from_user = 1 if end == USER else 0  # parity of the letters from a ``u`` on
        least = 1 if end == USER else 2
        found[SYSTEM, end] = table.best(from_user, least)
        both = [a for a in (table.best(from_user, least), table.best(from_user, least, behind_system=True)) if a]
        found[START, end] = min(both, default=None)
        found[ASSISTANT, end] = table.best(from_user)
        found[USER, end] = table.best(1 - from_user)
    return {places: a for places, a in found.items() if a is not None}
