"""Error-correcting Earley parsing of role sequences.

The grammar ``(s?(ua)+)?`` is written with the nonterminal of every production at its left, so each item of the
chart begins at the first row and a column of the chart holds one completed item for each nonterminal. To its
productions come those for errors: a row that is deleted, a row that stands for another role, and a role for
which there is no row. An item retains the least (cost, audit) that leads to it.

Audits are not kept as strings. Two that end with the same row never begin one another, as whatever is inserted after
that row still costs something; so the order of two audits is that of what they were at the row before, and then
of what came since. Each column therefore keeps a rank for each item and what was added.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

#: What a sequence has come to so far, as nonterminals: nothing, a system row, a user row without answer, whole pairs.
EMPTY, SYSTEM, HALF, FULL = range(4)
#: Roles of rows by their initial; OTHER is in no production.
S, U, A, OTHER = range(4)
NAMES = ("system", "user", "assistant")
PRODUCTIONS = ((SYSTEM, EMPTY, S), (HALF, EMPTY, U), (HALF, SYSTEM, U), (HALF, FULL, U), (FULL, HALF, A))
ACCEPTED = (EMPTY, FULL)
ROLE_OF = {lhs: role for lhs, _, role in PRODUCTIONS}
_BY_TARGET = {lhs: tuple((prev, role) for to, prev, role in PRODUCTIONS if to == lhs) for lhs in range(4)}


@dataclass(frozen=True)
class Costs:
    """What edits cost; roles that a row can be given and that can be inserted are user and assistant."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if self.insert <= 0 or min(self.rerole, self.delete, self.truncated) < 0:
            raise ValueError("an insertion costs at least 1, other edits at least 0")


def symbol(role: int, dead: bool, truncated: bool) -> int:
    """A row as the parser sees it: a dead one must be deleted, a truncated one costs more if it stays."""
    return role * 4 + 2 * bool(dead) + bool(truncated)


class Chart:
    """Columns over a run of rows, from every item of ``entries`` on; an item's key is (entry, nonterminal).

    ``last`` has (cost, rank) of each item after the last row; ``back`` tells for each row how an item came about:
    the nonterminal before, what was inserted there, and the edit of the row.
    """

    def __init__(self, rows, costs: Costs, entries=(EMPTY,), keep_back: bool = True):
        self.costs, self.back, self.known = costs, [], {}
        column = {(e, e): (0, 0) for e in entries}
        for sym, times in rows:
            column, came = self._scan(self._predict(column), sym, times)
            if keep_back:
                self.back.append(came)
        self.last = column

    def _predict(self, column: dict) -> dict:
        """Items by insertions after the last row, as (cost, rank, inserted, nonterminal before them)."""
        full = {(e, x): (cost, rank, "", x) for (e, x), (cost, rank) in column.items()}
        todo = list(full)
        while todo:
            e, x = todo.pop()
            cost, rank, added, origin = full[e, x]
            for lhs, prev, role in PRODUCTIONS:
                if prev == x and role != S:
                    new = (cost + self.costs.insert, rank, added + "I", origin)
                    if (e, lhs) not in full or new[:3] < full[e, lhs][:3]:
                        full[e, lhs] = new
                        todo.append((e, lhs))
        return full

    def _scan(self, full: dict, sym: int, times: int) -> tuple[dict, dict]:
        """The next column, after ``times`` rows like this one (more than one only if they are dead)."""
        role, dead, more = sym >> 2, sym & 2, self.costs.truncated * (sym & 1)
        best: dict = {}
        for e in {e for e, _ in full}:
            for lhs in range(4):
                ways = []
                if (e, lhs) in full:
                    cost, rank, added, origin = full[e, lhs]
                    ways.append((cost + self.costs.delete * times, rank, added + "D", origin))
                if not dead:
                    for prev, wanted in _BY_TARGET[lhs]:
                        if (e, prev) in full:
                            cost, rank, added, origin = full[e, prev]
                            if role == wanted:
                                ways.append((cost + more, rank, added + "K", origin))
                            if wanted != S:
                                ways.append((cost + self.costs.rerole + more, rank, added + "R", origin))
                if ways:
                    best[e, lhs] = min(ways)
        place = {k: i for i, k in enumerate(sorted({(rank, added) for _, rank, added, _ in best.values()}))}
        column = {k: (cost, place[rank, added]) for k, (cost, rank, added, _) in best.items()}
        came = {k: self.known.setdefault(how := (origin, added), how) for k, (_, _, added, origin) in best.items()}
        return column, came

    def accepted(self, entry: int = EMPTY) -> tuple[int, int, str]:
        """Cost of the least repair, the nonterminal after the last row, and what is inserted after it."""
        cost, _, added, origin = min(v for (e, x), v in self._predict(self.last).items() if e == entry and x in ACCEPTED)
        return cost, origin, added

    def edits(self, entry: int, end: int, added: str = "") -> list[tuple[str, int]]:
        """For each row what is inserted before it and its own edit, as one string, and the nonterminal after the row;
        at last what is inserted at the end."""
        out, at = [(added, end)], end
        for came in reversed(self.back):
            origin, what = came[entry, at]
            out.append((what, at))
            at = origin
        return out[::-1]


def chain(column: dict, segment: dict) -> tuple[dict, dict]:
    """The column after a segment of rows, given the column before it and the ``last`` of a chart over it from all
    items, with ranks in common; and from which item each came."""
    best: dict = {}
    for (e, x), (cost, rank) in segment.items():
        if e in column:
            new = (column[e][0] + cost, (column[e][1], rank), e)
            best[x] = min(best.get(x, new), new)
    place = {k: i for i, k in enumerate(sorted({r for _, r, _ in best.values()}))}
    return {x: (cost, place[r]) for x, (cost, r, _) in best.items()}, {x: e for x, (_, _, e) in best.items()}


@lru_cache(1 << 14)
def _short(rows: tuple, costs: Costs) -> tuple[int, tuple]:
    chart = Chart(rows, costs)
    cost, end, added = chart.accepted()
    return cost, tuple(chart.edits(EMPTY, end, added))


def repair(rows: list[tuple[int, int]], costs: Costs) -> tuple[int, tuple]:
    """Cost and edits of a whole sequence; short ones repeat and are remembered."""
    if len(rows) <= 16:
        return _short(tuple(rows), costs)
    return _short.__wrapped__(tuple(rows), costs)


def applied(edits, rows: list[tuple[int, int]], lines: list[tuple[str, str]], entry: int = EMPTY) -> tuple[str, list[str]]:
    """The audit and the repaired ``role:text`` lines of rows with (role, text) ``lines``."""
    audit, out, before = [], [], entry
    for k, (what, state) in enumerate(edits):
        inserted = what.rstrip("DKR")
        edit = what[len(inserted) :]
        role = A if before == HALF else U
        for _ in inserted:  # they alternate from the role that is due
            out.append(f"{NAMES[role]}:")
            role = U + A - role
        audit.append(inserted + (edit if edit != "D" else "D" * rows[k][1]))
        if edit and edit != "D":
            role, text = lines[k]
            out.append(f"{role if edit == 'K' else NAMES[ROLE_OF[state]]}:{text}")
        before = state
    return "".join(audit), out
