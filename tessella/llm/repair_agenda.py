"""Repair of one conversation as a lightest derivation (plain Python helpers of operator 11).

An item (i, state) says that the first i rows have been edited so that what is kept ends
in ``state``. Each deduction adds one edit: its antecedent's value (cost, audit) becomes
(cost + weight, audit + letter). Both parts only grow, so the functions are superior and the
agenda, which pops items in the order of (cost, audit), finalises each at its
lightest value; it ends when the goal item is popped.

Audits of one item are never a proper prefix of each other at equal cost (a longer one
only has more insertions, which cost), so the order of two audits is kept by
whatever is appended to both.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re

#: What the kept rows end in; the goal is reached from NOTHING and ANSWERED.
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
#: The state after a kept row, by its role's first letter.
KEEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
#: The role that may come next, and the state after it: what a row is given, or what is inserted.
NEXT = {NOTHING: ("user", ASKED), SYSTEM: ("user", ASKED), ASKED: ("assistant", ANSWERED), ANSWERED: ("user", ASKED)}
RANK_REROLE, RANK_DELETE, RANK_INSERT, RANK_CUT = 1, 2, 5, 5
#: Rows, and code points of their texts, that one agenda takes in.
WINDOW, WINDOW_CHARS = 512, 1 << 21

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
_SEEN = re.compile(r"[^\x20\x09-\x0D]")
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def fault_of(text: str, repeated: bool) -> str | None:
    if not _SEEN.search(text):
        return BLANK
    if repeated:
        return DUPLICATE
    return None if text.rstrip(_SPACES)[-1] in ".!?" else TRUNCATED


def lightest(rows: list[tuple[str, str | None]], entries: dict[int, tuple[int, str]], ends: bool) -> dict[int, tuple[int, int, str]]:
    """Lightest (cost, entry state, audit after the entry) by state after all rows (first letter of the role, fault).

    ``entries``: (cost, audit so far) of the states before the rows. With ``ends``, only the
    goal's, under its last state.
    """
    # audits so far are compared once; those that continue another share its place and carry the rest along
    places: dict[int, tuple[int, str]] = {}
    base, place = "", 0
    for state, (_, audit) in sorted(entries.items(), key=lambda e: e[1][1]):
        if not places or not audit.startswith(base):
            base, place = audit, place + 1
        places[state] = (place, audit[len(base) :])
    agenda = [(cost, *places[state], 0, state, state) for state, (cost, _) in entries.items()]
    heapq.heapify(agenda)
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, int, str]] = {}
    n = len(rows)
    while agenda:
        cost, place, audit, i, state, entry = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and (not ends or state in (NOTHING, ANSWERED)):
            found[state] = (cost, entry, audit[len(places[entry][1]) :])
            if ends:
                return found
        role, after = NEXT[state]
        steps = [(RANK_INSERT, "I", i, after)]
        if i < n:
            initial, fault = rows[i]
            steps.append((RANK_DELETE, "D", i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                cut = RANK_CUT if fault else 0
                steps.append((RANK_REROLE + cut, "R", i + 1, after))
                if (state, initial) in KEEPS:
                    steps.append((cut, "K", i + 1, KEEPS[state, initial]))
        for weight, letter, j, to in steps:
            if (j, to) not in done:
                heapq.heappush(agenda, (cost + weight, place, audit + letter, j, to, entry))
    return found


def replay(rows: list[tuple[str, str]], state: int, audit: str):
    """(edit, row or None, role, text) of an audit over rows (role, text) from a state on."""
    i = 0
    for letter in audit:
        role, after = NEXT[state]
        if letter == "I":
            yield letter, None, role, ""
            state = after
            continue
        own, text = rows[i]
        if letter == "D":
            yield letter, i, own, text
        else:
            kept = own if letter == "K" else role
            yield letter, i, kept, text
            state = KEEPS[state, own[:1]] if letter == "K" else after
        i += 1


class _Entry:
    """The lightest way to a state: its cost, its audit since all ways agreed, and the digest of what it keeps."""

    def __init__(self, cost: int, audit: str, digest, started: bool):
        self.cost, self.audit, self.digest, self.started = cost, audit, digest, started

    def after(self, rows: list[tuple[str, str]], state: int, cost: int, audit: str) -> _Entry:
        out = _Entry(cost, self.audit + audit, self.digest.copy(), self.started)
        for letter, _, role, text in replay(rows, state, audit):
            if letter != "D":
                out.digest.update(f"{chr(10) if out.started else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                out.started = True
        return out


class Conversation:
    """Takes rows in order, one at a time, and holds at most a window of their texts."""

    def __init__(self):
        self.least = self.most = self.turn = self.last = None
        self.turns = self.illegal = 0
        self.faults = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.window: list[tuple[str, str]] = []
        self.marks: list[tuple[str, str | None]] = []
        self.chars = 0
        self.agreed: list[str] = []
        self.entries = {NOTHING: _Entry(0, "", hashlib.sha256(), False)}

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None:
            if turn != self.turn:
                self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = self.turn = turn
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        fault = fault_of(text, repeated)
        if fault:
            self.faults[fault] += 1
        self.window.append((role, text))
        self.marks.append((initial, fault))
        self.chars += len(text)
        if len(self.window) >= WINDOW or self.chars >= WINDOW_CHARS:
            self._advance(False)

    def _advance(self, ends: bool) -> None:
        found = lightest(self.marks, {s: (e.cost, e.audit) for s, e in self.entries.items()}, ends)
        self.entries = {state: self.entries[entry].after(self.window, entry, cost, audit) for state, (cost, entry, audit) in found.items()}
        agreed = os.path.commonprefix([e.audit for e in self.entries.values()])
        self.agreed.append(agreed)
        for e in self.entries.values():
            e.audit = e.audit[len(agreed) :]
        self.window, self.marks, self.chars = [], [], 0

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of the repaired rows."""
        self._advance(True)
        (end,) = self.entries.values()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, end.cost, "".join(self.agreed), end.digest.hexdigest()
