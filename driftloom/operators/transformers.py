"""Logs of operations on one value as functions from the state before to the state after.

A log of a key may be too long for one task, and each operation may depend on the one before (set if absent, delete if
equal, expiry). So a log is cut into ranges; each range becomes one function of the unknown state before it, without
running it for every such state; the functions of a key's ranges are applied one after the other, which gives each range
its state; then ranges run side by side.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

#: A state: None if there is no value, else (value, time at which it ends or None).
State = tuple[str, float | None] | None


def lasting(ttl: float | None) -> bool:
    return ttl is not None and ttl == ttl


class Segment:
    """What operations without chunk writes do to any state. rows: (at, op, arg, ttl) in order.

    From an absent state the outcome is a state (`absent`). A value that is there lives on until the first of: a set or
    delete, a delete that names it, its end; or until it gets a new end, from when on its fate is known, too. What follows
    its death is what follows from an absent state at that operation. Outcomes are found from the last operation back to
    the first, each from those that come later."""

    def __init__(self, rows: list[tuple[float | None, str, str | None, float | None]]) -> None:
        n = len(rows)
        at = [float("-inf") if r[0] is None else r[0] for r in rows]
        ordered = all(a <= b for a, b in zip(at, at[1:]))
        outcome: list[State] = [None] * (n + 1)  # of an absent state just before the operation
        kill, expire, named = n, n, {}  # the next such operations
        fate: dict[int, tuple[int, float]] = {}  # of a value that is given an end at an operation: (its death or n, end)

        def ended(after: int, ends: float | None) -> int:
            """The first later operation that finds the value's time over."""
            if ends is None:
                return n
            if ordered:
                return bisect_left(at, ends, after + 1)
            return next((i for i in range(after + 1, n) if at[i] >= ends), n)

        def course(after: int, ends: float | None) -> tuple[int, float | None]:
            """(death by time or n, end) of a value that has this end after an operation."""
            over = ended(after, ends)
            return fate[expire] if expire < over and expire < n else (over, ends)

        for i in range(n - 1, -1, -1):
            _, op, arg, ttl = rows[i]
            outcome[i] = outcome[i + 1]
            if op in ("set", "setnx") and arg is not None:
                over, ends = course(i, at[i] + ttl if lasting(ttl) else None)
                death = min(kill, named.get(arg, n), over)
                outcome[i] = (arg, ends) if death == n else outcome[death]
            elif op == "expire" and lasting(ttl):
                fate[i] = course(i, at[i] + ttl)
                expire = i
            elif op == "delifeq" and arg is not None:
                named[arg] = i
            if op in ("set", "del"):
                kill, named, outcome[i] = i, {}, outcome[i] if op == "set" and arg is not None else outcome[i + 1]
        high, upto = float("-inf"), min(kill, expire, n - 1)
        self.absent, self.over, reached = outcome[0], [], []
        for i in range(upto + 1):
            high = max(high, at[i])
            reached.append(high)
            if self.over and self.over[-1][1] == outcome[i]:
                self.over[-1] = (high, outcome[i])
            else:
                self.over.append((high, outcome[i]))
        latest = float("inf")  # beyond a new end, the old one does not matter
        told = lambda i: (i, reached[i] if i <= upto else latest, outcome[i])
        self.kill = told(kill) if kill < n else None
        self.named = {arg: told(i) for arg, i in named.items()}
        self.renewed = (expire, reached[expire], *fate[expire], outcome[fate[expire][0]]) if expire < n and expire < kill else None
        self.size, self.last = n, reached[-1] if reached else high

    def apply(self, state: State) -> State:
        if state is None:
            return self.absent
        value, ends = state
        first = min((x for x in (self.kill, self.named.get(value)) if x), key=lambda x: x[0], default=None)
        seen = self.last  # the latest time that is reached while nothing else has happened to the value
        if first and (not self.renewed or first[0] < self.renewed[0]):
            seen = first[1]
        elif self.renewed:
            seen = self.renewed[1]
        if ends is not None and seen >= ends:
            return self.over[bisect_left(self.over, ends, key=lambda x: x[0])][1]
        if self.renewed and (not first or first[0] > self.renewed[0]):
            _, _, death, ends, after = self.renewed
            if first and first[0] <= death:
                return first[2]
            return after if death < self.size else (value, ends)
        return first[2] if first else (value, ends)


class Chunk:
    """One write into the middle of a value."""

    def __init__(self, at: float | None, offset, data: str | None) -> None:
        self.at, self.offset, self.data = at, offset, data

    def apply(self, state: State) -> State:
        if state is None or (state[1] is not None and self.at is not None and self.at >= state[1]):
            return None
        return (patched(state[0], self.offset, self.data) or state[0], state[1])


def patched(value: str, offset, data: str | None) -> str | None:
    """The value with data at the offset; null if that does not fit."""
    if data is None or offset is None or not 0 <= offset <= len(value) - len(data):
        return None
    return value[: int(offset)] + data + value[int(offset) + len(data) :]


class KeyLog:
    """A range of a key's log (at, op, arg, ttl, offset) as a function of (state, appended values)."""

    def __init__(self, rows: Iterable[tuple]) -> None:
        self.parts: list[Segment | Chunk] = []
        self.cleared, self.appended, held = False, 0, []
        for at, op, arg, ttl, offset in rows:
            if op == "append":
                self.appended += 1
            elif op == "clear":
                self.cleared, self.appended = True, 0
            if op == "chunk":
                self.parts += [Segment(held), Chunk(at, offset, arg)]
                held = []
            else:
                held.append((at, op, arg, ttl))
        self.parts.append(Segment(held))

    def apply(self, start: tuple[State, int]) -> tuple[State, int]:
        state, appended = start
        for part in self.parts:
            state = part.apply(state)
        return state, self.appended + (0 if self.cleared else appended)


class Balance:
    """A range of a queue's log (steps of +1 and -1) as a function of (items in it, numbers of items that have come and
    gone). A removal from an empty queue does nothing, so what is left is the sum or, if that ran below zero, what came
    since its least point: (sum, least sum so far) is all there is to know."""

    def __init__(self, steps: Iterable[int]) -> None:
        self.sum = self.low = self.came = 0
        for step in steps:
            self.sum += step
            self.low = min(self.low, self.sum)
            self.came += step > 0

    def apply(self, start: tuple[int, int, int]) -> tuple[int, int, int]:
        held, came, gone = start
        left = self.sum + max(held, -self.low)
        return left, came + self.came, gone + held + self.came - left
