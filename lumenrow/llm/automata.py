"""Byte automata: rule expressions to one minimal transition array by subset construction.

The expressions are a small, exact subset: literals, ``[...]`` classes, ``(a|b)`` groups, and the
repeats ``?``, ``*``, ``+``, ``{n}`` and ``{n,}``; ``\\xHH`` and an escaped character stand for a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_HEX = "0123456789abcdefABCDEF"


class Nfa:
    """Thompson automaton: ``moves[s]`` has (byte set, target), ``empty[s]`` targets without a byte."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, left = set(states), list(states)
        while left:
            for t in self.empty[left.pop()]:
                if t not in seen:
                    seen.add(t)
                    left.append(t)
        return frozenset(seen)


class _Parser:
    def __init__(self, nfa: Nfa, text: str, ignore_case: bool) -> None:
        self.nfa, self.text, self.at, self.ignore_case = nfa, text, 0, ignore_case

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x" and self.text[self.at : self.at + 2].strip(_HEX) == "":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def cased(self, found: set[int]) -> frozenset[int]:
        if self.ignore_case:
            found |= {b ^ 32 for b in found if 65 <= b & ~32 <= 90}
        return frozenset(found)

    def choice(self) -> tuple[int, int]:
        start, end = self.nfa.state(), self.nfa.state()
        while True:
            a, b = self.sequence()
            self.nfa.empty[start].append(a)
            self.nfa.empty[b].append(end)
            if self.peek() != "|":
                return start, end
            self.take()

    def sequence(self) -> tuple[int, int]:
        start = end = self.nfa.state()
        while self.peek() and self.peek() not in "|)":
            at = self.at
            a, b = self.atom()
            low, high = self.repeat()
            after, parts = self.at, [(a, b)]
            for _ in range(max(low, 1) - 1):
                self.at = at
                parts.append(self.atom())
            self.at = after
            for a, b in parts:
                self.nfa.empty[end].append(a)
                start_of, end = a, b
            if low == 0:
                self.nfa.empty[parts[0][0]].append(end)
            if high is None:
                self.nfa.empty[end].append(start_of)
            new = self.nfa.state()
            self.nfa.empty[end].append(new)
            end = new
        return start, end

    def repeat(self) -> tuple[int, int | None]:
        c = self.peek()
        if c in ("?", "*", "+") and c:
            self.take()
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c != "{":
            return 1, 1
        body = self.text[self.at + 1 : self.text.index("}", self.at)]
        self.at += len(body) + 2
        return int(body.rstrip(",")), None if body.endswith(",") else int(body)

    def atom(self) -> tuple[int, int]:
        if self.peek() == "(":
            self.take()
            a, b = self.choice()
            self.take()
            start, end = self.nfa.state(), self.nfa.state()
            self.nfa.empty[start].append(a)
            self.nfa.empty[b].append(end)
            return start, end
        if self.peek() == "[":
            self.take()
            found: set[int] = set()
            while self.peek() != "]":
                first = self.byte()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    found |= set(range(first, self.byte() + 1))
                else:
                    found.add(first)
            self.take()
        else:
            found = {self.byte()}
        start, end = self.nfa.state(), self.nfa.state()
        self.nfa.moves[start].append((self.cased(found), end))
        return start, end


def reversed_nfa(nfa: Nfa) -> Nfa:
    back = Nfa()
    for _ in nfa.moves:
        back.state()
    for s, moves in enumerate(nfa.moves):
        for on, t in moves:
            back.moves[t].append((on, s))
        for t in nfa.empty[s]:
            back.empty[t].append(s)
    return back


@dataclass
class Dfa:
    """``step[s, class]`` is the next state, ``classes[byte]`` its class, ``marks[s]`` the bits of the rules that end in s.

    State 0 is the start. States with marks come last, from ``first_marked``. ``dead`` is the state
    nothing leaves, or -1.
    """

    step: np.ndarray
    classes: np.ndarray
    marks: np.ndarray
    first_marked: int
    dead: int


def determinise(nfa: Nfa, start: int, ends: dict[int, int], search: bool) -> Dfa:
    """Subset construction, then Moore's minimisation. ``search``: a match may start at any byte."""
    seeds = nfa.closure(frozenset([start]))
    sets: list[set[int]] = [set(on) for moves in nfa.moves for on, _ in moves]
    signature: dict[tuple[bool, ...], int] = {}
    classes = np.array([signature.setdefault(tuple(b in on for on in {frozenset(x) for x in sets}), len(signature)) for b in range(256)], np.int32)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(signature))]
    index, left, table = {seeds: 0}, [seeds], []
    while left:
        at = left.pop(0)
        row = []
        for b in sample:
            to = nfa.closure(frozenset(t for s in at for on, t in nfa.moves[s] if b in on))
            to = to | seeds if search else to
            if to not in index:
                index[to] = len(index)
                left.append(to)
            row.append(index[to])
        table.append(row)
    step = np.array(table, np.int32)
    marks = np.array([sum({1 << ends[s] for s in at if s in ends}) for at in index], np.int64)
    dead = index.get(frozenset(), -1)
    part = np.unique(np.stack([marks, np.arange(len(marks)) == dead], 1), axis=0, return_inverse=True)[1].ravel()
    while True:
        new = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    size = int(part.max()) + 1
    first = np.array([int(np.flatnonzero(part == p)[0]) for p in range(size)])
    order = sorted(range(size), key=lambda p: (p != part[0], marks[first[p]] != 0, p))
    if marks[0]:
        raise ValueError("a rule matches the empty string")
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    kept = first[order]
    return Dfa(rank[part[step[kept]]].astype(np.int32), classes, marks[kept], int((marks[kept] == 0).sum()), int(rank[part[dead]]) if dead >= 0 else -1)


def compile_rule(text: str, ignore_case: bool = False) -> tuple[Nfa, int, int]:
    nfa = Nfa()
    parser = _Parser(nfa, text, ignore_case)
    start, end = parser.choice()
    if parser.at != len(text):
        raise ValueError(f"{text!r} can't be read beyond {parser.at}")
    return nfa, start, end


def forward(text: str, ignore_case: bool = False) -> Dfa:
    """Accepts whole strings of the expression."""
    nfa, start, end = compile_rule(text, ignore_case)
    return determinise(nfa, start, {end: 0}, search=False)


def backward(text: str, ignore_case: bool = False) -> Dfa:
    """Accepts the reversals of the strings of the expression."""
    nfa, start, end = compile_rule(text, ignore_case)
    return determinise(reversed_nfa(nfa), end, {start: 0}, search=False)


def combined(rules: list[tuple[str, bool]]) -> Dfa:
    """One search automaton for all rules: it marks each byte at which a string of rule i may end with bit i."""
    nfa = Nfa()
    start, ends = nfa.state(), {}
    for i, (text, ignore_case) in enumerate(rules):
        parser = _Parser(nfa, text, ignore_case)
        a, b = parser.choice()
        nfa.empty[start].append(a)
        ends[b] = i
    return determinise(nfa, start, ends, search=True)


def longest(dfa: Dfa, data: bytes, start: int) -> int:
    """End of the longest match of a forward automaton from ``start``; ``start`` if there is none."""
    state, end = 0, start
    for at in range(start, len(data)):
        state = int(dfa.step[state, dfa.classes[data[at]]])
        if state == dfa.dead:
            break
        if dfa.marks[state]:
            end = at + 1
    return end


def leftmost(dfa: Dfa, data: bytes, end: int, bound: int) -> int | None:
    """Least start, not before ``bound``, of a match that ends at ``end``, by a backward automaton."""
    state, start = 0, None
    for at in range(end - 1, bound - 1, -1):
        state = int(dfa.step[state, dfa.classes[data[at]]])
        if state == dfa.dead:
            break
        if dfa.marks[state]:
            start = at
    return start


class Scanner:
    """Runs a search automaton over a buffer in one pass, many stretches of it side by side.

    Stretches are equally long, wherever that cuts. Each begins in the state that the bytes before it
    lead to from the start state, which is all but always the state that the stretch before ends in; a
    stretch where it is not is run again from that state.
    """

    def __init__(self, dfa: Dfa, lanes: int = 8192, least: int = 512, warm: int = 64) -> None:
        self.dfa, self.lanes, self.least, self.warm = dfa, lanes, least, warm
        self.width = dfa.step.shape[1]
        #: States are numbers of rows times the width, so that a state plus a class is a place in this table.
        self.flat = (dfa.step.astype(np.int32) * self.width).ravel()
        self.classes = dfa.classes.astype(np.uint8)
        self.resets = (dfa.step == 0).all(0)[dfa.classes]

    def _run(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The states in which stretches end, and (stretch, end offset, marks) of the marked bytes in them."""
        order = np.argsort(starts - ends, kind="stable")
        at, lengths, state = starts[order], (ends - starts)[order], state[order]
        limit, hits = self.dfa.first_marked * self.width, []
        active = len(at) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), "right")
        for n in active:
            now = self.flat[state[:n] + classes[at[:n]]]
            state[:n] = now
            at[:n] += 1
            if now.max() >= limit:
                hit = np.flatnonzero(now >= limit)
                hits.append((order[hit], at[hit], self.dfa.marks[now[hit] // self.width]))
        final = np.empty_like(state)
        final[order] = state
        return final, hits

    def scan(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end offsets, marks) of all marked bytes, ascending."""
        size = len(buffer)
        if not size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lanes = max(1, min(self.lanes, size // self.least))
        starts = np.arange(lanes, dtype=np.int64) * size // lanes
        ends, classes = np.append(starts[1:], size), self.classes[buffer]
        guess = np.zeros(lanes, np.int32)
        for back in range(self.warm, 0, -1):
            first = int(np.searchsorted(starts, back))
            guess[first:] = self.flat[guess[first:] + classes[starts[first:] - back]]
        final, hits = self._run(classes, starts, ends, guess.copy())
        runs = [(guess, hits)]
        known = [{int(s): (int(f), 0)} for s, f in zip(guess, final, strict=True)]
        state, lane, ahead, chosen = 0, 0, 1, np.zeros(lanes, np.int64)
        while lane < lanes:
            if state not in known[lane]:
                #: What carries a state beyond the warm-up, as a long run of blanks does, may carry it on: ever more stretches are tried with it.
                some = np.arange(lane, min(lanes, lane + ahead))
                again, found = self._run(classes, starts[some], ends[some], np.full(len(some), state, np.int32))
                for k, f in zip(some, again, strict=True):
                    known[k].setdefault(state, (int(f), len(runs)))
                runs.append((some, [(some[k], at, marks) for k, at, marks in found]))
                ahead *= 2
            state, chosen[lane] = known[lane][state]
            lane += 1
        kept = [(at[here], marks[here]) for run, (_, found) in enumerate(runs) for k, at, marks in found if (here := chosen[k] == run).any()]
        if not kept:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends_all, marks_all = (np.concatenate(c) for c in zip(*kept, strict=True))
        order = np.argsort(ends_all, kind="stable")
        return ends_all[order], marks_all[order]
