"""Deterministic automata for several byte patterns: Thompson construction, subset construction, minimisation, transition arrays.

The pattern language has literals, escapes (\\xHH, \\n, \\t and escaped punctuation), classes with ranges, groups, alternation and the
quantifiers ? * + {n} {n,} {n,m}. Matching is by bytes.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np


class _Parser:
    """Recursive descent into a nondeterministic automaton of byte sets and empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def pattern(self, text: str) -> tuple[int, int]:
        self.text, self.at = text, 0
        out = self._either()
        if self.at != len(text):
            raise ValueError(f"unexpected {text[self.at]!r} at {self.at} in {text!r}")
        return out

    def turn(self) -> None:
        """Reverse every move."""
        moves: list[list[tuple[frozenset[int], int]]] = [[] for _ in self.moves]
        empty: list[list[int]] = [[] for _ in self.empty]
        for s, out in enumerate(self.moves):
            for chars, t in out:
                moves[t].append((chars, s))
        for s, out in enumerate(self.empty):
            for t in out:
                empty[t].append(s)
        self.moves, self.empty = moves, empty

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _either(self) -> tuple[int, int]:
        branches = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            branches.append(self._sequence())
        if len(branches) == 1:
            return branches[0]
        start, end = self.state(), self.state()
        for s, e in branches:
            self.empty[start].append(s)
            self.empty[e].append(end)
        return start, end

    def _sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self._peek() not in ("", "|", ")"):
            s, e = self._repeated()
            self.empty[end].append(s)
            end = e
        return start, end

    def _repeated(self) -> tuple[int, int]:
        begin = self.at
        part = self._atom()
        stop = self.at
        low, high = 1, 1
        c = self._peek()
        if c and c in "?*+":
            self.at += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        elif c == "{":
            close = self.text.index("}", self.at)
            first, comma, last = self.text[self.at + 1 : close].partition(",")
            low, high = int(first), (int(last) if last else None) if comma else int(first)
            self.at = close + 1
        after = self.at
        if (low, high) == (1, 1):
            return part

        def again() -> tuple[int, int]:
            self.at = begin
            got = self._atom()
            assert self.at == stop
            return got

        start = end = self.state()
        for _ in range(low):
            s, e = again()
            self.empty[end].append(s)
            end = e
        if high is None:
            s, e = again()
            self.empty[end].append(s)
            self.empty[e].append(s)
            out = self.state()
            self.empty[end].append(out)
            self.empty[e].append(out)
            end = out
        else:
            out = self.state()
            self.empty[end].append(out)
            for _ in range(high - low):
                s, e = again()
                self.empty[end].append(s)
                self.empty[e].append(out)
                end = e
            end = out
        self.at = after
        return start, end

    def _atom(self) -> tuple[int, int]:
        c = self._peek()
        if c == "(":
            self.at += 1
            got = self._either()
            if self._peek() != ")":
                raise ValueError(f"no closing bracket in {self.text!r}")
            self.at += 1
            return got
        chars = self._class() if c == "[" else frozenset([self._char()])
        s, e = self.state(), self.state()
        self.moves[s].append((chars, e))
        return s, e

    def _char(self) -> int:
        c = self._peek()
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self._peek()
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def _class(self) -> frozenset[int]:
        self.at += 1
        negate = self._peek() == "^"
        self.at += negate
        out: set[int] = set()
        while self._peek() != "]":
            low = high = self._char()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._char()
            out.update(range(low, high + 1))
        self.at += 1
        return frozenset(range(256)) - out if negate else frozenset(out)


def either_case(pattern: str) -> str:
    """The pattern with every bare letter in either case; classes and escapes stay."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = 4 if pattern[i + 1] == "x" else 2
            out.append(pattern[i : i + n])
            i += n
        elif c == "[":
            end = pattern.index("]", i)
            out.append(pattern[i : end + 1])
            i = end + 1
        else:
            out.append(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c)
            i += 1
    return "".join(out)


class Automaton:
    """table[state, byte class] -> state, start state 0; accept[state] has bit r set where a match of rule r ends.

    Rules start anywhere, or only at the beginning if anchored: then `dead` is the state from which nothing matches any more, and `starts` has
    the start state of each rule. A backward automaton reads from right to left, so its accepting states say where matches start.
    """

    def __init__(self, patterns: list[str], backward: bool = False, anchored: bool = False):
        nfa = _Parser()
        ends, starts = {}, []
        for rule, pattern in enumerate(patterns):
            s, e = nfa.pattern(pattern)
            if backward:
                s, e = e, s
            starts.append(s)
            ends[e] = 1 << rule
        if backward:
            nfa.turn()
        self.classes, samples = self._byte_classes(nfa)
        table, accept, begins = self._subsets(nfa, starts, ends, samples, anchored)
        self.table, self.accept, renumber = self._minimise(table, accept)
        self.starts = [int(renumber[b]) for b in begins]
        self.dead = self.starts.pop() if anchored else None

    @staticmethod
    def _byte_classes(nfa: _Parser) -> tuple[np.ndarray, list[int]]:
        sets = {chars for moves in nfa.moves for chars, _ in moves}
        number: dict[tuple, int] = {}
        classes = np.zeros(256, dtype=np.int32)
        samples = []
        for b in range(256):
            sign = tuple(b in s for s in sets)
            if sign not in number:
                number[sign] = len(number)
                samples.append(b)
            classes[b] = number[sign]
        return classes, samples

    @staticmethod
    def _subsets(nfa, starts, ends, samples, anchored):
        closures: dict[int, frozenset[int]] = {}

        def closure(state: int) -> frozenset[int]:
            if state not in closures:
                seen, stack = {state}, [state]
                while stack:
                    for t in nfa.empty[stack.pop()]:
                        if t not in seen:
                            seen.add(t)
                            stack.append(t)
                closures[state] = frozenset(x for x in seen if nfa.moves[x] or x in ends)
            return closures[state]

        steps: dict[tuple[int, int], frozenset[int]] = {}

        def step(state: int, c: int) -> frozenset[int]:
            if (state, c) not in steps:
                steps[state, c] = frozenset().union(*(closure(t) for chars, t in nfa.moves[state] if samples[c] in chars))
            return steps[state, c]

        begin = frozenset().union(*map(closure, starts))
        again = frozenset() if anchored else begin
        firsts = [closure(s) for s in starts] if anchored else [begin]
        todo = list(dict.fromkeys(firsts))
        number, table = {subset: i for i, subset in enumerate(todo)}, []
        for subset in todo:
            row = []
            for c in range(len(samples)):
                to = again.union(*(step(s, c) for s in subset))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            table.append(row)
        if anchored and frozenset() not in number:
            number[frozenset()] = len(todo)
            todo.append(frozenset())
            table.append([len(todo) - 1] * len(samples))
        accept = [0] * len(todo)
        for i, subset in enumerate(todo):
            for s in subset:
                accept[i] |= ends.get(s, 0)
        begins = [number[f] for f in firsts] + ([number[frozenset()]] if anchored else [])
        return np.array(table, dtype=np.int64), np.array(accept, dtype=np.int64), begins

    @staticmethod
    def _minimise(table: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Refine blocks of equal acceptance by the blocks they move to, until nothing splits: table, acceptance, and each old state's new number."""
        block = np.unique(accept, return_inverse=True)[1]
        while True:
            sign = np.column_stack([block, block[table]])
            _, fresh = np.unique(sign, axis=0, return_inverse=True)
            if fresh.max() == block.max():
                break
            block = fresh
        first = np.full(block.max() + 1, -1)
        for i, b in enumerate(block):
            if first[b] < 0:
                first[b] = i
        renumber = np.argsort(np.argsort(first))[block]
        keep = np.sort(first)
        return renumber[table[keep]].astype(np.int32), accept[keep].astype(np.int64), renumber


class Scanner:
    """Where the matches of all rules start and end, in texts that lie one after another.

    A backward automaton of all rules marks, in one pass over the bytes, where matches start; lanes of equal length run side by side, and
    those whose right neighbour ended in another state than assumed run again from there. From a start, the rule's
    anchored automaton follows its longest match, again side by side for all starts. Both are linear in the bytes.
    """

    def __init__(self, patterns: list[str], lane: int = 512, few: int = 24):
        back = Automaton(patterns, backward=True)
        n_states, self.width = back.table.shape[0], back.table.shape[1] + 1
        # One more class stands between texts and leads every state back to the start.
        wide = np.zeros((n_states, self.width), dtype=np.int32)
        wide[:, :-1] = back.table
        self.flat = (wide * self.width).reshape(-1)
        self.accept = np.repeat(back.accept, self.width).astype(np.uint16)
        self.classes, self.lane, self.few = back.classes.astype(np.uint8), lane, few
        self.slow, self.slow_accept = self.flat.tolist(), self.accept.tolist()
        ahead = Automaton(patterns, anchored=True)
        # After a text's end nothing goes on.
        n = ahead.table.shape[1]
        self.next = np.column_stack([ahead.table, np.full(len(ahead.table), ahead.dead, dtype=np.int32)]).astype(np.int32)
        self.ahead_classes, self.gap = ahead.classes.astype(np.uint8), n
        self.ahead_accept, self.begins, self.dead = ahead.accept, ahead.starts, ahead.dead
        self.slow_next, self.slow_ends = self.next.tolist(), ahead.accept.tolist()

    def starts(self, data: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """For each byte, bits of the rules of which a match starts there. gaps: places between texts."""
        lane = self.lane
        n_lanes = -(-len(data) // lane)
        classes = np.full(n_lanes * lane, self.width - 1, dtype=np.uint8)
        classes[: len(data)] = self.classes[data]
        classes[gaps] = self.width - 1
        # Reading goes from right to left: step k of a lane is its k-th byte from the end.
        steps = np.ascontiguousarray(classes.reshape(n_lanes, lane).T[::-1])
        marks = np.zeros((lane, n_lanes), dtype=np.uint16)
        began = np.zeros(n_lanes, dtype=np.int32)
        ended = np.zeros(n_lanes, dtype=np.int32)
        todo = np.arange(n_lanes)
        while len(todo) > self.few:
            state = began[todo]
            rows = steps if len(todo) == n_lanes else steps[:, todo]
            got = np.empty((lane, len(todo)), dtype=np.uint16)
            for k in range(lane):
                state = self.flat[state + rows[k]]
                got[k] = self.accept[state]
            marks[:, todo] = got
            ended[todo] = state
            should = np.append(ended[1:], 0).astype(np.int32)
            todo = np.flatnonzero(should != began)
            began = should
        # A few lanes left: each is run by itself, from right to left, until its state agrees with what followed from the old one.
        waiting = sorted(todo.tolist())
        while waiting:
            i = waiting.pop()
            state = int(ended[i + 1]) if i + 1 < n_lanes else 0
            column, out = steps[:, i].tolist(), []
            for c in column:
                state = self.slow[state + c]
                out.append(self.slow_accept[state])
            marks[:, i] = out
            if state != ended[i]:
                ended[i] = state
                if i and (not waiting or waiting[-1] != i - 1):
                    waiting.append(i - 1)
        return np.ascontiguousarray(marks[::-1].T).reshape(-1)[: len(data)]

    def short_ends(self, data: np.ndarray, places: np.ndarray, rule: int, most: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The end of the rule's longest match from each place, and which of them go on after `most` bytes and have no end yet."""
        at, end = places.copy(), places.copy()
        state = np.full(len(places), self.begins[rule], dtype=np.int32)
        live = np.arange(len(places))
        bit = 1 << rule
        for _ in range(most):
            if not len(live):
                break
            state[live] = self.next[state[live], data[at[live]]]
            at[live] += 1
            hit = live[(self.ahead_accept[state[live]] & bit) != 0]
            end[hit] = at[hit]
            live = live[state[live] != self.dead]
        unknown = np.zeros(len(places), dtype=bool)
        unknown[live] = True
        return end, unknown

    def long_end(self, data: np.ndarray, place: int, rule: int) -> int:
        """The end of one match of any length."""
        state, at, end, bit = self.begins[rule], place, place, 1 << rule
        while state != self.dead:
            for c in data[at : at + 4096].tolist():
                state = self.slow_next[state][c]
                at += 1
                if state == self.dead:
                    break
                if self.slow_ends[state] & bit:
                    end = at
        return end

    def leftmost(self, data: np.ndarray, flag: np.ndarray, rule: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the rule's leftmost longest matches that do not overlap; flag: where matches start.

        A match from the first place of a run of starts may cover the others; those that it leaves are taken up where it ends. A start
        inside a match that was taken is never followed, so the work stays linear.
        """
        taken_up = lambda e: bool(flag[e]) and bool(flag[e - 1])
        new = np.flatnonzero(flag & ~np.concatenate([[0], flag[:-1]]).astype(flag.dtype))
        begins, ends, unknowns = [], [], []
        while len(new):
            end, unknown = self.short_ends(data, new, rule)
            begins.append(new)
            ends.append(end)
            unknowns.append(unknown)
            follow = end[~unknown]
            new = np.setdiff1d(follow[(flag[follow] != 0) & (flag[follow - 1] != 0)], np.concatenate(begins))
        if not begins:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        begin, end, unknown = np.concatenate(begins), np.concatenate(ends), np.concatenate(unknowns)
        order = np.argsort(begin, kind="stable")
        begin, end, unknown = begin[order], end[order], unknown[order]
        long = np.append(np.flatnonzero(unknown), len(begin))
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        i, last = 0, 0
        while i < len(begin):
            to = int(long[np.searchsorted(long, i)])
            if to > i:
                kept.append(self._apart(begin[i:to], end[i:to], last))
                last = int(kept[-1][1][-1]) if len(kept[-1][1]) else last
            i = to
            if i == len(begin):
                break
            if begin[i] < last:
                i += 1
                continue
            place = int(begin[i])
            while True:
                last = self.long_end(data, place, rule)
                kept.append((np.array([place]), np.array([last])))
                if not taken_up(last):
                    break
                place = last
            i = int(np.searchsorted(begin, last))
        return tuple(np.concatenate(c) for c in zip(*kept)) if kept else (begin[:0], end[:0])

    def matches(self, texts: list[bytes], least: list[int]) -> list[list[tuple[int, int, int]]]:
        """For each text and rule the leftmost longest matches that do not overlap, as (start, rule, end), by start and rule.

        Of these, matches shorter than the rule's `least` are left out.
        """
        sizes = np.array([len(t) + 1 for t in texts])
        stops = np.cumsum(sizes)
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        marks = self.starts(data, stops - 1)
        ahead = self.ahead_classes[data]
        ahead[stops - 1] = self.gap
        found = []
        for rule in range(len(self.begins)):
            begin, end = self.leftmost(ahead, (marks >> rule) & 1, rule)
            long = end - begin >= least[rule]
            found.append((begin[long], np.full(int(long.sum()), rule), end[long]))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        begin, rule, end = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((rule, begin))
        begin, rule, end = begin[order], rule[order], end[order]
        owner = np.searchsorted(stops, begin, side="right")
        base = stops - sizes
        for o, s, r, e in zip(owner.tolist(), (begin - base[owner]).tolist(), rule.tolist(), (end - base[owner]).tolist()):
            out[o].append((s, r, e))
        return out

    def _apart(self, begin: np.ndarray, end: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
        """From sorted candidates, those that leftmost matching takes after `last`: each starts where the one taken before has ended, or later."""
        reach = np.maximum.accumulate(np.concatenate([[last], end]))
        clash = begin < reach[:-1]
        keep = np.ones(len(begin), dtype=bool)
        at = 0
        for i in np.flatnonzero(clash).tolist():
            if at != i:
                last = int(end[i - 1])
            if begin[i] < last:
                keep[i] = False
            else:
                last = int(end[i])
            at = i + 1
        return begin[keep], end[keep]
