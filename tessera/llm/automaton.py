"""One deterministic automaton from many small patterns, run over overlapping chunks in lockstep with numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class _Nfa:
    """Thompson automaton on bytes: ``moves`` holds ``(byte set, target)``, ``free`` the empty moves."""

    moves: list[list[tuple[frozenset, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1


ANY = frozenset(range(256))
SHORT = {"d": frozenset(b"0123456789"), "w": frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"), "s": frozenset(b" \t"), "n": frozenset(b"\n"), "r": frozenset(b"\r"), "t": frozenset(b"\t")}


class _Pattern:
    """Recursive descent over literals, ``[...]``, ``(a|b)``, ``* + ? {m,n}`` and the escapes of ``SHORT``."""

    def __init__(self, nfa: _Nfa, text: str, fold: bool):
        self.nfa, self.text, self.at, self.fold = nfa, text, 0, fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def choice(self, start: int) -> int:
        end = self.nfa.state()
        while True:
            entry = self.nfa.state()
            self.nfa.free[start].append(entry)
            self.nfa.free[self.sequence(entry)].append(end)
            if self.peek() != "|":
                return end
            self.at += 1

    def sequence(self, at: int) -> int:
        while self.peek() and self.peek() not in "|)":
            begin = self.at
            out = self.atom(at)
            low, high = self.bounds()
            if (low, high) != (1, 1):
                out = self.repeat(at, begin, low, high)
            at = out
        return at

    def repeat(self, at: int, begin: int, low: int, high: int | None) -> int:
        resume = self.at

        def once(start: int) -> int:
            self.at = begin
            return self.atom(start)

        # the atom that was read to find the bounds stays unreachable: begin from a fresh state
        cur = self.nfa.state()
        self.nfa.free[at].clear()
        self.nfa.moves[at].clear()
        self.nfa.free[at].append(cur)
        for _ in range(low):
            cur = once(cur)
        if high is None:
            loop = self.nfa.state()
            self.nfa.free[cur].append(loop)
            self.nfa.free[once(loop)].append(loop)
            cur = loop
        else:
            end = self.nfa.state()
            self.nfa.free[cur].append(end)
            for _ in range(high - low):
                cur = once(cur)
                self.nfa.free[cur].append(end)
            cur = end
        self.at = resume
        out = self.nfa.state()
        self.nfa.free[cur].append(out)
        return out

    def bounds(self) -> tuple[int, int | None]:
        c = self.peek()
        if c and c in "*+?":
            self.at += 1
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        if c == "{":
            low, _, high = self.text[self.at + 1 : (end := self.text.index("}", self.at))].partition(",")
            comma = "," in self.text[self.at : end]
            self.at = end + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def atom(self, at: int) -> int:
        c = self.peek()
        self.at += 1
        if c == "(":
            out = self.choice(at)
            self.at += 1
            return out
        if c == "[":
            chars = self.members()
        elif c == "\\":
            chars = self.escape()
        elif c == ".":
            chars = ANY - frozenset(b"\n\0")
        else:
            chars = frozenset(c.encode()[:1])
        if self.fold:
            chars = chars | frozenset(b for x in chars for b in (bytes([x]).lower() + bytes([x]).upper()))
        out = self.nfa.state()
        self.nfa.moves[at].append((chars, out))
        return out

    def escape(self) -> frozenset:
        c = self.peek()
        self.at += 1
        return SHORT.get(c, frozenset(c.encode()))

    def members(self) -> frozenset:
        negated = self.peek() == "^"
        self.at += negated
        chars: set[int] = set()
        while self.peek() != "]":
            c = self.peek()
            self.at += 1
            if c == "\\":
                chars |= self.escape()
            elif self.peek() == "-" and self.text[self.at + 1] != "]":
                chars |= set(range(ord(c), ord(self.text[self.at + 1]) + 1))
                self.at += 2
            else:
                chars |= set(c.encode())
        self.at += 1
        return ANY - chars - frozenset(b"\0") if negated else frozenset(chars)


class Automaton:
    """The union of ``patterns`` (name, pattern, fold case), unanchored, made deterministic.

    ``find`` gives the end offset and the bit set of names for every place where a pattern ends, ``start_of`` the start of
    the longest match with a given end, by the mirror image of the pattern. No pattern may match a NUL byte, which
    separates texts. States are made when a text first needs them, so whole grammars fit beside each other. Matches may
    be of any length: where a chunk's state after the ``overlap`` is not the one that the chunk before ended in, it is
    run again from there until both agree.
    """

    def __init__(self, patterns: list[tuple[str, str, bool]], chunk: int = 4096, overlap: int = 512, max_states: int = 100_000):
        self.names = [p[0] for p in patterns]
        self.chunk, self.overlap, self.max_states = chunk, overlap, max_states
        self.nfa = nfa = _Nfa()
        start = nfa.state()
        self.accept: dict[int, int] = {}
        self.entries: list[int] = []
        self.ends: list[int] = []
        for bit, (_, text, fold) in enumerate(patterns):
            entry = nfa.state()
            nfa.free[start].append(entry)
            parser = _Pattern(nfa, text, fold)
            end = parser.choice(entry)
            self.accept[end] = 1 << bit
            self.entries.append(entry)
            self.ends.append(end)
            assert parser.at == len(text), text
        # byte classes: bytes that no move tells apart
        sets = list({chars for moves in nfa.moves for chars, _ in moves})
        kinds: dict[tuple, int] = {}
        self.classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint16)
        self.width = len(kinds)
        member = {s: frozenset(int(self.classes[b]) for b in s) for s in sets}
        self.steps = [[(member[chars], t) for chars, t in moves] for moves in nfa.moves]
        self.back: list[list[tuple[frozenset, int]]] = [[] for _ in nfa.moves]
        self.back_free: list[list[int]] = [[] for _ in nfa.moves]
        for s, moves in enumerate(nfa.moves):
            for chars, t in moves:
                self.back[t].append((member[chars], s))
            for t in nfa.free[s]:
                self.back_free[t].append(s)
        self.base = self._closure(frozenset([start]), nfa.free)
        self.mirrors: dict[tuple[int, frozenset, int], frozenset] = {}
        self._reset()

    @staticmethod
    def _closure(states: frozenset, free: list[list[int]]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def _reset(self) -> None:
        self.index: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.known: dict[frozenset, int] = {frozenset(): 0}
        self.table = np.full(1024 * self.width, -1, np.int32)
        self.hits = np.zeros(1024, np.int64)
        self._state(self.base)

    def _state(self, nfa_states: frozenset) -> int:
        kept = frozenset(s for s in nfa_states if self.steps[s] or s in self.accept)
        n = self.index.get(kept)
        if n is None:
            n = self.index[kept] = len(self.sets)
            self.sets.append(kept)
            if n == len(self.hits):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
                self.hits = np.concatenate([self.hits, np.zeros(n, np.int64)])
            self.hits[n] = sum({self.accept[s] for s in kept if s in self.accept})
        return n

    def _make(self, cell: int) -> int:
        """The value of one cell of the table: the row offset of the state that follows."""
        n, kind = divmod(cell, self.width)
        targets = frozenset(t for s in self.sets[n] for chars, t in self.steps[s] if kind in chars)
        nxt = self.known.get(targets)
        if nxt is None:
            nxt = self.known[targets] = self._state(self._closure(targets, self.nfa.free) | self.base)
        self.table[cell] = nxt * self.width
        return nxt * self.width

    def start_of(self, kinds: np.ndarray, end: int, bit: int) -> int | None:
        """Where the longest match of pattern ``bit`` that ends at ``end`` begins; ``kinds`` are byte classes."""
        now, at, best = self._closure(frozenset([self.ends[bit]]), self.back_free), end, None
        while at > 0:
            key = (bit, now, int(kinds[at - 1]))
            nxt = self.mirrors.get(key)
            if nxt is None:
                if len(self.mirrors) > self.max_states:
                    self.mirrors.clear()
                nxt = self._closure(frozenset(s for t in now for chars, s in self.back[t] if key[2] in chars), self.back_free)
                self.mirrors[key] = nxt
            if not nxt:
                break
            now, at = nxt, at - 1
            if self.entries[bit] in now:
                best = at
        return best

    def find(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``buffer`` is one array of bytes. Offsets are those just past a match; each is given once."""
        n = len(buffer)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.sets) > self.max_states:
            self._reset()
        size, step = self.chunk, self.chunk - self.overlap
        count = max(1, -(-(n - self.overlap) // step))
        padded = np.zeros(count * step + self.overlap, np.uint16)
        padded[:n] = self.classes[buffer]
        padded[n:] = self.classes[0]
        chunks = np.lib.stride_tricks.as_strided(padded, (size, count), (padded.strides[0], padded.strides[0] * step))
        state = np.zeros(count, np.int32)
        ends, masks = [], []
        starts = np.arange(count, dtype=np.int64) * step
        entered = state
        for j in range(size):
            cells = state + chunks[j]
            state = self.table[cells]
            if state.min() < 0:
                for cell in np.unique(cells[state < 0]).tolist():
                    self._make(cell)
                state = self.table[cells]
            if j == self.overlap - 1:
                entered = state
            hit = self.hits[state // self.width]
            if hit.any():
                at = np.flatnonzero(hit)
                ends.append(starts[at] + j + 1)
                masks.append(hit[at])
        for c in range(1, count):
            true, held = int(state[c - 1]), int(entered[c])
            if true == held:
                continue
            at = int(starts[c]) + self.overlap
            stop = int(starts[c]) + size
            more, found = [], []
            while at < stop and true != held:
                kind = int(padded[at])
                cell, other = true + kind, held + kind
                true, held = int(self.table[cell]), int(self.table[other])
                if true < 0:
                    true = self._make(cell)
                if held < 0:
                    held = self._make(other)
                at += 1
                if hit := int(self.hits[true // self.width]):
                    more.append(at)
                    found.append(hit)
            if true != held:
                state[c] = true
            if more:
                ends.append(np.array(more, np.int64))
                masks.append(np.array(found, np.int64))
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, mask = np.concatenate(ends), np.concatenate(masks)
        order = np.argsort(end, kind="stable")
        end, mask = end[order], mask[order]
        first = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        return end[first], np.bitwise_or.reduceat(mask, first)
