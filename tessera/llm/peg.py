"""Packrat parsing-expression grammars on tokens, compiled to Python functions.

A grammar is text: ``name = expression`` per rule, continued on indented lines. Expressions know ``/`` (ordered
choice), sequences, ``? * +``, ``e % "s"`` (one or more ``e`` with ``s`` between), ``! &`` (look ahead) and
parentheses. ``"x"`` is a keyword or operator token, ``'x'`` an identifier with that text, upper-case names are token
classes, ``KW`` is any keyword, ``ANY`` any token, ``@nl`` and ``@nonl`` hold if there is (no) line end before the next token.
"""

from __future__ import annotations

import re

LEX = re.compile(r"""\s*(?:("[^"]+")|('[^']+')|(@\w+)|([A-Za-z_]\w*)|([/?*+%!&()=]))""")


KEEP = 200_000
"""Tokens behind which a parse forgets what it has memorised; what it tries again from within them stays known."""


class _Reader:
    def __init__(self, text: str):
        self.rules: dict[str, tuple] = {}
        name, body = None, ""
        for line in [*text.split("\n"), "END = x"]:
            if line.strip() and not line[0].isspace():
                if name:
                    self.rules[name] = self.read(body)
                name, _, body = (x.strip() for x in line.partition("="))
            elif line.strip():
                body += " " + line
        for name, rule in self.rules.items():
            for used in self._names(rule):
                assert used in self.rules, f"{name} uses {used}"

    def _names(self, node):
        if node[0] == "rule":
            yield node[1]
        for x in node[1:]:
            if isinstance(x, tuple):
                yield from self._names(x)
            elif isinstance(x, list):
                for y in x:
                    yield from self._names(y)

    def read(self, text: str) -> tuple:
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = LEX.match(text, at)
            assert m, text[at : at + 40]
            self.tokens.append(m.group(0).strip())
            at = m.end()
        self.at = 0
        node = self.choice()
        assert self.at == len(self.tokens), (text, self.tokens[self.at :][:5])
        return node

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def choice(self) -> tuple:
        options = [self.sequence()]
        while self.peek() == "/":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("choice", options)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "/)":
            parts.append(self.prefixed())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def prefixed(self) -> tuple:
        if self.peek() in ("!", "&"):
            return ("not" if self.take() == "!" else "and", self.prefixed())
        node = self.atom()
        while self.peek() and self.peek() in "?*+%":
            op = self.take()
            if op == "?":
                node = ("opt", node)
            elif op == "*":
                node = ("star", node)
            elif op == "+":
                node = ("seq", [node, ("star", node)])
            else:
                node = ("seq", [node, ("star", ("seq", [self.atom(), node]))])
        return node

    def atom(self) -> tuple:
        t = self.take()
        if t == "(":
            node = self.choice()
            assert self.take() == ")"
            return node
        if t[0] == '"':
            return ("token", t[1:-1])
        if t[0] == "'":
            return ("word", t[1:-1])
        if t[0] == "@":
            return ("at", t[1:])
        return ("kind", t) if t.isupper() else ("rule", t)


class Grammar:
    """A compiled grammar. ``parse`` gives the position after ``start`` or -1; ``furthest`` the last token tried.

    ``parse`` looks at the next token before it tries a rule or an alternative that can't begin with it; ``furthest``
    tries everything in order, so that the last token tried is that of the grammar alone.
    """

    def __init__(self, text: str, keywords: set[str], start: str = "file"):
        self.reader = _Reader(text)
        self.start = start
        self.keywords = frozenset(keywords)
        self.firsts: dict[str, tuple[frozenset | None, bool]] = {name: (frozenset(), False) for name in self.reader.rules}
        changed = True
        while changed:
            changed = False
            for name, node in self.reader.rules.items():
                now = self.first(node)
                changed |= now != self.firsts[name]
                self.firsts[name] = now
        self.fast = self._compile(False)
        self.tracing = self._compile(True)

    def first(self, node: tuple) -> tuple[frozenset | None, bool]:
        """The token kinds that a match can begin with (nothing known: ``None``), and whether it can be empty."""
        op = node[0]
        if op == "word":
            return frozenset(["NAME"]), False
        if op in ("token", "kind"):
            return (None if node[1] == "ANY" else self.keywords if node[1] == "KW" else frozenset([node[1]])), False
        if op == "rule":
            return self.firsts[node[1]]
        if op in ("not", "and", "at"):
            return frozenset(), True
        if op in ("opt", "star"):
            return self.first(node[1])[0], True
        kinds: frozenset | None = frozenset()
        empty = op == "seq"
        for part in node[1]:
            f, e = self.first(part)
            kinds = None if kinds is None or f is None else kinds | f
            if op == "choice":
                empty |= e
            elif not e:
                return kinds, False
        return kinds, empty

    def guard(self, node: tuple, src: str) -> str | None:
        """A test of the next token without which ``node`` can't match."""
        kinds, empty = self.first(node)
        if self.tracing_on or empty or kinds is None:
            return None
        if len(kinds) == 1:
            return f"K[{src}] == {next(iter(kinds))!r}"
        name = self.sets.setdefault(kinds, f"F{len(self.sets)}")
        return f"K[{src}] in {name}"

    def parse(self, kinds: list[str], values: list[str], breaks: list[bool]) -> bool:
        return self.fast(kinds, values, breaks)[0] == len(kinds)

    def furthest(self, kinds: list[str], values: list[str], breaks: list[bool]) -> int:
        return self.tracing(kinds, values, breaks)[1]

    def _compile(self, tracing: bool):
        self.lines = ["def parse(K, V, N):", "    far = 0", f"    keep = {2 * KEEP}"]
        self.count, self.tracing_on, self.sets, self.testing = 0, tracing, {}, set()
        for name in self.reader.rules:
            self.lines += [f"    memo_{name} = {{}}"]
        # what lies far behind is forgotten, so that the memory of a long parse is bounded
        self.lines += ["    def forget(p):", "        nonlocal keep", f"        keep = p + {KEEP}", f"        least = p - {KEEP}"]
        self.lines += [f"        for memo in ({', '.join(f'memo_{name}' for name in self.reader.rules)},):"]
        self.lines += ["            near = {k: r for k, r in memo.items() if k >= least}", "            memo.clear()", "            memo.update(near)"]
        for name, node in self.reader.rules.items():
            self.lines += [f"    def r_{name}(p):", *(["        nonlocal far"] if tracing else [])]
            test = self.test(node, "p")
            if test and not tracing:
                # one token: nothing to memorise
                self.lines += [f"        return p + 1 if {test} else -1"]
                continue
            self.lines += [f"        r = memo_{name}.get(p)", "        if r is not None: return r"]
            self.emit(node, "p", "r", 2)
            self.lines += [f"        memo_{name}[p] = r", "        return r"]
        self.lines += [f"    return r_{self.start}(0), far"]
        scope: dict = {"KW": self.keywords} | {name: kinds for kinds, name in self.sets.items()}
        exec(compile("\n".join(self.lines), "<grammar>", "exec"), scope)  # noqa: S102
        return scope["parse"]

    def out(self, depth: int, text: str) -> None:
        self.lines.append("    " * depth + text)

    def fresh(self) -> str:
        self.count += 1
        return f"v{self.count}"

    def test(self, node: tuple, src: str) -> str | None:
        if node == ("kind", "ANY"):
            return "True"
        if node[0] in ("token", "kind"):
            return f"K[{src}] in KW" if node[1] == "KW" else f"K[{src}] == {node[1]!r}"
        if node[0] == "word":
            return f"V[{src}] == {node[1]!r} and K[{src}] == 'NAME'"
        if node[0] == "choice" and all(x[0] in ("token", "kind") and x[1] not in ("KW", "ANY") for x in node[1]):
            return f"K[{src}] in {{{', '.join(repr(x[1]) for x in node[1])}}}"
        if node[0] == "rule" and not self.tracing_on and node[1] not in self.testing:
            # a rule of one token is tested where it is used
            self.testing.add(node[1])
            found = self.test(self.reader.rules[node[1]], src)
            self.testing.discard(node[1])
            return found
        return None

    def emit(self, node: tuple, src: str, dst: str, d: int) -> None:
        test = self.test(node, src)
        if test:
            self.out(d, f"if {test}: {dst} = {src} + 1")
            self.out(d, "else:")
            self.out(d + 1, f"{dst} = -1")
            if self.tracing_on:
                self.out(d + 1, f"if {src} > far: far = {src}")
        elif node[0] == "rule":
            guard = self.guard(node, src)
            self.out(d, f"{dst} = r_{node[1]}({src})" + (f" if {guard} else -1" if guard else ""))
        elif node[0] == "at":
            self.out(d, f"{dst} = {src} if {'' if node[1] == 'nl' else 'not '}N[{src}] else -1")
        elif node[0] == "seq":
            self.out(d, f"{dst} = -1")
            at = src
            for i, part in enumerate(node[1]):
                nxt = self.fresh()
                self.emit(part, at, nxt, d)
                if i == len(node[1]) - 1:
                    self.out(d, f"{dst} = {nxt}")
                else:
                    self.out(d, f"if {nxt} >= 0:")
                    d += 1
                at = nxt
            if not node[1]:
                self.out(d, f"{dst} = {src}")
        elif node[0] == "choice":
            for i, part in enumerate(node[1]):
                guard = self.guard(part, src) if part[0] == "seq" else None
                if not i and guard:
                    self.out(d, f"{dst} = -1")
                if i or guard:
                    self.out(d, f"if {' and '.join(([f'{dst} < 0'] if i else []) + ([guard] if guard else []))}:")
                self.emit(part, src, dst, d + bool(i or guard))
        elif node[0] == "opt":
            v = self.fresh()
            self.emit(node[1], src, v, d)
            self.out(d, f"{dst} = {v} if {v} >= 0 else {src}")
        elif node[0] == "star":
            v, at = self.fresh(), self.fresh()
            self.out(d, f"{at} = {src}")
            self.out(d, "while True:")
            self.emit(node[1], at, v, d + 1)
            self.out(d + 1, f"if {v} <= {at}: break")
            self.out(d + 1, f"{at} = {v}")
            self.out(d + 1, f"if {v} > keep: forget({v})")
            self.out(d, f"{dst} = {at}")
        else:
            v = self.fresh()
            self.emit(node[1], src, v, d)
            if node[0] == "not" and self.tracing_on:
                self.out(d, f"if {v} >= 0 and {src} > far: far = {src}")
            hit, miss = (src, -1) if node[0] == "and" else (-1, src)
            self.out(d, f"{dst} = {hit} if {v} >= 0 else {miss}")
