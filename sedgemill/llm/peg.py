"""A small parsing-expression matcher: a grammar as text, tokens in, function nodes out.

Grammar text has one rule per line: ``name: a b / c``. ``'x'`` is a token of that kind, ``"x"`` an identifier of that text, capitals
are token kinds, small letters rules; ``* + ? & !`` and parentheses as usual. A rule named ``@x`` is a function node: its first FNAME
is the function's name. A rule that can come back to itself keeps its results by position, so that the time of a text is linear in
its tokens however deep it nests.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

PART = re.compile(r"\s*(?:'([^']+)'|\"([^\"]+)\"|([A-Z]+\b)|([a-z_0-9]+)|([()/*+?&!]))")


SPECIAL = ("EOS", "NLB", "NAME", "FNAME", "PNAME", "ANY", "ADJ", "UNA")


@dataclass
class Tokens:
    """kind, text, start, end of each token, whether a line break comes before it, and all comments (start, end)."""

    kind: list[str]
    text: list[str]
    start: list[int]
    end: list[int]
    broken: list[bool]
    comments: list[tuple[int, int]]


class Grammar:
    def __init__(self, *sources: str) -> None:
        """Later sources replace rules of earlier ones."""
        self.rules: dict[str, tuple] = {}
        self.marked: set[str] = set()
        for source in sources:
            for line in source.splitlines():
                if line.strip() and not line.startswith("#"):
                    name, body = line.split(":", 1)
                    name = name.strip()
                    if name.startswith("@"):
                        name = name[1:]
                        self.marked.add(name)
                    parts = [m.groups() for m in PART.finditer(body)]
                    self.rules[name], rest = self._choice(parts, 0)
                    if rest != len(parts):
                        raise ValueError(f"{name}: {parts[rest]}")
        self.first = self._first_sets()
        self.kept = self._recursive()
        self.compiled: dict = {}
        for name in reversed(self.rules):  # the lower rules come last; what is compiled is called directly
            self._rule(name)

    # text -> tree
    def _choice(self, parts: list, i: int) -> tuple[tuple, int]:
        options, items = [], []
        while i < len(parts) and parts[i][4] != ")":
            if parts[i][4] == "/":
                options.append(("seq", tuple(items)))
                items, i = [], i + 1
            else:
                item, i = self._item(parts, i)
                items.append(item)
        options.append(("seq", tuple(items)))
        return (options[0] if len(options) == 1 else ("alt", tuple(options))), i

    def _item(self, parts: list, i: int) -> tuple[tuple, int]:
        token, ident, kind, rule, mark = parts[i]
        if mark in ("&", "!"):
            node, i = self._item(parts, i + 1)
            return ("and" if mark == "&" else "not", node), i
        if mark == "(":
            node, i = self._choice(parts, i + 1)
        elif token:
            node = ("kind", token)
        elif ident:
            node = ("text", ident)
        elif kind:
            node = ("special" if kind in SPECIAL else "kind", kind)
        else:
            node = ("rule", rule)
        i += 1
        if i < len(parts) and parts[i][4] in ("*", "+", "?"):
            node, i = (parts[i][4], node), i + 1
        return node, i

    # which kinds can begin an expression; None in the set: any, or nothing at all
    def _first_of(self, node: tuple) -> set:
        op = node[0]
        if op == "kind":
            return {node[1]}
        if op == "text":
            return {"ID"}
        if op == "special":
            return {"ID"} if node[1] == "FNAME" else {None}
        if op == "rule":
            return self._sets.get(node[1], set())
        if op in ("and", "not", "*", "?"):
            return {None}
        if op == "+":
            return self._first_of(node[1])
        if op == "alt":
            return set().union(*(self._first_of(x) for x in node[1]))
        out: set = set()
        for x in node[1]:
            f = self._first_of(x)
            if x[0] == "not" or x[0] == "and":
                continue
            if x[0] in ("*", "?"):
                out |= self._first_of(x[1])
                continue
            return out | f
        return out | {None}

    def _first_sets(self) -> dict[str, set]:
        self._sets: dict[str, set] = {name: set() for name in self.rules}
        while True:
            new = {name: self._first_of(node) for name, node in self.rules.items()}
            if new == self._sets:
                return new
            self._sets = new

    def _recursive(self) -> dict[str, int]:
        """A number for each rule that can come back to itself."""

        def used(node) -> set[str]:
            if node[0] == "rule":
                return {node[1]}
            parts = node[1] if isinstance(node[1], tuple) and node[0] in ("seq", "alt") else (node[1],) if isinstance(node[1], tuple) else ()
            return set().union(*(used(x) for x in parts))

        direct = {name: used(node) for name, node in self.rules.items()}
        out: dict[str, int] = {}
        for name in direct:
            seen, todo = set(), list(direct[name])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += direct.get(x, ())
            if name in seen:
                out[name] = len(out)
        return out

    # tree -> closures over the parser's state
    def _rule(self, name: str) -> None:
        body = self._compile(self.rules[name])
        if name in self.marked:
            inner = body

            def body(s, i):
                at = len(s.found)
                j = inner(s, i)
                if j >= 0:
                    for k in range(at, len(s.found)):
                        if len(s.found[k]) == 1:
                            s.found[k] = (s.found[k][0], i, j)
                            break
                return j

        if name in self.kept:
            number = self.kept[name]

            def run(s, i):
                memo = s.memo[number]
                hit = memo.get(i)
                if hit is not None:
                    if hit.__class__ is int:
                        return hit
                    s.found.extend(hit[1])
                    return hit[0]
                at = len(s.found)
                j = body(s, i)
                memo[i] = (j, s.found[at:]) if j >= 0 and len(s.found) > at else j
                return j

        else:
            run = body
        self.compiled[name] = run

    def _compile(self, node: tuple):
        op = node[0]
        if op == "kind":
            k = node[1]
            return lambda s, i: i + 1 if s.kind[i] == k else -1
        if op == "text":
            t = node[1]
            return lambda s, i: i + 1 if s.text[i] == t and s.kind[i] == "ID" else -1
        if op == "special":
            return getattr(_Special, node[1])
        if op == "rule":
            if node[1] not in self.rules:
                raise ValueError(f"no rule {node[1]}")
            name, table = node[1], self.compiled
            if name in table:
                return table[name]
            return lambda s, i: table[name](s, i)
        if op == "seq":
            parts = [self._compile(x) for x in node[1]]
            if len(parts) == 1:
                return parts[0]

            def seq(s, i):
                for p in parts:
                    i = p(s, i)
                    if i < 0:
                        return -1
                return i

            return seq
        if op == "alt":
            options = [(self._compile(x), self._first_of(x)) for x in node[1]]
            options = [(p, None if None in f else frozenset(f)) for p, f in options]

            def alt(s, i):
                k, at = s.kind[i], len(s.found)
                for p, f in options:
                    if f is None or k in f:
                        j = p(s, i)
                        if j >= 0:
                            return j
                        del s.found[at:]
                return -1

            return alt
        inner = self._compile(node[1])
        f = self._first_of(node[1])
        first = None if None in f else frozenset(f)
        if op in ("and", "not"):
            want = op == "and"

            def look(s, i):
                at = len(s.found)
                hit = inner(s, i) >= 0
                del s.found[at:]
                return i if hit == want else -1

            return look
        if op == "?":

            def maybe(s, i):
                if first is not None and s.kind[i] not in first:
                    return i
                at = len(s.found)
                j = inner(s, i)
                if j < 0:
                    del s.found[at:]
                    return i
                return j

            return maybe

        def many(s, i):
            if op == "+":
                i = inner(s, i)
                if i < 0:
                    return -1
            while first is None or s.kind[i] in first:
                at = len(s.found)
                j = inner(s, i)
                if j < 0:
                    del s.found[at:]
                    return i
                if j == i:
                    return i
                i = j
            return i

        return many

    def parse(self, tokens: Tokens) -> list[tuple[int, int, int]] | None:
        """Function nodes as (token of the name, first token, end token), or None if the tokens are no program."""
        s = _State(tokens, len(self.kept))
        if self.compiled["start"](s, 0) < 0:
            return None
        return [f for f in s.found if len(f) == 3]


class _State:
    __slots__ = ("kind", "text", "broken", "start", "end", "found", "memo")

    def __init__(self, t: Tokens, kept: int) -> None:
        self.kind, self.text, self.broken, self.start, self.end = t.kind, t.text, t.broken, t.start, t.end
        self.found: list = []
        self.memo: list[dict] = [{} for _ in range(kept)]


class _Special:
    """Terminals that are no plain kinds."""

    @staticmethod
    def EOS(s, i):  # end of a statement where it may be left out
        k = s.kind[i]
        return i + 1 if k == ";" else i if k in ("}", "EOF") or s.broken[i] else -1

    @staticmethod
    def NLB(s, i):  # a line break comes before this token
        return i if s.broken[i] else -1

    @staticmethod
    def ADJ(s, i):  # no blank before this token
        return i if i and s.end[i - 1] == s.start[i] else -1

    @staticmethod
    def UNA(s, i):  # a blank before this token and none after it
        return i if 0 < i < len(s.start) - 1 and s.end[i - 1] < s.start[i] and s.end[i] == s.start[i + 1] else -1

    @staticmethod
    def NAME(s, i):  # an identifier or a reserved word
        c = s.text[i][:1]
        return i + 1 if (c.isalpha() or c in ("_", "$", "#")) and s.text[i] != "#" and s.kind[i] not in ("STR", "NUM", "CHR", "TPL") else -1

    @staticmethod
    def FNAME(s, i):  # the name of a function node
        if s.kind[i] != "ID":
            return -1
        s.found.append((i,))
        return i + 1

    @staticmethod
    def PNAME(s, i):  # the same, reserved words too
        j = _Special.NAME(s, i)
        if j >= 0:
            s.found.append((i,))
        return j

    @staticmethod
    def ANY(s, i):
        return i + 1 if s.kind[i] != "EOF" else -1
