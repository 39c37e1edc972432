"""Patterns that a backtracking matcher may take for ever on, found before they run.

A pattern is slow without bound where a loop can read one word in two ways: each repetition
doubles the ways to fail. The pattern becomes an automaton of its positions (one for each sign or
class); two different ways from a position back to itself over the same word are two different paths
in the automaton's product with itself, within one of its strongly connected parts. A loop within a loop, as in ``(a*)*``, gives an arc
twice, which is two ways as well.
"""

from __future__ import annotations

import functools
import re
from re import _constants as C  # type: ignore[attr-defined]
from re import _parser as parser  # type: ignore[attr-defined]

#: Signs that classes are told apart by; the last bit stands for all others.
_SIGNS, _OTHER = 128, 1 << 128
_ALL = (1 << 129) - 1
#: Copies of a counted part that are looked at; positions of a pattern at most (a longer one is not looked at).
_COPIES, MOST_POSITIONS = 3, 150


def _of(test) -> int:
    return sum(1 << i for i in range(_SIGNS) if test(chr(i)))


_CATEGORY = {
    C.CATEGORY_DIGIT: _of(str.isdigit), C.CATEGORY_SPACE: _of(str.isspace), C.CATEGORY_WORD: _of(lambda c: c.isalnum() or c == "_") | _OTHER,
}
_NOT = {C.CATEGORY_NOT_DIGIT: C.CATEGORY_DIGIT, C.CATEGORY_NOT_SPACE: C.CATEGORY_SPACE, C.CATEGORY_NOT_WORD: C.CATEGORY_WORD}


def _category(kind) -> int:
    return _CATEGORY[kind] if kind in _CATEGORY else (_ALL & ~_CATEGORY[_NOT[kind]]) | _OTHER


def _literal(code: int) -> int:
    c = chr(code)
    return _OTHER if code >= _SIGNS else 1 << ord(c.lower()) | 1 << ord(c.upper())  # rules ignore case


def _class(items: list) -> int:
    out, negated = 0, False
    for op, arg in items:
        if op is C.NEGATE:
            negated = True
        elif op is C.LITERAL:
            out |= _literal(arg)
        elif op is C.RANGE:
            for i in range(arg[0], min(arg[1], _SIGNS - 1) + 1):
                out |= _literal(i)
            out |= _OTHER if arg[1] >= _SIGNS else 0
        elif op is C.CATEGORY:
            out |= _category(arg)
    return (_ALL & ~out) | _OTHER if negated else out


class _Automaton:
    """Positions with their signs, arcs between them, and arcs that there are twice."""

    def __init__(self):
        self.signs: list[int] = []
        self.arcs: list[set[int]] = []
        self.twice: set[tuple[int, int]] = set()

    def _position(self, signs: int):
        self.signs.append(signs)
        self.arcs.append(set())
        if len(self.signs) > MOST_POSITIONS:
            raise OverflowError
        return False, [len(self.signs) - 1], [len(self.signs) - 1]

    def _join(self, last: list[int], first: list[int]) -> None:
        for p in last:
            for q in first:
                if q in self.arcs[p]:
                    self.twice.add((p, q))
                self.arcs[p].add(q)

    def _sequence(self, parts):
        """(may be empty, first positions, last positions) of parts one behind another."""
        empty, first, last = True, [], []
        for e, f, l in parts:  # noqa: E741
            self._join(last, f)
            first = first + f if empty else first
            last = last + l if e else l
            empty = empty and e
        return empty, first, last

    def _loop(self, part):
        empty, first, last = part
        self._join(last, first)
        return True, first, last

    def of(self, tree) -> tuple[bool, list[int], list[int]]:
        return self._sequence(self._part(op, arg) for op, arg in tree)

    def _part(self, op, arg):
        if op is C.LITERAL:
            return self._position(_literal(arg))
        if op is C.NOT_LITERAL:
            return self._position((_ALL & ~_literal(arg)) | _OTHER)
        if op is C.ANY:
            return self._position(_ALL & ~(1 << 10))
        if op is C.IN:
            return self._position(_class(arg))
        if op is C.CATEGORY:
            return self._position(_category(arg))
        if op is C.SUBPATTERN:
            return self.of(arg[-1])
        if op is C.BRANCH:
            ways = [self.of(x) for x in arg[1]]
            return any(w[0] for w in ways), [p for w in ways for p in w[1]], [p for w in ways for p in w[2]]
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, tree = arg
            endless = high is C.MAXREPEAT
            parts = [self.of(tree) for _ in range(min(low, _COPIES))]
            if endless:
                parts.append(self._loop(self.of(tree)))
            else:
                parts += [(True, *self.of(tree)[1:]) for _ in range(min(high - low, _COPIES))]
            return self._sequence(parts)
        return True, [], []  # places, look-arounds, references: no sign read in a loop


def _kept_apart(pattern: str) -> str:
    """The pattern with an empty group behind each ``|`` that is no sign of a class: else Python's parser makes one class of alternatives of one sign, and two that overlap could not be seen."""
    return re.sub(r"(?s)(\\.|\[\^?\]?(?:\\.|[^\]\\])*\])|\|", lambda m: m[1] or "|()", pattern)


def _parts(arcs: dict[object, list]) -> dict[object, int]:
    """Number of the strongly connected part of each node, without recursion."""
    number, low, part, stack, on = {}, {}, {}, [], set()
    for root in arcs:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        work = [(root, iter(arcs[root]))]
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    stack.append(to)
                    on.add(to)
                    work.append((to, iter(arcs[to])))
                    break
                if to in on:
                    low[node] = min(low[node], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part[x] = number[node]
                        if x == node:
                            break
    return part


@functools.lru_cache(maxsize=1000)
def ambiguous(pattern: str) -> bool:
    """Whether some loop of the pattern reads a word in two ways. False for a pattern that cannot be read here or has too many positions."""
    text = re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern)
    text = re.sub(r"\\p\{\w+\}", r"[^\\W\\d_]", text)
    try:
        automaton = _Automaton()
        automaton.of(parser.parse(_kept_apart(text)))
    except (re.error, OverflowError, RecursionError, ValueError):
        return False
    signs, arcs = automaton.signs, automaton.arcs
    own = _parts({p: list(arcs[p]) for p in range(len(signs))})
    if any(own[p] == own[q] for p, q in automaton.twice):
        return True
    # Pairs of positions in one part of the automaton that one word can lead to.
    pairs: dict[object, list] = {}
    todo = [(p, p) for p in range(len(signs))]
    while todo:
        pair = todo.pop()
        if pair in pairs:
            continue
        p, q = pair
        pairs[pair] = [(a, b) for a in arcs[p] for b in arcs[q] if own[a] == own[b] == own[p] and signs[a] & signs[b]]
        todo += pairs[pair]
    part = _parts(pairs)
    straight = {part[p, p] for p in range(len(signs))}
    return any(p != q and part[p, q] in straight for p, q in pairs)
