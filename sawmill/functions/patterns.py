"""Patterns that a matcher which goes back may take exponential time for: found from the pattern alone, before a plan is built.

Spark's matcher tries the ways through a pattern one by one. Their number grows exponentially with the text just when
some character of the pattern can be come back to by two ways over the same text. So the pattern is turned into an
automaton that has a position a character class and counts the ways from each to the next, and pairs of positions are
followed side by side. A loop that nothing can fail after, as in ``(a+)+``, is left alone: its first way is a match.
Anchors and word boundaries count as matching everywhere, so patterns that only they keep apart are refused too.
"""

from __future__ import annotations

import re
from collections import Counter
from re import _constants as op
from re import _parser
from typing import NamedTuple

#: A counted repetition of up to so many is written out, while the automaton has no more than so many positions; others count as loops.
COPIES, POSITIONS = 8, 400

TOP = 0x10FFFF
#: The classes as Spark's matcher has them.
CLASSES = {op.CATEGORY_DIGIT: [(48, 57)], op.CATEGORY_WORD: [(48, 57), (65, 90), (95, 95), (97, 122)], op.CATEGORY_SPACE: [(9, 13), (32, 32)]}
OPPOSITES = {op.CATEGORY_NOT_DIGIT: op.CATEGORY_DIGIT, op.CATEGORY_NOT_WORD: op.CATEGORY_WORD, op.CATEGORY_NOT_SPACE: op.CATEGORY_SPACE}
LINE_ENDS = [(10, 10), (13, 13), (0x85, 0x85), (0x2028, 0x2029)]

Ranges = list[tuple[int, int]]


class Part(NamedTuple):
    """Of a part of the pattern: in how many ways it is empty, begins at a position, and ends at one (2 stands for more, too)."""

    empty: int
    first: Counter
    last: Counter


def _few(ways: dict[int, int], times: int = 1) -> Counter:
    return Counter({p: min(2, n * times) for p, n in ways.items() if n * times})


def _without(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for low, high in sorted(ranges):
        if low > at:
            out.append((at, low - 1))
        at = max(at, high + 1)
    return [*out, (at, TOP)] if at <= TOP else out


def _any_case(ranges: Ranges) -> Ranges:
    both = list(ranges)
    for low, high in ranges:
        for start, shift in ((65, 32), (97, -32)):
            if max(low, start) <= min(high, start + 25):
                both.append((max(low, start) + shift, min(high, start + 25) + shift))
    return both


class Automaton:
    """The positions of a pattern, what each reads, and in how many ways each is followed by another.

    With ``stops`` anchors are positions that read nothing: then ``whole.last`` has just the positions after which nothing can fail.
    """

    def __init__(self, parsed: _parser.SubPattern, stops: bool = False):
        self.stops, self.reads, self.follow = stops, [], []
        self.whole = self._row(parsed, parsed.state.flags)

    def _position(self, ranges: Ranges) -> Part:
        self.reads.append(ranges)
        self.follow.append(Counter())
        p = len(self.reads) - 1
        return Part(0, Counter({p: 1}), Counter({p: 1}))

    def _join(self, last: Counter, first: Counter) -> None:
        for p, n in last.items():
            for q, m in first.items():
                self.follow[p][q] = min(2, self.follow[p][q] + n * m)

    def _then(self, a: Part, b: Part) -> Part:
        self._join(a.last, b.first)
        return Part(min(2, a.empty * b.empty), _few(a.first + _few(b.first, a.empty)), _few(b.last + _few(a.last, b.empty)))

    def _row(self, items, flags: int) -> Part:
        part = Part(1, Counter(), Counter())
        for kind, arg in items:
            part = self._then(part, self._item(kind, arg, flags))
        return part

    def _item(self, kind, arg, flags: int) -> Part:
        if kind in (op.LITERAL, op.NOT_LITERAL, op.IN, op.ANY):
            return self._position(_ranges(kind, arg, flags))
        if kind is op.AT:
            anchor = self._position([])
            return anchor if self.stops else Part(1, Counter(), Counter())
        if kind is op.SUBPATTERN:
            _, more, fewer, items = arg
            return self._row(items, (flags | more) & ~fewer)
        if kind is op.BRANCH:
            parts = [self._row(items, flags) for items in arg[1]]
            return Part(min(2, sum(x.empty for x in parts)), _few(sum((x.first for x in parts), Counter())), _few(sum((x.last for x in parts), Counter())))
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            return self._repeated(*arg, flags)
        raise ValueError(f"{str(kind).lower().replace('_', ' ')} is not supported")

    def _repeated(self, least: int, most: int, items, flags: int) -> Part:
        if most > COPIES or len(self.reads) > POSITIONS:
            copies = least - 1 if 1 < least <= COPIES and len(self.reads) <= POSITIONS else 0
            part = Part(1, Counter(), Counter())
            for _ in range(copies):
                part = self._then(part, self._row(items, flags))
            loop = self._row(items, flags)
            if most > 1:
                self._join(loop.last, loop.first)
            return self._then(part, loop if least else _optional(loop))
        part = Part(1, Counter(), Counter())
        for _ in range(most - least):
            part = _optional(self._then(self._row(items, flags), part))
        for _ in range(least):
            part = self._then(self._row(items, flags), part)
        return part

    def meet(self, p: int, q: int) -> bool:
        return any(max(a, c) <= min(b, d) for a, b in self.reads[p] for c, d in self.reads[q])

    def loops(self) -> list[set[int]]:
        """Groups of positions that can all be come to from each other."""
        n = len(self.reads)
        reach = [sum(1 << q for q in self.follow[p] if self.reads[q]) if self.reads[p] else 0 for p in range(n)]
        for k in range(n):
            for p in range(n):
                if reach[p] >> k & 1:
                    reach[p] |= reach[k]
        groups, seen = [], set()
        for p in range(n):
            if p not in seen and reach[p] >> p & 1:
                groups.append({q for q in range(n) if reach[p] >> q & 1 and reach[q] >> p & 1})
                seen |= groups[-1]
        return groups

    def ambiguous(self, group: set[int]) -> bool:
        """Can a position of a loop be come back to in two ways over one text?"""
        steps = {p: [q for q in self.follow[p] if q in group] for p in group}
        if any(self.follow[p][q] > 1 for p in group for q in steps[p]):
            return True
        back, todo, seen = {}, [(p, p) for p in group], {(p, p) for p in group}
        while todo:
            pair = todo.pop()
            for a in steps[pair[0]]:
                for b in steps[pair[1]]:
                    to = (min(a, b), max(a, b))
                    if self.meet(a, b):
                        back.setdefault(to, set()).add(pair)
                        if to not in seen:
                            seen.add(to)
                            todo.append(to)
        todo, seen = [(p, p) for p in group], set()
        while todo:
            for pair in back.get(todo.pop(), ()):
                if pair[0] != pair[1]:
                    return True  # came from one position, since all pairs here did, and goes back to one
                if pair not in seen:
                    seen.add(pair)
                    todo.append(pair)
        return False


def _optional(part: Part) -> Part:
    return part._replace(empty=min(2, part.empty + 1))


def _ranges(kind, arg, flags: int) -> Ranges:
    """What a character class reads."""
    if kind is op.ANY:
        return [(0, TOP)] if flags & re.DOTALL else _without(LINE_ENDS)
    found, negated = [], kind is op.NOT_LITERAL
    for what, value in arg if kind is op.IN else [(op.LITERAL, arg)]:
        if what is op.NEGATE:
            negated = True
        elif what is op.LITERAL:
            found.append((value, value))
        elif what is op.RANGE:
            found.append(value)
        else:
            found += CLASSES[value] if value in CLASSES else _without(CLASSES[OPPOSITES[value]])
    found = _any_case(found) if flags & re.IGNORECASE else found
    return _without(found) if negated else found


def exponential(pattern: str, ignore_case: bool = False) -> bool:
    """May a text exist, for each length, that takes Spark's matcher a time exponential in it? Unsupported syntax is a ValueError."""
    # An empty group at the start of each alternative keeps the parser from joining alternatives that read the same.
    apart = re.sub(r"(\\.|\[\^?\]?(?:\\.|[^\]\\])*\])|\|", lambda m: m[1] or "|()", pattern, flags=re.DOTALL)
    parsed = _parser.parse(apart, re.IGNORECASE if ignore_case else 0)
    ways, ends = Automaton(parsed), Automaton(parsed, stops=True).whole.last
    return any(not group <= set(ends) and ways.ambiguous(group) for group in ways.loops())
