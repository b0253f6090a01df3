"""What a text must have for a pattern to match: literals or digits, read off the pattern, and the stretches of a text where a match can lie.

A pattern is looked for only in texts that have what it needs, and, where its matches are of bounded width, only around those places. A batch's
texts are asked for a literal all at once, so a literal that no text has costs one search a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

_DIGITS, _LONG = "digits", "long"
#: Characters without a space between from which on a word is long.
LONG = 16
#: Widths from which on a pattern counts as unbounded.
WIDE = 400
_PLACES = {_DIGITS: re.compile(r"\d"), _LONG: re.compile(rf"\S{{{LONG},}}")}


@dataclass(frozen=True)
class Gate:
    """needs: literals, folded, of which every match has one, or that it has a digit or a part of a long word; empty if nothing is known."""

    needs: frozenset[str] | str
    width: int


def fold(text: str) -> str:
    """Text in which every letter that a pattern without case takes for another one is that one."""
    return text.casefold().replace("ı", "i")


def _class(items: list) -> frozenset[str] | str | None:
    out = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(fold(chr(arg)))
        elif op is C.RANGE and arg[1] - arg[0] < 10:
            out |= {fold(chr(i)) for i in range(arg[0], arg[1] + 1)}
        elif op is C.CATEGORY and arg is C.CATEGORY_DIGIT:
            out |= set("0123456789*")
        else:
            return None
    if out <= set("0123456789*"):
        return _DIGITS
    return frozenset(out) if len(out) <= 4 else None


def _value(need: frozenset[str] | str) -> tuple:
    """Literals of three characters tell more than long words, those more than digits, and digits more than single characters; fewer literals more than many."""
    if need in (_DIGITS, _LONG):
        return (2.5 if need == _DIGITS else 3.5, 0)
    shortest = min(map(len, need))
    return (shortest + 1 if shortest > 1 else 2, -len(need))


def _spaceless(items: list) -> bool:
    return all(op in (C.RANGE, C.LITERAL) and not chr(arg if op is C.LITERAL else arg[0]).isspace() for op, arg in items)


def _needs(tree: Iterable) -> list[frozenset[str] | str]:
    """What a sequence needs: its parts' needs and its runs of literals."""
    found, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is C.LITERAL:
            run += fold(chr(arg))
            continue
        if run:
            found.append(_DIGITS if run.isdigit() else frozenset([run]))
            run = ""
        if op is C.IN:
            found.append(_class(arg))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            found += _needs(arg[2])
            if arg[0] >= LONG and len(arg[2]) == 1 and arg[2][0][0] is C.IN and _spaceless(arg[2][0][1]):
                found.append(_LONG)
        elif op is C.SUBPATTERN:
            found += _needs(arg[3])
        elif op is C.BRANCH:
            ways = [_needs(w) for w in arg[1]]
            found += [kind for kind in (_DIGITS, _LONG) if all(kind in w for w in ways)]
            literals = [max((n for n in w if isinstance(n, frozenset)), key=_value, default=None) for w in ways]
            if None not in literals:
                found.append(frozenset().union(*literals))
    return [n for n in found if n is not None]


def gate(pattern: str, flags: int = 0) -> Gate:
    tree = parser.parse(pattern, flags)
    return Gate(max(_needs(tree), key=_value, default=frozenset()), min(tree.getwidth()[1], WIDE))


def stretches(at: Iterable[int], width: int, size: int) -> Iterator[tuple[int, int]]:
    """Merged stretches of a text around places in order, wide enough for any match that has one of them, and the character beside it."""
    begin = end = -1
    for p in at:
        if begin < 0:
            begin, end = max(0, p - width), p + width + 1
        elif p - width <= end:
            end = p + width + 1
        else:
            yield begin, min(end, size)
            begin, end = p - width, p + width + 1
    if begin >= 0:
        yield begin, min(end, size)


class Scanner:
    """Finds the matches of gated patterns in the texts of one batch, as ``finditer`` over each whole text would give them."""

    def __init__(self, patterns: list[tuple[re.Pattern, Gate]], texts: list[str]):
        self.texts, self.folded = texts, [fold(t) for t in texts]
        joined = "\n".join(self.folded)
        literals = {n for _, g in patterns if not isinstance(g.needs, str) for n in g.needs}
        self.there = {n for n in literals if n in joined}
        self.places: dict[tuple[str, int], list[int]] = {}

    def _at(self, i: int, kind: str) -> list[int]:
        """Places of digits, or of every so many characters of long words, in a text."""
        if (kind, i) not in self.places:
            self.places[kind, i] = [p for m in _PLACES[kind].finditer(self.texts[i]) for p in (*range(m.start(), m.end(), LONG // 2), m.end() - 1)]
        return self.places[kind, i]

    def find(self, i: int, pattern: re.Pattern, gate: Gate) -> Iterator[re.Match]:
        text, at = self.texts[i], None
        if isinstance(gate.needs, str):
            at = self._at(i, gate.needs)
            if not at:
                return
        elif gate.needs:
            own, folded = gate.needs & self.there, self.folded[i]
            if not any(n in folded for n in own):
                return
            # folding can lengthen a text, and then places in it aren't the text's
            if len(folded) == len(text) and gate.width < WIDE:
                at = sorted({m.start() for n in own for m in re.finditer(f"(?={re.escape(n)})", folded)})
        if at is None or gate.width >= WIDE:
            yield from pattern.finditer(text)
            return
        for a, z in stretches(at, gate.width, len(text)):
            yield from pattern.finditer(text, a, z)
