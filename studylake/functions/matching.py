"""Many names looked up in one text by one scan: Aho-Corasick over the names of a document."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

#: White space of the heading rules, and what ends a line.
_BLANK_CLASS = r"[ \t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
BLANKS = frozenset(c for c in map(chr, range(0x10000)) if re.fullmatch(_BLANK_CLASS, c))
LINE_ENDS = frozenset("\n\r\u0085\u2028\u2029")
_UPPER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    return text.translate(_UPPER)


def automaton(names: Iterable[str]):
    """The names' automaton, or None without names; empty ones are left out."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for name in names:
        if name:
            found.add_word(name, name)
    if not len(found):
        return None
    found.make_automaton()
    return found


def places(text: str, names: Iterable[str]) -> dict[str, list[int]]:
    """All places from 0 at which each name stands in the text, ascending; names without places are absent."""
    out: dict[str, list[int]] = defaultdict(list)
    if (scan := automaton(names)) is not None:
        for end, name in scan.iter(text):
            out[name].append(end - len(name) + 1)
    return out


def contained(text: str, scan) -> set[str]:
    """The names that stand in the text."""
    return {name for _, name in scan.iter(text)} if scan is not None else set()


def first_from(found: Sequence[int], least: int) -> int | None:
    """The first of ascending places that is not before `least`."""
    at = bisect_left(found, least)
    return found[at] if at < len(found) else None


class Marks:
    """Where names stand as headings (one to three # at the beginning of a line, blanks, the name as the beginning of the rest)
    and between double asterisks. A-Z match both cases."""

    def __init__(self, text: str, names: Iterable[str | None]):
        self.text = text
        self.headings: dict[str, list[int]] = defaultdict(list)
        self.bold: dict[str, list[int]] = defaultdict(list)
        for name, found in places(ascii_lower(text), {ascii_lower(x) for x in names if x}).items():
            for at in found:
                if (head := self._heading(at)) is not None:
                    self.headings[name].append(head)
                if text.startswith("**", at - 2) and at >= 2 and text.startswith("**", at + len(name)):
                    self.bold[name].append(at - 2)

    def _heading(self, at: int) -> int | None:
        text, end = self.text, at
        while end and text[end - 1] in BLANKS:
            end -= 1
        begin = end
        while begin and text[begin - 1] == "#" and end - begin < 4:
            begin -= 1
        fits = 1 <= end - begin <= 3 and (begin == 0 or text[begin - 1] in LINE_ENDS)
        return begin if fits else None

    def first(self, name: str | None, least: int = 0) -> int | None:
        """The first heading of a name, else its first bold place, not before `least`. A text that is looked at from `least` on
        begins a line there."""
        if not name:
            return None
        key = ascii_lower(name)
        if least and re.compile(f"#{{1,3}}{_BLANK_CLASS}*{re.escape(key)}", re.IGNORECASE | re.ASCII).match(self.text, least):
            return least
        found = first_from(self.headings.get(key, ()), least)
        return found if found is not None else first_from(self.bold.get(key, ()), least)


_CUTS = (re.compile(r"\n\n+"), 0), (re.compile(rf"[.!?]{_BLANK_CLASS}"), 1), (re.compile(r"\n"), 0)


def smart_boundary(text: str, position: int, forward: bool = True, reach: int = 500) -> int:
    """The place to cut near a position: a blank line, else after a sentence, else a line's end, the nearest of its kind."""
    if position < 0 or position >= len(text):
        return len(text) if forward else 0
    first = max(0, position - reach)
    region = text[first : position + reach]
    for pattern, shift in _CUTS:
        best = min((first + m.start() + shift for m in pattern.finditer(region)), key=lambda x: (abs(x - position), x), default=None)
        if best is not None:
            return best
    return position


def section_spans(text: str, names: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """(begin, end) of the part of each of a document's sections, in order."""
    marks, n, count = Marks(text, names), len(text), len(names)
    starts = []
    for i, name in enumerate(names):
        low, high = i * n // count, (i + 1) * n // count
        at = marks.first(name)
        if at is None and name:
            within = text[low:high].lower().find(name.lower())
            at = low + within if within >= 0 else None
        starts.append(smart_boundary(text, low) if at is None else at)
    for i, start in enumerate(starts):
        end = n if i == count - 1 else marks.first(names[i + 1], start + 1)
        if end is None:
            end = smart_boundary(text, (i + 1) * n // count, False)
        yield min(start, end), max(start, end)


class Spots:
    """First places of names in a text: as they are, else in lower case."""

    def __init__(self, text: str, names: Iterable[str | None]):
        known = {x for x in names if x}
        self.text, self.exact = text, places(text, known)
        self.low = text.lower()
        self.loose = places(self.low, {x.lower() for x in known})

    def first(self, name: str | None, least: int = 0) -> int | None:
        if not name:
            return None if name is None else least
        found = first_from(self.exact.get(name, ()), least)
        return found if found is not None else first_from(self.loose.get(name.lower(), ()), least)
