"""Semantic units of a section: reversible pieces of its blocks under a budget of tokens."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

# How sentences end, what clings to what stands before it, and lines that stay together.
SENTENCE_END = re.compile("(?:[。！？!?]+|\\.(?=\\s|[\"'”’)\\]）】》」』]|$))[\"'”’)\\]）】》」』]*[ \\t]*")
DEPENDENT = re.compile("\\s*(?:但|但是|不过|然而|否则|除非|除外|其中|并且|并|且|以及|或者|或|及|的|和|与|but\\b|however\\b|unless\\b|except\\b|provided\\b|otherwise\\b|and\\b|or\\b)", re.IGNORECASE)
NUMBER_ONLY = re.compile("\\s*(?:第[\\s零〇一二三四五六七八九十百千万\\d]+[条章节]|[（(]?[零〇一二三四五六七八九十百\\d]+[）)、.．])\\s*")
BOOKING = re.compile("^\\s*(?:借|贷)(?:方)?\\s*[:：]", re.MULTILINE)
NOTE = re.compile("\\s*\\d+\\s+[^\\W\\d_].*[。.!！?？]\\s*")
COLON = re.compile("[:：]\\s*$")
_TOKEN = re.compile("[㐀-鿿]|[^\\s㐀-鿿]+")


@dataclass(frozen=True)
class Block:
    """A block of a document; tables have a header, of `header` characters (0: none)."""

    ordinal: int
    text: str
    kind: str = "paragraph"
    header: int = 0


@dataclass(frozen=True)
class Unit:
    """Text and its spans (ordinal, start, end, start in the text, end in the text); prefix isn't part of the text."""

    prefix: str
    text: str
    tokens: int
    spans: tuple[tuple[int, int, int, int, int], ...]


def tokens(text: str) -> int:
    """Words, and CJK characters one by one."""
    return len(_TOKEN.findall(text))


def prefixes(titles: list[str], budget: int) -> list[str]:
    """Context lines of headings (outermost first), longest first: the nearest that fit, and none at last."""
    kept, out = [], [""]
    for title in dict.fromkeys(" ".join(t.split()) for t in reversed(titles)):
        line = " / ".join([title, *kept]) + "\n\n"
        if title and tokens(line) <= budget:
            kept.insert(0, title)
            out.insert(0, line)
    return out


@dataclass
class _Section:
    """Blocks joined by newlines, with places to cut by preference, and groups that aren't cut."""

    blocks: list[Block]
    starts: list[int] = field(default_factory=list)
    text: str = ""
    cuts: list[list[int]] = field(default_factory=list)
    groups: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.text = "\n".join(b.text for b in self.blocks)
        at = 0
        for b in self.blocks:
            self.starts.append(at)
            at += len(b.text) + 1
        self.ends = [s + len(b.text) for s, b in zip(self.starts, self.blocks)]
        found = [m.span() for m in _TOKEN.finditer(self.text)]
        self._first, self._last = [a for a, _ in found], [b for _, b in found]

    def size(self, a: int, b: int) -> int:
        """Tokens that [a, b) touches."""
        return max(0, bisect_left(self._first, b) - bisect_right(self._last, a))

    def prepare(self, heading: bool, budget: int) -> None:
        """Find the groups that fit the budget and the cuts outside them; a heading stays with what it heads."""
        for i, b in enumerate(self.blocks):
            booking = bool(BOOKING.search(b.text))
            note = b.kind == "footnote" or bool(NOTE.fullmatch(b.text))
            if not (booking or note or b.kind == "table") or booking and i + 1 < len(self.blocks) and BOOKING.search(self.blocks[i + 1].text):
                continue
            first = max(i - 1, 0) if note else i
            while booking and first and BOOKING.search(self.blocks[first - 1].text):
                first -= 1
            if first and COLON.search(self.blocks[first - 1].text):
                first -= 1
            left, right = self.starts[first], self.ends[i]
            joined = bool(self.groups) and self.groups[-1][1] >= left
            left = self.groups[-1][0] if joined else left
            if self.size(left, right) <= budget:
                self.groups = [*self.groups[: -1 if joined else None], (left, right)]
        closed = self.ends[0] if heading and len(self.blocks) > 1 else 0
        paragraphs = {len(self.text)}
        for i, b in enumerate(self.blocks):
            after = self.blocks[i + 1].text if i + 1 < len(self.blocks) else ""
            if not NUMBER_ONLY.fullmatch(b.text) and not DEPENDENT.match(after):
                paragraphs.add(self.ends[i])
            if b.kind == "table":
                paragraphs |= {self.starts[i] + m.end() for m in re.finditer("\n", b.text) if m.start() > b.header}
        sentences = {m.end() for m in SENTENCE_END.finditer(self.text) if not DEPENDENT.match(self.text, m.end())}
        words = {m.end() for m in re.finditer("\\s+", self.text)}
        self.opened = [a for a, _ in self.groups]
        self.tables = [(s + b.header, e, s) for s, e, b in zip(self.starts, self.ends, self.blocks) if b.kind == "table" and b.header]
        edges = {x for g in self.groups for x in g}
        fine = lambda at: at > closed and (self.group(at) or (at,))[0] == at
        self.cuts = [sorted(filter(fine, some | edges | {len(self.text)})) for some in (paragraphs, sentences, words)]

    def group(self, at: int) -> tuple[int, int] | None:
        """The group that holds a place."""
        found = bisect_right(self.opened, at) - 1
        return self.groups[found] if found >= 0 and at < self.groups[found][1] else None

    def furthest(self, start: int, room: int) -> int:
        """Where to end a piece from `start` of at most `room` tokens: at a paragraph, else a sentence, else a word, else a character."""
        for cuts in self.cuts:
            first = bisect_right(cuts, start)
            low, high = first, len(cuts)  # the pieces that fit are a prefix
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if self.size(start, cuts[middle]) <= room else (low, middle)
            if low > first:
                return cuts[low - 1]
        return max(start + 1, self._last[min(bisect_right(self._last, start) + room, len(self._last)) - 1])

    def repeat(self, before: int, start: int, room: int) -> tuple[int, int] | None:
        """What a piece from `start` says again: the header of the table it goes on with, else the end of the piece that began at `before`."""
        table = bisect_left(self.tables, (start,)) - 1
        if table >= 0 and start < self.tables[table][1]:
            end, _, at = self.tables[table]
            return (at, end) if self.size(at, end) <= room else None
        if room < 1:
            return None
        least = self._last[max(bisect_left(self._first, start) - room - 1, 0)]  # nothing from before this place fits
        for cuts in self.cuts:
            for at in cuts[bisect_right(cuts, max(before, least - 1)) : bisect_left(cuts, start)]:
                if 0 < self.size(at, start) <= room:
                    return at, start
        return None

    def unit(self, prefix: str, ranges: list[tuple[int, int]]) -> Unit | None:
        """Parts of the blocks in the ranges, by newlines where they don't follow on one another."""
        parts, spans, at, last = [], [], 0, -1
        for a, b in ranges:
            for i in range(bisect_right(self.ends, a), bisect_left(self.starts, b)):
                s, e, block = self.starts[i], self.ends[i], self.blocks[i]
                left, right = max(a, s), min(b, e)
                if left < right:
                    between = "\n" if parts and left != last else ""
                    at += len(between)
                    parts += [between, self.text[left:right]]
                    spans.append((block.ordinal, left - s, right - s, at, at + right - left))
                    at, last = at + right - left, right
        text = "".join(parts)
        return Unit(prefix, text, tokens(prefix + text), tuple(spans)) if parts else None


def units(blocks: list[Block], titles: list[str], heading: bool, budget: int, overlap: int = 0, context: int = 0) -> Iterator[Unit]:
    """Units of a section's blocks (none empty), in order; without what they repeat they cover every character once.

    At most `budget` tokens with the prefix, of which the prefix takes up to
    `context` and what is repeated up to `overlap`. Both give way so that a section
    or a group that fits alone stays whole.
    """
    if not blocks:
        return
    section = _Section(blocks)
    lines = prefixes(titles, min(context, budget - 1))
    room = lambda prefix: budget - tokens(prefix)
    whole = section.size(0, len(section.text))
    if (fits := next((p for p in lines if whole <= room(p)), None)) is not None:
        yield section.unit(fits, [(0, len(section.text))])
        return
    section.prepare(heading, budget)
    start, before = 0, 0
    while start < len(section.text):
        group = section.group(start)
        need = section.size(start, group[1]) if group else 0
        prefix = next(p for p in lines if need <= room(p) or not p)
        again = section.repeat(before, start, min(overlap, room(prefix) - max(need, 1))) if start and overlap else None
        end = section.furthest(start, room(prefix) - (section.size(*again) if again else 0))
        if again and end not in section.cuts[0] and section.furthest(start, room(prefix)) in section.cuts[0]:
            again, end = None, section.furthest(start, room(prefix))  # a paragraph is worth more than a repetition
        if found := section.unit(prefix, [*([again] if again else []), (start, end)]):
            yield found
        start, before = end, start
