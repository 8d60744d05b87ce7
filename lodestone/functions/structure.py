"""Structure of regulations and answers: headings, outlines, references, statements, commands."""

from __future__ import annotations

import re

from lodestone.sources.text import numeral

_NUMBER = "[一二三四五六七八九十百千零〇两\\d]{1,9}"
#: Families of headings with their rank, tried in order.
HEADINGS = (
    (1, "part", re.compile(f"^第({_NUMBER})[编部]")),
    (2, "chapter", re.compile(f"^第({_NUMBER})章|^(?i:chapter)\\s+(\\d+)\\b")),
    (3, "section", re.compile(f"^第({_NUMBER})节|^(?i:section)\\s+(\\d+)\\b")),
    (4, "article", re.compile(f"^第({_NUMBER})条|^(?i:article)\\s+(\\d+)\\b")),
    (5, "item", re.compile("^([一二三四五六七八九十]{1,3})、|^(\\d{1,2})[.、](?!\\d)")),
    (6, "subitem", re.compile("^[（(]([一二三四五六七八九十]{1,3}|\\d{1,2})[）)]")),
)


def heading(line: str) -> tuple[int, str, int] | None:
    """(rank, family, number) of a heading line; lines that end like sentences are none below the article."""
    line = line.strip()
    for rank, family, pattern in HEADINGS:
        if m := pattern.match(line):
            if rank >= 5 and (len(line) > 60 or line.endswith(("。", ";", "；"))):
                return None
            value = numeral(next(g for g in m.groups() if g))
            return (rank, family, value) if value is not None else None
    return None


def contents_lines(lines: list[str]) -> set[int]:
    """Lines of a table of contents: from its title, while lines are headings or end in a page number."""
    out: set[int] = set()
    inside = False
    for n, line in enumerate(lines):
        text = line.strip()
        if re.fullmatch("目\\s*录|(?i:(table of )?contents)", text):
            inside = True
            out.add(n)
        elif inside and (not text or re.search("[.…·\\s]\\d{1,4}$", text)):
            out.add(n)
        else:
            inside = False
    return out


def outline(lines: list[str]) -> list[tuple[int, int, int, int, str]]:
    """(section, parent, first line, last line, title) of nested sections, by a stack over heading ranks.

    Lines in front of the first heading belong to section 0. Parents hold the
    lines of their children. Contents tables make no sections.
    """
    skip = contents_lines(lines)
    sections: list[list] = [[0, -1, 0, len(lines) - 1, ""]]
    stack = [(0, 0)]
    for n, line in enumerate(lines):
        found = None if n in skip else heading(line)
        if not found:
            continue
        while stack[-1][0] >= found[0]:
            sections[stack.pop()[1]][3] = n - 1
        sections.append([len(sections), stack[-1][1], n, len(lines) - 1, line.strip()])
        stack.append((found[0], len(sections) - 1))
    return [tuple(s) for s in sections]


def minimal_union(sections: list[tuple[int, int, int, int, str]], chosen: set[int]) -> list[int]:
    """Chosen sections that no other chosen one holds."""
    span = {s[0]: (s[2], s[3]) for s in sections}
    return sorted(c for c in chosen if not any(o != c and span[o][0] <= span[c][0] and span[c][1] <= span[o][1] and (span[o] != span[c] or o < c) for o in chosen))


def promote(sections: list[tuple[int, int, int, int, str]], section: int, levels: int) -> int:
    """The ancestor `levels` up, or the outermost below section 0."""
    parent = {s[0]: s[1] for s in sections}
    for _ in range(levels):
        if parent[section] <= 0:
            break
        section = parent[section]
    return section


def references(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, family, number) of clause references; those in quotes of other titles are left out."""
    hidden = [m.span() for m in re.finditer("《[^》]*》第[^，。；]*", text)]
    out = []
    for m in re.finditer(f"第({_NUMBER})(章|节|条)|\\b(?i:(article|section|chapter))\\s+(\\d+)\\b", text):
        if any(a <= m.start() < b for a, b in hidden):
            continue
        family = {"章": "chapter", "节": "section", "条": "article"}.get(m[2]) or m[3].lower()
        value = numeral(m[1] or m[4])
        if value is not None:
            out.append((m.start(), m.end(), family, value))
    return out


def resolve(text: str, sections: list[tuple[int, int, int, int, str]]) -> list[tuple[str, int, str, int]]:
    """(family, number, state, section): RESOLVED to one section, AMBIGUOUS, or UNRESOLVED (section -1)."""
    index: dict[tuple[str, int], list[int]] = {}
    for s in sections[1:]:
        if found := heading(s[4]):
            index.setdefault(found[1:], []).append(s[0])
    out = []
    for _, _, family, number in references(text):
        hits = index.get((family, number), [])
        out.append((family, number, "RESOLVED" if len(hits) == 1 else "AMBIGUOUS" if hits else "UNRESOLVED", hits[0] if len(hits) == 1 else -1))
    return out


def statements(text: str) -> list[tuple[str, str, bool]]:
    """(kind, title or date, partial) of repeal and effect statements, sentence by sentence."""
    out = []
    for sentence in re.split("[。；;\n]", text):
        partial = bool(re.search("除|部分|不再适用的条款|except|in part", sentence))
        if re.search("废止|repealed", sentence):
            out += [("repeals", t, partial) for t in re.findall("《([^》]+)》", sentence)]
        elif re.search("代替|取代|replaces", sentence):
            out += [("replaces", t, partial) for t in re.findall("《([^》]+)》", sentence)]
        if m := re.search("自(\\d{4})年(\\d{1,2})月(\\d{1,2})日起(?:施行|实施|生效)", sentence):
            out.append(("effective", f"{int(m[1]):04d}-{int(m[2]):02d}-{int(m[3]):02d}", False))
    return out


def commands(text: str, cap: int = 30) -> list[tuple[str, str]]:
    """(command, argument) of READ:, SEARCH: and GAP: lines outside fences and quotes, ordered, distinct, at most `cap`."""
    out: dict[tuple[str, str], None] = {}
    fenced = False
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and not bare.startswith(">") and (m := re.match(r"(READ|SEARCH|GAP)\s*[:：]\s*(.+)$", bare)):
            out[m[1], m[2].strip()] = None
    return list(out)[:cap]


def missing_gaps(gaps: list[str], held: list[str]) -> list[str]:
    """Gaps that no held title covers, by containment of normalised names."""
    key = lambda t: re.sub("[\\s《》“”\"'（）()、，,.。:：]", "", t).casefold()
    titles = [k for k in map(key, held) if k]
    return [g for g in gaps if (k := key(g)) and not any(k in t or t in k for t in titles)]


def merge_lines(lines: list[str], cap: int = 900, short: int = 80) -> list[tuple[int, int, str]]:
    """(first, last, text): short neighbouring lines joined while the whole stays within the cap."""
    out: list[tuple[int, int, str]] = []
    for n, line in enumerate(lines):
        text = line.strip()
        if not text:
            continue
        if out and out[-1][1] == n - 1 and len(text) <= short and len(out[-1][2]) + 1 + len(text) <= cap and not out[-1][2].endswith((".", "。", "!", "?")):
            out[-1] = (out[-1][0], n, f"{out[-1][2]} {text}")
        else:
            out.append((n, n, text))
    return out


def seeds(ranked: dict[str, list[tuple[str, str]]], most: int = 8) -> list[str]:
    """Units to start from: each query's best first, then the best of sections not yet seen, then by rank; ranked: query -> (unit, section)."""
    chosen: dict[str, str] = {}
    for query in ranked:
        if ranked[query] and len(chosen) < most:
            unit, section = ranked[query][0]
            chosen.setdefault(unit, section)
    depth = max(map(len, ranked.values()), default=0)
    for fresh_only in (True, False):
        for n in range(depth):
            for rows in ranked.values():
                if n < len(rows) and len(chosen) < most and rows[n][0] not in chosen and (not fresh_only or rows[n][1] not in chosen.values()):
                    chosen[rows[n][0]] = rows[n][1]
    return list(chosen)


def trim_tiers(items: list[tuple[str, int, int]], budget: int) -> list[str]:
    """Items (id, tier, size) that fit: lower tiers first, smaller first within one; what overflows is left out."""
    used, out = 0, []
    for name, _, size in sorted(items, key=lambda i: (i[1], i[2], i[0])):
        if used + size <= budget:
            used += size
            out.append(name)
    return out


def priority(relevance: float, hit: float, channels: int, gain: float, role: float) -> float:
    """Order in which graph pages are read."""
    return 0.55 * relevance + 0.25 * hit + 0.03 * channels + 0.35 * gain + 0.3 * role


_PART = f"第\\s*[（(]?\\s*({_NUMBER})\\s*[）)]?\\s*([章节条款项])"
_PATH = f"{_PART}(?:\\s*{_PART})*"
_ANNEX = f"附[件录表]\\s*(?:{_NUMBER}|[A-Za-z][A-Za-z0-9]*)"
_UNITS = {"章": "chapter", "节": "section", "条": "article", "项": "item", "款": "paragraph"}
#: Kinds of places that a text points to, tried in this order; of places that overlap the first found counts.
LOCATORS = (
    ("external", re.compile(f"《(?P<title>[^《》\\n]+)》(?P<more>(?:[（(][^（）()\\n]+[）)])*)\\s*(?P<path>(?:{_ANNEX})?\\s*(?:{_PATH})?)")),
    ("annex", re.compile(f"(?:参见|参照|按照|依据|依照|见|按)\\s*(?P<title>{_ANNEX})\\s*(?P<path>(?:{_PATH})?)")),
    ("relative", re.compile("(?P<title>前|后|上一|下一)(?P<path>[章节条项])")),
    ("note", re.compile("\\[\\^(?P<title>[^\\]\\s]+)\\](?!\\s*[:：])(?P<path>)")),
    ("path", re.compile(f"(?P<title>)(?P<path>{_PATH})")),
)


def path_parts(path: str) -> list[tuple[str, int]]:
    """(family, number) of the parts of a path such as 第三条第（一）项; a number that can't be read is -1."""
    return [(_UNITS[u], -1 if (v := numeral(n)) is None else v) for n, u in re.findall(_PART, path)]


def locators(line: str) -> list[tuple[int, int, str, str, list[tuple[str, int]]]]:
    """(start, end, kind, title, parts) of the places that a line points to, in order.

    A line's own number at its start is no reference.
    """
    found: list[tuple[int, int, str, str, list[tuple[str, int]]]] = []
    own = heading(line)
    first = len(line) - len(line.lstrip())
    for kind, pattern in LOCATORS:
        for m in pattern.finditer(line):
            if any(m.start() < b and a < m.end() for a, b, *_ in found) or kind == "path" and own and m.start() == first:
                continue
            if kind == "relative":
                parts = [(_UNITS[m["path"]], -1 if m["title"] in ("前", "上一") else 1)]
            else:
                parts = path_parts(m["path"])
            title = m["title"] + m["more"] if kind == "external" else re.sub("\\s", "", m["title"])
            found.append((m.start(), m.end(), kind, title, parts))
    return sorted(found)
