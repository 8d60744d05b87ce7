"""HTML to blocks, and HTML reduced to an allow-list."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Elements dropped with all they hold, elements that make blocks, elements and attributes that may stay.
DROPPED = frozenset("script style iframe object embed form input button select textarea svg noscript template head".split())
BLOCKS = {"p": "paragraph", "li": "list", "pre": "paragraph", "blockquote": "paragraph", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading"}
ALLOWED = frozenset("p br ul ol li pre code blockquote h1 h2 h3 h4 h5 h6 table thead tbody tr th td strong em b i a".split())
VOID = frozenset("br hr img input meta link".split())


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.kind, self.text, self.path = [], 0, None, [], []
        self.table, self.row, self.cell, self.level = None, None, None, 0

    def flush(self):
        if self.kind and (text := " ".join("".join(self.text).split())):
            self.out.append((self.kind, self.level, text, "/".join(self.path)))
        self.kind, self.text = None, []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.path.append(tag)
        if tag in DROPPED and tag not in VOID:
            self.skip += 1
        elif self.skip:
            return
        elif tag == "table":
            self.flush()
            self.table = []
        elif self.table is not None and tag == "tr":
            self.row = []
            self.table.append(self.row)
        elif self.row is not None and tag in ("td", "th"):
            self.cell = []
            self.row.append(self.cell)
        elif tag in BLOCKS and self.table is None:
            self.flush()
            self.kind, self.level = BLOCKS[tag], int(tag[1]) if BLOCKS[tag] == "heading" else 0
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in self.path:
            while (last := self.path.pop()) != tag:
                if last in DROPPED:
                    self.skip -= 1
            if tag in DROPPED:
                self.skip -= 1
        if tag == "table" and self.table is not None:
            rows = [[" ".join("".join(c).split()) for c in r] for r in self.table]
            wide = max(map(len, rows), default=0)
            if wide:
                self.out.append(("table", 0, "\n".join("\t".join(r + [""] * (wide - len(r))) for r in rows), "/".join([*self.path, "table"])))
            self.table = self.row = self.cell = None
        elif tag in BLOCKS and self.table is None:
            self.flush()

    def handle_data(self, data):
        if self.skip:
            return
        if self.cell is not None:
            self.cell.append(data)
        elif self.kind:
            self.text.append(data)


def html_blocks(page: str | None) -> list[tuple[str, int, str, str]]:
    """(kind, level, text, path) of headings, paragraphs, list items and tables; table rows are padded to one width."""
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.out


class _Sanitizer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.skip = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED and tag not in VOID:
            self.skip.append(tag)
        if self.skip or tag not in ALLOWED:
            return
        link = dict(attrs).get("href") or "" if tag == "a" else ""
        safe = link.split(":", 1)[0].lower() in ("http", "https", "mailto") if ":" in link.split("/", 1)[0] else True
        self.out.append(f'<{tag} href="{escape(link)}">' if link and safe else f"<{tag}>")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
        elif tag in self.open:
            while True:
                self.out.append(f"</{(last := self.open.pop())}>")
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.skip:
            self.out.append(escape(data))


def sanitize(page: str | None) -> str:
    """The page with allowed elements only, without attributes but safe links, well-formed."""
    parser = _Sanitizer()
    parser.feed(page or "")
    parser.close()
    return "".join(parser.out) + "".join(f"</{t}>" for t in reversed(parser.open))


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, ordinal, kind, level, text, path."""
    kind = pages.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, n, *b) for k, h in zip(part[key], part[html]) for n, b in enumerate(html_blocks(h))]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "kind", "level", "text", "path"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, ordinal int, kind string, level int, text string, path string")
