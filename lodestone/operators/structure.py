"""Structure of texts as rows: sections, references, statements, commands, packets. One pass over the texts, nothing shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from lodestone.functions import structure as S, units as U
from lodestone.functions.text import quantities
from lodestone.session import worker_path
from lodestone.sources import text as X

#: Texts whose rows a task holds at once.
TEXTS = 256


def rows_of(docs: DataFrame, found: Callable[[str], Iterable[tuple]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the columns of `schema`: what a function finds in each text, in its order; null texts hold nothing."""
    worker_path(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(fields)
        for whole in batches:
            for first in range(0, whole.num_rows, TEXTS):
                batch, at, rows = whole.slice(first, TEXTS), [], []
                for n, t in enumerate(batch.column(1)):
                    if t.is_valid:
                        some = list(found(t.as_py()))
                        rows += some
                        at += [n] * len(some)
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), f.type) for c, f in zip(columns, kinds))], names=[key, *kinds.names])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, {schema}")


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, level, family, number: heading lines outside tables of contents."""

    def found(t: str):
        lines = t.split("\n")
        skip = S.contents_lines(lines)
        return ((n, *h) for n, line in enumerate(lines) if n not in skip and (h := S.heading(line)))

    return rows_of(docs, found, "line int, level int, family string, number int", key, text)


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section, parent, first_line, last_line, title: nested sections; section 0 is the whole text."""
    return rows_of(docs, lambda t: S.outline(t.split("\n")), "section int, parent int, first_line int, last_line int, title string", key, text)


def clause_links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, family, number, state, section: references to clauses of the same text and where they lead."""
    return rows_of(docs, lambda t: S.resolve(t, S.outline(t.split("\n"))), "family string, number int, state string, section int", key, text)


def section_blocks(text: str) -> Iterator[tuple[int, list[str], bool, list[U.Block]]]:
    """(section, titles, headed, blocks) of a text's innermost sections in order.

    A block is a line that isn't blank, or neighbouring lines of a table (with tabs,
    or from a bar); its ordinal is where it starts in the text.
    """
    lines = text.split("\n")
    sections = S.outline(lines)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    owner = [0] * len(lines)
    for n, _, first, last, _ in sections:
        owner[first : last + 1] = [n] * (last + 1 - first)
    tabular = [("\t" in line.strip() or line.lstrip().startswith("|")) for line in lines]
    at = 0
    while at < len(lines):
        section, blocks = owner[at], []
        while at < len(lines) and owner[at] == section:
            end = at + 1
            while tabular[at] and end < len(lines) and tabular[end] and owner[end] == section:
                end += 1
            body = "\n".join(lines[at:end])
            if end > at + 1:
                ruled = re.fullmatch(r"[\s|:\-]+", lines[at + 1])
                blocks.append(U.Block(starts[at], body, "table", starts[at + (2 if ruled else 1)] - starts[at] - 1))
            elif body.strip(" "):
                blocks.append(U.Block(starts[at], body))
            at = end
        titles, n = [], section
        while n > 0:
            titles.insert(0, sections[n][4])
            n = sections[n][1]
        yield section, titles, section > 0, blocks


def units(docs: DataFrame, budget: int = 480, overlap: int = 64, context: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section, path, prefix, body, n_tokens, spans: semantic units, none across sections.

    spans are the places of the unit in the text and in its body: what a unit says
    again (a table's header, the end of the unit before) comes first. Without that
    the spans of a text cover each character of each block once. Tokens are words
    and single CJK characters; prefix and body together keep to the budget.
    """
    if budget < 2 or overlap < 0 or context < 0:
        raise ValueError("a unit takes two tokens at least, overlap and context none at least")

    def found(t: str) -> Iterator[tuple]:
        for section, titles, headed, blocks in section_blocks(t):
            for u in U.units(blocks, titles, headed, budget, overlap, context):
                yield section, titles, u.prefix, u.text, u.tokens, [{"start": o + a, "end": o + b, "body_start": c, "body_end": d} for o, a, b, c, d in u.spans]

    return rows_of(docs, found, "section int, path array<string>, prefix string, body string, n_tokens int, spans array<struct<start: int, end: int, body_start: int, body_end: int>>", key, text)


def statements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, value, partial: repeals, replacements and dates of effect."""
    return rows_of(docs, S.statements, "kind string, value string, partial boolean", key, text)


def commands(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, command, argument: READ, SEARCH and GAP lines outside fences and quotes."""
    return rows_of(docs, S.commands, "command string, argument string", key, text)


def packets(docs: DataFrame, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, packet, body: lossless pieces of at most `budget` UTF-8 bytes, in order."""
    return rows_of(docs, lambda t: enumerate(X.packets(t, budget)), "packet int, body string", key, text)


def evidence_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, evidence: numbers of evidence marks and ranges outside code."""
    return rows_of(docs, lambda t: ((n,) for n in X.evidence_ids(t)), "evidence int", key, text)


def merged_lines(docs: DataFrame, cap: int = 900, short: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, first_line, last_line, passage: short neighbouring lines as one passage of at most `cap` characters."""
    return rows_of(docs, lambda t: S.merge_lines(t.split("\n"), cap, short), "first_line int, last_line int, passage string", key, text)


def numerals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, value: the value of texts that are Arabic or Chinese numerals."""
    return rows_of(docs, lambda t: [(v,)] if (v := X.numeral(t)) is not None else [], "value long", key, text)


def gaps_left(gaps: DataFrame, held: DataFrame) -> DataFrame:
    """Gaps (gap) that no held title (title) covers by containment of normalised names. At most 10 000 titles are held: they are broadcast."""
    key = lambda c: F.lower(F.regexp_replace(c, "[\\s《》“”\"'（）()、，,.。:：]", ""))
    titles = held.select(key(F.col("title")).alias("t")).where("t <> ''").distinct()
    if titles.limit(10_001).count() > 10_000:
        raise ValueError("more than 10 000 held titles")
    known = titles.agg(F.collect_list("t").alias("titles"))
    rows = gaps.select("gap", key(F.col("gap")).alias("k")).where("k <> ''").crossJoin(F.broadcast(known))
    return rows.where(~F.exists("titles", lambda t: F.contains(t, F.col("k")) | F.contains(F.col("k"), t))).select("gap")


def ungrounded(claims: Column, support: Column) -> Column:
    """Quantities of a claim that its support doesn't hold, whatever units they are stated in."""
    return F.array_except(quantities(claims), quantities(support))


def read_priority(relevance: Column, hit: Column, channels: Column, gain: Column, role: Column) -> Column:
    """Order in which graph pages are read."""
    return S.priority(relevance, hit, channels, gain, role)
