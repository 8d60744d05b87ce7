"""Sources and parsers: files to decoded text, text to blocks, splitting under byte budgets."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.session import worker_path

#: File kinds that are taken, and the limit on their size.
EXTENSIONS = ("pdf", "docx", "xlsx", "txt", "md", "html", "png", "jpg")
MAX_BYTES = 100 << 20
BLOCK_CHARS = 20_000


def decode(raw: bytes) -> str:
    """Text of bytes: by a byte order mark, else UTF-8, else GB 18030; ValueError if none fits."""
    for mark, name in ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name)
    for name in ("utf-8-sig", "gb18030"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("no known encoding")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, size, text, problem of every file below a path; text only for plain kinds that decode."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = rows.select("path", kind.alias("kind"), F.col("length").alias("size"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                text = problem = None
                if r.kind not in EXTENSIONS:
                    problem = "UNSUPPORTED_TYPE"
                elif r.size > MAX_BYTES:
                    problem = "TOO_LARGE"
                elif r.kind in ("txt", "md", "html"):
                    try:
                        text = decode(bytes(r.content))
                    except ValueError:
                        problem = "UNDECODABLE"
                out.append((r.path, r.kind, r.size, text, problem))
            yield pd.DataFrame(out, columns=["path", "kind", "size", "text", "problem"])

    return rows.mapInPandas(run, "path string, kind string, size long, text string, problem string")


def line_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ordinal, line (from 1), char_start, text, content_sha256: a block per line that isn't blank."""
    worker_path(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if not (body := batch.column(1)[k].as_py()):
                    continue
                lines = body.split("\n")
                starts = np.cumsum([0, *(len(line) + 1 for line in lines[:-1])])
                at = [n for n, line in enumerate(lines) if line.strip(" ")]
                columns = [batch.column(0).take(pa.array(np.full(len(at), k))), pa.array(at, pa.int64()), pa.array(starts[at], pa.int64()), pa.array([lines[n] for n in at], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "ordinal", "char_start", "text"])

    rows = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, ordinal long, char_start long, text string")
    return rows.select(key, "ordinal", (F.col("ordinal") + 1).alias("line"), "char_start", "text", F.sha2("text", 256).alias("content_sha256"))


def block_text(kind: Column, data: Column) -> Column:
    """Canonical text of a block: table rows as tab-separated lines, lists as lines, else its text."""
    rows = F.array_join(F.transform(data["rows"], lambda r: F.array_join(r, "\t")), "\n")
    return F.when(kind == "table", rows).when(kind == "list", F.array_join(data["items"], "\n")).when(kind == "formula", data["expression_text"]).when(kind.isin("image", "attachment"), data["caption"]).otherwise(data["text"])


_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$")


def markdown_blocks(text: str) -> list[tuple[str, int, str, int]]:
    """(kind, level, text, first line) of headings, lists, tables, code and paragraphs."""
    out: list[tuple[str, int, str, int]] = []
    lines, i = text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif line.lstrip().startswith(("```", "~~~")):
            fence, first = line.lstrip()[:3], i
            i += 1
            while i < len(lines) and not lines[i].lstrip().startswith(fence):
                i += 1
            out.append(("code", 0, "\n".join(lines[first + 1 : i]), first + 1))
            i += 1
        elif m := _HEADING.match(line):
            out.append(("heading", len(m[1]), m[2], i + 1))
            i += 1
        else:
            first = i
            kind = "list" if _ITEM.match(line) else "table" if "|" in line and i + 1 < len(lines) and re.fullmatch(r"[\s|:-]*-[\s|:-]*", lines[i + 1]) else "paragraph"
            while i < len(lines) and lines[i].strip() and not _HEADING.match(lines[i]) and not lines[i].lstrip().startswith(("```", "~~~")) and (kind != "paragraph" or i == first or not _ITEM.match(lines[i])):
                i += 1
            part = lines[first:i]
            if kind == "list":
                part = [_ITEM.sub(r"\1", p) for p in part]
            elif kind == "table":
                part = ["\t".join(c.strip() for c in p.strip().strip("|").split("|")) for n, p in enumerate(part) if n != 1]
            out.append((kind, 0, "\n".join(part), first + 1))
    return out


def byte_chunks(text: str, budget: int, overlap: int = 0) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most `budget` UTF-8 bytes that cover the text.

    A piece ends at the last blank line, line, sentence or space it holds, in this
    order of preference, else at the last character that fits; the next starts up
    to `overlap` bytes earlier. A character wider than the budget is an error.
    """
    if not 0 <= overlap < budget:
        raise ValueError("overlap must be under the budget")
    width = [len(c.encode()) for c in text]
    if any(w > budget for w in width):
        raise ValueError("a character is wider than the budget")
    out, start, covered = [], 0, 0
    while start < len(text):
        used, end = 0, start
        while end < len(text) and used + width[end] <= budget:
            used, end = used + width[end], end + 1
        if end < len(text):
            for mark in ("\n\n", "\n", ". ", " "):
                at = text.rfind(mark, start, end)
                if at > start:
                    end = at + len(mark) if at + len(mark) <= end else end
                    break
        if end <= covered:  # the overlap leaves no room for what comes next
            start = covered
            continue
        out.append((start, end))
        covered = end
        if end == len(text):
            break
        back, at = 0, end
        while at > start + 1 and back + width[at - 1] <= overlap:
            at -= 1
            back += width[at]
        start = at
    return out


def packets(text: str, budget: int) -> list[str]:
    """Lossless pieces of at most `budget` UTF-8 bytes; joined they give the text."""
    return [text[a:b] for a, b in byte_chunks(text, budget)] if text else []


def split_rows(docs: DataFrame, budget: int, overlap: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, part, start, end of the byte-budget pieces of every text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, n, a, b) for k, t in zip(part[key], part[text]) for n, (a, b) in enumerate(byte_chunks(t or "", budget, overlap))]
            yield pd.DataFrame(rows, columns=[key, "part", "start", "end"])

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, part int, start int, end int")


def semantic_units(docs: DataFrame, tokens: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, unit, first_line, last_line, n_tokens: lines packed into units of at most `tokens` words.

    A line that starts a new section (a heading mark or a numbered clause) opens a
    unit; a line longer than the budget is a unit alone.
    """
    kind = docs.schema[key].dataType.simpleString()
    opens = re.compile(r"^\s*(?:#{1,6}\s|\d+(?:\.\d+)*[.)]\s|第.{1,9}[章节条])")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, t in zip(part[key], part[text]):
                unit, used, first, last = 0, 0, None, None
                for n, line in enumerate((t or "").split("\n"), 1):
                    if not line.strip():
                        continue
                    size = len(line.split())
                    if first is not None and (used + size > tokens or opens.match(line)):
                        rows.append((k, unit, first, last, used))
                        unit, used, first = unit + 1, 0, None
                    first, last, used = first if first is not None else n, n, used + size
                if first is not None:
                    rows.append((k, unit, first, last, used))
            yield pd.DataFrame(rows, columns=[key, "unit", "first_line", "last_line", "n_tokens"])

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, unit int, first_line int, last_line int, n_tokens int")


def numeral(text: str) -> int | None:
    """Value of an Arabic or Chinese numeral below 10 ** 8, else None."""
    if re.fullmatch(r"\d+", text):
        return int(text)
    digits = {c: n for n, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
    units = {"十": 10, "百": 100, "千": 1000}
    if not text or any(c not in digits and c not in units and c != "万" for c in text):
        return None
    total = section = number = 0
    for c in text:
        if c in digits:
            number = digits[c]
        elif c in units:
            section += (number or 1) * units[c]
            number = 0
        else:
            total += (section + number or 1) * 10_000
            section = number = 0
    return total + section + number


def strict_json(text: str) -> object:
    """A JSON value; ValueError on repeated keys, non-finite numbers and lone surrogates."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in items}) != len(items):
            raise ValueError("repeated key")
        return dict(items)

    def reject(name: str) -> None:
        raise ValueError(f"{name} is no JSON number")

    value = json.loads(text, object_pairs_hook=pairs, parse_constant=reject)
    json.dumps(value, ensure_ascii=False).encode()
    return value


def evidence_ids(text: str) -> list[int]:
    """Numbers of E-ids and ranges such as E3-E7 outside code, ordered, distinct."""
    plain = re.sub(r"(?s)```.*?(?:```|\Z)|`[^`\n]*`", lambda m: " " * len(m[0]), text)
    out: dict[int, None] = {}
    for a, b in re.findall(r"\bE(\d+)(?:\s*[-–~]\s*E?(\d+))?\b", plain):
        for n in range(int(a), min(int(b or a), int(a) + 999) + 1):
            out[n] = None
    return list(out)
