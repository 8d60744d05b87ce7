"""Quality rules in a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and
a bit per failed rule. A policy is a version with a mask of rules: it keeps what
fails none of them. Policies and ablations read the ledger only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.session import worker_path

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_repeat_next")

#: Rules in the order of their bits: name and SQL condition of failure over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 50"),
    ("repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "20 * n_symbols > word_chars"),
    ("duplicate_lines", "n_dup_lines > 2 and 2 * n_dup_lines > n_lines"),
    ("capitals", "n_letters > 0 and 2 * n_upper > n_letters"),
    ("exclamations", "4 * n_bangs > n_words"),
    ("stutter", "5 * n_repeat_next > n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the rules it applies."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("too_short", "repeated_phrases"))
POLICIES = (BASE, Policy("v1", (*BASE.rules, "symbols", "duplicate_lines")), Policy("v2", tuple(name for name, _ in RULES)))


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a whole text (None: of an empty one)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    seen: set[str] = set()
    duplicates = lines = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    triples = list(zip(words, words[1:], words[2:]))
    counts = Counter(triples)
    repeated = 0
    if len(counts) < len(triples):
        covered = 0  # words up to here are counted
        for i, t in enumerate(triples):
            if counts[t] > 1:
                repeated += i + 3 - max(covered, i)
                covered = i + 3
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = upper + len(raw) - len(raw.translate(None, _LOWER))
    next_same = sum(a == b for a, b in zip(words, words[1:]))
    chars = len(text) - sum(map(text.count, _SPACES))
    return n, chars, sum(map(text.count, _SYMBOLS)), duplicates, repeated, lines, upper, letters, text.count("!"), next_same


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the measurements, and failed: a bit per rule of RULES.

    A row per input row; null and empty texts measure zero throughout. Repeated
    rows, null keys and ties stay as they are; other columns aren't read.
    """
    worker_path(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(measure(t.as_py()) for t in batch.column(1))) if batch.num_rows else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.int64()) for c in columns)], names=[key, *MEASURES])

    measured = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << n)).otherwise(F.lit(0)) for n, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed.cast("long"))


def kept(policy: Policy) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def outcomes(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """version, n_docs, n_kept per policy, from one aggregation over the ledger's distinct bits."""
    patterns = book.groupBy("failed").agg(F.count("*").alias("n"))
    table = F.explode(F.array(*(F.struct(F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("mask")) for p in policies)))
    rows = patterns.select("failed", "n", table.alias("p"))
    return rows.groupBy(F.col("p.version").alias("version")).agg(F.sum("n").alias("n_docs"), F.sum(F.when(F.col("failed").bitwiseAND(F.col("p.mask")) == 0, F.col("n")).otherwise(0)).alias("n_kept"))


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """rule, n_failed, n_alone (rows that only this rule of the policy rejects), per rule of a policy."""
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("failed")).agg(F.count("*").alias("n"))
    names = [name for name, _ in RULES]
    table = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules)))
    rows = patterns.select("failed", "n", table.alias("r"))
    hit = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_alone"))
