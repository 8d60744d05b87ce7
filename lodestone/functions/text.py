"""Text expressions: tokens, keys, paths and masks, as columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from lodestone.constants import STOP_WORDS

_STOP = frozenset(STOP_WORDS)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no built-in; null stays null."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def name_key(names: pd.Series) -> pd.Series:
    """Key that names are compared by: NFKC, stripped, case-folded."""
    return names.map(lambda t: unicodedata.normalize("NFKC", t).strip().casefold(), na_action="ignore")


_LATIN = re.compile("[a-z0-9]+")
_WORDS = re.compile("[a-z0-9]+(?:[._/-][a-z0-9]+)*")
_CJK = re.compile("[㐀-鿿]+")


def search_tokens(text: str | None) -> list[str]:
    """Search tokens of a text after NFKC, in lower case (None: none).

    Runs of [a-z0-9]; compounds such as a.b or 12-3 once more; of a run of CJK
    characters all neighbouring pairs, or the one it is, without stop words.
    Accented letters part words.
    """
    if not text:
        return []
    plain = text.isascii()
    low = (text if plain or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).lower()
    found = _WORDS.findall(low)
    if compounds := [w for w in found if not w.isalnum()]:
        found += [part for w in compounds for part in _LATIN.findall(w)]
    for run in () if plain else _CJK.findall(low):
        found += [w for w in ([run] if len(run) == 1 else map("".join, zip(run, run[1:]))) if w not in _STOP]
    return found


def distinct_words(text: Column) -> Column:
    """Ordered distinct query words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def search_terms(text: Column, cap: int = 24) -> Column:
    """Terms of 2 to 160 characters between punctuation and white space, ordered, distinct, at most `cap`."""
    parts = F.split(F.lower(text), r"[\s,.;:!?()\[\]{}|/\\]+")
    return F.slice(F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 2) & (F.length(t) <= 160) & ~t.isin(*STOP_WORDS))), 1, cap)


def gap_key(material: Column) -> Column:
    """Key of a missing material: no white space, quotes, brackets or stops, lower case."""
    return F.lower(F.regexp_replace(material, "[\\s《》“”\"'（）()、，,.。:：]", ""))


def title_key(title: Column) -> Column:
    """Title without punctuation and white space, lower case."""
    return F.lower(F.regexp_replace(title, r"[\p{Punct}\s]", ""))


def category_path(path: Column, levels: int = 8) -> Column:
    """A path with trimmed, non-empty levels, at most `levels` of them."""
    parts = F.filter(F.transform(F.split(path, "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.slice(parts, 1, levels), "/")


def ancestors(path: Column) -> Column:
    """A path and all paths above it, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def wikilinks(text: Column) -> Column:
    """Targets of [[title]] and [[title|alias]], ordered, distinct; ![[embeds]] are none."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|[^!\\])\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.trim(t)))


def redact(text: Column) -> Column:
    """Secrets replaced by a mark: key=value credentials, bearer tokens and private keys."""
    out = F.regexp_replace(text, r"(?i)\b(api[_-]?key|secret|token|password|passwd)\b(\s*[=:]\s*)\S+", "$1$2[REDACTED]")
    out = F.regexp_replace(out, r"(?i)\bbearer\s+[a-z0-9._~+/-]+=*", "Bearer [REDACTED]")
    return F.regexp_replace(out, r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]")


def quantities(text: Column) -> Column:
    """Numbers with a unit as structs of unit and value, scaled so that equal quantities are equal: 1% is 100 bp, 1亿元 is 10000万元."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?\s?(?:%|bp|万元|亿元|元|天|days|kg|km))"), F.lit(1))
    scale = {"%": ("bp", "100"), "万元": ("元", "10000"), "亿元": ("元", "100000000"), "days": ("天", "1")}

    def scaled(x: Column) -> Column:
        unit, value = F.regexp_extract(x, r"([^\d.\s]+)$", 1), F.regexp_extract(x, r"^([\d.]+)", 1).try_cast("decimal(28,6)")
        name, times = unit, F.lit("1")
        for one, (base, factor) in scale.items():
            name, times = F.when(unit == one, base).otherwise(name), F.when(unit == one, factor).otherwise(times)
        return F.struct(name.alias("unit"), (value * times.cast("decimal(10,0)")).cast("decimal(38,6)").alias("value"))

    return F.transform(found, scaled)


def deletions_only(sentence: Column, narrowed: Column) -> Column:
    """Whether a narrowed sentence is the sentence with characters deleted, none added or moved; null if either is."""
    letters = F.filter(F.split(narrowed, ""), lambda c: c != "")
    after = lambda at, c: F.when(at < 0, -1).otherwise(F.coalesce(F.nullif(F.call_function("locate", c, sentence, at + 1), F.lit(0)), F.lit(-1)))
    return F.when(sentence.isNotNull(), F.aggregate(letters, F.lit(0), after) >= 0)


def excerpt(text: Column, size: int = 280) -> Column:
    """The first characters of a text."""
    return F.substring(text, 1, size)
