"""Removal of passages that an earlier document holds, with repeated-phrase automata.

1. Every window of 50 words has a characteristic phrase: of its 8-word phrases
   the one of least hash (the leftmost, if repeated). Equal windows have equal ones, so a window
   can only recur if its phrase does. Phrases of all documents are aggregated;
   those of two or more documents recur.
2. Documents are dealt to shards by key and text hash, each to one, and recurring
   phrases to the shards whose documents hold them. A shard compiles its phrases into
   an Aho-Corasick automaton and streams its documents through it, which locates
   every occurrence. From then on only digests of the windows around occurrences travel.
3. The windows of a phrase meet in one bucket, where equal ones are those of equal
   96-bit digests of all 50 words; all but those of the least document lose their
   words. A phrase too frequent for one task is split by document: its parts are
   compared by themselves, then the least document of each window across them.

Each window is sent to one bucket, so what is shuffled grows with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.session import discard, materialise, worker_path

#: Words of a phrase; two bytes of a word's hash stand for it, so that a phrase is two longs.
PHRASE = 8
#: Text bytes that one shard should hold. A bucket should hold as many windows as a 48th of it.
SHARD_BYTES = 6 << 20
#: Text bytes of a word with its space, about: for the number of shards only.
WORD_BYTES = 7
#: Digest of a window.
_DIGEST = np.dtype([("d", "<i8"), ("e", "<i4")])
#: Fixed multipliers of the two 64-bit digests of a window.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def word_hashes(text: str | None) -> np.ndarray:
    found = (text or "").encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


class Words:
    """Hashes of the words of several documents in a row."""

    def __init__(self, each: list[np.ndarray]):
        self.sizes = np.array([len(h) for h in each], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.hashes = np.concatenate([np.empty(0, np.uint64), *each])
        self.symbols = (self.hashes & np.uint64(0xFFFF)).astype("<u2")

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and document of every window, and the place of its phrase."""
        span = np.maximum(self.sizes - width + 1, 0)
        doc = np.repeat(np.arange(len(span)), span)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(span) - span, span) + self.starts[doc]
        if not len(start):
            return start, doc, start
        grams = np.zeros(len(self.hashes) - PHRASE + 1, np.uint64)
        for i in range(PHRASE):
            grams = grams * np.uint64(0xBF58476D1CE4E5B9) + self.symbols[i : len(self.symbols) - PHRASE + 1 + i]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0x94D049BB133111EB)
        view = np.lib.stride_tricks.sliding_window_view(grams, width - PHRASE + 1)
        least = np.empty(len(start), np.int64)
        for at in range(0, len(start), 100_000):
            some = start[at : at + 100_000]
            least[at : at + 100_000] = view[some[0] : some[-1] + 1].argmin(1)[some - some[0]] + some
        return start, doc, least

    def phrases(self, at: np.ndarray) -> np.ndarray:
        """Phrases that start at the places, as rows of two longs."""
        raw = np.lib.stride_tricks.sliding_window_view(self.symbols, PHRASE)[at]
        return np.ascontiguousarray(raw).view("<i8").reshape(-1, 2)

    def digests(self, start: np.ndarray, width: int) -> list[np.ndarray]:
        """128 bits of the word sequences of windows, as two arrays."""
        out, n = [], len(self.hashes)
        for k, base in enumerate(_BASES):
            mixed = self.hashes if not k else (self.hashes ^ (self.hashes >> np.uint64(32))) * np.uint64(_BASES[0])
            one = np.ones(1, np.uint64)
            powers = np.cumprod(np.concatenate([one, np.full(n, base, np.uint64)]))
            back = np.cumprod(np.concatenate([one, np.full(n, pow(base, -1, 1 << 64), np.uint64)]))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers[:n])])
            out.append((total[start + width] - total[start]) * back[start])
        return out


def phrases(docs: DataFrame, width: int) -> DataFrame:
    """p, q (a phrase), doc, tie, n: the characteristic phrases of every document, and of how many windows each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(t.as_py() or "") for t in batch.column(2)], np.int64)
            part = np.cumsum(sizes) // (4 << 20)
            for n in np.unique(part):
                rows = np.flatnonzero(part == n)
                some = batch.slice(int(rows[0]), len(rows))
                words = Words([word_hashes(t.as_py()) for t in some.column(2)])
                _, doc, least = words.windows(width)
                if not len(doc):
                    continue
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])]))
                times = np.diff(first, append=len(doc))
                doc, pairs = doc[first], words.phrases(least[first])
                order = np.lexsort((pairs[:, 1], pairs[:, 0], doc))
                doc, pairs, times = doc[order], pairs[order], times[order]
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pairs[1:] != pairs[:-1]).any(1)]))
                doc, pairs, times = doc[first], pairs[first], np.add.reduceat(times, first)
                of = pa.array(doc)
                columns = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), some.column(0).take(of), some.column(1).take(of), pa.array(times)]
                yield pa.RecordBatch.from_arrays(columns, names=["p", "q", "doc", "tie", "n"])

    return docs.select("doc", "tie", "text").mapInArrow(run, "p long, q long, doc long, tie long, n long")


def _bytes_of(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Consecutive runs of an array, as binaries."""
    ends = np.append(cuts, len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def locate(left: pa.Table, right: pa.Table, width: int) -> pa.Table:
    """One shard: its documents (doc, tie, text) and the recurring phrases they hold (p, q, bucket, parts).

    Returns bucket, part, doc, tie, at, digests: per run of windows of one located
    phrase its first word, and the digests of its windows.
    """
    known = dict(zip(zip(right["p"].to_pylist(), right["q"].to_pylist()), range(len(right))))
    codes = np.array(list(known), "<i8").reshape(-1, 2).tobytes()
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, row in enumerate(known.values()):
        auto.add_word(codes[i * 2 * PHRASE : (i + 1) * 2 * PHRASE].decode("latin-1"), row)
    auto.make_automaton()

    def occurrences(words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places where a phrase starts, and its row in right."""
        found = np.fromiter(auto.iter(words.symbols.tobytes().decode("latin-1")) if len(auto) else (), [("end", "<i8"), ("row", "<i8")])
        found = found[found["end"] % 2 == 1]
        return (found["end"] + 1 >> 1) - PHRASE, found["row"]

    hashes = [word_hashes(t.as_py()) for t in left["text"]]
    words = Words(hashes)
    held = np.unique(np.searchsorted(words.ends, occurrences(words)[0], side="right"))
    words = Words([hashes[i] for i in held])
    of = np.full(len(words.hashes) + 1, -1)
    at, row = occurrences(words)
    of[at] = row
    start, doc, least = words.windows(width)
    found = of[least] >= 0
    start, doc, least = start[found], doc[found], least[found]
    digests = np.empty(len(start), _DIGEST)
    d, e = words.digests(start, width)
    digests["d"], digests["e"] = d.view(np.int64), (e >> np.uint64(32)).astype(np.uint32).view(np.int32)
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])])) if len(doc) else np.empty(0, np.int64)
    row, mine = of[least[cuts]], held[doc[cuts]]
    docs, ties = left["doc"].to_numpy()[mine], left["tie"].to_numpy()[mine]
    parts = right["parts"].to_numpy()[row]
    mixed = (docs.view(np.uint64) * np.uint64(_BASES[0]) ^ ties.view(np.uint64)) >> np.uint64(20)
    part = np.where(parts > 1, 1 + (mixed % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64), 0)
    return pa.table({
        "bucket": pa.array(right["bucket"].to_numpy()[row]), "part": pa.array(part.astype(np.int32)), "doc": pa.array(docs), "tie": pa.array(ties),
        "at": pa.array((start[cuts] - words.starts[doc[cuts]]).astype(np.int32)), "digests": _bytes_of(digests, cuts),
    })


def compare(table: pa.Table, width: int) -> pa.Table:
    """Windows of one bucket, or of one part of it, with a smaller document: doc, tie and their words a to b.

    Of a part, also doc, tie, a, d, e of each window of the least document that has it there.
    """
    digests = table["digests"].to_pylist()
    sizes = np.fromiter(map(len, digests), np.int64) // _DIGEST.itemsize
    digests = np.frombuffer(b"".join(digests), _DIGEST)
    d, e = np.ascontiguousarray(digests["d"]), np.ascontiguousarray(digests["e"])
    row = np.repeat(np.arange(len(sizes)), sizes)
    docs, ties = table["doc"].to_numpy()[row], table["tie"].to_numpy()[row]
    at = table["at"].to_numpy()[row].astype(np.int64) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((docs, e, d))
    new = np.concatenate([[True], (d[order][1:] != d[order][:-1]) | (e[order][1:] != e[order][:-1])])
    late = np.empty(len(row), bool)
    late[order] = docs[order][new][np.cumsum(new) - 1] < docs[order]
    first = late & np.concatenate([[True], ~late[:-1] | (row[1:] != row[:-1])])
    last = late & np.concatenate([~late[1:] | (row[1:] != row[:-1]), [True]])
    table_of = lambda pick, b, d, e: pa.table({"doc": docs[pick], "tie": ties[pick], "a": at[pick].astype(np.int32), "b": b, "d": d, "e": e})
    n = int(first.sum())
    out = table_of(first, pa.array((at[last] + width).astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()))
    if table["part"][0].as_py():
        heads = ~late
        out = pa.concat_tables([out, table_of(heads, pa.nulls(int(heads.sum()), pa.int32()), pa.array(d[heads]), pa.array(e[heads]))])
    return out


def repeated_spans(docs: DataFrame, width: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc, tie, spans: word spans that lie in windows which a smaller document holds too.

    docs has doc (long), tie (a hash of the text) and text. Only documents with spans are returned.
    """
    docs = docs.where(F.col("doc").isNotNull() & (F.octet_length("text") >= 2 * width - 1))  # shorter texts have no window
    held = materialise(phrases(docs, width), "phrases")
    room = max(1, shard_bytes // 48)
    seen = held.groupBy("p", "q").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.sum("n").alias("n"), F.sum(F.col("n") + 4).alias("weight"))
    recurring = materialise(seen.where("least < most").select("p", "q", F.ceil(F.col("weight") / room).alias("parts"), "n"), "recurring")
    shards = -(-(held.agg(F.sum("n")).first()[0] or 1) * WORD_BYTES // shard_bytes)
    buckets = -(-(recurring.agg(F.sum("n")).first()[0] or 1) // room)
    shard = F.pmod(F.xxhash64("doc", "tie"), F.lit(shards)).alias("shard")
    bucket = F.pmod(F.xxhash64("p", "q"), F.lit(buckets)).alias("bucket")
    dealt = held.join(recurring.select("p", "q", "parts"), ["p", "q"]).select(shard, "p", "q", bucket, "parts")
    streams = docs.select(shard, "doc", "tie", "text")
    schema = "bucket long, part int, doc long, tie long, at int, digests binary"
    runs = materialise(streams.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(lambda a, b: locate(a, b, width), schema), "windows")
    discard(held, recurring)
    schema = "doc long, tie long, a int, b int, d long, e int"
    found = materialise(runs.groupBy("bucket", "part").applyInArrow(lambda t: compare(t, width), schema), "located")
    discard(runs)
    heads = found.where("b is null")
    least = heads.groupBy("d", "e").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("d", "e", "least")
    across = heads.join(least, ["d", "e"]).where("least < doc").select("doc", "tie", "a").distinct()
    island = F.col("a") - F.row_number().over(Window.partitionBy("doc", "tie").orderBy("a"))
    across = across.withColumn("island", island).groupBy("doc", "tie", "island").agg(F.min("a").alias("a"), (F.max("a") + width).alias("b")).drop("island")
    spans = found.where("b is not null").select("doc", "tie", "a", "b").unionByName(across)
    return spans.groupBy("doc", "tie").agg(F.collect_list(F.array("a", "b")).alias("spans"))


def kept_words(text: str | None, spans: list[list[int]] | None) -> tuple[int, list[bytes]]:
    """Words of a text, and those outside the spans."""
    found = (text or "").encode().split()
    if not spans:
        return len(found), found
    gone = np.zeros(len(found) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    return len(found), [w for w, g in zip(found, np.cumsum(gone).tolist()) if not g]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove every word in a window of `width` words that also starts in a document of a smaller key (an integer).

    Returns the columns of docs with n_words, n_removed, kept_text (the words that
    stay, joined by one space) and spans (removed word spans, unmerged; null if
    none) behind them. Windows are judged on the input. Null, empty and short
    texts have no windows. Rows of one key never remove each other's words; rows
    that repeat are treated alike. A null key neither removes nor loses words.
    An empty table gives none. Extra columns pass through; columns that already
    have one of the four names are replaced.
    """
    worker_path(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept_text", "spans", "__doc", "__tie")
    slim = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))
    spans = repeated_spans(slim, width, shard_bytes).select(F.col("doc").alias("__doc"), F.col("tie").alias("__tie"), "spans")
    joined = docs.join(spans, (F.col(key).cast("long") == F.col("__doc")) & (F.xxhash64(F.col(text)) == F.col("__tie")), "left").drop("__doc", "__tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            n, removed, kept = [], [], []
            for t, s in zip(batch.column(names.index(text)), batch.column(names.index("spans"))):
                total, rest = kept_words(t.as_py(), s.as_py())
                n.append(total)
                removed.append(total - len(rest))
                kept.append(b" ".join(rest).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema)
    return joined.mapInArrow(run, f"{fields}, n_words long, n_removed long, kept_text string")
