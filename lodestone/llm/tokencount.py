"""Token counts: pieces per distinct pre-token, joined to per-document frequencies."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestone.llm import pieces as P
from lodestone.session import materialise, worker_path

#: UTF-8 bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Text bytes for which there is a hash bucket that distinct pre-tokens are joined in, and the least number of buckets.
BUCKET_BYTES = 128 << 20
BUCKETS = 64
#: Piece counts that a bucket remembers: about 100 bytes each.
REMEMBERED = 2_000_000


class _Numbers(dict):
    """Key -> its number, given out in the order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _pack(numbers: np.ndarray) -> bytes:
    """Small non-negative numbers, bytes of the same weight together."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = pa.decompress(blob[8:], 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel()


def _pack_texts(texts: list[str]) -> bytes:
    body = "".join(texts).encode()
    sizes = _pack(np.array([len(t) for t in texts]))
    return len(sizes).to_bytes(4, "little") + sizes + len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack_texts(blob: bytes) -> list[str]:
    n = int.from_bytes(blob[:4], "little")
    ends = np.cumsum(_unpack(blob[4 : 4 + n])).tolist()
    body = pa.decompress(blob[12 + n :], int.from_bytes(blob[4 + n : 12 + n], "little"), codec="zstd", asbytes=True).decode()
    return [body[a:b] for a, b in zip([0, *ends], ends)]


class _Block:
    """Frequencies of a block: documents x chunks, and chunks x pre-tokens."""

    def __init__(self, tok: P.Pieces):
        self.tok, self.keys, self.n_bytes, self.size = tok, [], [], 0
        self.chunks, self.rows = _Numbers(), []

    def _numbers(self, words: list[str], check: bool) -> list[int]:
        got = list(map(self.chunks.get, words))
        if None in got:
            if check and not P.regular([w for w, n in zip(words, got) if n is None]):
                raise P.Irregular
            got = list(map(self.chunks.__getitem__, words))
        return got

    def add(self, key, text: str | None) -> None:
        text, row = text or "", []
        for part in self.tok.segments(text) if self.tok.piecewise else [text]:
            if part in self.tok.special or not self.tok.piecewise:
                row += self._numbers([P.BARE + part], False)
                continue
            try:
                row += self._numbers(P.chunks(part), True)
            except P.Irregular:
                row += self._numbers(P.chunks_any(part), False)
        self.keys.append(key)
        self.n_bytes.append(len(text.encode()))
        self.size += self.n_bytes[-1]
        self.rows.append(np.array(row, np.int64))

    def done(self, block: int, buckets: int) -> tuple:
        """Block, keys, bytes, the packed frequencies, and the pre-tokens by bucket."""
        counts = [np.unique(r, return_counts=True) for r in self.rows]
        split, numbers, lengths = _Numbers(), [], []
        whole = not self.tok.piecewise
        for chunk in self.chunks:
            parts = [chunk[1:]] if chunk[:1] == P.BARE and (whole or chunk[1:] in self.tok.special) else P.pretokens(chunk)
            numbers += map(split.__getitem__, parts)
            lengths.append(len(parts))
        flat = lambda xs: np.concatenate([np.empty(0, np.int64), *xs])
        steps = flat([np.diff(i, prepend=0) for i, _ in counts])
        numbers = np.array(numbers, np.int64)
        seen = np.maximum.accumulate(np.concatenate([[-1], numbers]))[:-1]
        bucket_of = [zlib.crc32(p.encode()) % buckets for p in split]
        dealt: dict[int, list[str]] = {}
        for p, bucket in zip(split, bucket_of):
            dealt.setdefault(bucket, []).append(p)
        return (
            block, self.keys, self.n_bytes, _pack(np.array([len(i) for i, _ in counts])), _pack(steps), _pack(flat([n for _, n in counts])), _pack(np.array(lengths)),
            _pack(np.where(numbers > seen, 0, numbers + 1)), _pack(np.array(bucket_of)), [{"bucket": b, "pretokens": _pack_texts(t)} for b, t in dealt.items()],
        )


def _sums(lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    ends = np.cumsum(lengths)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - lengths]


def _tokens(n_chunks: bytes, steps: bytes, counts: bytes, lengths: bytes, numbers: bytes, pieces: np.ndarray) -> np.ndarray:
    """Sum of frequency times pieces, per document of a block."""
    per_doc = _unpack(n_chunks).astype(np.int64)
    steps = _unpack(steps).view("<i4").astype(np.int64)
    before = np.concatenate([[0], np.cumsum(steps)])
    index = before[1:] - before[np.repeat(np.cumsum(per_doc) - per_doc, per_doc)]
    codes = _unpack(numbers).astype(np.int64)
    split = np.where(codes == 0, np.cumsum(codes == 0) - 1, codes - 1)
    per_chunk = _sums(_unpack(lengths).astype(np.int64), pieces[split])
    return _sums(per_doc, per_chunk[index] * _unpack(counts))


def frequencies(docs: DataFrame, path: str, key: str, text: str, block_bytes: int, buckets: int) -> DataFrame:
    """One row per block of documents: its packed frequencies, and its distinct pre-tokens by hash bucket."""
    kind = docs.schema[key].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, base = P.pieces(path), TaskContext.get().partitionId() << 32
        names = ["block", "keys", "n_bytes", "n_chunks", "steps", "counts", "lengths", "numbers", "bucket_of", "dealt"]
        block, n, types = _Block(tok), 0, None

        def row() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.list_(types), pa.list_(pa.int64()), *[pa.binary()] * 6, pa.list_(pa.struct([("bucket", pa.int32()), ("pretokens", pa.binary())]))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block.done(base | n, buckets), kinds)], names=names)

        for batch in batches:
            types = batch.column(0).type
            for k, t in zip(batch.column(0), batch.column(1)):
                block.add(k.as_py(), t.as_py())
                if block.size >= block_bytes or len(block.keys) >= 100_000:
                    yield row()
                    block, n = _Block(tok), n + 1
        if block.keys:
            yield row()

    packed = ", ".join(f"{c} binary" for c in ("n_chunks", "steps", "counts", "lengths", "numbers", "bucket_of"))
    schema = f"block long, keys array<{kind}>, n_bytes array<long>, {packed}, dealt array<struct<bucket:int,pretokens:binary>>"
    return docs.select(F.col(key), F.col(text)).mapInArrow(blocks, schema)


def piece_counts(asked: DataFrame, path: str, remembered: int = REMEMBERED) -> DataFrame:
    """(asker, bucket, pretokens) -> (asker, bucket, pieces): a hash join, bucket by bucket.

    Each distinct pre-token goes through the model once, when its bucket meets it
    first. A bucket that remembers too many counts starts anew, and counts again.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Counts(dict):
            def __missing__(self, pretoken: str) -> int:
                self[pretoken] = n = tok.count(pretoken)
                return n

        tok, at, counts = P.pieces(path), None, Counts()
        for batch in batches:
            answers = []
            for bucket, blob in zip(batch.column(1), batch.column(2)):
                if bucket.as_py() != at:
                    at, counts = bucket.as_py(), Counts()
                elif len(counts) >= remembered:
                    counts.clear()
                answers.append(_pack(np.fromiter(map(counts.__getitem__, _unpack_texts(blob.as_py())), np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(answers, pa.binary())], names=["asker", "bucket", "pieces"])

    rows = asked.repartition("bucket").sortWithinPartitions("bucket")
    return rows.select("asker", "bucket", "pretokens").mapInArrow(count, "asker long, bucket int, pieces binary")


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """Tokens of every whole text under the tokenizer file at `path`.

    Returns key, n_bytes, n_tokens, over_limit (n_tokens > limit), a row per
    input row: repeated rows and null keys stay; null texts count as empty, with
    no bytes and no tokens. An empty table gives none. Other columns aren't read.

    Documents are taken in blocks. A block keeps the frequencies of its documents
    packed, and its distinct pre-tokens as strings, by hash bucket. Only those are
    shuffled to be joined to piece counts, so a frequent pre-token is a string per
    block, not per document. Piece counts return to their block, which sums
    frequency times pieces. No id is made. Unless given, `buckets` grows with the
    bytes of all texts; the pre-tokens of one bucket are held in memory, up to REMEMBERED.
    """
    spark = docs.sparkSession
    worker_path(spark)
    if buckets is None:
        buckets = max(BUCKETS, (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BUCKET_BYTES)
    blocks = materialise(frequencies(docs, path, key, text, block_bytes, buckets), "frequencies")
    answers = piece_counts(blocks.select(F.col("block").alias("asker"), F.inline("dealt")), path)
    packed = blocks.drop("dealt")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {name: left[name][0] for name in left.column_names}
        order = np.argsort(_unpack(row["bucket_of"].as_py()), kind="stable")
        parts = sorted(zip(right["bucket"].to_pylist(), right["pieces"].to_pylist()))
        pieces = np.zeros(len(order), np.int64)
        pieces[order] = np.concatenate([np.empty(0, np.int64), *(_unpack(blob) for _, blob in parts)])
        tokens = _tokens(*(row[n].as_py() for n in ("n_chunks", "steps", "counts", "lengths", "numbers")), pieces)
        return pa.table({key: row["keys"].values, "n_bytes": row["n_bytes"].values, "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array(tokens > limit)})

    return packed.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(total, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")
