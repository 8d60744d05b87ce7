"""Packing of token sequences by non-negative least squares over a length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestone.llm import pieces as P
from lodestone.session import worker_path

#: Tokens gathered before a cell is packed: bounds the memory of a task.
CELL_TOKENS = 8_000_000


@lru_cache(maxsize=4)
def combinations(bins: int) -> np.ndarray:
    """Columns of counts per bin (bin b holds lengths of up to b + 1 units) that fill a window of `bins` units.

    Shallow ones only: one bin alone or repeated, closed by at most one other
    bin, and three bins once each.
    """
    found: set[tuple[tuple[int, int], ...]] = set()

    def add(*parts: int) -> None:
        counts: dict[int, int] = {}
        for p in parts:
            if p:
                counts[p] = counts.get(p, 0) + 1
        found.add(tuple(sorted(counts.items())))

    for a in range(1, bins + 1):
        for k in range(1, bins // a + 1):
            add(*[a] * k, bins - k * a)
        for b in range(a, bins - a + 1):
            if bins - a - b >= b:
                add(a, b, bins - a - b)
    out = np.zeros((bins, len(found)))
    for n, counts in enumerate(sorted(found)):
        for size, times in counts:
            out[size - 1, n] = times
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set method on the normal equations."""
    gram, target = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gradient = target - gram @ x
        gradient[active] = -np.inf
        # As many of the steepest columns at once as touch no bin twice.
        order, used = np.argsort(-gradient)[:64], np.zeros(a.shape[0], bool)
        grown = False
        for j in order:
            if gradient[j] <= slack:
                break
            if not (used & (a[:, j] > 0)).any():
                used |= a[:, j] > 0
                active[j] = grown = True
        if not grown:
            break
        while True:
            at = np.flatnonzero(active)
            y = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (y > 0).all():
                x[:] = 0
                x[at] = y
                break
            bad = y <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - y[bad], 1e-300))
            x[at] += step * (y - x[at])
            drop = at[bad & (x[at] <= 1e-12)]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                break
    return x


def solve(lengths: np.ndarray, window: int, width: int) -> list[list[int]]:
    """Positions into lengths that share a window, as far as full combinations go.

    Repeat counts solve the histogram of lengths in bins of `width`, and are
    rounded down, then as far up as the bins allow.
    """
    bins = window // width
    kind = np.minimum((lengths + width - 1) // width, bins) - 1
    stock = [np.flatnonzero(kind == b).tolist()[::-1] for b in range(bins)]
    have = np.array([len(s) for s in stock], float)
    combos = combinations(bins)
    solved = nnls(combos, have)
    out: list[list[int]] = []
    for up in (0, 1):
        for j in np.argsort(-solved, kind="stable"):
            if solved[j] <= 1e-9:
                break
            parts = [(b, int(combos[b, j])) for b in np.flatnonzero(combos[:, j])]
            times = 1 if up else int(solved[j])
            times = min([times, *(len(stock[b]) // n for b, n in parts)])
            for _ in range(times):
                out.append([stock[b].pop() for b, n in parts for _ in range(n)])
    return out


def plan(lengths: np.ndarray, window: int, width: int) -> list[list[int]]:
    """Whole remainders (positions into lengths) that share a window, by two histograms.

    Of remainders under eight units the rounding to units would take too large a
    share. They are solved to the token first, in bundles of eight units. Bundles
    and the longer remainders are then solved in units, over whole windows. What
    no full combination takes stays out.
    """
    small = 8 * width
    short, long = np.flatnonzero(lengths < small), np.flatnonzero(lengths >= small)
    members = [short[b].tolist() for b in solve(lengths[short], small, 1)] if len(short) else []
    members += [[i] for i in long.tolist()]
    sizes = np.array([lengths[m].sum() for m in members], np.int64)
    return [[i for m in group for i in members[m]] for group in (solve(sizes, window, width) if len(sizes) else [])]


def pack_cell(lengths: np.ndarray, window: int, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a cell of documents.

    A document's full windows are sequences of their own. Of the remainders,
    those that combinations take stay whole; the others fill further sequences
    greedily, largest first, cut where a sequence ends.
    """
    sequence, rest_of = 0, []
    for d, n in enumerate(lengths.tolist()):
        for k in range(n // window):
            yield d, k * window, window, sequence, 0
            sequence += 1
        if n % window:
            rest_of.append(d)
    rest = np.array(rest_of, np.int64)
    left = lengths[rest] % window
    taken = np.zeros(len(rest), bool)
    for group in plan(left, window, width) if len(rest) else []:
        offset = 0
        for i in group:
            taken[i] = True
            yield int(rest[i]), int(lengths[rest[i]] - left[i]), int(left[i]), sequence, offset
            offset += int(left[i])
        sequence += 1
    offset = 0
    residual = np.flatnonzero(~taken)
    for i in residual[np.argsort(-left[residual], kind="stable")]:
        start, n = int(lengths[rest[i]] - left[i]), int(left[i])
        while n:
            part = min(n, window - offset)
            yield int(rest[i]), start, part, sequence, offset
            start, n, offset = start + part, n - part, offset + part
            if offset == window:
                sequence, offset = sequence + 1, 0


def pack(docs: DataFrame, path: str, end_id: int, window: int = 2048, key: str = "doc_id", text: str = "text", width: int = 16, cell_tokens: int = CELL_TOKENS, ids: bool = True) -> DataFrame:
    """Pack the token ids of every document, each closed by end_id, into sequences of at most `window` ids.

    Returns a row per piece: key, start (ids of its document before it), length,
    ids_crc32 (of its ids as little-endian 32-bit numbers), doc_tokens, sequence_id,
    offset (in the sequence), and with `ids` the ids themselves.

    Each task packs cells of up to cell_tokens ids that it reads in a row, by the
    histogram of the cell, so nothing is shuffled and no key or length can weigh
    on one task; a sequence is numbered by partition and by its place there. A
    cell leaves at most one sequence short. Null texts are empty: one piece, the
    end id. Repeated rows and null keys are packed row by row; other columns are
    not read; an empty table gives none.
    """
    worker_path(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, base = P.pieces(path), TaskContext.get().partitionId() << 32
        keys, bodies, size = [], [], 0

        def flush(base: int) -> Iterator[tuple[pa.RecordBatch, int]]:
            made = list(pack_cell(np.array([len(b) for b in bodies], np.int64), window, width))
            for at in range(0, len(made), 4096):
                some = made[at : at + 4096]
                parts = [bodies[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in some]
                columns = [
                    pa.array([keys[d] for d, *_ in some], types), pa.array([s for _, s, *_ in some], pa.int64()), pa.array([n for _, _, n, *_ in some], pa.int64()),
                    pa.array(list(map(zlib.crc32, parts)), pa.int64()), pa.array([len(bodies[d]) for d, *_ in some], pa.int64()),
                    pa.array([base + q for *_, q, _ in some], pa.int64()), pa.array([o for *_, o in some], pa.int64()),
                ]
                names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names), max(q for *_, q, _ in some) + 1

        types = None
        for batch in batches:
            types = batch.column(0).type
            for k, found in zip(batch.column(0), tok.ids_of(batch.column(1))):
                body = np.append(found, np.array([end_id], tok.dtype))
                keys.append(k.as_py())
                bodies.append(body)
                size += len(body)
                if size >= cell_tokens:
                    used = 0
                    for out, n in flush(base):
                        used = max(used, n)
                        yield out
                    base += used
                    keys, bodies, size = [], [], 0
        for out, _ in flush(base):
            yield out

    schema = f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids
    return docs.select(F.col(key), F.col(text)).mapInArrow(cells, schema)
