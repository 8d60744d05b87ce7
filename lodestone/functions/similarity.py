"""Ratcliff-Obershelp similarity of many titles: an exact filter, and the ratio of long strings."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

#: Titles whose masks are held at once, and pairs that a step works on.
LANES, BLOCK = 4096, 6144
#: Pairs that are followed to their end at once, and words of masks held for them.
PAIRS = 4096
MASKS = 1 << 21
#: Characters that keep a class of their own, and classes that all others share.
OWN, SHARED = 48, 15
#: Places of a string in a word; the last bit takes the borrow of the next word.
PLACES = 63
#: Cells of a part in which equal characters are marked one by one, and length of the shorter part that is searched as text.
CELLS = 1 << 20
SMALL = 6
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _rolling(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of points times powers of the base, and powers that bring windows of any start to one scale."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[: len(points)], dtype=np.uint64)])
    return sums, powers[::-1]


def _hashed_block(a: str, b: str) -> tuple[int, int, int]:
    """Length and places of the longest block of long strings (of these the first in a, and then in b), by hashes of windows."""
    n = max(len(a), len(b))
    (sa, scale), (sb, _) = _rolling(_points(a), n), _rolling(_points(b), n)

    def windows(k: int) -> tuple[np.ndarray, np.ndarray]:
        return (sa[k:] - sa[: len(sa) - k]) * scale[: len(sa) - k], (sb[k:] - sb[: len(sb) - k]) * scale[: len(sb) - k]

    low, high = 0, min(len(a), len(b))
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if np.isin(*windows(k)).any() else (low, k - 1)
    if not low:
        return 0, 0, 0
    x, y = windows(low)
    i = int(np.isin(x, y).argmax())
    j = int((y == x[i]).argmax())
    if a[i : i + low] == b[j : j + low]:
        return low, i, j
    found = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()  # two windows of one hash
    return found.size, found.a, found.b


def _marked_block(equal: np.ndarray) -> tuple[int, int, int]:
    """The longest block where equal characters are marked: the longest run along a diagonal, whose length is put together from powers of two."""
    if not equal.any():
        return 0, 0, 0
    runs, size = [equal], 1
    while size < min(runs[-1].shape) and (longer := runs[-1][:-size, :-size] & runs[-1][size:, size:]).any():
        runs.append(longer)
        size *= 2
    best = runs.pop()
    for k in range(len(runs) - 1, -1, -1):
        n, m = (min(best.shape[d], runs[k].shape[d] - size) for d in (0, 1))
        if n > 0 and m > 0 and (longer := best[:n, :m] & runs[k][size : size + n, size : size + m]).any():
            best, size = longer, size + (1 << k)
    return size, *divmod(int(best.argmax()), best.shape[1])


def _text_block(a: str, b: str) -> tuple[int, int, int]:
    """The longest block where one of both is short."""
    for k in range(min(len(a), len(b)), 0, -1):
        for i in range(len(a) - k + 1):
            if (j := b.find(a[i : i + k])) >= 0:
                return k, i, j
    return 0, 0, 0


def _matched(a: str, b: str) -> int:
    """Characters in the matching blocks of difflib (without junk): the longest, of these the first in a and then in b, and those on either side of it."""
    total, stack, held = 0, [(0, len(a), 0, len(b))], None
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if min(a1 - a0, b1 - b0) <= SMALL:
            size, i, j = _text_block(a[a0:a1], b[b0:b1])
        elif (a1 - a0) * (b1 - b0) > CELLS:
            size, i, j = _hashed_block(a[a0:a1], b[b0:b1])
        else:
            # Marks of a part serve the parts within it, which come next.
            if held is None or not (held[0] <= a0 and a1 <= held[1] and held[2] <= b0 and b1 <= held[3]):
                held = (a0, a1, b0, b1, _points(a[a0:a1])[:, None] == _points(b[b0:b1]))
            size, i, j = _marked_block(held[4][a0 - held[0] : a1 - held[0], b0 - held[2] : b1 - held[2]])
        if size:
            total += size
            i, j = a0 + i, b0 + j
            stack += [(s, e, t, f) for s, e, t, f in ((a0, i, b0, j), (i + size, a1, j + size, b1)) if s < e and t < f]
    return total


def ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b, autojunk=False).ratio()."""
    return 2.0 * _matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def _need(la: np.ndarray, lb: np.ndarray, least: float) -> np.ndarray:
    """Matches without which strings of these lengths stay below `least`, with room for rounding."""
    return np.ceil(least * (la + lb) / 2 - 1e-6).astype(np.int64)


def _before(words: np.ndarray, rows: np.ndarray, places: int) -> np.ndarray:
    """Bits of the words (first axis, `places` in each) in the rows before those that each place of the last axis asks for."""
    got = np.zeros(words.shape[1:], np.int32)
    for w in range(min(len(words), max(0, int(rows.max()) - 1) // places + 1)):
        at = np.clip(rows - w * places, 0, places).astype(np.uint64)
        # A word of 64 places would be shifted by one too many.
        kept = np.where(at == 64, ~np.uint64(0), (_ONE << (at & np.uint64(63))) - _ONE)
        got += np.bitwise_count(words[w] & kept)
    return got


class _Long:
    """Pairs one by one, in integers of as many bits as a string is long: for pairs too few to be worth array calls for every word."""

    def __init__(self, codes: np.ndarray, start: np.ndarray, lens: np.ndarray, least: float) -> None:
        self.codes, self.start, self.lens, self.least, self.held = codes, start, lens, least, (-1, {})

    @staticmethod
    def fits(pairs: int, length: int) -> bool:
        return pairs < 64 + 16 * (length // PLACES)

    def reaches(self, a: int, b: int) -> bool:
        """Whether the longest common subsequence may have the matches that the ratio needs; the rule of _prefixes."""
        la, lb = int(self.lens[a]), int(self.lens[b])
        need = int(_need(la, lb, self.least))
        if need > min(la, lb):
            return False
        if self.held[0] != a:
            own = self.codes[self.start[a] : self.start[a] + la]
            self.held = a, {c: int.from_bytes(np.packbits(own == c, bitorder="little").tobytes(), "little") for c in np.unique(own).tolist()}
        masks, every = self.held[1], max(16, lb // 32)
        text = self.codes[self.start[b] : self.start[b] + lb].tolist()
        # Rows beyond the band of a stretch of columns join when it gets there.
        state, rows = 0, 0
        for at in range(0, lb, every):
            rows = min(la, at + every + la - need)
            kept = (1 << rows) - 1
            for c in text[at : at + every]:
                grown = state | masks.get(c, 0) & kept
                state = (2 * state - grown) & grown
            j = min(at + every, lb)
            before = max(0, j + la - lb)
            if (state & ((1 << before) - 1)).bit_count() < j - (lb - need):
                return False
        return state.bit_count() >= need


def _prefixes(codes: np.ndarray, start: np.ndarray, lens: np.ndarray, lanes: np.ndarray, cols: np.ndarray, first: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(column, lane) in arrays: pairs that the beginnings of their strings don't rule out.

    lanes and cols: strings in the order of their length; a column meets the lanes
    from `first` on, which are no shorter. Codes are 1 and more.

    All lanes follow a column's characters at once: masks tell where a lane holds a
    character, so that a step looks nothing up for a pair. A bit tells that the common
    subsequence with what was read of the column grows at that place of the lane
    (Hyyro's form, complemented). With `need` matches the places of a match differ by
    no more than the characters that may stay unmatched, so words outside that band
    are skipped. Let j characters of the column and the j + la - lb first of the lane
    be read, so that as many of either remain as belong together: a pair with `need`
    matches has j - (lb - need) of them there at least, for on any other way through
    the surplus of one side stays unmatched as well.
    """
    n, m = lens[lanes], lens[cols]
    last = np.searchsorted(n, np.floor(((2 - least) * m + 1e-6) / max(least, 1e-9) + 1e-6), "right")
    end = 0
    while end < len(n):
        # Lanes of like length, unless they are few.
        near, far = (int(np.searchsorted(n, n[end] * f, "right")) for f in (1.08, 1.3))
        at, end = end, min(end + LANES, max(near, min(far, end + LANES // 16)))
        meet = np.flatnonzero((first < end) & (last > at) & (first < last))
        if not len(meet):
            continue
        la, own = n[at:end], np.arange(end - at)
        rows = min(int(la[-1]), int(0.62 * la[-1]) + 40)
        words = -(-rows // PLACES)
        masks = np.zeros((words, int(codes.max()) + 1, len(la)), np.uint64)
        for p in range(rows):
            k = own[np.searchsorted(la, p, "right") :]
            masks[p // PLACES, codes[start[lanes[at + k]] + p], k] |= np.uint64(1 << (p % PLACES))
        usual = 0.0
        while len(meet):
            begin = max(0, int(first[meet[0]]) - at)
            size = max(1, BLOCK // (min(len(la), int(last[meet[0]]) - at) - begin))
            size = min(size, int(np.searchsorted(m[meet], m[meet[0]] * 1.2, "right")))
            part, meet = meet[:size], meet[size:]
            upto = min(len(la), int(last[part[-1]]) - at)
            lane, lb = la[begin:upto], m[part]
            need = _need(lane, lb[:, None], least)
            place = np.arange(begin + at, upto + at)
            alive = (place >= first[part][:, None]) & (place < last[part][:, None])
            if _Long.fits(int(alive.sum()), int(0.4 * lb[0])):
                c, k = np.nonzero(alive)
                yield cols[part[c]], lanes[k + (begin + at)]
                continue
            spare = (lb[:, None] - need).astype(np.int32)
            spare[~alive] = -1 << 20  # never enough
            ahead, behind = int((lane - need).max()), int(spare.max())
            short = int(lb[0])
            stop = max(0, min(short, rows - int(lane[-1]) + short))
            read = np.array([codes[start[c] : start[c] + stop] for c in cols[part]]).T.astype(np.intp)
            state = np.zeros((words, len(part), upto - begin), np.uint64)
            every, seen, few = max(6, short // 32), None, alive.sum() // 128
            j, check = 0, max(every, int(usual * short) - every)
            while j < stop:
                for j in range(j, min(stop, check)):
                    lo, hi = max(0, j - behind) // PLACES, min(words, (j + ahead) // PLACES + 1)
                    if seen != (lo, hi):
                        seen, now = (lo, hi), state[lo:hi]
                        grown, less, borrow = np.empty_like(now), np.empty_like(now), np.empty_like(now[0])
                        whole = [masks[w, :, begin:upto] for w in range(lo, hi)]
                    for w, mask in enumerate(whole):
                        np.bitwise_or(mask[read[j]], now[w], out=grown[w])
                    np.subtract(now, grown, out=less)
                    np.add(less, now, out=less)
                    for w in range(1, hi - lo):
                        np.right_shift(less[w - 1], PLACES, out=borrow)
                        np.subtract(less[w], borrow, out=less[w])
                    np.bitwise_and(less, grown, out=now)
                j += 1
                # Where columns are about as long, the shortest serves for all: it asks for the most rows, which only lets more pass.
                alive &= _before(state, j + lane - (short if lb[-1] <= 1.02 * short else lb[:, None]), PLACES) + spare >= j
                if alive.sum() <= few:
                    break
                check = j + every
            usual = j / short
            c, k = np.nonzero(alive)
            if len(c):
                yield cols[part[c]], lanes[k + (begin + at)]


def _subsequences(masks: np.ndarray, base: np.ndarray, la: np.ndarray, codes: np.ndarray, col: np.ndarray, lens: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Of pairs (base and la on the left, col and lens on the right) those whose longest common subsequence may have `need` characters.

    masks: 64 places of the strings on the left in a word (rows), at base + code;
    codes: the strings on the right, by place and col. A common subsequence in
    bit-parallel form, a column for each pair, with the band and the rule of _prefixes.
    """
    alive = np.arange(len(col))
    spare_a, spare_b = int((la - need).max()), int((lens - need).max())
    words = np.full((len(masks), len(col)), ~np.uint64(0))
    every = max(16, int(lens.min()) // 16)
    for j in range(int(lens.max())):
        if j and j % every == 0:
            done = np.minimum(j, lens)
            keep = _before(~words, done + la - lens, 64) >= done - (lens - need)
            if not keep.any():
                return alive[:0]
            if keep.sum() < 0.8 * len(keep):
                alive, words, la, lens, need, base, col = alive[keep], words[:, keep], la[keep], lens[keep], need[keep], base[keep], col[keep]
        lo, hi = max(0, j - spare_b) // 64, min(len(masks), (j + spare_a) // 64 + 1)
        if lo >= hi:
            continue
        at, carry = base + codes[j].take(col), None
        for w in range(lo, hi):
            old = words[w]
            hit = masks[w].take(at)
            hit &= old
            new = old + hit
            if w + 1 < hi:
                over = new < old
                if carry is not None:
                    new += carry
                    over |= new < carry
                carry = over.astype(np.uint64)
            elif carry is not None:
                new += carry
            hit ^= old
            new |= hit
            words[w] = new
    return alive[np.bitwise_count(~words).sum(0, dtype=np.int64) >= need]


def may_reach(left: list[str], right: list[str] | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) in arrays: pairs of left and right whose ratio may be `least` or more; without right, pairs of left, each once.

    An exact filter: matching blocks are a common subsequence, so nothing that
    reaches the ratio is lost where the longest one is too short. It is bounded by
    the beginnings of many strings at once, then taken for each pair that is left.
    Rare characters share classes, by which a common subsequence can only grow.
    Titles aren't empty.
    """
    both = left if right is None else left + right
    if not left or len(both) < 2:
        return
    values, place, often = np.unique(_points("".join(both)), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(values))
    codes = (np.where(rank < OWN, rank, OWN + rank % SHARED) + 1).astype(np.uint8)[place]
    lens = np.array([len(t) for t in both])
    start = np.cumsum(lens) - lens
    width = int(codes.max()) + 1
    mine = np.argsort(lens[: len(left)], kind="stable")
    if right is None:
        sides = [(mine, mine, np.arange(1, len(mine) + 1))]
    else:
        theirs = len(left) + np.argsort(lens[len(left) :], kind="stable")
        sides = [(mine, theirs, np.searchsorted(lens[mine], lens[theirs], "left")), (theirs, mine, np.searchsorted(lens[theirs], lens[mine], "right"))]

    long = _Long(codes, start, lens, least)

    def whole(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose longest common subsequence is long enough."""
        order = np.argsort(lens[a], kind="stable")
        a, b = a[order], b[order]
        while len(a):
            size = min(PAIRS, max(1, MASKS // (width * (int(lens[a[:PAIRS]].max()) // 64 + 1))))
            x, y, a, b = a[:size], b[:size], a[size:], b[size:]
            if _Long.fits(len(x), int(lens[x].max())):
                order = np.argsort(y, kind="stable")
                x, y = x[order], y[order]
                found = np.array([long.reaches(q, p) for p, q in zip(x.tolist(), y.tolist(), strict=True)], bool)
                x, y = x[found], y[found]
                yield (x, y) if right is None else (np.minimum(x, y), np.maximum(x, y) - len(left))
                continue
            rows, row = np.unique(x, return_inverse=True)
            others, col = np.unique(y, return_inverse=True)
            masks = np.zeros(((int(lens[rows].max()) + 63) // 64, len(rows) * width), np.uint64)
            for k, r in enumerate(rows):
                places = np.arange(lens[r])
                np.bitwise_or.at(masks, (places // 64, k * width + codes[start[r] : start[r] + lens[r]].astype(np.int64)), _ONE << (places % 64).astype(np.uint64))
            read = np.zeros((int(lens[others].max()), len(others)), np.uint8)
            for k, o in enumerate(others):
                read[: lens[o], k] = codes[start[o] : start[o] + lens[o]]
            found = _subsequences(masks, row * width, lens[x], read, col, lens[y], _need(lens[x], lens[y], least))
            x, y = x[found], y[found]
            yield (x, y) if right is None else (np.minimum(x, y), np.maximum(x, y) - len(left))

    for lanes, cols, first in sides:
        held, count = [], 0
        for pair in _prefixes(codes, start, lens, lanes, cols, first, least):
            held.append(pair)
            count += len(pair[0])
            if count >= PAIRS:
                yield from whole(*map(np.concatenate, zip(*held, strict=True)))
                held, count = [], 0
        if held:
            yield from whole(*map(np.concatenate, zip(*held, strict=True)))
