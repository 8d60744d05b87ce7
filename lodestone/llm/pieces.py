"""Sub-word pieces of texts, by a public tokenizer file of the tokenizers library.

A byte-level BPE file is applied piecewise. White space only ever starts a
pre-token, so a text may be cut in front of any run of white space without
changing its pre-tokens. Texts are cut there into chunks (a space and a word,
mostly), each distinct chunk is split into pre-tokens once, and each distinct
pre-token goes through the library's model once. Other kinds of files are
applied to whole texts by the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

#: Unicode White_Space, and what Python also takes for white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
ALSO_WHITE = "\x1c\x1d\x1e\x1f"
#: Fixed value: the pre-token pattern of byte-level BPE.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CHUNK = regex.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Marks a chunk that does not start with one space.
BARE = "\x00"
_ODD = regex.compile(f" [{WHITE}{ALSO_WHITE}]|[{WHITE}{ALSO_WHITE}] ")


class Irregular(Exception):
    """The text has white space other than single spaces between words."""


def chunks(text: str) -> list[str]:
    """Cut at single spaces. Each chunk lacks its leading space; the first is marked bare."""
    if BARE in text:
        raise Irregular
    first, *rest = text.split(" ")
    return [BARE + first, *rest]


def chunks_any(text: str) -> list[str]:
    """Cut in front of every run of white space; all chunks are marked bare."""
    return [BARE + c for c in CHUNK.findall(text)]


def regular(words: list[str]) -> bool:
    """Whether no chunk of chunks() has white space at an end, but for the start of the text."""
    inner = [w for w in words if w[:1] != BARE]
    if "" in inner or any(w[-1].isspace() for w in words if w[:1] == BARE and w != BARE):
        return False
    return not inner or _ODD.search(f" {' '.join(inner)} ") is None


def pretokens(chunk: str) -> list[str]:
    """The pre-tokens of a chunk."""
    if chunk[:1] == BARE:
        return PRETOKEN.findall(chunk[1:])
    return PRETOKEN.findall(" " + chunk)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class Pieces:
    """The pieces of texts, for one tokenizer file.

    room bounds the remembered chunks (about 200 bytes each).
    """

    def __init__(self, path: str, room: int = 150_000):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.piecewise = (
            spec["model"].get("type") == "BPE"
            and spec.get("normalizer") is None
            and not spec["model"].get("dropout")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and not any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        self.special = {a["content"]: a["id"] for a in added}
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self._letters = _byte_letters()
        self._model = self.tok.model
        self._room, self._memo = room, {}
        self._core = self._ranked(spec["model"]) if self.piecewise else None
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _ranked(self, model: dict) -> tiktoken.Encoding | None:
        """The same merges in the faster core of tiktoken, if ids are in the order of the merges.

        Both then join the pair of the least rank first, so the ids agree.
        """
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if sorted(vocab.values()) != list(range(len(vocab))) or len(merges) + 256 != len(vocab) or any(vocab.get(a + b) != 256 + n for n, (a, b) in enumerate(merges)):
            return None
        back = {letter: byte for byte, letter in self._letters.items()}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items()}
        self._length = np.zeros(len(ranks), np.int64)
        for token, i in ranks.items():
            self._length[i] = len(token)
        return tiktoken.Encoding("pieces", pat_str=PRETOKEN.pattern, mergeable_ranks=ranks, special_tokens={})

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which stand as segments of their own."""
        if not any(s in text for s in self.special):
            return [text] if text else []
        return [s for s in self._split.split(text) if s]

    def model_ids(self, pretoken: str) -> list[int]:
        """The ids of one pre-token or special string."""
        if (known := self.special.get(pretoken)) is not None:
            return [known]
        letters = pretoken.encode().decode("latin-1").translate(self._letters)
        return [t.id for t in self._model.tokenize(letters)]

    def count(self, pretoken: str) -> int:
        """Pieces of one pre-token; of a whole text, where the file isn't applied piecewise."""
        if not self.piecewise:
            return len(self.tok.encode(pretoken, add_special_tokens=False).ids)
        return len(self.model_ids(pretoken))

    def _fresh(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of chunks not remembered yet."""
        fresh, inner = {}, missing
        if self._core is None or any(c[:1] == BARE for c in missing):
            slow = [c for c in missing if self._core is None or c[:1] == BARE]
            inner = [c for c in missing if self._core is not None and c[:1] != BARE]
            for c in slow:
                fresh[c] = np.array([i for p in pretokens(c) for i in self.model_ids(p)], self.dtype).tobytes()
        if inner:
            joined = " " + " ".join(inner)
            ids = np.array(self._core.encode_ordinary(joined), self.dtype)
            sizes = np.fromiter(map(len, inner if joined.isascii() else map(str.encode, inner)), np.int64, len(inner)) + 1
            cuts = (np.searchsorted(np.cumsum(self._length[ids]), np.cumsum(sizes)) + 1) * self.dtype.itemsize
            raw, at = ids.tobytes(), 0
            for c, cut in zip(inner, cuts.tolist()):
                fresh[c] = raw[at:cut]
                at = cut
        return fresh

    def _inner(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks that follow a space, one chunk after the other, and how many each has."""
        ids, sizes = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        for at in range(0, len(words), 100_000):
            some = words.slice(at, 100_000)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
            ids.append(np.array(self._core.encode_ordinary(" " + joined), self.dtype))
            ends = np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64) + 1)
            sizes.append(np.diff(np.searchsorted(np.cumsum(self._length[ids[-1]]), ends) + 1, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _first(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks that start a text, and how many each has."""
        ids = []
        for word in words:
            if (found := self._memo.get(BARE + word)) is None:
                found = self._fresh([BARE + word])[BARE + word]
                if len(self._memo) < self._room:
                    self._memo[BARE + word] = found
            ids.append(found)
        return np.frombuffer(b"".join(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize

    def _together(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of several texts: each distinct chunk of them is split once, and all are put together by number."""
        plain = pc.invert(pc.match_substring(texts, BARE))
        for special in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, special)))
        at = np.flatnonzero(pc.fill_null(plain, False).to_numpy(zero_copy_only=False))
        out: list[np.ndarray | None] = [None] * len(texts)
        if len(at):
            lists = pc.split_pattern(texts.take(pa.array(at)), " ")
            coded = lists.flatten().dictionary_encode()
            words, number = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy())
            first = np.concatenate([[0], ends[:-1]])
            trimmed = pc.utf8_trim(words, WHITE + ALSO_WHITE)
            length = pc.binary_length(words).to_numpy()
            odd = (length == 0) | (pc.binary_length(trimmed).to_numpy() != length)
            late = length != pc.binary_length(pc.utf8_rtrim(words, WHITE + ALSO_WHITE)).to_numpy()
            bad = odd[number]
            bad[first] = late[number[first]]
            regular = ~np.logical_or.reduceat(bad, first)
            live = np.repeat(regular, ends - first)
            live[first] = False
            starts = np.zeros(len(number), bool)
            starts[first[regular]] = True
            used, starters = np.zeros(len(words), bool), np.zeros(len(words), bool)
            used[number[live]] = starters[number[starts]] = True
            inner, inner_sizes = self._inner(words.filter(pa.array(used)))
            outer, outer_sizes = self._first(words.filter(pa.array(starters)).to_pylist())
            ids, sizes = np.concatenate([inner, outer]), np.concatenate([inner_sizes, outer_sizes])
            which = np.where(starts, len(inner_sizes) + np.cumsum(starters)[number], np.cumsum(used)[number]) - 1
            which = which[live | starts]
            n = sizes[which]
            upto = np.cumsum(n)
            source = np.repeat((np.cumsum(sizes) - sizes)[which] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)
            body = ids[source]
            cuts = upto[np.cumsum((ends - first)[regular]) - 1].tolist()
            for i, a, b in zip(at[regular].tolist(), [0, *cuts], cuts):
                out[i] = body[a:b]
        return [self.ids(t.as_py()) if found is None else found for found, t in zip(out, texts)]

    def ids_of(self, texts: pa.Array, room: int = 8 << 20) -> Iterator[np.ndarray]:
        """ids() of every text, in order, taken together as far as about `room` bytes of text go."""
        if not self.piecewise or self._core is None:
            yield from (self.ids(t.as_py()) for t in texts)
            return
        part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()) // room
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(1, np.int64)
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            yield from self._together(texts.slice(a, b - a))

    def _part(self, words: list[str], check: bool) -> bytes:
        found = list(map(self._memo.get, words))
        if None in found:
            at = [i for i, ids in enumerate(found) if ids is None]
            missing = list(dict.fromkeys([words[i] for i in at]))
            if check and not regular(missing):
                raise Irregular
            fresh = self._fresh(missing)
            if len(self._memo) < self._room:
                self._memo.update(fresh)
            for i in at:
                found[i] = fresh[words[i]]
        return b"".join(found)

    def ids(self, text: str | None) -> np.ndarray:
        """All ids of a text (None: none), special strings handled as the library does by default."""
        if not text:
            return np.empty(0, self.dtype)
        if not self.piecewise:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)
        out = []
        for part in self.segments(text):
            if part in self.special:
                out.append(np.array([self.special[part]], self.dtype).tobytes())
                continue
            try:
                out.append(self._part(chunks(part), True))
            except Irregular:
                out.append(self._part(chunks_any(part), False))
        return np.frombuffer(b"".join(out), self.dtype)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One Pieces per file and Python worker."""
    return Pieces(path)
