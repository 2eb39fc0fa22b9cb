"""Token ids of whole texts with a public byte-level BPE.

The vocabulary's pre-tokeniser splits a text into runs of letters, digits, signs and white
space; merges never cross them. ``CUT`` names places that are such a border whatever stands
further away, by the kinds of three code points. Texts are cut there, many at a time as
arrays of code points; equal pieces are found by two 64-bit hashes, within a block and among
the pieces that the tokenizers library gave ids for before, up to a fixed number, which are
held as arrays by both hashes. Only pieces that are new become texts of their own. Code points
of no listed kind are never cut from their neighbours. A text with a literal of an added
token goes through the library whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

DEFAULT = "byte_bpe_50k.json"
EDGE, LETTER, DIGIT, SIGN, QUOTE, SPACE, WHITE, OTHER = range(8)
#: code points that are letters in every version of Unicode: Latin, Greek, Cyrillic, kana, Han, Hangul
LETTERS = [
    (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x3B1, 0x3C9), (0x410, 0x44F),
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]
#: signs that are neither letters, digits nor white space
SIGNS = [
    (0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E), (0xA1, 0xA9), (0xAB, 0xAB), (0xBF, 0xBF),
    (0x2010, 0x2027), (0x3001, 0x3003), (0x300C, 0x300F), (0xFF01, 0xFF01), (0xFF0C, 0xFF0C), (0xFF1A, 0xFF1B), (0xFF1F, 0xFF1F),
]
BLOCK = 1 << 18  # code points that are hashed at a time
LONGEST = 64  # code points of a remembered piece
REMEMBERED = 1 << 19  # pieces that a worker looks up at most, 20 bytes each
NUMBERED = 4  # times as many pieces, with those driven out, have their ids kept before all are let go
_MULS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]


def vocabulary(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _kinds() -> np.ndarray:
    kind = np.full(1 << 16, OTHER, np.uint8)
    for these, k in ((LETTERS, LETTER), (SIGNS, SIGN), ([(0x30, 0x39)], DIGIT), ([(0x09, 0x0D)], WHITE)):
        for a, b in these:
            kind[a : b + 1] = k
    kind[0x20], kind[0x27] = SPACE, QUOTE
    return kind


def _cuts() -> np.ndarray:
    """Whether a piece begins at the second of three kinds.

    White space begins a piece after anything that is none. The last of several white code
    points before something else is apart; a space stays with what follows, others do not.
    Runs of one kind end where the next begins, but letters may belong to a quote before them.
    """
    cut = np.zeros((8, 8, 8), bool)
    cut[EDGE], cut[:, EDGE] = True, True
    solid = (LETTER, DIGIT, SIGN, QUOTE)
    for a in solid:
        cut[a, [SPACE, WHITE]] = True
        for b in solid:
            cut[a, b] = (a, b) not in {(LETTER, LETTER), (DIGIT, DIGIT), (SIGN, SIGN), (QUOTE, QUOTE), (SIGN, QUOTE), (QUOTE, SIGN), (QUOTE, LETTER)}
        for p in (SPACE, WHITE, OTHER):
            cut[p, [SPACE, WHITE], a] = True
        cut[WHITE, a] = True
    return cut.reshape(-1)


KIND, CUT = _kinds(), _cuts()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the k-th multiplier and of its inverse."""
    if k not in _POWERS or len(_POWERS[k][0]) < n:
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(pow(int(_MULS[k]), e, 1 << 64)))]) for e in (1, -1))
        if n > BLOCK + LONGEST:
            return up, down
        _POWERS[k] = up, down
    return _POWERS[k]


def _hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    up, down = _powers(k, max(len(points), BLOCK))
    with np.errstate(over="ignore"):
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint32(1)) * up[: len(points)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        return h ^ (h >> np.uint64(32))


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """An array of ``n`` places at least, with what ``a`` has."""
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tok = Tokenizer.from_file(path)
        #: literals that the library turns into ids of their own, wherever they stand
        self.added = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.size = self.tok.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        pieces = self.tok.get_vocab()
        self.spaced = np.zeros(max(pieces.values()) + 1, bool)
        self.spaced[[i for p, i in pieces.items() if p[0] == "\u0120"]] = True  # the byte-level sign of a space
        self.most = remembered
        self._forget()

    def _forget(self) -> None:
        places = 1 << max(1, self.most.bit_length() - 1)
        self.shift = np.uint64(64 - places.bit_length() + 1)
        self.hashes = np.zeros((2, places), np.uint64)
        self.number = np.full(places, -1, np.int32)  # of the piece in a place; a pair of places belongs to a hash
        self.many = 0  # pieces with a number
        self.end = np.zeros(1 << 10, np.int64)  # where the ids of each piece end, after a first 0
        self.flat = np.zeros(1 << 10, self.kind)

    @property
    def known(self) -> np.ndarray:
        """The numbers of the pieces that can be looked up."""
        return self.number[self.number >= 0]

    def _pair(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * _MULS[0] >> self.shift).astype(np.int64) & ~1

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for new ones."""
        number = np.full(len(h), -1, np.int64)
        for at in (pair := self._pair(h), pair + 1):
            hit = np.flatnonzero((self.hashes[0, at] == h) & (self.hashes[1, at] == check))
            number[hit] = self.number[at[hit]]
        return number

    def _keep(self, h: np.ndarray, check: np.ndarray, number: np.ndarray) -> None:
        """Each piece goes to the first place of its pair, or to the second, from where it drives out another."""
        at = self._pair(h)
        at += self.number[at] >= 0
        self.hashes[0, at], self.hashes[1, at], self.number[at] = h, check, number

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _led(self, pieces: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Ids of pieces that begin with their only space and end with no white space, and how many each has.

        They are encoded a thousand in one text. A token begins with a space only where a piece begins.
        """
        ids = [np.array(x, self.kind) for x in self._plain(["".join(pieces[i : i + 1000]) for i in range(0, len(pieces), 1000)])]
        many = [np.diff(np.r_[np.flatnonzero(self.spaced[x]), len(x)]) for x in ids]
        if sum(map(len, many)) != len(pieces):
            raise ValueError("a piece's first token does not begin with a space")
        return np.concatenate(many), ids

    def _numbers(self, text: str, start: np.ndarray, end: np.ndarray, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each of some distinct pieces of ``text``; ids of new ones are added."""
        if self.many > NUMBERED * self.most:
            self._forget()
        number = self._find(h, check)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = [text[i:j] for i, j in zip(start[new].tolist(), end[new].tolist())]
            led = np.array([p[0] == " " and not p[1:2].isspace() and not p[-1].isspace() and " " not in p[1:] for p in fresh])
            order = np.r_[np.flatnonzero(led), np.flatnonzero(~led)]
            new, fresh, cut = new[order], [fresh[i] for i in order.tolist()], int(led.sum())
            many, ids = self._led(fresh[:cut]) if cut else ([], [])
            rest = self._plain(fresh[cut:])
            number[new] = self.many + np.arange(len(new))
            short = new[end[new] - start[new] <= LONGEST]
            self._keep(h[short], check[short], number[short])
            first, last = self.many, self.many + len(new)
            self.end = _room(self.end, last + 1)
            self.end[first + 1 : last + 1] = self.end[first] + np.cumsum(np.r_[many, [len(x) for x in rest]].astype(np.int64))
            self.flat = _room(self.flat, int(self.end[last]))
            self.flat[self.end[first] : self.end[last]] = np.concatenate([*ids, np.array([i for x in rest for i in x], self.kind)])
            self.many = last
        return number

    def _block(self, text: str, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive pieces, and how many each has."""
        base = int(start[0])
        points, a, b = points[base : end[-1]], start - base, end - base
        h, check = _hashes(points, a, b, 0), _hashes(points, a, b, 1)
        code, of = pd.factorize(h)
        first = np.empty(len(of), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        if not (check == check[first][code]).all():  # two pieces share a hash: take each by itself
            code, first = np.arange(len(start)), np.arange(len(start))
        number = self._numbers(text, start[first], end[first], h[first], check[first])[code]
        at = self.end[number]
        n = self.end[number + 1] - at
        before = np.cumsum(n) - n
        return self.flat[np.repeat(at - before, n) + np.arange(int(n.sum()))], n

    def ids(self, texts: list[str | None], end: int | None = 0) -> list[np.ndarray]:
        """Ids of each text (null: empty), then ``end``, as little-endian integers of ``self.kind``."""
        whole = {i for i, t in enumerate(texts) if t and any(a in t for a in self.added)}
        cut = ["" if i in whole else t or "" for i, t in enumerate(texts)]
        size = np.array([len(t) for t in cut], np.int64) + 1
        stop = np.cumsum(size) - 1  # the mark after each text
        text = "\0".join([*cut, ""])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = np.full(len(points) + 2, EDGE, np.uint8)
        kind[1:-1] = KIND[np.minimum(points, 0xFFFF)]
        kind[stop + 1] = EDGE
        three = kind[:-2].astype(np.uint16) << 6
        three |= kind[1:-1] << np.uint8(3)
        three |= kind[2:]
        begin = np.flatnonzero(CUT[three])
        finish = np.append(begin[1:], len(points))
        real = kind[begin + 1] != EDGE
        begin, finish = begin[real], finish[real]
        got, many = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        at = np.unique(np.r_[np.searchsorted(begin, np.arange(0, len(points), BLOCK)), len(begin)])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            x, n = self._block(text, points, begin[a:b], finish[a:b])
            got.append(x), many.append(n)
        flat = np.concatenate(got)
        place = np.r_[0, np.cumsum(np.concatenate(many))][np.searchsorted(begin, np.r_[0, stop])].tolist()
        other = dict(zip(sorted(whole), self._plain([texts[i] for i in sorted(whole)])))
        last = np.array([] if end is None else [end], self.kind)
        parts = (np.array(other[i], self.kind) if i in whole else flat[place[i] : place[i + 1]] for i in range(len(texts)))
        return [np.concatenate([x, last]) for x in parts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: list[str | None], most: int = BLOCK):
    """Ranges of rows with about ``most`` characters."""
    a = n = 0
    for b, t in enumerate(texts, 1):
        n += len(t or "")
        if n >= most or b == len(texts):
            yield a, b
            a, n = b, 0


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
