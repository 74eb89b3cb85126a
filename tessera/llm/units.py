"""Cutting texts where byte-level BPE pre-tokens cannot cross, and encoding each different unit once.

The pre-token pattern of byte-level BPE vocabularies attaches one leading blank to a word and
lets only white space share a match with other white space. So between a visible character of
whatever script and a single blank or newline that another visible character follows, a
pre-token always ends. Units between such places are encoded on their own, and equal units give
equal ids, which makes a bounded memo of units exact.

Texts are handled by blocks, as arrays of bytes: places, different units and ids of all texts of
a block are found without a loop over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in a block; a longer text is handled in pieces of that size.
BLOCK = 2 << 20
#: Bytes, estimated, that a memo holds before it is emptied; units longer than ``SHORT`` bytes aren't kept.
MEMO, ENTRY, SHORT = 64 << 20, 64, 64

_VISIBLE = np.arange(256) > 0x20


def visible(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 text whether its character is certainly not white space, in any table of Unicode."""
    out = _VISIBLE[data]
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3) | (data == 0xEF))
    if len(at):
        one, two, three = (data[np.minimum(at + k, len(data) - 1)] for k in range(3))
        # U+0080-00A0, U+1680-16BF, U+1800-183F, U+2000-207F, U+3000, U+FEFF
        space = ((one == 0xC2) & (two < 0xA1)) | ((one == 0xE1) & ((two == 0x9A) | (two == 0xA0))) | ((one == 0xE2) & (two < 0x82)) | ((one == 0xE3) & (two == 0x80) & (three == 0x80)) | ((one == 0xEF) & (two == 0xBB) & (three == 0xBF))
        for k in range(3):
            some = at[space & ((k < 2) | (one != 0xC2))] + k
            out[some[some < len(data)]] = False
    return out


def places(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the units of texts that begin at ``starts`` (the first at 0), and whether each may stand among others.

    Such a unit begins with one blank or newline before a visible character and ends with a
    visible one, so in a row of them each is still a unit.
    """
    seen = visible(data)
    before, after = np.append(False, seen[:-1]), np.append(seen[1:], False)
    starts = starts[starts < len(data)]
    after[starts[starts > 0] - 1] = False
    blank = ((data == 0x20) | (data == 0x0A)) & after
    first = blank & before
    first[starts] = True
    at = np.flatnonzero(first)
    return at, blank[at] & seen[np.append(at[1:], len(data)) - 1]


def cut(text: str) -> list[str]:
    """The units of a text; joined, they are the text."""
    if not text:
        return []
    data = np.frombuffer(text.encode(), np.uint8)
    at = places(data, np.zeros(1, np.int64))[0].tolist()
    return [bytes(data[a:b]).decode() for a, b in zip(at, [*at[1:], len(data)])]


#: Takes units and whether they may be joined; gives the ids of all units in a row, and the number of each unit's ids.
Encode = Callable[[list[bytes], bool], tuple[np.ndarray, np.ndarray]]

#: Keeps the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Spans:
    """Parts of an array of bytes, told apart by their whole contents."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: np.ndarray):
        """``data`` has eight more bytes behind the last part."""
        self.data, self.at, self.length = data, at, length
        self._eight = np.ndarray(len(data) - 8, "<u8", data, strides=(1,))

    def _words(self, some: np.ndarray, k: int) -> np.ndarray:
        return self._eight[self.at[some] + 8 * k] & _FIRST[np.minimum(self.length[some] - 8 * k, 8)]

    def prints(self) -> np.ndarray:
        """A 64-bit number of each part; equal parts have equal ones."""
        out, some, k = self.length.astype(np.uint64), np.flatnonzero(self.length), 0
        while len(some):
            x = (out[some] ^ self._words(some, k)) * np.uint64(0x9E3779B97F4A7C15)
            out[some] = x ^ (x >> np.uint64(29))
            k += 1
            some = some[self.length[some] > 8 * k]
        return out * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(8)

    def same(self, own: np.ndarray, other: Spans, others: np.ndarray) -> np.ndarray:
        """Whether parts ``own`` are those of ``other`` at ``others``, byte by byte."""
        out, k = self.length[own] == other.length[others], 0
        some = np.flatnonzero(out & (self.length[own] > 0))
        while len(some):
            out[some] = self._words(own[some], k) == other._words(others[some], k)
            k += 1
            some = some[out[some] & (self.length[own[some]] > 8 * k)]
        return out


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class UnitMemo:
    """Encodes texts by units, with a memo of ids bounded by ``most`` bytes (``MEMO`` if not given).

    Units, ids and a hash table with linear probing are flat arrays, so that a unit takes some
    ninety bytes and a block is looked up without a loop over its units.
    """

    def __init__(self, encode: Encode, most: int | None = None):
        self._encode, self._most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.size = self._n = self._used = self._filled = 0
        self._flat, self._bytes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint8)
        self._first, self._count, self._at, self._length = (np.zeros(1 << 14, np.int32) for _ in range(4))
        self._prints, self._table = np.zeros(1 << 14, np.uint64), np.full(1 << 15, -1, np.int32)

    @property
    def known(self) -> list[bytes]:
        """The units in the memo."""
        return [self._bytes[a : a + n].tobytes() for a, n in zip(self._at[: self._n], self._length[: self._n])]

    def _add(self, units: list[bytes], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """First places and numbers of the ids of new units, which come behind all others."""
        ids, count = self._encode(units, joined)
        first = self._used + np.cumsum(count) - count
        self._flat = _grown(self._flat, self._used + len(ids))
        self._flat[self._used : self._used + len(ids)] = ids
        self._used += len(ids)
        return first, count

    def _slots(self, prints: np.ndarray) -> np.ndarray:
        return (prints & np.uint64(len(self._table) - 1)).astype(np.int64)

    def _found(self, prints: np.ndarray) -> np.ndarray:
        """Numbers of the memo's units with these prints, or -1."""
        out, some, slot = np.full(len(prints), -1, np.int32), np.arange(len(prints)), self._slots(prints)
        while len(some):
            held = self._table[slot]
            hit = (held >= 0) & (self._prints[held] == prints[some])
            out[some[hit]] = held[hit]
            next_ = (held >= 0) & ~hit
            some, slot = some[next_], (slot[next_] + 1) & (len(self._table) - 1)
        return out

    def _keep(self, units: list[bytes], prints: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Numbers of new units, whose prints differ from one another and from the memo's."""
        own, length = np.frombuffer(b"".join(units), np.uint8), np.fromiter(map(len, units), np.int32, len(units))
        a, b = self._n, self._n + len(units)
        self._bytes = _grown(self._bytes, self._filled + len(own) + 8)
        self._bytes[self._filled : self._filled + len(own)] = own
        for name, new in (("_first", first), ("_count", count), ("_at", self._filled + np.cumsum(length) - length), ("_length", length), ("_prints", prints)):
            setattr(self, name, _grown(getattr(self, name), b))
            getattr(self, name)[a:b] = new
        self._n, self._filled = b, self._filled + len(own)
        self.size += ENTRY * len(units) + len(own) + 4 * int(count.sum())
        numbers = fresh = np.arange(a, b, dtype=np.int32)
        if 2 * b > len(self._table):
            self._table, numbers = np.full(1 << (4 * b - 1).bit_length(), -1, np.int32), np.arange(b, dtype=np.int32)
        slot = self._slots(self._prints[numbers])
        while len(numbers):
            free = self._table[slot] < 0
            self._table[slot[free]] = numbers[free]
            left = self._table[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & (len(self._table) - 1)
        return fresh

    def block(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that begin at ``starts`` in ``data``, in a row, and where each text's end."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        if self.size > (MEMO if self._most is None else self._most):
            self._clear()
        at, joined = places(data, starts)
        length = np.diff(at, append=len(data))
        spans = Spans(np.append(data, np.zeros(8, np.uint8)), at, length)
        short = length <= SHORT
        prints = np.zeros(len(at), np.uint64)
        place = np.full(len(at), -1, np.int32)
        some = np.flatnonzero(short)
        prints[some] = Spans(spans.data, at[some], length[some]).prints()
        place[some] = self._found(prints[some])
        new = some[place[some] < 0]
        hit = some[place[some] >= 0]
        apart = hit[~spans.same(hit, Spans(self._bytes, self._at, self._length), place[hit])]  # of other bytes, with the print of a unit
        raw = data.tobytes() if len(new) or len(apart) or not short.all() else b""
        if len(new):
            _, one, of = np.unique(prints[new], return_index=True, return_inverse=True)
            one = new[one]
            number = np.empty(len(one), np.int32)
            for flag in (True, False):
                own = np.flatnonzero(joined[one] == flag)
                if len(own):
                    units = [raw[a : a + n] for a, n in zip(at[one[own]].tolist(), length[one[own]].tolist())]
                    number[own] = self._keep(units, prints[one[own]], *self._add(units, flag))
            place[new] = number[of]
            apart = np.append(apart, new[~spans.same(new, spans, one[of])])
        first, count = self._first[place].astype(np.int64), self._count[place].astype(np.int64)
        used, rest = self._used, np.append(apart, np.flatnonzero(~short))
        for flag in (True, False):
            own = rest[joined[rest] == flag]
            if len(own):
                seen: dict[bytes, int] = {}
                of = [seen.setdefault(raw[a : a + n], len(seen)) for a, n in zip(at[own].tolist(), length[own].tolist())]
                a, n = self._add([*seen], flag)
                first[own], count[own] = a[of], n[of]
        ends = np.cumsum(count)
        ids = self._flat[np.repeat(first - ends + count, count) + np.arange(ends[-1])]
        self._used = used  # units that aren't kept go again
        return ids, np.append(0, ends)[np.searchsorted(at, np.append(starts[1:], len(data)))]

    def streams(self, texts: pa.Array) -> Iterator[Iterator[np.ndarray]]:
        """For each text (null: empty) its ids, in one part or, for a long text, in several; to be read in order."""
        texts = texts.cast(pa.string()).fill_null("")
        if not len(texts):
            return
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
            own = data[offsets[row] : offsets[end]]
            if len(own) > BLOCK:
                yield self._pieces(own)
            else:
                ids, ends = self.block(own, offsets[row:end] - offsets[row])
                at = 0
                for e in ends.tolist():
                    yield iter((ids[at:e],))
                    at = e
            row = end

    def _pieces(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of one long text; a unit longer than a block is one piece."""
        at, size, zero = 0, BLOCK, np.zeros(1, np.int64)
        while len(data) - at > size:
            found = places(data[at : at + size], zero)[0]
            found = found[found < size - 4]  # the window may end inside a character
            if len(found) < 2:
                size *= 2
                continue
            yield self.block(data[at : at + found[-1]], zero)[0]
            at, size = at + int(found[-1]), BLOCK
        yield self.block(data[at:], zero)[0]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.concatenate([*parts]).tolist() for parts in self.streams(pa.array(texts, pa.string()))]
