"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

A sequence of tokens is the encoding of its bytes exactly if each two neighbours are the
encoding of theirs. So the last token of each prefix follows from those of shorter prefixes: it
is the longest token that ends there and may follow the last token of what stands before it.
The encoder keeps that for the bytes since its last output and walks back to emit tokens.

How far a token can depend on bytes to its right follows from the merge list. A merge (x, y)
is kept from happening only by an earlier merge (z, w) that takes away z, a right end of y,
which itself may be prevented by a still earlier one. ``lookahead`` is the longest such chain
in bytes. Tokens that end so far before the last byte seen are final and leave the window.

Pre-tokens of up to ``STEPPED`` bytes fit a window: the same machine runs over many of them in
step, a byte of each at a time, as matrices. Longer ones go through :class:`Encoder`.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches
from tessera.llm.units import UnitMemo

#: Bytes gathered beyond the lookahead before stable tokens are emitted.
STEP = 512
#: Bytes of the longest pre-token that is encoded in step with others, and how matrices are widened.
STEPPED = 64
#: Characters that are fed to an encoder at once, and units that are parted into pre-tokens at once.
PIECE, TOGETHER = 1 << 16, 4096
WIDTHS = (4, 8, 12, 16, 24, 32, 48, STEPPED)
_PAIRS = 1_000_000
#: Pairs of tokens remembered by :class:`Stepped`, by hash; a new pair takes the place of an old one.
_SLOTS = 1 << 20
_P, _K = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, bytes and merges of a byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = functools.cache(lambda s: bytes(alphabet[c] for c in s))
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in vocab.items()}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.table = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = [(raw(a), raw(b)) for a, b in merges]
        self.rank = {m: k for k, m in reversed(list(enumerate(self.merges)))}
        self.longest = max(map(len, self.ids))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.split = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.made: dict[bytes, tuple[bytes, bytes]] = {}
        for a, b in self.merges:
            self.made.setdefault(a + b, (a, b))
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        tails: dict[bytes, set[int]] = {}
        for token in self.ids:
            tails.setdefault(token[-3:], set()).add(len(token))
        #: Lengths of the tokens that end in given three bytes, longest first.
        self.tails = {t: (*sorted(n | {1, 2}, reverse=True),) for t, n in tails.items() if len(t) == 3}
        self.lookahead = sufficient_lookahead(self.merges)

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether b may stand after a, or first where a is empty, in an encoding.

        At the border of two tokens stand, one after the other, the right ends of a and the left
        ends of b, each from its own merge until the next one takes it. A merge of two of them
        that comes while both stand would have crossed the border; among equal merges the
        leftmost comes first.
        """
        if not a:
            return True
        if (known := self._pairs.get((a, b))) is None:
            if len(self._pairs) > _PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self._apart(a, b)
        return known

    def _apart(self, a: bytes, b: bytes) -> bool:
        rank, right = self.rank, self._ends(b, 0)
        for x, x_from, x_to in self._ends(a, 1):
            for y, y_from, y_to in right:
                r = rank.get((x, y))
                if r is not None and x_from < r < x_to and y_from < r <= y_to:
                    return False
        return True

    def _ends(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The symbols at one side of a token: bytes, own merge's rank, rank of the merge that takes it."""
        memo = self._spines[side]
        if (found := memo.get(token)) is None:
            found, taken, at = [], 1 << 60, token
            while True:
                parts = self.made.get(at)
                own = self.rank[parts] if parts else -1
                found.append((at, own, taken))
                if not parts:
                    break
                at, taken = parts[side], own
            memo[token] = found
        return found


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the right of a token on which the merge list can let it depend, at most."""
    made = {}
    for a, b in merges:
        made.setdefault(a + b, (a, b))
    reach: dict[bytes, int] = {}  # of merges so far, by left part: bytes needed beyond it
    most = 0
    for a, b in merges:
        need, z = 0, b
        while True:  # the right ends of b, b included
            need = max(need, reach.get(z, 0))
            if z not in made:
                break
            z = made[z][1]
        reach[a] = max(reach.get(a, 0), len(b) + need)
        most = max(most, reach[a])
    return most


class Encoder:
    """Encodes the bytes of one pre-token given in pieces; memory depends on the merge list only."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.keep = vocabulary, vocabulary.lookahead + vocabulary.longest
        self.bytes, self.last = b"", [b""]

    def feed(self, data: bytes) -> list[bytes]:
        """Tokens that are final with these bytes."""
        out = []
        for i in range(0, len(data), STEP):
            self._extend(data[i : i + STEP])
            if len(self.bytes) >= self.keep + STEP:
                out += self._emit(len(self.bytes) - self.keep)
        return out

    def close(self) -> list[bytes]:
        out = self._emit(len(self.bytes))
        self.bytes, self.last = b"", [b""]
        return out

    def _extend(self, data: bytes) -> None:
        v, at, known = self.v, len(self.bytes), self.v._pairs
        self.bytes = text = self.bytes + data
        ids, last, tails, short = v.ids, self.last, v.tails, (2, 1)
        for end in range(at + 1, len(text) + 1):
            for n in tails.get(text[end - 3 : end], short) if end > 2 else range(end, 0, -1):
                if n <= end and (token := text[end - n : end]) in ids:
                    before = last[end - n]
                    if before is None:
                        continue
                    if not before:
                        break
                    ok = known.get((before, token))
                    if v.follows(before, token) if ok is None else ok:
                        break
            else:
                token = None
            last.append(token)

    def _emit(self, upto: int) -> list[bytes]:
        """Tokens on the way to the last byte that end at ``upto`` at most; they leave the window."""
        ends, at = [], len(self.bytes)
        while at > 0:
            ends.append(at)
            at -= len(self.last[at])
        done = [e for e in reversed(ends) if e <= upto]
        if not done:
            return []
        out = [self.last[e] for e in done]
        self.bytes, self.last = self.bytes[done[-1] :], self.last[done[-1] :]
        return out


class Stepped:
    """The transducer over many short pre-tokens in step."""

    def __init__(self, vocabulary: Vocabulary):
        v, self.n = vocabulary, len(vocabulary.table)
        tokens = sorted(v.ids.items(), key=lambda t: t[1])
        self.length = np.zeros(self.n, np.int64)
        by_length: dict[int, list[tuple[bytes, int]]] = {}
        for token, i in tokens:
            self.length[i] = len(token)
            by_length.setdefault(len(token), []).append((token, i))
        self.tables = {}
        for n, some in by_length.items():
            if n <= STEPPED:
                keys = np.zeros(len(some), np.uint64)
                for c in np.array([list(t) for t, _ in some], np.uint64).T:
                    keys = keys * _P + c + np.uint64(1)
                order = np.argsort(keys)
                self.tables[n] = keys[order], np.array([i for _, i in some], np.int32)[order]
        merges = sorted((v.ids[a] * self.n + v.ids[b], r) for (a, b), r in v.rank.items())
        self.merge_keys, self.merge_ranks = (np.array(x, np.int64) for x in zip(*merges))
        self.ends = []  # of each side: first place, number, and there symbol, own rank, rank of the merge that takes it
        for side in (1, 0):
            found = [(i, [(v.ids[s], own, taken) for s, own, taken in v._ends(t, side)]) for t, i in tokens]
            count = np.zeros(self.n, np.int64)
            count[[i for i, _ in found]] = [len(f) for _, f in found]
            first = np.cumsum(count) - count
            self.ends.append((first, count, *(np.array(x, np.int64) for x in zip(*chain.from_iterable(f for _, f in found)))))
        for memo in v._spines:  # they are in arrays now; few are needed again
            memo.clear()
        self.keys, self.known = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, bool)

    def follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`Vocabulary.follows` of pairs of ids."""
        pair = a.astype(np.int64) * self.n + b
        slot = ((pair.view(np.uint64) * _K) >> np.uint64(64 - _SLOTS.bit_length() + 1)).astype(np.int64)
        out, new = self.known[slot], np.flatnonzero(self.keys[slot] != pair)
        if len(new):
            some, back = np.unique(pair[new], return_inverse=True)
            ok = self._apart(some // self.n, some % self.n)
            out[new] = ok[back]
            self.keys[slot[new]], self.known[slot[new]] = pair[new], out[new]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (first_a, count_a, *right), (first_b, count_b, *left) = self.ends
        many = count_a[a] * count_b[b]
        of = np.repeat(np.arange(len(a)), many)
        k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        i, j = first_a[a][of] + k // count_b[b][of], first_b[b][of] + k % count_b[b][of]
        (x, x_from, x_to), (y, y_from, y_to) = (z[i] for z in right), (z[j] for z in left)
        pair = x * self.n + y
        at = np.minimum(np.searchsorted(self.merge_keys, pair), len(self.merge_keys) - 1)
        r = np.where(self.merge_keys[at] == pair, self.merge_ranks[at], -1)
        crossed = (x_from < r) & (r < x_to) & (y_from < r) & (r <= y_to)
        return np.bincount(of[crossed], minlength=len(a)) == 0

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words of 1 to ``STEPPED`` bytes: all in some row, where each word's begin, and their numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order, least, used, flat = np.argsort(-sizes, kind="stable"), 0, 0, [np.zeros(0, np.uint32)]
        first, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for width in WIDTHS:
            some = order[(sizes[order] > least) & (sizes[order] <= width)]
            least, step = width, max(1, 1_500_000 // ((width + 1) * width))
            for i in range(0, len(some), step):
                rows = some[i : i + step]
                ids, n = self._in_step([words[r] for r in rows], sizes[rows], width)
                first[rows], count[rows] = used + np.cumsum(n) - n, n
                used += len(ids)
                flat.append(ids)
        return np.concatenate(flat), first, count

    def _in_step(self, words: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words``, which come from the longest to the shortest, and their numbers."""
        count = len(words)
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(count, width)
        own = text.T.astype(np.uint64) + np.uint64(1)
        ending = np.full((width + 1, count, width), -1, np.int32)  # by end, word and width - length: the token
        h = np.zeros_like(own)
        for n in range(1, width + 1):
            h = h[: width - n + 1] * _P + own[n - 1 :]
            if n in self.tables:
                keys, ids = self.tables[n]
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                ending[n:, :, width - n] = np.where(keys[at] == h, ids[at], -1)
        last = np.full((width + 1, count), -1, np.int32)
        for end in range(1, width + 1):
            alive = int(np.searchsorted(-sizes, -end, side="right"))
            rows, place = np.nonzero(ending[end, :alive] >= 0)  # the longest token of a row first
            token, n = ending[end, rows, place], width - place
            before = last[end - n, rows]
            ok = n == end
            test = np.flatnonzero(~ok & (before >= 0))
            ok[test] = self.follow(before[test], token[test])
            rows, token = rows[ok], token[ok]
            first = np.ones(len(rows), bool)
            first[1:] = rows[1:] != rows[:-1]
            last[end, rows[first]] = token[first]
        at, back = sizes.copy(), []
        while at.any():
            token = np.where(at > 0, last[at, np.arange(count)], -1)
            at -= np.where(at > 0, self.length[token], 0)
            back.append(token)
        ids = np.stack(back[::-1], axis=1)
        return ids[ids >= 0].astype(np.uint32), (ids >= 0).sum(axis=1)


@functools.lru_cache(1)
def transducer(path: str) -> Transducer:
    """One a Python worker, with its memo."""
    return Transducer(path)


class Transducer:
    """Text to ids and back, as the tokenizers library gives them without added special tokens.

    A special token's string in a text becomes its id, as there. Units between safe cutting
    places go through a bounded memo; a long text is handled in pieces.
    """

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self._stepped, self.memo = Stepped(self.v), UnitMemo(self._units)

    def _units(self, units: list[bytes], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units and their numbers. Different pre-tokens of all units are encoded once."""
        texts, parts, many = [u.decode() for u in units], [], []
        for i in range(0, len(texts), TOGETHER) if joined else ():
            some = texts[i : i + TOGETHER]
            whole = "".join(some)
            if len(whole) > 64 * TOGETHER or any(s in whole for s in self.v.special):
                own = [self._parts(x) for x in some]
                parts += chain.from_iterable(own)
                many += map(len, own)
                continue
            found = self.v.pattern.findall(whole)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            of = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))) + 1
            parts += found
            many += np.diff(of, prepend=0).tolist()
        for x in () if joined else texts:
            own = self._parts(x)
            parts += own
            many.append(len(own))
        at: dict[str | int, int] = {}
        of = np.fromiter((at.setdefault(p, len(at)) for p in parts), np.int64, len(parts))
        words = [p if isinstance(p, int) else p.encode() for p in at]
        short = [i for i, w in enumerate(words) if not isinstance(w, int) and len(w) <= STEPPED]
        flat, first, count = np.zeros(0, np.uint32), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if short:
            flat, first[short], count[short] = self._stepped.encode([words[i] for i in short])
        used, flat = len(flat), [flat]
        for i in {*range(len(words))}.difference(short):
            ids = np.array([words[i]] if isinstance(words[i], int) else self._streamed(words[i]), np.uint32)
            first[i], count[i] = used, len(ids)
            used += len(ids)
            flat.append(ids)
        first, count = first[of], count[of]
        ends = np.cumsum(count)
        ids = np.concatenate(flat)[np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(np.append(0, ends)[np.cumsum(many)], prepend=0)

    def _parts(self, text: str) -> list[str | int]:
        """Pre-tokens of a text, and the ids of special tokens in it."""
        v = self.v
        if not any(s in text for s in v.special):
            return v.pattern.findall(text)
        return [*chain.from_iterable([v.special[t]] if t in v.special else v.pattern.findall(t) for t in v.split.split(text) if t)]

    def _streamed(self, word: bytes) -> list[int]:
        encoder, ids, out = Encoder(self.v), self.v.ids, []
        for i in range(0, len(word), PIECE):
            out += map(ids.__getitem__, encoder.feed(word[i : i + PIECE]))
        return [*out, *map(ids.__getitem__, encoder.close())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.memo.encode(texts)

    def decode(self, ids: list[int]) -> str:
        return "".join(self.text([ids]))

    def text(self, parts: Iterable[list[int]]) -> Iterator[str]:
        """Bytes of the ids through a UTF-8 machine that keeps unfinished characters between parts."""
        machine, table = codecs.getincrementaldecoder("utf-8")("replace"), self.v.table
        for ids in parts:
            yield machine.decode(b"".join(map(table.__getitem__, ids)))
        yield machine.decode(b"", True)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded by :class:`Transducer`.

    A null text counts as empty, which has no tokens and decodes to an empty text. Rows with
    null or equal doc_id stay rows of their own; other columns are ignored. Of a long text only
    a piece is held as ids.
    """

    def run(t: Transducer, batch: pa.RecordBatch) -> pa.RecordBatch:
        names, count, ids_sha, text_sha = [*map(str, range(len(t.v.table)))], [], [], []

        def told(parts: Iterable[list[int]]) -> None:
            n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

            def passed() -> Iterator[list[int]]:
                nonlocal n
                for ids in parts:
                    of_ids.update(("," * bool(n and ids) + ",".join(map(names.__getitem__, ids))).encode())
                    n += len(ids)
                    yield ids

            for text in t.text(passed()):
                of_text.update(text.encode())
            count.append(n), ids_sha.append(of_ids.hexdigest()), text_sha.append(of_text.hexdigest())

        for parts in t.memo.streams(batch.column("text")):
            told(ids.tolist() for ids in parts)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: transducer(path))
