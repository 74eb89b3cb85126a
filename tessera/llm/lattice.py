"""Language-model scores by subword lattices.

The pieces of an existing vocabulary weight all segmentations of a word: its probability is the
sum, over all ways to cut it into pieces, of the products of their probabilities, by the forward
recursion in log space. A text is its words, each behind a word mark, and one end. A piece has
two probabilities, one where it ends its word and one where it doesn't; those of pieces with
the word mark and the end sum to 1, and so do those of the others, so all texts together have
probability 1. The vocabulary's scores give each piece its prior mass, and the corpus adds the
expected uses of the piece, by expectation maximization over the table of distinct words; the
vocabulary is never changed.

Words of one length are handled together, as matrices: substrings are found in the vocabulary by
a rolling hash, and the recursion runs over positions. A very long word is handled alone, in
segments, so that memory holds a number or two for each of its bytes.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches
from tessera.session import materialize, ship

MARK = "▁".encode()
#: Rounds of expectation maximization over all distinct training words.
ROUNDS = 4
#: Prior count, mean over the pieces, which the vocabulary's scores deal out.
PRIOR = 1.0
#: Bytes of the longest word that is handled with others, and of a segment of a longer one.
LONG, SEGMENT = 1 << 12, 1 << 14
#: Words scored in the map over documents; others go through a join. It bounds the broadcast.
FREQUENT = 1 << 17
#: Distinct words that a task gathers before it passes its counts on.
GATHER = 400_000
_P, _K = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(1)
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece model as bytes, and log weights from their scores.

    The model's scores are negative ranks; a piece weighs the inverse of its rank. Each single
    byte is a piece, so each word has a segmentation. Pieces with a word mark inside and control
    pieces are left out.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    best: dict[bytes, float] = {bytes([b]): float(sp.get_piece_size()) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i).encode()
        if MARK not in piece[1:]:
            best[piece] = min(best.get(piece, 1e9), 10.0 - sp.get_score(i))
    pieces = sorted(best)
    return pieces, -np.log(np.array([best[p] for p in pieces]))


class Lattice:
    """Forward and backward recursion over words.

    ``logp`` has the natural log probabilities of the pieces, first those inside a word, then
    those at its end.
    """

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.tables, n_pieces = {}, len(pieces)
        self.inside, self.ending = np.asarray(logp, float).reshape(2, n_pieces)
        for n in sorted({len(p) for p in pieces}):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == n])
            keys = np.zeros(len(ids), np.uint64)
            for c in np.array([list(pieces[i]) for i in ids], np.uint64).T:
                keys = keys * _P + c + np.uint64(1)
            order, seen = np.argsort(keys), np.zeros(1 << 16, bool)
            seen[(keys * _K) >> np.uint64(48)] = True  # few other substrings share a place with a piece
            self.tables[n] = (keys[order], ids[order], seen)
        self.longest, self.first = max(self.tables), np.array([p.startswith(MARK) for p in pieces])

    def edges(self, words: np.ndarray, opens: bool = True, closes: bool = True) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, piece of each start and word or -1, its log probability) for a matrix with a word's bytes in a row.

        ``opens`` and ``closes`` say whether the bytes begin and end the words.
        """
        n, out = words.shape[1], []
        own = words.T.astype(np.uint64) + np.uint64(1)
        h = np.zeros_like(own)
        for size in range(1, min(n, self.longest) + 1):
            h = h[: n - size + 1] * _P + own[size - 1 :]
            if size in self.tables:
                keys, ids, seen = self.tables[size]
                flat = h.ravel()
                some = np.flatnonzero(seen[(flat * _K) >> np.uint64(48)])
                at = np.searchsorted(keys, flat[some])
                at[at == len(keys)] = 0
                found = np.full(len(flat), -1)
                found[some] = np.where(keys[at] == flat[some], ids[at], -1)
                found = found.reshape(h.shape)
                if opens:
                    found[0][~self.first[found[0]]] = -1
                rest = found[int(opens) :]
                rest[self.first[rest]] = -1
                if (found >= 0).any():
                    weight = self.inside[found]
                    if closes:
                        weight[-1] = self.ending[found[-1]]
                    weight[found < 0] = -np.inf
                    out.append((size, found, weight))
        return out

    def segments(self, word: bytes, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, lengths, pieces, log probabilities) of the pieces found in a long word, by segments of starts, in order or ``back``."""
        data, n = np.frombuffer(MARK + word, np.uint8)[None], len(MARK) + len(word)
        for i in reversed(range(0, n, SEGMENT)) if back else range(0, n, SEGMENT):
            end = min(n, i + SEGMENT + self.longest)
            parts = []
            for size, found, weight in self.edges(data[:, i:end], i == 0, end == n):
                at = np.flatnonzero(found[:SEGMENT, 0] >= 0)
                parts.append((at + i, np.full(len(at), size), found[at, 0], weight[at, 0]))
            starts, sizes, pieces, weights = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(starts, kind="stable")
            yield starts[order], sizes[order], pieces[order], weights[order]

    def long(self, word: bytes, count: float | None = None, uses: np.ndarray | None = None) -> float:
        """Natural log probability of one word; with ``count``, its expected uses of pieces are added to ``uses``."""
        n = len(MARK) + len(word)
        alpha = [0.0] + [-np.inf] * n
        for starts, sizes, _, weights in self.segments(word):
            for s, k, w in zip(starts.tolist(), sizes.tolist(), weights.tolist()):
                alpha[s + k] = _logadd(alpha[s + k], alpha[s] + w)
        if count is not None:
            beta = [-np.inf] * n + [0.0]
            for starts, sizes, pieces, weights in self.segments(word, True):
                for s, k, w in zip(starts[::-1].tolist(), sizes[::-1].tolist(), weights[::-1].tolist()):
                    beta[s] = _logadd(beta[s], beta[s + k] + w)
                p = np.exp([alpha[s] + w + beta[s + k] - alpha[n] for s, k, w in zip(starts.tolist(), sizes.tolist(), weights.tolist())]) * count
                last = starts + sizes == n
                for k, some in enumerate((~last, last)):
                    uses[k] += np.bincount(pieces[some], p[some], uses.shape[1])
        return alpha[n]

    def forward(self, edges: list, count: int, n: int) -> np.ndarray:
        """Log probability of each prefix: a row a position, a column a word."""
        alpha = np.full((n + 1, count), -np.inf)
        alpha[0] = 0.0
        for j in range(1, n + 1):
            alpha[j] = _logsum([alpha[j - size] + w[j - size] for size, _, w in edges if size <= j], count)
        return alpha

    def backward(self, edges: list, count: int, n: int) -> np.ndarray:
        """Log probability of each rest."""
        beta = np.full((n + 1, count), -np.inf)
        beta[n] = 0.0
        for j in range(n - 1, -1, -1):
            beta[j] = _logsum([beta[j + size] + w[j] for size, _, w in edges if j + size <= n], count)
        return beta

    def score(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """Natural log probability of each word behind its mark."""
        out = np.zeros(len(words))
        for rows, matrix in by_length(words):
            if isinstance(matrix, bytes):
                out[rows] = self.long(matrix)
            else:
                out[rows] = self.forward(self.edges(matrix), len(rows), matrix.shape[1])[-1]
        return out

    def expected(self, words: pa.Array, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, as in ``logp``, when each word stands as often as its count says."""
        out = np.zeros((2, len(self.inside)))
        for rows, matrix in by_length(words):
            if isinstance(matrix, bytes):
                self.long(matrix, float(counts[rows][0]), out)
                continue
            edges, (count, n) = self.edges(matrix), matrix.shape
            alpha, beta = self.forward(edges, count, n), self.backward(edges, count, n)
            for size, e, w in edges:
                at, word = np.nonzero(e >= 0)
                p = np.exp(alpha[at, word] + w[at, word] + beta[at + size, word] - alpha[n, word]) * counts[rows][word]
                for k, some in enumerate((at + size < n, at + size == n)):
                    out[k] += np.bincount(e[at[some], word[some]], p[some], out.shape[1])
        return out.ravel()


def normalized(weights: np.ndarray, first: np.ndarray, end: float) -> tuple[np.ndarray, float]:
    """Log probabilities from positive weights, and that of the end, which shares the sum of the marked pieces."""
    w = weights.reshape(2, -1)
    total = w[:, first].sum() + end
    return np.log(np.where(first, w / total, w / w[:, ~first].sum())).ravel(), float(np.log(end / total))


def _logsum(terms: list[np.ndarray], count: int) -> np.ndarray:
    if not terms:
        return np.full(count, -np.inf)
    top = np.maximum.reduce(terms)
    safe = np.where(np.isfinite(top), top, 0.0)
    total = np.exp(terms[0] - safe)
    for t in terms[1:]:
        total += np.exp(t - safe)
    with np.errstate(divide="ignore"):
        return safe + np.log(total)


def _logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -np.inf else a + log1p(exp(b - a))


def by_length(words: list[bytes] | pa.Array, most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray | bytes]]:
    """Row numbers and bytes, behind the word mark, of words of one length, ``most`` at a time; a word beyond ``LONG`` as it is."""
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    if not len(words):
        return
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        n = int(sizes[part[0]])
        if n > LONG:
            yield from ((part[i : i + 1], words[int(part[i])].as_py()) for i in range(len(part)))
            continue
        step = max(1, min(most, 400_000 // (n + 3)))
        for i in range(0, len(part), step):
            rows = part[i : i + step]
            matrix = np.empty((len(rows), n + 3), np.uint8)
            matrix[:, :3] = np.frombuffer(MARK, np.uint8)
            matrix[:, 3:] = data[offsets[rows][:, None] + np.arange(n)]
            yield rows, matrix


def words_of(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case, as UTF-8; bytes.split and bytes.lower know ASCII alone."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, train (uses in documents that aren't held out), every: from ``text`` and ``held_out``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = [*(train | other)]
            a = np.fromiter(map(train.__getitem__, keys), np.int64, len(keys))
            b = np.fromiter(map(other.__getitem__, keys), np.int64, len(keys))
            train.clear(), other.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(a), pa.array(a + b)], ["word", "train", "every"])

        for batch in batches:
            for held, text in zip(batch.column("held_out").to_pylist(), batch.column("text").to_pylist()):
                (other if held else train).update(words_of(text))
                if len(train) + len(other) > GATHER:
                    yield out()
        yield out()

    ship(docs.sparkSession)
    return docs.mapInArrow(count, "word binary, train long, every long").groupBy("word").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))


def fit(counts: DataFrame, n_train: int, path: str, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Natural log probabilities of the pieces, and that of the end; without rounds those of the scores alone.

    What reaches the driver in a round is one number for each piece of the vocabulary.
    """
    pieces, logp = vocabulary(path)
    first, spark = np.array([p.startswith(MARK) for p in pieces]), counts.sparkSession
    logp, end = normalized(np.exp(np.tile(logp, 2)), first, 1.0)
    prior = PRIOR * len(pieces) * np.exp(logp)  # each of the two sums of the scores deals out as much
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(logp)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(vocabulary(path)[0], shared.value), 0.0
            for batch in batches:
                total = total + lattice.expected(batch.column("word"), batch.column("train").to_numpy())
            if isinstance(total, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["piece", "n"])

        found = counts.where("train > 0").select("word", "train").mapInArrow(step, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        expected = prior.copy()
        for r in found:
            expected[r["piece"]] += r["n"]
        logp, end = normalized(expected, first, n_train + PRIOR)
        shared.unpersist()
    return logp, end


def lattice_scores(docs: DataFrame, path: str, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    Learns from the documents whose CRC-32 of doc_id as text, modulo ``modulus``, isn't ``held``;
    a null doc_id counts as an empty text there. Null texts are empty: their one token is the
    end. ``base_score`` is the add-one word unigram; both scores are log10 probabilities. Rows
    with equal doc_id stay rows of their own. With no training document N and V are 0.
    """
    spark = docs.sparkSession
    of = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.select(F.col("doc_id").cast("long"), "text", (of % modulus == held).alias("held_out"))
    counts = materialize(word_counts(docs.select("text", "held_out")), "lattice-words")
    n_train = docs.where("NOT held_out").count()
    sums = counts.agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("v")).head()
    total, distinct = (sums["n"] or 0) + n_train, sums["v"] + bool(n_train)
    logp, end = fit(counts, n_train, path)
    shared = spark.sparkContext.broadcast(logp)

    def score(lattice: Lattice, batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("word"), batch.column("train"), batch.column("every"), pa.array(lattice.score(batch.column("word")) / np.log(10))], ["word", "train", "every", "score"])

    model = materialize(map_batches(counts, score, "word binary, train long, every long, score double", lambda: Lattice(vocabulary(path)[0], shared.value)), "lattice-model")
    unit = np.log10(total + distinct + 1.0)
    often = model.orderBy(F.desc("every"), "word").limit(FREQUENT).select("word", "train", "score").toArrow()  # FREQUENT rows at most
    known = spark.sparkContext.broadcast((often["word"].to_pylist(), often["train"].to_numpy(), often["score"].to_numpy()))
    end_base, end_score, end_known = float(np.log10(n_train + 1) - unit), end / np.log(10), int(n_train > 0)

    def setup() -> tuple:
        words, train, scores = known.value
        return {w: i for i, w in enumerate(words)}, np.log10(train + 1.0) - unit, scores, train > 0

    def per_document(state: tuple, batch: pa.RecordBatch) -> pa.RecordBatch:
        at, base, scores, seen = state
        rows, tails = [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            ids = np.fromiter(map(at.get, words, repeat(-1)), np.int64, len(words))
            own = ids[ids >= 0]
            rows.append((len(words) + 1, int(seen[own].sum()) + end_known, base[own].sum() + end_base, scores[own].sum() + end_score))
            rest = Counter(words[i] for i in np.flatnonzero(ids < 0).tolist())
            tails.append([{"word": w, "n": n} for w, n in rest.items()])
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        tail = pa.array(tails, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out")), *columns, tail], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail"])

    told = map_batches(docs.withColumn("row", F.monotonically_increasing_id()), per_document, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<word:binary,n:long>>", setup)
    told = materialize(told, "lattice-documents")
    tail = (
        told.select("row", F.inline("tail")).join(model.select("word", "train", F.col("score").alias("s")), "word")
        .groupBy("row").agg(
            F.sum(F.when(F.col("train") > 0, F.col("n")).otherwise(0)).alias("k"),
            F.sum(F.col("n") * (F.log10(F.col("train") + 1.0) - F.lit(float(unit)))).alias("b"),
            F.sum(F.col("n") * F.col("s")).alias("s"),
        )
    )
    return told.drop("tail").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
