"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of one to three characters of the lower-cased text, everything but letters being a blank,
are hashed to ``DIM`` places; a place weighs 1 + log(count) times its inverse document
frequency, and a text's vector has length 1. Weights are trained by follow the regularised
leader (per-coordinate, with elastic-net penalties) and a temperature is fitted to a part of the
sample that training doesn't see.

The score says which of the learned languages fits best, not whether one does. That is told by
the mean log-likelihood of a text's n-grams in its language, against that of the calibration rows.

Document frequencies come from all training documents. The classifier is fitted on a bounded
sample of them, ``SAMPLE`` rows, drawn by a hash with equal chances for each language; a language
without a row in it isn't learned.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_batches, quoted
from tessera.session import materialize, ship

DIM = 1 << 15
SAMPLE = 4000
EPOCHS = 3
#: Step size and its offset, L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: One in so many sample rows serves calibration alone.
CALIBRATE = 5
#: Nats an n-gram by which a text may be less likely than its language's median text, and the
#: number of n-grams at which sampling alone doubles the square of that.
SLACK, SHORT = 1.5, 100
#: Most languages whose numbers of rows are broadcast; beyond, a join shuffles.
BROADCAST = 1 << 16
UNKNOWN = "und"
_STEP = 1 << 20
_K = np.uint32(0x9E3779B1)


@functools.lru_cache(1)
def letter_table() -> np.ndarray:
    """Whether each character is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def features(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a text's n-grams; none if it has no letter. Long texts go through in steps."""
    out, seen = np.zeros(DIM, np.int64), False
    text, tail = (text or "").lower(), np.zeros(0, np.uint32)  # the last characters of the step before
    for i in range(0, len(text), _STEP):
        c = np.frombuffer(text[i : i + _STEP].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[c]
        seen |= bool(is_letter.any())
        c = np.append(tail, np.where(is_letter, c, np.uint32(32)))
        c = np.append(c[: len(tail)], c[len(tail) :][~((c == 32) & (np.append(0, c[:-1]) == 32))[len(tail) :]])
        h = c.copy()
        for n in range(1, 4):
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
            # Runs that end in the tail were counted in the step before.
            mixed = mixed[max(0, len(tail) - n + 1) :]
            out += np.bincount(((mixed ^ (mixed >> np.uint32(13))) * _K) >> np.uint32(32 - 15), minlength=DIM)
            if len(c) <= n:
                break
            h = h[: len(c) - n] * _K + c[n:]
        tail = c[-2:]
    at = np.flatnonzero(out) if seen else np.zeros(0, np.int64)
    return at, out[at]


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights (DIM by classes) and biases from (places, values, class) rows, in their order."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))  # the last place is the bias, unpenalized

    def weights(at: np.ndarray | slice) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(z[at]) <= L1] = 0
        return w

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = weights(at)
            w[-1] = -z[DIM] / ((BETA + np.sqrt(n[DIM])) / ALPHA)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            square = n[at] + g * g
            z[at] += g - (np.sqrt(square) - np.sqrt(n[at])) / ALPHA * w
            n[at] = square
    w = weights(slice(0, DIM))
    return w, -z[DIM] / ((BETA + np.sqrt(n[DIM])) / ALPHA)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Rows:
    """A sparse matrix of ``DIM`` rows: what differs from 0, by row."""

    def __init__(self, dense: np.ndarray):
        at, self.column = np.nonzero(dense)
        self.value, self.columns = dense[at, self.column], dense.shape[1]
        self.first = np.searchsorted(at, np.arange(DIM + 1))

    def product(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The sum of the rows ``at``, each times its ``x``."""
        many = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(self.column[place], self.value[place] * np.repeat(x, many), self.columns)


def likeliness(at: np.ndarray, counts: np.ndarray, logp: tuple[Rows, np.ndarray], y: int) -> float:
    """Mean log-probability of a text's n-grams in one language."""
    return float(logp[0].product(at, counts)[y] / counts.sum() + logp[1][y])


def shortfall(at: np.ndarray, counts: np.ndarray, logp: tuple[Rows, np.ndarray], y: int, usual: float) -> float:
    """Nats an n-gram by which a text is less likely than ``usual``, made smaller for short texts."""
    return float((usual - likeliness(at, counts, logp, y)) / np.sqrt(1 + SHORT / counts.sum()))


def evidence(learn: list[tuple], check: list[tuple], classes: int) -> tuple[tuple[Rows, np.ndarray], np.ndarray, float] | None:
    """N-gram log-probabilities by language (that of an n-gram never seen, and what others have more), the median text's of each, and the largest shortfall allowed.

    From (places, counts, class) rows; None without calibration rows. A language without any
    takes the median of all. The limit grows with the spread of the calibration rows.
    """
    if not check:
        return None
    total = np.zeros((DIM, classes))
    for at, n, y in learn:
        total[at, y] += n
    logp = Rows(np.log(total / 0.5 + 1)), np.log(0.5 / (total.sum(axis=0) + 0.5 * DIM))
    of = np.array([y for *_, y in check])
    mean = np.array([likeliness(at, n, logp, y) for at, n, y in check])
    usual = np.array([np.median(mean[of == y]) if (of == y).any() else np.median(mean) for y in range(classes)])
    spread = np.quantile([shortfall(at, n, logp, y, usual[y]) for at, n, y in check], 0.99)
    return logp, usual, max(SLACK, 2 * float(spread))


def fold(modulus: int = 5) -> Column:
    """CRC-32 of doc_id as text modulo ``modulus``; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def fit(train: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, float, tuple | None] | None:
    """Languages, idf, weights, biases, temperature and :func:`evidence` from doc_id, text and lang (not null); None without rows.

    Exactly ``sample`` rows are drawn, or all, however many agree in their key.
    """
    ship(train.sparkSession)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, df, n = letter_table(), np.zeros(DIM + 1, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                at, _ = features(text, letters)
                df[at] += 1
                n += 1
        df[DIM] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(df)], ["place", "n"])

    df = np.zeros(DIM + 1, np.int64)
    for r in train.select("text").mapInArrow(frequency, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # DIM + 1 rows
        df[r["place"]] = r["n"]
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1

    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(29), "doc_id"), 11) + 1) / float(1 << 53)
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    key = F.struct((-F.log(uniform) * F.col("rows")).alias("key"), F.xxhash64("text", "lang").alias("tie"))
    sizes = materialize(sizes, "lang-sizes")
    few = sizes.count() <= BROADCAST
    keyed = train.join(F.broadcast(sizes) if few else sizes, "lang").select(key.alias("key"), "lang", "text")
    # The last of the sample, and how many stand before it; rows that tie with it are equal, and fill the sample.
    last = keyed.select("key").orderBy("key").limit(sample).agg(F.max("key").alias("last")).select("last.*").head()
    if last["key"] is None:
        return None
    last = F.struct(F.lit(last["key"]).alias("key"), F.lit(last["tie"]).alias("tie"))
    before = keyed.where(F.col("key") < last).count()

    def count(letters: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t, letters) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tie"), batch.column("lang"), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))], ["key", "tie", "lang", "at", "n"])

    some = keyed.where(F.col("key") < last).unionByName(keyed.where(F.col("key") == last).limit(sample - before))
    drawn = map_batches(some.select("key.key", "key.tie", "lang", "text"), count, "key double, tie long, lang string, at array<int>, n array<int>", letter_table).toArrow().sort_by([("key", "ascending"), ("tie", "ascending")])
    names = sorted(set(drawn["lang"].to_pylist()))
    told = [(np.asarray(a.values), np.asarray(c.values), names.index(y)) for a, c, y in zip(drawn["at"], drawn["n"], drawn["lang"].to_pylist())]
    told = [r for r in told if len(r[0])]
    rows = [(at, vector(at, c, idf), y) for at, c, y in told]
    learn = [r for i, r in enumerate(rows) if i % CALIBRATE or len(rows) < 2 * CALIBRATE]
    w, b = train_ftrl(learn, len(names))
    check = rows[::CALIBRATE] if len(rows) >= 2 * CALIBRATE else []
    logits = np.array([x @ w[at] + b for at, x, _ in check]).reshape(len(check), len(names))
    floors = evidence([r for i, r in enumerate(told) if i % CALIBRATE], told[::CALIBRATE] if check else [], len(names))
    return names, idf, Rows(w), b, temperature(logits, np.array([y for *_, y in check], int)), floors


def identify(docs: DataFrame, model: tuple | None, columns: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """``columns``, lang_pred, score and known of each row's ``text``.

    A null text or one without letters is ``und`` with score 0 and not known; so is every text
    without a model. Known is a text that its language makes likely enough, or any text with
    letters where the model has no calibration rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(letters: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores, known = [], [], []
        for text in batch.column("text").to_pylist():
            at, n = features(text, letters)
            if not len(at) or shared.value is None:
                langs.append(UNKNOWN), scores.append(0.0), known.append(False)
                continue
            names, idf, w, b, t, floors = shared.value
            s = (w.product(at, vector(at, n, idf)) + b) / t
            p = np.exp(s - s.max())
            y = int(p.argmax())
            langs.append(names[y]), scores.append(float(p.max() / p.sum()))
            known.append(floors is None or shortfall(at, n, floors[0], y, floors[1][y]) <= floors[2])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())], [*columns, "lang_pred", "score", "known"])

    told = [T.StructField(c, k) for c, k in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("known", T.BooleanType()))]
    return map_batches(docs.select(*columns, "text"), predict, T.StructType([*(docs.schema[c] for c in columns), *told]), letter_table)


def language_model(docs: DataFrame, sample: int = SAMPLE) -> tuple | None:
    """A model from the documents outside fold 0 that have a language."""
    return fit(docs.select("doc_id", "text", "lang").where((fold() != 0) & F.col("lang").isNotNull()), sample)


def predicted_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; other columns are no inputs.

    Rows with equal doc_id stay rows of their own. A learned language may itself be named ``und``.
    """
    return identify(docs.select(F.col("doc_id").cast("long"), "text", (fold() == 0).alias("held_out")), language_model(docs, sample)).drop("known")


def keep_known_language(docs: DataFrame, least: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``docs`` in a known language; all columns stay.

    Out go texts without letters, texts that their language makes too unlikely, and those whose
    score is nearer to chance, 1 of all languages, than ``least`` of the way to 1.
    """
    columns, model = docs.columns, language_model(docs, sample)
    told = identify(docs.withColumn("__all", F.struct(*map(quoted, columns))), model, ("__all",))
    chance = 1 / len(model[0]) if model else 0.0
    return told.where((F.col("lang_pred") != UNKNOWN) & F.col("known") & (F.col("score") >= chance + least * (1 - chance))).select("__all.*")
