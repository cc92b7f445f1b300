"""Quality classifier: a linear support vector machine over Naive Bayes ratios.

Features are indicators of hashed n-grams, of two kinds: ``shapes`` are n-grams
of two to four character shapes with the shares of repeated and distinct words,
``words`` are single words. Quality uses shapes. Each indicator is scaled by the
log ratio of its frequencies in the two classes, counted over all labelled
training rows, and a linear hinge-loss model is fitted by dual coordinate descent
on a bounded sample of them. Scores pass through a logistic curve fitted on the
margins that rows of the sample get from models fitted without them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FEATURE_BYTES, Stored, carried, plain_columns, small_batches, text_slices

#: Hashed features.
FEATURES = 1 << 16
#: Labelled rows used to fit the weights at most; counts use all of them.
SAMPLE_ROWS = 4_000
#: Deviations by which the bound of the hashes is raised, so that enough rows pass it.
SURPLUS = 6
#: Labels that are sent to all tasks at most, some 30 bytes each.
SENT_LABELS = 300_000
SMOOTHING = 1.0
PENALTY = 0.1
EPOCHS = 20
#: Parts of the drawn rows, each scored by a model of the others for the logistic curve.
FOLDS = 3

def _shape_table() -> bytes:
    """Bytes to shape symbols: lower, upper, digit, blank; other ASCII stays; other bytes count as lower."""
    out = bytearray(range(256))
    for b in range(256):
        if chr(b).isdigit() and b < 128:
            out[b] = ord("0")
        elif b < 128 and chr(b).isupper():
            out[b] = ord("A")
        elif b >= 128 or chr(b).isalpha():
            out[b] = ord("a")
        elif 9 <= b <= 13 or b == 32:
            out[b] = ord(" ")
    return bytes(out)


_SHAPES = np.frombuffer(_shape_table(), np.uint8)


def _grams(a: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams of two, three and four bytes of an array, each by its own multiplier."""
    x = a.astype(np.uint32)
    out, h = [], x
    for n, odd in ((2, 2654435769), (3, 2246822519), (4, 3266489917)):
        h = h[: max(0, len(x) - n + 1)] * np.uint32(16777619) + x[n - 1 :]
        out.append((h * np.uint32(odd)) >> np.uint32(16))
    return out


def _letters_only() -> bytes:
    """Bytes with A-Z lowered and everything in ASCII but letters as blanks."""
    return bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


_LETTERS = _letters_only()
#: Words whose feature numbers a worker remembers.
KNOWN_WORDS = 200_000


class _Numbers(dict):
    """Feature numbers of words, worked out when first met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = number = zlib.crc32(word) % FEATURES
        return number


_NUMBERS = _Numbers()


def _named(*names: str) -> np.ndarray:
    return np.array([zlib.crc32(n.encode()) % FEATURES for n in names], np.uint32)


#: Tenths of the words that repeat the one before: all that are reached. Tenths that are distinct: all that are not passed.
_AGAIN = _named(*[f"again {k}" for k in range(1, 11)])
_DISTINCT = _named(*[f"distinct {k}" for k in range(11)])


@cache
def _sized(tenths: int, bits: int) -> np.ndarray:
    return _named(f"distinct {tenths} of {bits}")


def word_features(texts: list[str]) -> Iterator[np.ndarray]:
    """Feature numbers of the words of each text, each once; the first is always there.

    Words are runs of ASCII letters, A-Z lowered, and of bytes beyond ASCII.
    """
    for text in texts:
        found = set(map(_NUMBERS.__getitem__, set(text.encode().lower().translate(_LETTERS).split())))
        found.add(0)
        yield np.fromiter(found, np.int64, len(found))


def shape_features(texts: list[str]) -> Iterator[np.ndarray]:
    """Feature numbers of each text, each once; the first is always there.

    Shape n-grams of two to four characters, where all letters look alike but
    for their case, the share of words that repeat the one before, and that of
    distinct words. Shapes and hashes are worked out for all texts at once.
    """
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    if not len(sizes):
        return
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    shape = _SHAPES[data]
    # runs of lower-case letters beyond two say nothing more
    keep = np.ones(len(shape), bool)
    low = shape == 97
    keep[2:] = ~(low[2:] & low[1:-1] & low[:-2])
    for k in (0, 1):  # the first two characters of a text follow nothing
        keep[(starts + k)[sizes > k]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shape = shape[keep]
    grams = _grams(shape)
    # words between blanks; a text's end ends its last word
    blank = _SHAPES[data] == 32
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * data + np.uint64(7))])
    blanks = np.flatnonzero(blank)
    first = np.searchsorted(blanks, starts).tolist()
    last = np.searchsorted(blanks, ends).tolist()
    seen = np.zeros(FEATURES, np.int64)
    order = np.arange(3 * int(sizes.max()) + 64)  # three n-grams a character at most, and the rest
    rows = zip(starts.tolist(), ends.tolist(), place[starts].tolist(), place[ends].tolist(), first, last)
    for s, e, ps, pe, f, t in rows:
        parts = [np.zeros(1, np.uint32)] + [g[ps : pe - n + 1] for n, g in zip((2, 3, 4), grams) if pe - ps >= n]
        cut = blanks[f:t]
        begin, end = np.concatenate([[s], cut + 1]), np.concatenate([cut, [e]])
        real = end > begin
        begin, end = begin[real], end[real]
        if len(begin) > 3:
            word = (sums[end] - sums[begin]) * np.uint64(131) + (end - begin).astype(np.uint64)
            again = int(10 * np.count_nonzero(word[1:] == word[:-1]) / (len(word) - 1))
            word.sort()
            distinct = (1 + np.count_nonzero(word[1:] != word[:-1])) / len(word)
            parts += [_AGAIN[:again], _DISTINCT[int(10 * distinct) :], _sized(int(10 * distinct), len(word).bit_length())]
        h = np.concatenate(parts)
        # of equal numbers the one written last is left
        o = order[: len(h)]
        seen[h] = o
        yield h[seen[h] == o]


KINDS = {"shapes": shape_features, "words": word_features}


@dataclass
class Model:
    """Weights over features, with the ratios multiplied in, and the logistic curve."""

    weights: np.ndarray
    slope: float
    shift: float
    kind: str = "shapes"

    def scores(self, texts: list[str]) -> np.ndarray:
        """Chance of label 1 of each text."""
        margins = np.array([self.weights[f].sum() for f in KINDS[self.kind](texts)], float)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.shift, -40.0, 40.0)))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float = PENALTY, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a hinge-loss linear model on rows of scaled indicators.

    Classes weigh alike: the box of a row's dual variable is inversely
    proportional to the size of its class.
    """
    w = np.zeros(len(ratio))
    share = np.array([max(1, (y < 0).sum()), max(1, (y > 0).sum())]) / len(y)
    box = penalty * 0.5 / share[(y > 0).astype(int)]
    values = [ratio[r] for r in rows]
    norms = np.array([float(v @ v) for v in values])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            if norms[i] == 0:
                continue
            gradient = y[i] * float(w[rows[i]] @ values[i]) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), box[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                alpha[i] = new
    return w


def logistic_curve(margins: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, each counted by its weight, by Newton steps."""
    weights = np.ones(len(y)) if weights is None else weights
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        g = x.T @ (weights * (p - target)) + 1e-3 * (theta - [1.0, 0.0])
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature counts of each class in a task, one row for each feature met; rows are counted as a feature after the last."""
    counts = np.zeros((2, FEATURES + 1), np.int64)
    for batch in batches:
        for raw, y in zip(batch.column("features"), batch.column("label").to_pylist()):
            counts[y, np.frombuffer(raw.as_buffer(), np.uint16)] += 1
            counts[y, FEATURES] += 1
    y, feature = np.nonzero(counts)
    yield pa.RecordBatch.from_pydict({"label": pa.array(y, pa.int32()), "feature": pa.array(feature, pa.int32()), "n": pa.array(counts[y, feature], pa.int64())})


def _ratios(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log ratio of each feature's smoothed frequency in class 1 to that in class 0."""
    freq = (counts + SMOOTHING) / (rows[:, None] + 2 * SMOOTHING)
    return np.log(freq[1] / freq[0])


def _left_out_margins(found: list[np.ndarray], y: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Margins of the drawn rows by models that know nothing of them.

    Each fold's rows are taken out of the counts and of the fit. A fold without
    which a class has no row left in the fit keeps its rows in it.
    """
    out = np.zeros(len(found))
    fold = np.arange(len(found)) % FOLDS
    for k in range(FOLDS):
        mine, others = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(np.unique(y[others])) < 2:
            others = np.arange(len(found))
        less, fewer = counts.copy(), rows.copy()
        for i in mine:
            c = int(y[i] > 0)
            less[c, found[i]] -= 1
            fewer[c] -= 1
        ratio = _ratios(less, fewer)
        w = dual_coordinate_descent([found[i] for i in others], y[others], ratio) * ratio
        out[mine] = [w[found[i]].sum() for i in mine]
    return out


def train(known: DataFrame, label: str = "label", features: str = "features", kind: str = "shapes", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows of ``order``, feature numbers and a label (0 or 1; others take no part).

    Class counts cover all rows; the driver gets at most two numbers for each of
    ``FEATURES`` and at most ``sample_rows`` rows, half of each class if there
    are as many: those of the least hashes, found below a bound and not by a sort,
    repeated rows once. The logistic curve is fitted on
    margins of models that left the row out, so that it holds for rows that were
    not seen. With no rows, or one class only, the score is a constant. The
    table is read three times; store it if it is dear.
    """
    known = known.where(F.col(label).isin(0, 1)).select("order", F.col(features).alias("features"), F.col(label).cast("int").alias("label"))
    parts = known.select("features", "label").mapInArrow(_class_counts, "label int, feature int, n long")
    summed = parts.groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, FEATURES + 1))
    counts[np.asarray(summed["label"]), np.asarray(summed["feature"])] = np.asarray(summed["n"])
    counts, rows = counts[:, :FEATURES].copy(), counts[:, FEATURES].copy()
    if not rows.all():
        return Model(np.zeros(FEATURES), 1.0, 40.0 if rows[1] or not rows.any() else -40.0, kind)
    half = sample_rows // 2
    # the least hashes of each class lie below a bound that follows from their count; little more than is asked for passes it
    drawable = known.withColumn("draw", F.xxhash64("order")).dropDuplicates(["label", "draw"])
    sizes = {r.label: r["count"] for r in drawable.groupBy("label").count().collect()}
    bound = [min((1 << 63) - 1, -(1 << 63) + int((half + SURPLUS * math.sqrt(half)) / sizes[k] * (1 << 64))) for k in (0, 1)]
    passed = drawable.where(F.col("draw") <= F.when(F.col("label") == 0, bound[0]).otherwise(bound[1]))
    drawn = sorted((r.draw, r.label, bytes(r.features)) for r in passed.toLocalIterator())
    got = sorted(x for k in (0, 1) for x in [r for r in drawn if r[1] == k][:half])
    y = np.array([1.0 if r[1] else -1.0 for r in got])
    found = [np.frombuffer(r[2], np.uint16) for r in got]
    ratio = _ratios(counts, rows)
    w = dual_coordinate_descent(found, y, ratio) * ratio
    # a row stands for those of its class that were not drawn, so that scores mean the same at every size
    stands = [rows[k] / max(1, sum(r[1] == k for r in got)) for k in (0, 1)]
    slope, shift = logistic_curve(_left_out_margins(found, y, counts, rows), y, np.array([stands[r[1]] for r in got]))
    return Model(w, slope, shift, kind)


def held_out(id_col: str = "doc_id"):
    """Column: rows that are kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def labelled_features(docs: DataFrame, labels: DataFrame, kinds: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> Stored:
    """``order``, and each label of ``kinds`` with its feature numbers (``<label>_features``), of the training rows.

    ``kinds`` names the kind of features of each label. Rows are those that have
    a label and are not held out; they are read once for all labels and stored.
    Labels other than 0 and 1 are null, null texts and identifiers take no part;
    of several labels of an identifier the least counts. Few labels are sent to
    all tasks; many are joined to the feature numbers, never to the texts.
    """
    small_batches(docs.sparkSession)
    least = [F.min(F.when(F.col(f"`{c}`").isin(0, 1), F.col(f"`{c}`").cast("int"))).alias(c) for c in kinds]
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(*least).dropna("all", subset=list(kinds))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where(~held_out("doc_id") & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.withColumn("order", F.xxhash64("doc_id", "text"))
    few = marks.count() <= SENT_LABELS
    if few:
        rows = rows.join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).drop("_id")
    kept = [c for c in rows.columns if c != "text"]
    fields = [rows.schema[c] for c in kept] + [T.StructField(f"{c}_features", T.BinaryType()) for c in kinds]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", FEATURE_BYTES):
            texts = batch.column("text").to_pylist()
            made = [pa.array([f.astype(np.uint16).tobytes() for f in KINDS[k](texts)], pa.binary()) for k in kinds.values()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=kept + [f"{c}_features" for c in kinds])

    found = rows.mapInArrow(work, T.StructType(fields))
    if not few:
        found = found.join(marks, F.col("doc_id") == F.col("_id"))
    return Stored(found.select("order", *kinds, *[f"{c}_features" for c in kinds]), "labelled")


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of ``labels.quality``."""
    known = labelled_features(docs, labels, {"quality": "shapes"}, id_col, text_col)
    model = train(known.df, "quality", "quality_features")
    known.drop()
    return model


def quality_scores(
    docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix: str = ""
) -> DataFrame:
    """``held_out``, ``score`` and ``predicted`` of every row, with its identifier and the columns of ``carry``.

    The names of the new columns begin with ``prefix``, so that columns of any
    name can be carried. Null texts score as empty ones; the score is the chance
    that the label is 1. Rows with a null identifier are never held out. The
    model, ``FEATURES`` weights whatever the corpus, is sent to all tasks.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept, plain, fields = carried(docs, (id_col, *carry), prefix, ("held_out", "score", "predicted"))
    slim, text_name = plain_columns(docs, kept, plain, text_col)
    schema = T.StructType([*fields, T.StructField("_score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in text_slices(batches, text_name, FEATURE_BYTES):
            scores = m.scores([t or "" for t in batch.column(text_name).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in plain] + [pa.array(scores, pa.float64())], names=[*plain, "_score"])

    scored = slim.mapInArrow(work, schema)
    return scored.select(
        *[F.col(a).alias(c) for c, a in zip(kept, plain)],
        held_out(plain[0]).alias(f"{prefix}held_out"),
        F.col("_score").alias(f"{prefix}score"),
        (F.col("_score") >= threshold).cast("int").alias(f"{prefix}predicted"),
    )
