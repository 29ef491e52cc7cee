"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their smoothed shares in good and bad documents, each
document is brought to unit length, and a linear hinge-loss model is fitted by dual coordinate descent. Its
margin becomes a probability by a logistic curve fitted on rows that the model hasn't seen.

N-grams are hashed: of words (1 to 3) and of word shapes (1 to 3: capitals, last sign, length, repetition of the
word before), so vocabulary that the sample lacks still counts through its form.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import Scratch
from .textscan import Words, mix, released, sequence_mix, slices, text_array

BITS = 20
#: The bounds on labelled rows that the fit uses, those with the least hash of their id, and on their features (4 bytes each).
TRAIN_ROWS = 4000
TRAIN_FEATURES = 16_000_000
ALPHA = 1.0
COST = 1.0
EPOCHS = 12

_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
#: Classes of a word's last byte: letter, digit, . , ! | and other signs by themselves.
_LAST = np.zeros(256, np.int64)
_LAST[33:48] = np.arange(3, 18)
_LAST[48:58] = 1
_LAST[58:65] = np.arange(18, 25)
_LAST[91:97] = np.arange(25, 31)
_LAST[123:127] = np.arange(31, 35)
_LAST[128:] = 2


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of each row, ordered by row, as two arrays."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = words.hashes()
    row = words.row
    letter = np.add.reduceat(_LETTER[words.data], words.start, dtype=np.int32)
    upper = np.add.reduceat(_UPPER[words.data], words.start, dtype=np.int32)
    size = words.end - words.start
    capital = np.where(upper == 0, 0, np.where((upper == letter) & (letter > 1), 2, np.where(upper == 1, 1, 3)))
    length = np.searchsorted(np.array([2, 5, 10, 20, 40]), size, side="left")
    again = np.zeros(n, np.int64)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    shape = mix((((capital * 64 + _LAST[words.data[words.end - 1]]) * 8 + length) * 2 + again + 1).astype(np.uint64))
    rows, feats = [row], [h]
    for kind, units, lengths in ((0, shape, (1, 2, 3)), (8, h, (2, 3))):
        for k in lengths:
            g = sequence_mix(units, k)
            ok = row[: len(g)] == row[k - 1 :]
            rows.append(row[: len(g)][ok])
            feats.append(mix(g[ok] + np.uint64(kind + k)))
    keys = np.concatenate(rows) << BITS | (np.concatenate(feats) >> np.uint64(64 - BITS)).astype(np.int64)
    keys = np.unique(keys)
    return keys >> BITS, keys & ((1 << BITS) - 1)


class Model:
    """Weights of features (ratio and model in one), the ratios for lengths, an offset and the logistic curve."""

    def __init__(self, weight: np.ndarray, square: np.ndarray, offset: float, slope: float, shift: float):
        self.weight, self.square, self.offset, self.slope, self.shift = weight, square, offset, slope, shift

    def margins(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        total = np.bincount(row, weights=self.weight[feature], minlength=rows)
        norm = np.sqrt(np.bincount(row, weights=self.square[feature], minlength=rows))
        return total / np.where(norm > 0, norm, 1) + self.offset

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def _descend(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss over unit rows with a constant last feature."""
    w, b = np.zeros(len(ratio)), 0.0
    norms = [math.sqrt(float(ratio[f] @ ratio[f])) or 1.0 for f in rows]
    alpha = np.zeros(len(y))
    # both classes weigh alike
    limit = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            f = rows[i]
            x = (ratio[f] / norms[i]).astype(np.float32)
            gradient = y[i] * (w[f] @ x + b) - 1
            new = min(max(alpha[i] - gradient / (float(x @ x) + 1), 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * x
                b += step
                alpha[i] = new
    return w, b


def fit(examples: list[tuple[np.ndarray, int]]) -> Model:
    """A model of (features, label 1 or 0). Without both labels it is constant."""
    size = 1 << BITS
    y = np.array([1 if label else -1 for _, label in examples])
    if not len(y) or abs(y.sum()) == len(y):
        share = (y > 0).mean() if len(y) else 0.5
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0, 4.0 * (2 * float(share) - 1))

    def ratio_of(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        p, q = np.full(size, ALPHA), np.full(size, ALPHA)
        for f, label in zip(rows, y, strict=True):
            (p if label > 0 else q)[f] += 1
        # of features that stand in one document alone nothing can be said
        seen = p + q > 2 * ALPHA + 1
        return np.where(seen, np.log((p / p.sum()) / (q / q.sum())), 0.0)

    rows = [f for f, _ in examples]
    # the curve: margins of a fifth of the rows by a model of the others
    held = np.arange(len(y)) % 5 == 0
    slope, shift = 1.0, 0.0
    if len(set(y[held])) == 2 and len(set(y[~held])) == 2:
        part = [rows[i] for i in np.flatnonzero(~held)]
        ratio = ratio_of(part, y[~held])
        w, b = _descend(part, ratio, y[~held], COST, EPOCHS)
        m = np.array([_margin(rows[i], ratio, w) + b for i in np.flatnonzero(held)])
        slope, shift = _curve(m, (y[held] > 0).astype(float))
    ratio = ratio_of(rows, y)
    w, b = _descend(rows, ratio, y, COST, EPOCHS)
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), b, slope, shift)


def _margin(f: np.ndarray, ratio: np.ndarray, w: np.ndarray) -> float:
    x = ratio[f]
    return float(w[f] @ x) / (math.sqrt(float(x @ x)) or 1.0)


def _curve(m: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton steps; the slope stays positive."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        g = np.array([((p - t) * m).sum() + 0.01 * (a - 1), (p - t).sum() + 0.01 * b])
        s = p * (1 - p)
        hess = np.array([[(s * m * m).sum() + 0.01, (s * m).sum()], [(s * m).sum(), s.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def held_out(doc_id) -> F.Column:
    """Whether a row's label may not be learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS, most: int = TRAIN_FEATURES) -> Model:
    """A model from labelled documents that aren't held out; null labels and ids don't count.

    The sample is of `limit` ids at most, those of least hash, and of them as many as have `most` features together;
    the first one counts whatever it has. Of several rows of an id the one of least text hash is taken, of repeated
    labels of a document the largest counts. The sample's features come to the driver; nothing else does.
    """
    rows = labels.where(f"{label} IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # many rows of one id are brought down to one before the shuffle
    picked = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches):
        for batch in batches:
            texts = text_array(batch.column(2))
            for i, j in slices(texts):
                row, feature = features(Words(texts, i, j))
                ends = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).cast(pa.int32()), pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], names=["doc_id", "y", "f"]
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = picked.mapInArrow(released(run), f"doc_id {id_type}, y int, f binary")
    scratch = Scratch(docs.sparkSession)
    found = scratch.table(found.withColumn("n", F.octet_length("f") / 4).withColumn("turn", F.xxhash64("doc_id")), "quality-sample")
    # a row for each id of the sample, without its features
    before = F.coalesce(F.sum("n").over(W.orderBy("turn", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = found.select("doc_id", "turn", "n").withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.col("n") <= most))
    table = found.join(F.broadcast(kept.select("doc_id")), "doc_id").select("doc_id", "y", "f").toArrow()
    scratch.drop(found)
    ids, labels_, raw = (table.column(k) for k in range(3))
    order = sorted(range(table.num_rows), key=lambda i: ids[i].as_py())
    return fit([(np.frombuffer(raw[i].as_buffer(), np.int32), labels_[i].as_py()) for i in order])


def score_quality(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score (0 to 1, higher: better) and predicted (1 if score >= 0.5), in place of columns of these names that df has.

    Only the text is scored; a null one as an empty one, whose score is the model's for no features. Equal texts
    have equal scores, repeated rows stay, an empty table gives an empty one. One pass, no shuffle; the model
    has a fixed size.
    """
    spark = df.sparkSession
    df = df.drop("score", "predicted")
    shared = spark.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = text_array(batch.column(at))
            scores = []
            for i, j in slices(texts):
                row, feature = features(Words(texts, i, j))
                scores.append(model.scores(model.margins(row, feature, j - i)))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return df.mapInArrow(released(run), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, repeated ones too; an empty table gives an empty result.

    A null id isn't learned from and is held out as an empty text would be (crc32 0: it isn't). Without labels,
    or with one kind only, every score is the share of good labels, drawn to the ends (0.5 without any).
    """
    model = train(docs, labels)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
