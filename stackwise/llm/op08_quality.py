"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

A rating is a grade 0 (toxic), 1 (low quality) or 2 (good).  All grades share one weight vector over hashed words and a
few hashed shape features; ordered thresholds cut the score: ``P(grade <= j) = sigmoid(t[j] - score)``.  The model gives
the expected grade and the tail probability ``P(grade = 2)``, by which documents are selected.

Training uses at most ``MAX_TRAIN`` labelled documents (those with the smallest hash of their id); their features,
not their texts, come to the driver.  The weights have a fixed size and are broadcast.  Every document is scored whole.

Defined results: null text counts as empty; an empty text has only shape features.  A document that several labels
name gets the lowest grade.  Labels with null quality or toxic count as not low and not toxic.  If fewer than two grades occur,
there is no model: scores are null and everything is kept.  Null ids and repeated rows are scored like others.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, PolyHash, chunks, mix, read_table, utf8

GRADES = 3
#: Labelled documents to train on, at most; the part of them that a feature with a weight occurs in, at least.
MAX_TRAIN, LEAST_SEEN = 8_000, 1 / 500
WORD_BITS = 20
#: Bytes of the word beginnings that are features besides whole words.
STEMS = (4, 5, 6)
SHAPES, STEPS = 6, 16
FEATURES = (1 << WORD_BITS) + SHAPES * STEPS
RIDGE, PASSES = 3e-4, 40
#: Features that the loss looks at together.
PART = 1 << 18
#: A document is kept if its probability of the top grade is at least this.
KEEP_AT = 0.5

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
BREAK = SPACE | PUNCTUATION


def _runs(mask: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true values that no edge divides."""
    before = np.concatenate(([False], mask[:-1])) if len(mask) else mask
    after = np.concatenate((mask[1:], [False])) if len(mask) else mask
    return np.flatnonzero(mask & (edge[:-1] | ~before)), np.flatnonzero(mask & (edge[1:] | ~after)) + 1


def features(data: np.ndarray, offsets: np.ndarray, hasher: PolyHash) -> Iterator[np.ndarray]:
    """The sorted distinct feature numbers of each document."""
    for lo, hi in chunks(offsets):
        base = offsets[lo]
        raw, at = data[base : offsets[hi]], offsets[lo : hi + 1] - base
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        prefix = hasher.prefix(LOWER[raw])
        # Words, runs of punctuation marks, and the first bytes of longer words.
        words = _runs(~BREAK[raw], edge)
        found = [words, _runs(PUNCTUATION[raw], edge)]
        found += [(words[0][longer], words[0][longer] + n) for n in STEMS if (longer := words[1] - words[0] > n) is not None]
        family = np.repeat(np.arange(len(found), dtype=np.uint64), [len(x[0]) for x in found])
        starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(starts, kind="stable")
        starts, ends, family = starts[order], ends[order], family[order]
        words = mix(hasher.ranges(prefix, starts, ends) + family) >> np.uint64(64 - WORD_BITS)
        words = words.astype(np.int64)
        first = np.searchsorted(starts, at)
        sums = [np.concatenate(([0], np.cumsum(mask)))[at] for mask in (PUNCTUATION[raw], (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57))]
        for d in range(hi - lo):
            own = words[first[d] : first[d + 1]]
            distinct = np.unique(own)
            size, n = max(1, int(at[d + 1] - at[d])), max(1, len(own))
            shares = [len(distinct) / n, *(int(s[d + 1] - s[d]) / size for s in sums)]
            steps = [min(STEPS - 1, int(x * STEPS)) if k == 0 else min(STEPS - 1, int((x * STEPS * STEPS) ** 0.5)) for k, x in enumerate(shares)]
            steps += [min(STEPS - 1, n.bit_length()), min(STEPS - 1, int(size / n))]
            yield np.concatenate((distinct, (1 << WORD_BITS) + np.arange(SHAPES) * STEPS + np.array(steps)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def minimise(loss, x: np.ndarray, passes: int, history: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving; ``loss`` returns value and gradient."""
    value, gradient = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(passes):
        step, scales = -gradient, []
        for s, y, r in reversed(pairs):
            scales.append(r * (s @ step))
            step = step - scales[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            step = step * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(pairs, reversed(scales), strict=True):
            step = step + s * (a - r * (y @ step))
        slope, size = gradient @ step, 1.0 if pairs else 1.0 / max(1e-12, np.abs(gradient).max())
        for _ in range(30):
            to = x + size * step
            new_value, new_gradient = loss(to)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x
        s, y = to - x, new_gradient - gradient
        if s @ y > 1e-12:
            pairs = [*pairs[1 - history :], (s, y, 1.0 / (s @ y))]
        done = value - new_value < 1e-7 * abs(value)
        x, value, gradient = to, new_value, new_gradient
        if done:
            break
    return x


def ordinal_loss(row: np.ndarray, column: np.ndarray, grades: np.ndarray, width: int):
    """Mean negative log likelihood with ridge penalty, and its gradient, of ``width`` weights, an origin and log steps."""
    n, above, below = len(grades), grades < GRADES - 1, grades > 0
    parts = [slice(a, a + PART) for a in range(0, len(row), PART)]  # arrays as long as all features are never made

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, free = x[:width], x[width:]
        t = np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))
        score = sum((np.bincount(row[p], w[column[p]], n) for p in parts), np.zeros(n))
        high = np.where(above, _sigmoid(t[np.minimum(grades, GRADES - 2)] - score), 1.0)
        low = np.where(below, _sigmoid(t[np.maximum(grades - 1, 0)] - score), 0.0)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_t = np.zeros(GRADES - 1)
        np.add.at(g_t, grades[above], -d_high[above] / n)
        np.add.at(g_t, grades[below] - 1, d_low[below] / n)
        g_free = np.concatenate(([g_t.sum()], np.cumsum(g_t[::-1])[::-1][1:] * np.exp(free[1:])))
        slope = (d_high - d_low) / n
        g_w = sum((np.bincount(column[p], slope[row[p]], width) for p in parts), RIDGE * w)
        return -np.log(p).mean() + 0.5 * RIDGE * (w @ w), np.concatenate((g_w, g_free))

    return loss


class OrdinalModel:
    """Cumulative-link (proportional odds) regression with ridge penalty, fitted on the full batch."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray) -> OrdinalModel | None:
        if len(rows) == 0 or len(np.unique(grades)) < 2:
            return None
        column = np.concatenate([r.astype(np.int32) for r in rows])
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        seen = np.bincount(column, minlength=FEATURES) >= min(max(3, LEAST_SEEN * len(rows)), len(rows))
        kept = seen[column]
        used, place = np.flatnonzero(seen), np.cumsum(seen, dtype=np.int32) - 1
        column, row = place[column[kept]], row[kept]
        del kept
        n = len(rows)
        # Thresholds are an origin and positive steps, so they stay ordered.
        share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
        t = np.log(share / (1 - share))
        free = np.concatenate((t[:1], np.log(np.maximum(np.diff(t), 0.1))))
        x = minimise(ordinal_loss(row, column, grades, len(used)), np.concatenate((np.zeros(len(used)), free)), PASSES)
        w, free = x[: len(used)], x[len(used) :]
        weights = np.zeros(FEATURES, np.float32)
        weights[used] = w
        return cls(weights, np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:])))))

    def predict(self, rows: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and probability of the top grade."""
        score = np.array([self.weights[r].sum(dtype=np.float64) for r in rows])
        tails = 1 - _sigmoid(self.thresholds[None, :] - score[:, None]) if len(score) else np.zeros((0, GRADES - 1))
        return tails.sum(axis=1), tails[:, -1]


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """Fit on ``ratings`` (doc_id, grade) joined with ``docs``."""
    ratings = ratings.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("grade").alias("_grade"))
    chosen = ratings.orderBy(F.xxhash64("_id"), "_id").limit(MAX_TRAIN)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    texts = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_grade", "_text")  # MAX_TRAIN rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = PolyHash()
        for batch in batches:
            rows = [r.astype(np.int32).tobytes() for r in features(*utf8(batch.column(2)), hasher)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(rows, pa.binary())], ["id", "grade", "row"])

    got = texts.mapInArrow(run, "id long, grade int, row binary").dropDuplicates(["id"]).toArrow().sort_by("id")
    return OrdinalModel.fit([np.frombuffer(r, np.int32) for r in got["row"].to_pylist()], got["grade"].to_numpy().astype(np.int64))


#: Columns that ``score`` adds: expected grade, probability of the top grade, and whether that reaches ``KEEP_AT``.
ADDED = ("expected_grade", "p_top", "keep")


def score(docs: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text", added: tuple[str, str, str] = ADDED) -> DataFrame:
    """``docs`` with the three columns ``added``; columns of these names are replaced."""
    kinds = dict(zip(added, ("double", "double", "boolean"), strict=True))
    docs = docs.drop(*added)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.withColumns(dict(zip(added, (none, none, F.lit(True)), strict=True)))
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    at, names = docs.columns.index(text_col), [*docs.columns, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model = PolyHash(), OrdinalModel(*held.value)
        for batch in batches:
            expected, top = model.predict(features(*utf8(batch.column(at)), hasher))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(top), pa.array(top >= KEEP_AT)], names)

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in kinds.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, ratings_of(read_table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", "expected_grade", "p_top", "keep")
