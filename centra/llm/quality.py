"""Quality classifier: a Gaussian kernel over document statistics, by random Fourier features.

A text becomes a fixed row of statistics (STATISTICS), each standardised and clipped. FEATURES cosines
of random projections approximate a Gaussian kernel over them. Ridge regression on the labels is solved
from normal equations: every partition of the training rows sums its own, the driver adds the sums. The
equations are kept apart by fold, so each training row also gets a score from the other folds, and those
scores are calibrated by isotonic regression to the probability of label 1.

Training reads at most MAX_LABELS labelled documents (those with the smallest hash of their id), whole
texts. The model is a few hundred KB and is broadcast; scoring is one pass without a shuffle.

Cases: a null text is scored like an empty one, whose statistics are all zero. Null labels are left out.
With no labelled row every score is 0.5; with labels of one kind, that label. Repeated rows are scored
alike; a doc_id that is no number is null in the result and has no label. An empty table gives an empty result. Columns of the documents other than id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centra.llm import codepoints as cp
from centra.llm.shared import cut, sample_of

MAX_LABELS, PARTS, FOLDS = 20_000, 8, 4
FEATURES, WIDTH, RIDGE, CLIP, SEED = 192, 4.0, 1.0, 4.0, 20
THRESHOLD = 0.3
STATISTICS = [
    "log_chars", "log_words", "word_length", "upper", "digits", "punctuation", "symbols", "letters", "log_words_a_line", "equal_lines",
    "distinct_words", "same_as_last", "sentence_ends", "words_without_letters", "exclamations", "equal_windows", "bars", "words_with_symbols",
]


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of STATISTICS a text."""
    return np.concatenate([np.zeros((0, len(STATISTICS))), *(_statistics(texts[a:b]) for a, b in cp.chunks(texts))])


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each owner."""
    mixed = np.unique((hashes ^ (owner.astype("u8") * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(20) | owner.astype("u8") << np.uint64(44))
    return np.bincount((mixed >> np.uint64(44)).astype("i8"), minlength=n)[:n]


def _statistics(texts: list[str | None]) -> np.ndarray:
    n = len(texts)
    points, starts, ends = cp.joined(texts)
    kind = cp.classes()[points]
    first, last = cp.runs((kind & cp.SPACE) == 0)
    of = lambda mask: cp.counts(mask, starts, ends).astype("f8")
    owner = np.searchsorted(starts, first, side="right") - 1
    per = lambda values: np.bincount(owner, weights=values, minlength=n)[:n]
    words, letters, filled = np.bincount(owner, minlength=n)[:n].astype("f8"), of(kind & cp.LETTER > 0), of((kind & cp.SPACE) == 0)
    if len(first):
        place = np.arange(len(points), dtype="u8")
        place -= np.repeat(place[np.concatenate([[0], first])], np.diff(np.concatenate([[0], first, [len(points)]])))
        mixed = (points.astype("u8") + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) * (place * np.uint64(2) + np.uint64(0x165667B19E3779F9))
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(mixed, dtype="u8")])
        hashes = (sums[last] - sums[first]) * np.uint64(0x9E3779B97F4A7C15)
    else:
        hashes = np.zeros(0, "u8")
    inner = lambda mask: (c := np.concatenate([[0], np.cumsum(mask, dtype="i8")]))[last] - c[first]
    same = np.zeros(len(first))
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    if len(first) > 2:
        whole = owner[2:] == owner[:-2]
        rolled = (hashes[:-2] + hashes[1:-1] * np.uint64(0x100000001B3) + hashes[2:] * np.uint64(0x1000000000193 * 0x10001 & 0xFFFFFFFFFFFFFFFF))[whole]
        windows = np.bincount(owner[2:][whole], minlength=n)[:n].astype("f8")
        distinct_windows = _distinct(owner[2:][whole], rolled * np.uint64(0xC2B2AE3D27D4EB4F), n)
    else:
        windows = distinct_windows = np.zeros(n)
    lines = [[x for x in (t or "").split("\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines], "f8")
    symbol = kind & cp.SYMBOL > 0
    chars = (ends - starts).astype("f8")
    ratio = lambda a, b: a / np.maximum(b, 1)
    return np.column_stack([
        np.log1p(chars), np.log1p(words), ratio(filled, words), ratio(of(kind & cp.UPPER > 0), letters), ratio(of(kind & cp.DIGIT > 0), filled), ratio(of(kind & cp.PUNCTUATION > 0), words),
        ratio(of(symbol), words), ratio(letters, filled), np.log1p(ratio(words, n_lines)), ratio(n_lines - np.array([len(set(x)) for x in lines], "f8"), n_lines),
        ratio(_distinct(owner, hashes, n), words), ratio(per(same), words), ratio(np.array([sum(x.rstrip()[-1] in ".!?" for x in own) for own in lines], "f8"), n_lines),
        ratio(per(inner(kind & cp.LETTER > 0) == 0), words), ratio(of(points == ord("!")), words), ratio(windows - distinct_windows, windows), ratio(of(points == ord("|")), words), ratio(per(inner(symbol) > 0), words),
    ])


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.centre) / self.scale, -CLIP, CLIP)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ self.projection + self.phase), np.ones(len(rows))])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return np.interp(self.features(statistics(texts)) @ self.weights, self.knots, self.values)


def isotonic(raw: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the calibration: pooled adjacent violators, joined by straight lines between the blocks' means."""
    order = np.argsort(raw, kind="stable")
    x, y = raw[order], labels[order].astype("f8")
    blocks: list[list[float]] = []  # weight, mean of y, sum of x
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        blocks.append([1.0, b, a])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w, m, s = blocks.pop()
            v = blocks[-1]
            v[1] = (v[0] * v[1] + w * m) / (v[0] + w)
            v[0] += w
            v[2] += s
    return np.array([s / w for w, _, s in blocks]), np.array([m for _, m, _ in blocks])


def _sums(phi: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """(folds, features, features + 1): each fold's part of the normal equations, the right side as the last column."""
    return np.stack([np.column_stack([p.T @ p, p.T @ t]) for p, t in ((phi[fold == k], y[fold == k]) for k in range(FOLDS))])


def _solve(sums: np.ndarray) -> np.ndarray:
    a = sums[:, :-1] + RIDGE * np.eye(len(sums))
    a[-1, -1] -= RIDGE * (1 - 1e-6)  # the constant is hardly penalised
    return np.linalg.solve(a, sums[:, -1])


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, max_labels: int = MAX_LABELS) -> Model:
    """Learns the column quality of `labels` from documents for which `learn_from`, on doc_id, holds."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learn_from).groupBy(F.expr("try_cast(doc_id AS bigint)").alias("id_")).agg(F.max("quality").cast("double").alias("y_"))
    # At most max_labels rows of 16 bytes.
    rows = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), "text").join(F.broadcast(sample_of(chosen, "id_", max_labels)), F.col("doc_id") == F.col("id_"))
    fold = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(FOLDS))).cast("int").alias("fold")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(statistics(b.column(2).to_pylist())), pa.list_(pa.float64()))], ["fold", "y", "row"])

    sample = cut(rows.select(fold, F.col("y_").alias("y"), "text").mapInArrow(measure, "fold int, y double, row array<double>").repartition(PARTS))
    rng = np.random.default_rng(SEED)
    model = Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), rng.normal(size=(len(STATISTICS), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))

    def table(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), np.array(b.column(2).flatten()).reshape(-1, len(STATISTICS))) for b in batches if b.num_rows]
        if not got:
            return np.zeros(0, "i4"), np.zeros(0), np.zeros((0, len(STATISTICS)))
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def summed(make) -> np.ndarray | None:
        """The sum over partitions of an array that is made of a partition's rows; one array a partition, PARTS of them, reaches the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fold, y, rows = table(batches)
            if len(y):
                yield pa.RecordBatch.from_arrays([pa.array([make(fold, y, rows).astype("f8").tobytes()], pa.binary())], ["a"])

        parts = [np.frombuffer(r[0], "f8") for r in sample.mapInArrow(run, "a binary").collect()]
        return np.sum(parts, axis=0) if parts else None

    moments = summed(lambda _, y, rows: np.concatenate([[len(y), y.sum()], rows.sum(0), (rows**2).sum(0)]))
    if moments is None:
        return model
    n, d = moments[0], len(STATISTICS)
    if moments[1] in (0, n):
        model.values = np.array([moments[1] / n])
        return model
    model.centre = moments[2 : 2 + d] / n
    model.scale = np.maximum(np.sqrt(np.maximum(moments[2 + d :] / n - model.centre**2, 0)), 1e-6)
    equations = summed(lambda fold, y, rows: _sums(model.features(rows), y, fold)).reshape(FOLDS, FEATURES + 1, FEATURES + 2)
    whole = equations.sum(0)
    apart = [_solve(whole - equations[k]) for k in range(FOLDS)]
    model.weights = _solve(whole)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, y, rows = table(batches)
        phi = model.features(rows)
        raw = (phi * np.stack(apart)[fold]).sum(1) if len(y) else y
        yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), pa.array(y, pa.float64())], ["raw", "y"])

    crossed = sample.mapInArrow(cross, "raw double, y double").toArrow()  # two numbers a training row
    model.knots, model.values = isotonic(crossed["raw"].to_numpy(), crossed["y"].to_numpy())
    return model


def scored(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of the documents, and the score in `out`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(out)
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(b.column(at).to_pylist()), pa.float64())], [*b.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{kinds}, `{out}` double")


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted; the text goes no further than the statistics."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    chosen = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return chosen.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
