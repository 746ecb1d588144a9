"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics (lengths, character shares,
repetition).  The first and second moments of each class are summed over all labelled
training rows on the executors; the class covariances are shrunk towards the pooled one
and towards a multiple of the identity; their Cholesky factors are computed once and
broadcast.  The score is the logistic of the difference of the two log densities, which
come from Mahalanobis distances by forward substitution, divided by ``TEMPERATURE`` so
that scores far from the boundary keep their order.

Defined results: a null text counts as empty and has the statistics of an empty text;
repeated rows are scored one by one; labels without an id or a value are ignored, several
labels of one id count as their majority; if a class has no training row every score is
the share of label 1 (one half without any labels); an empty table gives an empty result;
other columns are ignored, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernels as K
from pathloom.llm.labelled import fold, one_label
from pathloom.plans.staging import stage

TO_POOLED = 0.2
TO_IDENTITY = 0.05
TEMPERATURE = 4.0
PRIOR_WORDS = 20

FEATURES = (
    "log_words", "word_length", "capitals", "digits", "symbols", "exclamations", "stops", "commas", "line_words",
    "distinct_words", "repeated_next", "repeated_windows", "repeated_lines", "top_word", "long_words",
)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    raw, offsets = K.string_buffer(column)
    words = K.scan(column, K.SPACE)
    grams, at = K.windows(words, 3)
    n = np.diff(words.first).astype(float)
    count = lambda members: K.class_counts(raw, offsets, members).astype(float)
    # UTF-8 continuation bytes are no characters.
    chars = np.maximum(np.diff(offsets) - count(np.arange(0x80, 0xC0)), 1)
    blanks = count(b" \t\n\x0b\x0c\r")
    capitals = count(bytes(range(65, 91)))
    small = count(bytes(range(97, 123)))
    starts, ends = K.spans(raw, offsets, K.NEWLINE)
    line_hashes, line_first = K.hash_spans(raw, starts, ends), np.searchsorted(starts, offsets)
    lines = np.maximum(np.diff(line_first), 1)
    equal = np.zeros(len(words.hashes))
    equal[1:] = words.hashes[1:] == words.hashes[:-1]
    equal[words.first[:-1][n > 0]] = 0  # the word before a text's first one is another text's
    long = (words.ends - words.starts) > 12
    cuts = np.searchsorted(at, words.first)
    distinct, top, windows, unique_lines = (np.zeros(len(column)) for _ in range(4))
    for i in range(len(column)):
        if n[i]:
            _, counts = np.unique(words.hashes[words.first[i] : words.first[i + 1]], return_counts=True)
            distinct[i], top[i] = len(counts), counts.max()
        windows[i] = len(np.unique(grams[cuts[i] : cuts[i + 1]]))
        unique_lines[i] = len(np.unique(line_hashes[line_first[i] : line_first[i + 1]]))
    # Shares are drawn towards what is usual as if the text had PRIOR_WORDS usual words more,
    # so that a text of a few words is not judged by the accidents of one of them.
    share = lambda x, of, usual, per=1: np.sqrt((x + usual * per * PRIOR_WORDS) / (of + per * PRIOR_WORDS))
    return np.column_stack(
        [
            np.log1p(n),
            np.log((chars - blanks + 6 * PRIOR_WORDS) / (n + PRIOR_WORDS)),
            share(capitals, capitals + small, 0.03, 5),
            share(count(b"0123456789"), chars, 0.002, 6),
            share(np.minimum(count(b"#*$%&|<>"), 4 * n), n, 0.01),
            share(np.minimum(count(b"!"), 4 * n), n, 0.01),
            share(np.minimum(count(b"."), 4 * n), n, 0.15),
            share(np.minimum(count(b","), 4 * n), n, 0.05),
            np.log1p((n + PRIOR_WORDS) / (lines + 1)),
            # Distinct words grow as a power of the words, so their log ratio hardly depends on the length.
            np.log(distinct + 0.8 * PRIOR_WORDS) - 0.85 * np.log(n + PRIOR_WORDS),
            share(K.per_text(equal, words.first), n, 0.01),
            share(np.diff(cuts) - windows, np.diff(cuts), 0.01),
            share(np.maximum(lines - unique_lines, 0) * (n > 0), lines, 0.01, 0.1),
            share(top, n, 0.1),
            share(K.per_text(long, words.first), n, 0.05),
        ]
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in K.slices(batch, "text"):
            x = statistics(piece.column(1))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.record_batch([piece.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["id", "x"])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


class Moments(NamedTuple):
    n: float
    mean: np.ndarray
    covariance: np.ndarray


def class_moments(rows: DataFrame, width: int) -> dict[int, Moments]:
    """Of rows (x, y): size, mean and covariance of each class, summed on the executors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            x, y = _rows(batch.column(0)), batch.column(1).to_numpy()
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate(([len(z)], z.sum(0), (z.T @ z).ravel()))
        yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["y", "s"])

    parts = rows.select("x", "y").mapInArrow(sums, "y int, s array<double>")
    summed = parts.select("y", F.posexplode("s").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v"))
    out: dict[int, Moments] = {}
    table = summed.toPandas()
    for k in (0, 1):
        v = table[table.y == k].sort_values("i").v.to_numpy()
        if not len(v) or v[0] < 1:
            continue
        mean = v[1 : 1 + width] / v[0]
        out[k] = Moments(v[0], mean, v[1 + width :].reshape(width, width) / v[0] - np.outer(mean, mean))
    return out


def forward_substitution(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a lower triangular system, for many right sides (columns) at once."""
    out = np.empty_like(right)
    for i in range(len(factor)):
        out[i] = (right[i] - factor[i, :i] @ out[:i]) / factor[i, i]
    return out


class Discriminant(NamedTuple):
    """Two Gaussians in standardised coordinates, with cached Cholesky factors."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    fallback: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), self.fallback)
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            d = forward_substitution(factor, (z - mean).T)
            logs.append(constant - 0.5 * (d * d).sum(0))
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / TEMPERATURE, -500, 500)))


def fit(moments: dict[int, Moments], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    total = sum(m.n for m in moments.values())
    if len(moments) < 2:
        none = np.zeros(0)
        return Discriminant(none, none, [], [], [], moments[1].n / total if 1 in moments else 0.0 if moments else 0.5)
    centre = sum(m.n * m.mean for m in moments.values()) / total
    within = sum(m.n * m.covariance for m in moments.values()) / total
    between = sum(m.n * np.outer(m.mean - centre, m.mean - centre) for m in moments.values()) / total
    scale = np.sqrt(np.maximum(np.diag(within + between), 1e-9))
    unit = np.outer(scale, scale)
    means, factors, constants = [], [], []
    for k in (0, 1):
        m = moments[k]
        c = (1 - to_pooled) * m.covariance / unit + to_pooled * within / unit
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        means.append((m.mean - centre) / scale)
        factors.append(factor)
        constants.append(float(np.log(m.n / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(centre, scale, means, factors, constants, 0.5)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    parts: int = 5,
    held_out: int = 0,
    threshold: float = 0.3,
) -> DataFrame:
    """``id``, held_out, score and predicted of every document; labels of the held-out fold are never read."""
    features = stage(
        docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
            _features, "id long, x array<double>"
        ),
        "quality",
    )
    known = one_label(labels.where(fold(id, parts) != held_out), id, label)
    model = fit(class_moments(features.join(known, "id"), len(FEATURES)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(shared.value.scores(_rows(batch.column(1))))], ["id", "score"])

    return features.mapInArrow(score, "id long, score double").select(
        F.col("id").alias(id),
        (fold("id", parts) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The documents whose score reaches the threshold, all columns kept; rows without an id stay."""
    scored = quality_scores(docs, labels, id=id, text=text, threshold=threshold, **options)
    out = scored.groupBy(id).agg(F.max("predicted").alias("best")).where(F.col("best") == 0).select(id)
    return docs.join(out, id, "left_anti").select(*docs.columns)
