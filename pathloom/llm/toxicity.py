"""Toxicity classifier with a counterfactual penalty.

A logistic model over the presence of words and of word beginnings (inflected forms share them).  For every labelled text that mentions an
identity term, one counterfactual text has each such term swapped for another of its group, and a
second has it left out (swapped for no group at all); the training loss adds the squared
differences of the scores (logits), so a mention of a group alone hardly moves a score,
whichever group it is, while the other words keep the label's evidence.

Word counts by label are gathered over all labelled training rows, with partial counts on
the executors; the ``FEATURES`` words that tell the labels apart best, and all identity
terms, become the features (the bound of what is broadcast).  Each step of the optimiser
(limited-memory BFGS) sums the loss and its gradient over a stored table of feature lists.

Defined results: a null text counts as empty; an empty or wordless text has the score of
the intercept alone; repeated rows are scored one by one; labels without an id or a value
are ignored, several labels of one id count as their majority; without labels every score
is one half; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernels as K
from pathloom.llm.labelled import fold, one_label, with_label
from pathloom.llm.optimise import minimise
from pathloom.plans.staging import stage

FEATURES = 4096
MIN_DOCUMENTS = 4
#: Bytes of the word beginnings that are features beside the words.
PREFIX_BYTES = (4, 5, 6)
#: Standard errors by which a feature's share among the labels must differ from the usual.
LEAST_SURPRISE = 5.0
RIDGE = 0.2
FAIRNESS = 5.0
STEPS = 20
HELD = 1 << 22

#: Identity terms, by the group within which they are swapped.
IDENTITIES = {
    "faith": "muslim christian jewish hindu buddhist sikh catholic protestant atheist mormon",
    "faiths": "muslims christians jews hindus buddhists sikhs catholics protestants atheists mormons",
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer",
    "gender": "female male transgender nonbinary trans cisgender",
    "person": "woman man girl boy",
    "people": "women men girls boys",
    "origin": "african american asian european mexican latino hispanic chinese indian japanese arab french german spanish",
    "origins": "africans americans asians europeans mexicans latinos hispanics arabs",
    "colour": "black white brown",
    "ability": "deaf blind disabled autistic paralyzed",
    "age": "young old elderly teenage",
}


def _distinct_words(column: pa.Array) -> Iterator[np.ndarray]:
    """Of each text, the distinct words and word beginnings."""
    words = K.scan(column, K.NOT_ALNUM)
    parts, cuts = [words.hashes], [words.first]
    for length in PREFIX_BYTES:
        long = np.flatnonzero(words.ends - words.starts > length)
        starts = words.starts[long]
        parts.append(K.mix(K.hash_spans(words.data, starts, starts + length), length))
        cuts.append(np.searchsorted(long, words.first))
    for i in range(len(column)):
        yield np.unique(np.concatenate([p[c[i] : c[i + 1]] for p, c in zip(parts, cuts, strict=True)]))


def _identity_tables() -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """By an identity term's hash, its features and those of the term that replaces it; and all these features."""
    swap: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for group in IDENTITIES.values():
        column = pa.array(group.split())
        names = K.scan(column, K.NOT_ALNUM).hashes.tolist()
        own = list(_distinct_words(column))
        swap |= {n: (f, g) for n, f, g in zip(names, own, own[1:] + own[:1], strict=True)}
    return swap, np.unique(np.concatenate([f for f, _ in swap.values()]))


def word_counts(rows: DataFrame) -> DataFrame:
    """Of rows (text, y): how many texts of each label hold each word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        size = 0

        def totals() -> pa.RecordBatch:
            words, at = np.unique(np.concatenate(held), return_inverse=True)
            ones = np.bincount(at, weights=np.concatenate(marks), minlength=len(words)).astype(np.int64)
            both = np.bincount(at, minlength=len(words))
            return pa.record_batch([pa.array(words.view(np.int64)), pa.array(both), pa.array(ones)], ["word", "n", "n1"])

        for batch in batches:
            for piece in K.slices(batch, "text"):
                for found, y in zip(_distinct_words(piece.column(0)), piece.column(1).to_pylist(), strict=True):
                    held.append(found)
                    marks.append(np.full(len(found), y, dtype=np.int8))
                    size += len(found)
                if size >= HELD:
                    yield totals()
                    held, marks, size = [], [], 0
        if held:
            yield totals()

    parts = rows.select("text", "y").mapInArrow(count, "word long, n long, n1 long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def chosen_words(counts: DataFrame, n: int, n1: int, features: int, min_documents: int) -> np.ndarray:
    """The words whose share among the labels differs most, in standard errors."""
    p = (n1 + 1) / (n + 2)
    surprise = F.abs(F.col("n1") - F.col("n") * F.lit(p)) / F.sqrt(F.col("n") * F.lit(p * (1 - p)))
    told = (F.col("n") >= min_documents) & (surprise >= LEAST_SURPRISE)
    top = counts.where(told).orderBy(surprise.desc(), "word").limit(features).select("word").toArrow()
    return top.column("word").to_numpy().astype(np.int64).view(np.uint64)


def _places(found: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(words, found), len(words) - 1)
    return at[words[at] == found]


def design(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """Of rows (text, y): the label, the features present, and those of the two counterfactuals (null if none)."""
    swap, _ = _identity_tables()
    terms = np.array(sorted(swap), dtype=np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast((words, terms, swap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, terms, swap = shared.value
        for batch in batches:
            for piece in K.slices(batch, "text"):
                present, swapped, without = [], [], []
                for found in _distinct_words(piece.column(0)):
                    present.append(_places(found, words).astype(np.int32))
                    named = found[np.isin(found, terms)]
                    if len(named):
                        gone = np.concatenate([swap[int(w)][0] for w in named])
                        come = np.concatenate([swap[int(w)][1] for w in named])
                        rest = np.setdiff1d(found, gone)
                        swapped.append(_places(np.union1d(rest, come), words).astype(np.int32))
                        without.append(_places(rest, words).astype(np.int32))
                    else:
                        swapped.append(None)
                        without.append(None)
                kind = pa.list_(pa.int32())
                lists = [pa.array(x, kind) for x in (present, swapped, without)]
                yield pa.record_batch([piece.column(1), *lists], ["y", "x", "swapped", "without"])

    return rows.select("text", "y").mapInArrow(run, "y int, x array<int>, swapped array<int>, without array<int>")


def _logits(lists: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, the flat features, and the row of each."""
    flat = lists.flatten().to_numpy()
    lengths = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lists)), lengths)
    return np.bincount(row, weights=w[flat], minlength=len(lists)) + w[-1], flat, row


def loss_and_gradient(table: DataFrame, w: np.ndarray, fairness: float) -> tuple[float, np.ndarray]:
    """Summed over the executors; the last weight is the intercept."""
    shared = table.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, loss = shared.value, np.zeros(len(shared.value)), 0.0
        for batch in batches:
            y = batch.column(0).to_numpy().astype(float)
            z, flat, row = _logits(batch.column(1), w)
            loss += float(np.logaddexp(0, np.where(y > 0, -z, z)).sum())
            pull = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
            total += np.bincount(flat, weights=pull[row], minlength=len(w))
            total[-1] += pull.sum()
            pairs = batch.filter(batch.column(2).is_valid())
            for other in (2, 3) if pairs.num_rows else ():
                (a, flat_a, row_a), (b, flat_b, row_b) = _logits(pairs.column(1), w), _logits(pairs.column(other), w)
                gap = a - b
                loss += fairness * float((gap * gap).sum())
                total += np.bincount(flat_a, weights=2 * fairness * gap[row_a], minlength=len(w))
                total -= np.bincount(flat_b, weights=2 * fairness * gap[row_b], minlength=len(w))
        moved = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(moved, -1)), pa.array(np.append(total[moved], loss))], ["k", "v"])

    # One sum for each weight, whatever the number of tasks; the loss goes under -1.
    sums = table.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    k, v = sums.column("k").to_numpy(), sums.column("v").to_numpy()
    gradient = np.zeros(len(w))
    gradient[k[k >= 0]] = v[k >= 0]
    shared.unpersist()
    return float(v[k < 0].sum()), gradient


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    parts: int = 4,
    held_out: int = 2,
    threshold: float = 0.3,
    features: int = FEATURES,
    min_documents: int = MIN_DOCUMENTS,
    ridge: float = RIDGE,
    fairness: float = FAIRNESS,
    steps: int = STEPS,
) -> DataFrame:
    """``id``, held_out, score and predicted of every document; labels of the held-out fold are never read."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    known = stage(one_label(labels.where(fold(id, parts) != held_out), id, label), "labels")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("n1")).first()
    train = with_label(docs, known)
    _, terms = _identity_tables()
    if size.n:
        picked = chosen_words(word_counts(train), size.n, size.n1, features, min_documents)
        words = np.union1d(picked, terms)
        table = stage(design(train, words), "design")

        def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
            value, g = loss_and_gradient(table, w, fairness)
            pull = ridge * np.concatenate((w[:-1], [0.0]))
            return value + 0.5 * float(pull @ w), g + pull

        start = np.zeros(len(words) + 1)
        start[-1] = np.log((size.n1 + 1) / (size.n - size.n1 + 1))
        weights = minimise(objective, start, steps)
    else:
        words, weights = terms, np.zeros(len(terms) + 1)
    model = spark.sparkContext.broadcast((words, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = model.value
        for batch in batches:
            for piece in K.slices(batch, "text"):
                z = np.array([weights[_places(f, words)].sum() for f in _distinct_words(piece.column(1))]) + weights[-1]
                yield pa.record_batch([piece.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["id", "score"])

    return docs.mapInArrow(score, "id long, score double").select(
        F.col("id").alias(id),
        (fold("id", parts) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
