"""Hidden Markov language model over words.

Tokens are words, lower-cased in A-Z, and one end token for each text.  The ``HEAD`` most
frequent training words are symbols of their own; every other word falls into a class by
its shape, and the model emits the class times the word's add-one share of its class, so
each state has a proper distribution over all words, unseen ones included.

Training counts every word of every training text (partial counts on the executors, one
shuffle by word).  Baum-Welch then runs over all training texts: each task adds up the
expected transition and emission counts of its texts by scaled forward and backward
recursions, vectorised over texts of similar length, and one sum by symbol gives the next
parameters.  It starts from states that differ (the corpus counts times noise of each state,
moves that mostly stay) and ends when a round raises the log likelihood by less than ``GAIN``
of it.  The score of a text is its exact log10 likelihood by the scaled forward recursion.

Only bounded things are broadcast: the model and the ``KNOWN`` most frequent words.  The
counts of all other words stay a table, which the distinct words of the texts meet in a
join; the token sequences are stored once as symbol codes below the shared folder.

Defined results: null, empty and blank texts are the end token alone; repeated rows are
scored one by one; without training texts the model is uniform over its symbols; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernels as K
from pathloom.llm.labelled import fold
from pathloom.plans.staging import stage

HEAD = 4096
KNOWN = 1 << 16
STATES = 4
#: Relative gain in log likelihood at which training ends.
GAIN = 1e-3
HELD = 1 << 22
#: Cells (time x text) of one recursion.
CELLS = 400_000
#: Times between two scalings: eight emissions of any model of this module are far above the smallest double.
SCALED = 8
SHAPES = 16
SMOOTH = 0.01

END, FIRST_SHAPE = 0, 1
FIRST_WORD = FIRST_SHAPE + SHAPES
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def shapes(words: K.Words) -> np.ndarray:
    """The shape class of each word: its length, its last byte, and whether it is ASCII."""
    length = words.ends - words.starts
    size = np.searchsorted([3, 6, 10], length)
    last = _LETTER[words.data[words.ends - 1]] if len(length) else np.zeros(0, dtype=bool)
    wide = np.concatenate(([0], np.cumsum(words.data >= 128)))
    return size * 4 + last * 2 + (wide[words.ends] > wide[words.starts])


def word_counts(docs: DataFrame) -> DataFrame:
    """Of rows (text): word hash, its shape, and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        shape: list[np.ndarray] = []
        size = 0

        def totals() -> pa.RecordBatch:
            words, first, counts = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            kinds = np.concatenate(shape)[first].astype(np.int32)
            return pa.record_batch([pa.array(words.view(np.int64)), pa.array(kinds), pa.array(counts)], ["word", "shape", "n"])

        for batch in batches:
            for piece in K.slices(batch, "text"):
                words = K.scan(piece.column(0), K.SPACE)
                held.append(words.hashes)
                shape.append(shapes(words).astype(np.int8))
                size += len(words.hashes)
                if size >= HELD:
                    yield totals()
                    held, shape, size = [], [], 0
        if size:
            yield totals()

    parts = docs.select("text").mapInArrow(count, "word long, shape int, n long")
    return parts.groupBy("word").agg(F.max("shape").alias("shape"), F.sum("n").alias("n"))


class Vocabulary(NamedTuple):
    """What is broadcast of the counts: the most frequent words, and totals of the shapes."""

    words: np.ndarray
    counts: np.ndarray
    codes: np.ndarray
    tokens: int
    distinct: int
    texts: int
    shape_sizes: np.ndarray
    symbols: np.ndarray  # how often each symbol occurs


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    sums = counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    total, distinct = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in sums:
        total[r["shape"]], distinct[r["shape"]] = r["n"], r["v"]
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
    words = top.column("word").to_numpy().astype(np.int64).view(np.uint64)
    n = top.column("n").to_numpy().astype(np.int64)
    shape = top.column("shape").to_numpy().astype(np.int64)
    codes = FIRST_SHAPE + shape
    head = min(HEAD, len(words))
    codes[:head] = FIRST_WORD + np.arange(head)
    # The share of a shape covers the words outside the head.
    total -= np.bincount(shape[:head], weights=n[:head], minlength=SHAPES)
    distinct -= np.bincount(shape[:head], minlength=SHAPES)
    order = np.argsort(words)
    return Vocabulary(
        words[order],
        n[order],
        codes[order],
        int(sum(r["n"] for r in sums)) + texts,
        int(sum(r["v"] for r in sums)) + (texts > 0),
        texts,
        total + distinct + 1,
        np.concatenate(([texts], total, n[:head])),
    )


def _encode(shared):
    """A row for each text: its symbols, what is known of it here, and its words to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        row = TaskContext.get().partitionId() << 40
        logs = np.log10(v.counts + 1.0)
        for batch in batches:
            for piece in K.slices(batch, "text"):
                words = K.scan(piece.column(2), K.SPACE)
                n = len(words.hashes)
                if len(v.words):
                    at = np.minimum(np.searchsorted(v.words, words.hashes), len(v.words) - 1)
                    known = v.words[at] == words.hashes
                else:
                    at, known = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
                codes = FIRST_SHAPE + shapes(words)
                value = np.zeros(n)
                if n and known.any():
                    codes = np.where(known, v.codes[at], codes)
                    value = np.where(known, logs[at], 0.0)
                tail = np.where(codes < FIRST_WORD, value, 0.0)
                symbols, look, often = [], [], []
                for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                    symbols.append(np.append(codes[a:b], END).astype("<u2").tobytes())
                    rare, times = np.unique(words.hashes[a:b][~known[a:b]], return_counts=True)
                    look.append(rare.view(np.int64))
                    often.append(times.astype(np.int32))
                yield pa.record_batch(
                    [
                        pa.array(np.arange(row, row + piece.num_rows)),
                        piece.column(0),
                        piece.column(1),
                        pa.array(np.diff(words.first) + 1),
                        pa.array(K.per_text(known, words.first)),
                        pa.array(K.per_text(value, words.first)),
                        pa.array(K.per_text(tail, words.first)),
                        pa.array(symbols, pa.binary()),
                        pa.array(look, pa.list_(pa.int64())),
                        pa.array(often, pa.list_(pa.int32())),
                    ],
                    ["row", "id", "held_out", "n_tokens", "n_known", "s_all", "s_tail", "symbols", "look", "often"],
                )
                row += piece.num_rows

    return run


CODES = (
    "row long, id long, held_out boolean, n_tokens long, n_known long, s_all double, s_tail double, "
    "symbols binary, look array<long>, often array<int>"
)


class Model(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state


def initial(symbols: int, states: int, counts: np.ndarray | None = None) -> Model:
    """States that emit the counted symbols (without counts all alike) times noise, and mostly stay."""
    random = np.random.default_rng(7)
    often = np.ones(symbols) if counts is None else counts + SMOOTH
    emit = often[:, None] * random.gamma(1.0, size=(symbols, states))
    move = 1 + (states - 1) * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of similar length together: their places, lengths (falling), and symbols (time x text)."""
    codes = [np.frombuffer(x, dtype="<u2") for x in column.to_pylist()]
    lengths = np.array([len(c) for c in codes], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order):
        longest = int(lengths[order[i]])
        j = i + max(1, CELLS // longest)
        # Padding of more than half the cells is not worth a larger group.
        j = min(j, i + max(1, int(np.searchsorted(-lengths[order[i:]], -longest // 2, side="right"))), len(order))
        places = order[i:j]
        table = np.zeros((longest, j - i), dtype=np.int64)
        for k, p in enumerate(places):
            table[: lengths[p], k] = codes[p]
        yield places, lengths[places], table
        i = j


def forward(model: Model, lengths: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward variables (state x token), the scales taken out of each text, the emissions, and where each time begins.

    Tokens stand by time without padding.  Variables are scaled at every ``SCALED``-th time; what is left at a text's end is its
    last scale, so a text's likelihood is the product of its scales.  The emissions of scaled tokens come divided by their scale.
    """
    alive = np.searchsorted(-lengths, -np.arange(1, len(table) + 1), side="right")
    begins = np.concatenate(([0], np.cumsum(alive)))
    emit = np.take(np.ascontiguousarray(model.emit.T), _packed(lengths, table), axis=1)
    alpha = np.empty_like(emit)
    alpha[:, : alive[0]] = model.start[:, None] * emit[:, : alive[0]]
    scale = np.ones((1 + len(table) // SCALED, table.shape[1]))
    turn = np.ascontiguousarray(model.move.T)
    at = begins.tolist()
    for t in range(1, len(table)):
        i, j = at[t], at[t + 1]
        here, told, before = alpha[:, i:j], emit[:, i:j], at[t - 1]
        np.matmul(turn, alpha[:, before : before + j - i], out=here)
        np.multiply(here, told, out=here)
        if t % SCALED == 0:
            s = here.sum(0)
            scale[t // SCALED - 1, : j - i] = s
            here /= s
            told /= s
    scale[-1] = alpha[:, begins[lengths - 1] + np.arange(len(lengths))].sum(0)
    return alpha, scale, emit, begins


def _packed(lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The symbols of a table (time x text) by time, without those beyond a text's end."""
    return table[np.arange(len(table))[:, None] < lengths[None, :]]


def expected(model: Model, lengths: np.ndarray, table: np.ndarray, out: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Adds the expected starts, moves and emissions of the texts; returns their log likelihood."""
    starts, moves, emits = out
    alpha, scale, ahead, begins = forward(model, lengths, table)
    beta = np.empty_like(alpha)
    beta[:, begins[lengths - 1] + np.arange(len(lengths))] = 1 / scale[-1]
    at = begins.tolist()
    for t in range(len(table) - 2, -1, -1):
        i, j, k = at[t], at[t + 1], at[t + 2]
        later = ahead[:, j:k]
        np.multiply(later, beta[:, j:k], out=later)
        np.matmul(model.move, later, out=beta[:, i : i + k - j])
    first = at[1]
    if len(table) > 1:
        # Before each token stands that of the same text one time earlier.
        alive = np.diff(begins)
        before = np.arange(first, at[-1]) - np.repeat(alive[:-1], alive[1:])
        moves += alpha[:, before] @ ahead[:, first:].T
    np.multiply(alpha, beta, out=alpha)
    starts += alpha[:, :first].sum(1)
    symbols = _packed(lengths, table)
    for k in range(len(alpha)):
        emits[:, k] += np.bincount(symbols, weights=alpha[k], minlength=len(emits))
    return float(np.log(scale).sum())


def _expectation(shared):
    """The sums of one task, a row for each symbol.

    Symbol -1 has the starts, -2-k the moves from state k, and the one below those the log likelihood.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        states = len(model.start)
        out = (np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit))
        seen, likelihood = False, 0.0
        for batch in batches:
            for _, lengths, table in _groups(batch.column(0)):
                likelihood += expected(model, lengths, table, out)
                seen = True
        if seen:
            keys = np.concatenate(([-1], -2 - np.arange(states + 1), np.arange(len(model.emit))))
            values = np.vstack((out[0][None], out[1] * model.move, np.full((1, states), likelihood), out[2]))
            yield pa.record_batch(
                [pa.array(keys), *[pa.array(values[:, k]) for k in range(states)]], ["symbol", *[f"g{k}" for k in range(states)]]
            )

    return run


def baum_welch(codes: DataFrame, model: Model, rounds: int | None = None) -> Model:
    """Re-estimates the model on all rows (symbols) until the likelihood settles, or for so many rounds."""
    states = len(model.start)
    columns = [f"g{k}" for k in range(states)]
    schema = "symbol long, " + ", ".join(f"{c} double" for c in columns)
    before = None
    for _ in count() if rounds is None else range(rounds):
        shared = codes.sparkSession.sparkContext.broadcast(model)
        parts = codes.select("symbols").mapInArrow(_expectation(shared), schema)
        sums = parts.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        shared.unpersist()
        if sums.empty:
            return Model(model.start, np.full_like(model.move, 1 / states), np.full_like(model.emit, 1 / len(model.emit)))
        keys, values = sums["symbol"].to_numpy(), sums[columns].to_numpy()
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
        start[:] = values[keys == -1][0]
        moves = (keys < -1) & (keys >= -1 - states)
        for key, v in zip(keys[moves], values[moves], strict=True):
            move[-2 - key] = v
        emit[keys[keys >= 0]] = values[keys >= 0]
        start, move, emit = start + SMOOTH, move + SMOOTH, emit + SMOOTH
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        likelihood = values[keys == -2 - states][0][0]
        if rounds is None and before is not None and likelihood - before < GAIN * abs(before):
            return model
        before = likelihood
    return model


def _likelihood(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sizes = shared.value
        cost = np.zeros(len(model.emit))
        cost[FIRST_SHAPE:FIRST_WORD] = np.log10(sizes)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for places, lengths, table in _groups(batch.column(1)):
                _, scale, _, _ = forward(model, lengths, table)
                # Beyond a text's end its scales are 1 and its symbols the end, which cost nothing.
                score[places] = np.log10(scale).sum(0) - cost[table].sum(0)
            yield pa.record_batch([batch.column(0), pa.array(score)], ["row", "score"])

    return run


def hmm_scores(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    parts: int = 7,
    held_out: int = 2,
    states: int = STATES,
    rounds: int | None = None,
) -> DataFrame:
    """``id``, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    docs = docs.select(
        F.col(id).cast("long").alias("id"), (fold(id, parts) == held_out).alias("held_out"), F.col(text).alias("text")
    )
    train = docs.where(~F.col("held_out"))
    counts = stage(word_counts(train), "words")
    known = vocabulary(counts, train.count())
    codes = stage(docs.mapInArrow(_encode(spark.sparkContext.broadcast(known)), CODES), "codes")
    model = baum_welch(codes.where(~F.col("held_out")), initial(len(known.symbols), states, known.symbols), rounds)
    scored = codes.select("row", "symbols").mapInArrow(
        _likelihood(spark.sparkContext.broadcast((model, known.shape_sizes))), "row long, score double"
    )
    # Scores keep the order of the stored rows, so the row's other columns meet them in a join of small rows.
    looked = (
        codes.select("row", F.explode(F.arrays_zip("look", "often")).alias("w"))
        .select("row", F.col("w.look").alias("word"), F.col("w.often").alias("often"))
        .join(counts.select("word", "n"), "word")
        .groupBy("row")
        .agg(F.sum(F.col("often") * F.log10(F.col("n") + 1.0)).alias("s"), F.sum("often").alias("k"))
    )
    rows = codes.select("row", "id", "held_out", "n_tokens", "n_known", "s_all", "s_tail").join(scored, "row")
    rows = rows.join(looked, "row", "left")
    extra = F.coalesce("s", F.lit(0.0))
    unit = float(np.log10(known.tokens + known.distinct + 1))
    return rows.select(
        F.col("id").alias(id),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0)) + F.lit(int(known.texts > 0))).cast("long").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("s_all") + extra + F.lit(float(np.log10(known.texts + 1))) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("score") + F.col("s_tail") + extra).alias("score"),
    )
