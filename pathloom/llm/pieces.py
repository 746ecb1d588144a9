"""SentencePiece encoding and decoding with a given vocabulary.

A text with a blank before it is cut into units: blanks followed by non-blanks, and line
ends.  No piece of the vocabulary crosses a unit's end, so the best segmentation of the text
is that of its units.  Distinct units of equal length advance together through a numpy Viterbi: the
hashes of all substrings that end at a place probe the sorted piece keys, and the maximum
over them gives the score and the backpointer of the place for all units at once.

Scores are log probabilities by Zipf's law of the piece's rank, since the vocabulary's own
scores are merge ranks and not log probabilities.  Among equal scores the longest last piece
wins.  A character without a piece becomes its UTF-8 bytes, and so does a unit whose pieces do
not spell it (a collision of hashes).  Nothing is trained.

Defined results: null text gives null pieces and back; the empty text has no pieces; any
other text comes back exactly, literal piece markers, blanks and line ends included; units
of any length work in bounded steps; repeated rows are encoded one by one; an empty table
gives an empty result; other columns are carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernels as K

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIT = re.compile(" *[^ \n]+| +|\n")
#: Between a character and a blank or line end after it, a unit ends.
UNIT_END = re.compile("(?<=[^ ])[ \n]")
#: Bytes of the units that a worker remembers, and about what an entry takes besides its characters.
REMEMBERED_BYTES = 16 << 20
ENTRY_BYTES = 220
#: Units that are held at a time, characters of a text that are cut at a time, and cells (unit x place) of one Viterbi.
UNITS = 1 << 17
SPAN = 1 << 19
CELLS = 1 << 17
#: Powers of the multiplier that are kept; a longer unit computes its own.
KEPT_POWERS = 1 << 12
#: Bits of a hash that a bitmap tests before the sorted keys are searched.
MAP_BITS = 20
MULTIPLIER = 0x9E3779B97F4A7C15
UNKNOWN = -10.0
#: Rows that are decoded at a time.
DECODED = 256


class Vocabulary(NamedTuple):
    """Pieces with blanks for markers: bytes of each id, and sorted keys with ids and scores."""

    raw: list[bytes]
    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    seen: np.ndarray
    longest: int
    byte_ids: list[int]
    unknown: float


def _prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Of rows of code points, the prefix sums from which substrings take their hashes."""
    up = _powers(codes.shape[1])[0]
    sums = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: codes.shape[1]], axis=1, out=sums[:, 1:])
    return sums


def _slots(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - MAP_BITS)


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
        table = np.full(n, base, dtype=np.uint64)
        table[0] = 1
        with np.errstate(over="ignore"):
            tables.append(np.multiply.accumulate(table))
    return tables[0], tables[1]


_kept_powers = _made_powers(KEPT_POWERS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _kept_powers if n <= KEPT_POWERS else _made_powers(n)


def _codes(units: list[str]) -> np.ndarray:
    return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(units), -1)


def load(model: str = MODEL) -> Vocabulary:
    """Reads the vocabulary file, on the driver."""
    from sentencepiece import SentencePieceProcessor

    given = SentencePieceProcessor(model_file=model)
    size = given.vocab_size()
    raw: list[bytes] = []
    byte_ids = [0] * 256
    plain: list[tuple[str, int]] = []
    for i in range(size):
        piece = given.id_to_piece(i)
        if given.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            raw.append(bytes([value]))
        elif given.is_control(i) or given.is_unknown(i) or given.is_unused(i):
            raw.append(b"")
        else:
            text = piece.replace(MARK, " ")
            raw.append(text.encode())
            plain.append((text, i))
    if any(" " in text.lstrip(" ") or "\n" in text for text, _ in plain):
        raise ValueError("a piece crosses the end of a unit")
    keys = np.zeros(len(plain), dtype=np.uint64)
    ids = np.array([i for _, i in plain], dtype=np.int32)
    # Rank by the file's own scores, best first.
    rank = np.empty(len(plain))
    rank[np.lexsort((ids, [-given.get_score(int(i)) for i in ids]))] = np.arange(len(plain))
    scores = -np.log(rank + 2) - np.log(np.log(size))
    lengths = np.array([len(t) for t, _ in plain])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        keys[at] = _prefix_sums(_codes([plain[k][0] for k in at]))[:, -1]
    seen = np.zeros(1 << MAP_BITS, dtype=bool)
    seen[_slots(keys)] = True
    order = np.argsort(keys)
    worst = float(scores.min()) + UNKNOWN
    return Vocabulary(raw, keys[order], ids[order], scores[order], seen, int(lengths.max()), byte_ids, worst)


def viterbi(units: list[str], v: Vocabulary) -> list[bytes]:
    """Piece ids, as little-endian 32-bit integers, of units of one length."""
    codes = _codes(units)
    m, n = codes.shape
    sums, down = _prefix_sums(codes), _powers(n + 1)[1]
    best = np.zeros((m, n + 1))
    back = np.zeros((m, n + 1), dtype=np.int8)
    piece = np.full((m, n + 1), -1, dtype=np.int32)
    rows = np.arange(m)
    for end in range(1, n + 1):
        widths = np.arange(min(end, v.longest), 0, -1)  # the longest first, which wins ties
        with np.errstate(over="ignore"):
            h = (sums[:, end, None] - sums[:, end - widths]) * down[end - widths]
        total = np.full(h.shape, -np.inf)
        which = np.full(h.shape, -1, dtype=np.int32)
        maybe = np.flatnonzero(v.seen[_slots(h)])
        probes = h.ravel()[maybe]
        at = np.minimum(np.searchsorted(v.keys, probes), len(v.keys) - 1)
        hit = v.keys[at] == probes
        total.ravel()[maybe[hit]] = v.scores[at[hit]]
        which.ravel()[maybe[hit]] = v.ids[at[hit]]
        total[:, -1] = np.where(which[:, -1] >= 0, total[:, -1], v.unknown)
        total += best[:, end - widths]
        pick = total.argmax(1)
        best[:, end] = total[rows, pick]
        back[:, end] = widths[pick]
        piece[:, end] = which[rows, pick]
    # All units step back together, from their ends; the table's columns fill from the right.
    place = np.full(m, n)
    out = np.full((m, n), -2, dtype=np.int32)
    ends = np.zeros((m, n), dtype=np.int32)
    at = n
    while place.any():
        at -= 1
        out[:, at] = np.where(place > 0, piece[rows, place], -2)
        ends[:, at] = place
        place = place - back[rows, place]
    out, ends = out[:, at:], ends[:, at:]
    good = out >= 0
    sizes = 4 * np.concatenate(([0], np.cumsum(good.sum(1))))
    flat = out[good].astype("<i4").tobytes()
    made = [flat[a:b] for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]
    for k in np.flatnonzero((out == -1).any(1)):
        row: list[int] = []
        for i, e in zip(out[k].tolist(), ends[k].tolist(), strict=True):
            if i >= 0:
                row.append(i)
            elif i == -1:
                row += [v.byte_ids[b] for b in units[k][e - 1].encode()]
        made[k] = np.array(row, dtype="<i4").tobytes()
    # A hit is one of hashes; the pieces must spell the unit.
    for k, unit in enumerate(units):
        if b"".join([v.raw[i] for i in np.frombuffer(made[k], "<i4").tolist()]) != unit.encode():
            made[k] = np.array([v.byte_ids[b] for b in unit.encode()], dtype="<i4").tobytes()
    return made


class Encoder:
    """Encodes texts; remembers the units it has met, within a bound of bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, units: set[str]) -> None:
        if self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        by_length: dict[int, list[str]] = {}
        for unit in units - self.known.keys():
            by_length.setdefault(len(unit), []).append(unit)
            self.held += ENTRY_BYTES + 8 * len(unit)
        for length, alike in by_length.items():
            step = max(1, CELLS // length)
            for i in range(0, len(alike), step):
                part = alike[i : i + step]
                self.known.update(zip(part, viterbi(part, self.vocabulary), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        made: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            nonlocal waiting, size
            self._learn({u for _, units in waiting for u in units})
            for k, units in waiting:
                made[k].append(b"".join(map(self.known.__getitem__, units)))
            waiting, size = [], 0

        for k, text in enumerate(texts):
            for units in _unit_lists(" " + text) if text else ():
                waiting.append((k, units))
                size += len(units)
                if size >= UNITS:
                    flush()
        flush()
        return [None if t is None else b"".join(m) for t, m in zip(texts, made, strict=True)]


def _unit_lists(text: str) -> Iterator[list[str]]:
    """The units of a text, in lists of about SPAN characters that end where a unit ends."""
    at = 0
    while at < len(text):
        cut = UNIT_END.search(text, at + SPAN)
        end = cut.start() if cut else len(text)
        yield UNIT.findall(text, at, end)
        at = end


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    data = b"".join([v.raw[i] for i in ids])
    return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([*batch.columns, column], [*batch.schema.names, name])


def _id_lists(rows: list[bytes | None]) -> pa.Array:
    sizes = [0 if r is None else len(r) // 4 for r in rows]
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    values = pa.array(np.frombuffer(b"".join(r or b"" for r in rows), dtype="<i4").astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([r is None for r in rows]))


def _texts(rows: list[bytes | None], v: Vocabulary) -> pa.Array:
    return pa.array([None if r is None else decode_ids(np.frombuffer(r, "<i4").tolist(), v) for r in rows], pa.string())


def encode(
    docs: DataFrame, *, text: str = "text", ids: str = "piece_ids", decoded: str | None = None, model: str = MODEL
) -> DataFrame:
    """``docs`` with the piece ids of each text and, if ``decoded`` names a column, the text that these ids decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    rest = [c for c in docs.columns if c not in (ids, decoded)]
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for piece in K.slices(batch, text):
                found = encoder.encode(piece.column(at).to_pylist())
                out = _with_column(piece, ids, _id_lists(found))
                yield _with_column(out, decoded, _texts(found, shared.value)) if decoded else out

    df = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = df.withColumn(ids, F.array().cast("array<int>")).schema
    schema[ids].nullable = True
    if decoded:
        schema = schema.add(decoded, "string")
    return df.mapInArrow(run, schema)


def decode(encoded: DataFrame, *, ids: str = "piece_ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its piece ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))
    rest = [c for c in encoded.columns if c != text]
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, DECODED):
                batch = whole.slice(i, DECODED)
                texts = [None if x is None else decode_ids(x, v) for x in batch.column(at).to_pylist()]
                yield _with_column(batch, text, pa.array(texts, pa.string()))

    df = encoded.select(*[F.col(f"`{c}`") for c in rest])
    return df.mapInArrow(run, df.withColumn(text, F.lit(None).cast("string")).schema)
