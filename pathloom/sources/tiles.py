"""Vector tiles: a grid of addresses, and features out of tile bytes."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.geo import lambert_inverse

FEATURES = "z int, x int, y int, layer string, extent int, kind string, properties map<string,string>, parts array<array<struct<x:int,y:int>>>"
# Fixed values of the vector-tile format: kinds of geometry by number, and commands (any other one draws a line).
KINDS = ("Unknown", "Point", "LineString", "Polygon")
MOVE, CLOSE = 1, 7


def grid(spark: SparkSession, z: int, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """The tiles of a rectangle."""
    rows = spark.range(x0, x1 + 1).select(F.lit(z).alias("z"), F.col("id").cast("int").alias("x"))
    return rows.select("z", "x", F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("y"))


class Message:
    """The fields of an encoded message, by number, each with its values in order.

    Lengths and integers come as Python numbers, everything else as bytes.  Bytes that end in the
    middle of a field, or are of no known kind, end the message: what stood before them counts.
    """

    def __init__(self, data: bytes) -> None:
        self.values: dict[int, list[int | bytes]] = {}
        rest = memoryview(data)
        while rest:
            key, rest = self._integer(rest)
            width = {1: 8, 5: 4}.get(key & 7)
            if key & 7 == 0:
                value, rest = self._integer(rest)
            else:
                if key & 7 == 2:
                    width, rest = self._integer(rest)
                if width is None or width < 0 or width > len(rest):
                    return
                value, rest = bytes(rest[:width]), rest[width:]
            if key < 0 or (isinstance(value, int) and value < 0):
                return
            self.values.setdefault(key >> 3, []).append(value)

    @staticmethod
    def _integer(rest: memoryview) -> tuple[int, memoryview]:
        """A base-128 number, low digits first, and what follows; -1 if it breaks off."""
        size = next((k + 1 for k, digit in enumerate(rest[:10]) if digit < 0x80), 0)
        if not size:
            return -1, rest[:0]
        return sum((digit & 0x7F) << (7 * k) for k, digit in enumerate(rest[:size])), rest[size:]

    def all(self, number: int, kind: type) -> list:
        return [v for v in self.values.get(number, []) if isinstance(v, kind)]

    def last(self, number: int, kind: type, usual):
        return (self.all(number, kind) or [usual])[-1]

    def text(self, number: int) -> str:
        return self.last(number, bytes, b"").decode("utf-8", "replace")

    def packed(self, number: int) -> np.ndarray:
        """The numbers of a packed field: digits are weighted by their place behind the last number's end, and summed."""
        data = np.frombuffer(b"".join(self.all(number, bytes)), dtype=np.uint8).astype(np.int64)
        ends = np.flatnonzero(data < 0x80)
        if not len(ends):
            return np.zeros(0, dtype=np.int64)
        data = data[: ends[-1] + 1]
        starts = np.concatenate(([0], ends[:-1] + 1))
        place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
        return np.add.reduceat((data & 0x7F) << np.minimum(7 * place, 56), starts)


def _signed(n):
    """Numbers alternate in sign: 0, -1, 1, -2, 2, ..."""
    return (n >> 1) ^ -(n & 1)


#: How a property's value is written, by the field that holds it.
SHOWN: dict[int, Callable] = {
    1: lambda v: v.decode("utf-8", "replace"),
    2: lambda v: repr(struct.unpack("<f", v)[0]),
    3: lambda v: repr(struct.unpack("<d", v)[0]),
    4: lambda v: str(v - (1 << 64) if v >> 63 else v),
    5: str,
    6: lambda v: str(_signed(v)),
    7: lambda v: "true" if v else "false",
}


def _shown(data: bytes) -> str | None:
    for number, values in Message(data).values.items():
        if number in SHOWN and isinstance(values[-1], bytes) == (number <= 3):
            return SHOWN[number](values[-1])
    return None


def paths(commands: np.ndarray) -> list[list[tuple[int, int]]]:
    """Lines of a geometry's command stream; closing repeats the first point.  A stream that breaks off ends the last line."""
    out: list[list[tuple[int, int]]] = []
    x = y = k = 0
    while k < len(commands):
        command, count = int(commands[k]) & 7, int(commands[k]) >> 3
        k += 1
        if command == CLOSE:
            if out:
                out[-1].append(out[-1][0])
            continue
        moves = _signed(commands[k : k + 2 * count])
        k += 2 * count
        for dx, dy in zip(moves[0::2].tolist(), moves[1::2].tolist(), strict=False):
            x, y = x + dx, y + dy
            if command == MOVE or not out:
                out.append([])
            out[-1].append((x, y))
    return out


class Layer:
    """A named layer: its keys and values, which its features refer to by place."""

    def __init__(self, data: bytes) -> None:
        read = Message(data)
        self.name, self.extent = read.text(1), read.last(5, int, 4096)
        self.keys = [k.decode("utf-8", "replace") for k in read.all(3, bytes)]
        self.shown = [_shown(v) for v in read.all(4, bytes)]
        self.encoded = read.all(2, bytes)

    def features(self) -> Iterator[tuple[str, dict[str, str], list[list[tuple[int, int]]]]]:
        """(kind, properties, parts) of each feature; references to what is not there are passed over."""
        for data in self.encoded:
            read = Message(data)
            tags, kind = read.packed(2).tolist(), read.last(3, int, 0)
            pairs = [(k, v) for k, v in zip(tags[0::2], tags[1::2], strict=False) if k < len(self.keys) and v < len(self.shown)]
            named = {self.keys[k]: self.shown[v] for k, v in pairs if self.shown[v] is not None}
            yield KINDS[kind if kind < len(KINDS) else 0], named, paths(read.packed(4))


def decode(data: bytes) -> Iterator[tuple[str, int, str, dict[str, str], list[list[tuple[int, int]]]]]:
    """(layer, extent, kind, properties, parts) of each feature of a tile."""
    for encoded in Message(data).all(3, bytes):
        layer = Layer(encoded)
        for feature in layer.features():
            yield layer.name, layer.extent, *feature


def features(tiles: DataFrame) -> DataFrame:
    """Of tiles (z, x, y, content; null or empty content for an absent tile), a row for each feature."""

    def run(batches):
        import pandas as pd

        names = ["z", "x", "y", "layer", "extent", "kind", "properties", "parts"]
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if not r.content:
                    continue
                for layer, extent, kind, named, lines in decode(bytes(r.content)):
                    out.append((r.z, r.x, r.y, layer, extent, kind, named, [[{"x": a, "y": b} for a, b in line] for line in lines]))
            yield pd.DataFrame(out, columns=names)

    return tiles.select("z", "x", "y", "content").mapInPandas(run, FEATURES)


def positions(parts: Column, z: Column, x: Column, y: Column, extent: Column, *, origin: tuple[float, float], tile_ft: float, shift: tuple[float, float] = (0.0, 0.0)) -> Column:
    """Tile parts as arrays of (lng, lat): a share of the tile, state-plane feet, degrees, and a constant datum shift, to seven digits.

    ``origin``: feet of the grid's upper left corner; ``tile_ft``: side of a tile at zoom 0.
    """
    side = F.lit(tile_ft) / F.pow(F.lit(2.0), z)

    def place(p: Column) -> Column:
        degrees = lambert_inverse(F.lit(origin[0]) + (x + p["x"] / extent) * side, F.lit(origin[1]) - (y + p["y"] / extent) * side)
        return F.struct(
            F.bround(degrees["lng"] + shift[0], 7).alias("lng"), F.bround(degrees["lat"] + shift[1], 7).alias("lat")
        )

    return F.transform(parts, lambda line: F.transform(line, place))


def distinct_shapes(rows: DataFrame) -> DataFrame:
    """Features of a layer that are drawn in several tiles count once: the first by tile."""
    first = F.min(F.struct(*[c for c in ("z", "x", "y", "kind") if c in rows.columns]))
    return rows.groupBy("layer", "positions").agg(first.alias("f")).select("layer", "f.*", "positions")


def geometry_kind(kind: Column, parts: Column) -> Column:
    """Closed rings are polygons; single points are points, several are a multi-point."""
    first = F.get(parts, F.lit(0))
    closed = (F.size(first) > 3) & (F.get(first, F.lit(0)) == F.element_at(first, -1))
    return (
        F.when(kind == "Point", F.when(F.size(parts) > 1, "MultiPoint").otherwise("Point"))
        .when(closed, "Polygon")
        .when(F.size(parts) > 1, "MultiLineString")
        .otherwise("LineString")
    )
