"""A paged feature service as a Spark data source.

The row count is asked once; each partition reads its own range of offsets, or of object
ids where the service cannot skip rows, page by page.  Filters and the column list are sent to the service.  The transport is a callable named by its import
path, so that tests need no network.
"""

from __future__ import annotations

import importlib
import json
import math
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual, Not,
)
from pyspark.sql.types import StructType

RETRIES = 4


def http_get(url: str, query: dict[str, Any]) -> dict:
    """GET as JSON; server errors are tried again with growing pauses, client errors are not."""
    full = f"{url}?{urllib.parse.urlencode(query)}"
    for attempt in range(RETRIES):
        try:
            with urllib.request.urlopen(full, timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as error:
            if error.code < 500 or attempt == RETRIES - 1:
                raise
        except urllib.error.URLError:
            if attempt == RETRIES - 1:
                raise
        time.sleep(2**attempt)
    raise RuntimeError("not reached")


def split_service(url: str) -> tuple[str, str]:
    """Service root and layer number of a layer's address."""
    root, _, layer = url.rstrip("/").rpartition("/")
    return (root, layer) if layer.isdigit() else (url.rstrip("/"), "0")


class PagedSource(DataSource):
    """``spark.read.format("paged").schema(...).option("url", ...).load()``.

    Options: url, pageSize (1000), partitionRows (100000), idColumn (set it for services
    without offsets), where, orWhere (a wider condition in place of ``where`` if no row meets that), transport (``module:function``).
    A page may hold fewer rows than were asked for; a range that ends with other than the number of rows that the
    service counts in it is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


class _Range(InputPartition):
    def __init__(self, start: int, end: int, where: str) -> None:
        self.start, self.end, self.where = start, end, where


def literal(value: Any) -> str | None:
    """A value in the service's language; None if it has no certain form there."""
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int | Decimal):
        return str(value)
    if isinstance(value, float):
        return repr(value) if math.isfinite(value) else None
    if isinstance(value, date) and not isinstance(value, datetime):
        return f"DATE '{value.isoformat()}'"
    return None


def condition(f: Filter) -> str | None:
    """A filter in the service's language, which has three truth values as Spark has; None if it is left to Spark alone."""
    if isinstance(f, Not):
        if isinstance(f.child, EqualNullSafe):
            met = condition(EqualTo(f.child.attribute, f.child.value))
            return met and f"({f.child.attribute[0]} IS NULL OR NOT ({met}))"
        met = condition(f.child)
        return met and f"NOT ({met})"
    attribute = getattr(f, "attribute", ())
    if len(attribute) != 1 or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", attribute[0]):
        return None
    name = attribute[0]
    if isinstance(f, IsNull | IsNotNull):
        return f"{name} IS NULL" if isinstance(f, IsNull) else f"{name} IS NOT NULL"
    if isinstance(f, In):
        values = [literal(v) for v in f.value]
        return None if None in values or not values else f"{name} IN ({', '.join(values)})"
    value = literal(f.value) if isinstance(f, EqualTo | EqualNullSafe | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) else None
    if value is None:
        return None
    if isinstance(f, EqualTo | EqualNullSafe):
        return f"{name} = {value}"
    # Services order texts in their own ways.
    signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
    return None if isinstance(f.value, str) else f"{name} {signs[type(f)]} {value}"


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns = [f.name for f in schema.fields]
        self.options = {k.lower(): v for k, v in options.items()}
        self.pushed: list[str] = []

    def _ask(self, where: str, **query: Any) -> dict:
        module, _, function = self.options.get("transport", "pathloom.sources.paged:http_get").partition(":")
        get = getattr(importlib.import_module(module), function)
        return get(self.options["url"], {"where": where, "f": "json", **query})

    def _all(self, first: str | None) -> str:
        return " AND ".join(([f"({first})"] if first else []) + self.pushed) or "1=1"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows what the service sends; Spark looks at every filter again."""
        for f in filters:
            if met := condition(f):
                self.pushed.append(met)
            yield f

    def _count(self, where: str) -> int:
        return self._ask(where, returnCountOnly="true")["count"]

    def partitions(self) -> list[_Range]:
        step, first = int(self.options.get("partitionrows", 100_000)), self.options.get("where")
        # The wider condition stands in for the first on the whole table, whatever else Spark asks for.
        if first and "orwhere" in self.options and not self._count(first):
            first = self.options["orwhere"]
        where = self._all(first)
        if not (count := self._count(where)):
            return [_Range(0, 0, where)]
        low, high = 0, count
        if "idcolumn" in self.options:
            answer = self._ask(where, returnIdRange="true", idColumn=self.options["idcolumn"])
            low, high = answer["min"], answer["max"] + 1
        return [_Range(a, min(a + step, high), where) for a in range(low, high, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if partition.start >= partition.end:
            return
        by_id = self.options.get("idcolumn")
        pages = self._by_id(partition, by_id) if by_id else self._by_offset(partition)
        for row in pages:
            yield tuple(row.get(c) for c in self.columns)

    def _by_offset(self, partition: _Range) -> Iterator[dict]:
        size, at = int(self.options.get("pagesize", 1000)), partition.start
        while at < partition.end:
            rows = self._ask(partition.where, outFields=",".join(self.columns), resultOffset=at, resultRecordCount=min(size, partition.end - at))["features"]
            if not rows:
                raise RuntimeError(f"the service ends at row {at}, before {partition.end}")
            yield from (r["attributes"] for r in rows)
            at += len(rows)

    def _by_id(self, partition: _Range, by_id: str) -> Iterator[dict]:
        """Ids in ``size`` steps; a page that the service cut short is followed from its last id."""
        size, at, got = int(self.options.get("pagesize", 1000)), partition.start, 0
        inside = f"{partition.where} AND {by_id} >= {partition.start} AND {by_id} < {partition.end}"
        fields = self.columns if by_id in self.columns else [*self.columns, by_id]
        while at < partition.end:
            to = min(at + size, partition.end)
            answer = self._ask(partition.where, outFields=",".join(fields), idColumn=by_id, fromId=at, toId=to, orderByFields=by_id)
            rows = [r["attributes"] for r in answer["features"]]
            yield from rows
            got += len(rows)
            cut = answer.get("exceededTransferLimit") and rows
            at = max(r[by_id] for r in rows) + 1 if cut else to
        if got != (want := self._count(inside)):
            raise RuntimeError(f"the service sent {got} rows of {want} with {by_id} from {partition.start} to {partition.end}")
