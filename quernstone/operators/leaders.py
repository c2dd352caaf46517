"""Order-dependent de-duplication whose rules are not equality: leaders with tolerances, and the first of several keys.

Rows of a group stream through their task in order, many groups to a batch; only the kept rows of the group at hand are held,
with an index that leaves few of them to compare.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def _streamed(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object]) -> DataFrame:
    """Send each group's rows, in order, to a new ``start()``, which has ``add(row)`` and ``kept``."""
    schema, rows = to_arrow_schema(df.schema), df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        now, group = None, start()
        for batch in batches:
            done: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[c] for c in keys)
                if key != now:
                    done += group.kept
                    now, group = key, start()
                group.add(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if group.kept:
            yield pa.RecordBatch.from_pylist(group.kept, schema=schema)

    return rows.mapInArrow(run, df.schema)


def _more_complete(kept: dict, row: dict, longest: tuple[str, ...]) -> None:
    """Fill what the kept row lacks; of the texts ``longest`` the longer stays."""
    for c, v in row.items():
        if c in longest and v is not None and len(v) > len(kept[c] or ""):
            kept[c] = v
        elif kept[c] in (None, []) and v is not None:
            kept[c] = v


def _completeness(row: dict) -> int:
    """How much a row says: its filled columns, a list for each item."""
    return sum(len(v) if isinstance(v, list) else 1 for v in row.values() if v not in (None, ""))


class _Leaders:
    """Kept rows of a group by region and number of sizes: the first that a row agrees with takes it up."""

    def __init__(self, region: str, sizes: str, tolerance: float, longest: tuple[str, ...], own: tuple[str, ...]):
        self.region, self.sizes, self.tolerance, self.longest, self.own = region, sizes, tolerance, longest, own
        self.kept: list[dict] = []
        self.open: list[int] = []  # rows without sizes or region, which may agree with any
        self.by_cell: dict[tuple, list[int]] = {}

    def _cell(self, row: dict) -> tuple | None:
        size = row[self.sizes] or []
        return (row[self.region], len(size), round(size[0] // (2 * self.tolerance))) if size and row[self.region] is not None else None

    def _file(self, i: int) -> None:
        cell = self._cell(self.kept[i])
        (self.open if cell is None else self.by_cell.setdefault(cell, [])).append(i)

    def _near(self, row: dict):
        """Places of kept rows that may agree: all for a row without region or size, else the open ones and three cells."""
        cell = self._cell(row)
        if cell is None:
            return range(len(self.kept))
        return sorted({*self.open, *(i for d in (-1, 0, 1) for i in self.by_cell.get((*cell[:2], cell[2] + d), ()))})

    def _agrees(self, a: dict, b: dict) -> bool:
        if a[self.region] is not None and b[self.region] is not None and a[self.region] != b[self.region]:
            return False
        x, y = a[self.sizes] or [], b[self.sizes] or []
        return not x or not y or len(x) == len(y) and all(abs(p - q) <= self.tolerance for p, q in zip(x, y, strict=True))

    def add(self, row: dict) -> None:
        for i in self._near(row):
            if self._agrees(self.kept[i], row):
                kept, before = self.kept[i], self._cell(self.kept[i])
                if _completeness(row) > _completeness(kept):
                    row, kept = kept, {**row, **{c: kept[c] for c in self.own}}
                _more_complete(kept, row, self.longest)
                self.kept[i] = kept
                if self._cell(kept) != before:
                    (self.open if before is None else self.by_cell[before]).remove(i)
                    self._file(i)
                return
        self.kept.append(row)
        self._file(len(self.kept) - 1)


def fold_findings(findings: DataFrame, keys: list[str], order: list[str], region: str = "region", sizes: str = "sizes", tolerance: float = 0.5, longest: tuple[str, ...] = ()) -> DataFrame:
    """One row for each finding that a group describes several times; columns as in ``findings``.

    Rows of equal ``keys`` (report, organ, type, side) are one finding if their regions don't contradict and their sizes, largest first and as many,
    are within ``tolerance`` of each other; a null region and empty or null sizes agree with any. Rows are taken by ``order`` and each joins the
    first kept row that it agrees with. Of the two the one that says more stays (on a tie the kept one), with what it lacks from the other, so the
    sizes and the region that later rows are compared with change; it keeps the place (``order``) of the first, and of the columns ``longest``
    the longer text. Two rows that a third agrees with may stay apart, so connected components would give another answer.
    """
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    return _streamed(findings, keys, order, lambda: _Leaders(region, sizes, tolerance, longest, tuple(order)))


class _FirstKey:
    """Kept rows of a group and a map from keys to them; a row belongs to the first of its keys that is known."""

    def __init__(self, key: str, longest: tuple[str, ...]):
        self.key, self.longest = key, longest
        self.kept: list[dict] = []
        self.known: dict[str, int] = {}

    def add(self, row: dict) -> None:
        keys = row[self.key] or []
        at = next((self.known[k] for k in keys if k in self.known), None)
        if at is None:
            self.kept.append(row)
            at = len(self.kept) - 1
        else:
            kept = self.kept[at]
            own = kept[self.key] or []
            _more_complete(kept, row, self.longest)
            kept[self.key] = own + [k for k in keys if k not in own]
        for k in keys:
            self.known[k] = at


def fold_by_first_key(rows: DataFrame, keys: list[str], order: list[str], source_keys: str, longest: tuple[str, ...] = ()) -> DataFrame:
    """One row for each source that a group reports several times; columns as in ``rows``.

    Each row has a list ``source_keys``. Rows of equal ``keys`` are taken by ``order``; a row joins the kept row to which the first of its keys that is
    known leads, fills what that one lacks, and from then on all its keys lead there, also those that led elsewhere. So kept rows are never
    merged with each other, as connected components would. A row without keys, or with new ones only, is kept. A kept row's list has
    the keys of the rows that joined it, each once.
    """
    return _streamed(rows, keys, order, lambda: _FirstKey(source_keys, longest))
