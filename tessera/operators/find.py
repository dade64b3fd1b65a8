"""Find: filter, sort, skip, limit and projection, in that order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

from ..functions.values import resolve
from ..plans.filters import compile_filter
from ..plans.pipeline import ordering


def find(df: DataFrame, query: dict | None = None, sort=None, skip: int = 0, limit: int = 0, projection: list[str] | None = None, dialect: str = "filter", coerce: bool = False) -> DataFrame:
    """One lazy plan; a sort with a limit becomes TakeOrderedAndProject, and filters and columns reach the scan. Limit 0 is none."""
    out = df.where(compile_filter(query, df.schema, dialect, coerce, where=True)) if query else df
    if sort:
        out = out.orderBy(*ordering(df.schema, sort))
    if skip:
        out = out.offset(skip)
    if limit:
        out = out.limit(limit)
    if projection is not None:
        out = out.select(*[resolve(df.schema, p)[0].alias(p) for p in projection if resolve(df.schema, p)])
    return out


def find_one(df: DataFrame, query: dict | None = None, sort=None, dialect: str = "filter") -> Row | None:
    return find(df, query, sort, limit=1, dialect=dialect).first()


def count(df: DataFrame, query: dict | None = None, dialect: str = "filter") -> int:
    return find(df, query, dialect=dialect).count()


def explain(df: DataFrame, query: dict | None = None, sort=None, skip: int = 0, limit: int = 0, projection: list[str] | None = None) -> dict:
    """The physical plan that Catalyst chose, beside the request."""
    plan = find(df, query, sort, skip, limit, projection)._jdf.queryExecution().executedPlan().toString()
    strategy = "id_lookup" if query and set(query) == {"_id"} else "scan"
    return {"strategy": strategy, "filter": query or {}, "skip": skip, "limit": limit, "pushed": "PushedFilters: [" in plan and "PushedFilters: []" not in plan, "plan": plan}


class Cursor:
    """Batches of a DataFrame, fetched partition by partition; rewinding runs it again unless it is persisted."""

    def __init__(self, df: DataFrame, batch_size: int = 101):
        self.df, self.batch_size = df, batch_size
        self.rewind()

    def rewind(self) -> None:
        self._rows: Iterator[Row] = self.df.toLocalIterator(prefetchPartitions=True)
        self._ahead: list[Row] = []
        self.position = 0

    def _fill(self, n: int) -> None:
        while len(self._ahead) < n:
            row = next(self._rows, None)
            if row is None:
                return
            self._ahead.append(row)

    def has_next(self) -> bool:
        self._fill(1)
        return bool(self._ahead)

    def next_batch(self) -> list[Row]:
        self._fill(self.batch_size)
        out, self._ahead = self._ahead[: self.batch_size], self._ahead[self.batch_size :]
        self.position += len(out)
        return out

    def total(self) -> int:
        return self.df.count()

    def remaining(self) -> int:
        return self.total() - self.position

    def collect_all(self) -> list[Row]:
        out = []
        while self.has_next():
            out += self.next_batch()
        return out
