"""Paging through a table of points in order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

from ..schema import Order


class PointPages:
    """Pages of a table, one after the other; only the page at hand and one partition are on the driver."""

    def __init__(self, df: DataFrame, order: Order, rows: int = 10_000):
        if rows < 1:
            raise ValueError("a page has at least one row")
        self.df, self.order, self.rows = df, order, rows
        self.reset()

    def reset(self) -> None:
        """Back to the first page."""
        self._source: Iterator[Row] | None = None
        self._next: list[Row] | None = None
        self.yielded = 0

    def _page(self) -> list[Row]:
        if self._source is None:
            self._source = self.df.orderBy(*self.order.by()).toLocalIterator(prefetchPartitions=True)
        return [r for _, r in zip(range(self.rows), self._source, strict=False)]

    def has_next(self) -> bool:
        if self._next is None:
            self._next = self._page()
        return bool(self._next)

    def yield_page(self) -> list[Row] | None:
        """The next page, or None after the last."""
        if not self.has_next():
            return None
        page, self._next = self._next, None
        self.yielded += len(page)
        return page

    def __iter__(self) -> Iterator[list[Row]]:
        while (page := self.yield_page()) is not None:
            yield page

    def collect(self, max_points: int | None = None) -> DataFrame:
        """All points, or the first so many."""
        return self.df if max_points is None else self.df.orderBy(*self.order.by()).limit(max_points)

    def progress(self) -> dict[str, int]:
        total = self.df.count()
        return {"total_points": total, "yielded": self.yielded, "remaining": total - self.yielded, "page_rows": self.rows}

    def __repr__(self) -> str:
        return f"PointPages({self.yielded} points yielded, {self.rows} a page)"
