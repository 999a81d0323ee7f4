"""The time axis of a frame: which columns name a series and which order it."""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Window


@dataclass(frozen=True)
class Axis:
    """``by`` names one series, ``order`` sorts it, ``carry`` rides along unchanged.

    All operators assume one row per ``by + order``. With a date as the order
    column a window partition then holds at most 366 rows per year of history,
    however large the raw data was; for finer clocks see ``chunks``.
    """

    by: tuple = ("series_id",)
    order: tuple = ("date",)
    carry: tuple = ()

    @property
    def keys(self):
        return [*self.by, *self.order, *self.carry]

    def base(self):
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def last(self, n):
        """The current row and the n-1 before it."""
        return self.base().rowsBetween(-(n - 1), 0)

    def centred(self, n):
        """n rows around the current one; an even n reaches one further back."""
        return self.base().rowsBetween(-(n // 2), n - 1 - n // 2)

    def past(self):
        return self.base().rowsBetween(Window.unboundedPreceding, 0)

    def future(self):
        return self.base().rowsBetween(0, Window.unboundedFollowing)

    def whole(self):
        return Window.partitionBy(*self.by)

    def within(self, *extra):
        """The same axis cut further by ``extra`` columns."""
        return replace(self, by=(*self.by, *extra))

    def carrying(self, *extra):
        return replace(self, carry=(*self.carry, *extra))


DAILY = Axis()
