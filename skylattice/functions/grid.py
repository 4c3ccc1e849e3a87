"""The constellation grid: ``planes`` rings of ``slots`` satellites, numbered plane by plane.

The slot axis is cyclic; the plane axis is not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constellation:
    planes: int
    slots: int

    @property
    def size(self) -> int:
        return self.planes * self.slots


SMALL = Constellation(10, 10)
LARGE = Constellation(18, 36)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plane(node: Column | str, c: Constellation) -> Column:
    return F.floor(_col(node) / c.slots).cast("int")


def slot(node: Column | str, c: Constellation) -> Column:
    return (_col(node) % c.slots).cast("int")


def node_id(x: Column | str, y: Column | str, c: Constellation) -> Column:
    return (_col(x) * c.slots + _col(y)).cast("int")


def to_region_frame(y: Column | str, offset: Column | str, c: Constellation) -> Column:
    """Slot in the frame that moves with the reference region."""
    return F.pmod(_col(y) - _col(offset) + (c.slots - 1), F.lit(c.slots)).cast("int")


def to_raw_frame(y: Column | str, offset: Column | str, c: Constellation) -> Column:
    """The inverse of ``to_region_frame``."""
    return F.pmod(_col(y) + _col(offset) + 1, F.lit(c.slots)).cast("int")


def same_plane(a: Column | str, b: Column | str, c: Constellation) -> Column:
    return plane(a, c) == plane(b, c)


def is_curved(a: Column | str, b: Column | str, c: Constellation) -> Column:
    """Links along one row that skip planes are drawn as arcs."""
    return (slot(a, c) == slot(b, c)) & (F.abs(plane(a, c) - plane(b, c)) > 1)


def clipped(value: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(_col(value), F.lit(low)), F.lit(high))
