"""A space-filling curve over longitude and latitude: rows near each other get near keys.

A key interleaves the bits of the two coordinates, so a box is a few ranges of keys. Files sorted by the key hold small
areas, and a filter by key ranges prunes files and row groups in both directions.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of each coordinate; cells of about 600 m by 300 m.
BITS = 16
Box = tuple[float, float, float, float]


def _step(v: float, low: float, width: float) -> int:
    return min(max(int((v - low) / width * (1 << BITS)), 0), (1 << BITS) - 1)


def _spread(x: Column) -> Column:
    """The bits of a number below 2 ** 16, each followed by a zero bit above it."""
    for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
    return x


def curve_key(lon: str, lat: str) -> Column:
    """The key of a place; null for a place without both coordinates."""
    last = F.lit((1 << BITS) - 1).cast("long")
    cell = lambda c, low, width: F.least(last, F.greatest(F.lit(0).cast("long"), F.floor((F.col(c) - low) / width * (1 << BITS))))
    key = _spread(cell(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(cell(lat, -90.0, 180.0)), 1))
    return F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(lon) & ~F.isnan(lat), key)


def box_ranges(box: Box, most: int = 32) -> list[tuple[int, int]]:
    """At most ``most`` ranges of keys that cover a box (west, south, east, north), ends included.

    Squares of the curve are split, the largest first, until they are all in the box or enough; then ranges with the
    smallest gaps between them are joined.
    """
    x0, x1 = _step(box[0], -180, 360), _step(box[2], -180, 360)
    y0, y1 = _step(box[1], -90, 180), _step(box[3], -90, 180)
    todo, out = [(0, 0, 0)], []  # level, column, row
    while todo:
        nxt = []
        for level, x, y in todo:
            size = 1 << (BITS - level)
            left, low = x * size, y * size
            if left > x1 or left + size - 1 < x0 or low > y1 or low + size - 1 < y0:
                continue
            inside = left >= x0 and left + size - 1 <= x1 and low >= y0 and low + size - 1 <= y1
            if inside or size == 1 or len(out) + len(todo) > 8 * most:
                first = sum(((left >> i & 1) << 2 * i) | ((low >> i & 1) << 2 * i + 1) for i in range(BITS))
                out.append((first, first + size * size - 1))
            else:
                nxt += [(level + 1, 2 * x + a, 2 * y + b) for a in (0, 1) for b in (0, 1)]
        todo = nxt
    return joined(out, most)


def joined(ranges: Iterable[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one, and the smallest gaps closed until ``most`` are left."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    while len(out) > most:
        i = min(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
        out[i - 1][1] = out[i][1]
        del out[i]
    return [(a, b) for a, b in out]


def in_ranges(key: str, ranges: list[tuple[int, int]]) -> Column:
    """A predicate of plain comparisons, which reaches the Parquet scan."""
    return reduce(lambda p, q: p | q, [F.col(key).between(a, b) for a, b in ranges], F.lit(False))


def path_boxes(points: list[tuple[float, float]], margin_m: float, step_m: float = 5000.0) -> list[Box]:
    """Boxes around the legs of a path (lon, lat), widened by a margin; a long leg has one box for each ``step_m``."""
    from math import ceil, cos, hypot, radians

    metres = 111_194.9
    out = []
    for (ax, ay), (bx, by) in zip(points, points[1:] or points, strict=False):
        shrink = max(min(cos(radians(ay)), cos(radians(by))), 0.01)
        n = max(1, ceil(hypot((bx - ax) * shrink, by - ay) * metres / step_m))
        for i in range(n):
            (px, py), (qx, qy) = ((ax + (bx - ax) * t, ay + (by - ay) * t) for t in (i / n, (i + 1) / n))
            dx, dy = margin_m / metres / shrink, margin_m / metres
            out.append((min(px, qx) - dx, min(py, qy) - dy, max(px, qx) + dx, max(py, qy) + dy))
    return out
