"""Polygons as arrays of structs (x, y), closed from the last point to the first. Folds over the arrays, without exploding them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _edges(polygon: Column) -> Column:
    """Structs (a, b) of the points at the ends of each side; none of an empty polygon."""
    after = F.concat(F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, F.lit(1), F.lit(1)))
    return F.zip_with(polygon, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def twice_area(polygon: Column) -> Column:
    """Twice the signed area (shoelace), positive if y turns to the left of x; 0 of fewer than three points."""
    wide = lambda c: c.cast("double")
    crosses = F.transform(_edges(polygon), lambda e: wide(e["a"]["x"]) * wide(e["b"]["y"]) - wide(e["b"]["x"]) * wide(e["a"]["y"]))
    return F.aggregate(crosses, F.lit(0.0), lambda total, c: total + c)


def area(polygon: Column) -> Column:
    return F.abs(twice_area(polygon)) / 2


def bounds(polygon: Column) -> dict[str, Column]:
    """Sides of the box around a polygon; null of an empty one."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def holds(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside: a ray to the right crosses an odd number of sides. Points on a left or lower side are inside,
    on a right or upper one outside, so that of polygons that share a side one holds its points. Fewer than three points hold none."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]).cast("double") * (b["x"] - a["x"]) / F.when(spans, b["y"] - a["y"])  # not divided where the side is level
        return F.when(spans & (x < at), 1).otherwise(0)

    crossed = F.aggregate(_edges(polygon), F.lit(0), lambda n, e: n + crosses(e))
    return (F.size(polygon) >= 3) & (crossed % 2 == 1)
