"""Places of a network's layers as blocks in a row, in oblique projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from .networks import whole_number
from .ranking import with_island

RUN = math.cos(math.radians(V.FIGURE_ANGLE)) * V.FIGURE_DEPTH
RISE = math.sin(math.radians(V.FIGURE_ANGLE)) * V.FIGURE_DEPTH


def _between(value: Column, bounds) -> Column:
    """A size that grows with the logarithm of a number between two bounds, or the one size that all have."""
    if not isinstance(bounds, tuple):
        return F.lit(float(bounds))
    low, high = map(float, bounds)
    return F.when(value > 0, low + (high - low) * F.least(F.lit(1.0), F.log2(value + 1) / 10)).otherwise(low)


def sizes(shape: Column, params: Column, count: Column) -> Column:
    """(h, d, w) of a layer from the first that is known: its output's shape, a number of units, its parameters."""
    n = F.size(F.coalesce(shape, F.array().cast("array<bigint>")))
    end = lambda k: F.try_element_at(shape, F.lit(k))
    units = F.coalesce(*(whole_number(F.try_element_at(params, F.lit(k))) for k in V.FIGURE_UNITS))
    share = count / 64
    known = {"map": (n >= 3, (end(-2), end(-1), end(1))), "matrix": (n == 2, (end(2), end(2), end(1))), "row": (n == 1, (end(1),) * 3), "units": (units.isNotNull(), (units,) * 3), "count": (count > 0, (share,) * 3)}
    size = lambda kind, of: F.struct(*(_between(v, b).alias(c) for c, v, b in zip("hdw", of, V.FIGURE_SIZES[kind], strict=True)))
    out = None
    for kind, (met, of) in known.items():
        out = F.when(met, size(kind, of)) if out is None else out.when(met, size(kind, of))
    return out.otherwise(size("none", (F.lit(0),) * 3))


def _corner(x: Column, y: Column) -> Column:
    return F.struct(F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


def place(layers: DataFrame, model: list[str]) -> DataFrame:
    """A row per block: runs of equal layers are one, with its number of layers, box and faces.

    ``layers``: the model's columns, pos, type, category, params, param_count, shape (null
    where it is not known).  The tallest block of a model sets the scale; a block begins
    where those before it end, a sum over the model, and depth recedes up and to the right.
    A run shows up to three copies behind its block, which widen its box.
    """
    signed = F.to_json(F.struct("type", "category", "param_count", "shape", F.array_sort(F.map_entries("params")).alias("p")))
    runs = with_island(layers.withColumn("__sign", signed), model, ["pos"], "__sign")
    first = F.min_by(F.struct("type", "category", "params", "param_count", "shape"), "pos")
    groups = runs.groupBy(*model, "island").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("repeat"), first.alias("l"))
    r = groups.select(*model, "island", "pos", "repeat", "l.type", F.col("l.param_count").alias("param_count"), sizes(F.col("l.shape"), F.col("l.params"), F.col("l.param_count")).alias("s"))
    whole = Window.partitionBy(*model)
    k = V.FIGURE_HEIGHT / F.greatest(F.max("s.h").over(whole), F.lit(1.0))
    tall, wide = F.greatest(F.col("s.h") * k, F.lit(V.FIGURE_LEAST_HEIGHT)), F.greatest(F.col("s.w") * k, F.lit(V.FIGURE_LEAST_WIDTH))
    deep = F.least(F.greatest(F.col("s.d") * k, F.lit(V.FIGURE_LEAST_DEPTH)), F.lit(V.FIGURE_HEIGHT * V.FIGURE_MOST_DEPTH))
    r = r.select("*", tall.alias("h"), wide.alias("w"), deep.alias("d"), F.least(F.col("repeat") - 1, F.lit(V.FIGURE_COPIES)).cast("double").alias("copies"))
    ahead = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    span = F.col("w") + F.col("d") * RUN
    left = V.FIGURE_LEFT + F.coalesce(F.sum(span + F.col("copies") * V.FIGURE_STEP + V.FIGURE_GAP).over(ahead), F.lit(0.0))
    middle = V.FIGURE_TOP + F.max(F.col("h") / 2 + F.col("d") * RISE).over(whole)
    r = r.withColumn("left", left).withColumn("middle", middle)
    x0, x1, dx, dy = F.col("left"), F.col("left") + F.col("w"), F.col("d") * RUN, F.col("d") * RISE
    y0, y1 = F.col("middle") - F.col("h") / 2, F.col("middle") + F.col("h") / 2
    faces = F.struct(
        F.array(_corner(x0, y1), _corner(x1, y1), _corner(x1, y0), _corner(x0, y0)).alias("front"),
        F.array(_corner(x0, y0), _corner(x1, y0), _corner(x1 + dx, y0 - dy), _corner(x0 + dx, y0 - dy)).alias("top"),
        F.array(_corner(x1, y1), _corner(x1 + dx, y1 - dy), _corner(x1 + dx, y0 - dy), _corner(x1, y0)).alias("side"),
    )
    return r.select(
        *model, "pos", "type", "repeat", (F.col("param_count") * F.col("repeat")).alias("params"),
        x0.alias("left"), (x1 + dx + F.col("copies") * V.FIGURE_STEP).alias("right"),
        (y0 - dy - F.col("copies") * V.FIGURE_STEP * RISE * 2).alias("top"), y1.alias("bottom"), faces.alias("faces"),
    )
