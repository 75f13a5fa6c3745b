"""Running values along arrays, in Spark's own functions and in time that follows their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are gone through at once; what is appended to grows to this length only.
STEP = 256


def running(values: Column, combine: Callable[[Column, Column], Column], start: int) -> Column:
    """For each element of an array of longs, what ``combine`` makes of ``start`` and all elements before it."""
    first = F.lit(start).cast("long")
    grown = lambda so_far, more: F.concat(so_far, F.array(more))

    def enter(state: Column, part: Column) -> Column:
        held = grown(state["parts"], F.struct(state["now"].alias("now"), part.alias("part")))
        return F.struct(F.aggregate(part, state["now"], lambda a, b: combine(a, b)).alias("now"), held.alias("parts"))

    def through(p: Column) -> Column:
        state = F.struct(p["now"].alias("now"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(p["part"], state, lambda s, v: F.struct(combine(s["now"], v).alias("now"), grown(s["out"], s["now"]).alias("out")), lambda s: s["out"])

    def along(v: Column) -> Column:
        count = F.ceil(F.size(v) / STEP).cast("int")
        parts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(v, k * STEP + 1, STEP))).otherwise(F.array().cast("array<array<bigint>>"))
        entered = F.aggregate(parts, F.struct(first.alias("now"), F.array().cast("array<struct<now:bigint,part:array<bigint>>>").alias("parts")), enter, lambda state: state["parts"])
        return F.flatten(F.transform(entered, through))

    # the array goes through a lambda, or it would be made anew for each part
    return F.get(F.transform(F.array(values), along), F.lit(0))
