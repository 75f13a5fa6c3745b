"""Interval sets as columns: arrays of (start, end), sorted, disjoint and not adjacent.

Everything is a composition of Spark's array functions, so set algebra stays in the JVM. Text form:
``1-100,105,200-300``; the empty set is ``-``. Null in gives null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from genolith.functions.arrays import running

TYPE = "array<struct<start:int,end:int>>"
_EMPTY = f"CAST(array() AS {TYPE})"


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def merge(spans: Column) -> Column:
    """Any array of (start, end) as a set: sorted, overlapping and adjacent ones joined. What is a set already is only sorted and compared with its neighbours."""

    def join(s: Column) -> Column:
        # a joined span begins where one starts beyond all ends before it, and ends at the last of these for the next one
        reach = running(F.transform(s, lambda x: x["end"].cast("long")), F.greatest, -(1 << 40))
        opened = F.filter(F.arrays_zip(s.alias("s"), reach.alias("r")), lambda x: x["s"]["start"] > x["r"] + 1)
        last = F.array_max(F.transform(s, lambda x: x["end"].cast("long")))
        ends = F.concat(F.transform(F.slice(opened, 2, F.greatest(F.size(opened) - 1, F.lit(0))), lambda x: x["r"]), F.array(last))
        return F.zip_with(opened, ends, lambda x, e: _span(x["s"]["start"], e))

    def joined(s: Column) -> Column:
        apart = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.coalesce(b["start"] > a["end"] + 1, F.lit(True)))
        return F.when(F.forall(apart, lambda x: x), F.transform(s, lambda x: _span(x["start"], x["end"]))).otherwise(join(s))

    return F.get(F.transform(F.array(F.array_sort(spans)), joined), F.lit(0))


def parse(runlist: Column) -> Column:
    """From the text form."""
    parts = F.when(F.trim(runlist).isin("-", ""), F.expr("CAST(array() AS array<string>)")).otherwise(F.split(runlist, ","))
    return merge(F.transform(parts, lambda p: _span(F.regexp_extract(p, r"^\s*(-?\d+)", 1), F.when(p.rlike(r"^\s*-?\d+\s*-"), F.regexp_extract(p, r"-(-?\d+)\s*$", 1)).otherwise(F.trim(p)))))


def to_runlist(spans: Column) -> Column:
    """To the text form."""
    text = F.transform(spans, lambda s: F.when(s["start"] == s["end"], s["start"].cast("string")).otherwise(F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))))
    return F.when(F.size(spans) == 0, "-").otherwise(F.array_join(text, ","))


def size(spans: Column) -> Column:
    """Number of integers in the set."""
    return F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["start"] + 1)


def span_size(spans: Column) -> Column:
    return F.size(spans)


def union(a: Column, b: Column) -> Column:
    return merge(F.concat(a, b))


def intersect(a: Column, b: Column) -> Column:
    pieces = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"])), lambda y: _span(F.greatest(x["start"], y["start"]), F.least(x["end"], y["end"])))))
    return merge(pieces)


def complement(spans: Column, low: Column, high: Column) -> Column:
    """What the set lacks of low..high."""
    starts = F.concat(F.array(low.cast("int")), F.transform(spans, lambda s: s["end"] + 1))
    ends = F.concat(F.transform(spans, lambda s: s["start"] - 1), F.array(high.cast("int")))
    gaps = F.zip_with(starts, ends, lambda s, e: _span(F.greatest(s, low.cast("int")), F.least(e, high.cast("int"))))
    return F.filter(gaps, lambda g: g["start"] <= g["end"])


def diff(a: Column, b: Column) -> Column:
    """Integers of a that are not in b."""
    return F.when(F.size(a) == 0, a).otherwise(intersect(a, complement(b, F.get(a, 0)["start"], F.get(a, F.size(a) - 1)["end"])))


def contains(spans: Column, value: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] <= value) & (value <= s["end"]))


def index_of(spans: Column, value: Column) -> Column:
    """1-based rank of a member; null for others."""
    rank = F.aggregate(spans, F.lit(0), lambda a, s: a + F.greatest(F.least(s["end"], value) - s["start"] + 1, F.lit(0)))
    return F.when(contains(spans, value), rank)


def at(spans: Column, rank: Column) -> Column:
    """The member of a 1-based rank; null beyond the set."""
    start = F.struct(F.lit(0).alias("seen"), F.lit(None).cast("int").alias("found"))

    def step(acc: Column, s: Column) -> Column:
        n = s["end"] - s["start"] + 1
        here = (acc["found"].isNull()) & (rank > acc["seen"]) & (rank <= acc["seen"] + n)
        return F.struct((acc["seen"] + n).alias("seen"), F.when(here, s["start"] + rank.cast("int") - acc["seen"] - 1).otherwise(acc["found"]).alias("found"))

    return F.aggregate(spans, start, step, lambda acc: acc["found"])


def slice_ranks(spans: Column, first: Column, last: Column) -> Column:
    """Members of ranks first..last."""
    return F.when((first <= last) & at(spans, first).isNotNull() & at(spans, last).isNotNull(), intersect(spans, F.array(_span(at(spans, first), at(spans, last))))).otherwise(F.expr(_EMPTY))


def fill(spans: Column, gap: int) -> Column:
    """Gaps of at most ``gap`` integers are filled."""
    wide = merge(F.transform(spans, lambda s: _span(s["start"], s["end"] + gap)))
    return F.transform(wide, lambda s: _span(s["start"], s["end"] - gap))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's integers in b; null for an empty a."""
    return F.try_divide(size(intersect(a, b)), size(a))


def substr_spans(sequence: Column, spans: Column) -> Column:
    """The parts of a sequence that lie in the set, joined."""
    return F.array_join(F.transform(spans, lambda s: F.substring(sequence, s["start"], s["end"] - s["start"] + 1)), "")


def runs_of(sequence: Column, pattern: str) -> Column:
    """Spans of the characters of a class, such as ``-`` for gaps; ``pattern`` is what may stand in brackets."""

    def placed(s: Column) -> Column:
        runs = F.regexp_extract_all(s, F.lit(f"([{pattern}]+)"), F.lit(1))
        others = F.slice(F.split(s, f"[{pattern}]+", -1), 1, F.size(runs))
        lengths = F.zip_with(others, runs, lambda x, r: (F.length(x) + F.length(r)).cast("long"))
        ends = F.zip_with(running(lengths, lambda a, b: a + b, 0), lengths, lambda a, b: a + b)
        return F.zip_with(runs, ends, lambda r, e: _span(e - F.length(r) + 1, e))

    return F.get(F.transform(F.array(sequence), placed), F.lit(0))
