"""What the operators of this subpackage share: reading, components; ``Scratch`` is passed on from the package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.scratch import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def ascii_lower(column) -> "F.Column":
    """A-Z lower-cased, all else as it is."""
    return F.translate(column, UPPER, LOWER)


#: Edges that one task may join by itself; more take the distributed steps.
SMALL_GRAPH = 500_000


def _joined_in_one_task(edges: DataFrame) -> DataFrame:
    """node, component_id by union-find over at most SMALL_GRAPH edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := low.setdefault(x, x)) != x:
                low[x] = x = low.setdefault(p, p)
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = find(u), find(v)
                low[max(a, b)] = min(a, b)
        nodes = list(low)
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "component_id": pa.array([find(x) for x in nodes], pa.int64())})

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, component_id long")


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc", small: int = SMALL_GRAPH) -> DataFrame:
    """Connected components of an undirected edge list (a long, b long).

    Alternates the large-star and small-star steps of Kiveris et al. until the edges no
    longer change; every step is an aggregate and a join, so no component is gathered in one
    place. Minima are written before they are joined back: both sides of that join are then
    plain exchanges, whose hot keys Spark's skew join can split. Returns (node long,
    component_id long), component_id being the smallest node of the component; nodes without
    an edge are absent. Self-loops and null ends are dropped. At most ``small`` edges, which are counted first, are
    joined in one task instead, in bounded memory: the result is the same, without dozens of tiny jobs.
    """
    current = scratch.keep(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(),
        f"{tag}_0",
    )
    if current.count() <= small:
        return _joined_in_one_task(current)
    mark, step = None, 0
    while True:
        step += 1
        both = current.unionByName(current.selectExpr("v AS u", "u AS v"))
        low = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{tag}_low_{step}")
        large = both.where("v > u").join(low, "u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        large = scratch.keep(large, f"{tag}_large_{step}")
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}_least_{step}")
        small = large.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v").unionByName(least.selectExpr("u", "m AS v")).distinct()
        following = scratch.keep(small, f"{tag}_{step}")
        now = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{tag}_{step - 1}", f"{tag}_low_{step}", f"{tag}_large_{step}", f"{tag}_least_{step}")
        current = following
        if now == mark or not now[0]:
            break
        mark = now
    return current.selectExpr("u AS node", "v AS component_id").unionByName(current.selectExpr("v AS node", "v AS component_id").distinct())
