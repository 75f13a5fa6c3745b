"""Embedding near-duplicates through a pivot-permutation index.

Pivots are rows of the table (a sample of bounded size, chosen by hash). A vector is described by
its nearest pivots in their order. Inverted lists are kept for pairs of pivots: two
vectors that share s pivots meet in s * (s - 1) / 2 lists, and a list stays short because with
pivots in proportion to the square root of the rows there are as many lists as rows. Pairs with
at least two shared pivots are candidates; each is looked at in one list only, that of the two
smallest pivots it shares, and verified by its cosine in double precision.

How many nearest pivots a vector needs depends on how crowded its place is: where vectors share a
direction, a partner at the threshold has other nearest pivots, and the more so the more pivots there are. The
number is therefore measured on the pivots themselves, by how close the tenth nearest pivot is: each
is given partners at exactly the threshold, and its group takes the least length that finds enough of them.

Where many pivots lie near a vector, the order of its nearest is noise, and the more so the larger
the table is. A vector with NEAREST pivots or more at a cosine of DENSE is therefore left out of the
lists. Its home is a band of angles around the nearest of a few centres of dense places, and it
is compared with every vector that the triangle inequality allows to be linked with the band: such
links are all found, whatever the size of a group.

A vector is sent once for all its short lists that have their smaller pivot in common (a bundle, which is parted by the larger
pivot where it would be long), not once for each list. A list of more than BLOCK rows is cut, and pairs of its blocks go to
different tasks. No pairs leave a task, only each vector's number of links and enough edges to
connect what is linked. Vectors that are equal are one row with a multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.llm.common import Scratch, components, read

#: How crowded a vector's place is: the cosine of its pivot of this rank.
NEAREST = 10
#: Lengths of a permutation to choose from, and the share of partners at the threshold that the one chosen must find.
LENGTHS, TARGET = (8, 10, 12, 14, 16, 20, 24, 32), 0.98
#: Pivots that lengths are measured on, in groups of GROUP_OF or more by how crowded they are, and partners of each kind for one.
PROBES, GROUP_OF, MOST_GROUPS, PARTNERS = 2048, 128, 16, 2
#: Pivots: PER_ROOT times the square root of the rows, between these bounds (lists keep their length up to 268 million rows).
PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 4, 64, 65_536
BLOCK = 1024
#: Entries of lists that one bundle holds, but for its last list.
BUNDLE = 16_384
#: Cosine of a near pivot; a home is compared in blocks of WIDE times as many rows, as it has no lists of pairs.
DENSE, WIDE = 0.75, 4
#: ``low`` of the lists that are homes; ``high`` is then the home, centre * BANDS + band.
_HOME, BANDS = -1, 64
_NONE = np.int32(2**31 - 1)


_USABLE = (
    "coalesce(vec_id IS NOT NULL AND size(embedding) > 0 AND exists(embedding, x -> x <> 0) "
    "AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')), false)"
)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has finite components only and is not zero."""
    return vectors.where(_USABLE)


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first: no overflow or underflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def dense_centres(pivots: np.ndarray, length: int) -> np.ndarray:
    """Centres of the places with many pivots.

    Of ``length`` pivots at DENSE of one vector, two have at least the cosine ``mutual`` (their mean is that or more). Every
    pivot with such a neighbour is at DENSE of a centre, or is one.
    """
    if len(pivots) < length or length < 2:
        return np.zeros((0, pivots.shape[1]))
    mutual = (length * DENSE**2 - 1) / (length - 1)
    count = np.concatenate([(pivots[i : i + 512] @ pivots.T >= mutual).sum(1) for i in range(0, len(pivots), 512)])
    open_, out = count >= 2, []
    for at in np.argsort(-count, kind="stable"):
        if not open_[at]:
            continue
        centre = pivots[at]
        for _ in range(2):
            mean = pivots[pivots @ centre >= DENSE**2].sum(0)
            centre = mean / (np.linalg.norm(mean) or 1)
        if pivots[at] @ centre < DENSE:
            centre = pivots[at]
        open_[pivots @ centre >= DENSE] = False
        open_[at] = False
        out.append(centre)
    return np.array(out).reshape(len(out), pivots.shape[1])


def nearest(score: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` best columns of each row, best first, ties by number (in rows of more than four times that many columns, ties with the last place as they come)."""
    if score.shape[1] > 4 * length:
        some = np.sort(np.argpartition(-score, length, axis=1)[:, : length + 1], axis=1)
    else:
        some = np.broadcast_to(np.arange(score.shape[1]), score.shape)
    order = np.argsort(-np.take_along_axis(score, some, 1), axis=1, kind="stable")[:, :length]
    return np.take_along_axis(some, order, 1).astype(np.int32)


def crowding(score: np.ndarray) -> np.ndarray:
    rank = min(NEAREST, score.shape[1])
    return np.partition(score, -rank, axis=1)[:, -rank]


def measured_lengths(pivots: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Limits of crowding (ascending) and the length of a permutation in each of the groups that they part.

    Partners of a probe have a cosine of ``least`` with it, in a random direction or in that of one of the sixteenth of the pivots
    around it: the second kind stays in the subspace or cone that the vectors lie in. A probe is not its own pivot here. A group takes the least of
    LENGTHS by which TARGET of the partners share two pivots with their probe, the last if none does.
    """
    none = np.zeros(0)
    if len(pivots) < LEAST_PIVOTS:
        return none, np.array([min(LENGTHS[-1], len(pivots))])
    rng = np.random.default_rng(7)
    most, crowd, hits = min(LENGTHS[-1], len(pivots) - 1), [], []
    for at in range(0, min(PROBES, len(pivots)), 128):
        x = pivots[at : at + 128][: PROBES - at]
        rows = np.arange(len(x))
        score = x @ pivots.T
        score[rows, at + rows] = -np.inf
        crowd.append(crowding(score))
        around, kinds = nearest(score, max(most, len(pivots) // 16)), []
        own = around[:, :most]
        for kind in range(2):
            found = []
            for _ in range(PARTNERS):
                noise = pivots[around[rows, rng.integers(0, around.shape[1], len(x))]] if kind else 0
                noise = noise + rng.normal(size=x.shape) * (1e-6 if kind else 1)
                noise = noise - (noise * x).sum(1, keepdims=True) * x
                partner = least * x + math.sqrt(1 - least**2) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
                score = partner @ pivots.T
                score[rows, at + rows] = -np.inf
                same = own[:, :, None] == nearest(score, most)[:, None, :]
                found.append([same[:, :n, :n].any(2).sum(1) >= 2 for n in LENGTHS])
            kinds.append(np.mean(found, axis=0))
        hits.append(kinds)
    crowd, hits = np.concatenate(crowd), np.concatenate(hits, axis=2)  # hits: kind, length, probe
    order = np.argsort(crowd, kind="stable")
    order = order[crowd[order] < DENSE]  # the others are compared in homes
    if not len(order):
        return none, np.array([min(NEAREST, most)])
    groups = np.array_split(order, max(1, min(MOST_GROUPS, len(order) // GROUP_OF)))
    enough = [np.flatnonzero(hits[:, :, g].mean((0, 2)) >= TARGET) for g in groups]
    lengths = np.array([min(most, LENGTHS[e[0]] if len(e) else LENGTHS[-1]) for e in enough])
    return np.array([crowd[g[0]] for g in groups[1:]]), lengths


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def permutations(classes: DataFrame, pivots: np.ndarray, limits: np.ndarray, lengths: np.ndarray, centres: np.ndarray, least: float) -> DataFrame:
    """classes, ``near`` (the nearest pivots, nearest first, ties by number, -1 after the vector's length) and ``home`` (-1 for a vector in no dense place)."""
    shared = classes.sparkSession.sparkContext.broadcast((pivots, centres))
    width, most, step = math.acos(least) / 2, int(lengths.max()), max(16, 2**22 // len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, centres = shared.value
        for batch in batches:
            near, home = [], []
            for i in range(0, batch.num_rows, step):
                x = unit(matrix(batch.column("embedding").slice(i, step)))
                score = x @ pivots.T
                crowd, best = crowding(score), nearest(score, most)
                best[np.arange(most) >= lengths[np.searchsorted(limits, crowd, side="right")][:, None]] = -1
                near.append(best)
                own = np.full(len(x), -1, np.int32)
                dense = np.flatnonzero(crowd >= DENSE) if len(centres) else []
                if len(dense):
                    angle = angles(x[dense], centres)
                    own[dense] = angle.argmin(1) * BANDS + np.minimum(angle.min(1) // width, BANDS - 1)
                home.append(own)
            near = np.concatenate(near) if near else np.zeros((0, most), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
            home = pa.array(np.concatenate(home) if home else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, home], names=[*batch.schema.names, "near", "home"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{schema}, near array<int>, home int")


def visits(described: DataFrame, homes: list[int], centres: np.ndarray, least: float) -> DataFrame:
    """rep, low, high: the homes a vector is compared in, its own and all later ones with which it can have a link."""
    keys = np.array(sorted(homes))
    shared = described.sparkSession.sparkContext.broadcast((keys, centres[keys // BANDS]))
    reach = math.acos(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, centres = shared.value
        inner, outer = (keys % BANDS) * reach / 2 - reach - 1e-6, (keys % BANDS + 1) * reach / 2 + reach + 1e-6
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                angle, own = angles(unit(matrix(part.column("embedding"))), centres), np.asarray(part.column("home"))[:, None]
                p, k = np.nonzero((angle >= inner) & (angle <= outer) & (own <= keys))
                high = keys[k].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(p)), pa.array(np.full(len(p), _HOME, np.int32)), pa.array(high)], names=["rep", "low", "high"])

    return described.select("rep", "embedding", "home").mapInArrow(run, "rep long, low int, high int")


def _canonical(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether low and high are the two smallest entries that rows of a and b share."""
    both = np.where((a[:, :, None] == b[:, None, :]).any(2) & (a >= 0), a, _NONE)
    two = np.sort(both, axis=1)[:, :2]
    return (two[:, 0] == low) & (two[:, 1] == high)


def _compare(rows: pa.Table, least: float) -> pa.RecordBatch:
    """Links within bundles, and within lists (and pairs of blocks) of their own: rows (class, null, its links) and edges (id, id, null)."""
    rows = rows.combine_chunks()
    column = lambda c: rows.column(c).combine_chunks()
    rep, ident, times, own, home = (np.asarray(column(c)) for c in ("rep", "id", "times", "own", "home"))
    x, near = unit(matrix(column("embedding"))), matrix(column("near"), np.int32)
    # one entry for each list of a row; homes come first and have one a row, so that their entries are rows
    high = np.asarray(column("highs").flatten())
    at = np.repeat(np.arange(len(rep)), np.asarray(column("highs").value_lengths()))
    low, i, j = (np.asarray(column(c))[at] for c in ("low", "i", "j"))
    order = np.lexsort((j, i, high, low))
    at, low, high, i, j = at[order], low[order], high[order], i[order], j[order]
    key = np.stack([low, high, i, j], 1)
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
    ends = np.r_[first[1:], len(at)]
    links, parent = np.zeros(len(rep), np.int64), np.arange(len(rep))

    def found(p: np.ndarray, q: np.ndarray) -> None:
        ok = _canonical(near[at[p]], near[at[q]], low[p], high[p])
        p, q = at[p[ok]], at[q[ok]]
        np.add.at(links, p, times[q])
        np.add.at(links, q, times[p])
        while len(p):  # smallest row that is reachable, by pointer jumping
            m = np.minimum(parent[p], parent[q])
            np.minimum.at(parent, parent[p], m)
            np.minimum.at(parent, parent[q], m)
            np.minimum.at(parent, p, m)
            np.minimum.at(parent, q, m)
            parent[:] = parent[parent]
            going = parent[p] != parent[q]
            p, q = p[going], q[going]

    def compare_home(a: int, b: int) -> None:
        """Pairs with at least one vector at home here; counted by whole rows, as most are links."""
        rows = np.arange(a, b)[np.argsort(home[a:b] != high[a], kind="stable")]  # those at home first
        one = rows[own[rows] == i[a]]
        two = one if i[a] == j[a] else rows[own[rows] == j[a]]
        here, y, weight = home[two] == high[a], x[two], times[two].astype(np.float64)
        inside = parent[a:b]
        for begin in range(0, len(one), 256):
            p = one[begin : begin + 256]
            own_here = home[p] == high[a]
            if not own_here.any() and not here.any():
                continue
            mask = x[p] @ y.T >= least
            mask &= own_here[:, None] | here
            if two is one:
                mask[np.arange(len(p)), np.arange(begin, begin + len(p))] = False
            weights = mask.astype(np.float64)
            links[p] += (weights @ weight).astype(np.int64)
            if two is not one:
                links[two] += (times[p].astype(np.float64) @ weights).astype(np.int64)
            for k in np.flatnonzero((mask & (parent[p][:, None] != parent[two])).any(1)):
                joined = np.unique(np.r_[parent[p[k]], parent[two[mask[k]]]])
                inside[np.isin(inside, joined)] = joined[0]

    size = ends - first
    homes = low[first] == _HOME
    short = (size <= 24) & ~homes
    for a, b in zip(first[homes].tolist(), ends[homes].tolist()):
        if b - a > 1:
            compare_home(a, b)
    # short runs: all their pairs in one go
    for n in np.unique(size[short]):
        if n < 2:
            continue
        starts = first[short & (size == n)]
        u, v = np.triu_indices(int(n), 1)
        step = max(1, 200_000 // len(u))
        for begin in range(0, len(starts), step):
            some = starts[begin : begin + step, None]
            p, q = (some + u).ravel(), (some + v).ravel()
            across = (i[p] == j[p]) | (own[at[p]] != own[at[q]])
            p, q = p[across], q[across]
            ok = np.einsum("ij,ij->i", x[at[p]], x[at[q]]) >= least
            found(p[ok], q[ok])
    for a, b in zip(first[~short & ~homes].tolist(), ends[~short & ~homes].tolist()):
        y = x[at[a:b]]
        for begin in range(0, b - a, 256):
            p, q = np.nonzero(y[begin : begin + 256] @ y.T >= least)
            p, q = p + begin + a, q + a
            ok = (p < q) & ((i[p] == j[p]) | (own[at[p]] != own[at[q]]))
            found(p[ok], q[ok])
    while (parent[parent] != parent).any():
        parent[:] = parent[parent]
    some, tied = np.flatnonzero(links), np.flatnonzero(parent != np.arange(len(rep)))
    nulls = lambda n: pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.r_[rep[some], ident[tied]]), pa.concat_arrays([nulls(len(some)), pa.array(ident[parent[tied]])]), pa.concat_arrays([pa.array(links[some]), nulls(len(tied))])], names=["a", "b", "n"]
    )


def compare_lists(rows: DataFrame, least: float) -> DataFrame:
    """Runs through sorted bundles and lists; one that a batch cuts waits for its rest (a bundle, or two blocks of rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            keys = np.stack([np.asarray(table.column(c).combine_chunks()) for c in ("low", "part", "i", "j")], 1)
            cut = int(np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])[-1])
            held = table.slice(cut)
            if cut:
                yield _compare(table.slice(0, cut), least)
        if held is not None and held.num_rows:
            yield _compare(held, least)

    return rows.mapInArrow(run, "a long, b long, n long")


def _links(same: DataFrame, count: int, scratch: Scratch, tag: str, least: float, length: int | None, block: int, pivots: int | None) -> DataFrame:
    """Rows (class, null, its links) and edges (id, id, null) of the ``count`` classes of one dimension."""
    wanted = pivots or max(LEAST_PIVOTS, min(MOST_PIVOTS, math.ceil(PER_ROOT * math.sqrt(count))))
    sample = same.orderBy(F.xxhash64("id"), "rep").limit(wanted).select("embedding").toPandas()
    points = unit(np.array(sample["embedding"].tolist(), np.float64))
    limits, lengths = (np.zeros(0), np.array([min(length, len(points))])) if length else measured_lengths(points, least)
    centres = dense_centres(points, NEAREST)
    described = scratch.keep(permutations(same, points, limits, lengths, centres, least), f"described{tag}")
    pairs = F.expr("flatten(transform(filter(near, x -> x >= 0), x -> transform(filter(near, y -> y > x), y -> struct(x AS low, y AS high))))")
    postings = described.where("home < 0").select("rep", F.explode(pairs).alias("k")).select("rep", "k.low", "k.high")
    homes = [r["home"] for r in described.where("home >= 0").select("home").distinct().collect()]  # bands of centres, no more than a few for each pivot
    if homes:
        postings = postings.unionByName(visits(described, homes, centres, least))
    postings = scratch.keep(postings, f"postings{tag}")
    size = F.when(F.col("low") == _HOME, WIDE * block).otherwise(block)
    lists = postings.groupBy("low", "high").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
    lists = scratch.keep(lists, f"lists{tag}")
    short = (F.col("low") != _HOME) & (F.col("blocks") == 1)
    parts = lists.where(short).groupBy("low").agg(F.ceil(F.sum("n") / BUNDLE).cast("int").alias("parts"))  # a row for each pivot at most
    lists = lists.join(parts, "low", "left").withColumn("part", F.when(short, F.expr("pmod(xxhash64(high), parts)").cast("int")))
    placed = postings.join(lists.select("low", "high", "blocks", "part"), ["low", "high"]).repartition("rep")
    bundles = placed.where("part IS NOT NULL").groupBy("rep", "low", "part").agg(F.collect_list("high").alias("highs"))  # at most one entry for each near pivot
    bundles = bundles.selectExpr("rep", "low", "part", "highs", "0 AS own", "-1 AS i", "-1 AS j")
    long = placed.where("part IS NULL").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
    long = long.select("rep", "low", F.col("high").alias("part"), F.array("high").alias("highs"), "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))
    full = bundles.unionByName(long).join(described.select("rep", "id", "embedding", "times", "near", "home"), "rep")
    ordered = full.select("rep", "id", "times", "low", "part", "highs", "i", "j", "own", "home", "embedding", "near").repartition("low", "part", "i", "j").sortWithinPartitions("low", "part", "i", "j")
    return scratch.keep(compare_lists(ordered, least), f"found{tag}")


def near_vectors(vectors: DataFrame, scratch: Scratch, least: float = 0.9, length: int | None = None, block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors (vec_id, embedding).

    Linked are vectors whose cosine is found to be ``least`` or more, never others. ``length`` fixes the number of nearest pivots,
    which is measured otherwise. A vector that is
    null, empty, zero or has null or non-finite components links with nothing. Each dimension is indexed by itself,
    as vectors of different dimensions have no cosine. Equal vectors link with each other. Rows that share a vec_id are one
    node of the components. A row without
    vec_id gets a null component and is kept.
    """
    spark = scratch.spark
    good = usable(vectors.selectExpr("CAST(vec_id AS bigint) AS vec_id", "embedding"))
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"))
    classes = scratch.keep(classes.withColumn("rep", F.xxhash64("embedding", "id")), "classes")  # ids may be shared by classes
    rows = vectors.selectExpr("CAST(vec_id AS bigint) AS vec_id", "embedding")
    sizes = classes.groupBy(F.size("embedding").alias("d")).count().where("count > 1").orderBy("d").collect()  # one row for each dimension
    if not classes.limit(1).count():
        return rows.selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id", "true AS kept")
    found = spark.createDataFrame([], "a long, b long, n long")
    for r in sizes:
        same = classes.where(F.size("embedding") == r["d"])
        found = found.unionByName(_links(same, r["count"], scratch, f"_{r['d']}", least, length, block, pivots))
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    same_id = good.groupBy("vec_id").agg(F.count("*").alias("rows")).where("rows > 1").select("vec_id")
    tied = good.join(same_id, "vec_id", "left_semi").join(classes.select("embedding", "id"), "embedding").selectExpr("vec_id AS a", "id AS b")
    labels = components(found.where("b IS NOT NULL").select("a", "b").unionByName(tied), scratch)
    per_class = classes.join(counts, classes["rep"] == counts["a"], "left").select("embedding", "id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    per_class = per_class.join(labels.withColumnRenamed("node", "id"), "id", "left").select("embedding", F.coalesce("component_id", "id").alias("low"), "n_links")
    per_class = scratch.keep(per_class, "per_class")
    joined = usable(rows).join(per_class, "embedding").select("vec_id", "n_links", F.col("low").alias("component_id"))
    bad = rows.where(f"NOT {_USABLE}")
    bad = bad.selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id")
    return joined.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whatever their labels."""
    return near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), Scratch(spark, "op2"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
