"""MinHash near-duplicates by chosen paths (set similarity join by recursive branching).

Documents of one shingle set are one class. Classes descend independent trees: the root of a tree
branches on one minwise token, and so does every node below, on a coordinate that the node's own
hash picks (in a quarter of the nodes on two: 1.25 branches on average, the inverse of the
similarity sought, so a pair at the threshold keeps one common path in expectation at any depth).

* What is asked for is which documents are reachable, so linked classes are contracted: a node whose members are
  all in one component is finished.
* Small nodes are compared exhaustively, in blocks of ``leaf`` members: first by sketches of 64 minwise tokens, then the members
  that have a candidate by their full sets. A pair that met in the root of an earlier tree was decided there. The first tree goes
  alone, so that most copies are one component before the others look at them.
* Larger nodes (over SMALL blocks) are held against a few hubs, which is linear, and then branch. Below ``depth`` they no
  longer branch but are compared exhaustively in blocks: nothing is capped.
* Trees are repeated until a pair at the threshold is missed with a probability of ``miss`` at most, given the
  depth that was reached.

A pair is dropped without a look at its sets only if its sketches agree in so few places that a pair at
the threshold would do so with probability below 1e-6. All links are confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.llm.common import Scratch, components, read
from genolith.llm.shingles import chunks, mix, shingle_sets

COORDINATES = 64
#: Members of a block, blocks of a node that is small, levels, hubs of a large node.
LEAF, SMALL, DEPTH, HUBS = 1024, 8, 12, 4
#: Shingles of the members of one block, about.
BLOCK_SHINGLES = 2_000_000
#: Probability to miss a pair at the threshold in all trees together.
MISS = 1e-6
#: Ids that are broadcast at most (24 bytes each) to pick out the texts to verify; more are joined by a shuffle.
BROADCAST_IDS = 400_000
#: Rows with a sketch (some 320 bytes each) that are broadcast at most.
BROADCAST_SKETCHES = 50_000
_A = np.random.default_rng(7).integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_X = np.random.default_rng(8).integers(1, 1 << 63, COORDINATES, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of COORDINATES hash functions over a set, as 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[i : i + 2048, None] ^ _X) * _A).min(0))
    return (least >> np.uint64(32)).astype("<u4")


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (128 bits of the whole set), sig (COORDINATES unsigned 32-bit values; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                n, f1, f2, sig = [], [], [], []
                for s in shingle_sets(part.column("text"), k):
                    n.append(len(s))
                    f1.append(s.sum(dtype=np.uint64))
                    f2.append(mix(s + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64))
                    sig.append(signature(s).tobytes() if len(s) else None)
                signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(n, np.int64)), signed(f1), signed(f2), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def least_agreement(threshold: float, miss: float = 1e-6) -> int:
    """Places of COORDINATES in which two sketches agree at least, but for a chance of ``miss``, if their sets are as similar as ``threshold``."""
    p, total, at = (1 - threshold) ** COORDINATES, 0.0, 0
    while total + p < miss and threshold < 1:
        total += p
        p *= (COORDINATES - at) / (at + 1) * threshold / (1 - threshold)
        at += 1
    return at if threshold < 1 else COORDINATES


def trees_for(depth: int, threshold: float, miss: float) -> int:
    """Trees after which a pair at the threshold has met in some node, but for a chance of ``miss``, where nodes end at ``depth``."""
    meets = 1.0
    for _ in range(depth):
        one = threshold * meets
        meets = 0.75 * one + 0.25 * (1 - (1 - one) ** 2)
    meets *= threshold
    return COORDINATES if meets <= 0 else 1 if meets >= 1 else min(COORDINATES, math.ceil(math.log(miss) / math.log(1 - meets)))


def _sketch_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def _joined(group: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """group, with the groups that rows p and q tie together made one."""
    if not len(p):
        return group
    low = np.arange(group.max() + 1)
    a, b = group[p], group[q]
    while (low[a] != low[b]).any():
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
    while (low[low] != low).any():
        low = low[low]
    return low[group]


def _forest(group: np.ndarray, p: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Indices of the edges (p, q) that join the groups they connect, heaviest first (Boruvka's rounds). ``group``: of each row."""
    chosen, left = [], np.arange(len(p))
    while True:
        left = left[group[p[left]] != group[q[left]]]
        if not len(left):
            return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        ends, edge = np.r_[group[p[left]], group[q[left]]], np.r_[left, left]
        order = np.lexsort((edge, -w[edge], ends))
        best = np.unique(edge[order[np.r_[True, ends[order][1:] != ends[order][:-1]]]])
        chosen.append(best)
        group = _joined(group, p[best], q[best])


def _runs(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.Table]:
    """Tables of whole runs of ``grp`` with some ``most`` pairs each. A run that a batch cuts waits for its rest: two blocks of rows at most."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        if not table.num_rows:
            continue
        grp = np.asarray(table.column("grp").combine_chunks())
        first = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
        held, table = table.slice(int(first[-1])), table.slice(0, int(first[-1]))
        cost, at = np.cumsum(np.diff(first).astype(np.int64) ** 2), 0
        while at < len(first) - 1:
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + most, "right")))
            yield table.slice(int(first[at]), int(first[to] - first[at])).combine_chunks()
            at = to
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _candidates(table: pa.Table, need: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, places of agreement): the pairs of rows of one run that may be linked and are not known to be in one component.

    Pairs that met in the root of an earlier tree were decided there, unless both are ``deep``. Where i and j differ only
    pairs across the two blocks count.
    """
    grp, label, n, own, i, j, tree, deep = (np.asarray(table.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in ("grp", "label", "n", "own", "i", "j", "tree", "deep"))
    sig = _sketch_matrix(table.column("sig").combine_chunks())
    first = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]]) if len(grp) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(grp)])
    ps, qs, ws = [], [], []

    def look(p: np.ndarray, q: np.ndarray) -> None:
        ok = (label[p] != label[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q])) & ((i[p] == j[p]) | (own[p] != own[q]))
        p, q = p[ok], q[ok]
        for at in range(0, len(p), 16_384):
            x, y = p[at : at + 16_384], q[at : at + 16_384]
            same = sig[x] == sig[y]
            w = same.sum(1)
            early = (same & (np.arange(COORDINATES) < tree[x][:, None])).any(1) & ~(deep[x] & deep[y])
            ok = (w >= need) & ~early
            ps.append(x[ok])
            qs.append(y[ok])
            ws.append(w[ok])

    for s in np.unique(size[(size > 1) & (size <= 32)]):
        u, v = np.triu_indices(int(s), 1)
        starts = first[size == s, None]
        for at in range(0, len(starts), 2048):
            look((starts[at : at + 2048] + u).ravel(), (starts[at : at + 2048] + v).ravel())
    for a, s in zip(first[size > 32].tolist(), size[size > 32].tolist()):
        for at in range(0, s, 128):
            u, v = np.meshgrid(np.arange(at, min(s, at + 128)), np.arange(at, s), indexing="ij")
            look(a + u[u < v], a + v[u < v])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ps, qs, ws))


def promising(rows: DataFrame, need: int, percent: int) -> DataFrame:
    """node, rep: members of runs (grp, node, rep, label, n, own, i, j, tree, deep, sig; sorted by grp) that have a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            p, q, _ = _candidates(table, need, percent)
            take = pa.array(np.union1d(p, q))
            yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(take) for c in ("node", "rep")], names=["node", "rep"])

    return rows.mapInArrow(run, "node long, rep long")


def shared_counts(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray, most: int = 1_000_000) -> np.ndarray:
    """Sizes of the intersections of sets p and q. The shingles of each p are marked, and those of all its q looked up, some ``most`` at a time:
    work is what the sets of the pairs hold, however many sets there are."""
    out = np.zeros(len(p), np.int64)
    if not len(p):
        return out
    used, at = np.unique(np.r_[p, q], return_inverse=True)
    size = np.array([len(sets[k]) for k in used.tolist()], np.int64)
    column = np.unique(np.concatenate([sets[k] for k in used.tolist()]), return_inverse=True)[1].astype(np.int32)
    columns = np.split(column, np.cumsum(size)[:-1])
    a, b = at[: len(p)], at[len(p) :]
    order = np.argsort(a, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(a[order]) != 0])
    marked = np.zeros(int(column.max()) + 1 if len(column) else 0, bool)
    for low, high in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
        own = columns[a[order[low]]]
        marked[own] = True
        held, at = np.cumsum(size[b[order[low:high]]]), low
        while at < high:
            to = max(at + 1, low + int(np.searchsorted(held, (held[at - low - 1] if at > low else 0) + most, "right")))
            some = order[at:to]
            hits = np.r_[0, np.cumsum(marked[np.concatenate([columns[k] for k in b[some].tolist()])])]
            ends = np.cumsum(size[b[some]])
            out[some] = hits[ends] - hits[ends - size[b[some]]]
            at = to
        marked[own] = False
    return out


def linked(rows: DataFrame, need: int, percent: int) -> DataFrame:
    """a, b: links that join the components of each run as far as all its links do. Columns as for ``promising``, and ``shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            p, q, w = _candidates(table, need, percent)
            rep, label, n = (np.asarray(table.column(c).combine_chunks()) for c in ("rep", "label", "n"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]
            start = np.asarray(table.column("grp").combine_chunks())
            group = np.unique(np.stack([np.cumsum(np.r_[0, start[1:] != start[:-1]]), label], 1), axis=0, return_inverse=True)[1].ravel()
            out: list[np.ndarray] = []

            def verify(some: np.ndarray) -> np.ndarray:
                both = shared_counts(sets, p[some], q[some])
                return some[100 * both >= percent * (n[p[some]] + n[q[some]] - both)]

            # a forest first; then only what is still apart
            for some in (_forest(group, p, q, w), None):
                if some is None:
                    some = np.flatnonzero(group[p] != group[q])
                found = verify(some)
                tied = found[_forest(group, p[found], q[found], w[found])]
                out.append(tied)
                group = _joined(group, p[tied], q[tied])
            chosen = np.concatenate(out)
            x, y = rep[p[chosen]], rep[q[chosen]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def compare_hubs(rows: DataFrame, need: int, percent: int) -> DataFrame:
    """a, b: each row (rep, label, n, sig) with that of its ``hubs`` (same fields) in another component that it agrees with most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs = batch.column("hubs")
            flat = hubs.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(hubs.offsets)))
            own = lambda c: np.asarray(batch.column(c))[owner]
            hub = lambda c: np.asarray(flat.field(c))
            w = (_sketch_matrix(batch.column("sig"))[owner] == _sketch_matrix(flat.field("sig"))).sum(1) if len(owner) else np.zeros(0, np.int64)
            ok = np.flatnonzero((w >= need) & (own("label") != hub("label")) & (100 * np.minimum(own("n"), hub("n")) >= percent * np.maximum(own("n"), hub("n"))))
            ok = ok[np.lexsort((-w[ok], owner[ok]))]
            ok = ok[np.r_[True, owner[ok][1:] != owner[ok][:-1]]] if len(ok) else ok
            x, y = own("rep")[ok], hub("rep")[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return rows.select("rep", "label", "n", "sig", "hubs").mapInArrow(run, "a long, b long")


class ChosenPathJoin:
    """One run over a table of classes (rep long, n_shingles long, f1 long, sig binary)."""

    def __init__(self, docs: DataFrame, classes: DataFrame, scratch: Scratch, k: int, percent: int, miss: float, leaf: int, depth: int):
        self.docs, self.classes, self.scratch, self.k, self.percent = docs, classes, scratch, k, percent
        self.miss, self.leaf, self.most, self.depth = miss, leaf, SMALL * leaf, depth
        self.need = least_agreement(percent / 100)
        self.labels: DataFrame | None = None
        self.sets: list[DataFrame] = []
        self.deep: list[DataFrame] = []
        self.step = 0

    def _name(self, what: str) -> str:
        self.step += 1
        return f"{what}_{self.step}"

    def components(self) -> DataFrame | None:
        """(node, component_id) of the classes that are linked."""
        shallow = trees_for(0, self.percent / 100, self.miss)
        low, high, deepest, source = 0, 1, 0, self.classes
        while low < high:
            tree = F.explode(F.expr(f"transform(sequence({low}, {high - 1}), t -> struct(xxhash64(t, substring(sig, 4 * t + 1, 4)) AS node, t))")).alias("x")
            deepest = max(deepest, self.descend(source.select("rep", tree).selectExpr("x.node", "rep", "CAST(x.t AS smallint) AS tree")))
            low = high
            high = shallow if low < shallow else trees_for(deepest, self.percent / 100, self.miss)
            if shallow <= low < high:  # more trees, for the members of nodes that branched
                source = self.classes.join(reduce(DataFrame.unionByName, self.deep).distinct(), "rep", "left_semi")
        return self.labels

    def labelled(self, rows: DataFrame) -> DataFrame:
        """node, rep, tree, label: the component that a class is known to be in, or itself."""
        if self.labels is None:
            return rows.select("node", "rep", "tree", F.col("rep").alias("label"))
        joined = rows.join(self.labels.withColumnRenamed("node", "rep"), "rep", "left")
        return joined.select("node", "rep", "tree", F.coalesce("component_id", "rep").alias("label"))

    def descend(self, rows: DataFrame) -> int:
        """Compares what meets in the trees with these roots (node, rep, tree); returns the depth reached."""
        level, scratch = 0, self.scratch
        while True:
            labelled = scratch.keep(self.labelled(rows), name := self._name("rows"))
            per = labelled.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
            nodes = scratch.keep(per.where("low <> high").select("node", "size"), self._name("nodes"))
            largest = nodes.agg(F.max("size")).first()[0]
            if largest is None:
                return level
            sketch = self.classes.select("rep", F.col("n_shingles").alias("n"), "sig")
            branching = largest > self.most and level < self.depth
            opened = scratch.keep(labelled.join(nodes, "node"), self._name("open"))
            members = sketch.join(F.broadcast(opened) if opened.count() <= BROADCAST_IDS // 2 else opened, "rep")
            if branching:
                large = scratch.keep(members.where(F.col("size") > self.most), self._name("large"))
                if level == 0:
                    self.deep.append(large.select("rep").distinct())
                self.confirm(self.star(large, level))
                members = members.where(F.col("size") <= self.most)
            members = self.with_deep(members)
            some = scratch.keep(promising(self.blocks(members), self.need, self.percent).distinct(), self._name("some"))
            self.fetch(some.select("rep").distinct())
            if self.sets:
                size = some.join(self.classes.select("rep", "n_shingles"), "rep").groupBy("node").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("total"))
                want = scratch.keep(self.labelled(labelled.join(some, ["node", "rep"], "left_semi")).join(size, "node"), self._name("want"))
                rows = want.count()
                full = self.with_deep(sketch.join(F.broadcast(want) if rows <= BROADCAST_IDS else want, "rep"))
                full = self.all_sets().join(F.broadcast(full) if rows <= BROADCAST_SKETCHES else full, "rep")
                self.contract(linked(self.blocks(full), self.need, self.percent))
            scratch.drop(name)
            if not branching:
                return level
            rows = self.branch(large)
            level += 1

    def with_deep(self, members: DataFrame) -> DataFrame:
        """members and ``deep``: whether a root of theirs branched, so that meeting in it decided nothing."""
        if not self.deep:
            return members.withColumn("deep", F.lit(False))
        ids = reduce(DataFrame.unionByName, self.deep).distinct().withColumn("deep", F.lit(True))
        return members.join(ids, "rep", "left").withColumn("deep", F.coalesce("deep", F.lit(False)))

    def blocks(self, members: DataFrame) -> DataFrame:
        """Rows of nodes in runs; nodes of more than ``leaf`` members, or BLOCK_SHINGLES of ``total``, are cut, and each two of their blocks meet."""
        count = F.ceil(F.col("size") / self.leaf)
        if "total" in members.columns:
            count = F.least(F.greatest(count, F.ceil(F.col("total") / BLOCK_SHINGLES)), F.col("size"))
        placed = members.withColumn("blocks", count.cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
        placed = placed.withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o")).withColumn("grp", F.xxhash64("node", "i", "j"))
        columns = ["grp", "node", "rep", "label", "n", "own", "i", "j", "tree", "deep", "sig", *["shingles"] * ("shingles" in members.columns)]
        return placed.select(*columns).repartition("grp").sortWithinPartitions("grp")

    def star(self, large: DataFrame, level: int) -> DataFrame:
        """Each member of a large node with the best of its hubs: linear in the members."""
        draw = F.min_by(F.struct("rep", "label", "n", "sig"), F.xxhash64("rep", F.lit(level))).alias("hub")
        hubs = large.groupBy("node", F.pmod(F.xxhash64("rep"), F.lit(HUBS)).alias("part")).agg(draw).groupBy("node").agg(F.collect_list("hub").alias("hubs"))
        return compare_hubs(large.join(hubs, "node"), self.need, self.percent)

    def branch(self, rows: DataFrame) -> DataFrame:
        """Children of each row: one branch, in a quarter of the nodes two."""
        coordinate = f"substring(sig, 4 * CAST(pmod(xxhash64(node, j), {COORDINATES}) AS int) + 1, 4)"
        ways = F.expr("CASE WHEN pmod(xxhash64(node, 'ways'), 4) = 0 THEN array(0, 1) ELSE array(0) END")
        children = rows.select("node", "rep", "sig", "tree", F.explode(ways).alias("j"))
        return children.select(F.expr(f"xxhash64(node, j, {coordinate})").alias("node"), "rep", "tree")

    def all_sets(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.sets)

    def confirm(self, pairs: DataFrame) -> None:
        """Verifies single pairs of hubs with members, by plain joins whose hot keys Spark can split."""
        percent = self.percent
        near = self.scratch.keep(pairs.distinct(), self._name("pairs"))
        self.fetch(near.select(F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))).distinct())
        if not self.sets:
            return

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x"), batch.column("y")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in "ab"], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        side = F.broadcast(near) if near.count() <= BROADCAST_IDS else near  # few pairs are brought to the sets, not all sets to the pairs
        x, y = self.all_sets().toDF("a", "x").join(side, "a"), self.all_sets().toDF("b", "y").join(side, "b")
        full = x.join(y, ["a", "b"]).select("a", "b", "x", "y")
        self.contract(full.mapInArrow(verify, "a long, b long"))

    def contract(self, links: DataFrame) -> None:
        """Takes links (a, b) into the components."""
        links = self.scratch.keep(links, self._name("links"))
        if not links.limit(1).count():
            return
        edges = links if self.labels is None else links.unionByName(self.labels.selectExpr("node AS a", "component_id AS b"))
        self.labels = self.scratch.keep(components(edges, self.scratch, self._name("cc")), self._name("labels"))

    def fetch(self, wanted: DataFrame) -> None:
        """Writes the full sets of classes that have none yet, from the text of their representatives."""
        if self.sets:
            wanted = wanted.join(self.all_sets().select("rep"), "rep", "left_anti")
        wanted = self.scratch.keep(wanted.join(self.classes.select("rep", "n_shingles", "f1"), "rep"), self._name("wanted"))
        n, k = wanted.count(), self.k
        if not n:
            return

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    # of rows that share an id, the one that has the class's set
                    sets = list(shingle_sets(part.column("text"), k))
                    own = [len(s) == m and int(s.sum(dtype=np.uint64).astype(np.int64)) == f for s, m, f in zip(sets, part.column("n_shingles").to_pylist(), part.column("f1").to_pylist())]
                    yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "shingles"]).filter(pa.array(own, pa.bool_()))

        side = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
        texts = self.docs.selectExpr("CAST(doc_id AS bigint) AS rep", "text").join(side, "rep").select("rep", "text", "n_shingles", "f1")
        self.sets.append(self.scratch.keep(texts.mapInArrow(run, "rep long, shingles binary"), self._name("sets")))


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80, miss: float = MISS, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs (doc_id, text).

    Linked are documents with 100 * |A & B| >= percent * |A | B| of k-word shingle sets; component_id is
    the smallest doc_id reachable by links, kept says whether it is the row's own. Null and empty
    texts and those of white space only have no shingles and link with nothing. Rows that share a
    doc_id are one node with the links of each. A null doc_id links with nothing: its
    component_id is null and it is kept. Extra columns are ignored.
    """
    raw = scratch.keep(sketches(docs, k), "sketches")
    sized = raw.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = sized.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig"))
    classes = scratch.keep(classes, "classes")
    # rows that share an id tie their classes together; an id may stand for several classes
    one = classes.select("rep", "n_shingles", "f1", "f2")
    shared = sized.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    tied = sized.join(shared, "doc_id", "left_semi").select("doc_id", "n_shingles", "f1", "f2").join(one, ["n_shingles", "f1", "f2"]).selectExpr("doc_id AS a", "rep AS b")
    tied = scratch.keep(tied.distinct(), "tied")
    labels = ChosenPathJoin(docs, classes, scratch, k, percent, miss, leaf, depth).components()
    if tied.limit(1).count():
        edges = tied if labels is None else tied.unionByName(labels.selectExpr("node AS a", "component_id AS b"))
        labels = scratch.keep(components(edges, scratch, "cc_tied"), "labels_tied")
    reps = raw.select("doc_id", "n_shingles", "f1", "f2").join(one, ["n_shingles", "f1", "f2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    if labels is not None:
        reps = scratch.keep(reps, "reps").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        reps = reps.withColumn("component_id", F.lit(None).cast("long"))
    out = reps.select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, four-word shingles as its contract asks."""
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), Scratch(spark, "op1"), k=4)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(s) AS s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p:p + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (s) JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
      WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN c ON c.a = doc_id LEFT JOIN n USING (doc_id)
"""
