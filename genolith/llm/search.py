"""Ranked lexical search over an index of document shards.

A shard is a row: some documents' ids and, term by term, a CSR matrix of postings: the places of the documents
that hold a term, and their impacts, whole numbers that already hold a document's length and a term's frequency in it. What
depends on how rare a term is in the corpus is one weight for each term of a query. Queries go in blocks over all shards,
a term at a time, each adding its weighted impacts to a dense accumulator of the shard; the best are chosen with
all that tie with the last, and the best of the tasks are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genolith.llm.common import LOWER, UPPER, Scratch, read
from genolith.llm.terms import LETTERS_AND_DIGITS, terms

TOP = 50
#: Postings and documents of a shard, about; a document is always in one shard, and places are 16 bits wide.
POSTINGS, DOCUMENTS = 1_000_000, 65_000
#: Queries that go over the index together.
QUERIES = 2048
SCHEMA = "n_docs long, n_null long, ids binary, terms array<string>, counts array<int>, places binary, impacts binary"


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = 0
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                here = sum(map(len, terms(text.as_py(), LETTERS_AND_DIGITS))) if text.is_valid else 0
                n, size = n + (here > 0), size + here
        yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "size": pa.array([size])})

    total = docs.select("text").mapInArrow(run, "n long, size long").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    return total["n"] or 0, total["size"] or 0


def build_index(docs: DataFrame, n: int, size: int, postings: int = POSTINGS) -> DataFrame:
    """Shards (SCHEMA) of docs (doc_id, text), which have n documents with terms and ``size`` terms.

    Impact: 1000000000 * tf div (1000 * tf + 20 * m), m = 50 + 50 * length * n div size. Null ids come last in a shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        keys: list[bytes] = []
        tfs: list[int] = []
        ms: list[int] = []
        held: list[int] = []

        def shard() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            known = {t: i for i, t in enumerate(sorted(set(keys)))}
            term = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
            doc, tf = np.repeat(place, held), np.array(tfs, np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(np.array(ms, np.int64), held))
            by = np.lexsort((doc, term))
            plain = [ids[i] for i in order if ids[i] is not None]
            columns = {
                "n_docs": pa.array([len(ids)], pa.int64()),
                "n_null": pa.array([len(ids) - len(plain)], pa.int64()),
                "ids": pa.array([np.array(plain, "<i8").tobytes()], pa.binary()),
                "terms": pa.ListArray.from_arrays([0, len(known)], pa.array(list(known), pa.binary()).cast(pa.string())),
                "counts": pa.array([np.bincount(term, minlength=len(known)).astype(np.int32)], pa.list_(pa.int32())),
                "places": pa.array([doc[by].astype("<u2").tobytes()], pa.binary()),
                "impacts": pa.array([impact[by].astype("<u4").tobytes()], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                tf = Counter()
                for part in terms(text.as_py() if text.is_valid else b"", LETTERS_AND_DIGITS):
                    tf.update(part)
                if not tf:
                    continue
                ids.append(doc_id)
                keys.extend(tf)
                tfs.extend(tf.values())
                ms.append(50 + 50 * tf.total() * n // size)
                held.append(len(tf))
                if len(keys) >= postings or len(ids) >= DOCUMENTS:
                    yield shard()
                    for x in (ids, keys, tfs, ms, held):
                        x.clear()
        if ids:
            yield shard()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of the items, rows that share an id taken together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").cast(pa.binary())):
                own = set().union(*terms(text.as_py(), LETTERS_AND_DIGITS)) if text.is_valid else set()
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([item] * len(own), pa.int64()), "term": pa.array(list(own), pa.binary()).cast(pa.string())})

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term string").distinct()


def weigh(index: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """item_id, term, weight: floor(1000 * ln((2 * n + 2) / (2 * df + 1))), df from the shards. Terms that no document has are left out."""
    distinct = wanted.select("term").distinct()
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    df = held.join(distinct, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n + 2)) / (2.0 * F.col("df") + 1))).cast("long")
    return wanted.join(df.select("term", weight.alias("weight")), "term").select("item_id", "term", "weight")


def _best(scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores above 0, of equal ones the first; in no order."""
    found = np.flatnonzero(scores > 0)
    if len(found) <= top:
        return found
    values = scores[found]
    last = values[np.argpartition(values, len(values) - top)[len(values) - top]]
    above, level = found[values > last], found[values == last]
    return np.concatenate([above, level[: top - len(above)]])


def _search_block(index: DataFrame, block: list, top: int) -> DataFrame:
    """item (place in the block), doc_id, score: the best of each task for each query of the block."""
    vocabulary = sorted({t for r in block for t in r["terms"]})
    place = {t: i for i, t in enumerate(vocabulary)}
    queries = [(np.array([place[t] for t in r["terms"]]), np.array(r["weights"], np.int64)) for r in block]
    sent = index.sparkSession.sparkContext.broadcast((pa.array(vocabulary, pa.string()), queries))  # QUERIES queries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, queries = sent.value
        best: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(queries)
        for batch in batches:
            for r in range(batch.num_rows):
                n_docs, n_null = batch.column("n_docs")[r].as_py(), batch.column("n_null")[r].as_py()
                raw = {c: batch.column(c)[r].as_buffer() for c in ("ids", "places", "impacts")}
                ids = np.concatenate([np.frombuffer(raw["ids"], "<i8"), np.zeros(n_null, np.int64)])
                null = np.arange(n_docs) >= n_docs - n_null
                ends = np.concatenate([[0], np.cumsum(batch.column("counts")[r].values.to_numpy(), dtype=np.int64)])
                places, impacts = np.frombuffer(raw["places"], "<u2"), np.frombuffer(raw["impacts"], "<u4")
                at = pc.index_in(vocabulary, value_set=batch.column("terms")[r].values).fill_null(-1).to_numpy()
                cut: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for q, (own, weights) in enumerate(queries):
                    scores = np.zeros(n_docs, np.int64)
                    for t, w in zip(own.tolist(), weights.tolist()):
                        if (k := at[t]) >= 0 and w > 0:
                            if t not in cut:
                                part = slice(ends[k], ends[k + 1])
                                cut[t] = places[part].astype(np.int64), impacts[part].astype(np.int64)
                            where, what = cut[t]
                            scores[where] += w * what
                    found = _best(scores, top)
                    if len(found):
                        s, d, z = (np.concatenate(x) for x in zip(best[q], (scores[found], ids[found], null[found])))
                        keep = np.lexsort((d, z, -s))[:top]
                        best[q] = s[keep], d[keep], z[keep]
        for q, (s, d, z) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_pydict({"item": pa.array([q] * len(s), pa.int32()), "doc_id": pa.array(d, pa.int64(), mask=z), "score": pa.array(s, pa.int64())})

    return index.mapInArrow(run, "item int, doc_id long, score long")


def search(index: DataFrame, wanted: DataFrame, scratch: Scratch, top: int = TOP, block: int = QUERIES) -> DataFrame:
    """item_id, rank, doc_id, score: each query's ``top`` documents, from ``wanted`` (item_id, term, weight).

    Queries are dealt into blocks of about ``block``, by hash; one block at a time is on the driver and goes over all shards.
    """
    items = wanted.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("t")).select("item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    items = scratch.keep(items, "queries")
    blocks = max(1, math.ceil(items.count() / block))
    out = None
    for b in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if held:
            names = index.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(held)], "item int, item_id long")
            found = _search_block(index, held, top).join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
            found = scratch.keep(found, f"found_{b}") if blocks > 1 else found
            out = found if out is None else out.unionByName(found)
    if out is None:
        return index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, scratch: Scratch, top: int = TOP, postings: int = POSTINGS, block: int = QUERIES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents (doc_id, text) with a score above 0 for each item (item_id, text).

    Equal scores come in the order of doc_id, a null doc_id after all others; rows that share a doc_id are documents of
    their own. Null texts and those without terms match nothing. Rows that share an item_id are one query of all their terms; a
    null item_id is one like others. Extra columns are ignored; empty tables give no rows.
    """
    n, size = corpus_size(docs)
    index = scratch.keep(build_index(docs, n, size, postings), "index")
    wanted = scratch.keep(query_terms(items), "wanted")
    weighed = scratch.keep(weigh(index, wanted, n), "weighed")
    return search(index, weighed, scratch, top, block)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents for each item of the benchmark."""
    return ranked_search(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"), Scratch(spark, "op12"))


_TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
e AS (SELECT r, doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
c AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM e),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM e) GROUP BY 1, 2, 3, 4),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT item_id, term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM i JOIN df USING (term), c),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // l))))::BIGINT AS score FROM w JOIN tf USING (term), c GROUP BY 1, 2, 3)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {TOP}
"""
