"""How the word use of sources differs: chi-square distances of all pairs of sources of a language, and each source's own terms.

Documents are counted once, in one shuffle: (language, chunk of the vocabulary) is its key, so that counts of groups,
the document frequency of terms, the choice of the vocabulary, places of terms within their chunk and the packed count vectors
(a row for each language, chunk and source) all follow without another. Sources of a language are dealt into blocks; packed
vectors are replicated to the tiles, block by block, that need them. A tile walks over successive chunks and adds up its pair
submatrix over the terms that either source has; all others of the vocabulary have one value for a pair, which is added
once, times their number. A tile's chunks are dealt to several tasks, whose submatrices are summed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genolith.llm.common import LOWER, UPPER, Scratch, read
from genolith.llm.terms import LETTERS, terms

#: Documents of a language that a term of its vocabulary is in at least.
MIN_DOCS = 3
#: Probabilities are whole parts of this number.
SCALE = 1_000_000_000
#: A source's own terms that are listed.
TOP_TERMS = 200
#: Chunks of each language's vocabulary at least; more where the session has more shuffle partitions.
CHUNKS = 4096
#: Runs of chunks that a tile is dealt out in.
SPANS = 512
#: Sources in a block, about.
BLOCK = 64
#: Terms over which a tile computes at once, about.
WIDTH = 16_384
#: Distinct terms, over all groups, that a counting task holds at most before it passes them on.
HELD = 500_000


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), df (documents); a row without a term for each group that has documents."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in groups.items():
            size = len(n) + 1
            columns = {
                "lang": pa.repeat(pa.scalar(lang, pa.string()), size),
                "source": pa.repeat(pa.scalar(source, pa.string()), size),
                "term": pa.array([None, *n], pa.binary()).cast(pa.string()),
                "n": pa.array([0, *n.values()], pa.int64()),
                "df": pa.array([0, *map(df.__getitem__, n)], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            n, df = groups.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for part in terms(text.as_py(), LETTERS):
                n.update(part)
                own.update(part)
            df.update(own)
            held += len(n) - before
            if held >= HELD:
                yield from rows()
                groups, held = {}, 0
    yield from rows()


def packed_counts(docs: DataFrame, chunks: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, chunk, source, n_all, n_first, v (array of place, term, n, total): the packed count vectors, over so many chunks.

    v holds the vocabulary's terms that the source has in this chunk: their place in it, their count in the source
    and in the language. n_all is the sum of its counts, n_first the number of terms whose first source this is. Each
    group has a row, which may be empty.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    found = docs.select(*text).mapInArrow(count_terms, "lang string, source string, term string, n long, df long")
    dealt = found.withColumn("chunk", F.pmod(F.xxhash64("lang", "term"), F.lit(chunks)).cast("int")).repartition("lang", "chunk")
    counts = dealt.groupBy("lang", "chunk", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "chunk", "term")
    used = counts.withColumns({"total": F.sum("n").over(term), "df": F.sum("df").over(term), "first": F.min("source").over(term)})
    used = used.where(f"term IS NULL OR df >= {min_docs}")
    placed = used.withColumn("place", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    has = F.col("term").isNotNull()
    return placed.groupBy("lang", "chunk", "source").agg(
        F.sum("n").alias("n_all"),
        F.count(F.when(has & (F.col("first") == F.col("source")), 1)).alias("n_first"),
        F.collect_list(F.when(has, F.struct("place", "term", "n", "total"))).alias("v"),
    )


def group_sizes(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, n, lang_n, terms (of the language's vocabulary), blocks, block, place: a row for each group."""
    sums = packed.groupBy("lang", "source").agg(F.sum("n_all").alias("n"), F.sum("n_first").alias("n_first"))
    lang = Window.partitionBy("lang")
    sized = sums.select("lang", "source", "n", F.sum("n").over(lang).alias("lang_n"), F.sum("n_first").over(lang).alias("terms"), F.ceil(F.count("*").over(lang) / block).cast("int").alias("blocks"))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    return dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1)


def _parts(n: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / whole), three digits at a time, so that no product is beyond 64 bits."""
    out, rest = np.divmod(n + 1, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return 1 + out


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Side:
    """Sources of one block in a tile: names and N + V by their place, and the counts of some successive chunks."""

    def __init__(self):
        self.names: dict[int, str] = {}
        self.whole: dict[int, int] = {}
        self.chunks: list[tuple[int, np.ndarray, np.ndarray]] = []

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends of each source's part, places and p; the chunks are gone then."""
        by: dict[int, list] = {}
        for place, at, n in self.chunks:
            by.setdefault(place, []).append((at, n))
        self.chunks = []
        ends, at, parts = np.zeros(len(self.names) + 1, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for place in sorted(by):
            a, n = (np.concatenate(x) for x in zip(*by[place]))
            at.append(a)
            parts.append(_parts(n, self.whole[place]))
            ends[place + 1] = len(a)
        return np.cumsum(ends), np.concatenate(at), np.concatenate(parts)

    def zero(self) -> np.ndarray:
        """p of a term that a source does not have."""
        return np.array([_parts(np.zeros(1, np.int64), self.whole[place])[0] for place in range(len(self.names))], np.int64)


def _submatrix(x, y, x0: np.ndarray, y0: np.ndarray, width: int) -> np.ndarray:
    """Row s, column t: the sum of f(s, t) less the value of a term that neither has, over the terms that either has. Sums are
    differences of running sums; these may wrap around, their differences do not."""
    (x_ends, x_at, x_parts), (y_ends, y_at, y_parts) = x, y
    out = np.zeros((len(x0), len(y0)), np.int64)
    y_zero = np.repeat(y0, np.diff(y_ends))

    def sums(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[y_ends])

    for s in range(len(x0)):
        own = slice(x_ends[s], x_ends[s + 1])
        p = np.full(width, x0[s])
        p[x_at[own]] = x_parts[own]
        has = np.zeros(width, bool)
        has[x_at[own]] = True
        p_there, both = p[y_at], has[y_at]
        # terms of t; terms of s, less those that t has too
        total = sums(_distance(p_there, y_parts) - np.where(both, _distance(p_there, y_zero), 0))
        total += _distance(x_parts[own][:, None], y0[None, :]).sum(axis=0)
        union = np.diff(y_ends) + (own.stop - own.start) - sums(both.astype(np.int64))
        out[s] = total - union * _distance(x0[s], y0)
    return out


def tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, item, value: sums for the ordered pairs of each tile, from its packed vectors in the order of chunks.

    Rows of chunk -1 come first and name the sources; those that are marked are in one task for each tile, where the whole
    vocabulary's share is added.
    """

    def rows() -> Iterator[tuple]:
        for batch in batches:
            at, n = batch.column("at"), batch.column("n")
            columns = [batch.column(c).to_pylist() for c in ("lang", "i", "j", "chunk", "source", "block", "place", "whole", "terms", "marked")]
            for k, row in enumerate(zip(*columns)):
                yield *row, at[k].values.to_numpy(zero_copy_only=False), n[k].values.to_numpy(zero_copy_only=False)

    for (lang, i, j), tile in groupby(rows(), key=lambda r: r[:3]):
        sides = {i: _Side(), j: _Side()}
        total: dict[tuple[int, int], np.ndarray] = {}
        zero: dict[int, np.ndarray] = {}

        def compute(width: int) -> None:
            held = {b: s.take() for b, s in sides.items()}
            for a, b in total:
                total[a, b] += _submatrix(held[a], held[b], zero[a], zero[b], width)

        vocabulary, mark, width = 0, False, 0
        for number, chunk in groupby(tile, key=lambda r: r[3]):
            widest = 0
            for _, _, _, _, source, block, place, whole, size, marked, at, n in chunk:
                side = sides[block]
                if number < 0:
                    side.names[place], side.whole[place], vocabulary = source, max(whole, 1), size
                    mark |= marked
                elif len(at):
                    side.chunks.append((place, width + at.astype(np.int64), n.astype(np.int64)))
                    widest = max(widest, int(at.max()) + 1)
            if number < 0:
                zero = {b: s.zero() for b, s in sides.items()}
                total = {(a, b): np.zeros((len(zero[a]), len(zero[b])), np.int64) for a, b in {(i, j), (j, i)}}
            width += widest
            if width >= WIDTH:
                compute(width)
                width = 0
        if width:
            compute(width)
        for (a, b), values in total.items():
            values = values + vocabulary * _distance(zero[a][:, None], zero[b][None, :]) if mark else values
            left, right = sides[a].names, sides[b].names
            pairs = [(s, t) for s in left for t in right if (a != b or s != t) and (mark or values[s, t])]
            columns = {"source": pa.array([left[s] for s, _ in pairs], pa.string()), "item": pa.array([right[t] for _, t in pairs], pa.string()), "value": pa.array([int(values[p]) for p in pairs], pa.int64())}
            yield pa.RecordBatch.from_pydict({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(pairs)), **columns})


def pair_values(packed: DataFrame, groups: DataFrame, chunks: int) -> DataFrame:
    """lang, source, item, value for all ordered pairs of sources of a language."""
    sized = groups.select("lang", "source", "block", "place", "blocks", "terms", (F.col("n") + F.col("terms")).alias("whole"))
    span = F.floor(F.col("chunk") * SPANS / chunks).cast("int")
    vectors = packed.where("size(v) > 0").select("lang", "source", "chunk", span.alias("span"), F.col("v.place").alias("at"), F.col("v.n").alias("n"), F.lit(False).alias("marked")).join(sized, ["lang", "source"])
    heads = sized.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(SPANS - 1))))
    heads = heads.withColumns({"chunk": F.lit(-1), "marked": F.col("span") == 0, "at": F.expr("CAST(array() AS array<int>)"), "n": F.expr("CAST(array() AS array<bigint>)")})
    tiles = vectors.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = tiles.repartition("lang", "i", "j", "span").sortWithinPartitions("lang", "i", "j", "chunk")
    found = dealt.select("lang", "i", "j", "chunk", "source", "block", "place", "whole", "terms", "marked", "at", "n")
    return found.mapInArrow(tile_pairs, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def own_terms(packed: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, item, value, rank: terms that a source uses more than its language, the most distant first."""
    rows = packed.select("lang", "source", F.explode("v").alias("v")).where("v.n > 0").join(groups.select("lang", "source", F.col("n").alias("size"), "lang_n", "terms"), ["lang", "source"])
    part = lambda n, whole: F.expr(f"1 + (CAST({SCALE} AS decimal(10,0)) * CAST({n} + 1 AS decimal(19,0))) div CAST({whole} AS decimal(19,0))")
    rows = rows.select("lang", "source", F.col("v.term").alias("item"), part("v.n", "size + terms").alias("p"), part("v.total", "lang_n + terms").alias("q")).where("p > q")
    rows = rows.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    # first among the terms of a salt, as one source may have most of the rows
    some = rows.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(16)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top).drop("salt")


def source_divergence(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block: int = BLOCK, chunks: int = CHUNKS) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source).

    ``pair``: each other source of the language, by its distance; ``term``: the source's own terms, the ``top`` most distant.
    Null texts, languages and sources are empty ones, and an empty language or source is one like others. Sources without terms
    are compared too; where a language has no vocabulary all its pairs are at 0. Repeated rows count each. Extra columns are
    ignored; no rows give none. Values are exact in 64 bits.
    """
    chunks = max(chunks, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = scratch.keep(packed_counts(docs, chunks, min_docs), "packed")
    groups = scratch.keep(group_sizes(packed, block), "groups")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    pairs = pair_values(packed, groups, chunks).withColumn("rank", ranked).withColumn("part", F.lit("pair"))
    own = own_terms(packed, groups, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(own).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return source_divergence(read(spark, sf_dir, "documents", "text", "lang", "source"), Scratch(spark, "op11"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3),
f AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, total FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS size FROM f GROUP BY 1, 2),
p AS (SELECT lang, source, term, f.n, (1 + (1000000000::HUGEINT * (f.n + 1)) // (size + v)::HUGEINT)::BIGINT AS p, (1 + (1000000000::HUGEINT * (total + 1)) // (l.n + v)::HUGEINT)::BIGINT AS q
      FROM f JOIN s USING (lang, source) JOIN l USING (lang)),
a AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
b AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM b
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
