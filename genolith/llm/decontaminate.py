"""Benchmark items inside documents: size-partitioned MinHash containment search.

The items are cut into size classes (powers of two of their shingle count). Of each item the minwise hash selects its
lowest shingles, as many as its class needs: a document that holds the threshold's share of an item lacks few of its
shingles, so in small classes one more than it may lack is selected and no item can be missed; in larger ones ``tokens``
are, and an item at containment 0.8 is missed with a probability under 0.2 ** tokens. One shared token makes a candidate. A
document is held only against classes whose smallest possible match it has shingles for. The candidates' texts are
written, and verified by exact shingle containment. DataFrame functions only; documents are never sketched or cut,
however long they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genolith.llm.common import Scratch, read

#: Rows of shingles or tokens (some 50 bytes each) that may be broadcast; more are joined by a shuffle, whose hot keys Spark splits.
BROADCAST_ROWS = 1_000_000


def with_words(df: DataFrame, *keys: str) -> DataFrame:
    """keys and ``w``: lower-cased runs of letters and digits of ``text``; null and empty texts have none.

    Two projections, so that the text is cut once.
    """
    parts = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    first = F.when(F.get("p", 0) == "", 1).otherwise(0)
    last = F.when((F.size("p") > 1) & (F.element_at("p", -1) == ""), 1).otherwise(0)
    return df.select(*keys, parts.alias("p")).select(*keys, F.slice("p", first + 1, F.greatest(F.size("p") - first - last, F.lit(0))).alias("w"))


def exploded_shingles(words: DataFrame, k: int, *keys: str) -> DataFrame:
    """keys, n_words, n, h: a row for each run of k words, with repeats.

    Positions are exploded and hashed outside of a lambda: generator, hash and the probe of a
    broadcast table that follows compile into one stage.
    """
    at = words.where(F.size("w") >= k).select(*keys, "w", F.explode(F.expr(f"sequence(0, size(w) - {k})")).alias("i"))
    return at.select(*keys, F.size("w").alias("n_words"), F.lit(k).alias("n"), F.expr(f"xxhash64({', '.join(f'w[i + {j}]' for j in range(k))})").alias("h"))


def item_shingles(items: DataFrame, k: int) -> DataFrame:
    """item_id, n (words in a shingle), h: distinct shingles. An item of under k words is one shingle of all its words."""
    w = with_words(items.where("item_id IS NOT NULL"), "item_id")
    out = exploded_shingles(w, k, "item_id")
    for n in range(1, k):
        out = out.unionByName(exploded_shingles(w.where(F.size("w") == n), n, "item_id"))
    return out.select("item_id", "n", "h").distinct()


def contained_items(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 5, threshold: float = 0.8, tokens: int = 9) -> DataFrame:
    """doc_id, item_id, matched long, item_shingles long, containment double: all pairs found with containment >= threshold.

    Repeated item_ids count as one item. Rows that share a doc_id count as one document once one
    of them alone is long enough for the item and shares a token with it; rows with a null id are left out; null and empty texts contain nothing and
    are contained in nothing. Extra columns are ignored.
    """
    target = scratch.keep(item_shingles(items, k), "items")
    sizes = target.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    sized = target.join(sizes, "item_id")
    # class 2^c <= size < 2^(c+1): the least that a document must hold for any item of the class
    low = F.pow(F.lit(2.0), F.floor(F.log2("item_shingles")))
    need = F.ceil(low * threshold - 1e-9)
    # a match lacks at most this many shingles of an item of the class
    lacks = F.floor((2 * low - 1) * (1 - threshold) + 1e-9)
    order = Window.partitionBy("item_id").orderBy(F.xxhash64("h", F.lit(1)), "h", "n")  # of one item
    signature = sized.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.least(lacks + 1, F.lit(tokens)))
    signature = scratch.keep(signature.select("item_id", "n", need.alias("need"), "h"), "signature")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    lengths = [r["n"] for r in target.select("n").distinct().collect()]  # at most k values

    def exploded(source: DataFrame) -> DataFrame:
        w = with_words(source.where("doc_id IS NOT NULL AND text IS NOT NULL"), "doc_id")
        parts = [exploded_shingles(w, n, "doc_id") for n in lengths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    schema = "doc_id, item_id, matched, item_shingles, matched / item_shingles AS containment"
    if not lengths:
        return docs.where("false").selectExpr("doc_id", "CAST(NULL AS bigint) AS item_id", "0L AS matched", "0L AS item_shingles", "0D AS containment")
    candidates = exploded(docs).join(small(signature.drop("n")), "h").where("n_words - n + 1 >= need").select("doc_id", "item_id").distinct()
    candidates = scratch.keep(candidates, "candidates")
    # written first: else the optimizer cuts every text into words once more below this join
    again = scratch.keep(docs.select("doc_id", "text").join(candidates.select("doc_id").distinct(), "doc_id", "left_semi"), "again")
    hits = exploded(again).join(small(sized.drop("n")), "h").select("doc_id", "item_id", "item_shingles", "h")
    matched = hits.distinct().groupBy("doc_id", "item_id", "item_shingles").agg(F.count("*").alias("matched"))
    exact = matched.where(F.col("matched") >= F.col("item_shingles") * F.lit(threshold)).join(candidates, ["doc_id", "item_id"], "left_semi")
    return exact.selectExpr(*schema.split(", "))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items against all documents."""
    return contained_items(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"), Scratch(spark, "op9"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda p: list_aggregate(w[p:p + 4], 'string_agg', ' '))) AS s FROM d WHERE len(w) >= 5)),
s AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 3), lambda p: list_aggregate(w[p:p + 4], 'string_agg', ' '))) AS s FROM i WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY 1)
SELECT doc_id, item_id, count(*) AS matched, item_shingles, count(*) / item_shingles AS containment
FROM ds JOIN s USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING count(*) >= 0.8 * item_shingles
"""
