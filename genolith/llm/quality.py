"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is a 4-gram over classes of UTF-8 bytes (CLASSES of them, a fixed rule). 4-gram counts of the trusted texts
are summed in tables dealt by the hash of the gram; the lower orders are continuation counts. Joins of counts with the
sums of their contexts give discounts, probabilities and back-off weights, all as tables.

A document's distinct 4-grams, with their counts, are joined with those tables: the probability of a seen gram is
looked up, an unseen one takes the weight of its context and the next lower order. The sum over a document is its
log-perplexity. Count tables of a known small size are broadcast; larger ones are joined shard by shard, by a shuffle.

Perplexities of all documents, by language, give the thresholds by their quantiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.llm.common import Scratch, read
from genolith.llm.shingles import chunks, text_bytes

BITS, ORDER = 6, 4
CLASSES = 1 << BITS
#: A document is rejected if its log-perplexity is beyond the median of its language by more than
#: REACH times the way from the 5 % quantile to the median, or MARGIN if that is more, and by
#: NOISE / sqrt(bytes) on top: short texts vary more. It is rejected as far below the median too (repeated words).
REACH, MARGIN, NOISE = 2.0, 0.05, 2.0
#: Rows of a count table (16 bytes each), or trusted ids, that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Texts are cut into 4-grams in pieces of about so many bytes.
PIECE = 1 << 20


def byte_classes() -> np.ndarray:
    """Class of each byte: letters each their own, upper and lower apart; digits, marks and non-ASCII bytes in groups."""
    table = np.full(256, 0, np.uint8)
    table[[9, 10, 13]] = 1
    table[ord(".")], table[ord(",")] = 2, 3
    for i in range(26):
        table[ord("a") + i], table[ord("A") + i] = 4 + i, 30 + i
    table[48:58] = 56
    marks = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"]
    table[marks] = 57
    table[[ord(c) for c in "'\"()-:;?"]] = 58
    table[0xC0:] = 59
    table[0x80:0xC0] = 60 + np.arange(64) % 4
    return table


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram index at each byte, offsets of the texts); a text is preceded by line ends."""
    raw, at = text_bytes(texts)
    code = byte_classes()[raw].astype(np.uint32)
    index = code.copy()
    starts, ends = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0]
    for back in range(1, ORDER):
        before = np.empty_like(code)
        before[back:] = code[:-back] if back <= len(code) else 0
        for k in range(back):  # positions with fewer than ``back`` bytes before them in their text
            before[np.minimum(starts + k, ends - 1)[starts + k < ends]] = 1
        index |= before << np.uint32(BITS * back)
    return index, at


def gram_counts(docs: DataFrame) -> DataFrame:
    """The columns of docs but for text, then ``grams`` (array of gram, n): the distinct 4-grams of each row's text, none for a null or empty one."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=PIECE):
                index, at = grams(part.column("text"))
                owner = np.repeat(np.arange(part.num_rows, dtype=np.uint64), np.diff(at))
                both, n = np.unique(owner << np.uint64(BITS * ORDER) | index, return_counts=True)
                offsets = np.searchsorted(both >> np.uint64(BITS * ORDER), np.arange(part.num_rows + 1, dtype=np.uint64))
                pairs = pa.StructArray.from_arrays([pa.array((both & np.uint64((1 << BITS * ORDER) - 1)).astype(np.int64)), pa.array(n.astype(np.int32))], ["gram", "n"])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], names=[*keep, "grams"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.select(*keep, "text").mapInArrow(run, ", ".join(x for x in (schema, "grams array<struct<gram:bigint,n:int>>") if x))


def trusted_rows(docs: DataFrame, labels: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """All rows of docs whose doc_id is labelled as good. Up to ``most`` ids are broadcast; more are joined by a shuffle."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(F.broadcast(good) if good.count() <= most else good.hint("shuffle_hash"), "doc_id", "left_semi")


class Model:
    """Tables of an interpolated modified Kneser-Ney model.

    ``seen[k]`` (g, p): log-probability of a seen k-gram's last class given those before; ``weight[k]`` (h, w): log of
    the back-off weight of a context of k - 1 classes. Order 2 holds all pairs. Lower orders use continuation counts; three discounts
    for each order from its counts of counts (Chen and Goodman); order 0 is uniform. Without any count all is uniform.
    """

    def __init__(self, texts: DataFrame, scratch: Scratch):
        spark = scratch.spark
        counts = gram_counts(texts.select("text")).select(F.explode("grams").alias("x")).groupBy("x.gram").agg(F.sum("x.n").alias("c"))
        tables = {ORDER: scratch.keep(counts.selectExpr("gram AS g", "c"), f"counts_{ORDER}")}
        for order in range(ORDER - 1, 0, -1):
            shorter = tables[order + 1].select((F.col("g") % (1 << BITS * order)).alias("g")).groupBy("g").agg(F.count("*").alias("c"))
            tables[order] = scratch.keep(shorter, f"counts_{order}")
        self.seen, self.weight = {}, {}
        lower = spark.range(CLASSES).select(F.col("id").alias("g"), F.lit(1 / CLASSES).alias("p"))
        for order in range(1, ORDER + 1):
            discounted = tables[order].withColumn("off", self._discount(tables[order])).withColumn("h", F.shiftright("g", BITS))
            contexts = discounted.groupBy("h").agg(F.sum("c").alias("total"), F.sum("off").alias("given"))
            own = discounted.join(contexts, "h").select("g", ((F.col("c") - F.col("off")) / F.col("total")).alias("own"))
            weight = contexts.select("h", (F.col("given") / F.col("total")).alias("w"))
            every = lower if order == 1 else spark.range(CLASSES**2).select(F.col("id").alias("g")) if order == 2 else tables[order].select("g")
            if order > 1:
                every = every.withColumn("l", F.col("g") % (1 << BITS * (order - 1))).join(lower.withColumnRenamed("g", "l"), "l").select("g", "p")
            mixed = every.withColumn("h", F.shiftright("g", BITS)).join(weight, "h", "left").join(own, "g", "left")
            lower = scratch.keep(mixed.select("g", (F.coalesce("own", F.lit(0.0)) + F.coalesce("w", F.lit(1.0)) * F.col("p")).alias("p")), f"seen_{order}")
            self.seen[order] = lower.select("g", F.log("p").alias("p"))
            self.weight[order] = scratch.keep(weight.select("h", F.log("w").alias("w")), f"weight_{order}")

    @staticmethod
    def _discount(table: DataFrame) -> "F.Column":
        n1, n2, n3, n4 = table.agg(*[F.sum((F.col("c") == k).cast("long")) for k in (1, 2, 3, 4)]).first()
        n1, n2, n3, n4 = (x or 0 for x in (n1, n2, n3, n4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        one, two, more = (min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))
        return F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).otherwise(more)

    def log_sums(self, counted: DataFrame, *keys: str) -> DataFrame:
        """keys, ``nll`` (mean negative log-probability of a byte's class; null without bytes) and ``times``: a row for each
        distinct key of ``counted`` (keys, grams), with the number of its rows. The texts of a key's rows are the same.

        Each row is reduced to its sum where its grams are joined, so with broadcast tables nothing but sums is shuffled.
        """
        small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
        # a row without grams, and one more for each row, carry the number of rows
        x = counted.select(*keys, F.explode(F.expr("concat(array(named_struct('gram', -1L, 'n', 0)), grams)")).alias("_x"))
        x = x.select(*keys, F.col("_x.gram").alias("_g4"), F.col("_x.n").alias("_n")).withColumn("_h4", F.shiftright("_g4", BITS))
        x = x.withColumn("_g3", F.col("_g4") % CLASSES**3).withColumn("_h3", F.shiftright("_g3", BITS)).withColumn("_g2", F.col("_g4") % CLASSES**2)
        for table, name in ((self.seen[4], "4"), (self.weight[4], "4"), (self.seen[3], "3"), (self.weight[3], "3"), (self.seen[2], "2")):
            key, value = table.columns
            x = x.join(small(table.toDF(f"_{key}{name}", f"_{value}{name}")), f"_{key}{name}", "left")
        p3 = F.coalesce("_p3", F.coalesce("_w3", F.lit(0.0)) + F.col("_p2"))
        p = F.coalesce("_p4", F.coalesce("_w4", F.lit(0.0)) + p3)
        sums = x.groupBy(*keys).agg(F.sum(F.when(F.col("_n") > 0, p * F.col("_n"))).alias("_s"), F.sum("_n").alias("_m"), F.sum((F.col("_g4") < 0).cast("long")).alias("times"))
        return sums.select(*keys, (-F.col("_s") / F.nullif("_m", F.lit(0))).alias("nll"), "times")


def thresholds(scores: DataFrame) -> DataFrame:
    """lang, limit, floor: from the quantiles of ``nll`` over all rows of a language (null is one), each counted ``times``."""
    q = scores.where("nll IS NOT NULL").groupBy("lang").agg(F.percentile_approx("nll", [0.05, 0.5], 10_000).alias("q"))
    way = F.greatest((F.col("q")[1] - F.col("q")[0]) * REACH, F.lit(MARGIN))
    return q.select("lang", (F.col("q")[1] + way).alias("limit"), (F.col("q")[1] - way).alias("floor"))


def judge(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """scores (lang, n_bytes, nll, ...) with ``threshold`` (the upper one) and ``kept``; a null or empty text has no perplexity and is not kept."""
    limits = limits.select(F.col("lang").alias("_l"), "limit", "floor")
    joined = scores.join(limits, F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")
    noise = F.lit(NOISE) / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    inside = (F.col("nll") <= F.col("threshold")) & (F.col("nll") >= F.col("floor") - noise)
    return joined.withColumn("threshold", F.col("limit") + noise).withColumn("kept", F.coalesce(inside, F.lit(False))).drop("limit", "floor")


#: What tells texts apart once they are scored: two hashes of 64 bits, and the length.
_TEXT_KEY = ("xxhash64(text) AS h1", "xxhash64('2', text) AS h2", "octet_length(text) AS n_bytes")


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, lang, n_bytes, nll, threshold, kept and ``times``, the number of rows that are alike, for every row of docs (doc_id, lang, text)."""
    model = Model(trusted_rows(docs.select("doc_id", "text"), labels.select("doc_id", "quality")).select("text"), scratch)
    keyed = docs.selectExpr("doc_id", "lang", *_TEXT_KEY, "text")
    scores = scratch.keep(model.log_sums(gram_counts(keyed), "doc_id", "lang", "h1", "h2", "n_bytes"), "scores")
    every = scores.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times")))).select("lang", "nll")
    return judge(scores, scratch.keep(thresholds(every), "limits"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity, its threshold and whether it is kept; rows that are alike are returned as often as they are there."""
    judged = score(read(spark, sf_dir, "documents", "doc_id", "lang", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"), Scratch(spark, "op7"))
    every = judged.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return every.select("doc_id", "lang", F.exp("nll").alias("perplexity"), F.exp("threshold").alias("threshold"), "kept")


def filter_quality(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs (doc_id, lang, text and more) that are kept, with all their columns, whatever these are called.

    Null and empty texts go. Rows with the same language and text are judged alike, so repeats stay repeats. The verdict is carried
    back by the texts that are rejected, as hashes: Spark broadcasts them where they are few.
    """
    bad = score(docs.select("doc_id", "lang", "text"), labels, scratch).where("NOT kept").select("lang", "h1", "h2").distinct()
    bad = scratch.keep(bad, "rejected").toDF("_ql_lang", "_ql_h1", "_ql_h2")
    full = docs.where("text IS NOT NULL AND text <> ''")
    same = (F.xxhash64(full["text"]) == bad["_ql_h1"]) & (F.xxhash64(F.lit("2"), full["text"]) == bad["_ql_h2"]) & full["lang"].eqNullSafe(bad["_ql_lang"])
    return full.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, same, "left_anti")
