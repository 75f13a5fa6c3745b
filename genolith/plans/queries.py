"""Report plans on the tables at hand, and the same in SQL.

windows, orders for alignments and indels, part for features, events for positions, letters of
documents for nucleotides. Doubles are rounded to six digits on both sides, so that the order of
summation does not show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.functions import intervals as iv
from genolith.operators import aggregates as agg
from genolith.operators import buckets as bk
from genolith.operators import enrich, joins
from genolith.plans import reports as rp

QUERIES, ORACLE_SQL = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- windows
def isw(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS align_id", "l_partkey AS part_id", "l_orderkey * 10 + l_linenumber AS isw_id", "l_linenumber AS distance", "CAST(l_quantity AS int) AS density", "l_discount AS pi", "l_tax AS gc", "l_discount * l_tax AS cv", "l_extendedprice AS length", "l_returnflag AS flag", "l_linestatus AS status",
    )


ISW = "isw AS (SELECT l_orderkey AS align_id, l_partkey AS part_id, l_orderkey * 10 + l_linenumber AS isw_id, l_linenumber AS distance, CAST(l_quantity AS INT) AS density, l_discount AS pi, l_tax AS gc, l_discount * l_tax AS cv, l_extendedprice AS length, l_returnflag AS flag, l_linestatus AS status FROM lineitem)"
INDEL = "indel AS (SELECT o_orderkey AS align_id, o_orderstatus AS type, CAST(floor(o_totalprice) AS BIGINT) AS extand, CAST(floor(o_totalprice / 10000) AS INT) AS len, o_orderpriority AS prio FROM orders)"
PGC = ["pi", "gc", "cv"]
PGC_SQL = ", ".join(f"round(avg({c}), 6) AS avg_{c}, round(stddev_pop({c}), 6) AS std_{c}" for c in PGC) + ", count(*) AS count"


def indel(spark, d) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey AS align_id", "o_orderstatus AS type", "CAST(floor(o_totalprice) AS bigint) AS extand", "CAST(floor(o_totalprice / 10000) AS int) AS len", "o_orderpriority AS prio")


def bands_sql(edges) -> str:
    return "bands(band, lo, hi) AS (VALUES " + ", ".join(f"({i + 1}, {lo}, {hi})" for i, (lo, hi) in enumerate(edges)) + ")"


@query(f"WITH {ISW} SELECT distance, {PGC_SQL} FROM isw GROUP BY distance")
def d1_pi_gc_cv(spark, d):
    return rp.metrics(isw(spark, d), ["distance"], PGC)


@query(f"WITH {ISW} SELECT density, {PGC_SQL} FROM isw GROUP BY density")
def d2_pi_gc_cv(spark, d):
    return rp.metrics(isw(spark, d), ["density"], PGC)


def _fold_sql(key: str, threshold: int, where: str = "true") -> str:
    return f"""h AS (SELECT {key} AS key, count(*) AS n, row_number() OVER (ORDER BY {key}) AS i FROM isw WHERE {where} GROUP BY {key}),
f AS (SELECT i, key, 1 AS bucket, CASE WHEN n >= {threshold} THEN 0 ELSE n END AS s FROM h WHERE i = 1
      UNION ALL SELECT h.i, h.key, f.bucket + CASE WHEN f.s = 0 THEN 1 ELSE 0 END, CASE WHEN f.s + h.n >= {threshold} THEN 0 ELSE f.s + h.n END FROM f JOIN h ON h.i = f.i + 1)"""


@query(f"WITH RECURSIVE {ISW}, {_fold_sql('density', 3000)} SELECT bucket, round(avg(density), 6) AS avg_key, {PGC_SQL} FROM isw JOIN f ON key = density GROUP BY bucket")
def comb_pi_gc_cv(spark, d):
    return rp.combined_metrics(isw(spark, d), "density", PGC, 3000)


@query(f"WITH RECURSIVE {ISW}, {_fold_sql('density', 2000, chr(102) + 'lag = ' + chr(39) + 'R' + chr(39))}, t AS (SELECT max(bucket) AS b, bool_or(i = (SELECT max(i) FROM h) AND s > 0) AS open FROM f) SELECT CASE WHEN t.open AND f.bucket = t.b AND t.b > 1 THEN t.b - 1 ELSE f.bucket END AS bucket, round(avg(density), 6) AS avg_key, {PGC_SQL} FROM isw JOIN f ON key = density CROSS JOIN t WHERE flag = 'R' GROUP BY 1")
def comb_coding_merge_last(spark, d):
    return rp.combined_metrics(isw(spark, d).where("flag = 'R'"), "density", PGC, 2000, merge_last=True)


GROUPS = [(1, 1), (2, 2), (3, 4), (3, 5), (5, 7), (2, 7)]


@query(f"WITH {ISW}, {bands_sql(GROUPS)} SELECT band, {PGC_SQL}, round(sum(length) * 100 / (SELECT sum(length) FROM isw), 6) AS length_share FROM isw JOIN bands ON distance BETWEEN lo AND hi GROUP BY band")
def group_distance(spark, d):
    return rp.length_share(isw(spark, d), "distance", "length", bk.bands(spark, GROUPS), PGC)


@query(f"""WITH {ISW}, k AS (SELECT density, sum(length) AS w FROM isw GROUP BY 1), r AS (SELECT density, coalesce(sum(w) OVER (ORDER BY density DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(w) OVER () AS t FROM k)
SELECT density, {PGC_SQL} FROM isw WHERE density IN (SELECT density FROM r WHERE b < t * 0.05) GROUP BY density""")
def last_portion(spark, d):
    top = bk.top_portion(isw(spark, d), F.col("density"), F.col("length"), 0.05)
    return rp.metrics(isw(spark, d).join(F.broadcast(top.withColumnRenamed("key", "density")), "density", "left_semi"), ["density"], PGC)


@query(f"WITH {ISW} SELECT flag, distance, {PGC_SQL} FROM isw WHERE flag IN ('R', 'N') GROUP BY flag, distance")
def coding_split(spark, d):
    return rp.metrics(isw(spark, d).where(F.col("flag").isin("R", "N")), ["flag", "distance"], PGC)


@query(f"WITH {ISW}, {INDEL} SELECT type, distance, {PGC_SQL} FROM isw JOIN indel USING (align_id) WHERE type IN ('O', 'F') GROUP BY type, distance")
def slippage_split(spark, d):
    return rp.metrics(isw(spark, d).join(indel(spark, d), "align_id").where(F.col("type").isin("O", "F")), ["type", "distance"], PGC)


DENSITIES = [(1, 2), (3, 6), (7, 10), (11, 18), (19, 50)]


@query(f"WITH {ISW}, {bands_sql(DENSITIES)} SELECT band, distance, {PGC_SQL} FROM isw JOIN bands ON density BETWEEN lo AND hi WHERE distance <= (lo + 1) / 2.0 GROUP BY band, distance")
def dd_group(spark, d):
    return rp.density_distance(isw(spark, d), bk.bands(spark, DENSITIES), PGC)


LENGTHS = [(1, 5), (6, 10), (11, 50), (51, 300)]


@query(f"WITH {ISW}, {INDEL}, {bands_sql(LENGTHS)} SELECT band, distance, {PGC_SQL} FROM isw JOIN indel USING (align_id) JOIN bands ON len BETWEEN lo AND hi WHERE density > 9 AND distance <= 5 GROUP BY band, distance")
def indel_length_group(spark, d):
    rows = isw(spark, d).where("density > 9 AND distance <= 5").join(indel(spark, d), "align_id")
    return rp.banded_metrics(rows, F.col("len"), bk.bands(spark, LENGTHS), ["distance"], PGC)


@query(f"WITH {ISW}, {INDEL}, {bands_sql([(0, 300), (301, 900), (901, 99999)])} SELECT band, distance, {PGC_SQL} FROM isw JOIN indel USING (align_id) JOIN bands ON floor(extand / 100.0) BETWEEN lo AND hi GROUP BY band, distance")
def indel_extand_group(spark, d):
    rows = isw(spark, d).join(indel(spark, d), "align_id")
    return rp.banded_metrics(rows, bk.floor_bin(F.col("extand"), 100), bk.bands(spark, [(0, 300), (301, 900), (901, 99999)]), ["distance"], PGC)


@query(f"WITH {ISW}, c(pos, flag, status) AS (VALUES (1, 'R', 'F'), (2, 'N', 'F'), (3, 'N', 'O'), (4, 'A', 'F')) SELECT pos, distance, {PGC_SQL} FROM isw JOIN c USING (flag, status) GROUP BY pos, distance")
def indel_position_group(spark, d):
    combos = spark.createDataFrame([(1, "R", "F"), (2, "N", "F"), (3, "N", "O"), (4, "A", "F")], "pos int, flag string, status string")
    return rp.metrics(isw(spark, d).join(F.broadcast(combos), ["flag", "status"]), ["pos", "distance"], PGC)


@query(f"WITH {ISW}, {INDEL}, {bands_sql([(0.0, 0.02), (0.03, 0.05), (0.06, 0.08)])} SELECT band, distance, {PGC_SQL} FROM isw JOIN indel USING (align_id) JOIN bands ON gc BETWEEN lo AND hi WHERE len >= 5 GROUP BY band, distance")
def indel_gc_group(spark, d):
    rows = isw(spark, d).join(indel(spark, d).where("len >= 5"), "align_id")
    return rp.banded_metrics(rows, F.col("gc"), bk.bands(spark, [(0.0, 0.02), (0.03, 0.05), (0.06, 0.08)]), ["distance"], PGC)


@query("""WITH c AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_totalprice AS price, n, o_orderkey AS k, sum(n) OVER (ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM orders JOIN c ON c.k = o_orderkey)
SELECT CAST(floor((run - n) / 2000.0) AS BIGINT) + 1 AS piece, round(avg(price), 6) AS avg_price, round(stddev_pop(price), 6) AS std_price, round(avg(n), 6) AS avg_n, round(stddev_pop(n), 6) AS std_n, count(*) AS count FROM o GROUP BY 1""")
def snp_indel_ratio(spark, d):
    counted = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_totalprice AS price").join(counted, "k")
    return rp.sorted_pieces(rows, [-F.col("price"), F.col("k")], F.col("n"), 2000.0, ["price", "n"])


def greedy_sql(rows: str, piece: float, by: str | None = None) -> str:
    """cut: the running weights at which pieces end, from ``rows`` (run, n and a group)."""
    g = by or "0"
    return f"""cut AS (SELECT g, 0 AS piece, 0::HUGEINT AS begun FROM (SELECT DISTINCT {g} AS g FROM {rows}) UNION ALL SELECT c.g, c.piece + 1, min(o.run)::HUGEINT FROM cut c JOIN {rows} o ON {("o." + by) if by else g} = c.g AND o.run >= c.begun + {piece} GROUP BY c.g, c.piece),
cuts AS (SELECT g, piece, begun, coalesce(lead(begun) OVER (PARTITION BY g ORDER BY piece), 9223372036854775807) AS until FROM cut)"""


@query(f"""WITH RECURSIVE n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_totalprice AS price, n, k, sum(n) OVER (ORDER BY o_totalprice DESC, k ROWS UNBOUNDED PRECEDING) AS run FROM orders JOIN n ON k = o_orderkey), {greedy_sql("o", 333)}
SELECT piece + 1 AS piece, round(avg(sqrt(price)), 6) AS avg_root, round(avg(n), 6) AS avg_n, count(*) AS count, CAST(sum(n) AS BIGINT) AS sum_length FROM o JOIN cuts ON run - n >= begun AND run - n < until GROUP BY piece""")
def greedy_pieces(spark, d):
    counted = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_totalprice AS price").join(counted, "k")
    return rp.level_pieces(rows, [], [F.desc("price"), F.col("k")], "n", 333, {"root": F.sqrt("price"), "n": F.col("n")})


_PARTS = f"""o AS (SELECT p_brand AS level, p_partkey AS k, p_retailprice AS price, p_size AS n, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS run FROM part), {greedy_sql("o", 500, "level")},
s AS (SELECT level, piece + 1 AS piece, avg(sqrt(price)) AS avg_root, avg(n) AS avg_size, count(*) AS count, CAST(sum(n) AS BIGINT) AS sum_length FROM o JOIN cuts ON g = level AND run - n >= begun AND run - n < until GROUP BY level, piece)"""


def _part_pieces(spark, d) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_brand AS level", "p_partkey AS k", "p_retailprice AS price", "p_size AS n")
    return rp.level_pieces(rows, ["level"], [F.desc("price"), F.col("k")], "n", 500, {"root": F.sqrt("price"), "size": F.col("n")})


@query(f"WITH RECURSIVE {_PARTS} SELECT level, piece, round(avg_root, 6) AS avg_root, round(avg_size, 6) AS avg_size, count, sum_length FROM s")
def segment_sorted_pieces(spark, d):
    return _part_pieces(spark, d)


@query(f"WITH RECURSIVE {_PARTS} SELECT level, 'avg_size' AS y, count(*) AS n, round(regr_r2(avg_size, avg_root), 6) AS r2, round(regr_intercept(avg_size, avg_root), 4) AS intercept, round(regr_slope(avg_size, avg_root), 6) AS slope FROM s GROUP BY level")
def segment_piece_fits(spark, d):
    return rp.level_fits(_part_pieces(spark, d), ["level"], "avg_root", ["avg_size"]).drop("p").withColumn("intercept", F.round("intercept", 4))


@query("SELECT p_size, count(*) AS count, round(avg(p_retailprice), 6) AS avg_p_retailprice, CAST(sum(p_size) AS BIGINT) AS sum_length, coalesce(count(*) > lag(count(*)) OVER (ORDER BY p_size), false) AS special FROM part GROUP BY p_size")
def indel_length_hist(spark, d):
    return rp.length_histogram(table(spark, d, "part"), "p_size", ["p_retailprice"])


@query(f"WITH {ISW}, c AS (SELECT distance, CASE WHEN flag < status THEN flag || status ELSE status || flag END AS pair, count(*) AS count FROM isw GROUP BY 1, 2) SELECT distance, pair, count, round(count / sum(count) OVER (PARTITION BY distance), 6) AS share FROM c")
def base_pair_share(spark, d):
    return rp.pair_shares(isw(spark, d), "flag", "status", "distance")


@query(f"WITH {ISW}, c AS (SELECT distance, CASE WHEN flag || status IN ('AF', 'RF') THEN 'Tri' ELSE 'Trv' END AS kind, count(*) AS count FROM isw GROUP BY 1, 2) SELECT distance, kind, count, round(count / sum(count) OVER (PARTITION BY distance), 6) AS share FROM c")
def tri_trv(spark, d):
    kind = F.when(F.concat("flag", "status").isin("AF", "RF"), "Tri").otherwise("Trv").alias("kind")
    counted = isw(spark, d).groupBy("distance", kind).agg(F.count("*").alias("count"))
    return counted.withColumn("share", bk.share(F.col("count"), "distance"))


@query(f"""WITH {ISW}, q AS (SELECT quantile_cont(length, [0, 0.25, 0.5, 0.75, 1]) AS q FROM isw), l AS (SELECT i AS band, q[i] AS lo, q[i + 1] AS hi FROM q, range(1, 5) t(i))
SELECT band, distance, {PGC_SQL} FROM isw JOIN l ON length BETWEEN lo AND hi GROUP BY band, distance""")
def quartile_levels(spark, d):
    return rp.quantile_metrics(isw(spark, d), "length", ["distance"], PGC)


_STAT = "round(avg({c}), 4) AS average, round(min({c}), 6) AS minimum, round(max({c}), 6) AS maximum, round(stddev_pop({c}), 4) AS std, count({c}) AS count, round(CAST(sum(CAST({c} AS DECIMAL(28, 10))) AS DOUBLE), 1) AS sum"


def _stat_rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"average": F.round("average", 4), "std": F.round("std", 4), "sum": F.round("sum", 1)})


@query(f"WITH {ISW} " + " UNION ALL ".join(f"SELECT '{c}' AS type, {_STAT.format(c=c)} FROM isw" for c in (*PGC, "length")))
def summary_stats(spark, d):
    return _stat_rounded(agg.column_stat(isw(spark, d), [*PGC, "length"]))


@query(f"WITH {ISW}, {INDEL} " + " UNION ALL ".join(f"SELECT prio, '{c}' AS type, {_STAT.format(c='CAST(' + c + ' AS DOUBLE)')} FROM indel GROUP BY prio" for c in ("len", "extand")))
def summary_by_type(spark, d):
    return _stat_rounded(agg.column_stat(indel(spark, d), ["len", "extand"], by=["prio"]))


@query(f"""WITH {ISW}, a AS (SELECT align_id, sum(length) AS total FROM isw GROUP BY 1) SELECT round(sum(pi * length) / sum(length), 6) AS weighted_pi, round(avg(pi) / nullif(avg(gc), 0), 6) AS ratio_of_means,
round(avg(pi / nullif(gc, 0)), 6) AS mean_of_ratios, round(avg(power(pi, 2)), 6) AS mean_square, round(max(pi) - min(pi), 6) AS pi_range, round(-0.75 * log2(1 - 4.0 / 3 * avg(pi)), 6) AS d_on_average, round(-0.75 * ln(1 - 4.0 / 3 * avg(pi)), 6) AS jc,
(SELECT round(avg(total), 6) FROM a) AS avg_total, count(DISTINCT align_id) AS aligns FROM isw""")
def basic_facts(spark, d):
    w = isw(spark, d)
    nested = w.groupBy("align_id").agg(F.sum("length").alias("total")).agg(F.avg("total").alias("avg_total"))
    pi = F.avg("pi")
    facts = w.agg(agg.weighted_mean(F.col("pi"), F.col("length")).alias("weighted_pi"), agg.ratio_of_means(F.col("pi"), F.col("gc")).alias("ratio_of_means"), agg.mean_of_ratios(F.col("pi"), F.col("gc")).alias("mean_of_ratios"), F.avg(F.pow("pi", F.lit(2))).alias("mean_square"), agg.value_range(F.col("pi")).alias("pi_range"), agg.log2_distance(pi).alias("d_on_average"), agg.jukes_cantor(pi).alias("jc"), F.countDistinct("align_id").alias("aligns"))
    return facts.crossJoin(nested)  # one row each


@query("SELECT (i - 1) // 3 + 1 AS step, max(CASE WHEN (i - 1) % 3 = 0 THEN v END) AS operation, max(CASE WHEN (i - 1) % 3 = 1 THEN v END) AS duration, max(CASE WHEN (i - 1) % 3 = 2 THEN v END) AS command FROM (SELECT n_nationkey + 1 AS i, n_name AS v FROM nation) GROUP BY 1")
def process_triples(spark, d):
    rows = table(spark, d, "nation").selectExpr("CAST(n_nationkey DIV 3 + 1 AS bigint) AS step", "n_nationkey % 3 AS m", "n_name")
    return rows.groupBy("step").agg(*[F.max(F.when(F.col("m") == i, F.col("n_name"))).alias(c) for i, c in enumerate(("operation", "duration", "command"))])


@query(f"""WITH {ISW}, {INDEL}, {bands_sql([(0, 50000), (50001, 150000), (150001, 9999999)])} SELECT band, distance, {PGC_SQL} FROM isw JOIN indel USING (align_id) JOIN bands ON extand BETWEEN lo AND hi WHERE distance <= 4 GROUP BY band, distance""")
def wave_length_series(spark, d):
    rows = isw(spark, d).where("distance <= 4").join(indel(spark, d), "align_id")
    return rp.banded_metrics(rows, F.col("extand"), bk.bands(spark, [(0, 50000), (50001, 150000), (150001, 9999999)]), ["distance"], PGC)


@query(f"WITH {ISW} SELECT CAST(floor(gc / 0.01) AS BIGINT) AS level, CAST(ceil(density / 10.0) * 10 AS BIGINT) AS ceiling, {PGC_SQL} FROM isw GROUP BY 1, 2")
def gc_bins(spark, d):
    w = isw(spark, d).withColumn("level", bk.floor_bin(F.col("gc"), 0.01)).withColumn("ceiling", bk.ceil_bin(F.col("density"), 10).cast("long"))
    return rp.metrics(w, ["level", "ceiling"], PGC)


@query("""WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, value FROM events)
SELECT event_id, s - coalesce(lag(s) OVER w, 0) AS left_extand, coalesce(lead(s) OVER w, 0) - s AS right_extand, round(abs(value - lag(value) OVER w), 6) AS left_amplitude, round(abs(lead(value) OVER w - value), 6) AS right_amplitude, coalesce(lag(event_id) OVER w, 0) AS prev_id FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)""")
def extreme_waves(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").selectExpr("user_id", "event_id", "CAST(unix_timestamp(ts) AS bigint) AS s", "value")
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    return e.select("event_id", (F.col("s") - F.coalesce(F.lag("s").over(w), F.lit(0))).alias("left_extand"), (F.coalesce(F.lead("s").over(w), F.lit(0)) - F.col("s")).alias("right_extand"), F.abs(F.col("value") - F.lag("value").over(w)).alias("left_amplitude"), F.abs(F.lead("value").over(w) - F.col("value")).alias("right_amplitude"), F.coalesce(F.lag("event_id").over(w), F.lit(0)).alias("prev_id"))


@query("SELECT p_brand, count(*) AS parts, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes, round(sum(p_retailprice), 6) AS price FROM part GROUP BY p_brand")
def gene_summary(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("parts"), F.countDistinct("p_type").alias("types"), F.countDistinct("p_size").alias("sizes"), F.sum("p_retailprice").alias("price"))


@query(f"WITH RECURSIVE {ISW}, {_fold_sql('distance', 9000)} SELECT bucket, round(avg(gc) / nullif(avg(pi), 0), 6) AS dn_ds, round(avg(pi), 6) AS syn, round(avg(gc), 6) AS nsy, count(*) AS count FROM isw JOIN f ON key = distance GROUP BY bucket")
def combined_dnds(spark, d):
    w = isw(spark, d)
    placed = bk.by_buckets(w, F.col("distance"), bk.fold(bk.histogram(w, F.col("distance")), 9000, (-1, 0)))
    return placed.groupBy("bucket").agg(agg.ratio_of_means(F.col("gc"), F.col("pi")).alias("dn_ds"), F.avg("pi").alias("syn"), F.avg("gc").alias("nsy"), F.count("*").alias("count"))


@query(f"WITH {ISW}, {INDEL}, g AS (SELECT type, density, count(*) AS count, round(avg(power(pi, 2)), 6) AS r2, round(avg(abs(gc)), 6) AS dprime, row_number() OVER (PARTITION BY type ORDER BY density) AS n FROM isw JOIN indel USING (align_id) GROUP BY type, density) SELECT type, density, count, r2, dprime FROM g WHERE n <= 20")
def indel_ld_first(spark, d):
    rows = isw(spark, d).join(indel(spark, d), "align_id")
    return rp.first_groups(rows, "density", 20, [F.count("*").alias("count"), F.avg(F.pow("pi", F.lit(2))).alias("r2"), F.avg(F.abs("gc")).alias("dprime")], ["type"])


@query(f"WITH {ISW} SELECT density, count(*) AS count, round(avg(pi), 6) AS pi FROM isw GROUP BY density ORDER BY density LIMIT 35")
def snps_ld_first(spark, d):
    return rp.first_groups(isw(spark, d), "density", 35, [F.count("*").alias("count"), F.avg("pi").alias("pi")])


@query(f"WITH {ISW}, {INDEL}, l(name, lo, hi) AS (VALUES {', '.join(str(x) for x in bk.frequency_levels(8))}) SELECT name, type, distance, {PGC_SQL} FROM isw JOIN indel USING (align_id) JOIN l ON distance BETWEEN lo AND hi GROUP BY name, type, distance")
def frequency_groups(spark, d):
    levels = spark.createDataFrame(bk.frequency_levels(8), "name string, lo int, hi int")
    rows = bk.by_bands(isw(spark, d).join(indel(spark, d), "align_id"), F.col("distance"), levels)
    return rp.metrics(rows, ["name", "type", "distance"], PGC)


@query(f"""WITH {ISW}, {bands_sql([(1, 3), (2, 5), (1, 7)])}, p AS (SELECT band, align_id, avg(CASE WHEN flag = 'N' THEN pi END) - avg(CASE WHEN flag <> 'N' THEN pi END) AS diff FROM isw JOIN bands ON distance BETWEEN lo AND hi GROUP BY band, align_id)
SELECT band, count(diff) AS pairs, round(avg(diff), 6) AS mean, round(CASE WHEN count(diff) > 2 THEN avg(diff) * sqrt(count(diff)) / nullif(stddev_samp(diff), 0) END, 6) AS t FROM p GROUP BY band""")
def paired_t(spark, d):
    rows = bk.by_bands(isw(spark, d), F.col("distance"), bk.bands(spark, [(1, 3), (2, 5), (1, 7)]))
    diffs = rows.groupBy("band", "align_id").agg((F.avg(F.when(F.col("flag") == "N", F.col("pi"))) - F.avg(F.when(F.col("flag") != "N", F.col("pi")))).alias("diff"))
    return diffs.groupBy("band").agg(*agg.paired_t(F.col("diff")))


_SIZE = "CASE WHEN p_size < 10 THEN 'short' WHEN p_size < 30 THEN 'middle' ELSE 'long' END"
_HALF = "CASE nullif(p_size % 3, 2) WHEN 0 THEN 'coding' WHEN 1 THEN 'noncoding' WHEN NULL THEN 'never' ELSE 'semi' END"


@query(f"SELECT 'size' AS name, {_SIZE} AS label, count(*) AS count, round(avg(p_retailprice), 6) AS avg_p_retailprice FROM part GROUP BY 2 UNION ALL SELECT 'coding', {_HALF}, count(*), round(avg(p_retailprice), 6) FROM part GROUP BY 2")
def case_groups(spark, d):
    return rp.labelled_counts(table(spark, d, "part"), {"size": F.expr(_SIZE), "coding": F.expr(_HALF)}, ["p_retailprice"])


@query("SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def left_keep(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").selectExpr("o_custkey AS c_custkey", "o_orderkey", "o_orderstatus")
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left")


@query("SELECT p_name AS name, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids, min(p_size) AS low, max(p_size) AS high, round(sum(p_retailprice * p_size) / nullif(sum(p_size), 0), 6) AS pi FROM part GROUP BY p_name")
def gene_list(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(ids.alias("ids"), F.min("p_size").alias("low"), F.max("p_size").alias("high"), agg.weighted_mean(F.col("p_retailprice"), F.col("p_size")).alias("pi"))


_BITS = "b AS (SELECT user_id, CASE WHEN count(*) = 1 THEN 'unknown' ELSE " + " || ".join(f"CASE WHEN count(CASE WHEN event_id % 97 = {i} THEN 1 END) > 0 THEN '1' ELSE '0' END" for i in range(5)) + " END AS bits FROM events GROUP BY user_id)"


def bits(spark, d):
    return spark.sql(f"WITH {_BITS.replace('FROM events', 'FROM {events}')} SELECT * FROM b", events=table(spark, d, "events"))


@query(f"WITH {_BITS} SELECT user_id % 2 AS side, i AS position, CAST(sum(CASE WHEN bits[i] = '1' THEN 1 ELSE 0 END) AS BIGINT) AS count FROM b, range(1, 6) t(i) WHERE bits <> 'unknown' GROUP BY 1, 2".replace(" AS position", "::INT AS position"))
def strain_counts(spark, d):
    return rp.bit_counts(bits(spark, d).withColumn("side", F.expr("user_id % 2")), "bits", ["side"])


@query(f"""WITH {_BITS}, p AS (SELECT x.user_id AS a, y.user_id AS b, x.bits AS u, y.bits AS v FROM b x JOIN b y ON x.user_id < y.user_id AND y.user_id - x.user_id <= 3 WHERE x.bits <> 'unknown' AND y.bits <> 'unknown'),
c AS (SELECT a, b, len(list_filter(range(1, 6), lambda i: u[i] = '1')) / 5.0 AS pa, len(list_filter(range(1, 6), lambda i: v[i] = '1')) / 5.0 AS pb, len(list_filter(range(1, 6), lambda i: u[i] = '1' AND v[i] = '1')) / 5.0 AS pab FROM p),
e AS (SELECT *, pab - pa * pb AS dd FROM c WHERE pa > 0 AND pa < 1 AND pb > 0 AND pb < 1)
SELECT a, b, round(dd / sqrt(pa * (1 - pa) * pb * (1 - pb)), 6) AS r, round(dd / CASE WHEN dd >= 0 THEN least(pa * (1 - pb), (1 - pa) * pb) ELSE least(pa * pb, (1 - pa) * (1 - pb)) END, 6) AS dprime FROM e""")
def pair_ld(spark, d):
    rows = bits(spark, d).withColumn("g", F.lit(1))
    pairs = joins.pairs_within(rows, ["g"], "user_id", "user_id", 3)
    r, dprime = rp.linkage(F.col("bits_a"), F.col("bits_b"))
    return pairs.select(F.col("user_id_a").alias("a"), F.col("user_id_b").alias("b"), r.alias("r"), dprime.alias("dprime")).where("r IS NOT NULL")


@query("""SELECT p_brand AS tag, p_type AS type, count(*) AS count, round(avg(p_size), 6) AS length FROM part GROUP BY 1, 2 UNION ALL SELECT p_brand, NULL, count(*), round(avg(p_size), 6) FROM part GROUP BY 1 UNION ALL SELECT NULL, p_type, count(*), round(avg(p_size), 6) FROM part GROUP BY 2""")
def tag_type_rollup(spark, d):
    p = table(spark, d, "part").selectExpr("p_brand AS tag", "p_type AS type", "p_size")
    return p.groupingSets([["tag", "type"], ["tag"], ["type"]], "tag", "type").agg(F.count("*").alias("count"), F.avg("p_size").alias("length"))


@query(f"WITH {ISW} SELECT distance, {PGC_SQL} FROM isw WHERE part_id IN (SELECT p_partkey FROM part WHERE p_brand || '_' || CAST(p_size % 2 AS VARCHAR) = 'Brand#1_1' OR p_size <= 20) GROUP BY distance")
def ofg_semi(spark, d):
    parts = table(spark, d, "part").where("concat(p_brand, '_', p_size % 2) = 'Brand#1_1' OR p_size <= 20").selectExpr("p_partkey AS part_id")
    return rp.metrics(isw(spark, d).join(parts, "part_id", "left_semi"), ["distance"], PGC)


_E = "e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, value FROM events), w AS (SELECT user_id, s // 7200 AS n, (s // 7200) * 7200 AS start_s, (s // 7200) * 7200 + 3599 AS end_s FROM e GROUP BY 1, 2)"


def _events(spark, d):
    e = table(spark, d, "events").selectExpr("user_id", "event_id", "CAST(unix_timestamp(ts) AS bigint) AS s", "value")
    w = e.selectExpr("user_id", "s DIV 7200 AS n").distinct().selectExpr("user_id", "n", "n * 7200 AS start_s", "n * 7200 + 3599 AS end_s")
    return e, w


@query(f"WITH {_E} SELECT w.user_id, w.n, count(*) AS count, round(avg(value), 6) AS value FROM e JOIN w ON e.user_id = w.user_id AND s BETWEEN start_s AND end_s GROUP BY 1, 2")
def interval_join(spark, d):
    e, w = _events(spark, d)
    return joins.binned_interval_join(e, w, ["user_id"], "s", "start_s", "end_s", 3600).groupBy("user_id", "n").agg(F.count("*").alias("count"), F.avg("value").alias("value"))


@query(f"""WITH {_E}, i AS (SELECT event_id, user_id, s AS a, s + 600 AS b FROM e), h AS (SELECT event_id, i.user_id, a, b, n FROM i JOIN (SELECT user_id, n, start_s AS c, end_s AS f FROM w UNION ALL SELECT user_id, n + 1000000000, start_s - 5000, end_s + 5000 FROM w) x ON i.user_id = x.user_id AND c <= a AND f >= b)
SELECT event_id, user_id, min(n) AS n, count(*) AS hits FROM h GROUP BY 1, 2""")
def containment_first(spark, d):
    e, w = _events(spark, d)
    outer = w.selectExpr("user_id", "n", "start_s AS c", "end_s AS f").unionByName(w.selectExpr("user_id", "n + 1000000000 AS n", "start_s - 5000 AS c", "end_s + 5000 AS f"))
    inner = e.selectExpr("event_id", "user_id", "s AS a", "s + 600 AS b")
    return joins.containment_join(inner, outer, ["user_id"], ("a", "b"), ("c", "f"), 3600, "event_id", "n").select("event_id", "user_id", "n", "hits")


@query("""WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), p AS (SELECT * FROM e WHERE event_id % 2 = 0), o AS (SELECT * FROM e WHERE event_id % 2 = 1),
j AS (SELECT p.event_id, o.event_id AS nearest_id, abs(o.s - p.s) AS nearest_distance, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(o.s - p.s) NULLS LAST, o.event_id) AS n FROM p LEFT JOIN o ON o.user_id = p.user_id) SELECT event_id, nearest_id, nearest_distance FROM j WHERE n = 1""")
def nearest_variant(spark, d):
    e, _ = _events(spark, d)
    p, o = (e.where(f"event_id % 2 = {i}").select("user_id", "event_id", "s") for i in (0, 1))
    return joins.nearest(p, o, ["user_id"], "s", "s", "event_id").select("event_id", "nearest_id", "nearest_distance")


_DNA_FROM, _DNA_TO = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
_DNA = f"dna AS (SELECT doc_id, regexp_replace(translate(lower(text), '{_DNA_FROM}', '{_DNA_TO}'), '[^ACGT]', '', 'g') AS s FROM documents)"


def dna(spark, d):
    """Letters of whole texts."""
    return table(spark, d, "documents").selectExpr("doc_id", f"regexp_replace(translate(lower(text), '{_DNA_FROM}', '{_DNA_TO}'), '[^ACGT]', '') AS s")


@query(f"""WITH {_DNA}, k AS (SELECT s[i:i + 2] AS k FROM (SELECT s, unnest(range(1, len(s) - 1)) AS i FROM dna)), c AS (SELECT k, reverse(translate(k, 'ACGT', 'TGCA')) AS r FROM k),
g AS (SELECT least(k, r) || ',' || greatest(k, r) AS kmer, count(*) AS count FROM c GROUP BY 1) SELECT kmer, count, round(len(regexp_replace(kmer[1:3], '[AT]', '', 'g')) / 3.0, 6) AS gc, round(count / sum(count) OVER (), 6) AS freq FROM g""")
def kmer_canonical(spark, d):
    return rp.canonical_kmers(dna(spark, d), "s", 3)


_AROUND = ", ".join(f"{'lag' if k < 0 else 'lead'}(ch, {abs(k)}) OVER w AS {'m' if k < 0 else 'p'}{abs(k)}" for k in (*range(-4, 0), *range(1, 6)))


@query(f"""WITH {_DNA}, i AS (SELECT doc_id, unnest(string_split(s, '')) AS ch, unnest(range(1, len(s) + 1)) AS i FROM dna), x AS (SELECT doc_id, ch, {_AROUND} FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, ch AS one, m4 || m3 || m2 || m1 AS l1, p1 || p2 || p3 || p4 AS r1, ch || p1 || p2 AS three, m3 || m2 || m1 AS l3, p3 || p4 || p5 AS r3, m1 AS a, p1 AS c FROM x WHERE m4 IS NOT NULL AND p5 IS NOT NULL) SELECT doc_id, count(*) AS sites,
CAST(sum(CASE WHEN position(repeat(one, 4) IN l1 || one || r1) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS slip_one, CAST(sum(CASE WHEN l3 = three OR r3 = three THEN 1 ELSE 0 END) AS BIGINT) AS slip_three,
CAST(sum(CASE WHEN (one = 'C' AND c = 'G') OR (one = 'G' AND a = 'C') THEN 1 ELSE 0 END) AS BIGINT) AS cpg FROM p GROUP BY doc_id""")
def slippage_cpg(spark, d):
    """All sites of whole texts with four letters on their left and five on their right."""
    windows = F.explode(rp.letter_runs(F.col("s"), 10)).alias("w")
    s = dna(spark, d).where("length(s) >= 10").select("doc_id", windows)
    part = lambda at, n: F.substring("w", at, n)
    mutant = F.when(part(5, 1) == "C", "C->T").when(part(5, 1) == "G", "G->A").otherwise("A->G")
    one, three = rp.slippage(part(5, 1), part(1, 4), part(6, 4)), rp.slippage(part(5, 3), part(2, 3), part(8, 3))
    total = lambda c, name: F.sum(c.cast("long")).alias(name)
    return s.groupBy("doc_id").agg(F.count("*").alias("sites"), total(one, "slip_one"), total(three, "slip_three"), total(rp.cpg(mutant, part(4, 1), part(6, 1)), "cpg"))


_SITES = "'ACGT'"
_D_SQL = f"""WITH w AS (SELECT o_orderkey AS isw_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 7 = 1 THEN '11111' ELSE list_element(['11000', '10100', '01110', '10000', '00111'], CAST(o_custkey % 5 AS INT) + 1) END AS g, CAST(7 * (15 + 2 * (o_custkey % 5)) AS INT) AS len FROM orders),
s AS (SELECT l_orderkey AS isw_id, row_number() OVER () AS n, {_SITES}[CAST(l_partkey % 4 AS INT) + 1] AS o, list_transform(range(0, 5), lambda k: {_SITES}[CAST((l_partkey + CASE WHEN (l_suppkey >> k) % 3 = 0 THEN l_linenumber + (k * l_suppkey) % 2 ELSE 0 END) % 4 AS INT) + 1]) AS b FROM lineitem),
x AS (SELECT w.isw_id, n, len, o, g[i + 1] AS gi, g[j + 1] AS gj, b[i + 1] AS bi, b[j + 1] AS bj FROM w JOIN s USING (isw_id), range(0, 5) r(i), range(0, 5) q(j) WHERE i <> j AND position('0' IN g) > 0 AND position('1' IN g) > 0),
f AS (SELECT isw_id, n, count(DISTINCT bi) FILTER (gi = '1') = 1 AND bool_and(bi <> o) FILTER (gi = '1') AS f1, count(DISTINCT bi) FILTER (gi = '0') = 1 AND bool_and(bi <> o) FILTER (gi = '0') AS f0, bool_or(gi <> gj AND bi = bj AND bi <> o) AS shared FROM x GROUP BY 1, 2),
y AS (SELECT x.*, NOT f1 AND NOT f0 AS second, CASE WHEN f1 OR f0 THEN shared ELSE true END AS third FROM x JOIN f USING (isw_id, n)),
k(k) AS (VALUES (1), (2), (3)),
t AS (SELECT isw_id, k, n, len, sum(CASE WHEN gi = '1' AND gj = '0' AND bi <> o AND bj = o THEN 1.0 ELSE 0 END) / count(*) FILTER (gi = '1' AND gj = '0') AS indel, sum(CASE WHEN gi = '1' AND gj = '0' AND bi = o AND bj <> o THEN 1.0 ELSE 0 END) / count(*) FILTER (gi = '1' AND gj = '0') AS noindel,
coalesce(sum(CASE WHEN gi = '1' AND gj = '1' AND (bi = o) <> (bj = o) THEN 1.0 ELSE 0 END) / nullif(count(*) FILTER (gi = '1' AND gj = '1'), 0), 0) AS bii, coalesce(sum(CASE WHEN gi = '0' AND gj = '0' AND (bi = o) <> (bj = o) THEN 1.0 ELSE 0 END) / nullif(count(*) FILTER (gi = '0' AND gj = '0'), 0), 0) AS bnn,
sum(CASE WHEN bi <> o AND bj <> o AND bi <> bj THEN 1.0 ELSE 0 END) / count(*) AS complex FROM y, k WHERE k = 1 OR (k = 2 AND second) OR (k = 3 AND third) GROUP BY 1, 2, 3, 4),
u AS (SELECT isw_id, k, sum(indel) AS indel, sum(noindel) AS noindel, sum(bii) AS bii, sum(bnn) AS bnn, sum(complex) AS complex FROM t GROUP BY 1, 2)
SELECT w.isw_id, """ + ", ".join(f"CASE WHEN position('0' IN g) > 0 AND position('1' IN g) > 0 THEN round(coalesce(max({c}) FILTER (k = {i}), 0) / len, 6) END AS isw_d_{c}{'' if i == 1 else i}" for i in (1, 2, 3) for c in ("indel", "noindel", "bii", "bnn", "complex")) + " FROM w LEFT JOIN u USING (isw_id) GROUP BY w.isw_id, g, len"


@query(_D_SQL)
def d_values(spark, d):
    """D values of windows that stand for orders, with SNPs of up to four bases that stand for their lines. Lengths are multiples of 7, so that no value is a tie at six decimals."""
    orders = table(spark, d, "orders").selectExpr("o_orderkey AS isw_id", "o_orderkey AS isw_indel_id", "CAST(7 * (15 + 2 * (o_custkey % 5)) AS int) AS isw_length", "o_custkey")
    groups = "CASE WHEN isw_id % 7 = 0 THEN 'unknown' WHEN isw_id % 7 = 1 THEN '11111' ELSE element_at(array('11000', '10100', '01110', '10000', '00111'), CAST(o_custkey % 5 AS int) + 1) END AS indel_occured"
    base = f"substring({_SITES}, CAST((l_partkey + CASE WHEN shiftright(l_suppkey, k) % 3 = 0 THEN l_linenumber + (k * l_suppkey) % 2 ELSE 0 END) % 4 AS int) + 1, 1)"
    snps = table(spark, d, "lineitem").selectExpr("l_orderkey AS isw_id", f"substring({_SITES}, CAST(l_partkey % 4 AS int) + 1, 1) AS snp_outgroup_base", f"array_join(transform(sequence(0, 4), k -> {base}), '') AS snp_all_bases")
    return enrich.d_values(orders, orders.selectExpr("isw_indel_id AS indel_id", groups), snps)


@query("""WITH x AS (SELECT o_orderkey AS id, CAST(o_orderkey % 50 AS INT) AS a, CAST(o_custkey % 40 AS INT) AS b FROM orders)
SELECT id, CASE WHEN b <= a + 11 AND a <= b + 16 THEN CAST(least(a, b) AS VARCHAR) || '-' || CAST(greatest(a + 10, b + 15) AS VARCHAR) WHEN a < b THEN a || '-' || (a + 10) || ',' || b || '-' || (b + 15) ELSE b || '-' || (b + 15) || ',' || a || '-' || (a + 10) END AS joined,
greatest(0, least(a + 10, b + 15) - greatest(a, b) + 1)::INT AS common, (11 - greatest(0, least(a + 10, b + 15) - greatest(a, b) + 1))::INT AS only_a, (26 BETWEEN a AND a + 10) AS has, a + 3 AS fourth FROM x""")
def runlist_ops(spark, d):
    x = table(spark, d, "orders").selectExpr("o_orderkey AS id", "CAST(o_orderkey % 50 AS int) AS a", "CAST(o_custkey % 40 AS int) AS b")
    x = x.withColumn("x", iv.parse(F.expr("concat(a, '-', a + 10)"))).withColumn("y", iv.parse(F.expr("concat(b, '-', b + 15)")))
    return x.select("id", iv.to_runlist(iv.union(F.col("x"), F.col("y"))).alias("joined"), iv.size(iv.intersect(F.col("x"), F.col("y"))).alias("common"), iv.size(iv.diff(F.col("x"), F.col("y"))).alias("only_a"), iv.contains(F.col("x"), F.lit(26)).alias("has"), iv.at(F.col("x"), F.lit(4)).alias("fourth"))


@query("SELECT l_linenumber, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem GROUP BY l_linenumber")
def lm_fit(spark, d):
    fit = table(spark, d, "lineitem").groupBy("l_linenumber").agg(*agg.line_fit(F.col("l_extendedprice"), F.col("l_quantity")))
    return fit.withColumn("intercept", F.round("intercept", 4))


@query("SELECT DISTINCT n + 1 AS strains FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def consistency_check(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").count().select((F.col("count") + 1).alias("strains")).distinct()


@query(r"SELECT n_name, regexp_replace(lower(n_name), '^nation_0?', '') AS short FROM nation WHERE NOT regexp_matches(n_name, '(?i)rand|un|contig|hap|scaf') AND n_nationkey IN (SELECT c_nationkey FROM customer)")
def chr_filter(spark, d):
    seen = table(spark, d, "customer").selectExpr("c_nationkey AS n_nationkey").distinct()
    n = table(spark, d, "nation").where(~F.col("n_name").rlike("(?i)rand|un|contig|hap|scaf")).join(seen, "n_nationkey", "left_semi")
    return n.select("n_name", F.regexp_replace(F.lower("n_name"), "^nation_0?", "").alias("short"))


@query("SELECT a.o_orderkey AS align_id, a.o_orderstatus AS role, c.c_name AS common_name, n.n_name AS chr_name FROM orders a JOIN customer c ON c.c_custkey = a.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE a.o_orderstatus = 'F'")
def target_info(spark, d):
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS align_id", "o_orderstatus AS role", "o_custkey AS c_custkey")
    n = table(spark, d, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name AS chr_name")
    c = table(spark, d, "customer").selectExpr("c_custkey", "c_name AS common_name", "c_nationkey")
    return a.join(c, "c_custkey").join(F.broadcast(n), "c_nationkey", "left").select("align_id", "role", "common_name", "chr_name")


@query("""WITH d AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents) SELECT lang, count(*) AS windows, CAST(sum(n) AS BIGINT) AS bases, round(avg(CASE WHEN n > 200 THEN 1.0 ELSE 0.0 END), 6) AS coding FROM documents JOIN d USING (doc_id) GROUP BY lang""")
def feature_portion(spark, d):
    w = table(spark, d, "documents").select("lang", F.size(F.split("text", " ")).alias("n"))
    return w.groupBy("lang").agg(F.count("*").alias("windows"), F.sum("n").alias("bases"), F.avg((F.col("n") > 200).cast("double")).alias("coding"))


from genolith.plans import alignments  # noqa: E402, F401  registers the queries on alignments
