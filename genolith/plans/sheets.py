"""Report sheets by name: what columns a sheet needs, and the plan that fills it from the tables.

A sheet whose columns hold no value is left out, so a study gets the sheets that its steps have made possible.
Groups of a sheet are one table of bands that the rows meet, never one query for each group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genolith.config import Config
from genolith.operators import aggregates as agg
from genolith.operators import buckets as bk
from genolith.plans import reports as rp
from genolith.plans.templates import build

Tables = Mapping[str, DataFrame]

# The groups that the sheets report.
DISTANCES = [(-1, -1), (0, 0), (1, 1), (2, 2), (3, 5), (6, 10), (11, 20), (21, 50), (51, 999), (3, 20), (21, 999), (101, 999), (0, 0), (1, 5), (6, 10), (11, 15), (16, 20), (21, 25)]
DENSITIES = [(1, 2), (3, 6), (7, 10), (11, 18), (19, 999)]
LENGTHS = [(1, 5), (6, 10), (11, 50), (51, 300)]
EXTENDS = [(0, 0), (1, 2), (3, 4), (5, 9), (10, 19), (20, 999)]
HALVES = [(0, 0), (1, 1)]
GC_LEVELS = [(0, 0.2999), (0.3, 0.4999), (0.5, 1)]
WAVE_LENGTHS = [(5, 10), (11, 20), (21, 30), (31, 999)]
AMPLITUDES = [(10, 20), (21, 30), (31, 100)]
TRANSITIONS = ("AG", "CT", "GA", "TC")


@dataclass(frozen=True)
class Sheet:
    report: str
    needs: Mapping[str, Sequence[str]]
    plan: Callable[[Tables, Config], DataFrame]


SHEETS: dict[str, Sheet] = {}


def sheet(report: str, name: str | None = None, **needs: str):
    """Registers a plan under a name; ``needs`` gives, by table, the columns that must hold values."""

    def add(plan):
        SHEETS[name or plan.__name__] = Sheet(report, {t: c.split() for t, c in needs.items()}, plan)
        return plan

    return add


def filled(table: DataFrame, columns: Sequence[str]) -> set[str]:
    """Those of the columns that the table has and that hold a value, in one pass."""
    there = [c for c in columns if c in table.columns]
    row = table.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in there]).first()
    return {c for c in there if row[c]} if row["_n"] else set()


def possible(tables: Tables, report: str | None = None) -> list[str]:
    """Names of the sheets (of one report) for which the tables hold what they need."""
    wanted = {n: s for n, s in SHEETS.items() if report in (None, s.report)}
    columns: dict[str, set[str]] = {}
    for s in wanted.values():
        for t, cs in s.needs.items():
            columns.setdefault(t, set()).update(cs)
    have = {t: filled(tables[t], sorted(cs)) for t, cs in columns.items() if t in tables}
    return [n for n, s in wanted.items() if all(set(cs) <= have.get(t, set()) for t, cs in s.needs.items())]


def sheets(tables: Tables, report: str | None = None, config: Config = Config(), names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The possible sheets by name; ``names`` limits them to some."""
    return {n: SHEETS[n].plan(tables, config) for n in possible(tables, report) if names is None or n in names}


def _named(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in columns.items() if a in df.columns])


def _isw(tables: Tables, where: str | None = None) -> tuple[DataFrame, list[str]]:
    """Windows under plain names, and the metrics that they have."""
    w = tables["isw"].where(where) if where else tables["isw"]
    w = _named(w, {"isw_distance": "distance", "isw_density": "density", "isw_length": "length", "isw_pi": "pi", "isw_gc": "gc", "isw_cv": "cv"})
    return w, [c for c in ("pi", "gc", "cv") if c in w.columns]


def _near(tables: Tables) -> DataFrame:
    """Windows next to an indel, with it, as sheets by a property of indels take them: of long intervals, up to a distance of 5."""
    w = tables["isw"].where("isw_density > 9 AND isw_distance <= 5").select("isw_indel_id", F.col("isw_distance").alias("distance"), F.col("isw_pi").alias("pi"))
    return w.join(tables["indel"].withColumnRenamed("indel_id", "isw_indel_id"), "isw_indel_id")


def _banded(tables: Tables, value: Column, edges: Sequence[tuple[float, float]]) -> DataFrame:
    near = _near(tables)
    return rp.banded_metrics(near, value, bk.bands(near.sparkSession, edges), ["distance"], ["pi"])


@sheet("common", align="align_length align_comparables")
def basic(t, config):
    """Numbers and lengths of alignments, rates of indels and substitutions over them, distances."""
    a, pi = t["align"], agg.weighted_mean(F.col("align_pi"), F.col("align_comparables"))
    return a.agg(
        F.count("*").alias("alignments"), F.sum("align_length").alias("length"), F.sum("align_comparables").alias("comparables"), pi.alias("pi"), agg.jukes_cantor(pi).alias("distance"),
        F.try_divide(F.sum("align_differences") * 100, F.sum("align_comparables")).alias("snps_per_100"), F.try_divide(F.sum("align_indels") * 100, F.sum("align_comparables")).alias("indels_per_100"),
        F.try_divide(F.sum("align_differences"), F.sum("align_indels")).alias("snps_per_indel"), agg.weighted_mean(F.col("align_gc"), F.col("align_length")).alias("gc"),
    )


@sheet("common", meta="meta_key meta_value")
def process(t, config):
    """The steps of the log, one a row."""
    part = F.regexp_extract("meta_key", r"^(.*)_[acd]_(operation|duration|cmd_line)$", 2)
    rows = t["meta"].select(F.regexp_extract("meta_key", r"^(.*)_[acd]_", 1).alias("step"), part.alias("part"), "meta_value").where("part <> ''")
    return rows.groupBy("step").agg(*[F.max(F.when(F.col("part") == p, F.col("meta_value"))).alias(p) for p in ("operation", "duration", "cmd_line")])


@sheet("common", align="align_length align_pi")
def summary(t, config):
    """Average, extremes, spread, number and sum of the measures of each table."""
    parts = [("align", "align_length align_comparables align_pi align_gc"), ("indel", "indel_length indel_gc left_extand"), ("isw", "isw_length isw_pi isw_gc isw_cv")]
    out = None
    for name, columns in parts:
        if name in t and (some := [c for c in columns.split() if c in t[name].columns]):
            rows = agg.column_stat(t[name], some)
            out = rows if out is None else out.unionByName(rows)
    return out


@sheet("common", isw="isw_distance isw_pi")
def d1_pi_gc_cv(t, config):
    w, metrics = _isw(t)
    return rp.metrics(w, ["distance"], metrics)


@sheet("common", isw="isw_density isw_pi")
def d2_pi_gc_cv(t, config):
    w, metrics = _isw(t)
    return rp.metrics(w, ["density"], metrics)


def _combined(report: str, name: str, key: str, where: str | None = None, merge_last: bool = False, **needs: str) -> None:
    def plan(t, config):
        w, metrics = _isw(t, where)
        return rp.combined_metrics(w, key, metrics, config.combine_threshold, config.standalone, merge_last)

    SHEETS[name] = Sheet(report, {k: c.split() for k, c in {"isw": f"isw_{key} isw_pi", **needs}.items()}, plan)


def _combined_by_indel(name: str, key: str, where: str) -> None:
    def plan(t, config):
        some = t["indel"].where(where).select(F.col("indel_id").alias("isw_indel_id"))
        w, metrics = _isw({"isw": t["isw"].join(some, "isw_indel_id", "left_semi")})
        return rp.combined_metrics(w, key, metrics, config.combine_threshold, config.standalone, True)

    SHEETS[name] = Sheet("common", {"isw": [f"isw_{key}", "isw_pi"], "indel": ["indel_slippage"]}, plan)


for _d, _key in (("d1", "distance"), ("d2", "density")):
    _combined("common", f"{_d}_comb_pi_gc_cv", _key)
    _combined("common", f"{_d}_comb_coding", _key, "isw_coding = 1", True, isw=f"isw_{_key} isw_pi isw_coding")
    _combined("common", f"{_d}_comb_non_coding", _key, "isw_coding = 0", True, isw=f"isw_{_key} isw_pi isw_coding")
    _combined_by_indel(f"{_d}_comb_slippage", _key, "indel_slippage = 1")
    _combined_by_indel(f"{_d}_comb_non_slippage", _key, "indel_slippage = 0")


def _grouped(key: str, name: str) -> None:
    def plan(t, config):
        w, metrics = _isw(t)
        edges = bk.bands(w.sparkSession, DISTANCES)
        fixed = rp.length_share(w, key, "length", edges, [*metrics, key])
        last = bk.top_portion(w, F.col(key), F.col("length"), config.last_portion).agg(F.lit(len(DISTANCES) + 1).alias("band"), F.min("key").cast("double").alias("lo"), F.max("key").cast("double").alias("hi"))
        return fixed.unionByName(rp.length_share(w, key, "length", last, [*metrics, key]))

    SHEETS[name] = Sheet("common", {"isw": [f"isw_{key}", "isw_pi", "isw_length"]}, plan)


_grouped("distance", "group_distance")
_grouped("density", "group_density")


@sheet("common", isw="isw_distance isw_density isw_pi")
def dd_group(t, config):
    w, _ = _isw(t)
    return rp.density_distance(w, bk.bands(w.sparkSession, DENSITIES), ["pi"])


@sheet("common", isw="isw_distance isw_density isw_gc")
def dd_group_gc(t, config):
    w, _ = _isw(t)
    return rp.density_distance(w, bk.bands(w.sparkSession, DENSITIES), ["gc"])


def _by_indel(name: str, column: str, edges: Sequence[tuple[float, float]]) -> None:
    SHEETS[name] = Sheet("common", {"isw": ["isw_distance", "isw_pi"], "indel": column.split()}, lambda t, config: _banded(t, F.col(column), edges))


_by_indel("indel_length_group", "indel_length", LENGTHS)
_by_indel("indel_coding_group", "indel_coding", HALVES)
_by_indel("indel_repeat_group", "indel_repeats", HALVES)
_by_indel("indel_slip_group", "indel_slippage", HALVES)
_by_indel("indel_gc_group", "indel_gc", GC_LEVELS)


@sheet("common", isw="isw_distance isw_pi", indel="left_extand right_extand")
def indel_extand_group(t, config):
    """By the windows (of 100) that the nearer neighbouring indel leaves free."""
    return _banded(t, F.floor(F.least("left_extand", "right_extand") / 100), EXTENDS)


@sheet("common", isw="isw_distance isw_pi", indel="indel_coding indel_repeats")
def indel_position_group(t, config):
    """Indels wholly in or outside coding regions, wholly in or outside repeats."""
    near = _near(t).where("indel_coding IN (0, 1) AND indel_repeats IN (0, 1)")
    return rp.metrics(near, ["indel_coding", "indel_repeats", "distance"], ["pi"])


@sheet("common", align="align_indels align_differences align_comparables")
def snp_indel_ratio(t, config):
    """Alignments with indels by pi, the most diverse first, cut into pieces of ``piece`` length: substitutions to indels, and both a kb."""
    a = t["align"].where("align_indels > 0")
    rate = lambda c, by, scale: F.try_divide(F.col(c) * scale, by)
    measures = {"pi": F.col("align_pi"), "snp_indel": rate("align_differences", "align_indels", 1), "align_length": F.col("align_length"), "snp_kb": rate("align_differences", "align_length", 1000), "indel_kb": rate("align_indels", "align_length", 1000)}
    return rp.level_pieces(a, [], [F.desc_nulls_last("align_pi"), F.col("align_id")], "align_length", config.piece, measures)


@sheet("common", indel="indel_length")
def indel_length(t, config):
    return rp.length_histogram(t["indel"], "indel_length", ["indel_gc"])


@sheet("common", indel="indel_length left_extand right_extand")
def indel_length_100(t, config):
    """Of indels with 100 free bases or more on both sides."""
    return rp.length_histogram(t["indel"].where("left_extand >= 100 AND right_extand >= 100"), "indel_length", ["indel_gc"])


def _snps(name: str, key: str, label: Callable[[], Column]) -> None:
    def plan(t, config):
        some = t["isw"].where(f"isw_{key} BETWEEN -1 AND 15").select("isw_id", F.col(f"isw_{key}").alias(key))
        rows = t["snp"].select("isw_id", label().alias("pair")).join(some, "isw_id").where("pair IS NOT NULL")
        counted = rows.groupBy(key, "pair").agg(F.count("*").alias("count"))
        return counted.withColumn("share", bk.share(F.col("count"), key))

    SHEETS[name] = Sheet("common", {"isw": [f"isw_{key}"], "snp": ["snp_target_base", "snp_query_base"]}, plan)


def _pair() -> Column:
    return F.array_join(F.array_sort(F.array("snp_target_base", "snp_query_base")), "<->")


def _change() -> Column:
    return F.when(F.concat("snp_target_base", "snp_query_base").isin(*TRANSITIONS), "Tri").otherwise("Trv")


_snps("distance_snp", "distance", _pair)
_snps("density_snp", "density", _pair)
_snps("distance_tri_trv", "distance", _change)


def _portion(name: str, column: str) -> None:
    def plan(t, config):
        """Quartiles of alignments by a portion, and those of 0.4 to 0.6, by distance."""
        a = t["align"].where(F.col(column).isNotNull()).select("align_id", F.col(column).alias("portion"))
        levels = bk.quantile_levels(a, F.col("portion"))
        levels = levels.unionByName(bk.bands(a.sparkSession, [(0.4, 0.6)]).select(F.lit(5).alias("band"), "lo", "hi"))
        w = t["isw"].select("align_id", F.col("isw_distance").alias("distance"), F.col("isw_pi").alias("pi")).join(a, "align_id")
        return rp.banded_metrics(w, F.col("portion"), levels, ["distance"], ["pi"])

    SHEETS[name] = Sheet("common", {"isw": ["isw_distance", "isw_pi"], "align": [column]}, plan)


_portion("align_coding", "align_coding")
_portion("align_repeat", "align_repeats")


# --- several strains


def _levels(t: Tables) -> DataFrame:
    """name, lo, hi of allele frequencies, up to the highest that is found."""
    strains = t["sequence"].where("seq_role <> 'O'").groupBy("align_id").count().agg(F.max("count")).first()[0]
    highest = t["indel"].agg(F.max("indel_freq")).first()[0]
    return t["indel"].sparkSession.createDataFrame(bk.frequency_levels(strains, highest), "name string, lo int, hi int")


def _at_levels(t: Tables, rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(_levels(t)), F.col("indel_freq").between(F.col("lo"), F.col("hi")))  # at most a row for each frequency


_DERIVED = "isw_distance isw_pi isw_d_indel"
_FREQ = {"indel": "indel_freq indel_length", "sequence": "seq_role"}


def _branch(level: str) -> None:
    def plan(t, config):
        return build(t, f"multi-distance{level}")

    SHEETS[f"distance{level}"] = Sheet("multi", {"isw": [*_DERIVED.split(), f"isw_d_indel{level}"], "indel": ["indel_slippage"]}, plan)


for _level in ("", "2", "3"):
    _branch(_level)


def _stacked(t: Tables, edges: DataFrame, on: Column, name: Column, where: str = "true") -> DataFrame:
    """D values by level and distance: level, distance, averages, count."""
    w = t["isw"].join(t["indel"].where(where).select(F.col("indel_id").alias("isw_indel_id"), "indel_freq", "indel_length", "indel_type"), "isw_indel_id")
    placed = w.join(F.broadcast(edges), on)
    d = [F.avg(f"isw_d_{c}").alias(f"avg_d_{c}") for c in ("indel", "noindel", "bii", "bnn", "complex")]
    return placed.groupBy(name.alias("level"), F.col("isw_distance").alias("distance")).agg(F.avg("isw_pi").alias("avg_d"), *d, F.count("*").alias("count"))


@sheet("multi", isw=_DERIVED, **_FREQ)
def distance_freq(t, config):
    return _stacked(t, _levels(t), F.col("indel_freq").between(F.col("lo"), F.col("hi")), F.col("name"))


@sheet("multi", isw=_DERIVED, indel="indel_length")
def distance_length(t, config):
    """By length of the indel: the levels of indel_length_group."""
    edges = bk.bands(t["isw"].sparkSession, LENGTHS)
    return _stacked(t, edges, F.col("indel_length").between(F.col("lo"), F.col("hi")), F.concat_ws("-", F.col("lo").cast("int"), F.col("hi").cast("int")))


@sheet("multi", isw=_DERIVED, **_FREQ)
def distance_type_freq(t, config):
    """Insertions and deletions by frequency."""
    return _stacked(t, _levels(t), F.col("indel_freq").between(F.col("lo"), F.col("hi")), F.concat_ws("_", F.col("indel_type"), F.col("name")), "indel_type IN ('I', 'D')")


@sheet("multi", "indel_length_slippage_free", indel="indel_length indel_slippage")
def _indel_length_multi(t, config):
    return build(t, "multi-indel_length")


@sheet("multi", **_FREQ)
def indel_length_freq(t, config):
    return rp.length_histogram(_at_levels(t, t["indel"]), "indel_length", ["indel_gc"], ["name"])


def _type_gc(name: str, most: int, step: int) -> None:
    def plan(t, config):
        """gc of insertions and deletions by length, in steps."""
        rows = t["indel"].where(f"indel_type IN ('I', 'D') AND indel_length <= {most}").withColumn("length", bk.ceil_bin(F.col("indel_length"), step).cast("int"))
        return rp.metrics(rows, ["indel_type", "length"], ["indel_gc"])

    SHEETS[name] = Sheet("multi", {"indel": ["indel_length", "indel_gc", "indel_type"]}, plan)


_type_gc("indel_type_gc_10", 10, 1)
_type_gc("indel_type_gc_100", 100, 10)


@sheet("multi", isw="isw_distance isw_pi", **_FREQ)
def pigccv_freq(t, config):
    w = _at_levels(t, t["isw"].join(t["indel"].select(F.col("indel_id").alias("isw_indel_id"), "indel_freq"), "isw_indel_id"))
    named = _named(w, {"name": "level", "isw_distance": "distance", "isw_pi": "pi", "isw_gc": "gc", "isw_cv": "cv"})
    return rp.metrics(named, ["level", "distance"], [c for c in ("pi", "gc", "cv") if c in named.columns])


def _ttest(name: str, free: bool) -> None:
    def plan(t, config):
        """Paired t of D values on both sides of indels by groups of distances, with its one-sided p; windows without a value on either side are left out."""
        w = t["isw"]
        if free:
            w = w.join(t["indel"].where("indel_slippage = 0").select(F.col("indel_id").alias("isw_indel_id")), "isw_indel_id", "left_semi")
        w = w.where("isw_d_indel + isw_d_noindel > 0").select(F.col("isw_distance").alias("distance"), (F.col("isw_d_indel") - F.col("isw_d_noindel")).alias("difference"))
        rows = bk.by_bands(w, F.col("distance"), bk.bands(w.sparkSession, DISTANCES)).groupBy("band").agg(*agg.paired_t(F.col("difference")))
        p = F.udf(lambda x, n: None if x is None else agg.student_upper_tail(x, n - 1), "double")  # a row for each band
        return rows.withColumn("p", p("t", "pairs"))

    needs = {"isw": ["isw_distance", "isw_d_indel", "isw_d_noindel"], **({"indel": ["indel_slippage"]} if free else {})}
    SHEETS[name] = Sheet("multi", needs, plan)


_ttest("di_dn_ttest", False)
_ttest("di_dn_ttest_ns", True)


# --- gc


@sheet("gc", segment="segment_type segment_gc_mean")
def segment_summary(t, config):
    return agg.column_stat(t["segment"], [f"segment_gc_{c}" for c in ("mean", "std", "cv", "mdcw")], by=["segment_type"])


@sheet("gc", extreme="extreme_type extreme_left_wave_length")
def extreme_summary(t, config):
    return agg.column_stat(t["extreme"], [f"extreme_{s}_{c}" for s in ("left", "right") for c in ("amplitude", "wave_length")], by=["extreme_type"])


#: Measures of windows on waves.
WAVE = ("distance", "pi", "indel", "gc", "cv")


def _gsw(t: Tables) -> DataFrame:
    """Windows on waves, with the pi, gc and indels a 100 bp of their windows, as far as these are there."""
    x = t["gsw"].withColumn("distance", F.col("gsw_distance"))
    x = x.withColumn("cv", F.col("gsw_cv")) if "gsw_cv" in x.columns else x
    if "window" not in t:
        return x
    w = t["window"].select(F.col("window_id").alias("gsw_id"), F.col("window_pi").alias("pi"), F.col("window_gc").alias("gc"), (F.col("window_indel") / F.col("window_length") * 100).alias("indel"))
    return x.join(w, "gsw_id", "left")


def _wave(name: str, key: str, step: float | None = None) -> None:
    def plan(t, config):
        """By buckets of a property of the wave: mean distance to the trough, and the measures of windows."""
        x = _gsw(t)
        value = F.col(key) if step is None else bk.floor_bin(F.col(key), step).cast("int")
        rows = x.where(F.col(key).isNotNull()).select(value.alias("key"), *[c for c in WAVE if c in x.columns])
        return rp.combined_metrics(rows, "key", rows.columns[1:], config.combine_threshold, ())

    SHEETS[name] = Sheet("gc", {"gsw": ["gsw_distance"], "window": ["window_gc"]} if key == "gc" else {"gsw": [key]}, plan)


for _name, _key, _step in (
    ("distance_to_trough", "gsw_distance", None), ("distance_to_crest", "gsw_distance_crest", None), ("wave_length", "gsw_wave_length", 100), ("amplitude", "gsw_amplitude", 0.01), ("gradient", "gsw_gradient", None),
    ("trough_gc", "gsw_trough_gc", 0.01), ("crest_gc", "gsw_crest_gc", 0.01), ("window_gc", "gc", 0.01), ("bed_count_trough", "gsw_bed_count", None),
):
    _wave(_name, _key, _step)


def _wave_series(name: str, key: str, step: float, levels: Sequence[tuple[int, int]]) -> None:
    def plan(t, config):
        """Indels by distance from the trough, to 10, for bands of the wave."""
        rows = _gsw(t).where("distance <= 10").withColumn("value", bk.floor_bin(F.col(key), step))
        return rp.banded_metrics(rows, F.col("value"), bk.bands(rows.sparkSession, levels), ["distance"], ["indel"])

    SHEETS[name] = Sheet("gc", {"gsw": [key], "window": ["window_indel"]}, plan)


for _name, _key, _step, _levels_ in (("d_wave_length_series", "gsw_wave_length", 100, WAVE_LENGTHS), ("d_amplitude_series", "gsw_amplitude", 0.01, AMPLITUDES)):
    _wave_series(_name, _key, _step, _levels_)


def _wave_quartiles(name: str, key: str, digits: int) -> None:
    def plan(t, config):
        """Indels by distance from the trough, 1 to 10, for quartiles of a gc."""
        rows = _gsw(t).where("distance BETWEEN 1 AND 10")
        return rp.quantile_metrics(rows, key, ["distance"], ["indel"], digits=digits)

    SHEETS[name] = Sheet("gc", {"gsw": ["gsw_distance" if key == "gc" else key], "window": ["window_gc"]}, plan)


for _name, _key, _digits in (("d_gc_series", "gc", 3), ("d_trough_gc_series", "gsw_trough_gc", 4), ("d_crest_gc_series", "gsw_crest_gc", 4)):
    _wave_quartiles(_name, _key, _digits)


# --- segments, by type: ranked by one of their measures, cut into pieces, with a line for each type


def _segments(t: Tables) -> DataFrame:
    return t["segment"].drop("align_id", "window_start", "window_end").join(t["window"], "window_id")


def segment_pieces(rows: DataFrame, metric: str, piece: float, more: Sequence[str] = ()) -> DataFrame:
    """Segments of each type ranked by a measure, the highest first, cut into pieces."""
    of = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("double")
    measures = {"gc": of("window_gc"), "pi": of("window_pi"), "indel_100bp": of("window_indel") / of("window_length") * 100, "cv": of("segment_gc_cv"), "std": of("segment_gc_std"), "mdcw": of("segment_gc_mdcw"), "coding": of("window_coding"), "r2": of("segment_r2_s"), "length": of("window_length")}
    order = [F.desc_nulls_last(metric), F.asc_nulls_first("window_pi"), F.asc_nulls_first("window_indel"), F.asc("window_id")]
    return rp.level_pieces(rows, ["segment_type", *more], order, "window_length", piece, measures)


def _segment_sheets(name: str, metric: str, x: str) -> None:
    def pieces(t, config):
        """Pieces of segments, for each type."""
        return segment_pieces(_segments(t), metric, config.segment_piece)

    def fits(t, config):
        """Lines of diversity, indels and linkage on the measure, for each type of segment."""
        return rp.level_fits(pieces(t, config), ["segment_type"], x, ["avg_pi", "avg_indel_100bp", "avg_r2"])

    table, column = ("window", metric) if metric.startswith("window") else ("segment", metric)
    needs = {"segment": ["segment_type"], "window": ["window_pi"]} | {table: [column, *(["window_pi"] if table == "window" else ["segment_type"])]}
    SHEETS[f"segment_{name}_indel"] = Sheet("gc", needs, pieces)
    SHEETS[f"segment_{name}_lm"] = Sheet("gc", needs, fits)


for _name, _metric, _x in (("gc", "window_gc", "avg_gc"), ("std", "segment_gc_std", "avg_std"), ("cv", "segment_gc_cv", "avg_cv"), ("mdcw", "segment_gc_mdcw", "avg_mdcw"), ("coding", "window_coding", "avg_coding")):
    _segment_sheets(_name, _metric, _x)


def _segment_features(name: str, metric: str) -> None:
    def pieces(t, config):
        """Short segments wholly in or outside coding regions and repeats, but for those in both."""
        rows = _segments(t).where("segment_type = '3' AND window_coding IN (0, 1) AND window_repeats IN (0, 1) AND window_coding + window_repeats < 2")
        return segment_pieces(rows, metric, config.segment_piece, ["window_coding", "window_repeats"])

    SHEETS[f"segment_{name}_indel_cr"] = Sheet("gc", {"segment": ["segment_type"], "window": ["window_pi", "window_coding", "window_repeats"]}, pieces)


for _name, _metric in (("gc", "window_gc"), ("cv", "segment_gc_cv")):
    _segment_features(_name, _metric)


# --- positions and the windows around them


def _ofg(t: Tables) -> DataFrame:
    """Windows around positions, with the position's tag and type, and its own window's share of coding bases."""
    own = t["window"].select("window_id", F.col("window_coding").alias("own_coding") if "window_coding" in t["window"].columns else F.lit(None).cast("double").alias("own_coding"))
    features = t["ofg"].select("ofg_id", "ofg_tag", "ofg_type", "window_id").join(own, "window_id", "left").drop("window_id")
    x = t["ofgsw"].drop("align_id", "rank_start", "rank_end").join(features, "ofg_id").join(t["window"], "window_id")
    return x.withColumns({"distance": F.col("ofgsw_distance"), "pi": F.col("window_pi"), "indel": F.col("window_indel") / F.col("window_length") * 100, "gc": F.col("window_gc"), "cv": F.col("ofgsw_cv"), "repeats": F.col("window_repeats") if "window_repeats" in x.columns else F.lit(None).cast("double")})


_OFG = ["pi", "indel", "gc", "cv", "repeats"]
_OFG_NEEDS = {"ofg": ["ofg_tag"], "ofgsw": ["ofgsw_distance"], "window": ["window_pi"]}


@sheet("ofg", "summary_ofg", **{t: " ".join(c) for t, c in _OFG_NEEDS.items()})
def summary_ofg(t, config):
    """Positions by tag and type, each and both, and their windows: counts and lengths."""
    stack = lambda df, what: rp.labelled_counts(df, {f"{what} tag_type": F.concat_ws("_", "ofg_tag", "ofg_type"), f"{what} tag": F.col("ofg_tag"), f"{what} type": F.col("ofg_type")}, ["window_length"])
    return stack(t["ofg"].join(t["window"].select("window_id", "window_length"), "window_id"), "ofg").unionByName(stack(_ofg(t), "ofgsw"))


def _ofg_sheet(name: str, by: Sequence[str], where: str | None = None, needs: Mapping[str, Sequence[str]] = _OFG_NEEDS) -> None:
    def plan(t, config):
        """By distance from the position."""
        rows = _ofg(t)
        return rp.metrics(rows.where(where) if where else rows, [*by, "distance"], _OFG)

    SHEETS[name] = Sheet("ofg", needs, plan)


_CODED = {**_OFG_NEEDS, "window": ["window_pi", "window_coding"]}
for _name, _by, _where, _needs in (
    ("ofg_all", [], None, _OFG_NEEDS), ("ofg_tag", ["ofg_tag"], None, _OFG_NEEDS), ("ofg_type", ["ofg_type"], None, _OFG_NEEDS), ("ofg_tt", ["ofg_tag", "ofg_type"], None, _OFG_NEEDS),
    ("ofg_coding", [], "own_coding = 1", _CODED), ("ofg_noncoding", [], "own_coding = 0", _CODED),
    ("ofg_coding_pure", [], "own_coding = 1 AND window_coding = 1", _CODED), ("ofg_noncoding_pure", [], "own_coding = 0 AND window_coding = 0", _CODED),
):
    _ofg_sheet(_name, _by, _where, _needs)


# --- genes


@sheet("gene", gene="gene_stable_id", exon="exon_stable_id", window="window_pi")
def summary_gene(t, config):
    """Genes and exons, all and whole ones: how many, how long, how diverse, with how many indels."""
    out = None
    for name, table, ident, full in (("gene", "gene", "gene_stable_id", None), ("full gene", "gene", "gene_stable_id", "gene_is_full"), ("exon", "exon", "exon_stable_id", None), ("full exon", "exon", "exon_stable_id", "exon_is_full")):
        rows = t[table].where(f"{full} = 1") if full else t[table]
        x = rows.select("window_id", ident).join(t["window"].select("window_id", "window_length", "window_pi", "window_indel"), "window_id")
        x = x.agg(F.lit(name).alias("name"), F.countDistinct(ident).alias("distinct"), F.count("*").alias("count"), F.avg("window_length").alias("avg_length"), F.sum("window_length").alias("sum_length"), F.avg("window_pi").alias("avg_pi"), F.sum("window_indel").alias("indel"), (F.try_divide(F.sum("window_indel"), F.sum("window_length")) * 100).alias("indel_100bp"))
        out = x if out is None else out.unionByName(x)
    return out


def _dnds() -> list[Column]:
    return [agg.ratio_of_means(F.col("isw_nsy"), F.col("isw_syn")).alias("dn_ds"), F.avg("isw_syn").alias("avg_syn"), F.avg("isw_nsy").alias("avg_nsy"), F.avg("isw_stop").alias("avg_stop"), F.count("*").alias("count")]


@sheet("gene", isw="isw_syn isw_distance")
def combined_dnds(t, config):
    """dN/dS of windows by buckets of their distance."""
    rows = t["isw"].where("isw_syn IS NOT NULL")
    placed = bk.by_buckets(rows, F.col("isw_distance"), bk.fold(bk.histogram(rows, F.col("isw_distance")), config.combine_threshold, config.standalone))
    return placed.groupBy("bucket").agg(F.avg("isw_distance").alias("avg_distance"), *_dnds())


@sheet("gene", isw="isw_syn isw_distance", indel="indel_freq")
def frequency_dnds(t, config):
    """dN/dS by distance from indels that one strain has."""
    near = t["isw"].where("isw_syn IS NOT NULL").join(t["indel"].select(F.col("indel_id").alias("isw_indel_id"), "indel_freq"), "isw_indel_id").where("indel_freq = 1")
    return near.groupBy("isw_distance").agg(*_dnds())


@sheet("gene", gene="gene_syn gene_stable_id")
def gene_dnds(t, config):
    """dN/dS of each gene."""
    return t["gene"].select("gene_stable_id", "gene_tl_size", "gene_syn", "gene_nsy", "gene_stop", F.try_divide("gene_nsy", "gene_syn").alias("dn_ds"))


@sheet("gene", gene="gene_syn gene_stable_id gene_biotype", window="window_pi", sequence="seq_role")
def gene_list(t, config):
    """Genes with their places; of genes that no alignment holds as a whole the parts are rolled up: ends of all, sums, and pi, syn and nsy by the length
    of the parts that have them."""
    target = t["sequence"].where("seq_role = 'T'").select("align_id", "chr_name")
    named = [c for c in ("gene_external_name", "gene_biotype", "gene_strand", "gene_multitrans", "gene_multiexons") if c in t["gene"].columns]
    w = t["window"].select("window_id", F.col("window_differences").alias("subs"), F.col("window_indel").alias("indel"), F.col("window_pi").alias("pi"))
    x = t["gene"].join(w, "window_id").join(target.drop("chr_name"), "align_id").withColumn("size", F.col("rank_end") - F.col("rank_start") + 1)
    columns = ["gene_stable_id", "chr_name", "start", "end", *named]
    whole = x.where("gene_is_full = 1").select(F.col("gene_id").cast("string").alias("gene_ids"), *columns, F.lit(1).alias("gene_is_full"), F.lit(1).cast("long").alias("parts"), F.col("subs").cast("long").alias("subs"), F.col("indel").cast("long").alias("indel"), "pi", F.col("gene_syn").alias("syn"), F.col("gene_nsy").alias("nsy"))
    weighed = lambda c: F.try_divide(F.sum(F.col(c) * F.col("size")), F.sum(F.when(F.col(c).isNotNull(), F.col("size")))).alias(c)
    parts = x.where("gene_is_full = 0").withColumnsRenamed({"gene_syn": "syn", "gene_nsy": "nsy"})
    rolled = parts.groupBy("gene_stable_id", "chr_name").agg(
        F.array_join(F.array_sort(F.collect_list(F.col("gene_id").cast("string"))), ",").alias("gene_ids"), F.min("start").alias("start"), F.max("end").alias("end"), *[F.min(c).alias(c) for c in named],
        F.lit(0).alias("gene_is_full"), F.count("*").alias("parts"), F.sum("subs").alias("subs"), F.sum("indel").alias("indel"), weighed("pi"), weighed("syn"), weighed("nsy"),
    )
    return whole.unionByName(rolled)


# --- linkage: by distance (the first 20) and density (the first 35), for all indels, by their type and by their frequency


def _linked(name: str, template: str, key: str, most: int) -> None:
    needs = {"snp": ["snp_r"] if template == "ld-indel_ld" else ["snp_r2_s"], "isw": [key], "indel": ["indel_type"]}

    def all_indels(t, config):
        return build(t, template, key=key, limit=most)

    def by(levels: Callable[[Tables], list[tuple[str, str]]]):
        def plan(t, config):
            out = None
            for level, where in levels(t):
                x = build(t, template, key=key, where=[where], limit=most).withColumn("level", F.lit(level))
                out = x if out is None else out.unionByName(x)
            return out

        return plan

    frequencies = lambda t: [(r["name"], f"indel_freq BETWEEN {r['lo']} AND {r['hi']}") for r in _levels(t).collect()]  # noqa: E731  a few levels
    SHEETS[name] = Sheet("ld", needs, all_indels)
    SHEETS[f"{name}_insdel"] = Sheet("ld", needs, by(lambda t: [("ins", "indel_type = 'I'"), ("del", "indel_type = 'D'")]))
    SHEETS[f"{name}_freq"] = Sheet("ld", {**needs, "indel": ["indel_type", "indel_freq"], "sequence": ["seq_role"]}, by(frequencies))


for _what in ("indel_ld", "snps_ld"):
    for _d, _key, _most in (("d1", "isw_distance", 20), ("d2", "isw_density", 35)):
        _linked(f"{_d}_{_what}", f"ld-{_what}", _key, _most)


@sheet("multi", "summary_indel", **_FREQ)
def summary_indel(t, config):
    """Lengths of indels: of all, of each type, and of both by frequency."""
    levels = _levels(t).unionByName(t["indel"].sparkSession.createDataFrame([("unknown", -1, -1)], "name string, lo int, hi int"))
    kinds = t["indel"].select("indel_length", "indel_freq", F.explode(F.array(F.lit("all"), F.col("indel_type"))).alias("kind"))
    banded = kinds.join(F.broadcast(levels), F.col("indel_freq").between(F.col("lo"), F.col("hi"))).select("indel_length", "kind", F.col("name").alias("level"))  # a row for each level
    return agg.column_stat(banded.unionByName(kinds.select("indel_length", "kind", F.lit("all").alias("level"))), ["indel_length"], by=["kind", "level"])


@sheet("mvar", indel="indel_seq indel_length")
def indel_kmers(t, config):
    """Words of 1 to 6 bases, each with its reverse complement, in indels by the bands of their length."""
    rows = bk.by_bands(t["indel"], F.col("indel_length"), bk.bands(t["indel"].sparkSession, LENGTHS, "int"))
    out = None
    for k in range(1, 7):
        x = rp.canonical_kmers(rows, "indel_seq", k, ["band"]).withColumn("k", F.lit(k))
        out = x if out is None else out.unionByName(x)
    return out


# --- variants


def _labels(table: DataFrame, labels: Mapping[str, Callable[[], Column]], columns: Sequence[str]) -> DataFrame:
    have = filled(table, list(labels))
    return rp.labelled_counts(table, {c: f() for c, f in labels.items() if c in have}, columns)


def _half(column: str, word: str) -> Callable[[], Column]:
    return lambda: F.when(F.col(column) == 0, f"non_{word}").when(F.col(column) == 1, word).when(F.col(column).isNull(), "NULL").otherwise(f"semi_{word}")


def _text(column: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.col(column).cast("string"), F.lit("NULL"))


@sheet("mvar", indel="indel_length")
def indel_basic(t, config):
    """Indels by coding, repeats, slippage, type, frequency and bits, one under the other."""
    kinds = lambda: F.when(F.col("indel_type") == "C", "Complex").when(F.col("indel_type") == "D", "Deletion").when(F.col("indel_type") == "I", "Insertion").otherwise("WRONG")
    labels = {"indel_coding": _half("indel_coding", "coding"), "indel_repeats": _half("indel_repeats", "repeat"), "indel_slippage": _half("indel_slippage", "slippage"), "indel_type": kinds, "indel_freq": _text("indel_freq"), "indel_occured": _text("indel_occured")}
    return _labels(t["indel"], labels, ["indel_length"])


@sheet("mvar", snp="snp_pos")
def snp_basic(t, config):
    """SNPs by coding, repeats, CpG, frequency and change."""
    labels = {"snp_coding": _half("snp_coding", "coding"), "snp_repeats": _half("snp_repeats", "repeat"), "snp_cpg": _half("snp_cpg", "CpG"), "snp_freq": _text("snp_freq"), "snp_mutant_to": _text("snp_mutant_to")}
    return _labels(t["snp"], labels, [])


def _listed(t: Tables, table: str, start: str) -> DataFrame:
    """A table's rows with the chromosome, start and end of the target that their alignment lies on."""
    target = t["sequence"].where("seq_role = 'T'").select("align_id", "chr_name", "chr_start", "chr_end")
    return t[table].join(target, "align_id", "left").orderBy("chr_name", "chr_start", start)


@sheet("mvar", indel="indel_length", sequence="seq_role")
def indel_list(t, config):
    return _listed(t, "indel", "indel_start")


@sheet("mvar", snp="snp_pos", sequence="seq_role")
def snp_list(t, config):
    return _listed(t, "snp", "snp_pos")


@sheet("mvar", snp="snp_codons", sequence="seq_role")
def snp_codon_list(t, config):
    return _listed({**t, "snp": t["snp"].where("snp_codons IS NOT NULL")}, "snp", "snp_pos")


@sheet("mvar", snp="snp_occured")
def strain_list(t, config):
    """Derived SNPs and indels of each strain."""
    out = rp.bit_counts(t["snp"], "snp_occured").withColumnRenamed("count", "snps")
    return out.join(rp.bit_counts(t["indel"], "indel_occured").withColumnRenamed("count", "indels"), "position", "full") if "indel" in t else out
