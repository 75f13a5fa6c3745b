"""Named report templates: what is joined, by what rows are grouped, what is measured.

A template is data; ``build`` makes a DataFrame of it over the tables at hand and takes what callers used to edit
into the SQL: another key, more conditions, more measures, bucket maps, an order and a limit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genolith.operators import buckets as bk

#: How tables meet: (left, right) to the equal columns.
KEYS = {
    ("isw", "indel"): ("isw_indel_id", "indel_id"),
    ("isw", "snp"): ("isw_id", "isw_id"),
    ("gsw", "window"): ("window_id", "window_id"),
    ("isw", "align"): ("align_id", "align_id"),
    ("snp", "isw"): ("isw_id", "isw_id"),
}


def means(*columns: str, spread: bool = True) -> dict[str, str]:
    """AVG_x (and STD_x, of the population) for columns such as isw_pi, x being what follows the table's name."""
    out = {}
    for c in columns:
        name = c.partition("_")[2]
        out[f"AVG_{name}"] = f"avg({c})"
        if spread:
            out[f"STD_{name}"] = f"stddev_pop({c})"
    return out


@dataclass(frozen=True)
class Template:
    tables: tuple[str, ...]
    measures: Mapping[str, str]
    key: str | None = None
    where: str | None = None
    by_right_neighbour: bool = False  # isw meets indel by the indel on its right, not the nearest


_PGC = means("isw_pi", "isw_gc", "isw_cv")
_COUNT = {"COUNT": "count(*)"}
_SUM = _COUNT | {"SUM_length": "sum(isw_length)"}
_AROUND = {"AVG_distance": "avg(isw_distance)"}
_DNDS = means("isw_pi", spread=False) | {f"AVG_d_{k}": f"avg(isw_{k})" for k in ("syn", "nsy", "stop")} | _COUNT | {"dn_ds": "try_divide(avg(isw_nsy), avg(isw_syn))"}
_RATE = "try_divide(window_indel, window_length) * 100"
_WAVE = {"AVG_distance": "avg(gsw_distance)"} | means("window_pi") | {"AVG_indel": f"avg({_RATE})", "STD_indel": f"stddev_pop({_RATE})"} | means("gsw_cv")


def _branch(level: str) -> Template:
    d = {"AVG_D": "avg(isw_pi)", f"AVG_Di{level}": f"avg(isw_d_indel{level})", f"AVG_Dn{level}": f"avg(isw_d_noindel{level})", f"AVG_half_Dbii{level}": f"avg(isw_d_bii{level}) / 2", f"AVG_half_Dbnn{level}": f"avg(isw_d_bnn{level}) / 2", f"AVG_Dc{level}": f"avg(isw_d_complex{level})", f"Di{level}_Dn{level}": f"try_divide(avg(isw_d_indel{level}), avg(isw_d_noindel{level}))"}
    return Template(("isw", "indel"), d | _COUNT, "isw_distance", "indel_slippage = 0")


_LD = {"AVG_r": "avg(snp_r)", "AVG_r2": "avg(power(snp_r, 2))", "AVG_Dprime": "avg(snp_dprime)", "AVG_Dprime_abs": "avg(abs(snp_dprime))"}
_LDS = {"AVG_r2": "avg(power(snp_r, 2))", "AVG_Dprime_abs": "avg(abs(snp_dprime))"} | {f"AVG_{k}": f"avg(snp_{k})" for k in ("r2_s", "dprime_abs_s", "r2_i", "r2_ni", "dprime_abs_i", "dprime_abs_ni")}
_KNOWN = "indel_occured <> 'unknown' AND snp_occured <> 'unknown'"
_LENGTH = {"indel_number": "count(*)", "AVG_indel_gc": "avg(indel_gc)", "indel_sum": "sum(indel_length)"}

# The names of templates and of their measures.
TEMPLATES: dict[str, Template] = {
    "common-align": Template(("isw", "indel", "align"), means("isw_pi") | _COUNT, "isw_distance", by_right_neighbour=True),
    "common-d1_pi_gc_cv": Template(("isw",), _PGC | _COUNT, "isw_distance"),
    "common-d1_comb_pi_gc_cv": Template(("isw",), _AROUND | _PGC | _COUNT),
    "common-d1_comb_coding": Template(("isw",), _AROUND | _PGC | _COUNT),
    "common-d1_comb_slippage": Template(("isw", "indel"), _AROUND | _PGC | _COUNT),
    "common-d1_combine": Template(("isw",), _SUM, "isw_distance"),
    "common-d2_combine": Template(("isw",), _SUM, "isw_density"),
    "common-d1_make_combine_coding": Template(("isw",), _COUNT, "isw_distance"),
    "common-d1_make_combine_slippage": Template(("isw", "indel"), _COUNT, "isw_distance"),
    "common-d1_pi_avg": Template(("isw",), _AROUND | means("isw_pi") | _COUNT),
    "common-dd_group": Template(("isw",), means("isw_pi") | _COUNT, "isw_distance"),
    "common-dd_group_gc": Template(("isw",), means("isw_gc") | _COUNT, "isw_distance"),
    "common-distance_snp": Template(("snp", "isw"), {"snp_number": "count(snp_id)"}, "isw_distance"),
    "common-indel_isw": Template(("isw", "indel"), means("isw_pi") | _COUNT, "isw_distance", "isw_density > 9 AND isw_distance <= 5"),
    "common-indel_length": Template(("indel",), _LENGTH, "indel_length"),
    "dnds-d1_dn_ds": Template(("isw",), _DNDS, "isw_distance"),
    "dnds-d1_comb_dn_ds": Template(("isw",), _AROUND | _DNDS),
    "gc-wave_combine": Template(("gsw",), _COUNT, "gsw_distance", "gsw_distance IS NOT NULL"),
    "gc-wave_comb_pi_indel_cv": Template(("gsw", "window"), _WAVE | _COUNT),
    "gc-wave_comb_bed": Template(("gsw", "window"), _WAVE | means("gsw_bed_count") | _COUNT),
    "ld-indel_ld": Template(("isw", "indel", "snp"), _LD | _COUNT, "isw_distance", _KNOWN),
    "ld-snps_ld": Template(("isw", "indel", "snp"), _LDS | _COUNT, "isw_distance", _KNOWN),
    "multi-distance": _branch(""),
    "multi-distance2": _branch("2"),
    "multi-distance3": _branch("3"),
    "multi-indel_length": Template(("indel",), _LENGTH, "indel_length", "indel_slippage = 0"),
}


def joined(tables: Mapping[str, DataFrame], template: Template) -> DataFrame:
    """The template's tables; a column that an earlier one has is not taken again."""
    names = template.tables
    out = tables[names[0]]
    for name in names[1:]:
        left, right = KEYS[names[0], name]
        if template.by_right_neighbour and name == "indel":
            left = "indel_id"
        other = tables[name].withColumnRenamed(right, "_key")
        out = out.join(other.drop(*[c for c in other.columns if c in out.columns]), out[left] == other["_key"]).drop("_key")
    return out


def build(tables: Mapping[str, DataFrame], name: str, key: str | None = None, where: Sequence[str] = (), measures: Mapping[str, str] | None = None, buckets: DataFrame | None = None, bucket_by: Column | None = None, limit: int | None = None) -> DataFrame:
    """A template over tables. ``key`` replaces its key; ``buckets`` (bucket, key) groups by buckets of ``bucket_by`` instead."""
    t = TEMPLATES[name]
    rows = joined(tables, t)
    for condition in (*([t.where] if t.where else []), *where):
        rows = rows.where(condition)
    aggregates = [F.expr(e).alias(n) for n, e in {**t.measures, **(measures or {})}.items()]
    if buckets is not None:
        return bk.by_buckets(rows, bucket_by, buckets).groupBy("bucket").agg(*aggregates)
    by = key or t.key
    if by is None:
        return rows.agg(*aggregates)
    out = rows.groupBy(F.expr(by).alias("key")).agg(*aggregates)
    return out.orderBy("key").limit(limit) if limit else out
