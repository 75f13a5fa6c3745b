"""What a figure of an alignment is drawn from, as rows: where sequences have bases, sets of columns, pi of windows, the gc wave."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genolith.config import Config
from genolith.functions import intervals as iv
from genolith.operators import enrich
from genolith.operators.sequences import Store
from genolith.scratch import Scratch

COLUMNS = ("align_id", "track", "name", "start", "end", "score")


def _rows(df: DataFrame, track: Column, name: Column, start: Column, end: Column, score: Column | None = None) -> DataFrame:
    score = F.lit(None) if score is None else score
    values = (F.col("align_id"), track, name.cast("string"), start.cast("long"), end.cast("long"), score.cast("double"))
    return df.select(*[v.alias(c) for v, c in zip(values, COLUMNS)])


def _spans(df: DataFrame, runlist: str, track: Column, name: Column) -> DataFrame:
    """A row for each span of a runlist; none where it is null or empty."""
    spans = df.where(F.col(runlist).isNotNull()).select("align_id", track.alias("_track"), name.alias("_name"), F.explode(iv.parse(F.col(runlist))).alias("_s"))
    return _rows(spans, F.col("_track"), F.col("_name"), F.col("_s.start"), F.col("_s.end"))


def gc_track(store: Store, config: Config = Config()) -> DataFrame:
    """Windows of the gc wave: start and end are the columns of their first and last comparable base, the name is T in a trough, C in a crest, else null."""
    waves = Scratch(store.scratch.spark, "tracks").keep(enrich.wave_windows(store, config), "waves")
    flags = enrich.wave_flags(waves, max(1, config.vicinal_size // config.wave_window_step), config.fall_range).select("align_id", "k", "flag")
    placed = store.column_of(waves.join(flags, ["align_id", "k"], "left"), "free", a="rank_start", b="rank_end")
    return _rows(placed, F.lit("gc"), F.col("flag"), F.col("a"), F.col("b"), F.col("gc"))


def tracks(tables: Mapping[str, DataFrame], store: Store, config: Config = Config()) -> DataFrame:
    """align_id, track, name, start, end, score of all alignments in ``align``, in alignment columns.

    Tracks are ``target``, ``query`` and ``outgroup`` (spans with bases, by the sequence's name), ``comparable`` and ``indel``, ``coding`` and
    ``repeats`` where an alignment has such runlists, ``pi`` (windows between indels, by their type) and ``gc`` (see ``gc_track``). A table that
    is not there gives no rows. A window without comparable columns has a null score.
    """
    align = tables["align"]
    roles = F.when(F.col("seq_role") == "T", "target").when(F.col("seq_role") == "O", "outgroup").otherwise("query")
    parts = [_spans(align, f"align_{n}_runlist", F.lit(n), F.lit(None).cast("string")) for n in ("comparable", "indel", "coding", "repeats") if f"align_{n}_runlist" in align.columns]
    if "sequence" in tables:
        parts.append(_spans(tables["sequence"], "seq_runlist", roles, F.col("common_name")))
    if "isw" in tables:
        parts.append(_rows(tables["isw"], F.lit("pi"), F.col("isw_type"), F.col("isw_start"), F.col("isw_end"), F.col("isw_pi")))
    parts.append(gc_track(store, config))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(align.select("align_id"), "align_id", "left_semi")
