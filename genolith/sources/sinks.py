"""Sinks: tables, sheets, query output, the log of steps."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_table(df: DataFrame, root: str, name: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Overwrites a table, sorted within files so that readers can skip row groups; returns it as read."""
    (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").parquet(f"{root}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")


def emptied(table: DataFrame, window: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The table without rows, and windows without those that its rows had."""
    return table.limit(0), None if window is None else window.join(table.select("window_id"), "window_id", "left_anti")


def updated(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """A new version of a table: columns of ``updates`` replace its own or are added, by key (once in ``updates``).

    Rows without an update keep what they had, null in added columns.
    """
    fresh = [c for c in updates.columns if c != key]
    found = updates.select(key, F.lit(True).alias("_found"), *[F.col(c).alias(f"_new_{c}") for c in fresh])
    value = lambda c, old: F.when(F.col("_found"), F.col(f"_new_{c}")).otherwise(old).alias(c)
    own = [value(c, F.col(c)) if c in fresh else F.col(c) for c in table.columns]
    return table.join(found, key, "left").select(*own, *[value(c, F.lit(None)) for c in fresh if c not in table.columns])


class TableSet(Mapping):
    """Tables below a folder: parts that are written once, and changes of columns that are merged when a table is read.

    A step that adds columns writes its key and these columns only, not the table anew. A manifest, a new one for each
    write, lists the parts and changes of every table, so that a set is opened again as it was, and a write that failed
    leaves the set as it was. A part or change that is written again under its name takes the place of the old one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.version = spark, root, 0
        self.parts: dict[str, dict[str, list[str]]] = {}
        self.changes: dict[str, dict[str, list[str]]] = {}
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [x.getPath().getName() for x in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))] if fs.exists(path) else []
        if done:
            self.version = max(map(int, done))
            held = json.loads(spark.read.text(f"{root}/manifest/{self.version}").first()[0])
            self.parts, self.changes = held["parts"], held["changes"]

    def _write(self, df: DataFrame, name: str, order: tuple[str, ...]) -> list[str]:
        self.version += 1
        path = f"v{self.version}/{name}"
        write_table(df, f"{self.root}/v{self.version}", name, order)
        return [path, df.schema.json()]

    def _commit(self) -> None:
        text = json.dumps({"parts": self.parts, "changes": self.changes})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.root}/manifest/{self.version}")

    def _read(self, held: list[str]) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(held[1]))).parquet(f"{self.root}/{held[0]}")

    def put(self, name: str, df: DataFrame, *order: str, part: str = "") -> None:
        """Writes a table, or a part of one, whose rows come to the others'. A whole table takes the place of all its parts and changes."""
        held = self._write(df, name, order)
        if not part:
            self.parts[name], self.changes[name] = {}, {}
        self.parts.setdefault(name, {})[part] = held
        self._commit()

    def change(self, name: str, updates: DataFrame, key: str, step: str) -> None:
        """Writes columns of some rows of a table, by their key (once in ``updates``); rows without an update keep what they had."""
        held = [*self._write(updates, f"{name}_{step}", (key,)), key]
        self.changes.setdefault(name, {}).pop(step, None)
        self.changes[name][step] = held
        self._commit()

    def compact(self, *names: str) -> None:
        """Writes tables that have changes with all their columns, part by part, before they are read many times."""
        for name in names or list(self):
            if self.changes.get(name):
                self.parts[name] = {part: self._write(self._changed(self._read(held), name), f"{name}_{part}", ()) for part, held in self.parts[name].items()}
                self.changes[name] = {}
                self._commit()

    def _changed(self, df: DataFrame, name: str) -> DataFrame:
        for held in self.changes.get(name, {}).values():
            df = updated(df, self._read(held), held[2])
        return df

    def __getitem__(self, name: str) -> DataFrame:
        out = None
        for held in self.parts[name].values():
            part = self._read(held)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return self._changed(out, name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.parts)

    def __len__(self) -> int:
        return len(self.parts)


def has_values(df: DataFrame, column: str) -> bool:
    """Whether a table has the column, and a value in it: what reports ask before they run."""
    return column in df.columns and df.where(F.col(column).isNotNull()).limit(1).count() > 0


def write_sheets(sheets: dict[str, DataFrame], root: str) -> DataFrame:
    """A CSV folder for each sheet and an index of them; returns the index."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{root}/{name}")
    spark = next(iter(sheets.values())).sparkSession
    index = spark.createDataFrame([(i + 1, n) for i, n in enumerate(sheets)], "sheet int, name string")
    index.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{root}/index")
    return index


def write_query(df: DataFrame, path: str, style: str = "csv") -> None:
    """csv, tsv, or padded text (neat, table, box): of the latter the columns are as wide as their widest value."""
    if style in ("csv", "tsv"):
        df.write.mode("overwrite").option("header", "true").option("sep", "," if style == "csv" else "\t").csv(path)
        return
    text = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(c) for c in df.columns]
    widths = df.select(*text).agg(*[F.max(F.length(c)).alias(c) for c in df.columns]).first()
    bar = {"neat": "  ", "table": " | ", "box": " | "}[style]
    cells = F.concat_ws(bar, *[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("NULL")), max(widths[c] or 0, len(c)), " ") for c in df.columns])
    df.select((F.concat(F.lit("| "), cells, F.lit(" |")) if style == "box" else cells).alias("value")).write.mode("overwrite").text(path)


def copy_tables(spark: SparkSession, source: str, target: str, names: list[str]) -> None:
    for name in names:
        spark.read.parquet(f"{source}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")


def log_step(spark: SparkSession, root: str, operation: str, seconds: float, command: str) -> None:
    """Appends a step's three values to the meta table."""
    key = uuid.uuid4().hex[:8]
    rows = [(f"{key}_a_operation", operation), (f"{key}_c_duration", f"{seconds:.1f}"), (f"{key}_d_cmd_line", command)]
    spark.createDataFrame(rows, "meta_key string, meta_value string").coalesce(1).write.mode("append").parquet(f"{root}/meta")
