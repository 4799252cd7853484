"""Which columns the parts of a CSV table hold: a history of layouts beside the table.

Parts are written into one folder for each layout (``layout=<id>``), and the layout's columns are appended once to
``<table>_layouts``. Every column has an id that it keeps when it is renamed, so each part is read by the
columns it was written with and its values go to today's names. A reader needs the history, which has one row for each
version of the columns, and no file's header or footer.

Files that others wrote carry a header each. They are grouped by that line, read with the first block of
each file, and every group is read by its own columns.

Writers that register the same columns at the same time add the same row twice, which changes nothing;
two different layouts are ordered by their number, then by their id.
"""

from __future__ import annotations

import csv
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow import schemas
from barflow.sources.paths import exists


@dataclass(frozen=True)
class Layout:
    """Columns of some parts, in file order, as (name, column id)."""

    number: int
    fields: tuple[tuple[str, str], ...]

    @property
    def id(self) -> str:
        return hashlib.md5(json.dumps(self.fields).encode()).hexdigest()[:12]

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.fields]


def history_path(path: str) -> str:
    return f"{path.rstrip('/')}_layouts"


def part_path(path: str, layout: Layout) -> str:
    return f"{path.rstrip('/')}/layout={layout.id}"


def history(spark: SparkSession, path: str) -> list[Layout]:
    """All layouts of a table, oldest first; none if it has no history."""
    if not exists(spark, history_path(path)):
        return []
    rows = [json.loads(r.value) for r in spark.read.text(history_path(path)).collect()]
    found = {Layout(r["number"], tuple((n, i) for n, i in r["fields"])) for r in rows}
    return sorted(found, key=lambda x: (x.number, x.id))


def column_ids(known: list[Layout], columns: list[str], renamed: dict[str, str]) -> list[str]:
    """Ids of ``columns`` after the ``known`` layouts; ``renamed`` maps a new name to its last one.

    A name of the newest layout keeps its id, as does one that an older layout had and no other column has taken over;
    any other name is a new column, with its name as id, or with a number behind it if that id is taken.
    """
    newest = dict(known[-1].fields) if known else {}
    older = {name: i for layout in known for name, i in layout.fields}
    taken = {i for layout in known for _, i in layout.fields}
    moved = {newest.get(old, older.get(old)) for old in renamed.values()}
    out = []
    for name in columns:
        last = renamed.get(name)
        if last is not None and (last in newest or last in older):
            found = newest.get(last, older.get(last))
        elif name in newest and newest[name] not in moved:
            found = newest[name]
        elif name in older and older[name] not in newest.values() and older[name] not in moved:
            found = older[name]
        else:
            found = name if name not in taken else f"{name}#{1 + sum(i.split('#')[0] == name for i in taken)}"
        taken.add(found)
        out.append(found)
    return out


def register(spark: SparkSession, path: str, columns: list[str], renamed: dict[str, str] | None = None) -> Layout:
    """The layout of parts with ``columns``; added to the history if it is new."""
    known = history(spark, path)
    if not renamed:
        # parts under any earlier version of the columns may still be appended
        for layout in reversed(known):
            if layout.names == list(columns):
                return layout
    fields = tuple(zip(columns, column_ids(known, columns, renamed or {}), strict=True))
    for layout in known:
        if layout.fields == fields:
            return layout
    layout = Layout(len(known), fields)
    row = json.dumps({"number": layout.number, "fields": layout.fields})
    spark.range(1).select(F.lit(row).alias("value")).coalesce(1).write.mode("append").text(history_path(path))
    return layout


def read_csv(spark: SparkSession, paths: list[str], columns: list[str], header: bool) -> DataFrame:
    return spark.read.schema(schemas.text_schema(columns)).option("header", header).option(
        "quote", '"').option("escape", '"').csv(paths)


def as_columns(df: DataFrame, sources: dict[str, str | None]) -> DataFrame:
    """Output name to the column it comes from; null where there is none."""
    return df.select(*[(F.col(f"`{old}`") if old else F.lit(None).cast("string")).alias(new)
                       for new, old in sources.items()])


def read_parts(spark: SparkSession, path: str, columns: list[str]) -> list[DataFrame]:
    """The parts of a table with a history, one frame for each layout, under today's ``columns``."""
    known = history(spark, path)
    ids: dict[str, str] = {}
    for layout in known:  # newer names win
        ids |= dict(layout.fields)
    out = []
    for layout in known:
        if exists(spark, part_path(path, layout)):
            name_of = {i: name for name, i in layout.fields}
            df = read_csv(spark, [part_path(path, layout)], layout.names, header=True)
            out.append(as_columns(df, {c: name_of.get(ids.get(c)) for c in columns}))
    return out


def by_header(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Files grouped by their first line; folders of known layouts are left out."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    heads = lines.where((F.col("start") == 0) & ~F.col("file").contains("/layout=")).groupBy("file").agg(
        F.first("value").alias("head"))
    out: dict[str, list[str]] = {}
    for r in heads.collect():  # one row for each file, as in the planner's own listing
        out.setdefault(r["head"], []).append(r["file"])
    return out


def read_foreign(spark: SparkSession, paths: list[str], columns: list[str]) -> list[DataFrame]:
    """Files with a header each, under ``columns``; columns they lack are null, others go."""
    out = []
    for head, files in sorted(by_header(spark, paths).items()):
        names = next(csv.reader([head.lstrip("﻿")]), [])
        unique = [n if names.index(n) == i else f"{n}#{i}" for i, n in enumerate(names)]
        if unique:
            df = read_csv(spark, files, unique, header=True)
            out.append(as_columns(df, {c: c if c in unique else None for c in columns}))
    return out
