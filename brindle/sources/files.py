"""The files behind a scan, for reading only those that are new."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_STATUS = re.compile(r"path=(.*?); isDirectory=false; length=(\d+);.*?modification_time=(\d+)")
_FORMATS = ("parquet", "orc")


def _relation(df: DataFrame):
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() == "SubqueryAlias":
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    return plan.relation()


def listed_files(df: DataFrame) -> dict[str, tuple[int, int]] | None:
    """Path to (length, modification time) of each file that a plain scan reads.

    None for anything but a plain scan of Parquet or ORC files. The listing is the one that the
    scan itself holds on the driver; it comes over in one call.
    """
    relation = _relation(df)
    if relation is None or relation.fileFormat().toString().lower() not in _FORMATS:
        return None
    statuses = relation.location().allFiles()
    text = statuses.mkString("\n")
    found = {m[1]: (int(m[2]), int(m[3])) for m in map(_STATUS.search, text.splitlines()) if m}
    if len(found) != statuses.size() or "null" in found:  # a filesystem that prints its files otherwise is asked for each
        each = (statuses.apply(i) for i in range(statuses.size()))
        found = {f.getPath().toString(): (f.getLen(), f.getModificationTime()) for f in each}
    # glob characters in a name would be taken for patterns
    return None if any(set(p) & set("*?[]{}\\") for p in found) else found


def scan_of(df: DataFrame, paths: list[str]) -> DataFrame:
    """The same scan over some of its files; partition columns are kept."""
    if not paths:
        return df.limit(0)
    relation = _relation(df)
    reader = df.sparkSession.read.schema(df.schema).format(relation.fileFormat().toString().lower())
    roots = relation.location().rootPaths()
    if roots.size() == 1 and not paths == [roots.head().toString()]:
        reader = reader.option("basePath", roots.head().toString())
    return reader.load(paths)
