"""INSERT: prefill, validation, unique checks and an atomic append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.catalog import RETRIES, Catalog
from brindle.operators.skew import lookup_join
from brindle.sources.manifest import ConflictError
from brindle.sql.ddl import SPARK_TYPES
from brindle.sql.errors import ConstraintViolation, NotFound, SyntaxProblem, UniqueViolation

_LIMITS = {"int16": (1 << 15) - 1, "int32": (1 << 31) - 1, "int64": (1 << 63) - 1}


def _unique_indices(table: dict) -> list[dict]:
    return [x for x in table["indices"] if x["kind"] != "not_unique"]


def _first_clash(rows: DataFrame, index: dict, existing: DataFrame | None) -> tuple | None:
    """A key that is in ``rows`` twice, or in ``existing`` too; None if there is none."""
    keys = index["columns"]
    given = rows.select(*keys)
    if index["kind"] == "unique_nulls_distinct":
        given = given.dropna("any")
    twice = given.groupBy(*keys).count().where("count > 1").select(*keys).limit(1).collect()
    if not twice and existing is not None:
        # only what lies in the new keys' range is read: nothing, for numbers that grow
        bounds = given.agg(*(f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max)))).first()
        old = existing.select(*keys)
        for i, k in enumerate(keys):
            if bounds[f"lo{i}"] is not None:
                inside = F.col(k).between(F.lit(bounds[f"lo{i}"]), F.lit(bounds[f"hi{i}"]))
                old = old.where(inside | F.col(k).isNull() if index["kind"] == "unique_nulls_not_distinct" else inside)
        if index["kind"] == "unique_nulls_not_distinct":
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
            twice = given.join(old.toDF(*(f"__{k}" for k in keys)), same, "left_semi").limit(1).collect()
        else:
            # the table is not shuffled as long as the new keys fit a broadcast
            twice = lookup_join(old, given, keys, "left_semi").limit(1).collect()
    return tuple(twice[0]) if twice else None


def insert(catalog: Catalog, table: dict, source: DataFrame, columns: list[str] | None, ordered: str | None = None) -> int:
    """Appends the rows of ``source`` and returns their number.

    ``columns`` are the target columns in order (all, if None). A column that the statement
    leaves out is filled: NULL if it may be null, the next numbers if it is serial, else the
    statement fails. ``ordered`` names a source column that gives the order of serial numbers.

    The rows are staged first, so the source runs once. Numbers are given per staged
    partition from an offset each, without collecting or ordering rows. Checks are aggregates
    and semi-joins against the version that the rows will be published on; if another writer
    publishes first, they are made again.
    """
    spark = catalog.spark
    by_name = {c["name"]: c for c in table["columns"]}
    listed = columns or [c["name"] for c in table["columns"]]
    given = [c for c in source.columns if c != ordered]
    if len(given) != len(listed):
        raise SyntaxProblem(f"{len(listed)} columns but {len(given)} values")
    for c in listed:
        if c not in by_name:
            raise NotFound(f"column {c} does not exist")
    if len(set(listed)) != len(listed):
        raise SyntaxProblem("a column is listed twice")
    missing = [c for n, c in by_name.items() if n not in listed]
    for c in missing:
        if not c["nullable"] and not c["serial"]:
            raise ConstraintViolation(f"missing column {c['name']}")

    data = catalog.data(table)
    staged_at, final_at = data.data_path("staged"), data.data_path("part")
    typed = source.toDF(*[ordered if c == ordered else f"__s{i}" for i, c in enumerate(source.columns)])
    picks = [F.col(n).cast(SPARK_TYPES[by_name[t]["kind"]]).alias(t) for n, t in zip([c for c in typed.columns if c != ordered], listed)]
    staged = typed.select(*picks, *([ordered] if ordered else []))
    if not ordered:
        staged = staged.withColumn("__mid", F.monotonically_increasing_id())
    staged.write.parquet(staged_at)
    staged = spark.read.parquet(staged_at)
    n = staged.count()

    for c in listed:
        if not by_name[c]["nullable"] and staged.where(F.col(c).isNull()).limit(1).count():
            data.delete(staged_at)
            raise ConstraintViolation(f"null in column {c}, which is not nullable")

    if ordered:  # a literal list, on the driver already
        numbered = staged.withColumn("__n", F.col(ordered).cast("bigint"))
    else:
        pid = F.shiftright("__mid", 33)
        sizes = staged.groupBy(pid.alias("__pid")).count().collect() if any(c["serial"] for c in missing) else []
        offset, pairs = 0, []
        for r in sorted(sizes, key=lambda r: r["__pid"]):
            pairs.append((r["__pid"], offset))
            offset += r["count"]
        starts = spark.createDataFrame(pairs or [(0, 0)], "__pid bigint, __off bigint")
        # one row a partition of the source
        numbered = staged.withColumn("__pid", pid).join(F.broadcast(starts), "__pid", "left").withColumn("__n", F.coalesce("__off", F.lit(0)) + F.col("__mid").bitwiseAND((1 << 33) - 1))

    for _ in range(RETRIES):
        base = data.version()
        manifest = data.read(base)
        counters = dict(manifest.get("counters", {}))
        rows = numbered
        for c in missing:
            if c["serial"]:
                start = counters.get(str(c["id"]), 0)
                counters[str(c["id"])] = start + n
                if start + n > _LIMITS[c["kind"]]:
                    data.delete(staged_at)
                    raise ConstraintViolation(f"serial column {c['name']} is exhausted")
                rows = rows.withColumn(c["name"], (F.lit(start + 1) + F.col("__n")).cast(SPARK_TYPES[c["kind"]]))
            else:
                rows = rows.withColumn(c["name"], F.lit(None).cast(SPARK_TYPES[c["kind"]]))
        rows = rows.select(*by_name)
        existing = catalog.scan(table, base) if manifest.get("parts") else None
        for index in _unique_indices(table):
            clash = _first_clash(rows, index, existing)
            if clash is not None:
                data.delete(staged_at)
                raise UniqueViolation(index["name"], clash)
        rows.write.mode("overwrite").parquet(final_at)
        try:
            data.publish(base, {"parts": [*manifest.get("parts", []), final_at], "counters": counters})
        except ConflictError:
            continue
        data.delete(staged_at)
        return n
    raise ConflictError(f"{data.root}: too many writers")
