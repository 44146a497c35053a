"""Databases, schemas and tables, as descriptors in a versioned manifest."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brindle.sources.manifest import ConflictError, SnapshotTable
from brindle.sql.ddl import SPARK_TYPES, CreateTable
from brindle.sql.errors import AlreadyExists, NotFound

RETRIES = 10


class Catalog:
    """One manifest under ``root`` holds all descriptors; each change is one new version.

    Ids are allocated from one counter and never used again. A change that meets another
    writer's version is made once more on top of it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = SnapshotTable(spark, f"{self.root}/catalog")

    def read(self) -> dict:
        return self.versions.read() or {"next_id": 1, "databases": {}, "schemas": {}, "tables": {}}

    def _change(self, edit):
        for _ in range(RETRIES):
            base = self.versions.version()
            state = self.versions.read(base) or {"next_id": 1, "databases": {}, "schemas": {}, "tables": {}}
            out = edit(state)
            if out is None:
                return None
            try:
                self.versions.publish(base, state)
                return out
            except ConflictError:
                continue
        raise ConflictError(f"{self.root}: too many writers")

    def create_database(self, name: str, if_not_exists: bool = False) -> bool:
        """Makes the database and its schema ``public``; False if it was there."""

        def edit(state):
            if any(d["name"] == name for d in state["databases"].values()):
                if if_not_exists:
                    return None
                raise AlreadyExists(f"database {name} already exists")
            at = state["next_id"]
            state["next_id"] = at + 2
            state["databases"][str(at)] = {"id": at, "name": name, "parent_id": 0}
            state["schemas"][str(at + 1)] = {"id": at + 1, "name": "public", "parent_id": at}
            return at

        return self._change(edit) is not None

    def _schema(self, state: dict, database: str, schema: str) -> dict:
        found = next((d for d in state["databases"].values() if d["name"] == database), None)
        if not found:
            raise NotFound(f"database {database} does not exist")
        inside = next((s for s in state["schemas"].values() if s["parent_id"] == found["id"] and s["name"] == schema), None)
        if not inside:
            raise NotFound(f"schema {database}.{schema} does not exist")
        return inside

    @staticmethod
    def resolve(name: list[str], database: str) -> tuple[str, str, str]:
        return (database, "public", name[0]) if len(name) == 1 else (database, name[0], name[1]) if len(name) == 2 else tuple(name)

    def create_table(self, made: CreateTable, database: str) -> bool:
        """Adds the descriptor; False if the table was there and that is allowed."""
        db, schema, table = self.resolve(made.name, database)

        def edit(state):
            parent = self._schema(state, db, schema)
            if any(t["parent_id"] == parent["id"] and t["name"] == table for t in state["tables"].values()):
                if made.if_not_exists:
                    return None
                raise AlreadyExists(f"table {table} already exists")
            at = state["next_id"]
            state["next_id"] = at + 1
            state["tables"][str(at)] = {
                "id": at, "name": table, "parent_id": parent["id"], "last_column_id": len(made.columns), "last_index_id": len(made.indices),
                "columns": [asdict(c) for c in made.columns], "indices": [asdict(x) for x in made.indices],
            }
            return at

        return self._change(edit) is not None

    def find(self, name: list[str], database: str) -> dict | None:
        db, schema, table = self.resolve(name, database)
        state = self.read()
        try:
            parent = self._schema(state, db, schema)
        except NotFound:
            return None
        return next((t for t in state["tables"].values() if t["parent_id"] == parent["id"] and t["name"] == table), None)

    def drop_table(self, name: list[str], database: str, if_exists: bool = False) -> bool:
        """Removes the descriptor, then the rows."""
        gone: list[dict] = []

        def edit(state):
            db, schema, table = self.resolve(name, database)
            try:
                parent = self._schema(state, db, schema)
            except NotFound:
                if if_exists:
                    return None
                raise
            found = next((t for t in state["tables"].values() if t["parent_id"] == parent["id"] and t["name"] == table), None)
            if not found:
                if if_exists:
                    return None
                raise NotFound(f"table {table} does not exist")
            gone[:] = [state["tables"].pop(str(found["id"]))]
            return found["id"]

        if self._change(edit) is None:
            return False
        self.versions.delete(self.data(gone[0]).root)
        return True

    def data(self, table: dict) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.root}/tables/{table['id']}")

    @staticmethod
    def schema(table: dict) -> T.StructType:
        out = T.StructType()
        for c in table["columns"]:
            meta = {"serial": c["serial"]} | ({"max_length": c["max_length"]} if c["max_length"] else {})
            out.add(T.StructField(c["name"], T._parse_datatype_string(SPARK_TYPES[c["kind"]]), c["nullable"], meta))
        return out

    def scan(self, table: dict, version: int | None = None) -> DataFrame:
        """A table's rows in its newest (or an older) version; columns and filters are pushed down."""
        parts = self.data(table).read(version).get("parts", [])
        schema = self.schema(table)
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def descriptors(self) -> DataFrame:
        """All descriptors: id, name, kind, parent_id, columns, indices."""
        state = self.read()
        rows = [(d["id"], d["name"], kind, d["parent_id"], ",".join(c["name"] for c in d.get("columns", [])), ",".join(f"{x['id']}:{x['kind']}" for x in d.get("indices", []))) for kind, group in (("database", "databases"), ("schema", "schemas"), ("table", "tables")) for d in state[group].values()]
        return self.spark.createDataFrame(rows, "id bigint, name string, kind string, parent_id bigint, columns string, indices string")


def require_table(catalog: Catalog, name: list[str], database: str) -> dict:
    found = catalog.find(name, database)
    if not found:
        raise NotFound(f"table {'.'.join(name)} does not exist")
    return found

