"""Registered queries of statements, catalog and INSERT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.engine import Engine, format_rows
from brindle.operators.skew import lookup_join
from brindle.sources.shared import work_dir
from brindle.sources.tables import read_files, table, write_files
from brindle.sql.errors import SqlError

def _engine(spark: SparkSession, sf_dir: str | None = None, tables: list[str] | None = None) -> Engine:
    e = Engine(spark, "test1", "user1", root=work_dir(spark, "engine"), tables_dir=sf_dir, tables=tables)
    e.sql("CREATE DATABASE test1")
    return e


def _crates(spark: SparkSession, sf_dir: str) -> tuple[Engine, DataFrame]:
    """A table with a serial key and one row a nation, written out as a list of values."""
    e = _engine(spark, sf_dir, ["supplier"])
    e.sql("CREATE TABLE crates (no serial PRIMARY KEY, pieces bigint, fee real, note text)")
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25
    values = ", ".join(f"({r.n_regionkey}, {r.n_nationkey}.25, {'NULL' if r.n_regionkey == 0 else repr(r.n_name)})" for r in rows)
    return e, e.sql(f"INSERT INTO crates (pieces, fee, note) VALUES {values}")


def insert_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serial numbers of a list of values: in its order."""
    return _crates(spark, sf_dir)[0].sql("SELECT no, pieces, note FROM crates ORDER BY pieces DESC, no ASC")


def insert_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an INSERT of values and one of a query answer."""
    e, first = _crates(spark, sf_dir)
    return first.unionByName(e.sql("INSERT INTO crates (pieces, note) SELECT s_nationkey, s_name FROM supplier WHERE s_acctbal > 0"))


def insert_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _crates(spark, sf_dir)
    e.sql("INSERT INTO crates (pieces, fee) SELECT s_nationkey, s_acctbal FROM supplier")
    return e.sql("SELECT CAST(sum(pieces) AS bigint) AS s, round(CAST(max(fee) AS double), 2) AS hi, round(CAST(min(fee) AS double), 2) AS lo, round(sum(pieces * round(CAST(fee AS double), 2)), 1) AS total, max(no) AS last FROM crates ORDER BY max(fee) DESC")


def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table filled from a query: serial numbers are dense, whatever their order."""
    e = _engine(spark, sf_dir, ["orders"])
    e.sql("CREATE TABLE copies (id bigserial PRIMARY KEY, o bigint UNIQUE, status varchar(1))")
    e.sql("INSERT INTO copies (o, status) SELECT o_orderkey, o_orderstatus FROM orders")
    e.sql("INSERT INTO copies (o, status) SELECT -1 - o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
    return e.sql("SELECT min(id) AS lo, max(id) AS hi, count(DISTINCT id) AS n, count(*) FILTER (WHERE o < 0) AS negative FROM copies")


def agg_functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping by a table's key: its other columns need not be grouped or aggregated."""
    e = _engine(spark, sf_dir, ["customer", "orders"])
    e.sql("CREATE TABLE buyers (id bigint PRIMARY KEY, label text, segment text)")
    e.sql("INSERT INTO buyers SELECT c_custkey, c_name, c_mktsegment FROM customer")
    return e.sql("SELECT id, label, segment || '!' AS loud, count(o_orderkey) AS n FROM buyers LEFT JOIN orders ON id = o_custkey GROUP BY id")


def insert_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which INSERTs of all documents break NOT NULL, a kind or a column list, and what is left."""
    e = _engine(spark, sf_dir, ["documents"])
    e.sql("CREATE TABLE pages (id bigint PRIMARY KEY, lang text NOT NULL, pages smallint)")
    said = [_refused(e, f"INSERT INTO pages {rest}") for rest in ("SELECT doc_id, lang, page_no FROM documents", "(id, pages) SELECT doc_id, page_no FROM documents", "(id, lang, nothing) SELECT doc_id, 'x', 1 FROM documents", "(id, lang) SELECT doc_id, coalesce(lang, '?') FROM documents")]
    left = e.sql("SELECT count(*) AS n, count(pages) AS n_pages, count(DISTINCT lang) AS langs FROM pages")
    return left.withColumn("said", F.lit(",".join(said)))


def _refused(e: Engine, statement: str) -> str:
    try:
        e.sql(statement)
    except SqlError as x:
        return type(x).__name__
    return "done"


def insert_unique_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nulls of a unique column are let in, a second copy of a value is not."""
    e = _engine(spark, sf_dir, ["documents"])
    e.sql("CREATE TABLE shelves (no serial PRIMARY KEY, label text, CONSTRAINT one_label UNIQUE NULLS DISTINCT (label))")
    e.sql("INSERT INTO shelves (label) SELECT DISTINCT source FROM documents UNION ALL SELECT NULL FROM documents")
    said = [_refused(e, f"INSERT INTO shelves (label) SELECT {what} FROM documents WHERE source IS NOT NULL") for what in ("max(source)", "max(source) || '!'", "source || '?'")]
    return e.sql("SELECT label, count(*) AS n, count(DISTINCT no) AS numbers FROM shelves GROUP BY label").withColumn("said", F.lit(",".join(said)))


def insert_unique_not_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where nulls are equal, one is let in."""
    e = _engine(spark, sf_dir, ["documents"])
    e.sql("CREATE TABLE shelves (no serial PRIMARY KEY, label text, CONSTRAINT one_label UNIQUE NULLS NOT DISTINCT (label))")
    said = [_refused(e, f"INSERT INTO shelves (label) {what}") for what in ("SELECT NULL FROM documents", "SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT NULL", "SELECT NULL")]
    return e.sql("SELECT label FROM shelves").withColumn("said", F.lit(",".join(said)))


def ddl_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors after databases and tables were made and dropped."""
    e = _engine(spark)
    e.sql("CREATE DATABASE IF NOT EXISTS test1")
    e.sql("CREATE TABLE IF NOT EXISTS ledger (no bigserial PRIMARY KEY, code varchar(12) NOT NULL, remark varchar, CONSTRAINT one_code UNIQUE(code))")
    e.sql("CREATE TABLE gone (a int PRIMARY KEY)")
    e.sql("DROP TABLE gone")
    e.sql("DROP TABLE IF EXISTS gone")
    return e.catalog.descriptors()


_REFUSED = [
    "SELECT 1; SELECT 2", " ", "UPDATE t SET a = 1", "DELETE FROM t", "INSERT OVERWRITE t SELECT 1", "BEGIN", "SET a = 1", "COPY t FROM 'x'", "PREPARE p AS SELECT 1", "CREATE VIEW v AS SELECT 1", "CREATE SCHEMA s", "CREATE INDEX i ON t (a)",
    "CREATE FUNCTION f() RETURNS int", "DROP VIEW v", "DROP SCHEMA s", "CREATE OR REPLACE TABLE t (a int)", "CREATE TEMPORARY TABLE t (a int)", "CREATE EXTERNAL TABLE t (a int)", "CREATE TABLE t AS SELECT 1", "CREATE TABLE t (a int)", "CREATE TABLE t (a date PRIMARY KEY)",
    "CREATE TABLE t (a int PRIMARY KEY CHECK (a > 0))", "CREATE TABLE t (a int PRIMARY KEY, FOREIGN KEY (a) REFERENCES u (b))", "CREATE TABLE t (a varchar(max) PRIMARY KEY)", "DROP TABLE nothing", "INSERT INTO nothing VALUES (1)",
]
_CLASSES = ["MultipleStatements", "NoStatement", "Unsupported", "Unsupported", "Unsupported", "Unsupported", "Unsupported", "Unsupported", "Unsupported", "Unimplemented", "Unimplemented", "Unimplemented", "Unimplemented", "Unimplemented", "Unimplemented", "Unsupported", "Unsupported", "Unsupported", "UnexpectedStatement", "SyntaxProblem", "Unsupported", "Unsupported", "Unsupported", "Unsupported", "NotFound", "NotFound"]


def statement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements are refused, and with what class of error."""
    e = _engine(spark)
    return spark.createDataFrame([(i, _refused(e, s)) for i, s in enumerate(_REFUSED)], "i int, said string")


def explain_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir, ["nation"])
    plan = e.sql("EXPLAIN SELECT n_name FROM nation WHERE n_nationkey > 3").first()["plan"]
    return spark.createDataFrame([("PushedFilters" in plan and "n_nationkey" in plan,)], "pushed boolean")


def wire_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as text: t and f, hex for bytes, null for NULL."""
    e = _engine(spark)
    rows = list(format_rows(e.sql("SELECT true AS a, false AS b, NULL::text AS c, 12::int2 AS d, CAST('hi' AS bytea) AS e, 1.5::float8 AS f, 7::bigint AS g, 'NaN'::float8 AS h, 'Infinity'::float8 AS i, '-Infinity'::float4 AS j")))
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows[0])], "i int, v string")


def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows through each file format."""
    at, n = work_dir(spark, "formats"), table(spark, sf_dir, "nation")
    out = None
    for kind in ("parquet", "orc", "json", "csv"):
        write_files(n, f"{at}/{kind}", kind)
        back = read_files(spark, f"{at}/{kind}", kind, n.schema).groupBy(F.lit(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("keys"), F.max("n_name").alias("last"))
        out = back if out is None else out.unionByName(back)
    return out


def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of a lookup join beyond the broadcast bound: salted on the big side."""
    li, p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_quantity"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    return lookup_join(li, p, ["k"], "inner", max_rows=0).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


_ALL = (insert_serial, insert_count, insert_aggregate, insert_select, agg_functional, insert_not_null, insert_unique_distinct, insert_unique_not_distinct, ddl_catalog, statement_errors, explain_statement, wire_format, file_formats, join_salted)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {
    "insert_serial": "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS int) AS no, CAST(n_regionkey AS bigint) AS pieces, CASE WHEN n_regionkey <> 0 THEN n_name END AS note FROM nation",
    "insert_count": "SELECT count(*) AS count FROM nation UNION ALL SELECT count(*) FROM supplier WHERE s_acctbal > 0",
    "insert_aggregate": """WITH c AS (SELECT n_regionkey AS pieces, n_nationkey + 0.25 AS fee FROM nation UNION ALL SELECT s_nationkey, s_acctbal FROM supplier)
      SELECT CAST(sum(pieces) AS bigint) AS s, CAST(max(fee) AS double) AS hi, CAST(min(fee) AS double) AS lo, round(sum(pieces * round(fee, 2)), 1) AS total, CAST(count(*) AS int) AS last FROM c""",
    "insert_select": "SELECT CAST(1 AS bigint) AS lo, count(*) + count(*) FILTER (WHERE o_orderstatus = 'P') AS hi, count(*) + count(*) FILTER (WHERE o_orderstatus = 'P') AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS negative FROM orders",
    "agg_functional": "SELECT c_custkey AS id, any_value(c_name) AS label, any_value(c_mktsegment) || '!' AS loud, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "insert_not_null": "SELECT count(*) AS n, CAST(0 AS bigint) AS n_pages, count(DISTINCT coalesce(lang, '?')) AS langs, 'ConstraintViolation,ConstraintViolation,NotFound,done' AS said FROM documents",
    "insert_unique_distinct": """WITH r AS (SELECT DISTINCT source AS label FROM documents UNION ALL SELECT NULL FROM documents UNION ALL SELECT max(source) || '!' FROM documents)
      SELECT label, count(*) AS n, count(*) AS numbers, 'UniqueViolation,done,UniqueViolation' AS said FROM r GROUP BY label""",
    "insert_unique_not_distinct": "SELECT *, 'UniqueViolation,done,UniqueViolation' AS said FROM (SELECT DISTINCT source AS label FROM documents WHERE source IS NOT NULL UNION ALL SELECT NULL)",
    "ddl_catalog": "SELECT * FROM (VALUES (CAST(1 AS bigint), 'test1', 'database', CAST(0 AS bigint), '', ''), (2, 'public', 'schema', 1, '', ''), (3, 'ledger', 'table', 2, 'no,code,remark', '1:primary,2:unique_nulls_distinct')) t(id, name, kind, parent_id, columns, indices)",
    "statement_errors": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(_CLASSES)) + ") t(i, said)",
    "explain_statement": "SELECT true AS pushed",
    "wire_format": "SELECT * FROM (VALUES (0, 't'), (1, 'f'), (2, NULL), (3, '12'), (4, '\\x6869'), (5, '1.5'), (6, '7'), (7, 'NaN'), (8, 'Infinity'), (9, '-Infinity')) t(i, v)",
    "file_formats": "SELECT kind, count(*) AS n, CAST(sum(n_nationkey) AS bigint) AS keys, max(n_name) AS last FROM nation, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) k(kind) GROUP BY kind",
    "join_salted": "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
}
