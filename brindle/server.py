"""PostgreSQL's simple-query protocol in front of the engine.

    python -m brindle.server ROOT [PORT [TABLES_DIR]]

One thread a connection and one engine a connection's database and user. Startup asks for no
password and no encryption. The extended protocol is refused. Rows are sent as text while the
partitions arrive, so a result is never held whole.
"""

from __future__ import annotations

import socketserver
import struct
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from brindle.engine import Engine, format_rows
from brindle.sql.classify import classify, single
from brindle.sql.errors import NoStatement, SqlError

#: Spark type -> (type id, size) of PostgreSQL; all others are sent as text.
TYPES = {
    "boolean": (16, 1), "binary": (17, -1), "bigint": (20, 8), "smallint": (21, 2), "int": (23, 4), "string": (25, -1),
    "float": (700, 4), "double": (701, 8), "date": (1082, 4), "timestamp_ntz": (1114, 8), "timestamp": (1184, 8),
}
_TEXT, _NUMERIC = (25, -1), (1700, -1)
_SSL, _GSS, _CANCEL, _VERSION = 80877103, 80877104, 80877102, 196608
_TAGS = {"create_table": "CREATE TABLE", "create_database": "CREATE DATABASE", "drop_table": "DROP TABLE", "explain": "EXPLAIN"}


def _message(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("!I", len(body) + 4) + body


def _zero(text: str) -> bytes:
    return text.encode() + b"\0"


def row_description(df: DataFrame) -> bytes:
    body = struct.pack("!H", len(df.dtypes))
    for name, kind in df.dtypes:
        oid, size = TYPES.get(kind, _NUMERIC if kind.startswith("decimal") else _TEXT)
        body += _zero(name) + struct.pack("!IHIhih", 0, 0, oid, size, -1, 0)
    return _message(b"T", body)


def data_row(row: tuple[str | None, ...]) -> bytes:
    body = struct.pack("!H", len(row))
    for v in row:
        if v is None:
            body += struct.pack("!i", -1)
        else:
            raw = v.encode()
            body += struct.pack("!i", len(raw)) + raw
    return _message(b"D", body)


def error_response(code: str, text: str) -> bytes:
    return _message(b"E", b"S" + _zero("ERROR") + b"V" + _zero("ERROR") + b"C" + _zero(code) + b"M" + _zero(text) + b"\0")


_READY = _message(b"Z", b"I")


class _Connection(socketserver.StreamRequestHandler):
    def _read(self, n: int) -> bytes:
        data = self.rfile.read(n)
        if len(data) != n:
            raise ConnectionError
        return data

    def _startup(self) -> dict[str, str]:
        while True:
            (size,) = struct.unpack("!I", self._read(4))
            (code,) = struct.unpack("!I", self._read(4))
            body = self._read(size - 8)
            if code in (_SSL, _GSS):
                self.wfile.write(b"N")
            elif code == _VERSION:
                parts = [p.decode() for p in body.rstrip(b"\0").split(b"\0")]
                return dict(zip(parts[::2], parts[1::2]))
            else:
                raise ConnectionError

    def handle(self) -> None:
        try:
            params = self._startup()
            user = params.get("user", "postgres")
            server: PgServer = self.server  # type: ignore[assignment]
            engine = Engine(server.spark, params.get("database", user), user, self.client_address[1], server.root)
            hello = _message(b"R", struct.pack("!I", 0))
            for k, v in (("server_version", "16.0"), ("client_encoding", "UTF8"), ("server_encoding", "UTF8"), ("DateStyle", "ISO"), ("TimeZone", "UTC")):
                hello += _message(b"S", _zero(k) + _zero(v))
            self.wfile.write(hello + _READY)
            while True:
                kind = self._read(1)
                (size,) = struct.unpack("!I", self._read(4))
                body = self._read(size - 4)
                if kind == b"X":
                    return
                if kind == b"Q":
                    self._query(engine, body.rstrip(b"\0").decode())
                elif kind == b"S":
                    self.wfile.write(_READY)
                elif kind == b"P":
                    self.wfile.write(error_response("0A000", "the extended query protocol is not supported"))
        except (ConnectionError, BrokenPipeError):
            return

    def _query(self, engine: Engine, sql: str) -> None:
        try:
            try:
                kind = classify(single(sql))
            except NoStatement:
                self.wfile.write(_message(b"I", b"") + _READY)
                return
            df, n = engine.sql(sql), 0
            if kind == "insert":
                n = df.first()["count"]
                self.wfile.write(_message(b"C", _zero(f"INSERT 0 {n}")) + _READY)
                return
            if kind in ("create_database", "drop_table"):
                self.wfile.write(_message(b"C", _zero(_TAGS[kind])) + _READY)
                return
            self.wfile.write(row_description(df))
            held: list[bytes] = []
            for row in format_rows(df):
                n += 1
                held.append(data_row(row))
                if len(held) == 1000:
                    self.wfile.write(b"".join(held))
                    held = []
            self.wfile.write(b"".join(held) + _message(b"C", _zero(_TAGS.get(kind, f"SELECT {n}"))) + _READY)
        except SqlError as e:
            self.wfile.write(error_response("42000", str(e)) + _READY)
        except PySparkException as e:
            self.wfile.write(error_response(e.getSqlState() or "XX000", str(e).split("\n")[0]) + _READY)
        except (ConnectionError, BrokenPipeError):
            raise
        except Exception as e:  # noqa: BLE001  a statement must not end the connection
            self.wfile.write(error_response("XX000", str(e).split("\n")[0]) + _READY)


class PgServer(socketserver.ThreadingTCPServer):
    """Serves the catalog under ``root``; ``port`` 0 takes a free one."""

    allow_reuse_address = True
    daemon_threads = True

    def __init__(self, spark: SparkSession, root: str, host: str = "127.0.0.1", port: int = 5432):
        self.spark, self.root = spark, root
        super().__init__((host, port), _Connection)


def main(root: str, port: int = 5432, tables_dir: str | None = None) -> None:
    from brindle.session import local_session
    from brindle.sources.tables import register

    spark = local_session()
    if tables_dir:
        register(spark, tables_dir)
    with PgServer(spark, root, port=port) as server:
        server.serve_forever()


if __name__ == "__main__":
    main(sys.argv[1], *(int(x) if i == 0 else x for i, x in enumerate(sys.argv[2:])))
