"""The wire protocol, spoken by hand."""

from __future__ import annotations

import socket
import struct
import threading

import pytest

from brindle.server import PgServer
from brindle.sources.shared import work_dir


class Client:
    def __init__(self, port: int, **params: str):
        self.s = socket.create_connection(("127.0.0.1", port), timeout=120)
        self.s.sendall(struct.pack("!II", 8, 80877103))
        assert self.s.recv(1) == b"N"
        body = struct.pack("!I", 196608) + b"".join(k.encode() + b"\0" + v.encode() + b"\0" for k, v in params.items()) + b"\0"
        self.s.sendall(struct.pack("!I", len(body) + 4) + body)
        self.hello = self.read()

    def _exact(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            out += self.s.recv(n - len(out)) or pytest.fail("closed")
        return out

    def read(self) -> list[tuple[bytes, bytes]]:
        out = []
        while not out or out[-1][0] != b"Z":
            kind = self._exact(1)
            (size,) = struct.unpack("!I", self._exact(4))
            out.append((kind, self._exact(size - 4)))
        return out

    def send(self, kind: bytes, body: bytes) -> None:
        self.s.sendall(kind + struct.pack("!I", len(body) + 4) + body)

    def query(self, sql: str) -> list[tuple[bytes, bytes]]:
        self.send(b"Q", sql.encode() + b"\0")
        return self.read()

    def rows(self, sql: str) -> list[list[str | None]]:
        out = []
        for kind, body in self.query(sql):
            if kind == b"E":
                raise AssertionError(body)
            if kind == b"D":
                (n,), at, row = struct.unpack_from("!H", body), 2, []
                for _ in range(n):
                    (size,) = struct.unpack_from("!i", body, at)
                    at += 4
                    row.append(None if size < 0 else body[at : at + size].decode())
                    at += max(size, 0)
                out.append(row)
        return out


@pytest.fixture(scope="module")
def client(spark):
    server = PgServer(spark, work_dir(spark, "server"), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    c = Client(server.server_address[1], user="user1", database="test1")
    yield c
    c.send(b"X", b"")
    server.shutdown()
    server.server_close()


def test_hello(client):
    assert [k for k, _ in client.hello] == [b"R"] + [b"S"] * 5 + [b"Z"]


def test_statements(client):
    assert client.query("CREATE DATABASE test1")[0] == (b"C", b"CREATE DATABASE\0")
    assert client.rows("CREATE TABLE crates (no serial PRIMARY KEY, pieces bigint, fee real, note text)") == [["created"]]
    assert client.query("INSERT INTO crates (pieces, fee, note) VALUES (5, 12.5, NULL), (2, 8.25, 'zz')")[0] == (b"C", b"INSERT 0 2\0")
    reply = client.query("SELECT no, pieces, fee, note, true AS b FROM crates ORDER BY no")
    kind, body = reply[0]
    assert kind == b"T" and [x[0] for x in reply] == [b"T", b"D", b"D", b"C", b"Z"] and reply[3][1] == b"SELECT 2\0"
    oids, at = [], 2
    for _ in range(5):
        at = body.index(b"\0", at) + 1
        oids.append(struct.unpack_from("!IHI", body, at)[2])
        at += 18
    assert oids == [23, 20, 700, 25, 16]
    assert client.rows("SELECT no, note, no > 1 FROM crates ORDER BY no") == [["1", None, "f"], ["2", "zz", "t"]]
    port = client.s.getsockname()[1]
    assert client.rows("SELECT current_catalog, current_user, inet_client_port()") == [["test1", "user1", str(port)]]
    assert client.query("DROP TABLE crates")[0] == (b"C", b"DROP TABLE\0")


@pytest.mark.parametrize("sql", ["SELECT 1; SELECT 2", "UPDATE t SET a = 1", "SELECT * FROM nowhere", "SELECT CAST('x' AS int)", "SELECT 'open"])
def test_errors_leave_the_connection_open(client, sql):
    reply = client.query(sql)
    assert any(k == b"E" for k, _ in reply) and reply[-1] == (b"Z", b"I")
    assert client.rows("SELECT 1 AS a") == [["1"]]


def test_empty_and_extended(client):
    assert [k for k, _ in client.query(" ; ")] == [b"I", b"Z"]
    client.send(b"P", b"\0SELECT 1\0\0\0")
    client.send(b"S", b"")
    assert [k for k, _ in client.read()] == [b"E", b"Z"]


def test_many_rows_come_in_parts(client):
    assert len(client.rows("SELECT x FROM generate_series(1, 2500) g(x)")) == 2500
