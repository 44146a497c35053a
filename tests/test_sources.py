"""Manifests and operators on a filesystem other than the plain local one."""

from __future__ import annotations

import uuid

import pytest

from brindle.operators.dedupe import Deduper
from brindle.operators.incremental import IncrementalRun
from brindle.sources.manifest import ConflictError, SnapshotTable
from brindle.sources.shared import shared_dir


@pytest.fixture(scope="module")
def mounted(spark, tmp_path_factory) -> str:
    """A folder behind a mount table: paths of another scheme, another implementation."""
    conf, at = spark.sparkContext._jsc.hadoopConfiguration(), tmp_path_factory.mktemp("mounted")
    name = f"cluster{uuid.uuid4().hex[:6]}"
    conf.set(f"fs.viewfs.mounttable.{name}.link./data", f"file://{at}")
    return f"viewfs://{name}/data"


def test_manifests(spark, mounted):
    t = SnapshotTable(spark, f"{mounted}/m")
    assert t.version() == 0 and t.publish(0, {"a": "ü"}) == 1 and t.read() == {"a": "ü"}
    with pytest.raises(ConflictError):
        t.publish(0, {})
    path = t.data_path()
    spark.range(5).write.parquet(path)
    assert spark.read.parquet(path).count() == 5
    t.delete(path)
    assert not t._fs.exists(t._jvm.org.apache.hadoop.fs.Path(path))


def test_operators(spark, mounted):
    schema = "log_name string, log_offset bigint, tablet_id bigint, epoch bigint, sequence bigint"
    run, at = IncrementalRun(spark, f"{mounted}/run"), f"{mounted}/log"
    for k in range(2):
        spark.createDataFrame([("a", 10 * k + i, 1, 1, 10 * k + i) for i in range(3)], schema).coalesce(1).write.mode("append").parquet(at)
        pending = run.plan(spark.read.schema(schema).parquet(at))
        assert len(pending.files) == 1 and pending.rows.count() == 3
        run.commit(pending)
    job = Deduper(spark, f"{mounted}/dedupe")
    job.deliver(spark.read.schema(schema).parquet(at))
    job.deliver(spark.read.schema(schema).parquet(at))
    assert job.accepted().count() == 6 == job.repeated().count()


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: "")})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
