"""The folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where a local session names none (tests, a laptop) a temporary folder is made once and
    remembered in the session; on a cluster the setting must be there, as no folder of one
    machine is seen by the others.
    """
    at = spark.conf.get(SETTING, "")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{SETTING} names no folder that all executors of {master} can reach")
        at = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set(SETTING, at)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder for one run of the operator ``name``."""
    return f"{shared_dir(spark)}/brindle-{name}-{uuid.uuid4().hex}"


def ship_code(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever they run; once a session.

    The package's modules are zipped into the shared folder and handed to Spark, so workers
    need neither an installation nor the driver's path.
    """
    import hashlib
    import io
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_brindle_shipped", False):
        return
    package, held = Path(__file__).resolve().parent.parent, io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{package.name}/{p.relative_to(package)}"), p.read_bytes())
    data = held.getvalue()
    path = context._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark, 'code')}/brindle-{hashlib.md5(data).hexdigest()}.zip")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    context.addPyFile(path.toString())
    context._brindle_shipped = True
