"""Sessions: a tuned local factory, and making this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_ROOTS: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "lumenframe", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster, use the session that it gives."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application; Spark distributes the archive."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="lumenframe-"), "lumenframe-src.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(d, n)
                        z.write(full, os.path.join("lumenframe", os.path.relpath(full, root)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: the cluster's; on one machine, a folder of our own where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="lumenframe-checkpoints-")
    return _ROOTS[app]
