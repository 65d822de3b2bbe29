"""Session settings the ledger relies on, and where to cut lineage.

The ledger is pure DataFrame code, so any session works; these are the settings it was
designed and tested with:

* ``spark.sql.session.timeZone=UTC``: checkout timestamps are zone-less (``timestamp_ntz``)
  and the -3 h shift to local time is done by the query itself.
* ANSI mode stays on (Spark 4 default); every division that may hit zero uses ``try_divide``.
* AQE with partition coalescing and skew-join splitting, so a hot session or card does not
  leave one task with a third of the rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # a call site for every column expression doubles the time that building a plan takes
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "settlekit", **conf: str) -> SparkSession:
    """Return a session with :data:`DEFAULT_CONF` (overridable by keyword, dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and read from here; it is an error if it is not,
    for no other folder is shared by all executors. Only in a local session (a laptop or a
    test), whose one process is driver and executor, a private folder takes its place.
    """
    sc = spark.sparkContext
    current = (
        spark.conf.get("spark.checkpoint.dir", None)
        or sc.getConf().get("spark.checkpoint.dir", None)
        or sc.getCheckpointDir()
    )
    if not current:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="settlekit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A write within gives back its shuffle files when it ends. Else they stay on the executors' disks
    until the driver happens to collect its garbage, below those of the writes that follow."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
