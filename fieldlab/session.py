"""Session settings and the two helpers that decide how small tables travel."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its rows were counted and lie under this bound.
BROADCAST_ROWS = 200_000

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A key may hold a third of the rows: split its partition in joins even if
    # that costs one more exchange further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Rows with arrays reach Python in batches bounded by size.
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator here relies on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    _ship_package(spark)
    return spark


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, wherever the driver was started; once per application.

    The archive goes to the shared folder, from where Spark hands it to executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder, kept = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(kept, "w") as archive:
        for at, _, files in os.walk(folder):
            for name in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(at, name)
                archive.write(path, os.path.relpath(path, os.path.dirname(folder)))
    target = f"{shared_dir(spark)}/{os.path.basename(folder)}-{uuid.uuid4().hex}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(kept.getvalue())
    out.close()
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see, taken from ``spark.checkpoint.dir``.

    A local session without the setting gets a folder of its own. On a cluster
    the setting is needed, since a machine-local folder is of no use there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not path and context.getCheckpointDir():
        path = context.getCheckpointDir()
    if not path and context.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="fieldlab-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Compute a reduced table once and keep it in the shared folder.

    Survives lost executors and makes both readers of the table see the very
    same rows.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, many: bool = False, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if a count proves it small, else leave it to a shuffle join.

    The count stops at ``max_rows + 1``. The other way is Spark's sort-merge
    join, whose hot keys the adaptive skew handling splits. ``many`` says that
    the table has a row per entity and grows with the data: it then goes to the
    shuffle join at once, without being written and counted first.
    """
    if many:
        return df
    kept = settle(df)
    rows = kept.limit(max_rows + 1).count()
    return F.broadcast(kept) if rows <= max_rows else kept
