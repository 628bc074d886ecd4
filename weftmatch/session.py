"""Session defaults and durable intermediate results.

Iterative operators cut their lineage by writing a Parquet table to the folder named by ``spark.checkpoint.dir``,
which every executor of a cluster can reach; losing an executor therefore loses no intermediate result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Rows beyond which a side is not broadcast, however small its rows are.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "weftmatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map={**DEFAULTS, **conf}).getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session or the context's checkpoint
    folder. Where neither is set, as in tests, a session that runs in one process gets a temporary folder; on a cluster,
    whose executors could not reach it, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = "file://" + tempfile.mkdtemp(prefix="weftmatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps neither recompute it nor depend on
    blocks held by one executor. Keeps the schema; the tables are removed when the driver's Python ends, or earlier
    by ``discard``."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/weftmatch/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftmatch_path = path
    return out


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have ``path`` removed when the driver's Python ends."""
    if not _written:
        atexit.register(_discard_all)
    _written.append((spark, path))


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``BROADCAST_ROWS`` rows, else left to an ordinary join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def ranks(order: DataFrame) -> DataFrame:
    """``collection`` and ``ord`` of ``order`` as ``small`` gives them; what comes from here isn't counted again."""
    if getattr(order, "_weftmatch_ranks", False):
        return order
    out = small(order.select("collection", "ord"))
    out._weftmatch_ranks = True
    return out


def release(spark: SparkSession) -> None:
    """Let go of what ended statements left: the driver's garbage, and with it the shuffle files that it still names."""
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Remove a table of ``materialize`` that no later step reads."""
    path = getattr(df, "_weftmatch_path", None)
    if path:
        _remove(df.sparkSession, path)
        _written[:] = [(s, p) for s, p in _written if p != path]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _discard_all() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            return
