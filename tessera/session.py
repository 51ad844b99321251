"""Session construction and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a user would pass on a cluster too: AQE re-plans joins and
# aggregates from runtime statistics (skew-join splitting, broadcast of sides
# measured below the threshold, partition coalescing).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # RDD checkpoint files go with their RDDs; scratch tables go with the application
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "tessera",
                shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is only read.  When
    it is unset (local tests) a private folder is registered with the
    context (the setting itself is not modified at runtime).
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder inside the shared checkpoint folder (never
    machine-local on a cluster).  Each call gets a new unique leaf, which is
    removed when the application ends, or earlier by ``drop_scratch``."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tessera/{name}/{uuid.uuid4().hex}"
    fs, leaf = _hadoop(spark, path)
    fs.deleteOnExit(leaf)
    return path


def _hadoop(spark: SparkSession, path: str):
    leaf = spark._jvm.org.apache.hadoop.fs.Path(path)
    return leaf.getFileSystem(spark._jsc.hadoopConfiguration()), leaf


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that no later read needs."""
    for path in paths:
        fs, leaf = _hadoop(spark, path)
        fs.delete(leaf, True)


def table(spark: SparkSession, sf_dir: str, name: str):
    """Read one driver table; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back: cuts lineage (survives executor loss) and lets later
    passes read only the columns they need.  Use before multi-pass
    operators over an expensive upstream (e.g. the global index over
    chunks, whose range sampling would otherwise recompute tokenisation)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
