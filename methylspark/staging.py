"""Tables that are written to the folder which driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_tables: dict[str, list[str]] = {}
_written: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only where that is unset and all work is in this process (local mode, as in tests) a
    temporary folder is used, one per application; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="methylspark-")
    return _own[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; ``clear`` deletes it."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: whatever reads the result twice reads the same rows, and a
    lost executor costs no recomputation of what lies before.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Like ``staged``, dealt out by a hash of ``keys`` into as many buckets as there are shuffle partitions.

    Tables of the same keys and number of buckets are joined and grouped by them without an exchange: one
    shuffle, when they are written, serves all. It is a table of the catalogue until ``clear``.
    """
    spark = df.sparkSession
    path, n = scratch_path(spark, label), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("compression", "zstd").option("path", path).saveAsTable(name, format="parquet")
    _tables.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # PySpark has no call for this
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unstage(*dfs: DataFrame) -> None:
    """Delete tables that ``staged`` wrote and that no result still reads."""
    for df in dfs:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has staged. Call it once results are written: until then they read it."""
    for name in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
