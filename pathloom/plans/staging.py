"""Written intermediates that survive a lost executor.

Iterative plans must cut their lineage.  They do it by writing a Parquet table under the
folder that ``spark.checkpoint.dir`` names: every executor of the cluster shares it, so a
lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


#: Where the tables of this driver stand.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Those that the catalogue names.
_names: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder; one of our own only where the setting is absent and all tasks run on this machine."""
    root = spark.conf.get(SETTING, None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, which ends its lineage there.

    The table stays until ``discard``, at the latest until the driver's JVM stops.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/pathloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, folder = _folder(spark, path)
    files.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage_by(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """As ``stage``, in buckets by ``keys``: joins and groupings by all these keys read the table without shuffling it."""
    spark = df.sparkSession
    name = f"pathloom_{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_root(spark)}/{name}"
    df.write.option("path", path).bucketBy(buckets(spark), *keys).saveAsTable(name)
    files, folder = _folder(spark, path)
    files.deleteOnExit(folder)
    out = spark.table(name)
    _places[out] = path
    _names[out] = name
    return out


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stage`` wrote, once nothing will read them again; others stay."""
    for df in tables:
        if path := _places.pop(df, None):
            files, folder = _folder(df.sparkSession, path)
            files.delete(folder, True)
            if name := _names.pop(df, None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
