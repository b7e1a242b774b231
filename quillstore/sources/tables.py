"""Reading the store's tables and writing intermediate tables that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Intermediate tables of this session.
_WRITTEN: list[str] = []
#: The temporary folder of a local session without a shared one.
_LOCAL: dict[str, str] = {}


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table `name` under the folder `base`."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a new temporary one of this machine, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        session = spark.conf.get("spark.app.id", "")
        if session not in _LOCAL:
            _LOCAL[session] = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        folder = _LOCAL[session]
    return folder.rstrip("/")


def clear_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this session, once nothing that was read from them is needed any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in _WRITTEN:
        place = hadoop(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.clear()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts the lineage and lets several consumers share the work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillstore-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
