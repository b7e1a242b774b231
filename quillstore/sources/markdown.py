"""A folder of markdown files as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FILES = T.StructType([T.StructField("slug", T.StringType()), T.StructField("path", T.StringType()), T.StructField("mtime_us", T.LongType()), T.StructField("body", T.StringType())])


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """slug, path, mtime_us, body of every file under `root`, at any depth, whose extension is exactly `md` or `markdown`.

    The slug is the path below the root without the extension. Bytes that aren't UTF-8 are replaced. A missing root
    gives an empty table.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        return spark.createDataFrame([], _FILES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown}").load(root)
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + _quoted(system.makeQualified(place).toUri().getPath()) + "/*", "")
    return files.select(F.regexp_replace(below, r"\.(md|markdown)\z", "").alias("slug"), "path", F.unix_micros("modificationTime").alias("mtime_us"), F.make_valid_utf8(F.col("content").cast("string")).alias("body"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "/" else "\\" + c for c in text)
