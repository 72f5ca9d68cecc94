"""Tables written between passes, in the folder that the whole cluster shares.

Lineage is cut with Parquet tables below ``spark.checkpoint.dir``: they outlive any
executor, and unlike shuffle files they are compact and can be dropped when read.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one is set where none is named and all runs in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="casewise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """A private folder below the shared one; ``table`` writes a frame there and reads it again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made}-{name}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        to = self.path(name)
        df.write.parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._scratch_path = to
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads, and let Spark clean the shuffles behind them."""
        jvm = self.spark._jvm
        for t in tables:
            at = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.free()

    def free(self) -> None:
        """Shuffle files go when the driver's JVM has collected what refers to them."""
        gc.collect()
        self.spark._jvm.System.gc()
