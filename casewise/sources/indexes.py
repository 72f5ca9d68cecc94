"""A retrieval index in a folder: vectors, blocks and attributes of cases as Parquet, and a manifest.

The folder may be anywhere that Spark writes. A new row is asked with the fitted statistics
that were saved with the index, so it meets vectors of the same making.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_index(cases: DataFrame, path: str, weights: dict[str, float], mode: str = "prelaunch") -> dict:
    """Write cases (id, vector, blocks, attributes) and a manifest; the manifest is returned."""
    cases.write.mode("overwrite").parquet(f"{path}/cases")
    rows = cases.sparkSession.read.parquet(f"{path}/cases").agg(F.count("*"), F.max(F.size("vector"))).first()
    manifest = {"cases": rows[0], "width": rows[1], "weights": weights, "mode": mode, "columns": cases.columns}
    cases.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(cases, manifest) of a saved index."""
    return spark.read.parquet(f"{path}/cases"), json.loads(spark.read.text(f"{path}/manifest").first()[0])
