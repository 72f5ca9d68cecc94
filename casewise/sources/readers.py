"""Readers and writers by file kind; paths may be in any store that Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc"}


def _kind(path: str) -> str:
    for suffix, kind in KINDS.items():
        if path.rstrip("/").endswith(suffix):
            return kind
    raise ValueError(f"no reader for {path}: expected one of {', '.join(KINDS)}")


def read_table(spark: SparkSession, path: str, schema: str | None = None, clean: bool = True, **options) -> DataFrame:
    """A table by its suffix. CSV has a header; blank JSON lines are skipped; ``clean`` turns NaN and infinities to null and trims strings."""
    kind = _kind(path)
    reader = spark.read.options(**({"header": True} if kind == "csv" else {}) | options)
    if schema:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", True)
    df = reader.format(kind).load(path)
    return cleaned(df) if clean else df


def read_first(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """The first of the paths that exists, such as a Parquet table, its CSV sibling and a default folder's."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            return read_table(spark, path, **options)
    raise FileNotFoundError(" or ".join(paths))


def cleaned(df: DataFrame) -> DataFrame:
    """Strings trimmed; NaN and infinities null."""
    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind == "string":
            return F.trim(c).alias(name)
        if kind in ("double", "float"):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)
        return c

    return df.select(*[one(n, k) for n, k in df.dtypes])


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """A table by its suffix; CSV gets a header and nested values as JSON text, JSON keeps nulls."""
    kind = _kind(path)
    if kind == "csv":
        df = flat(df)
    writer = df.write.mode(mode).options(**({"header": True} if kind == "csv" else {"ignoreNullFields": False} if kind == "json" else {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    return df.select(*[F.to_json(F.col(f"`{n}`")).alias(n) if k.startswith(("array", "map", "struct")) else F.col(f"`{n}`") for n, k in df.dtypes])


def convert(spark: SparkSession, source: str, target: str, **options) -> None:
    """One kind of file to another."""
    write_table(read_table(spark, source, clean=False, **options), target)


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, content, kind, width, height, status) of image files; sizes come from PNG headers, by SQL functions."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    head = F.hex(F.substring("content", 1, 24))
    is_png = head.startswith("89504E470D0A1A0A")
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("int")
    kind = F.when(is_png, "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("5035") | head.startswith("5036"), "pnm")
    status = F.when(F.col("length") == 0, "missing").when(kind.isNull(), "corrupt").otherwise("ok")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content", kind.alias("kind"), F.when(is_png, number(33)).alias("width"), F.when(is_png, number(41)).alias("height"), status.alias("status"))


def feature_sets(text: str, name: str) -> list[str]:
    """Columns of a named feature set in a JSON catalog; KeyError for an unknown name."""
    return list(json.loads(text)[name])


def write_marts(tables: dict[str, DataFrame], folder: str, sort_by: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """Each table under its name, sorted within files by its lookup columns so that scans skip row groups."""
    out = {}
    for name, df in tables.items():
        by = (sort_by or {}).get(name)
        out[name] = f"{folder.rstrip('/')}/{name}.parquet"
        write_table(df.sortWithinPartitions(*by) if by else df, out[name])
    return out
