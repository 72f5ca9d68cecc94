"""Tables between passes (see ``casewise.sources.scratch``), and rows carried through Python whole."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "fed", "part_of", "shared_dir", "small_batches", "with_record"]

BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows in an Arrow batch from now on in this session: Spark's 10,000 whole texts take more of a worker than its work does."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def fed(df: DataFrame, whole: bool, **columns: Column) -> DataFrame:
    """What goes to Python: the columns or, with ``whole``, the row as the struct ``record`` (its texts go once)."""
    if whole:
        return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"))
    return df.select(*[c.alias(name) for name, c in columns.items()])


def part_of(batch, name: str, column: str):
    """A column of a batch, from its record (there named ``column``) if it has one."""
    return batch.column("record").field(column) if "record" in batch.schema.names else batch.column(name)


def with_record(schema: str, source: DataFrame) -> StructType:
    """A schema; for rows with a record that in place of doc_id."""
    out = StructType.fromDDL(schema)
    if "record" not in source.columns:
        return out
    return StructType([source.schema["record"], *[f for f in out if f.name not in ("doc_id", "id", "text")]])
