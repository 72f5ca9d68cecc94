"""Audits of the driver's tables."""

from pyspark.sql import functions as F

from ..operators import profile as O
from . import query, read

PART = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")]


def _audit(column: str, kind: str) -> str:
    return f"""SELECT '{column}' AS column_name, '{kind}' AS data_type, count(*) AS row_count, count(*) - count({column}) AS nulls, count(DISTINCT {column}) AS distinct_values,
      round((count(*) - count({column}))::DOUBLE / nullif(count(*), 0), 6) AS null_share, round(count(DISTINCT {column})::DOUBLE / nullif(count(*), 0), 6) AS unique_share,
      count(DISTINCT {column}) <= 1 AS is_constant, coalesce((count(*) - count({column}))::DOUBLE / nullif(count(*), 0) > 0.8, false) AS high_missing FROM part"""


@query(" UNION ALL ".join(_audit(*c) for c in PART))
def column_audit(spark, sf_dir):
    return O.column_audit(read(spark, sf_dir, "part").select(*[c for c, _ in PART]))


@query("SELECT 'labels' AS table_name, count(*) AS row_count, 3::BIGINT AS column_count, count(*) * 3 - count(doc_id) - count(quality) - count(toxic) AS null_cells, round((count(*) * 3 - count(doc_id) - count(quality) - count(toxic))::DOUBLE / nullif(count(*) * 3, 0), 6) AS null_share, count(*) - (SELECT count(*) FROM (SELECT DISTINCT doc_id, quality, toxic FROM labels)) AS duplicate_rows FROM labels")
def table_profile(spark, sf_dir):
    return O.table_profile(read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "labels")


@query("SELECT 'l_quantity' AS kept, 'copy' AS duplicate")
def duplicate_columns(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("copy", F.col("l_quantity")).withColumn("row", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return spark.createDataFrame(O.duplicate_columns(li.select("row", "l_quantity", "l_extendedprice", "copy"), "row"), "kept string, duplicate string")


def _spearman(a: str, b: str, table: str, by: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE"
    return f"SELECT segment, '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(x, y), 6) AS spearman FROM (SELECT {by} AS segment, {rank(a)} AS x, {rank(b)} AS y FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) GROUP BY segment HAVING count(*) >= 10"


PAIRS = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]


@query(" UNION ALL ".join(_spearman(a, b, "lineitem", "l_returnflag") for a, b in PAIRS))
def segment_correlations(spark, sf_dir):
    return O.correlations(read(spark, sf_dir, "lineitem"), PAIRS, "l_returnflag")


@query(" UNION ALL ".join(_spearman(a, b, "(SELECT *, 'all' AS one FROM part)", "one") for a, b in O.all_pairs(["p_size", "p_retailprice", "p_partkey"])))
def spearman_pairs(spark, sf_dir):
    return O.correlations(read(spark, sf_dir, "part"), O.all_pairs(["p_size", "p_retailprice", "p_partkey"]))


@query("""WITH j AS (SELECT coalesce(c.c_custkey, s.c_custkey) AS id, c.c_nationkey AS a, s.c_nationkey AS b, c.c_acctbal AS x, s.c_acctbal AS y FROM customer c FULL JOIN (SELECT s_suppkey AS c_custkey, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal FROM supplier) s ON c.c_custkey = s.c_custkey),
l AS (SELECT id, 'c_nationkey' AS column_name, NOT coalesce(abs(a - b) <= 1e-8 + 1e-8 * abs(b), a IS NULL AND b IS NULL) AS differs FROM j UNION ALL SELECT id, 'c_acctbal', NOT coalesce(abs(x - y) <= 1e-8 + 1e-8 * abs(y), x IS NULL AND y IS NULL) FROM j)
SELECT column_name, count(*) AS compared, count(*) FILTER (differs) AS mismatches, CAST((list(id ORDER BY id) FILTER (differs))[1:5] AS VARCHAR) AS examples FROM l GROUP BY column_name""")
def overlap_compare(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    out = O.compare_overlap(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), supplier, "c_custkey")
    return out.withColumn("examples", F.col("examples").cast("string"))


@query("SELECT round(max(((toxic IS NULL)::INT + (d.doc_id IS NULL)::INT + (quality IS NULL)::INT) / 3.0::DOUBLE), 6) AS max_row_null_share, CAST((count(*) - count(toxic) > 0.8 * count(*))::INT + (count(*) - count(quality) > 0.8 * count(*))::INT + (count(*) - count(d.doc_id) > 0.8 * count(*))::INT AS BIGINT) AS columns_over FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def missingness(spark, sf_dir):
    both = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return O.missingness(both.select("doc_id", "toxic", "quality"))


@query("SELECT size, count(*) AS groups FROM (SELECT conv_id, count(*) AS size FROM conversations GROUP BY conv_id) GROUP BY size")
def group_sizes(spark, sf_dir):
    return O.group_sizes(read(spark, sf_dir, "conversations"), ("conv_id",))


@query("SELECT count(*) AS line_count, count(*) FILTER (o_orderdate IS NOT NULL AND l_shipdate >= o_orderdate) AS in_range, count(*) FILTER (o_orderdate IS NULL) AS without_order, count(*) FILTER (l_shipdate < o_orderdate) AS too_early FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def temporal_check(spark, sf_dir):
    both = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    early = F.col("l_shipdate") < F.col("o_orderdate")
    return both.agg(F.count("*").alias("line_count"), F.count(F.when(~early, 1)).alias("in_range"), F.count(F.when(F.col("o_orderdate").isNull(), 1)).alias("without_order"), F.count(F.when(early, 1)).alias("too_early"))
