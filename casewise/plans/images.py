"""Embeddings read as grey images of eight by eight."""

from pyspark.sql import functions as F

from ..operators import images as I
from . import query, read

PIXELS = "p AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), q AS (SELECT *, i % 8 AS x, i // 8 AS y FROM p)"


@query(f"""WITH {PIXELS}, n AS (SELECT a.vec_id, avg(abs(a.v - b.v)) AS edge FROM q a JOIN q b ON a.vec_id = b.vec_id AND b.i = a.i - 1 AND a.x > 0 GROUP BY a.vec_id),
m AS (SELECT a.vec_id, avg(abs(a.v - b.v)) AS gap FROM q a JOIN q b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = 7 - a.x GROUP BY a.vec_id)
SELECT vec_id, round(avg(v), 6) AS brightness, round(stddev_pop(v), 6) AS contrast, round(any_value(edge), 6) AS edges, round(1 - any_value(gap) / (2 * avg(abs(v))), 6) AS symmetry,
  round(avg(v) FILTER (y < 4), 6) AS upper_half, round(avg(v) FILTER (x >= 4 AND y >= 4), 6) AS last_quarter, round(sum(abs(v) * x) / sum(abs(v)) / 7, 6) AS center_x
FROM q JOIN n USING (vec_id) JOIN m USING (vec_id) GROUP BY vec_id""")
def visual_statistics(spark, sf_dir):
    e = F.col("embedding")
    values = {"brightness": I.brightness(e), "contrast": I.contrast(e), "edges": I.edge_strength(e, 8), "symmetry": I.symmetry(e, 8), "upper_half": I.region(e, 8, 0, 8, 0, 4), "last_quarter": I.region(e, 8, 4, 8, 4, 8), "center_x": I.centroid(e, 8)[0]}
    return read(spark, sf_dir, "embeddings").select("vec_id", *[F.round(v, 6).alias(k) for k, v in values.items()])


@query(f"""WITH {PIXELS}, h AS (SELECT vec_id, greatest(0, least(7, floor((v + 0.4) / 0.1))) AS bin, count(*) AS n FROM q GROUP BY ALL)
SELECT vec_id, round(-sum(n / 64 * log2(n / 64)), 6) AS entropy FROM h GROUP BY vec_id""")
def image_entropy(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(I.entropy(F.col("embedding"), 8, -0.4, 0.4), 6).alias("entropy"))
