"""What to test next: how winners among similar cases differ from a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import cases_of

MOST_TESTS = 5
LEAST_SHARE, LEAST_DELTA = 0.35, 0.35
ENOUGH, POOL = 3, 20  # winners that suffice, and those of a fallback pool
#: Suggestions where there is nothing to compare with or no difference, and how an action begins its text.
NO_WINNERS = "test a clearer hook with a fresh visual angle"
NO_DIFFERENCE = "keep the strongest pattern but refresh hook, CTA, or layout"
GATHER = "Keep collecting data before deciding; test a small variant if budget allows."
OPENINGS = {
    "Scale": ("Scale the creative while testing a controlled variant: ", 2),
    "Refresh": ("Refresh the creative: ", 3),
    "Pause or rebuild": ("Rebuild the concept before scaling: ", 3),
    "Keep": ("Keep running, and queue a controlled test: ", 2),
    "Test next variation": ("Test next variation: ", 3),
}


def fallback_pools(ranking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pool of each vertical and format: kind, key, winner ids; the pools' members).

    Top performers of the vertical if there are three, of these those of the format if there
    are three, and of them the ``POOL`` with the best scores (none last, ties to the lesser id).
    """
    top = ranking.where(F.col("status") == "top_performer").select("case_id", "vertical", "format", "best_score")
    keys = {"both": F.to_json(F.struct("vertical", "format"), {"ignoreNullFields": "false"}), "vertical": F.to_json(F.struct("vertical"), {"ignoreNullFields": "false"}), "format": F.to_json(F.struct("format"), {"ignoreNullFields": "false"}), "any": F.lit("any")}
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in keys.items()]))
    long = top.withColumn("k", kinds).select("case_id", "best_score", "k.*")
    # the first of each of many parts of a key, then of the key: no key's rows meet in one task
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc_nulls_last("best_score"), F.asc("case_id"))
    long = long.withColumn("part", F.pmod(F.xxhash64("case_id"), F.lit(256)))
    first = long.withColumn("place", F.row_number().over(order("kind", "key", "part"))).where(F.col("place") <= POOL)
    members = first.withColumn("place", F.row_number().over(order("kind", "key"))).where(F.col("place") <= POOL).select("kind", "key", F.col("case_id").alias("winner_id"))
    counts = long.groupBy("kind", "key").agg(F.count("*").alias("n"))
    contexts = ranking.select("vertical", "format").distinct().withColumns({f"key_{k}": v for k, v in keys.items()})
    for k in ("both", "vertical", "format"):
        contexts = contexts.join(counts.where(F.col("kind") == k).select(F.col("key").alias(f"key_{k}"), F.col("n").alias(f"n_{k}")), f"key_{k}", "left")
    enough = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0)) >= ENOUGH
    kind = F.when(enough("vertical"), F.when(enough("both"), "both").otherwise("vertical")).otherwise(F.when(enough("format"), "format").otherwise("any"))
    key = F.when(kind == "both", F.col("key_both")).when(kind == "vertical", F.col("key_vertical")).when(kind == "format", F.col("key_format")).otherwise(F.col("key_any"))
    return contexts.select("vertical", "format", kind.alias("kind"), key.alias("key")), members


def winner_facts(winners: DataFrame, by: tuple[str, ...], traits: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """For each group of few winners (w_ columns): their number, each trait's mode (ties to the lesser) with its share, each number's median."""
    out = winners.groupBy(*by).agg(
        F.count("*").alias("winners"),
        *[F.mode(f"w_{c}", True).alias(f"mode_{c}") for c in traits],
        *[F.collect_list(f"w_{c}").alias(f"all_{c}") for c in traits],
        *[F.median(f"w_{c}").alias(f"median_{c}") for c in numbers],
    )
    for c in traits:
        out = out.withColumn(f"share_{c}", F.expr(f"size(filter(all_{c}, x -> x = mode_{c}))") / F.col("winners")).drop(f"all_{c}")
    return out


def suggestions(traits: tuple[str, ...], numbers: dict[str, str]) -> Column:
    """Over a case with its winners' facts and deviations (std_): traits in order, then numbers (column -> label), the first ``MOST_TESTS``."""
    tests = [F.when((F.col(f"share_{c}") >= LEAST_SHARE) & (F.col(f"mode_{c}").cast("string") != F.coalesce(F.col(c).cast("string"), F.lit("nan"))), F.concat(F.lit(f"test {c}='"), F.col(f"mode_{c}").cast("string"), F.lit("'"))) for c in traits]
    for c, label in numbers.items():
        delta = F.col(f"median_{c}") - F.col(c)
        tests.append(F.when((F.col(f"std_{c}") > 0) & (F.abs(delta) >= LEAST_DELTA * F.col(f"std_{c}")), F.concat(F.when(delta > 0, "increase").otherwise("reduce"), F.lit(f" {label}"))))
    chosen = F.slice(F.array_compact(F.array(*tests)), 1, MOST_TESTS)
    return F.when(F.coalesce("winners", F.lit(0)) == 0, F.array(F.lit(NO_WINNERS))).when(F.size(chosen) == 0, F.array(F.lit(NO_DIFFERENCE))).otherwise(chosen)


def action() -> Column:
    """What to do with a case, by its segment, health and score."""
    segment = F.col("segment")
    worn = (F.col("fatigue_status") == "tired") | (F.col("repetition_status") == "high_repetition")
    return cases_of((segment == "low_evidence", "Gather evidence"), (worn, "Refresh"), (segment == "top_winner", "Scale"), (segment == "strong_candidate", "Keep"), (F.col("best_score") < 0.35, "Pause or rebuild"), otherwise="Test next variation")


def composed(doing: Column, tests: Column) -> Column:
    """One text of an action and its first suggestions."""
    out = F.when(doing == "Gather evidence", F.lit(GATHER))
    for name, (opening, n) in OPENINGS.items():
        out = out.when(doing == name, F.concat(F.lit(opening), F.array_join(F.slice(tests, 1, n), "; ")))
    return out


def priority() -> Column:
    """0 to 1: winners by their risk, others also by what they lack."""
    lacking = F.coalesce(1 - F.col("best_score"), F.lit(0.5))
    score = F.when(F.col("segment").isin("top_winner", "strong_candidate"), 0.40 + 0.60 * F.col("risk")).otherwise(0.60 * lacking + 0.40 * F.col("risk"))
    return F.round(score + 1e-9, 4)  # halves go up, however they are stored


def evidence(columns: tuple[str, ...]) -> Column:
    """The named columns as one JSON text, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
