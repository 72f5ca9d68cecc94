"""Operators on small fixtures: ties, nulls, zeros, empty tables, contracts."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise import catalog
from casewise.functions import expr
from casewise.operators import blocks, facts, fetch, geometry, health, knn, nexttest, order, profile, ranking, retrieval, serving, texts
from casewise.sources import readers, scratch
from casewise.sources.scratch import Scratch
from casewise.streaming import rollup

CASES = "case_id long, vertical string, format string, status string, spend double, impressions double, perf_score double, roas double, ipm double, cvr double, ctr double"


def cases(spark, n=20):
    rows = [(i, "gf"[i % 2], "vb"[i % 3 == 0], ["top_performer", "fatigued", "stable"][i % 3], float(i), float(i * 10), (i % 7) / 7, None if i == 3 else i / n, float(i % 5), 0.5, float("nan") if i == 4 else i / 100) for i in range(n)]
    return spark.createDataFrame(rows, CASES).withColumn("ctr", expr.finite(F.col("ctr")))


def test_safe_div_and_clip(spark):
    r = spark.range(1).select(expr.safe_div(F.lit(1), F.lit(0)).alias("a"), expr.clip(F.lit(3.0), 0, 1).alias("b"), expr.clip(F.lit(None).cast("double"), 0, 1).alias("c"), expr.normalize_text(F.lit(" Él  ÑU ")).alias("d")).first()
    assert tuple(r) == (None, 1.0, None, "el nu")


def test_flags(spark):
    df = spark.createDataFrame([("yes",), ("0",), ("2",), (None,), ("no",), (" TRUE ",)], "x string")
    assert [r[0] for r in df.select(expr.flag(F.col("x"))).collect()] == [True, False, True, False, False, True]


def test_percent_rank_is_average_over_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "id int, x double")
    out = {r.id: (r.p, r.d, r.n) for r in order.with_ranks(df, order.Rank("x", (), "p", "d", "n")).collect()}
    assert out == {1: (2.5 / 3, 1, 3), 2: (2.5 / 3, 1, 3), 3: (1 / 3, 3, 3), 4: (None, None, None)}


def test_quantile_matches_numpy(spark):
    x = np.random.default_rng(1).normal(size=2001)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for p in (0, 0.25, 0.9, 0.95, 1):
        assert order.quantile(df, "x", p) == pytest.approx(np.quantile(x, p))
    assert order.quantile(df.limit(0), "x", 0.5) is None


def test_narrowed_quantiles_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(order, "FEW", 40)  # so that brackets are narrowed several times
    monkeypatch.setattr(order, "ACCURACY", 20)
    draw = np.random.default_rng(5)
    a, b = draw.normal(size=4000), np.repeat([1.0, 2.0, 2.0, 7.0], 1000)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)] + [(None, None, None)], "a double, b double, c double").repartition(5)
    wanted = {"a1": ("a", 0.0), "a2": ("a", 0.25), "a3": ("a", 0.9), "a4": ("a", 1.0), "b1": ("b", 0.25), "b2": ("b", 0.8), "c1": ("c", 0.5)}
    got = order.column_quantiles(df, wanted)
    values = {"a": a, "b": b}
    assert got == {n: None if c == "c" else pytest.approx(np.quantile(values[c], p), abs=1e-12) for n, (c, p) in wanted.items()}


def test_random_pairs_are_about_as_many_as_asked(spark):
    df = spark.range(3000)
    for n in (500, 6000):
        rows = [tuple(r) for r in knn.random_pairs(df, n).collect()]
        assert 0.7 * n < len(rows) < 1.3 * n and len(set(rows)) == len(rows) and all(a != b for a, b in rows)
        assert rows and sorted(rows) == sorted(tuple(r) for r in knn.random_pairs(df.repartition(7), n).collect())


def test_neighbours_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAST_ROWS", 8)
    monkeypatch.setattr(knn, "QUERY_ROWS", 16)
    draw = np.random.default_rng(6)
    x = draw.normal(size=(90, 5))
    x[7] = x[40] = x[41]
    rows = [(i, None if i == 3 else x[i].tolist(), "g" if i % 3 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, kind string").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)

    def wanted(same):
        out = {}
        for i in range(90):
            others = [j for j in range(90) if j not in (i, 3) and (not same or (i % 3 > 0) == (j % 3 > 0))]
            out[i] = sorted(others, key=lambda j: (-sims[i, j], j))[:4]
        del out[3]
        return out

    for group in (None, "kind"):
        got = {}
        for r in knn.nearest(df, df, 4, group_col=group).orderBy("query_id", "neighbor").collect():
            got.setdefault(r.query_id, []).append(r.case_id)
        assert got == wanted(group is not None)
    assert knn.nearest(df.limit(0), df, 4).count() == 0 == knn.nearest(df, df.limit(0), 4).count()


def test_winner_ranking_without_evidence(spark):
    out = {r.case_id: r for r in ranking.winner_ranking(cases(spark)).collect()}
    assert out[0].segment == "low_evidence" and out[0].best_score is None and out[0].hint == "Gather more data"
    assert sum(r.segment in ("top_winner", "strong_but_fatigued", "strong_candidate") for r in out.values()) >= 1
    assert ranking.winner_ranking(cases(spark).limit(0)).count() == 0


def test_health_is_null_safe(spark):
    df = spark.createDataFrame([(1, "fatigued", True, -0.5, None, 3), (2, "stable", False, 0.1, 0.0, None)], "case_id int, status string, has_fatigue boolean, ctr_decay double, cvr_decay double, fatigue_day int")
    out = {r.case_id: r.tired_score for r in health.tired_scores(df).collect()}
    assert out[2] == 0 and out[1] > 0.5


def test_next_test_without_winners(spark):
    df = cases(spark).withColumns({"risk": F.lit(0.1), "fatigue_status": F.lit("healthy"), "repetition_status": F.lit("distinct"), "best_score": F.lit(0.2), "segment": F.lit("not_top"), "winners": F.lit(0)})
    df = df.withColumns({"mode_format": F.lit(None).cast("string"), "share_format": F.lit(None).cast("double"), "median_spend": F.lit(None).cast("double"), "std_spend": F.lit(1.0)})
    out = df.select(nexttest.suggestions(("format",), {"spend": "spend"}).alias("tests"), nexttest.action().alias("a"), nexttest.priority().alias("p"))
    out = out.select(nexttest.composed(F.col("a"), F.col("tests")), "a", "p").distinct().collect()
    assert [tuple(r) for r in out] == [("Rebuild the concept before scaling: test a clearer hook with a fresh visual angle", "Pause or rebuild", 0.52)]


def test_fallback_pool_narrows_while_three_are_left(spark):
    rows = [(i, "game", "video" if i < 3 else "image", 0.1 * i) for i in range(5)] + [(10, "shop", "video", 0.9), (11, "shop", "image", None)]
    ranking = spark.createDataFrame([(*r, "top_performer") for r in rows] + [(20, "game", "banner", 0.5, "stable"), (21, "none", "video", 0.5, "stable"), (22, "none", None, 0.5, "stable")], "case_id int, vertical string, format string, best_score double, status string")
    contexts, members = nexttest.fallback_pools(ranking)
    pools = contexts.join(members, ["kind", "key"]).groupBy("vertical", "format").agg(F.sort_array(F.collect_list("winner_id")).alias("w"))
    got = {(r.vertical, r.format): r.w for r in pools.collect()}
    assert got["game", "video"] == [0, 1, 2] and got["game", "image"] == [0, 1, 2, 3, 4] == got["game", "banner"]
    assert got["shop", "video"] == [0, 1, 2, 10] == got["none", "video"] and got["none", None] == [0, 1, 2, 3, 4, 10, 11]


def test_reuse_takes_plain_shares_and_the_plain_mean(spark):
    rows = [(1, i, 0.9 - 0.1 * i, 0.5, f, p, s, None, 1.0, None, None) for i, (f, p, s) in enumerate([(0.8, 1.0, "top_performer"), (0.2, 3.0, "fatigue"), (-0.5, None, "fatigued"), (0.0, 2.0, "stable")])]
    rows.append((2, 0, 0.5, None, 0.5, None, "stable", None, None, None, None))
    df = spark.createDataFrame(rows, "query_id int, case_id int, similarity double, agreement double, final_score double, c_perf double, c_status string, c_roas double, c_ipm double, c_ctr double, c_cvr double")
    a, b = retrieval.reuse_summary(df).orderBy("query_id").collect()
    assert (a.top_ratio, a.fatigued_ratio, a.stable_ratio, a.median_perf, a.weighted_perf) == (0.25, 0.5, 0.25, 2.0, 1.4)
    spread = (2 / 3) ** 0.5  # of 1, 3 and 2
    assert a.confidence == pytest.approx(0.35 * 0.4 + 0.35 * 0.75 + 0.25 * 0.5 - spread / (2 + 1e-6) * 0.1, abs=1e-6)
    assert b.confidence == pytest.approx(0.35 * 0.1 + 0.35 * 0.5 + 0.25 * 0.5 - 0.1, abs=1e-6) and b.weighted_perf is None
    action = retrieval.reuse_summary(df).withColumns({"neighbors": F.lit(5), "confidence": F.lit(0.6), "top_ratio": F.lit(0.6), "fatigued_ratio": F.lit(0.1), "weighted_perf": F.lit(None).cast("double")})
    assert action.select(retrieval.recommended_action()).first()[0] == "SCALE"  # an unknown outcome counts as 0


def test_prediction_fills_unknown_outcomes_and_ndcg_takes_equal_labels(spark):
    rows = [(1, 7, 1, 0.6, 1.0, "a", "a", True, None, 5.0), (1, 8, 2, 0.3, None, "a", "b", None, None, 5.0), (1, 9, 3, 0.1, 3.0, "a", "a", None, True, 5.0)]
    df = spark.createDataFrame(rows, "query_id int, case_id int, place int, final_score double, c_perf double, q_status string, c_status string, c_tired boolean, q_tired boolean, q_perf double")
    r = retrieval.query_metrics(df).first()
    assert r.predicted == pytest.approx(0.6 + 0.3 * 2 + 0.1 * 3) and r.label_consistency == pytest.approx(2 / 3, abs=1e-6) and r.fatigue_consistency == pytest.approx(1 / 3, abs=1e-6)
    assert r.ndcg == pytest.approx((1 + 0.5) / (1 + 1 / np.log2(3)), abs=1e-6) and r.hit_top_performer == 0 and r.actual == 5


def test_weights_sum_to_one_and_candidates_follow_them(spark):
    from casewise.plans import retrieval as plan

    assert all(sum(w.values()) == pytest.approx(1, abs=2e-6) for w in plan.trial_weights())
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0])], "a array<double>, b array<double>")
    got = df.select(retrieval.weighted_vector([(F.col("a"), 0.64), (F.col("b"), 0.36)])).first()[0]
    assert got == pytest.approx([0.48, 0.64, 0.0, 0.6])


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    with pytest.raises(facts.ContractError):
        facts.assert_unique(df, ("k",))
    with pytest.raises(facts.ContractError):
        facts.assert_foreign_key(df, spark.createDataFrame([(2,)], "r int"), "k", "r")
    assert tuple(facts.unique_key_report(df, ("k",), "t").first()) == ("t", 3, 2, 1, 1)


def test_row_and_calendar_frames_differ_over_gaps(spark):
    import datetime as d

    days = spark.createDataFrame([(1, d.date(2024, 1, 1), 5), (1, d.date(2024, 1, 9), 7), (1, d.date(2024, 1, 10), 1)], "user_id int, day date, x int")
    rows = facts.rolling_previous(days, ("x",), (3,)).orderBy("day").collect()
    cal = facts.rolling_previous(days, ("x",), (3,), calendar=True).orderBy("day").collect()
    assert [r.x_prev_3d for r in rows] == [0, 5, 12] and [r.x_cal_3d for r in cal] == [0, 0, 7]


def test_nearest_matches_numpy(spark):
    x = np.random.default_rng(2).normal(size=(60, 8))
    x[7] = 0
    x[9] = x[8]
    df = spark.createDataFrame([(i, [float(v) for v in r], "ab"[i % 2]) for i, r in enumerate(x)], "id long, vector array<double>, g string")
    n = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    s = np.round(n @ n.T, 12)
    np.fill_diagonal(s, -9)
    got = {}
    for r in knn.nearest(df, df, 4).collect():
        got.setdefault(r.query_id, []).append((r.neighbor, r.case_id))
    for q in range(60):
        assert [c for _, c in sorted(got[q])] == np.lexsort((np.arange(60), -s[q]))[:4].tolist()
    assert all(r.query_id % 2 == r.case_id % 2 for r in knn.nearest(df, df, 3, group_col="g").collect())
    assert knn.nearest(df.limit(0), df, 3).count() == 0 and knn.nearest(df, df.limit(0), 3).count() == 0


def test_relaxation_drops_all_filters(spark):
    df = spark.createDataFrame([(1, 2, 0.9, "a", "b"), (1, 3, 0.8, "a", "b"), (1, 4, 0.7, "a", "a")], "query_id int, case_id int, similarity double, q_format string, c_format string")
    out = retrieval.filtered(df, retrieval.passes(same=("format",)), 3).collect()
    assert {r.case_id for r in out} == {2, 3, 4} and all(r.relaxed for r in out)
    strict = retrieval.filtered(df, retrieval.passes(same=("format",)), 3, relax=False).collect()
    assert [r.case_id for r in strict] == [4] and not strict[0].relaxed


def test_agreement(spark):
    r = spark.range(1).select(expr.agreement(F.array(F.lit(0.5), F.lit(1.0)))).first()[0]
    assert r == pytest.approx(0.75 * (1 - 0.25))


def test_duplicate_columns_and_greedy_drop(spark):
    df = spark.createDataFrame([(1, 2, 2, 3, None), (2, 5, 5, 5, None)], "k int, a int, b int, c int, d int")
    assert profile.duplicate_columns(df, "k") == [("a", "b")]
    assert profile.greedy_drop([("a", "b", 0.99), ("b", "c", 0.995), ("a", "c", 0.99)], 0.985) == ["c", "b"]


def test_geometry(spark):
    a, b = F.array(*map(F.lit, (0.0, 0.0, 0.5, 0.5))), F.array(*map(F.lit, (0.25, 0.25, 0.75, 0.75)))
    r = spark.range(1).select(geometry.iou(a, b).alias("i"), geometry.iou(F.array(*[F.lit(0.0)] * 4), F.array(*[F.lit(0.0)] * 4)).alias("z"), geometry.color_name(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("c"), geometry.color_name(F.lit(0.5), F.lit(0.5), F.lit(0.5)).alias("g"), geometry.vertical_zone(F.lit(0.332)).alias("v"), geometry.vertical_zone(F.lit(0.332), exact=False).alias("w")).first()
    assert r.i == pytest.approx(0.0625 / 0.4375) and tuple(r)[1:] == (0.0, "red", "gray", "top", "middle")


def test_texts(spark):
    r = spark.range(1).select(texts.fuzzy_match(F.lit("Play Now!"), F.lit("play now")).alias("a"), texts.fuzzy_match(F.lit(""), F.lit("x")).alias("b"), texts.token_overlap(F.lit("a b c"), F.lit("b c d e")).alias("c"), texts.inferred_group(F.lit("der die das"), {"en": ("the",), "de": ("der", "die")}).alias("e")).first()
    assert tuple(r) == (True, False, 0.5, "de")


def test_feature_gate_modes_and_filters(spark):
    df = spark.createDataFrame([(1.0, 0.5, None, 2.0, "x", "v")] * 5, "perf_score double, first_3d_ctr double, mostly_null double, clip_0 double, note string, vertical string")
    wanted = ["missing_col", "perf_score", "first_3d_ctr", "vertical", "mostly_null", "note", "clip_0"]
    got = blocks.gate(df, wanted, "prelaunch", ("perf_score",), ("vertical",))
    assert got == dict(zip(wanted, ("absent", "outcome", "forbidden", "metadata", "missing", "text", "kept")))
    assert blocks.gate(df, ["vertical", "first_3d_ctr"], "early_3d", (), ("vertical",), ("vertical",)) == {"vertical": "kept", "first_3d_ctr": "kept"}
    assert blocks.gate(df.limit(0), ["clip_0"], "prelaunch") == {"clip_0": "kept"}
    assert [blocks.mode_of(n, "all") for n in ("early_7d_core", "prelaunch_x", "full")] == ["early_7d", "prelaunch", "all"]
    with pytest.raises(ValueError):
        blocks.require_target(df.columns, "roas")
    assert retrieval.resolved_filters({"same_vertical": True, "min_spend": 5}, True, {"exclude_same_campaign": False, "min_spend": 9}) == {"same_vertical": True, "min_spend": 9, "exclude_same_campaign": False}


def test_unknown_levels_have_no_place(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "new", "x"), (4, "new", "new")], "id int, p string, q string")
    rows = blocks.one_hot(df, blocks.fit_levels(df.where("id < 3"), ["p", "q"]), "id", ["p", "q"]).collect()
    assert {(r.id, r.column_name, r.level, r.weight) for r in rows} == {(1, "p", "a", 0.707107), (1, "q", "x", 0.707107), (2, "p", "__missing__", 0.707107), (2, "q", "y", 0.707107), (3, "q", "x", 1.0)}


def test_saved_index_can_be_read_again(spark, tmp_path):
    from casewise.sources import indexes

    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [1.0, 0.0])], "id long, vector array<double>")
    manifest = indexes.save_index(df, f"file://{tmp_path}/i", {"clip": 0.5, "cnn": 0.5})
    cases, again = indexes.load_index(spark, f"file://{tmp_path}/i")
    assert again == manifest and again["cases"] == 2 and again["width"] == 2 and cases.count() == 2


def test_label_types_by_rule(spark):
    cases = [
        ("Acme Gmes", "acme games", None, None, None, 0.5, "brand_name", 0.92),
        ("games by acme corp now", "acme corp ltd", None, None, None, 0.5, "brand_name", 0.82),
        ("Order today", "zzz", "order today", None, None, 0.5, "cta_button", 0.95),
        ("</s>Flash sale live!", None, None, "flash sale live", None, 0.5, "headline", 0.95),
        ("big words of the season", None, None, None, "words of the season", 0.5, "subheadline", 0.88),
        ("5 stars", None, None, None, None, 0.5, "social_proof", 0.88),
        ("50% more", None, None, None, None, 0.5, "discount_badge", 0.88),
        ("coffee", None, None, None, None, 0.5, "discount_badge", 0.88),
        ("$ 3", None, None, None, None, 0.5, "price_tag", 0.85),
        ("try it", None, None, None, None, 0.5, "cta_button", 0.75),
        ("privacy", None, None, None, None, 0.5, "legal_text", 0.7),
        ("tiny", None, None, None, None, 0.95, "legal_text", 0.7),
        (None, "acme", "x", "y", "z", 0.5, "other", 0.55),
    ]
    df = spark.createDataFrame([c[:6] for c in cases], "t string, brand string, cta string, head string, sub string, y double")
    got = df.select(texts.text_type(*[F.col(c) for c in ("t", "brand", "cta", "head", "sub", "y")], F.lit(0.001)).alias("k")).select("k.*").collect()
    assert [(r.kind, r.confidence) for r in got] == [c[6:] for c in cases]


def test_layouts_by_rule(spark):
    card = lambda x, y, area=0.1, shape="card_portrait": (shape, area, x, y, 4)
    cases = [
        ([card(x, y) for x in (0.2, 0.8) for y in (0.2, 0.7)], "grid_2x2"),
        ([card(x, 0.5) for x in (0.2, 0.5, 0.9)], "carousel_3"),
        ([card(0.2, 0.5), card(0.7, 0.55)], "dual_product"),
        ([card(0.4, 0.4, shape="circle"), card(0.5, 0.55)], "hero_shapes"),
        ([card(0.5, 0.5), card(0.5, 0.9, 0.001, "circle"), card(0.6, 0.9, 0.001, "circle")], "single_product"),
        ([], "minimal"),
        ([card(0.1, 0.1), card(0.1, 0.9)], "multi_product_2"),
    ]
    df = spark.createDataFrame([(e,) for e, _ in cases], "e array<struct<shape:string,area:double,x:double,y:double,vertices:int>>")
    got = df.select(*[c.alias(n) for n, c in geometry.layout_template(F.col("e")).items()]).collect()
    assert [r.layout_template for r in got] == [t for _, t in cases] and got[4].has_pagination_dots and got[1].has_carousel_indicator is False


def test_terms_are_words_and_pairs(spark):
    df = spark.createDataFrame([("The cät sat, a mat",), ("one",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(texts.terms(F.col("t"))).collect()] == [["the", "cat", "sat", "mat", "the cat", "cat sat", "sat mat"], ["one"], [], None]


def test_blocks(spark):
    df = cases(spark)
    assert blocks.leaking_columns("prelaunch", ["first_3d_x", "a"]) == ["first_3d_x"]
    assert blocks.Block(prefixes=("s",), exclude=("sx",)).select(["spend", "sx_a", "b"]) == ["spend"]
    stats = blocks.fit(df, ["spend", "roas"])
    rows = blocks.transform(df, stats, "case_id", ["spend", "roas"]).collect()
    assert all(sum(v * v for v in r.block) == pytest.approx(1) for r in rows)


def test_serving(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "id int, name string")
    rows = serving.page(df, (F.asc("id"),), 2, 3).collect()
    assert [(r.id, r.total) for r in rows] == [(3, 5), (4, 5)]
    assert serving.clamp("x", 1, 5, 2) == 2 and serving.search(df, "3", ("name",), "id").count() == 1


def test_reads_and_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, " a ", float("nan"), [1, 2]), (2, None, 1.0, None)], "id int, s string, x double, l array<int>")
    for kind in ("parquet", "json", "orc", "csv"):
        path = f"{tmp_path}/t.{kind}"
        readers.write_table(df, path)
        schema = {"json": "id int, s string, x double, l array<int>", "csv": "id int, s string, x double, l string"}.get(kind)
        got = readers.read_table(spark, path, schema).orderBy("id").collect()
        assert got[0].s == "a" and got[0].x is None and got[1].x == 1.0
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.txt")


def test_fallbacks_conversion_marts_and_catalogs(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, s string")
    readers.write_table(df, f"{tmp_path}/t.csv")
    readers.convert(spark, f"{tmp_path}/t.csv", f"{tmp_path}/u.parquet")
    assert readers.read_first(spark, f"{tmp_path}/no.parquet", f"{tmp_path}/u.parquet", f"{tmp_path}/t.csv").count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_first(spark, f"{tmp_path}/no.parquet", f"{tmp_path}/no.csv")
    paths = readers.write_marts({"t": df, "u": df}, str(tmp_path / "marts"), {"t": ("id",)})
    assert [r.id for r in spark.read.parquet(paths["t"]).coalesce(1).collect()] and spark.read.parquet(paths["u"]).count() == 2
    assert readers.feature_sets('{"core": ["a", "b"]}', "core") == ["a", "b"]
    with pytest.raises(KeyError):
        readers.feature_sets("{}", "core")


def test_sql_names_of_expressions(spark):
    expr.register_functions(spark)
    r = spark.sql("SELECT cw_safe_div(1, 0) AS a, cw_clip(5, 0, 1) AS b, cw_clip(NULL, 0, 1) AS c, cw_normalize_text('  \u00c9t\u00e9  x ') AS d, cw_dot(array(1D, 2D), array(3D, 4D)) AS e").first()
    assert tuple(r) == (None, 1.0, None, "ete x", 11.0)


def test_weights_categories_zones_and_columns(spark):
    assert retrieval.normalized_weights({"a": 3.0, "b": 1.0, "off": 0.0}) == {"a": 0.75, "b": 0.25}
    boxes = F.array(*[F.array(*map(F.lit, b)) for b in ((0.0, 0.0, 0.2, 0.2), (0.0, 0.4, 0.2, 0.6), (0.1, 0.8, 0.3, 1.0), (0.0, 0.7, 1.0, 0.9))])
    counts = geometry.zone_counts(boxes)
    r = spark.range(1).select(*[c.alias(n) for n, c in counts.items()], geometry.whitespace_balance(F.lit(0.62)).alias("best"), geometry.whitespace_balance(F.lit(1.0)).alias("worst"), blocks.category_similarity([F.lit("a"), F.lit(None), F.lit("x")], [F.lit("a"), F.lit(None), F.lit("y")]).alias("same")).first()
    assert (r.top, r.middle, r.bottom) == (1, 1, 2) and r.best == pytest.approx(1) and r.worst == 0 and r.same == pytest.approx(2 / 3)
    df = spark.createDataFrame([(1.0, None, 2.0, 3.0)] * 3, "clip_0 double, empty double, first_3d_ctr double, roas double")
    assert blocks.allowed_columns(df, "prelaunch", ("roas",)) == ["clip_0"] and blocks.leaking_columns("prelaunch", df.columns) == ["first_3d_ctr"]


def test_image_headers(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"rest")
    (tmp_path / "b.png").write_bytes(b"nothing")
    rows = {r.name: (r.width, r.height, r.status) for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert rows == {"a.png": (640, 480, "ok"), "b.png": (None, None, "corrupt")}


def test_streamed_rollup_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    events.write.parquet(f"{tmp_path}/in")
    stream = rollup.daily_counts(rollup.event_stream(spark, f"{tmp_path}/in", events._jdf.schema().toDDL()))
    rollup.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got and got <= {tuple(r) for r in rollup.daily_counts(events).collect()}


def test_a_cluster_must_name_the_shared_folder():
    from types import SimpleNamespace

    def session(master, named=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,512]", "k8s://host"):
        with pytest.raises(ValueError):
            scratch.shared_dir(session(master))
        assert scratch.shared_dir(session(master, "hdfs:///tmp")) == "hdfs:///tmp"
    assert scratch.shared_dir(session("local[4]")).startswith("file:///")


def test_scratch_tables_can_be_dropped(spark):
    scratch = Scratch(spark, "test")
    t = scratch.table(spark.range(3).toDF("x"))
    assert t.count() == 3
    scratch.drop(t)
    with pytest.raises(Exception):
        t.count()


def test_join_kinds_and_policies(spark):
    from casewise.operators import joins

    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k long, a string")
    b = spark.createDataFrame([("1", "p", "dup"), ("1", "q", "dup"), ("3", "r", "dup"), ("bad", "s", "dup")], "k string, b string, a string")
    found = {h: sorted((r.k or 0, r.a or "", r.b or "") for r in joins.join_tables(a, b, "k", h, (F.asc("b"),)).collect()) for h in joins.HOWS}
    assert found["left"] == [(0, "z", ""), (1, "x", "p"), (2, "y", "")] and found["inner"] == [(1, "x", "p")]
    assert found["right"] == [(1, "x", "p"), (3, "", "r")] and found["outer"] == [(0, "z", ""), (1, "x", "p"), (2, "y", ""), (3, "", "r")]
    with pytest.raises(ValueError):
        joins.join_tables(a, b, "k", "cross")
    with pytest.raises(facts.ContractError):
        joins.duplicate_policy(b, "k", "error", (F.col("b"),))
    assert {(r.k, r.b) for r in joins.duplicate_policy(b, "k", "keep_first", (F.desc("b"),)).collect()} == {("1", "q"), ("3", "r"), ("bad", "s")}
    assert joins.temporal_split(spark.createDataFrame([(i, f"2024-01-{1 + i // 4:02d}") for i in range(10)], "id int, day string").withColumn("day", F.to_date("day")), "day", "id").where("is_train").count() == 8


def test_column_tools(spark):
    from casewise.operators import columns

    df = spark.createDataFrame([(1, '{"a": {"b": true}, "c": "x"}'), (2, "broken"), (3, None)], "id int, j string")
    rows = columns.flattened(df, "j", {"b": ("$.a.b", "boolean", 0), "c": ("$.c", "string", None), "n": ("$.c", "int", 5)}).orderBy("id").collect()
    assert [(r.b, r.c, r.n) for r in rows] == [(1, "x", 5), (0, None, 5), (0, None, 5)]
    assert columns.prefixed(spark.createDataFrame([(1, 2, 3, 4)], "id int, e_10 int, e_2 int, x int"), "v_", ("id",)).columns == ["id", "v_e_2", "v_e_10", "v_x"]


def whole(spark, tmp_path, name, **tables):
    """A registered query's rows over given tables."""
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    return sorted((tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=str)


def test_long_and_null_texts_are_normalized(spark, tmp_path):
    docs = spark.createDataFrame([(1, "É  A " * 3000), (2, None), (3, "x")], "doc_id long, text string")
    found = whole(spark, tmp_path, "text_normalize", documents=docs)
    assert found == [(1, " ".join(["e a"] * 3000)), (2, None), (3, "x")]


def test_words_beyond_the_twentieth_count(spark, tmp_path):
    docs = spark.createDataFrame([("en", "a " * 30 + " late" * 5), ("en", None), ("de", "a a")], "lang string, text string")
    assert whole(spark, tmp_path, "explode_list", documents=docs) == [("en", "a", 30), ("en", "late", 5)]


def test_rows_without_a_partner_stay(spark, tmp_path):
    part = spark.createDataFrame([(1, "b1", "k1")], "p_partkey long, p_brand string, p_type string")
    supplier = spark.createDataFrame([(2, "s2"), (7, "s7")], "s_suppkey long, s_name string")
    customer = spark.createDataFrame([(2, "c2"), (3, "c3"), (99, "c99")], "c_custkey long, c_name string")
    lines = spark.createDataFrame([(1, 1, 1, 2, 5.0), (1, 2, 9, 7, 50.0), (2, 1, None, None, 1.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    assert whole(spark, tmp_path, "fact_enrich", part=part, supplier=supplier, lineitem=lines, customer=customer) == [(1, 1, "b1", "k1", "s2"), (1, 2, None, None, "s7"), (2, 1, None, None, None)]
    outer = [(2, "s2", "c2"), (3, None, "c3"), (7, "s7", None), (99, None, "c99")]
    assert whole(spark, tmp_path, "join_outer") == whole(spark, tmp_path, "explanations_outer") == outer
    docs, labels = spark.createDataFrame([(1,), (2,)], "doc_id long"), spark.createDataFrame([(1, 1), (2, 0), (5, 1), (None, 1)], "doc_id long, quality int")
    assert whole(spark, tmp_path, "fact_consistency", documents=docs, labels=labels) == [(4, 2, 1)]


def test_overlap_of_all_pairs_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "ITEM_BLOCK", 2)  # so that items come in blocks
    bodies = [(1, "the red fox"), (2, "THE dog, the DOG"), (None, "fox"), (3, None), (4, "")] + [(10 + i, f"the w{i}") for i in range(40)]
    items = [(1, "the fox"), (2, "a dog"), (3, None), (4, "!!"), (5, "w7 w8 zzz"), (5, "the"), (None, "red")]
    words = lambda t: set(re.findall(r"[a-z0-9%$€£¥]+", (t or "").lower()))
    wanted = [(i, d, round(len(words(y) & words(x)) / len(words(y)), 6)) for i, y in items for d, x in bodies if words(x) & words(y)]
    docs, bench = spark.createDataFrame(bodies, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert whole(spark, tmp_path, "token_overlap", documents=docs, benchmark=bench) == sorted(wanted, key=str)
    assert texts.overlapping(docs, bench.limit(0), "doc_id", "item_id").count() == 0


def test_words_of_groups_end_at_letters_beyond_ascii(spark):
    df = spark.createDataFrame([("\u00dfund x",), ("undauheit",), ("und_ 1und",), ("le\u0153 und, LES",), (None,)], "t string")
    got = [r[0] for r in df.select(texts.inferred_group(F.col("t"), {"de": ("und",), "fr": ("le", "les")})).collect()]
    assert got == ["de", None, None, "fr", None]


def test_rounding_and_quantiles_are_the_sql_engines(spark):
    import duckdb

    pairs = [(a, b) for b in (128, 640, 1280) for a in range(1, b) if a * 2_000_000 % b == 0 and a * 1_000_000 % b]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs] + [(-41.0, 640.0), (1e300, 1.0)], "a double, b double")
    for r in df.select("a", "b", expr.rounded(F.col("a") / F.col("b"), 6).alias("got")).collect():
        assert r.got == duckdb.execute(f"SELECT round({r.a!r}::DOUBLE / {r.b!r}::DOUBLE, 6)").fetchone()[0], r
    assert df.limit(0).select(expr.rounded(F.lit(None).cast("double"), 6)).count() == 0
    draw = np.random.default_rng(11)
    columns = {f"c{i}": [float(v) for v in (draw.normal(size=4) * 1e6 if i % 2 else np.repeat(draw.normal() * 1e6, 4))] for i in range(20)}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    got = order.column_quantiles(df, {c: (c, 0.9) for c in columns})
    for c, values in columns.items():
        assert got[c] == duckdb.execute("SELECT quantile_cont(x, 0.9) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchone()[0]


@pytest.mark.parametrize("rule", [fetch.Rule(4), fetch.Rule(4, ("f",), ("g",), "n < 9", relax=True), fetch.Rule(4, ("f",), ("g",), "n < 9"), fetch.Rule(4, steps=("f", "g"))])
def test_candidates_are_filtered_where_they_are_found(spark, monkeypatch, rule):
    """Few rows leave the task, and the rule finds the same k among them as among all that were fetched."""
    monkeypatch.setattr(fetch, "CHUNK_ROWS", 40)
    monkeypatch.setattr(fetch, "LEAST_ROWS", 40)
    draw = np.random.default_rng(8)
    vectors = draw.normal(size=(230, 6)).round(1)
    vectors[60:110] = vectors[3]  # copies: ties go to the lesser id
    vectors[7] = 0
    rows = [(i, v[:3].tolist(), v[3:].tolist(), None if i % 11 == 0 else "uvwxy"[i % 5], i % 9, i % 10) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([*rows, (900, None, [1.0] * 3, "u", 1, 1)], "id long, a array<float>, b array<float>, f string, g int, n int")
    area, weights = Scratch(spark, "test"), {"a": 0.7, "b": 0.3}
    index = fetch.pack(df, ("a", "b"), rule, area)
    assert index[0].count() > 3
    near = fetch.fetch(index, index[0], weights, 30, rule, area)
    assert near.count() < 230 * 30 / 2

    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    a, b = (unit(vectors.astype(np.float32).astype(float)[:, s]) for s in (slice(0, 3), slice(3, 6)))
    sims = np.round(0.7 * (a @ a.T) + 0.3 * (b @ b.T), 12)
    every = [(q, int(c), float(sims[q, c])) for q in range(230) for c in [c for c in np.lexsort((np.arange(230), -sims[q])) if c != q][:30]]
    every = spark.createDataFrame(every, "query_id long, case_id long, similarity double")

    def first(pairs):
        side = lambda p, key: df.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in "fgn"])
        pairs = pairs.withColumn("similarity", F.round("similarity", 9)).join(side("q", "query_id"), "query_id").join(side("c", "case_id"), "case_id")
        if rule.steps:
            pairs = retrieval.filtered_stepwise(pairs, [expr.same_known(F.col(f"q_{c}"), F.col(f"c_{c}")) for c in rule.steps], rule.k)
        else:
            pairs = retrieval.filtered(pairs, retrieval.passes(rule.same, rule.other) & (F.col("c_n") < 9 if rule.ok else F.lit(True)), rule.k, rule.relax)
        return sorted((r.query_id, r.neighbor, r.case_id, round(r.similarity, 8)) for r in pairs.collect())

    assert first(near.withColumn("similarity", F.col("a") * 0.7 + F.col("b") * 0.3)) == first(every)
    empty = fetch.pack(df.limit(0), ("a", "b"), rule, area)
    assert fetch.fetch(empty, index[0], weights, 30, rule, area).count() == 0 == fetch.fetch(index, empty[0], weights, 30, rule, area).count()
