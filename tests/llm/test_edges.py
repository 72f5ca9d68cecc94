"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from casewise.llm import imagecopies, langid, lmscore, partenum, pii, sampling, shuffle, toxicity, warc, wumanber
from casewise.sources.scratch import Scratch

LONG = "lorem ipsum dolor sit amet " * 8000 + "x" * 70_000
DOCS = [(1, "The idiot wrote to a.b@mail.example.com", "en"), (2, None, "en"), (3, "", None), (4, " \t\n", "de"), (5, LONG, "en"), (6, LONG, "en"), (6, LONG, "en"), (None, "der die das und nicht", "de"), (7, "der die das und nicht", "de"), (8, "12 34 !!", "en")]
#: Names that operators use inside.
CLASH = ["id", "n", "h1", "record", "hits", "items", "bucket", "place", "size", "score", "key", "train", "shard", "slot", "tokens", "node", "component", "lettered", "target", "moved", "payload", "bytes", "sha1"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (5, 0), (7, None), (None, 1), (8, 0)], "doc_id long, toxic int")


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


EVERY = sorted((i is None, i or 0) for i, _, _ in DOCS)


def test_language(spark, docs):
    model = langid.fit_languages(docs)
    out = {r.doc_id: r for r in langid.predict_languages(docs, model).collect()}
    assert ids(langid.predict_languages(docs, model)) == EVERY
    assert out[7].lang_pred == "de" and out[5].lang_pred == "en"
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (2, 3, 4, 8))
    assert langid.predict_languages(docs.limit(0), model).count() == 0
    assert langid.fit_languages(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict_languages(docs, None).collect()} == {"und"}


def test_lm(spark, docs):
    out = lmscore.lm_scores(docs, F.lit(True))
    assert ids(out) == EVERY
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].n_tokens == rows[3].n_tokens == rows[4].n_tokens == 1 and rows[5].n_tokens == 8000 * 5 + 2
    assert rows[2].score == rows[3].score < 0
    assert lmscore.lm_scores(docs.limit(0), F.lit(True)).count() == 0
    unseen = lmscore.lm_scores(docs, F.lit(False)).collect()
    # nothing learned: the one class of unknown tokens has (0 + 0.5) / (0 + 0.5 * (0 + 1)) = 1
    assert all(r.n_known == 0 and r.train_tokens == 0 and abs(r.base_score) < 1e-9 and abs(r.score) < 1e-3 for r in unseen)


def test_pii(spark, docs):
    out = pii.replace_entities(docs).select("record.doc_id", "record.shard", "new_text", "n_entities")
    assert ids(out) == EVERY
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].new_text is None and rows[3].new_text == "" and rows[5].new_text == LONG
    assert rows[1].n_entities == 1 and "a.b@mail.example.com" not in rows[1].new_text and rows[1].shard == "clash"
    assert pii.replace_entities(docs.limit(0)).count() == 0


def test_shuffle(spark, docs):
    scratch = Scratch(spark, "test")
    out = shuffle.external_shuffle(docs, scratch.path("a"), 4)
    assert ids(out.select("record.doc_id")) == EVERY
    counts = {r.shard: r.n for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 4
    assert all([r.slot for r in out.where(F.col("shard") == s).orderBy("slot").collect()] == list(range(n)) for s, n in counts.items())
    assert shuffle.external_shuffle(docs.limit(0), scratch.path("b"), 4).count() == 0
    one = shuffle.external_shuffle(docs.limit(1), scratch.path("c"), 4).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]


def test_images(spark):
    import numpy as np

    flat = imagecopies.write_pgm(np.full((96, 96), 7))
    noise = imagecopies.write_pgm(np.random.default_rng(1).integers(0, 255, (96, 96)))
    df = spark.createDataFrame([(1, bytearray(flat)), (2, None), (3, bytearray(b"junk")), (4, bytearray(noise)), (5, bytearray(noise)), (4, bytearray(noise)), (None, bytearray(noise)), (6, bytearray(b"P5 0 0 255\n"))], "image_id long, image binary").withColumn("id", F.lit("clash"))
    assert {(r.query_id, r.match_id) for r in imagecopies.find_copies(df, df).collect()} == {(4, 4), (5, 4)}
    classes = {(r.image_id, r.class_id, r.n_corners > 0, r.found) for r in imagecopies.copy_classes(df, df.where("image_id IN (1, 5)")).collect()}
    assert classes == {(1, 1, False, False), (2, 2, False, None), (3, 3, False, None), (4, 4, True, None), (5, 4, True, True), (6, 6, False, None)}
    assert imagecopies.find_copies(df.limit(0), df).count() == 0 and imagecopies.find_copies(df, df.limit(0)).count() == 0


def test_contamination(spark, docs):
    bench = spark.createDataFrame([(1, "der die das"), (1, "der die das"), (2, None), (3, "!!"), (None, "34"), (4, "lorem ipsum dolor sit amet " * 4)], "item_id long, text string").withColumn("items", F.lit(0))
    out = wumanber.contamination(docs, bench)
    assert ids(out) == EVERY
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[7]["items"] == ["1"] and rows[7].n_hit == 3 and rows[8]["items"] == [] and rows[8].n_hit == 1
    assert rows[5].n_hit == 40_000 and rows[5].n_words == 40_001 and rows[2].n_words == rows[3].n_words == 0
    assert {r.n_hit for r in wumanber.contamination(docs, bench.limit(0)).collect()} == {0}
    assert wumanber.contamination(docs.limit(0), bench).count() == 0


def test_near_duplicates(spark, docs):
    out = partenum.near_duplicates(docs)
    assert ids(out) == EVERY
    rows = {(r.doc_id, r.n_shingles): r.component_id for r in out.collect()}
    assert rows[6, rows_of(out, 6)] == 5 and rows[2, 0] == 2 and rows[3, 0] == 3 and rows[None, 1] == 7
    assert partenum.near_duplicates(docs.limit(0)).count() == 0


def rows_of(out, doc_id):
    return out.where(F.col("doc_id") == doc_id).first().n_shingles


def test_sampling(spark, docs):
    out = sampling.encode_sampled(docs)
    assert ids(out) == EVERY
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r.lossless for r in rows.values()) and rows[2].n_tokens == rows[3].n_tokens == 0
    texts = {r.doc_id: r.text for r in sampling.decode_tokens(out).collect()}
    assert texts[5] == LONG and texts[4] == " \t\n" and texts[2] == ""
    assert sampling.encode_sampled(docs.limit(0)).count() == 0


def test_toxicity(spark, docs, labels):
    model = toxicity.fit_toxicity(docs, labels)
    out = toxicity.score_toxicity(docs, model)
    assert ids(out) == EVERY and all(0 <= r.score <= 1 for r in out.collect())
    nothing = toxicity.fit_toxicity(docs.limit(0), labels)
    assert len({r.score for r in toxicity.score_toxicity(docs, nothing).collect()}) == 1
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_warc(spark):
    big = "<p>\r\n\r\nWARC/1.1\r\n" * 100
    pages = spark.createDataFrame([(1, "http://www.A.org/x#y", big), (2, None, big), (3, "http://a.org/x", None), (4, "bad\r\nurl", "é"), (5, "http://b.org:8080/", big), (5, "http://b.org:8080/", big), (None, "http://c.org", "short")], "page_id long, url string, html string").withColumn("target", F.lit(1))
    scratch = Scratch(spark, "test")
    path = scratch.path("w")
    warc.write_archives(pages, path)
    rows = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_index(spark, path, scratch).collect()), key=str)
    n = len(big)
    assert rows == sorted([(1, n, "revisit", 5), (2, n, "revisit", 5), (3, 0, "response", None), (4, 2, "response", None), (5, n, "response", None), (5, n, "response", None), (0, 5, "response", None)], key=str)
    path = scratch.path("e")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_index(spark, path, scratch).count() == 0
