"""The pipeline's stages on null, repeated, empty, very long and clashing rows, and against brute force."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casewise.llm.scratch import Scratch
from tests.conftest import SMALL

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, record string, group long"
WORDS = " ".join(f"wort{i} und" for i in range(40))


def row(doc_id, text, lang="de"):
    return doc_id, text, lang, "web", None if text is None else len(text), 0.5, "r", 1


@pytest.fixture(scope="module")
def bench(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text


def run(spark, name, rows):
    out = STAGES[name](spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SMALL)
    return out


def shown(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_language_judges_rows(spark):
    rows = [row(i, f"{WORDS} der die das {i}") for i in range(1, 9)]
    rows += [row(None, None), row(None, "123 !!"), row(3, ""), row(3, "123"), row(None, WORDS), row(9, "ß" * 50_000)]
    out = run(spark, "language_id", rows)
    assert out.columns == spark.createDataFrame([], SCHEMA).columns
    assert shown(out) == sorted([(r[0], r[1]) for r in rows if r[1] and re.search("[^\\W\\d]", r[1])], key=str)
    assert run(spark, "language_id", rows[:0]).count() == 0


def test_dedupe_keeps_one_row_of_each_group(spark):
    near = WORDS.replace("wort7 ", "andere ")
    other = " ".join(f"mot{i} et" for i in range(40))
    rows = [row(5, WORDS), row(5, WORDS), row(7, near), row(None, WORDS), row(5, other), row(4, other + " fin"), row(None, "solo texte"), row(None, "solo texte"), row(8, None), row(8, None), row(9, ""), row(None, " \t"), row(6, "x " * 60_000)]
    out = run(spark, "near_duplicates", rows)
    wanted = [(5, WORDS), (4, other + " fin"), (None, "solo texte"), (8, None), (8, None), (9, ""), (None, " \t"), (6, "x " * 60_000)]
    assert shown(out) == sorted(wanted, key=str) and out.columns == spark.createDataFrame([], SCHEMA).columns
    assert run(spark, "near_duplicates", rows[:0]).count() == 0


def test_decontaminate_judges_rows(spark, bench):
    rows = [row(1, bench), row(1, WORDS), row(None, bench), row(None, WORDS), row(2, None), row(3, ""), row(4, bench + " " + WORDS * 300), row(5, WORDS), row(5, WORDS)]
    out = run(spark, "benchmark_decontamination", rows)
    assert shown(out) == sorted([(r[0], r[1]) for r in rows if r[1] != bench], key=str)
    assert run(spark, "benchmark_decontamination", rows[:0]).count() == 0


def test_pseudonymise_keeps_every_row(spark):
    rows = [row(1, "Mail an eva@firma.de heute"), row(1, "ohne"), row(None, "Mail an eva@firma.de heute"), row(2, None), row(3, ""), row(4, "a " * 30_000 + "eva@firma.de")]
    out = run(spark, "pii_surrogates", rows)
    got = out.collect()
    assert len(got) == len(rows) and not any("eva@firma.de" in (r.text or "") for r in got)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert len({r.text for r in got if r.text and r.text.startswith("Mail")}) == 1 and {r.text for r in got if r.doc_id in (2, 3)} == {None, ""}
    assert run(spark, "pii_surrogates", rows[:0]).count() == 0


def test_encode_keeps_every_row(spark):
    rows = [row(1, "abc"), row(1, "abc"), row(None, None), row(2, ""), row(3, "ꙮ" * 3000)]
    got = sorted(((r.doc_id, r.n_tokens, r.lossless, str(r.tokens)) for r in run(spark, "sentencepiece", rows).collect()), key=str)
    assert len(got) == 5 and all(x[2] for x in got) and got[0] == got[1]
    assert run(spark, "sentencepiece", rows[:0]).count() == 0


def test_all_stages(spark):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, SMALL), name)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[0] > seen[2] > seen[3] == seen[4] == seen[5]
    assert docs.where(~F.col("lossless")).count() == 0
