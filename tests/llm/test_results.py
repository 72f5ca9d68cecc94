"""Operators against brute force, exact round trips, SQL and held-out accuracy, on small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewise.llm import eliasfano, imagecopies, langid, lmscore, partenum, pii, registry, sampling, shuffle, textkernel, toxicity, warc, wumanber
from casewise.sources.scratch import Scratch
from tests.conftest import SMALL, rows_of


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def remainder(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    wanted = duck.sql(registry.ORACLE_SQL[name]).df()
    found = registry.QUERIES[name](spark, SMALL).toPandas()
    assert rows_of(found[list(wanted.columns)]) == rows_of(wanted)


# words and hashes


@given(st.lists(st.text(alphabet=st.sampled_from("aB9é \t\n.-ß漢"), max_size=12), max_size=6), st.integers(1, 20))
@settings(max_examples=150, deadline=None)
def test_words(found, limit):
    got = []
    for _, _, data, offsets in textkernel.string_slices(pa.array(found, pa.string()), limit):
        words = textkernel.Words(data, offsets, textkernel.SPACED)
        each = [words.word(i).decode() for i in range(len(words.start))]
        got += [each[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        h = words.hash
        assert len(set(zip(each, h.tolist()))) == len(set(each)) == len(set(h.tolist()))
    assert got == [spaced(t) for t in found]


# language


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = registry.QUERIES["op1_marginal_unigrams"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    good, n = found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and good >= 0.99


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice([b"a", b"b", b"ab", b"ba", b"aba"])
    p = np.array([[0.3], [0.2], [0.25], [0.15], [0.1], [0.0]])
    chars = np.frombuffer(b"abab", np.uint8)[None, :]
    pieces = {b"a": 0.3, b"b": 0.2, b"ab": 0.25, b"ba": 0.15, b"aba": 0.1}

    def total(rest):
        return 1.0 if not rest else sum(w * total(rest[len(x) :]) for x, w in pieces.items() if rest.startswith(x))

    assert lattice.forward(chars, p)[0, 0] == pytest.approx(math.log(total(b"abab")))
    used = np.zeros((5, 1))
    lattice.expect(chars, np.ones((1, 1)), p, used)
    assert (used[:, 0] * [1, 1, 2, 2, 3]).sum() == pytest.approx(4)  # every segmentation covers all four bytes


# language model


@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(0, 40))
@settings(max_examples=100, deadline=None)
def test_elias_fano(values, shift):
    v = np.unique(np.array(values, dtype=np.uint64)) << np.uint64(shift)
    e = eliasfano.EliasFano.build(v)
    q = np.concatenate([v, v + np.uint64(1), np.arange(0, 6000, 97, dtype=np.uint64) << np.uint64(shift)])
    assert (e.successor(q) == np.searchsorted(v, q)).all()
    assert (e.get(np.arange(len(v))) == v).all()


def test_trie_from_a_mapped_file(tmp_path):
    import mmap

    words = np.array([3, 9, 2**40], dtype=np.uint64)
    trie = eliasfano.Trie.build(words, np.array([0, 0, 2]), np.array([5, 2**31, 7], dtype=np.uint32), np.array([1.0, 2.0, 3.0]))
    (tmp_path / "trie").write_bytes(trie.to_bytes())
    with open(tmp_path / "trie", "rb") as f:
        again = eliasfano.Trie.map(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    assert again.place(np.array([9, 10, 2**40], dtype=np.uint64)).tolist() == [1, -1, 2]
    assert again.lookup(np.array([0, 0, 1, 2, 0]), np.array([5, 2**31, 5, 7, 6], dtype=np.uint32)) == pytest.approx([1, 2, 0, 3, 0], abs=1e-3)


@pytest.mark.parametrize("theta", [lmscore.THETA, 2.0])  # 2: no word is frequent, not even the end
def test_scores_equal_brute_force(spark, texts, monkeypatch, theta):
    monkeypatch.setattr(lmscore, "THETA", theta)
    tokens = {i: [*spaced(t), "\n"] for i, t in texts.items()}
    train = [i for i in texts if remainder(i, 5) != 1]
    one, two = collections.Counter(), collections.Counter()
    for i in train:
        one.update(tokens[i])
        two.update(zip([" ", *tokens[i]], tokens[i]))
    n, v, context = sum(one.values()), len(one), one.copy()
    context[" "] = len(train)
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    rows = registry.QUERIES["op2_elias_fano_trie"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(one[x] > 0 for x in w), n, remainder(r.doc_id, 5) == 1)
        assert r.base_score == pytest.approx(sum(math.log10(p(x)) for x in w), abs=1e-6)
        exact = sum(math.log10((two[c, x] + lmscore.MU * p(x)) / (context[c] + lmscore.MU)) for c, x in zip([" ", *w], w))
        assert abs(r.score - exact) <= len(w) * eliasfano.STEP / 2 + 1e-6


# personal data


def test_surrogates(spark):
    text = "Mr. John Smith (j.smith@corp.org, +1 (415) 555-2671, 10.1.2.3, card 4111 1111 1111 1111) met Mrs. Smith. Mr. John Smith again, J.SMITH@CORP.ORG, 415-555-2671; order 4111111111111112; v1.2.3.4.5; token = \"deadbeef00112233\"; Г-жа. Госпожа Иванова; 078-05-1120"
    new = pii.replace_entities(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().new_text
    for gone in ("John", "Smith", "j.smith@corp.org", "415", "10.1.2.3", "4111 1111 1111 1111", "deadbeef", "Иванова", "078-05-1120"):
        assert gone not in new
    assert "4111111111111112" in new and "v1.2.3.4.5" in new  # no card, no address
    name = re.match(r"Mr\. (\w+) (\w+) \(", new)
    assert name and f"Mr. {name[1]} {name[2]} again" in new and f"Mrs. {name[2]}." in new
    mail = re.search(r"[\w.]+@[\w.]+", new)[0]
    assert mail.upper() in new
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", new)
    assert f"{phone[1]}-{phone[2]}-{phone[3]}" in new
    card = re.search(r"card (4\d{3} \d{4} \d{4} \d{4})\)", new)[1].replace(" ", "")
    assert sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(card)) % 10 == 0
    assert re.search(r"Госпожа [А-Я][а-я]+;", new) and re.search(r"9\d\d-\d\d-\d{4}$", new)


def test_names_without_titles_and_their_mentions(spark):
    texts = ["Yesterday Maria Lopez called. Lopez said that maria and Maria's friend, John Smith, left; Smith's dog, Smithson and LOPEZ stayed. Dr. Weber too.", "Smith alone is nobody's name here."]
    a, b = [r.new_text for r in pii.replace_entities(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).orderBy("record.doc_id").collect()]
    first = re.match(r"Yesterday (\w+) (\w+) called\. (\w+) said that maria and (\w+)'s friend, (\w+) (\w+), left; (\w+)'s dog, Smithson and LOPEZ stayed\. Dr\. Weber too\.$", a)
    assert first and first[2] == first[3] and first[1] == first[4] and first[6] == first[7] and first[1][-1] == "a"
    assert not {"Maria", "Lopez", "John", "Smith"} & set(first.groups()) and b == texts[1]


def test_surrogates_stay_distinct(spark):
    values = [(f"+1 ({200 + i // 100:03d}) 555-{i % 100:04d}", i) for i in range(3000)]
    out = pii.replace_entities(spark.createDataFrame(values, "text string, doc_id int")).select("record.text", "new_text").collect()
    assert len({r.new_text for r in out}) == 3000 and not {r.new_text for r in out} & {r.text for r in out}


def test_clean_texts_are_left_alone(spark, texts):
    rows = pii.replace_entities(spark.read.parquet(f"{SMALL}/documents.parquet")).select("record.doc_id", "new_text", "n_entities").collect()
    assert all((r.new_text == texts[r.doc_id]) == (r.n_entities == 0) for r in rows)
    assert any(r.n_entities for r in rows)


# shards


def test_shuffle_is_seeded_and_uniform(spark):
    df = spark.range(4000).withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string")))
    scratch = Scratch(spark, "test")
    runs = [shuffle.external_shuffle(d, scratch.path("s"), 8, seed) for d, seed in ((df, 1), (df.repartition(7), 1), (df, 2))]
    a, b, c = ([(r.shard, r.slot, r.record.id) for r in x.orderBy("shard", "slot").collect()] for x in runs)
    assert a == b != c
    order = [i for _, _, i in a]
    assert abs(np.corrcoef(order, range(4000))[0, 1]) < 0.06
    assert sorted(shuffle.fisher_yates(50, 1, 2)) == list(range(50))


def test_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(shuffle, "BUCKET_BYTES", 2000)
    df = spark.range(900).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text")).repartition(3)
    out = shuffle.external_shuffle(df, Scratch(spark, "test").path("s"), 4)
    assert [r.n for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()] == [225] * 4
    mixed = spark.range(500).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") == 400, F.expr("repeat('x', 90000)")).otherwise("t").alias("text"))
    runs = [shuffle.external_shuffle(d, Scratch(spark, "test").path("s"), 4) for d in (mixed.repartition(3), mixed.repartition(11))]
    places = [sorted((r.shard, r.slot, r.record.doc_id, r.record.text) for r in x.collect()) for x in runs]
    assert places[0] == places[1] and len(places[0]) == 500  # however the rows lie


# images


def test_recall_against_brute_force(spark):
    rows = registry.QUERIES["op5_local_descriptors"](spark, SMALL).collect()
    asked = [r for r in rows if r.asked]
    assert len(rows) == spark.read.parquet(f"{SMALL}/embeddings.parquet").count() and all(r.image_id % 50 == 0 for r in asked)
    assert sum(r.found for r in asked) >= 0.9 * len(asked) > 0
    assert sum(r.n_queries > 0 for r in rows if not r.asked) <= 0.1 * len(asked)


def test_turned_and_flat_images():
    x = np.random.default_rng(3).integers(0, 255, (1, 96, 96)).astype(np.float32)
    x = imagecopies._smooth(imagecopies._smooth(x)) * 2
    who, place, bits = imagecopies.describe(x)
    _, turned_place, turned = imagecopies.describe(np.rot90(x, axes=(1, 2)).copy())
    near = np.bitwise_count(bits[:, None] ^ turned[None]).sum(axis=-1) <= imagecopies.MOST_APART
    a, b = np.nonzero(near)
    assert imagecopies.agreeing(place[a], turned_place[b]) >= imagecopies.LEAST_AGREEING
    assert len(imagecopies.describe(np.zeros((1, 96, 96)))[0]) == 0


def test_pairs_name_queries_and_classes(spark):
    pairs = [tuple(r) for r in registry.QUERIES["op5_copy_pairs"](spark, SMALL).select("query_id", "match_id").collect()]
    rows = {r.image_id: r for r in registry.QUERIES["op5_local_descriptors"](spark, SMALL).collect()}
    assert len(pairs) == len(set(pairs)) and all(q % 50 == 0 and rows[m].equal_id == m for q, m in pairs)
    assert {i for i, r in rows.items() if r.found} == {i for i, r in rows.items() if r.asked and (i, r.equal_id) in pairs}
    assert {i: r.n_queries for i, r in rows.items()} == {i: sum(m == r.equal_id for _, m in pairs) for i, r in rows.items()}


def fields(n, side=96):
    draw = np.random.default_rng(11)
    x = draw.integers(0, 255, (n, side, side)).astype(np.float32)
    x = imagecopies._smooth(imagecopies._smooth(x))
    return np.clip(128 + (x - x.mean()) * 3, 0, 255)


EDITS = {
    "cropped": lambda x: x[:, 7:88, 5:86] * 0.9 + 10,
    "turned": lambda x: np.rot90(x, axes=(1, 2)).copy(),
    "rescaled": lambda x: imagecopies._resized(x, 0.85),
    "noisy": lambda x: np.clip(x + np.random.default_rng(12).normal(0, 8, x.shape), 0, 255),
    "all of it": lambda x: np.rot90(imagecopies._resized(x[:, 4:90, 5:92] * 0.9 + 10, 0.9), axes=(1, 2)).copy(),
}


def rendered(spark, n):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").limit(n).collect()
    base = imagecopies._basis()
    return np.stack([np.clip(128 + 22 * (np.asarray(r.embedding, np.float32) @ base), 0, 255).reshape(96, 96) for r in rows])


@pytest.mark.parametrize("edit", sorted(EDITS))
def test_search_against_brute_force(spark, edit):
    """Of all pairs of a query and an image whose descriptors, all compared, agree on a transform."""
    images = np.rint(np.concatenate([fields(15), rendered(spark, 85)])).astype(np.uint8).astype(np.float32)
    edited = np.clip(np.rint(EDITS[edit](images)), 0, 255)
    table = lambda x: spark.createDataFrame([(i, imagecopies.write_pgm(v)) for i, v in enumerate(x)], "image_id long, image binary")
    got = {(r.query_id, r.match_id) for r in imagecopies.find_copies(table(images), table(edited)).collect()}
    who, place, bits = imagecopies.describe(images)
    asked, asked_place, asked_bits = imagecopies.describe(edited)
    of = lambda i: (place[who == i], bits[who == i])
    wanted = {(q, i) for q in range(len(images)) for i in range(len(images)) if imagecopies.matches(asked_place[asked == q], asked_bits[asked == q], *of(i))[1] >= imagecopies.LEAST_AGREEING}
    assert len({q for q, i in wanted if q == i}) >= 0.9 * len(images)
    assert got <= wanted and len(got) >= 0.9 * len(wanted)


def test_keys_of_near_descriptors_meet():
    draw = np.random.default_rng(14)
    a = draw.integers(0, 2**64, (2000, 4), dtype=np.uint64)
    for apart in (0, 4, 8, 16, 24):
        one = math.prod((256 - imagecopies.KEY_BITS - i) / (256 - i) for i in range(apart))  # a table keeps none of the bits that differ
        flips = np.zeros((2000, 256), np.uint8)
        for row in flips:
            row[draw.choice(256, apart, replace=False)] = 1
        b = a ^ np.packbits(flips, axis=1).view(np.uint64)
        assert (imagecopies.keys_of(a) == imagecopies.keys_of(b)).any(axis=1).mean() == pytest.approx(1 - (1 - one) ** imagecopies.TABLES, abs=0.05)
    assert not (imagecopies.keys_of(a)[:1000] == imagecopies.keys_of(a)[1000:]).any()


def test_the_bitmap_only_spares_rows(spark):
    bits = np.random.default_rng(15).integers(0, 2**64, (300, 4), dtype=np.uint64)
    rows = spark.createDataFrame([(i, i, bits[i * 10 : i * 10 + 10].tobytes()) for i in range(30)], "id long, h1 long, bits binary")
    asked = rows.where("id < 3").mapInArrow(imagecopies._deal(None, "bits"), imagecopies._KEYS)
    bitmap = imagecopies._bitmap(asked)
    every = {tuple(r) for r in rows.mapInArrow(imagecopies._deal(None, "bits"), imagecopies._KEYS).collect()}
    left = {tuple(r) for r in rows.mapInArrow(imagecopies._deal(bitmap, "bits"), imagecopies._KEYS).collect()}
    assert len(every) == 300 * imagecopies.TABLES and {tuple(r) for r in asked.collect()} <= left <= every and len(left) < len(every) / 5


def test_corners_grow_with_the_area_and_count_once_over_scales():
    small, large = (imagecopies.describe(fields(1, side))[2] for side in (96, 192))
    assert len(large) > 2 * len(small)
    place = np.array([[20 * i + d, 10.0, 1, 0] for i in range(3) for d in (0, 1.2)], np.float32)
    assert imagecopies.agreeing(place, place) == 3


# contamination


def test_occurrences_equal_brute_force():
    draw = np.random.default_rng(5)
    docs = [" ".join(draw.choice(list("abcd"), draw.integers(0, 700))) for _ in range(60)]
    items = [(i, " ".join(draw.choice(list("abcd"), n))) for i, n in enumerate([1, 2, 3, 5, 5, 6, 9, 14])] + [(99, docs[3][:41])]
    patterns = wumanber.Patterns(items, 6)
    for _, _, data, offsets in textkernel.string_slices(pa.array(docs)):
        words = textkernel.Words(data, offsets, textkernel.ALNUM)
        hit, found = patterns.search(words)
    at = 0
    for k, text in enumerate(docs):
        w, wanted, names = text.split(), [False] * len(text.split()), set()
        for i, item in items:
            p = item.split()
            m = min(6, len(p))
            for s in range(len(p) - m + 1 if m else 0):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == p[s : s + m]:
                        wanted[j : j + m] = [True] * m
                        names.add(str(i))
        assert hit[at : at + len(w)].tolist() == wanted and found.get(k, set()) == names
        at += len(w)


def test_benchmark_in_several_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {tuple(map(str, r)) for r in wumanber.contamination(docs, bench).collect()}
    monkeypatch.setattr(wumanber, "BLOCK_BYTES", 3000)
    assert {tuple(map(str, r)) for r in wumanber.contamination(docs, bench).collect()} == whole


# near duplicates


def components_of(sets, num=80, den=100):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            shared = len(sets[i] & sets[j])
            if shared and den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, width=5):
    w = spaced(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_components_equal_brute_force(spark, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    wanted = components_of(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.QUERIES["op7_partenum_join"](spark, SMALL).collect()}
    assert got == {i: (len(sets[i]), wanted[i]) for i in sets}


def test_near_copies_of_one_text_and_a_shared_passage(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK_MEMBERS", 16)  # so that buckets fall into blocks
    draw = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    base, passage = draw.choice(words, 120), " ".join(draw.choice(words, 60))
    rows = []
    for i in range(90):
        w = base.copy()
        for at in draw.choice(120, draw.integers(0, 5), replace=False):
            w[at] = draw.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, passage + " " + " ".join(draw.choice(words, draw.integers(3, 80)))) for i in range(90)]
    rows += [(200 + i, " ".join(draw.choice(words[:4], draw.integers(1, 9)))) for i in range(60)]
    wanted = components_of({i: shingles(t) for i, t in rows})
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {r.doc_id: r.component_id for r in partenum.near_duplicates(docs).collect()} == wanted
    got = partenum.near_duplicates(docs, class_bits=9)  # most classes share their first hash
    assert {r.doc_id: r.component_id for r in got.collect()} == wanted


def test_texts_without_ids_still_link(spark):
    w = [f"w{i}" for i in range(124)]
    rows = [(9, " ".join(w[:100])), (None, " ".join(w[8:108])), (None, " ".join(w[8:108])), (4, " ".join(w[16:116])), (1, " ".join(w[60:]))]
    got = partenum.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.component_id) for r in got.collect()) == [(0, 4), (0, 4), (1, 1), (4, 4), (9, 4)]


@pytest.mark.parametrize("found, columns", [(partenum._nearest, ("sketch",)), (partenum._open, ("sketch",)), (partenum._joining, ("features", "sketch"))])
def test_a_bucket_gives_no_more_rows_than_members(found, columns):
    """Of one large bucket of near copies, half of them just too far apart."""
    draw = np.random.default_rng(10)
    base = draw.integers(0, 2**63, 200, dtype=np.uint64)
    sets = []
    for i in range(600):
        e = base.copy()
        at = draw.choice(200, draw.integers(5, 15) if i % 2 else 30, replace=False)
        e[at] = draw.integers(0, 2**63, len(at), dtype=np.uint64)
        sets.append(np.unique(e))
    k = len(sets)
    zero = np.zeros(k, np.int64)
    table = pa.table({"bucket": zero, "i": zero, "j": zero, "block": zero, "node": np.arange(k), "component": np.arange(k), "n": [len(e) for e in sets], "sketch": [partenum._sketch(e) for e in sets], "features": [e.tobytes() for e in sets]})
    out = partenum._each_bucket(found, columns, 80, 100)(table)
    assert 0 < len(out) <= k
    if found is partenum._joining:
        links = {(i, j) for i in range(k) for j in range(i) if 100 * (s := len(np.intersect1d(sets[i], sets[j], assume_unique=True))) >= 80 * (len(sets[i]) + len(sets[j]) - s)}

        def least(pairs):
            root = list(range(k))
            for _ in range(k):
                before = list(root)
                for a, b in pairs:
                    root[a] = root[b] = min(root[a], root[b])
                if root == before:
                    return root

        pairs = list(zip(out.column("a").to_pylist(), out.column("b").to_pylist()))
        assert least(pairs) == least(links) and len(pairs) == k - len(set(least(links)))


def test_signatures_meet_for_every_linked_pair():
    draw = np.random.default_rng(9)
    bands = partenum.Bands(80, 100)
    for size in (1, 2, 3, 4, 5, 7, 9, 10, 13, 20, 33, 60, 63, 64, 81, 150, 400):
        for _ in range(30):
            a = np.unique(draw.integers(0, 2**63, size, dtype=np.uint64))
            drop = draw.integers(0, len(a) // 5 + 1)
            b = np.unique(np.concatenate([a[draw.permutation(len(a))[drop:]], draw.integers(0, 2**63, int((len(a) - drop - 0.8 * len(a)) / 0.8) if len(a) - drop > 0.8 * len(a) else 0, dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared < 80 * (len(a) + len(b) - shared):
                continue
            frequent = np.sort(draw.choice(a, len(a) // 3, replace=False)) if size > 3 else np.empty(0, np.uint64)
            sig, owner, _ = partenum.signatures(bands, np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), frequent)
            assert np.intersect1d(sig[owner == 0], sig[owner == 1]).size


# pieces


@given(st.lists(st.text(max_size=40), max_size=5), st.integers(0, 2**63))
@settings(max_examples=60, deadline=None)
def test_round_trip(found, seed):
    pieces = test_round_trip.pieces = getattr(test_round_trip, "pieces", None) or sampling.Pieces()
    found = [t.encode("utf-8", "replace").decode() for t in found]
    for a, b, data, offsets in textkernel.string_slices(pa.array(found, pa.string()), 64):
        ids, bounds = pieces.encode(data, offsets, np.full(b - a, seed, dtype=np.uint64))
        assert [t.decode() for t in pieces.decode(ids, bounds)] == found[a:b]


def drawn(pieces, unit, n):
    raw = unit.encode()
    data, offsets = np.frombuffer(raw * n, np.uint8), np.arange(n + 1) * len(raw)
    ids, bounds = pieces.encode(data, offsets, np.arange(n, dtype=np.uint64))
    return collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:]))


def segmentations(pieces, unit):
    """Weight of each segmentation of a unit, from enumerating all of them."""
    by_text = {}
    for i, w in zip(pieces.ids.tolist(), pieces.weight.tolist()):
        by_text[pieces.decode_one(i)] = (i, w)
    raw, found = b" " + unit.encode(), {}

    def walk(at, ids, weight):
        if at == len(raw):
            found[ids] = weight
        for j in range(at + 1, len(raw) + 1):
            if raw[at:j] in by_text:
                i, w = by_text[raw[at:j]]
                walk(j, (*ids, i), weight * w)

    walk(0, (), 1.0)
    return found


@pytest.mark.filterwarnings("error")
def test_shares_equal_enumeration_whatever_stands_before():
    pieces = sampling.Pieces()
    share = segmentations(pieces, "datenbank")
    total, n = sum(share.values()), 3000
    seen = drawn(pieces, "datenbank", n)
    for k, w in share.items():
        assert seen[k] / n == pytest.approx(w / total, abs=0.035)
    for times in (11, 12, 30):  # rare letters of three bytes each; the last makes a long unit
        odd = drawn(pieces, "ꙮ" * times + "datenbank", 1000)
        tails = segmentations(pieces, "ꙮdatenbank")
        total = sum(tails.values())
        got = collections.Counter()
        for ids, times_seen in odd.items():
            got[ids[-4:]] += times_seen
        want = collections.Counter()
        for ids, w in tails.items():
            want[(*[pieces.byte_id(b) for b in "ꙮ".encode()] * times, *ids[4:])[-4:]] += w / total
        for k, w in want.items():
            assert got[k] / 1000 == pytest.approx(w, abs=0.06)


def test_long_units_equal_side_by_side_sums():
    pieces, draw = sampling.Pieces(), np.random.default_rng(3)
    text = "".join(draw.choice(list("abcdeinrstäß漢ꙮ"), 5000))
    chars = np.frombuffer((" " + text).encode(), np.uint8)
    log = pieces.prefixes(chars)
    for n in (1, 7, 30, 64):
        state, share, taken, ids = pieces.choices(chars[None, :n], 0)
        for j in range(1, n + 1):
            on = state == j - 1
            mine = np.cumsum([math.exp(log[j - k] - log[j]) * pieces.weight[np.flatnonzero(pieces.ids == i)[0]] for k, i in zip(taken[on], ids[on])])
            assert share[on] == pytest.approx(mine, rel=1e-4) and share[on][-1] == pytest.approx(1, rel=1e-4)
    data = np.frombuffer(text.encode() * 2, np.uint8)
    ids, bounds = pieces.encode(data, np.array([0, len(data) // 2, len(data)]), np.array([5, 5], dtype=np.uint64))
    assert [t.decode() for t in pieces.decode(ids, bounds)] == [text, text] and (ids[: bounds[1]] == ids[bounds[1] :]).all()
    blocks = pieces.lattice.ending(chars, 0, len(chars))
    assert (pieces.lattice.ending(chars, 777, 3000) == blocks[777:3000]).all()


def test_long_words_sum_over_all_segmentations():
    model = langid.Model(langid.read_pieces(), ["a", "b"])
    draw = np.random.default_rng(4)
    model.p[:-1] = draw.random((model.n, 2)) ** 20 + 1e-9
    model.p[:-1] /= model.p[:-1].sum(axis=0)
    words = [b" " + "".join(draw.choice(list("abcdeinrstäß漢ꙮ"), n)).encode() for n in (3, 20, 40, 60, 5000)]
    got = model.likelihood(words)
    for w, row in zip(words, got):
        one = model.lattice.forward(np.frombuffer(w, np.uint8)[None, :64], model.p)[0]
        assert model.lattice.forward_long(np.frombuffer(w, np.uint8)[:64], model.p) == pytest.approx(one, rel=1e-9)
        assert np.isfinite(row).all()
        if len(w) < 12:  # by hand
            by = {p: i for i, p in enumerate(langid.read_pieces())}

            def ways(at):
                return np.ones(2) if at == len(w) else sum((model.p[by[w[at:j]]] * ways(j) for j in range(at + 1, len(w) + 1) if w[at:j] in by), np.zeros(2))

            assert row == pytest.approx(np.log(ways(0)))


def test_samples_follow_the_lattice():
    pieces = sampling.Pieces()
    n = 4000
    raw = b"the"
    data, offsets = np.frombuffer(raw * n, np.uint8), np.arange(n + 1) * 3
    ids, bounds = pieces.encode(data, offsets, np.arange(n, dtype=np.uint64))
    again, _ = pieces.encode(data, offsets, np.arange(n, dtype=np.uint64))
    assert (ids == again).all()
    weight = dict(zip(pieces.ids.tolist(), pieces.weight.tolist()))
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:]))
    share = {k: math.prod(weight[i] for i in k) for k in seen}
    total = sum(share.values())
    assert len(seen) > 1
    for k, times in seen.most_common(3):
        assert times / n == pytest.approx(share[k] / total, abs=0.05)


# toxicity


def test_kernel_equals_brute_force():
    import itertools

    def brute(s, t, p):
        total = 0.0
        for i in itertools.combinations(range(len(s)), p):
            for j in itertools.combinations(range(len(t)), p):
                if [s[k] for k in i] == [t[k] for k in j]:
                    total += float(toxicity.DECAY) ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    for s, t in ((b"idiot", b"idxiot"), (b"moron", b"moon"), (b"aaaa", b"aaa"), (b"ab", b"ba")):
        got = toxicity._subsequences(toxicity._matrix([s]), toxicity._matrix([t]))[:, 0]
        assert got == pytest.approx([brute(s, t, p) for p in toxicity.ORDERS], rel=1e-4)


def test_held_out_toxicity_and_gapped_insults(spark):
    clean = ["a fine day in the garden with many flowers", "the train leaves at nine from the old station", "we read books and drink tea by the fire", "rain falls on the hills and the river rises"]
    insults = ["idiot", "moron", "stupid"]
    draw = np.random.default_rng(4)
    rows = [(i, f"{clean[i % 4]} number{draw.integers(10**6)} word{draw.integers(10**6)} " + (f"you {insults[i % 3]} friend{draw.integers(10**6)}" if i % 2 else "and so on")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs.where("doc_id < 300"), labels)
    found = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((found[i] >= 0.7) == bool(i % 2) for i in range(300, 400))
    gapped = model.score(pa.array(["you i-d.i_o*t", "you m o r o n", "you idxiot", "you stuppid", "the station"]))
    assert (gapped[:2] >= 0.7).all() and (gapped[2:4] > gapped[4]).all() and gapped[4] < 0.3


def test_spaced_out_letters_of_several_bytes_are_joined():
    texts = ["l ä s t i g e r", "x д у р а к", "m o r o n", "é t", "ab д у"]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    buf, start, end, text = toxicity.word_units(np.frombuffer(data, np.uint8), offsets)
    found = {(int(t), buf[a:b].tobytes().decode()) for a, b, t in zip(start, end, text)}
    assert {x for x in found if len(x[1]) > 2} == {(0, "lästiger"), (1, "xдурак"), (2, "moron")}


# archives


def test_loser_tree():
    draw = np.random.default_rng(6)
    for k in (0, 1, 2, 3, 7, 8, 13):
        runs = [sorted(draw.integers(0, 20, draw.integers(0, 9)).tolist()) for _ in range(k)]
        out = [(runs[i][j], i, j) for i, j in warc.LoserTree(runs)]
        assert out == sorted(out) and len(out) == sum(map(len, runs))


def test_archives_are_valid_and_ordered(spark):
    scratch = Scratch(spark, "test")
    path = scratch.path("w")
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    pages = pages.union(pages.select(F.col("page_id") + 1000, "url", "html")).repartition(5)
    warc.write_archives(pages, path)
    rows = warc.read_index(spark, path, scratch).orderBy("index_range", "index_slot").collect()
    assert [r.sort_key for r in rows] == sorted(r.sort_key for r in rows) and len(rows) == pages.count()
    html = {r.page_id: r.html.encode() for r in pages.collect()}
    for r in rows:
        body = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", r.page_id + 1000) if len(body) >= 1000 and r.page_id < 1000 else ("response", None))


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/A/?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/" and warc.url_key("") == ")/"


# pipeline


def test_pipeline_stages(spark, texts):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = cp.language(spark, docs, SMALL)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
    wanted = components_of({i: shingles(t) for i, t in texts.items()})
    once = cp.dedupe(spark, docs, SMALL)
    assert {r.doc_id for r in once.collect()} == {i for i, c in wanted.items() if i == c}
    twice = cp.dedupe(spark, docs.union(docs), SMALL)
    assert sorted(r.doc_id for r in twice.collect()) == sorted(r.doc_id for r in once.collect())
    bad = {r.doc_id for r in registry.QUERIES["op6_wu_manber"](spark, SMALL).where("contaminated").collect()}
    assert {r.doc_id for r in cp.decontaminate(spark, docs, SMALL).collect()} == set(texts) - bad
    new = cp.pseudonymise(spark, docs, SMALL)
    assert new.columns == docs.columns and all(r.n_chars == len(r.text) for r in new.collect())
    last = cp.run(spark, SMALL).collect()
    assert last and all(r.lossless for r in last)
