"""Texts of documents, benchmark and pages; boxes made from lineitem numbers."""

from pyspark.sql import functions as F

from ..functions.expr import normalize_text as norm
from ..operators import geometry as G
from ..operators import texts as O
from . import query, read

NORM = "trim(regexp_replace(translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
ASCII = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9%$€£¥]+', ' ', 'g'))"


@query(f"SELECT doc_id, {NORM.format('text')} AS normalized FROM documents")
def text_normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", norm(F.col("text")).alias("normalized"))


def _flags() -> str:
    return ", ".join(f"CASE WHEN list_has_any(string_split(n, ' '), [{', '.join(repr(w) for w in v)}]) THEN 1 ELSE 0 END AS text_has_{k}" for k, v in O.KEYWORDS.items())


@query(f"SELECT conv_id, turn, CAST(length(text) AS INT) AS text_length, CAST(CASE WHEN length(n) > 0 THEN len(string_split(n, ' ')) ELSE 0 END AS INT) AS text_word_count, {_flags()} FROM (SELECT *, {NORM.format('text')} AS n FROM conversations)")
def text_features(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.withColumns(O.text_features(F.col("text"))).drop("text", "role")


FUZZY = f"""WITH a AS (SELECT p_partkey, {ASCII.format("p_name")} AS x, {ASCII.format("p_type || ' ' || p_brand")} AS y FROM part)"""


@query(f"{FUZZY} SELECT p_partkey, CAST(levenshtein(x, y) AS INT) AS distance, length(x) > 0 AND length(y) > 0 AND (x = y OR contains(x, y) OR contains(y, x) OR 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) >= 0.3) AS matches FROM a")
def fuzzy_match(spark, sf_dir):
    from ..functions.expr import normalize_ascii

    p = read(spark, sf_dir, "part").withColumn("other", F.concat_ws(" ", "p_type", "p_brand"))
    x, y = normalize_ascii(F.col("p_name")), normalize_ascii(F.col("other"))
    return p.select("p_partkey", F.levenshtein(x, y).alias("distance"), O.fuzzy_match(F.col("p_name"), F.col("other"), 0.3).alias("matches"))


TOKENS = "list_distinct([w FOR w IN string_split({0}, ' ') IF w <> ''])"


@query(f"WITH x AS (SELECT doc_id, unnest({TOKENS.format(ASCII.format('text'))}) AS w FROM documents), y AS (SELECT item_id, {TOKENS.format(ASCII.format('text'))} AS y FROM benchmark), z AS (SELECT item_id, len(y) AS n, unnest(y) AS w FROM y) SELECT item_id, doc_id, round(count(*)::DOUBLE / any_value(n), 6) AS overlap FROM x JOIN z USING (w) GROUP BY item_id, doc_id")
def token_overlap(spark, sf_dir):
    pairs = O.overlapping(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return pairs.select("item_id", "doc_id", F.round("overlap", 6).alias("overlap"))


LABELS = """SELECT p_partkey, CASE p_size % 12 WHEN 0 THEN '</s>' || p_brand WHEN 1 THEN 'Claim your reward now' WHEN 2 THEN p_type WHEN 3 THEN p_name WHEN 4 THEN 'Reviews: 5 stars' WHEN 5 THEN 'Up to 50% off' WHEN 6 THEN '$ 12.50' WHEN 7 THEN '20 EUR'
  WHEN 8 THEN 'Learn more' WHEN 9 THEN 'Privacy and terms' WHEN 10 THEN 'plain words here' END AS text, p_brand AS brand, CASE p_size % 2 WHEN 0 THEN 'Start playing' ELSE 'Claim your reward' END AS cta, p_type AS headline, p_name AS subhead, p_size / 50.0::DOUBLE AS y, p_retailprice / 100000.0::DOUBLE AS area FROM part"""
LABEL = "trim(regexp_replace(lower(trim(regexp_replace(coalesce({0}, ''), '</?s>', '', 'g'))), '[^a-z0-9%$]+', ' ', 'g'))"
LABELLED = f"""l AS ({LABELS}), n AS (SELECT p_partkey, {", ".join(f"{LABEL.format(c)} AS {c}" for c in ("text", "brand", "cta", "headline", "subhead"))}, y, area FROM l),
w AS (SELECT *, {", ".join(f"list_distinct([x FOR x IN string_split({c}, ' ') IF x <> '']) AS w_{c}" for c in ("text", "brand", "cta", "headline", "subhead"))} FROM n),
m AS (SELECT *, coalesce(len(list_intersect(w_text, w_brand))::DOUBLE / nullif(len(w_brand), 0), 0) AS o_brand, {", ".join(f"""CASE WHEN text = '' OR {c} = '' THEN 0 WHEN text = {c} THEN 1 WHEN contains(text, {c}) THEN 0.9 WHEN contains({c}, text) THEN CASE WHEN length(text)::DOUBLE / length({c}) >= 0.6 THEN 0.8 ELSE 0 END
  WHEN len(list_intersect(w_text, w_{c}))::DOUBLE / nullif(len(w_{c}), 0) >= 0.6 THEN len(list_intersect(w_text, w_{c}))::DOUBLE / len(w_{c}) ELSE 0 END AS m_{c}""" for c in ("cta", "headline", "subhead"))} FROM w)"""


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"


TYPED = f"""WITH {LABELLED}, k AS (SELECT p_partkey, CASE WHEN text <> '' AND brand <> '' AND (text = brand OR contains(text, brand) OR contains(brand, text) OR 1 - levenshtein(text, brand)::DOUBLE / greatest(length(text), length(brand)) >= 0.75) THEN ('brand_name', 0.92::DOUBLE)
  WHEN text <> '' AND brand <> '' AND o_brand >= 0.5 THEN ('brand_name', 0.82::DOUBLE) WHEN m_cta > 0 THEN ('cta_button', least(1, 0.80 + 0.15 * m_cta)::DOUBLE) WHEN m_headline > 0 THEN ('headline', least(1, 0.75 + 0.2 * m_headline)::DOUBLE) WHEN m_subhead > 0 THEN ('subheadline', least(1, 0.7 + 0.2 * m_subhead)::DOUBLE)
  WHEN {_any(O.SOCIAL_KEYWORDS)} THEN ('social_proof', 0.88::DOUBLE) WHEN {_any(O.PROMO_KEYWORDS)} THEN ('discount_badge', 0.88::DOUBLE) WHEN contains(text, '$') OR regexp_matches(text, '\\b\\d+[.,]?\\d*\\s*(%|off)\\b') OR {_any(O.CURRENCIES)} THEN ('price_tag', 0.85::DOUBLE)
  WHEN len([x FOR x IN string_split(text, ' ') IF x <> '']) <= 3 AND {_any(O.CTA_KEYWORDS)} THEN ('cta_button', 0.75::DOUBLE) WHEN {_any(O.LEGAL_KEYWORDS)} OR (y > 0.9 AND area < 0.01) THEN ('legal_text', 0.7::DOUBLE) ELSE ('other', 0.55::DOUBLE) END AS k FROM m)
SELECT p_partkey, k[1] AS kind, round(k[2], 6) AS confidence FROM k"""


def labels(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    size = F.col("p_size") % 12
    text = F.when(size == 0, F.concat(F.lit("</s>"), "p_brand")).when(size == 1, F.lit("Claim your reward now")).when(size == 2, F.col("p_type")).when(size == 3, F.col("p_name"))
    for k, words in enumerate(("Reviews: 5 stars", "Up to 50% off", "$ 12.50", "20 EUR", "Learn more", "Privacy and terms", "plain words here"), 4):
        text = text.when(size == k, words)
    return p.select("p_partkey", text.alias("text"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 2 == 0, "Start playing").otherwise("Claim your reward").alias("cta"), F.col("p_type").alias("headline"), F.col("p_name").alias("subhead"), (F.col("p_size") / 50.0).alias("y"), (F.col("p_retailprice") / 100000.0).alias("area"))


@query(TYPED)
def text_classify(spark, sf_dir):
    kind = O.text_type(*[F.col(c) for c in ("text", "brand", "cta", "headline", "subhead", "y", "area")])
    return labels(spark, sf_dir).select("p_partkey", kind.alias("k")).select("p_partkey", "k.*")


@query(f"WITH {LABELLED} SELECT p_partkey, {', '.join(f'm_{c} > 0 AS {c}_matches, round(m_{c}, 6)::DOUBLE AS {c}_score' for c in ('cta', 'headline'))} FROM m")
def reference_matches(spark, sf_dir):
    rows = labels(spark, sf_dir)
    found = {c: O.reference_match(O.normalize_label(F.col("text")), O.normalize_label(F.col(c))) for c in ("cta", "headline")}
    return rows.select("p_partkey", *[x for c, m in found.items() for x in (m["matches"].alias(f"{c}_matches"), m["score"].alias(f"{c}_score"))])


@query("""WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages)
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, string_split(regexp_replace(path, '/$', ''), '/')[-1] AS basename, TRY_CAST(nullif(regexp_extract(path, '(\\d+)(?:\\.html)?/?$', 1), '') AS BIGINT) AS number, regexp_extract(path, '^/([a-z]{2})/', 1) AS language FROM p""")
def regex_ids(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in O.url_parts(F.col("url")).items()])


@query("SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY lang, word HAVING count(*) >= 5")
def explode_list(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", " ")).alias("word"))
    return words.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n")).where("n >= 5")


BOX = "SELECT l_orderkey, l_linenumber, [l_discount, l_tax, least(1, l_discount + l_quantity / 100), least(1, l_tax + l_quantity / 80)] AS a, [l_tax, l_discount, least(1, l_tax + 0.4), least(1, l_discount + 0.5)] AS b FROM lineitem"
WIDTHS = "greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2]))"


def boxes(spark, sf_dir):
    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    one = F.lit(1.0)
    a = F.array(d, t, F.least(one, d + q / 100), F.least(one, t + q / 80))
    b = F.array(t, d, F.least(one, t + 0.4), F.least(one, d + 0.5))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.clamped(a).alias("a"), G.clamped(b).alias("b"))


@query(f"WITH x AS ({BOX}), y AS (SELECT *, {WIDTHS} AS i, (a[3] - a[1]) * (a[4] - a[2]) AS u, (b[3] - b[1]) * (b[4] - b[2]) AS v FROM x) SELECT l_orderkey, l_linenumber, round(coalesce(i / nullif(u + v - i, 0), 0), 6) AS iou FROM y")
def bbox_iou(spark, sf_dir):
    return boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(G.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query(f"WITH x AS ({BOX}), y AS (SELECT (a[1] + a[3]) / 2 AS cx, (a[2] + a[4]) / 2 AS cy FROM x) SELECT CASE WHEN cy < 1 / 3 THEN 'top' WHEN cy < 2 / 3 THEN 'middle' ELSE 'bottom' END AS row_zone, CASE WHEN cx < 0.33 THEN 'left' WHEN cx < 0.66 THEN 'center' ELSE 'right' END AS column_zone, count(*) AS n FROM y GROUP BY ALL")
def zone_assign(spark, sf_dir):
    c = G.center(F.col("a"))
    return boxes(spark, sf_dir).select(G.vertical_zone(c[1]).alias("row_zone"), G.horizontal_zone(c[0], exact=False).alias("column_zone")).groupBy("row_zone", "column_zone").agg(F.count("*").alias("n"))


HSV = """rgb AS (SELECT l_discount * 10 AS r, l_tax * 12 AS g, l_quantity / 50 AS b FROM lineitem), x AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM rgb),
hsv AS (SELECT v, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s, CASE WHEN d = 0 THEN 0 WHEN v = r THEN CASE WHEN (60 * (g - b) / d) % 360 < 0 THEN ((60 * (g - b) / d) % 360 + 360) % 360 ELSE (60 * (g - b) / d) % 360 END WHEN v = g THEN 60 * (b - r) / d + 120 ELSE 60 * (r - g) / d + 240 END AS h FROM x)"""


@query(f"""WITH {HSV} SELECT color, count(*) AS n FROM (SELECT CASE WHEN v < 0.15 THEN 'black' WHEN s < 0.10 AND v > 0.85 THEN 'white' WHEN s < 0.15 THEN 'gray' WHEN h < 15 OR h >= 345 THEN 'red' WHEN h < 40 THEN 'orange' WHEN h < 70 THEN 'yellow' WHEN h < 160 THEN 'green'
  WHEN h < 195 THEN 'teal' WHEN h < 255 THEN 'blue' WHEN h < 290 THEN 'purple' ELSE 'pink' END AS color FROM hsv) GROUP BY color""")
def color_names(spark, sf_dir):
    c = [F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50]
    return read(spark, sf_dir, "lineitem").select(G.color_name(*c).alias("color")).groupBy("color").agg(F.count("*").alias("n"))


ELEMENTS = """e AS (SELECT l_orderkey AS image, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'circle' WHEN 1 THEN 'rounded_card' WHEN 2 THEN 'card_portrait' ELSE 'shape' END AS shape, l_discount * l_tax AS area, l_quantity / 50 AS x, CASE WHEN l_orderkey % 3 = 0 THEN 0.5 + l_tax / 2 ELSE l_discount * 8 END AS y, l_linenumber + 1 AS vertices FROM lineitem),
cards AS (SELECT *, floor(y * 20) AS level FROM e WHERE area >= 0.0025), levels AS (SELECT image, count(*) AS rows, max(n) AS cols FROM (SELECT image, level, count(*) AS n FROM cards GROUP BY ALL HAVING count(*) >= 2) GROUP BY image),
heroes AS (SELECT DISTINCT c.image FROM cards c JOIN cards r ON c.image = r.image AND c.shape = 'circle' AND contains(r.shape, 'card') AND c.area > 0.02 AND r.area > 0.02 AND abs(c.x - r.x) < 0.3 AND abs(c.y - r.y) < 0.2),
images AS (SELECT image, count(*) FILTER (area >= 0.0025) AS n, count(*) FILTER (area < 0.0025 AND shape = 'circle') AS dots, max(y) FILTER (area >= 0.0025) - min(y) FILTER (area >= 0.0025) AS span,
  bool_or(x > 0.8 AND area > 0.002 AND area < 0.03 AND vertices <= 5 AND shape IN ('shape', 'card_portrait')) AS arrow FROM e GROUP BY image),
laid AS (SELECT i.*, n >= 4 AND coalesce(rows, 0) >= 2 AS grid, rows, cols, h.image IS NOT NULL AS hero FROM images i LEFT JOIN levels USING (image) LEFT JOIN heroes h USING (image))"""


@query(f"""WITH {ELEMENTS} SELECT image, CASE WHEN grid THEN 'grid_' || rows || 'x' || cols WHEN n >= 3 AND span < 0.08 THEN 'carousel_3' WHEN n = 2 AND span < 0.08 THEN 'dual_product' WHEN hero THEN 'hero_shapes' WHEN n = 1 THEN 'single_product' WHEN n = 0 THEN 'minimal' ELSE 'multi_product_' || n END AS layout_template,
  n AS product_card_count, dots AS pagination_dot_count, dots >= 2 AS has_pagination_dots, grid AS has_grid_layout, arrow AS has_carousel_indicator FROM laid""")
def layout_patterns(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    shape = F.element_at(F.array(*map(F.lit, ("circle", "rounded_card", "card_portrait", "shape"))), F.col("l_linenumber") % 4 + 1)
    y = F.when(F.col("l_orderkey") % 3 == 0, 0.5 + F.col("l_tax") / 2).otherwise(F.col("l_discount") * 8)
    element = F.struct(shape.alias("shape"), (F.col("l_discount") * F.col("l_tax")).alias("area"), (F.col("l_quantity") / 50).alias("x"), y.alias("y"), (F.col("l_linenumber") + 1).alias("vertices"))
    grouped = line.select(F.col("l_orderkey").alias("image"), element.alias("e")).groupBy("image").agg(F.collect_list("e").alias("elements"))
    laid = grouped.select("image", *[c.alias(n) for n, c in G.layout_template(F.col("elements")).items()])
    return laid.withColumns({c: F.col(c).cast("long") for c in ("product_card_count", "pagination_dot_count")})


TFIDF = f"""
words AS (SELECT doc_id AS id, [x FOR x IN regexp_split_to_array({NORM.format('text')}, '[^\\p{{L}}\\p{{N}}_]+') IF length(x) >= 2] AS w FROM documents),
tok AS (SELECT id, unnest(w) AS term FROM words UNION ALL SELECT id, a || ' ' || b FROM (SELECT id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM words WHERE len(w) > 1)),
cnt AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM cnt GROUP BY term),
raw AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS raw FROM cnt JOIN dfs USING (term), (SELECT count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL)),
w AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)"""
BRIEF = "the action and the entertion of the and"


@query(f"WITH {TFIDF} SELECT term, count(*) AS n, round(sum(weight), 5) AS total FROM w GROUP BY term HAVING count(*) >= 50")
def tfidf_terms(spark, sf_dir):
    w = O.tfidf(read(spark, sf_dir, "documents"), "doc_id", "text")
    return w.groupBy("term").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 5).alias("total")).where("n >= 50")


@query(f"WITH {TFIDF}, bw AS (SELECT string_split('{BRIEF}', ' ') AS w), q AS (SELECT term, count(*) AS t FROM (SELECT unnest(w) AS term FROM bw UNION ALL SELECT a || ' ' || b FROM (SELECT unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM bw)) GROUP BY term) SELECT id, round(sum(weight * t / (SELECT sqrt(sum(t * t)) FROM q)), 6) AS similarity FROM w JOIN q USING (term) GROUP BY id")
def tfidf_brief_match(spark, sf_dir):
    return O.brief_match(O.tfidf(read(spark, sf_dir, "documents"), "doc_id", "text"), BRIEF, spark)


ALIASES = {"en": ("the", "and", "of"), "de": ("der", "und", "die"), "fr": ("le", "et", "les"), "es": ("el", "los", "una")}


def _counted(words) -> str:
    return " + ".join(f"len(regexp_extract_all({NORM.format('text')}, '\\b{w}\\b'))" for w in words)


@query(f"WITH c AS (SELECT doc_id, {', '.join(f'{_counted(v)} AS n_{k}' for k, v in ALIASES.items())} FROM documents) SELECT doc_id, CASE WHEN greatest({', '.join(f'n_{k}' for k in ALIASES)}) = 0 THEN NULL {' '.join(f'WHEN n_{k} = greatest({chr(44).join(f"n_{j}" for j in ALIASES)}) THEN {chr(39)}{k}{chr(39)}' for k in ALIASES)} END AS inferred FROM c")
def infer_vertical(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", O.inferred_group(F.col("text"), ALIASES).alias("inferred"))


def _one(kind: str, where: str) -> str:
    return f"(SELECT (SELECT p_type FROM part WHERE {where} GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1) AS {kind}_p_type, median(p_size) AS s, median(p_retailprice) AS r FROM part WHERE {where})"


@query(f"SELECT good_p_type, bad_p_type, round(CASE WHEN abs(g.s - b.s) >= 0.05 THEN g.s - b.s END, 6) AS delta_p_size, round(CASE WHEN abs(g.r - b.r) >= 0.05 THEN g.r - b.r END, 6) AS delta_p_retailprice FROM {_one('good', 'p_size % 5 = 0')} g, {_one('bad', 'p_size % 5 = 1')} b")
def brief_guidance(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return O.guidance(p.where("p_size % 5 = 0"), p.where("p_size % 5 = 1"), ("p_size", "p_retailprice"), ("p_type",))
