"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one regular expression; names by their title or by a common given name
before a surname, and wherever a name found in a text occurs in it again on its own. Each distinct entity gets a keyed surrogate of
its own type: same format, script and (for names) gender. A surrogate is checked against all
others and against all entities found in the corpus; of those that collide one stays and the
others draw again, so distinct entities stay distinct, no surrogate is another person's real
datum, and one entity has one surrogate wherever it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

KEY = "casewise"
MOST_DRAWS = 64

MALE = "Mr|Sir|Herr|Señor|Sr|Monsieur|Господин"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Señora|Sra|Madame|Mme|Госпожа"
_NAME = r"\p{Lu}[\p{Ll}'’-]{1,30}+"
#: Common given names that aren't common words of another kind.
GIVEN_M = "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Steven|Andrew|Kenneth|Kevin|Brian|George|Edward|Peter|Paul|Hans|Klaus|Jürgen|Wolfgang|Stefan|Andreas|Jean|Pierre|Michel|Philippe|Jacques|Antoine|Carlos|José|Juan|Miguel|Pedro|Diego|Иван|Сергей|Дмитрий|Алексей|Андрей"
GIVEN_F = "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Margaret|Sandra|Ashley|Emily|Michelle|Laura|Anna|Maria|Julia|Ursula|Monika|Petra|Sabine|Claudia|Marie|Isabelle|Sophie|Camille|Nathalie|Carmen|Lucía|Elena|Ana|Pilar|Ольга|Наталья|Екатерина|Татьяна|Елена"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ -]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)",
    "secret": r"""(?<=["'])(?<=(?i:token|secret|password|passwd|api_?key|access_?key)[^\w"']{0,8}[=:][^\w"']{0,8}["'])[^"'\s]{8,200}+(?=["'])|(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?!\w)""",
    "name": rf"(?<!\w)(?:{MALE}|{FEMALE})\.? {_NAME}(?: {_NAME})?",
    "full_name": rf"(?<!\w)(?:{GIVEN_M}|{GIVEN_F}) {_NAME}",
}
PATTERN = "|".join(PATTERNS.values())

#: Parts of made-up names by script; given names end by gender.
SYLLABLES = {
    "latin": ("ba ca da fa ga la ma na ra sa be de le me ne re se te ve bi di li mi ni ri si ti vi bo co do lo mo no ro so to vo lu mu nu ru".split(), "n s rd l".split(), "na la ra tta".split()),
    "cyrillic": ("ба ва га да ка ла ма на ра са бе ве де ле ме не ре се те би ви ди ли ми ни ри си ти бо во до ло мо но ро со то лу му ну ру".split(), "н в р с".split(), "на ла ра ва".split()),
    "greek": ("βα γα δα κα λα μα να ρα σα βε δε λε με νε ρε σε τε βι δι λι μι νι ρι σι τι βο δο λο μο νο ρο σο το λου μου νου ρου".split(), "ος ης ας ων".split(), "να λα ρα τη".split()),
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _number(seed: Column, place: int, below: Column | int) -> Column:
    """A number below ``below`` drawn from the seed."""
    return F.pmod(F.xxhash64(seed, F.lit(place)), F.lit(below) if isinstance(below, int) else below)


def _padded(seed: Column, place: int, width: int) -> Column:
    return F.lpad(_number(seed, place, 10**width).cast("string"), width, "0")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one not doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _shaped(value: Column, seed: Column) -> Column:
    """Other characters of the same classes: digits, hexadecimal and other letters by case and script."""
    hexadecimal = value.rlike("^[0-9a-fA-F]+$")

    def other(c: Column, i: Column) -> Column:
        draw = F.xxhash64(seed, i)
        pick = lambda letters: F.substring(F.lit(letters), (F.pmod(draw, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
        low, cyrillic, greek = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω"
        out = F.when(hexadecimal & c.rlike("[0-9a-f]"), pick("0123456789abcdef")).when(hexadecimal, pick("0123456789ABCDEF"))
        out = out.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), pick(low)).when(c.rlike("[A-Z]"), pick(low.upper()))
        out = out.when(c.rlike(r"\p{IsCyrillic}"), F.when(c == F.upper(c), F.upper(pick(cyrillic))).otherwise(pick(cyrillic)))
        out = out.when(c.rlike(r"\p{IsGreek}"), F.when(c == F.upper(c), F.upper(pick(greek))).otherwise(pick(greek)))
        return out.when(c.rlike(r"\p{L}"), F.when(c == F.upper(c), pick(low.upper())).otherwise(pick(low))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _made_name(kind: Column, value: Column, seed: Column, draw: Column) -> Column:
    def of(script: str) -> Column:
        middle, male, female = SYLLABLES[script]
        pick = lambda parts, place: F.element_at(F.array(*map(F.lit, parts)), (_number(seed, place, len(parts)) + 1).cast("int"))
        end = F.when(kind == "given_f", pick(female, 0)).otherwise(pick(male, 0))
        more = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2) + F.when(kind == "surname", 1).otherwise(0) + F.floor(draw / 2).cast("int")), lambda i: F.element_at(F.array(*map(F.lit, middle)), (F.pmod(F.xxhash64(seed, i), F.lit(len(middle))) + 1).cast("int"))), "")
        return F.initcap(F.concat(more, end))

    return F.when(value.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(value.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def surrogate(kind: Column, value: Column, key: str, draw: Column) -> Column:
    """A surrogate for a canonical value; later draws have larger domains."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, value, draw.cast("string")).cast("binary"), 256)
    early = draw < 3
    domain = F.substring_index(value, "@", -1)
    host = F.concat(F.lit("m"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), domain).cast("binary"), 256), 1, 10), F.lit(".example.com"))
    email = F.concat(_shaped(F.substring_index(value, "@", 1), seed), F.when(early, F.lit("")).otherwise(F.substring(seed, 1, 6)), F.lit("@"), host)
    ipv4 = F.when(early, F.concat_ws(".", F.lit("10"), *[_number(seed, i, 256).cast("string") for i in range(3)])).otherwise(F.concat_ws(".", *[(_number(seed, i, 223) + 1).cast("string") for i in range(4)]))
    area = (_number(seed, 1, 800) + 200).cast("string")
    exchange = F.when(early, F.lit("555")).otherwise((_number(seed, 2, 800) + 200).cast("string"))
    american = (F.length(value) == 11) & value.startswith("1")
    phone = F.when(american, F.concat(F.lit("1"), area, exchange, _padded(seed, 3, 4))).otherwise(F.concat(F.substring(value, 1, 2), F.substring(_padded(seed, 4, 18), F.lit(1), F.length(value) - 2)))
    ssn = F.concat((_number(seed, 1, 100) + 900).cast("string"), _padded(seed, 2, 2), _padded(seed, 3, 4))
    body = F.concat(F.substring(value, 1, 1), F.substring(_padded(seed, 1, 18), F.lit(1), F.length(value) - 2))
    card = F.concat(body, F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
    out = F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "card", card)
    return out.when(kind == "secret", _shaped(value, seed)).otherwise(_made_name(kind, value, seed, draw))


def _kind(found: Column) -> Column:
    out = F.when(found.contains("@"), "email")
    for name in ("ipv4", "ssn", "card"):
        out = out.when(found.rlike(f"^(?:{PATTERNS[name]})$"), name)
    return out.when(found.rlike(rf"^(?:{MALE}|{FEMALE})\.? {_NAME}"), "name").when(found.rlike(rf"^(?:{GIVEN_M}|{GIVEN_F}) {_NAME}$"), "full_name").when(found.rlike(r"^[+(\d][\d ().+-]+$") & (F.length(_digits(found)) >= 8), "phone").otherwise("secret")


def _pieces(found: Column) -> Column:
    """What a match is made of: literal text and entities as (lit, kind, value)."""
    none = F.lit(None).cast("string")
    kind = _kind(found)
    digits = _digits(found)
    value = F.when(kind == "email", F.lower(found)).when(kind == "phone", F.when(F.length(digits) == 10, F.concat(F.lit("1"), digits)).otherwise(digits))
    value = value.when(kind.isin("card", "ssn"), digits).otherwise(found)
    real = (kind != "card") | (F.pmod(_luhn(digits), F.lit(10)) == 0)
    plain = F.array(F.struct(found.alias("lit"), F.when(real, kind).alias("kind"), F.when(real, value).alias("value")))
    parts = F.split(found, " ")
    given = F.when(found.rlike(rf"^(?:{FEMALE})\b"), F.lit("given_f")).otherwise(F.lit("given_m"))
    piece = lambda lit, kind, value: F.struct(lit.alias("lit"), kind.alias("kind"), value.alias("value"))
    title = piece(F.concat(parts[0], F.lit(" ")), none, none)
    last = F.element_at(parts, -1)
    names = F.when(F.size(parts) == 3, F.array(title, piece(F.get(parts, 1), given, F.initcap(F.get(parts, 1))), piece(F.lit(" "), none, none), piece(last, F.lit("surname"), F.initcap(last)))).otherwise(F.array(title, piece(last, F.lit("surname"), F.initcap(last))))
    called = F.when(parts[0].rlike(rf"^(?:{GIVEN_F})$"), F.lit("given_f")).otherwise(F.lit("given_m"))
    full = F.array(piece(parts[0], called, F.initcap(parts[0])), piece(F.lit(" "), none, none), piece(last, F.lit("surname"), F.initcap(last)))
    return F.when(kind == "name", names).when(kind == "full_name", full).otherwise(plain)


def _woven(text: Column, pattern: Column, pieces) -> Column:
    """Text cut at a pattern's matches: literal gaps, and ``pieces`` of each match."""
    none = F.lit(None).cast("string")
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    return F.flatten(F.zip_with(gaps, found, lambda gap, match: F.concat(F.array(F.struct(gap.alias("lit"), none.alias("kind"), none.alias("value"))), F.when(match.isNotNull(), pieces(match)).otherwise(F.array()))))


def _mentions(pieces: Column) -> Column:
    """Pieces with the names among them found again in the literal text, as whole words, as they were written."""
    names = F.array_distinct(F.filter(pieces, lambda p: p["kind"].isin("given_m", "given_f", "surname")))
    listed = F.array_join(F.array_distinct(F.transform(names, lambda p: p["lit"])), "|")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), listed, F.lit(r")(?![\p{L}\p{N}])"))
    again = F.transform(pieces, lambda p: F.when(p["kind"].isNotNull(), F.array(p)).otherwise(_woven(p["lit"], pattern, lambda m: F.slice(F.filter(names, lambda n: n["lit"] == m), 1, 1))))
    return F.when(F.size(names) > 0, F.flatten(again)).otherwise(pieces)


def _written(raw: Column, kind: Column, new: Column) -> Column:
    """The surrogate in the format of this occurrence: digits in place, capitals kept."""
    digits = F.substring(new, F.length(new) - F.length(_digits(raw)) + 1, F.length(_digits(raw)))
    state = lambda k, out: F.struct(k.cast("int").alias("k"), out.alias("out"))
    filled = F.aggregate(
        F.split(raw, ""),
        state(F.lit(1), F.lit("")),
        lambda s, c: F.when(c.rlike("[0-9]"), state(s["k"] + 1, F.concat(s["out"], F.substring(digits, s["k"], F.lit(1))))).otherwise(state(s["k"], F.concat(s["out"], c))),
        lambda s: s["out"],
    )
    upper = (raw == F.upper(raw)) & raw.rlike(r"\p{Lu}.*\p{Lu}")
    return F.when(kind.isin("phone", "card", "ssn"), filled).when(upper & kind.isin("email", "given_m", "given_f", "surname"), F.upper(new)).otherwise(new)


def assign(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, value, new) for distinct (kind, value): new is nobody's value and nobody else's surrogate."""
    known = scratch.table(entities, "entities")
    done, todo = None, known.select("kind", "value", F.lit(0).alias("draw"))
    for _ in range(MOST_DRAWS):
        drawn = todo.withColumn("new", surrogate(F.col("kind"), F.col("value"), key, F.col("draw")))
        first = drawn.groupBy("kind", "new").agg(F.min("value").alias("value"))
        first = first.join(known.select("kind", F.col("value").alias("new")), ["kind", "new"], "left_anti")
        if done is not None:
            first = first.join(done.select("kind", "new"), ["kind", "new"], "left_anti")
        kept = scratch.table(first.select("kind", "value", "new"), "kept")
        done = kept if done is None else done.union(kept)
        todo = scratch.table(todo.join(kept, ["kind", "value"], "left_anti").withColumn("draw", F.col("draw") + 1), "again")
        if not todo.take(1):
            return done
    raise RuntimeError(f"surrogates still collide after {MOST_DRAWS} draws")


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """(record, new_text, n_entities) for each row; record: the whole input row as a struct.

    Texts without an entity, empty ones among them, are as before; a null text stays null.
    Numbers that fail the Luhn check are no cards and stay. A name's parts are replaced wherever
    they stand alone in the same text, also where the word means something else there. Texts
    of any length are whole; rows that repeat and equal texts get equal results, an entity the
    same surrogate in all texts; of surrogates that collide the least value keeps its own. An
    empty table gives an empty result; other columns, whatever their names, stay in record.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(F.struct("*").alias("record"), F.col(text_col).alias("text"))
    text = F.col("text")  # cheap tests first: without an @ there is no email, and so on
    of = lambda *kinds: text.rlike("|".join(PATTERNS[k] for k in kinds))
    has = (text.contains("@") & of("email")) | (text.rlike("[0-9]") & of("ipv4", "phone", "ssn", "card")) | (text.rlike("[\"']|AKIA|gh[pousr]_|sk-") & of("secret")) | of("name", "full_name")
    has = F.coalesce(has, F.lit(False))
    clean = rows.where(~has).select("record", F.col("text").alias("new_text"), F.lit(0).cast("long").alias("n_entities"))

    rough = rows.where(has).select("record", "text", _woven(F.col("text"), F.lit(PATTERN), _pieces).alias("pieces"))
    marked = scratch.table(rough.select("record", _mentions(F.col("pieces")).alias("pieces"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("casewise"), "text").alias("h2")), "marked")

    each = marked.select("h1", "h2", F.posexplode("pieces").alias("at", "piece")).where("piece.kind IS NOT NULL")
    each = each.select("h1", "h2", "at", "piece.*").distinct()
    named = assign(each.select("kind", "value").distinct(), key, scratch)
    new = each.join(named, ["kind", "value"]).select("h1", "h2", F.struct("at", _written(F.col("lit"), F.col("kind"), F.col("new")).alias("new")).alias("one"))
    texts = new.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list("one")).alias("by_place"))
    joined = marked.join(texts, ["h1", "h2"], "left")
    by_place = F.coalesce("by_place", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>")))
    text = F.array_join(F.transform("pieces", lambda piece, i: F.coalesce(F.try_element_at(by_place, i), piece["lit"])), "")
    return clean.union(joined.select("record", text.alias("new_text"), F.size(by_place).cast("long").alias("n_entities")))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("record.doc_id").alias("doc_id"), F.col("new_text").alias("text"), "n_entities")
