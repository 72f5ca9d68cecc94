"""Local image descriptors that find cropped or edited copies.

Corners (Harris) are taken at several scales; each has an orientation, from the intensity
centroid around it, and 256 binary tests of smoothed intensities in a pattern turned to that
orientation. Hamming tables find images that may match: each table keeps a fixed choice of
``KEY_BITS`` bits, descriptors that agree on them share its key, and both sides' (key, image)
rows meet in an equi-join. An image that ``LEAST_VOTES`` of a query's descriptors meet is a
candidate; its descriptors and the query's are then all compared, and those within ``MOST_APART`` bits
must agree on one similarity transform (scale, turn, shift).

Neither side is collected or broadcast. A bitmap of fixed size tells which keys queries may
have, so images send few of their rows; it only spares rows. Equal images are searched once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .textkernel import U64, mix

SCALES = (1.0, 0.85, 0.72, 0.61)
CORNERS = (24, 16, 10, 6)  # at each scale, the strongest; more as an image exceeds AREA
AREA = 96 * 96
RADIUS = 12
TURNS = 60
PROBES = (0, 1, -1)  # a query's corners are also described turned by a bin, as an orientation may be off by one
TABLES, KEY_BITS = 16, 44  # keys of a descriptor, and the bits that each of them keeps
LEAST_VOTES = 3  # descriptors of a query that meet some descriptor of a candidate
SLOTS, MARKS = 27, 3  # the bitmap has 2 ** SLOTS bits (16 MB); bits that a key sets
MOST_APART = 48  # of 256 bits
LEAST_AGREEING = 6  # matches that agree on one transform
SHIFT_PIXELS = 3.0
APART = 3.0
BENT = 0.35

_draw = np.random.Generator(np.random.PCG64(20))
_TESTS = np.clip(_draw.normal(0, RADIUS / 2.2, (256, 2, 2)), -RADIUS, RADIUS)
_ANGLE = np.arange(TURNS) * (2 * np.pi / TURNS)
_ROTATED = np.rint(np.stack([np.stack([np.cos(a) * _TESTS[..., 0] - np.sin(a) * _TESTS[..., 1], np.sin(a) * _TESTS[..., 0] + np.cos(a) * _TESTS[..., 1]], -1) for a in _ANGLE])).astype(np.int64)
_MARGIN = int(np.abs(_ROTATED).max()) + 1
_MASKS = np.packbits([np.isin(np.arange(256), _draw.choice(256, KEY_BITS, replace=False)) for _ in range(TABLES)], axis=1).view(U64)
_DISC = np.array([(x, y) for x in range(-RADIUS + 1, RADIUS) for y in range(-RADIUS + 1, RADIUS) if x * x + y * y < RADIUS * RADIUS])


def read_pgm(data: bytes) -> np.ndarray | None:
    """Grey values of a binary PGM image of 8 bits; None if it isn't one."""
    head = data.split(maxsplit=4)
    if len(head) < 4 or head[0] != b"P5" or not all(x.isdigit() for x in head[1:4]):
        return None
    w, h, top = (int(x) for x in head[1:4])
    body = data[len(data) - w * h :]
    return np.frombuffer(body, np.uint8).reshape(h, w) if w * h and top == 255 and len(data) > w * h else None


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, dtype=np.uint8).tobytes()


def _smooth(x: np.ndarray) -> np.ndarray:
    """By 1 4 6 4 1 both ways, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (2, 2)
        p = np.pad(x, pad, mode="edge")
        n = x.shape[axis]
        at = lambda i: p[:, i : i + n] if axis == 1 else p[:, :, i : i + n]  # noqa: E731, B023
        x = (at(0) + at(4) + 4 * (at(1) + at(3)) + 6 * at(2)) / 16
    return x


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, of images [n, h, w]."""
    if scale == 1:
        return x
    size = [max(1, int(s * scale)) for s in x.shape[1:]]
    ys, xs = ((np.arange(n) + 0.5) / scale - 0.5 for n in size)
    ys, xs = np.clip(ys, 0, x.shape[1] - 1.001), np.clip(xs, 0, x.shape[2] - 1.001)
    y0, x0 = ys.astype(int), xs.astype(int)
    fy, fx = (ys - y0)[None, :, None].astype(np.float32), (xs - x0)[None, None, :].astype(np.float32)
    rows = x[:, y0] * (1 - fy) + x[:, np.minimum(y0 + 1, x.shape[1] - 1)] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, np.minimum(x0 + 1, x.shape[2] - 1)] * fx


def describe(images: np.ndarray, probes: tuple[int, ...] = (0,)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, (x, y, scale, turn), descriptor as four numbers) of the corners of images [n, h, w].

    With more ``probes`` the descriptors of a corner, each turned by so many bins, lie side by side.
    """
    owners, places, bits = [], [], []
    base = images.astype(np.float32)
    grown = max(1.0, images.shape[1] * images.shape[2] / AREA)
    for scale, most in zip(SCALES, CORNERS):
        most = int(most * grown)
        level = _smooth(_resized(base, scale))
        n, h, w = level.shape
        if min(h, w) <= 2 * _MARGIN + 2:
            continue
        gy, gx = np.gradient(level, axis=(1, 2))
        xx, yy, xy = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = strength[:, _MARGIN : h - _MARGIN, _MARGIN : w - _MARGIN]
        top = inner > 1.0
        for dy in (-2, -1, 0, 1, 2):
            for dx in (-2, -1, 0, 1, 2):
                if dx or dy:
                    top &= inner >= strength[:, _MARGIN + dy : h - _MARGIN + dy, _MARGIN + dx : w - _MARGIN + dx]
        who, y, x = np.nonzero(top)
        order = np.lexsort((-inner[who, y, x], who))
        who, y, x = who[order], y[order] + _MARGIN, x[order] + _MARGIN
        keep = np.arange(len(who)) - np.searchsorted(who, who) < most
        who, y, x = who[keep], y[keep], x[keep]
        around = level[who[:, None], y[:, None] + _DISC[:, 1], x[:, None] + _DISC[:, 0]]
        turn = np.arctan2((around * _DISC[:, 1]).sum(axis=1), (around * _DISC[:, 0]).sum(axis=1))
        owners.append(who)
        places.append(np.stack([(x + 0.5) / scale, (y + 0.5) / scale, np.full(len(x), 1 / scale), turn], axis=1).astype(np.float32))
        each = []
        for probe in probes:
            pattern = _ROTATED[(np.rint(turn / (2 * np.pi / TURNS)).astype(int) + probe) % TURNS]
            grey = level[who[:, None, None], y[:, None, None] + pattern[..., 1], x[:, None, None] + pattern[..., 0]]
            each.append(np.packbits(grey[..., 0] < grey[..., 1], axis=1).view(U64).reshape(len(x), 4))
        bits.append(np.concatenate(each, axis=1))
    if not owners:
        return np.empty(0, np.int64), np.empty((0, 4), np.float32), np.empty((0, 4 * len(probes)), U64)
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return who[order], np.concatenate(places)[order], np.concatenate(bits)[order]


_FEATURES = "id long, h1 long, h2 long, places binary, bits binary, probes binary"


def _describe(batches, probes: tuple[int, ...]):
    """Features of images; probes: descriptors that keys are taken from, where there are more than ``bits``."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            decoded = [None if x is None else read_pgm(x) for x in part.column("image").to_pylist()]
            places, bits, turned = ([b""] * len(decoded) for _ in range(3))
            for shape in {x.shape for x in decoded if x is not None}:
                rows = [i for i, x in enumerate(decoded) if x is not None and x.shape == shape]
                who, place, bit = describe(np.stack([decoded[i] for i in rows]), probes)
                at = np.searchsorted(who, np.arange(len(rows) + 1))
                for k, i in enumerate(rows):
                    own = bit[at[k] : at[k + 1]]
                    places[i], bits[i] = place[at[k] : at[k + 1]].tobytes(), own[:, :4].tobytes()
                    turned[i] = own.tobytes() if len(probes) > 1 else b""
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h1"), part.column("h2"), pa.array(places, pa.binary()), pa.array(bits, pa.binary()), pa.array(turned, pa.binary())], [x.split()[0] for x in _FEATURES.split(", ")])


def keys_of(bits: np.ndarray) -> np.ndarray:
    """Descriptors by tables: the hash of the table and of the bits that it keeps."""
    out = np.empty((len(bits), TABLES), dtype=U64)
    for t, mask in enumerate(_MASKS):
        kept, total = bits & mask, np.full(len(bits), t + 1, dtype=U64)
        for k in range(4):
            total = mix(total ^ kept[:, k])
        out[:, t] = total
    return out


_KEYS = "key long, id long, h1 long, place byte"


def _marks(key: np.ndarray) -> list[np.ndarray]:
    """Bits of the bitmap that a key sets."""
    out = []
    for _ in range(MARKS):
        out.append((key >> U64(64 - SLOTS)).astype(np.int64))
        key = mix(key)
    return out


def _deal(asked: np.ndarray | None, column: str):
    """(key, image, place of the descriptor modulo 64) rows; with a bitmap only of keys that it may have."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                raw = [x or b"" for x in part.column(column).to_pylist()]
                size = np.array([len(x) // 32 for x in raw])
                bits = np.frombuffer(b"".join(raw), U64).reshape(-1, 4)
                key = keys_of(bits).reshape(-1)
                owner = np.repeat(np.repeat(np.arange(len(raw)), size), TABLES)
                place = np.repeat(np.arange(len(bits)) - np.repeat(np.cumsum(size) - size, size), TABLES) % 64
                if asked is not None:
                    on = np.arange(len(key))
                    for k in range(MARKS):  # each mark spares most of what is left
                        slot = _marks(key[on])[k]
                        on = on[(asked[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)]
                    key, owner, place = key[on], owner[on], place[on]
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column("id").take(at), part.column("h1").take(at), pa.array(place.astype(np.int8))], ["key", "id", "h1", "place"])

    return run


def _slots(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(_marks(batch.column("key").to_numpy().view(U64)))))], ["slot"])


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of all keys: at most 2 ** (SLOTS - 15) rows of 4 kB come to the driver."""
    slots = keys.select("key").mapInArrow(_slots, "slot long")
    rows = slots.select((F.col("slot") / 32768).cast("long").alias("segment"), (F.col("slot") % 32768).alias("at")).groupBy("segment").agg(F.bitmap_construct_agg("at"))
    out = np.zeros((1 << SLOTS) // 8, dtype=np.uint8)
    for segment, bits in rows.toLocalIterator():
        out[segment * 4096 : (segment + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _corners(z: np.ndarray) -> int:
    """How many corners places stand for: at one scale corners lie APART pixels apart, so nearer places are one corner, seen at several scales."""
    kept: list = []
    for p in np.unique(z).tolist():
        if all(abs(p - k) >= APART for k in kept):
            kept.append(p)
    return len(kept)


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """The most matches (places a to places b), counted by corners, that one similarity transform explains."""
    zoom, turn = b[:, 2] / a[:, 2], b[:, 3] - a[:, 3]
    za, zb = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    move = zoom * np.exp(1j * turn)  # each match proposes a transform
    off = np.abs(zb[:, None] + move[:, None] * (za[None, :] - za[:, None]) - zb[None, :])
    bent = np.abs(np.angle(np.exp(1j * (turn[:, None] - turn[None, :]))))
    zoomed = np.abs(np.log(zoom[:, None] / zoom[None, :]))
    good = (off <= SHIFT_PIXELS * np.maximum(1, zoom)[:, None]) & (bent < BENT) & (zoomed < 0.3)
    best = good[good.sum(axis=1).argmax()]
    return min(_corners(za[best]), _corners(zb[best]))


def matches(a_place: np.ndarray, a_bits: np.ndarray, b_place: np.ndarray, b_bits: np.ndarray) -> tuple[int, int]:
    """(pairs of descriptors within the distance, corners of them that agree on one transform)."""
    i, j = np.nonzero(np.bitwise_count(a_bits[:, None] ^ b_bits[None]).sum(axis=2, dtype=np.int64) <= MOST_APART)
    return len(i), agreeing(a_place[i], b_place[j]) if len(i) >= LEAST_AGREEING else 0


def _judge(batches):
    place, bits = (lambda x: np.frombuffer(x, np.float32).reshape(-1, 4)), (lambda x: np.frombuffer(x, U64).reshape(-1, 4))
    for batch in batches:
        sides = [[f(x) for x in batch.column(c).to_pylist()] for c, f in (("places_q", place), ("bits_q", bits), ("places", place), ("bits", bits))]
        found = np.array([matches(*x) for x in zip(*sides)], dtype=np.int64).reshape(-1, 2)
        on = pa.array(np.flatnonzero(found[:, 1] >= LEAST_AGREEING))
        yield pa.RecordBatch.from_arrays([batch.column("id_q").take(on), batch.column("id").take(on), *(pa.array(found[:, k]).take(on) for k in (0, 1))], ["query_id", "match_id", "n_matches", "n_agreeing"])


PAIR = "query_id long, match_id long, n_matches long, n_agreeing long"


def _searched(images: DataFrame, queries: DataFrame, id_col: str, image_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features of all images, first id of each class of equal images, pairs)."""

    def features(of: DataFrame, probes: tuple[int, ...]) -> DataFrame:
        rows = of.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("image")).where("id IS NOT NULL")
        return rows.select("id", F.xxhash64("image").alias("h1"), F.xxhash64(F.lit(1), "image").alias("h2"), "image").mapInArrow(lambda batches: _describe(batches, probes), _FEATURES)

    every = scratch.table(features(images, (0,)), "features")
    first = every.groupBy("h1", "h2").agg(F.min("id").alias("id"))
    index = every.join(first, ["id", "h1", "h2"], "left_semi").dropDuplicates(["id", "h1", "h2"])
    asked = scratch.table(features(queries, PROBES).dropDuplicates(["id", "h1", "h2"]), "queries")
    side = lambda df: df.select(*[F.col(c).alias(f"{c}_q" if c != "key" else c) for c in df.columns])
    wanted = scratch.table(asked.mapInArrow(_deal(None, "probes"), _KEYS), "keys")
    shared = images.sparkSession.sparkContext.broadcast(_bitmap(wanted))
    offered = every.join(first, ["id", "h1", "h2"], "left_semi").mapInArrow(lambda batches: _deal(shared.value, "bits")(batches), _KEYS)
    votes = offered.join(side(wanted), "key").groupBy("id_q", "h1_q", "id", "h1").agg(F.bit_or(F.expr("shiftleft(1L, place_q)")).alias("votes"))
    candidates = scratch.table(votes.where(F.bit_count("votes") >= LEAST_VOTES).drop("votes"), "candidates")
    fed = candidates.join(side(asked.select("id", "h1", "places", "bits")), ["id_q", "h1_q"]).join(index.select("id", "h1", "places", "bits"), ["id", "h1"])
    return every, first, fed.mapInArrow(_judge, PAIR)


def find_copies(images: DataFrame, queries: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """(query_id, match_id, n_matches, n_agreeing): images that a query is a crop or edit of, or the reverse.

    Images are binary PGM; a null, malformed, tiny or flat one has no corners and matches
    nothing. Equal images are one class under its least id, which match_id names. Rows
    without id are left out; repeated ids of different images each count.
    """
    return _searched(images, queries, id_col, image_col, Scratch(images.sparkSession, "images"))[2]


def copy_classes(images: DataFrame, queries: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """One row for each image with an id: image_id, equal_id, class_id, n_corners, n_queries, most_agreeing, asked, found.

    equal_id: the least id of the images equal to it, which names it in find_copies' match_id.
    class_id: the least id of the images that queries (named after the image they come from)
    tie together, equal images included; edited copies that no query ties keep classes apart; n_queries: how many queries match the image;
    found: whether a query of its own does (null where none asks).
    """
    scratch = Scratch(images.sparkSession, "images")
    every, first, pairs = _searched(images, queries, id_col, image_col, scratch)
    pairs = scratch.table(pairs, "pairs")
    members = every.select("id", "h1", "h2", (F.octet_length("bits") / 32).cast("long").alias("n_corners")).join(first.withColumnRenamed("id", "rep"), ["h1", "h2"])
    rep_of = members.groupBy("id").agg(F.min("rep").alias("rep"))
    edges = pairs.join(rep_of.withColumnRenamed("id", "query_id"), "query_id", "left").select(F.coalesce("rep", "query_id").alias("a"), F.col("match_id").alias("b"))
    tied = components(edges, scratch).select(F.col("node").alias("rep"), "component")
    counts = pairs.groupBy(F.col("match_id").alias("rep")).agg(F.countDistinct("query_id").alias("n_queries"), F.max("n_agreeing").alias("most_agreeing"))
    own = pairs.join(rep_of.select(F.col("id").alias("query_id"), F.col("rep").alias("match_id")), ["query_id", "match_id"], "left_semi").select(F.col("query_id").alias("id"), F.lit(True).alias("hit")).distinct()
    asking = queries.select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("asks")).distinct()
    out = members.join(tied, "rep", "left").join(counts, "rep", "left").join(asking, "id", "left").join(own, "id", "left")
    return out.select(
        F.col("id").alias("image_id"),
        F.col("rep").alias("equal_id"),
        F.coalesce("component", "rep").alias("class_id"),
        "n_corners",
        F.coalesce("n_queries", F.lit(0).cast("long")).alias("n_queries"),
        F.coalesce("most_agreeing", F.lit(0).cast("long")).alias("most_agreeing"),
        F.coalesce("asks", F.lit(False)).alias("asked"),
        F.when(F.col("asks"), F.coalesce("hit", F.lit(False))).alias("found"),
    )


SIDE = 96


def _basis() -> np.ndarray:
    """A fixed smooth random field for each of 64 numbers."""
    draw = np.random.Generator(np.random.PCG64(64))
    y, x = np.mgrid[0:SIDE, 0:SIDE]
    out = np.zeros((64, SIDE, SIDE), dtype=np.float32)
    for k in range(64):
        for _ in range(8):
            a, f, p = draw.uniform(0, np.pi), 2 * np.pi / draw.uniform(7, 24), draw.uniform(0, 2 * np.pi)
            out[k] += np.cos(f * (np.cos(a) * x + np.sin(a) * y) + p)
    return out.reshape(64, -1)


def _render(edited: bool):
    """PGM images of vectors; edited: cropped, turned, rescaled, of other contrast and brightness, partly covered."""
    made: dict = {}

    def run(batches):
        if not made:
            made[0] = _basis()
        for batch in batches:
            ids = batch.column("image_id").to_pylist()
            out = []
            for i, v in zip(ids, batch.column("embedding").to_pylist()):
                if v is None or len(v) != 64 or any(x is None for x in v):
                    out.append(None)
                    continue
                grey = np.clip(128 + 22 * (np.asarray(v, np.float32) @ made[0]), 0, 255).reshape(SIDE, SIDE)
                if edited:
                    draw = np.random.Generator(np.random.PCG64(i or 0))
                    side = int(draw.integers(80, 93))
                    y, x = draw.integers(0, SIDE - side + 1, 2)
                    grey = grey[y : y + side, x : x + side] * draw.uniform(0.8, 1.0) + draw.uniform(0, 20)
                    cy, cx = draw.integers(0, side - 16, 2)
                    grey[cy : cy + 16, cx : cx + 16] = 255
                    grey = np.rot90(_resized(grey[None], draw.uniform(0.85, 1.0))[0], int(draw.integers(0, 4)))
                out.append(write_pgm(grey))
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(out, pa.binary())], ["image_id", "image"])

    return run


def _rendered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """No table has images: each embedding is rendered as one, and each fiftieth is asked for by an edited crop."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("image_id"), "embedding")
    images = rows.mapInArrow(_render(False), "image_id long, image binary")
    return images, rows.where("image_id % 50 = 0").mapInArrow(_render(True), "image_id long, image binary")


def op5_local_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each image, with its class of equal images; which query matched which is op5_copy_pairs."""
    return copy_classes(*_rendered(spark, sf_dir))


def op5_copy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search's answers: every query with every class of equal images that it matches."""
    return find_copies(*_rendered(spark, sf_dir))
