"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are windows of benchmark words. A block is two consecutive words. The shift table
tells, by a hash of the block under a cursor, how far the cursor may jump without passing the
end of any pattern; where that is zero, the block's full hash picks the bucket of patterns
with this suffix, and a direct comparison of bytes confirms the occurrence. Cursors of many
stretches of text advance together, one NumPy step for all of them; a long text is searched
in overlapping stretches, whole.

Patterns of unequal word counts get a table each, so a short one doesn't cut the others' jumps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, fed, part_of, small_batches, with_record
from .textkernel import ALNUM, U64, Words, mix, string_slices

STRETCH = 256  # words that one cursor searches
BLOCK_BYTES = 4 << 20  # most benchmark text in one broadcast; more text takes more passes
_ODD = (U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93))


def _block(h: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Hash of the block that ends at each word position."""
    x = h[at] * _ODD[0]
    return mix(x + h[at - 1] * _ODD[1]) if span > 1 else mix(x)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - at, size)


def _canonical(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, each with one space after it, and where each word starts."""
    length = words.end - words.start
    start = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(int(start[-1]), 0x20, dtype=np.uint8)
    out[_runs(start[:-1], length)] = words.buf[_runs(words.start, length)]
    return out, start


class Table:
    """Shift and suffix tables of patterns of ``m`` words each."""

    def __init__(self, patterns: list[bytes], m: int):
        text = pa.array(patterns, pa.binary())
        (_, _, data, offsets), *more = string_slices(text, 1 << 40)
        words = Words(data, offsets, ALNUM)
        h = words.hash.reshape(len(patterns), m)
        self.m, self.span = m, min(2, m)
        bits = max(10, math.ceil(math.log2(len(patterns) * m + 1)) + 3)
        self.down = U64(64 - bits)
        self.shift = np.full(1 << bits, m - self.span + 1, dtype=np.int32)
        for end in range(self.span - 1, m):  # a later block allows a smaller jump
            key = _block(h.reshape(-1), np.arange(len(patterns)) * m + end, self.span)
            np.minimum.at(self.shift, (key >> self.down).astype(np.int64), m - 1 - end)
        order = np.argsort(key)
        self.suffix, self.pattern = key[order], order
        self.first = h[:, 0]
        self.bytes, start = _canonical(words)
        self.at = start[:-1].reshape(len(patterns), m)[:, 0]
        self.size = start[m::m] - self.at

    def search(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence."""
        m, count = self.m, np.diff(words.first)
        cursors = np.maximum(0, -(-(count - m + 1) // STRETCH))
        text = np.repeat(np.arange(words.n_texts), cursors)
        pos = words.first[text] + _runs(np.zeros(words.n_texts, np.int64), cursors) * STRETCH + m - 1
        stop = np.minimum(pos + STRETCH, words.first[text + 1])
        seen, keys = [], []
        while len(pos):
            key = _block(h, pos, self.span)
            jump = self.shift[key >> self.down]
            hit = jump == 0
            if hit.any():
                seen.append(pos[hit])
                keys.append(key[hit])
            pos = pos + np.maximum(jump, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]
        if not seen:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pos, key = np.concatenate(seen), np.concatenate(keys)
        lo, hi = np.searchsorted(self.suffix, key), np.searchsorted(self.suffix, key, side="right")
        which = self.pattern[_runs(lo, hi - lo)]
        first = np.repeat(pos, hi - lo) - m + 1
        same = h[first] == self.first[which]
        first, which = first[same], which[same]
        canon, start = _canonical(words)
        same = start[first + m] - start[first] == self.size[which]
        first, which = first[same], which[same]
        if not len(first):
            return first, which
        good = np.zeros(len(first), dtype=bool)
        for a in range(0, len(first), 200_000):
            f, w = first[a : a + 200_000], which[a : a + 200_000]
            size = self.size[w]
            equal = canon[_runs(start[f], size)] == self.bytes[_runs(self.at[w], size)]
            good[a : a + len(f)] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return first[good], which[good]


class Patterns:
    """Tables for the windows of a block of (item_id, text) rows."""

    def __init__(self, items: list[tuple], window: int):
        owners: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            (_, _, data, offsets), = string_slices(pa.array([text or ""]), 1 << 40)
            words = Words(data, offsets, ALNUM)
            each = [words.word(i) for i in range(len(words.start))]
            m = min(window, len(each))
            for i in range(len(each) - m + 1 if m else 0):
                owners.setdefault(m, {}).setdefault(b" ".join(each[i : i + m]), set()).update(() if item is None else (str(item),))
        self.classes = [(Table(list(found), m), [sorted(x) for x in found.values()]) for m, found in sorted(owners.items())]

    def search(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the items that each text contains a window of."""
        delta = np.zeros(len(words.start) + 1, dtype=np.int64)
        items: dict[int, set[str]] = {}
        h = words.hash if len(words.start) else np.empty(0, U64)
        for table, owners in self.classes:
            first, which = table.search(words, h)
            np.add.at(delta, first, 1)
            np.add.at(delta, first + table.m, -1)
            if len(first):
                for text, pattern in np.unique(np.stack([words.text_of[first], which], axis=1), axis=0).tolist():
                    items.setdefault(text, set()).update(owners[pattern])
        return np.cumsum(delta[:-1]) > 0, items


def _scan(patterns: Patterns, text_col: str, last: bool):
    """Search batches of (id and text, or record; hits: a byte for each word so far; items so far)."""

    def run(batches):
        for batch in batches:
            kept = [c for c in ("record", "id", "text") if c in batch.schema.names]
            for a, b, data, offsets in string_slices(part_of(batch, "text", text_col)):
                words = Words(data, offsets, ALNUM)
                hit, items = patterns.search(words)
                bounds = words.first
                before = batch.column("hits").slice(a, b - a)
                if before.null_count < b - a:
                    hit = hit | np.frombuffer(b"".join(before.to_pylist()), dtype=bool)
                known = batch.column("items").slice(a, b - a).to_pylist()
                found = pa.array([sorted(items.get(i, set()).union(known[i] or ())) for i in range(b - a)], pa.list_(pa.string()))
                if last:
                    total = np.concatenate([[0], np.cumsum(hit)])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(kept[0]).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(total[bounds[1:]] - total[bounds[:-1]]), found], ["record" if kept[0] == "record" else "doc_id", "n_words", "n_hit", "items"]
                    )
                else:
                    raw = hit.tobytes()
                    hits = pa.array([raw[x:y] for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in kept), hits, found], [*kept, "hits", "items"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids with occurring windows, sorted as strings).

    With ``whole`` record, the input row as a struct, in place of doc_id.

    A-Z are lower-cased; words are runs of digits, letters and non-ASCII characters. Windows:
    ``window`` consecutive words of an item; an item of fewer, but not none, is one window.
    Null or wordless texts have no words; null or wordless items have no window; an item
    without id hits words but isn't listed. Repeated rows and items keep their rows; an empty
    benchmark hits nothing; other columns are ignored. The benchmark is broadcast in blocks of
    at most ``BLOCK_BYTES`` of text; each block is one pass over the documents, and a table
    between passes keeps a worker from holding the windows of more than one block.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "wumanber")
    small_batches(spark)
    kept = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("body")).where("body IS NOT NULL")
    size = kept.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    rows = fed(docs, whole, id=F.col(id_col).cast("long"), text=F.col(text_col))
    out = rows.withColumns({"hits": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")})
    between, after = out.schema, with_record("doc_id long, n_words long, n_hit long, items array<string>", rows)
    for k in range(blocks):
        block = [tuple(r) for r in kept.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).collect()]
        shared = spark.sparkContext.broadcast(Patterns(block, window))
        last = k == blocks - 1
        scan = lambda batches, shared=shared, last=last: _scan(shared.value, text_col, last)(batches)
        before = out
        out = out.mapInArrow(scan, after if last else between)
        if not last:
            out = scratch.table(out, "pass")
            if k:
                scratch.drop(before)
    return out


def op6_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def contaminated():
    """A twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


OP6_SQL = r"""
WITH bench AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bench WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
found AS (SELECT doc_id, item_id, p.m, i FROM places p JOIN windows v ON p.s = v.s AND p.m = v.m),
hits AS (SELECT doc_id, count(DISTINCT word_at) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS word_at FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
