"""LM scoring with an Elias-Fano n-gram trie.

The model: p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU), and p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),
over all training texts. A text's logarithm splits into parts that need only one word's
count each, and for each seen pair log10(1 + c(v w) / (MU p(w))), which the trie holds, quantised.

So each token travels once, to the part of its word's hash, with its context and text: there
training tokens are counted, the part's trie is built and all tokens are looked up in it;
per-text sums travel back. Words with a THETA-th of all tokens are at most 1 / THETA and are
broadcast: pairs that end in one are dealt by the pair, and the pairs that themselves are that
frequent (again at most 1 / THETA) are counted first and scored where the text is. Thus no
part gets more than a THETA-th of all tokens by one key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .eliasfano import Trie
from .langid import _remainder
from .partenum import _blobs, _narrow
from .scratch import Scratch
from .textkernel import SPACED, U64, Words, mix, string_slices

MU = 64.0
THETA = 1 / 2000
PART_TOKENS = 2_500_000  # more parts mean more sums to send back, one for each text and part
SLICE = 4 << 20  # bytes of text whose tokens travel together
COUNTED = 1_500_000  # distinct words that one run of counts keeps
START, END = U64(0x5354415254000001), U64(0x454E440000000001)
_ROWS = 1 << 15  # texts in a slice, at most: a text's number and its training mark share 16 bits


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash before, text) of each token: the words of each text, then its end."""
    n, texts = len(words.start), words.n_texts
    h, doc = np.full(n + texts, END, dtype=U64), np.empty(n + texts, dtype=np.int64)
    at = np.arange(n) + words.text_of
    h[at], doc[at] = words.hash, words.text_of
    doc[words.first[1:] + np.arange(texts)] = np.arange(texts)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[words.first[:-1] + np.arange(texts)] = START
    return h, before, doc


def _sliced(batches):
    """(batch, from row, to row, tokens, training marks) of (id, text, train) batches."""
    for batch in batches:
        train = batch.column("train").to_numpy(zero_copy_only=False)
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            for a, b, data, offsets in string_slices(part.column("text"), SLICE):
                yield part, a, b, _tokens(Words(data, offsets, SPACED)), train[lo + a : lo + b]


def _find(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Place of each x in a sorted array, -1 if it isn't there."""
    if not len(ordered):
        return np.full(len(x), -1, dtype=np.int64)
    table = np.zeros(1 << 16, dtype=bool)
    table[ordered >> U64(48)] = True
    out = np.full(len(x), -1, dtype=np.int64)
    maybe = np.flatnonzero(table[x >> U64(48)])
    at = np.minimum(np.searchsorted(ordered, x[maybe]), len(ordered) - 1)
    good = ordered[at] == x[maybe]
    out[maybe[good]] = at[good]
    return out


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash; rises with it."""
    return ((h >> U64(40)) * U64(parts) >> U64(24)).astype(np.int64)


def _merged(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their counts."""
    key, which = np.unique(keys, return_inverse=True)
    return key, *(np.bincount(which, weights=c, minlength=len(key)).astype(np.int64) for c in counts)


def _count_words(parts: int):
    def flush(runs):
        key, total, train = _merged(*map(np.concatenate, zip(*runs)))
        at = np.searchsorted(_part(key, parts), np.arange(parts + 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(parts, dtype=np.int32)), _blobs(key.view(np.uint8), at * 8), _blobs(total.view(np.uint8), at * 8), _blobs(train.view(np.uint8), at * 8)], ["part", "keys", "total", "train"]
        )

    def run(batches):
        runs, size = [], 0
        for _, _, _, (h, _, doc), train in _sliced(batches):
            runs.append(_merged(h, np.ones(len(h)), train[doc].astype(float)))
            size += len(runs[-1][0])
            if size > COUNTED:
                yield flush(runs)
                runs, size = [], 0
        if runs:
            yield flush(runs)

    return run


def _sum_words(table: pa.Table) -> pa.Table:
    """Of a part: a row of its sums (key null), and rows of words that may be frequent."""
    key, total, train = _merged(*(_narrow(table.column(c), 8).view(t) for c, t in (("keys", U64), ("total", np.int64), ("train", np.int64))))
    hot = np.flatnonzero(total >= THETA * total.sum())
    return pa.table(
        {
            "key": pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(key[hot].view(np.int64))]),
            "total": pa.array(np.append(total.sum(), total[hot])),
            "train": pa.array(np.append(train.sum(), train[hot])),
            "distinct": pa.array(np.append((train > 0).sum(), np.zeros(len(hot), np.int64))),
        }
    )


class Frequent:
    """What every task knows: corpus sums, and the frequent words and pairs."""

    def __init__(self, n: int, v: int, texts: int, words: np.ndarray, counts: np.ndarray):
        self.n, self.v, self.texts = n, v, texts
        self.words, self.counts = words, counts
        self.pairs, self.pair_counts = np.empty(0, U64), np.empty(0, np.int64)

    def pair(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Number of a pair of frequent words, from their places."""
        return (context * len(self.words) + word).astype(U64)

    def contexts(self) -> np.ndarray:
        """Frequent words as contexts: the start is one, the end none."""
        return np.unique(np.append(self.words[self.words != END], START))

    def smooth(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.n + 0.5 * (self.v + 1))

    def single(self, count: np.ndarray, is_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A token's part of (base score, score) that its own count decides."""
        base = np.log10(self.smooth(count))
        return base, base + math.log10(MU) - np.where(is_end, 0.0, np.log10(count + MU))

    def gain(self, pair: np.ndarray, count: np.ndarray) -> np.ndarray:
        """What a seen pair adds to the score."""
        return np.log10(1 + pair / (MU * self.smooth(count)))


def _count_pairs(known: Frequent):
    """Counts of pairs of frequent words, pre-aggregated."""

    def run(batches):
        contexts = known.contexts()
        runs, size = [], 0

        def flush():
            key, total, train = _merged(*map(np.concatenate, zip(*runs)))
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(total), pa.array(train)], ["pair", "total", "train"])

        for _, _, _, (h, before, doc), train in _sliced(batches):
            word, context = _find(h, known.words), _find(before, contexts)
            on = (word >= 0) & (context >= 0)
            runs.append(_merged(known.pair(word[on], context[on]), np.ones(int(on.sum())), train[doc[on]].astype(float)))
            size += len(runs[-1][0])
            if size > COUNTED:
                yield flush()
                runs, size = [], 0
        if runs:
            yield flush()

    return run


_ENTRY = "part int, slice long, keys binary, sizes binary, contexts binary, texts binary, hot binary, hot_contexts binary, hot_texts binary, local binary"


def _send(known: Frequent, parts: int):
    """Tokens by part; each slice's own sums go to one of the parts, as ``local``."""

    def run(batches):
        contexts = known.contexts()
        hot_base, hot_score = known.single(known.counts, known.words == END)
        start = -math.log10(known.texts + MU)
        task, turn = TaskContext.get().partitionId(), -1
        for batch, a, b, (h, before, doc), train in _sliced(batches):
            turn += 1
            word, context = _find(h, known.words), _find(before, contexts)
            hot = word >= 0
            base = np.bincount(doc[hot], weights=hot_base[word[hot]], minlength=b - a)
            score = np.bincount(doc[hot], weights=hot_score[word[hot]], minlength=b - a) + start
            seen = np.bincount(doc[hot], weights=known.counts[word[hot]] > 0, minlength=b - a).astype(np.int64)
            both = hot & (context >= 0)
            at = np.full(len(h), -1, dtype=np.int64)
            at[both] = _find_number(known.pair(word[both], context[both]), known.pairs)
            near = at >= 0
            score += np.bincount(doc[near], weights=known.gain(known.pair_counts[at[near]], known.counts[word[near]]), minlength=b - a)

            mark = (doc.astype(np.uint16) << np.uint16(1)) | train[doc].astype(np.uint16)
            cold = np.flatnonzero(~hot)
            cold = cold[np.argsort(h[cold])]
            new = np.ones(len(cold), dtype=bool)
            new[1:] = h[cold[1:]] != h[cold[:-1]]
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(cold))).astype(np.uint32)
            at_key = np.searchsorted(_part(h[cold[first]], parts), np.arange(parts + 1))
            at_token = np.append(first, len(cold))[at_key]
            far = np.flatnonzero(hot & ~near)
            route = _part(mix(h[far] ^ mix(before[far])), parts)
            order = np.argsort(route, kind="stable")
            far, at_far = far[order], np.searchsorted(route[order], np.arange(parts + 1))

            number = task << 32 | turn
            local = [b""] * parts
            ids = batch.column("id").slice(a, b - a)
            tokens = np.bincount(doc, minlength=b - a).astype(np.int64)
            local[number % parts] = b"".join(x.tobytes() for x in (ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), tokens, seen, base, score))
            narrow = lambda x, at, width: _blobs(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :width]), at * width)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(parts, dtype=np.int32)),
                    pa.array(np.full(parts, number)),
                    narrow(h[cold[first]], at_key, 6),
                    narrow(sizes, at_key, 4),
                    narrow(mix(before[cold]), at_token, 4),
                    narrow(mark[cold], at_token, 2),
                    narrow(word[far].astype(np.uint16 if len(known.words) < 1 << 16 else np.uint32), at_far, 2 if len(known.words) < 1 << 16 else 4),
                    narrow(mix(before[far]), at_far, 4),
                    narrow(mark[far], at_far, 2),
                    pa.array(local, pa.binary()),
                ],
                [x.split()[0] for x in _ENTRY.split(", ")],
            )

    return run


def _find_number(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.full(len(x), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return np.where(ordered[at] == x, at, -1)


def _joined(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all values end to end, and how many each value has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=dtype), np.array([len(x) // np.dtype(dtype).itemsize for x in raw], dtype=np.int64)


def _pairs(word: np.ndarray, context: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pairs, which each token is, training counts); a pair is word place * 2**32 + context."""
    pair, which = np.unique((word.astype(U64) << U64(32)) | context, return_inverse=True)
    return pair, which, np.bincount(which, weights=train, minlength=len(pair)).astype(np.int64)


def _gains(words: np.ndarray, counts: np.ndarray, word: np.ndarray, context: np.ndarray, train: np.ndarray, known: Frequent) -> np.ndarray:
    """Each token's gain, looked up in a trie of the training pairs."""
    pair, which, times = _pairs(word, context, train)
    on = times > 0
    place, rest = (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.uint32)
    trie = Trie.map(Trie.build(words, place[on], rest[on], known.gain(times[on], counts[place[on]])).to_bytes())
    return trie.lookup(place, rest)[which]


def _shard(known: Frequent):
    """Of a part: sums for each slice's texts, and slices' own sums passed on."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")
        slices = table.column("slice").to_numpy()
        key = _narrow(table.column("keys"), 6)
        sizes, _ = _joined(table.column("sizes"), np.uint32)
        context, per_token = _joined(table.column("contexts"), np.uint32)
        mark, _ = _joined(table.column("texts"), np.uint16)
        hot, per_hot = _joined(table.column("hot"), np.uint16 if len(known.words) < 1 << 16 else np.uint32)
        hot_context, _ = _joined(table.column("hot_contexts"), np.uint32)
        hot_mark, _ = _joined(table.column("hot_texts"), np.uint16)

        words, which = np.unique(key, return_inverse=True)
        word = np.repeat(which, sizes)
        train = (mark & 1).astype(bool)
        counts = np.bincount(word, weights=train, minlength=len(words)).astype(np.int64)
        base, score = known.single(counts, words == (END & U64((1 << 48) - 1)))
        cold_score = score[word] + _gains(words, counts, word, context, train, known)
        hot_score = _gains(np.arange(len(known.words), dtype=U64), known.counts, hot, hot_context, (hot_mark & 1).astype(bool), known)

        owner = np.concatenate([np.repeat(np.arange(len(slices)), per_token), np.repeat(np.arange(len(slices)), per_hot)])
        text = np.concatenate([mark >> 1, hot_mark >> 1])
        place, at = np.unique(owner * _ROWS + text, return_inverse=True)
        add = lambda x: np.bincount(at, weights=x, minlength=len(place))
        nothing = np.zeros(len(hot))
        sums = [add(np.concatenate([base[word], nothing])), add(np.concatenate([cold_score - base[word], hot_score])).astype(np.float32), add(np.concatenate([counts[word] > 0, nothing])).astype(np.uint32)]
        bounds = np.searchsorted(place, np.arange(len(slices) + 1) * _ROWS)
        return pa.table(
            {
                "slice": pa.array(slices),
                "part": table.column("part"),
                "texts": _blobs((place % _ROWS).astype(np.uint16).view(np.uint8), bounds * 2),
                "base": _blobs(sums[0].view(np.uint8), bounds * 8),
                "rest": _blobs(sums[1].view(np.uint8), bounds * 4),
                "seen": _blobs(sums[2].view(np.uint8), bounds * 4),
                "local": table.column("local"),
            }
        )

    return run


def _gather(table: pa.Table) -> pa.Table:
    """A slice's texts with all their sums, parts added in order."""
    table = table.sort_by("part")
    raw = next(x for x in table.column("local").to_pylist() if x)
    ids, null, tokens, seen = np.frombuffer(raw, np.int64).reshape(6, -1)[:4]
    base, score = np.frombuffer(raw, np.float64).reshape(6, -1)[4:]
    text, _ = _joined(table.column("texts"), np.uint16)
    add = lambda name, dtype: np.bincount(text, weights=_joined(table.column(name), dtype)[0], minlength=len(ids))
    far = add("base", np.float64)
    return pa.table(
        {
            "doc_id": pa.array(ids, mask=null.astype(bool)),
            "n_tokens": pa.array(tokens),
            "n_known": pa.array(seen + add("seen", np.uint32).astype(np.int64)),
            "base_score": pa.array(base + far),
            "score": pa.array(score + far + add("rest", np.float32)),
        }
    )


def lm_scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``train``: a condition; the texts that meet it are learned from, all texts are scored.
    A-Z are lower-cased, words are runs of other than white space, and each text has one end.
    A null or empty text is its end alone; whole texts of any size count; rows repeat as the
    input does; without training texts every token is unknown, with probability 1. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    fed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    count_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = fed.mapInArrow(_count_words(count_parts), "part int, keys binary, total binary, train binary")
    words = scratch.table(words.groupBy("part").applyInArrow(_sum_words, "key long, total long, train long, distinct long"), "words")
    sums = words.where("key IS NULL").agg(F.sum("total"), F.sum("train"), F.sum("distinct")).first()
    total, n, v = (x or 0 for x in sums)
    hot = words.where(F.col("key").isNotNull() & (F.col("total") >= THETA * total)).select("key", "train").collect()  # at most 1 / THETA
    keys = np.array([r.key for r in hot], dtype=np.int64).view(U64)
    order = np.argsort(keys)
    ends = next((r.train for r in hot if np.int64(r.key).view(U64) == END), None)
    known = Frequent(n, v, ends if ends is not None else fed.where("train").count(), keys[order], np.array([r.train for r in hot], dtype=np.int64)[order])
    first = spark.sparkContext.broadcast(known)
    counted = fed.mapInArrow(lambda batches: _count_pairs(first.value)(batches), "pair long, total long, train long")
    pairs = counted.groupBy("pair").agg(F.sum("total").alias("total"), F.sum("train").alias("train")).where(F.col("total") >= THETA * total).collect()  # at most 1 / THETA
    number = np.array([r.pair for r in pairs], dtype=np.int64).view(U64)
    order = np.argsort(number)
    known.pairs, known.pair_counts = number[order], np.array([r.train for r in pairs], dtype=np.int64)[order]
    shared = spark.sparkContext.broadcast(known)
    scratch.free()

    parts = int(min(1 << 20, max(4 * count_parts, math.ceil(total / PART_TOKENS))))
    sent = fed.mapInArrow(lambda batches: _send(shared.value, parts)(batches), _ENTRY)
    sums = sent.groupBy("part").applyInArrow(lambda table: _shard(shared.value)(table), "slice long, part int, texts binary, base binary, rest binary, seen binary, local binary")
    out = sums.groupBy("slice").applyInArrow(_gather, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def op2_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), _remainder("doc_id", 5) != 1)
    return found.select("doc_id", (_remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
