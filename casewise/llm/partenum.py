"""N-gram Jaccard join by PartEnum signatures.

Sets of similar size share a band; a pair whose Jaccard similarity reaches the threshold
differs in at most ``k`` shingles, ``k`` known from the band. The shingle domain is cut into
``n1`` groups of ``n2`` parts by a hash; at most ``k // (k2 + 1)`` groups hold more than
``k2`` differences, so in any other group some subset of ``n2 - k2`` parts is equal in both
sets, and the hash of that subset is a signature they share.

Two additions keep the signatures selective and the join exact:

* Signatures of empty subsets are not emitted. A set stands by a level only if it has more
  *robust* groups (groups in which every subset is non-empty) than a partner can spoil; a set
  that falls short also emits the next level's signatures. A pair needs one side that stands,
  or both sides meet at the next level; the last level has a signature for each shingle.
* The first levels leave out shingles that a large share of all sets has (a passage that
  thousands of texts quote); leaving a fixed set of features out of the domain adds no
  difference. That list is bounded: at most ``mean set size / FREQUENT`` shingles.

Equal sets are one class from the start, so exact copies cost one member. A class is named by
two 64-bit sums of its shingles; its node is the first sum, or the second where two classes
share the first (such classes are looked up, not assumed away).

Buckets of more than two members never become all their pairs: each gives a star, then for
each member its nearest of another component, and what is still apart is compared with whole
sets inside the task, which gives back only links that join two components.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, small_batches
from .textkernel import SPACED, U64, Words, mix, shingle_sets, string_slices

FREQUENT = 0.002  # share of a slice's distinct sets from which a shingle counts as frequent
PARTS, SPOILED = 3, 1  # n2, k2: parts in a group, and differences that a group's subsets bear
SIGNATURES_PER_PART = 400_000
SIGNATURES_PER_SHINGLE = 0.95  # about, over both roles
BROADCAST_NODES = 500_000  # ids of 8 bytes that may be broadcast
SLICE = 1 << 20  # bytes of text that are shingled together
COUNTED = 1_500_000  # shingles that are counted together
CHUNK_MEMBERS = 10_000  # of buckets that one call compares, about
BLOCK_MEMBERS = 4096  # a bucket of more members is compared block by block
BLOCK_SHINGLES = 400_000  # the same where whole sets are compared


class Bands:
    """Size bands for the threshold num/den; band 0 starts at size 1."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < 1 << 40:
            low.append(low[-1] * den // num + 1)
        self.low = np.array(low, dtype=np.int64)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1

    def top(self, band: np.ndarray) -> np.ndarray:
        return self.low[band + 1] - 1

    def differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most shingles in which linked sets of sizes a and b can differ."""
        return (a + b) * (self.den - self.num) // (self.num + self.den)


#: (groups per shingle of the band's largest set, leaves frequent ones out)
LEVELS = ((0.15, True), (0.6, True), (0.15, False))


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + size[i] - 1, end to end."""
    at = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - at, size)


def _level(bands: Bands, tag, limit, first, count, e, level: int):
    """Signatures of one level: (signature, set index) and which sets stand. count: features kept, of e from first."""
    n1 = np.ceil(bands.top(tag) * LEVELS[level][0]).astype(np.int64) + 1
    base = np.cumsum(n1) - n1
    seed = mix(tag.astype(U64) * U64(64) + U64(level))
    x = mix(e[_runs(first, count)] ^ np.repeat(seed, count))
    cell = np.repeat(base, count) + ((x >> U64(32)) * np.repeat(n1, count).astype(U64) >> U64(32)).astype(np.int64)
    cell = cell * PARTS + ((x & U64(0xFFFFFFFF)) * U64(PARTS) >> U64(32)).astype(np.int64)
    groups = int(n1.sum())
    total = np.zeros(groups * PARTS, dtype=U64)
    np.add.at(total, cell, mix(x + U64(0xA0761D6478BD642F)))
    filled = np.bincount(cell, minlength=groups * PARTS).reshape(groups, PARTS)
    total = total.reshape(groups, PARTS)
    owner = np.repeat(np.arange(len(tag)), n1)
    salt = mix(np.repeat(seed, n1) + (np.arange(groups) - np.repeat(base, n1)).astype(U64) * U64(8))
    sigs, owners = [], []
    for which, kept in enumerate(itertools.combinations(range(PARTS), PARTS - SPOILED)):
        some = np.flatnonzero(sum(filled[:, j] for j in kept) > 0)
        sigs.append(mix(sum((total[some, j] for j in kept), np.zeros(len(some), U64)) ^ (salt[some] + U64(which))))
        owners.append(owner[some])
    robust = (filled > 0).sum(axis=1) > SPOILED
    stands = np.bincount(owner, weights=robust, minlength=len(tag)) > limit // (SPOILED + 1)
    return np.concatenate(sigs), np.concatenate(owners), stands


def signatures(bands: Bands, e: np.ndarray, bounds: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, index of its set, band that it belongs to) over sets e[bounds[i]:bounds[i+1]] of at least one shingle."""
    size = np.diff(bounds)
    band = bands.of(size)
    owner = np.repeat(np.arange(len(size)), size)
    common = _member(e, frequent)
    rare = e[~common]
    rare_size = size - np.bincount(owner, weights=common, minlength=len(size)).astype(np.int64)
    rare_first = np.cumsum(rare_size) - rare_size
    sigs, owners, tags = [], [], []
    for role in (0, 1):
        todo = np.flatnonzero(band >= role)
        for level, (_, sparse) in enumerate(LEVELS):
            tag, s = band[todo] - role, size[todo]
            partner = np.minimum(bands.top(tag + 1), s * bands.den // bands.num) if role == 0 else bands.top(tag)
            limit = bands.differences(s, partner)
            first, count, features = (rare_first[todo], rare_size[todo], rare) if sparse else (bounds[todo], s, e)
            if not len(todo):
                break
            sig, own, stands = _level(bands, tag, limit, first, count, features, level)
            sigs.append(sig)
            owners.append(todo[own])
            tags.append(tag[own])
            todo = todo[~stands]
        else:
            c = size[todo]
            seed = mix((band[todo] - role).astype(U64) * U64(64) + U64(63))
            sigs.append(mix(e[_runs(bounds[todo], c)] ^ np.repeat(seed, c)))
            owners.append(np.repeat(todo, c))
            tags.append(np.repeat(band[todo] - role, c))
    return np.concatenate(sigs), np.concatenate(owners), np.concatenate(tags)


def _member(e: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of e are in a sorted array: a bit table first, as few are."""
    out = np.zeros(len(e), dtype=bool)
    if not len(ordered):
        return out
    table = np.zeros(1 << 22, dtype=bool)
    table[ordered >> U64(42)] = True
    maybe = np.flatnonzero(table[e >> U64(42)])
    at = np.minimum(np.searchsorted(ordered, e[maybe]), len(ordered) - 1)
    out[maybe] = ordered[at] == e[maybe]
    return out


def _slices(batches: Iterator[pa.RecordBatch], width: int):
    """(ids or None, hashes, bounds) of slices of (id, text) batches."""
    for batch in batches:
        for a, b, data, offsets in string_slices(batch.column(1), SLICE):
            yield batch.column(0).slice(a, b - a), *shingle_sets(Words(data, offsets, SPACED), width)


def _sums(e: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent sums of each set, its class: one of ``bits`` bits, one of 64."""
    out = []
    for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        total = np.zeros(len(e) + 1, dtype=U64)
        np.cumsum(mix(e + U64(salt)), out=total[1:])
        out.append(total[bounds[1:]] - total[bounds[:-1]])
    return out[0] >> U64(64 - bits), out[1]


def _nodes(h1: np.ndarray, h2: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    return np.where(np.isin(h1, clashing), h2, h1) if len(clashing) else h1


def _profile(width: int, num: int, den: int, share: float, bits: int):
    """A row for each text, and rows for shingles that at least ``share`` of a run of distinct sets have."""
    names = ["id", "n", "h1", "h2", "band", "mark", "is_text"]
    bands = Bands(num, den)

    def often(runs: list[np.ndarray], sets: int) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(runs), return_counts=True)
        on = times >= max(5, math.ceil(share * sets))
        k = int(on.sum())
        zero = pa.array(np.zeros(k, np.int64))
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(times[on]), pa.array(found[on].view(np.int64)), zero, pa.array(np.zeros(k, np.int32)), zero, pa.array(np.zeros(k, bool))], names)

    def run(batches):
        runs, sets, size = [], 0, 0
        for keys, e, bounds in _slices(batches, width):
            h1, h2 = _sums(e, bounds, bits)
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([keys.field("id"), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(bands.of(n).astype(np.int32)), keys.field("mark"), pa.array(np.ones(len(n), bool))], names)
            _, distinct = np.unique(h2, return_index=True)
            distinct = distinct[n[distinct] > 0]
            runs.append(e[_runs(bounds[distinct], n[distinct])])
            sets, size = sets + len(distinct), size + len(runs[-1])
            if size > COUNTED:
                yield often(runs, sets)
                runs, sets, size = [], 0, 0
        if size:
            yield often(runs, sets)

    return run


def _emit(width: int, num: int, den: int, bits: int, dealt: np.ndarray, frequent: np.ndarray, clashing: np.ndarray):
    """Signatures by part. dealt[b] .. dealt[b + 1] are the parts of band b, so a set's go to few of them."""

    def run(batches):
        bands = Bands(num, den)
        for _, e, bounds in _slices(batches, width):
            n = np.diff(bounds)
            node = _nodes(*_sums(e, bounds, bits), clashing)
            _, distinct = np.unique(node, return_index=True)
            distinct = np.sort(distinct[n[distinct] > 0])
            if not len(distinct):
                continue
            n, node = n[distinct], node[distinct]
            e = e[_runs(bounds[distinct], n)]
            sig, owner, tag = signatures(bands, e, np.concatenate([[0], np.cumsum(n)]), frequent)
            part = dealt[tag] + ((sig >> U64(32)) * (dealt[tag + 1] - dealt[tag]).astype(U64) >> U64(32)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            order = order[np.argsort(part[order].astype(np.uint16) if dealt[-1] <= 1 << 16 else part[order], kind="stable")]
            part, sig, owner = part[order], sig[order], owner[order]
            new = np.ones(len(part), dtype=bool)
            new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
            run_at = np.flatnonzero(new)
            long = np.diff(np.append(run_at, len(part)))
            pieces = (long + 254) // 255  # a run's size is a byte: longer ones are several
            run_size = np.full(int(pieces.sum()), 255, dtype=np.uint8)
            run_size[np.cumsum(pieces) - 1] = long - (pieces - 1) * 255
            run_at = np.cumsum(run_size.astype(np.int64)) - run_size
            at = np.flatnonzero(np.diff(part, prepend=-1))  # only parts that get something have a row
            ends = np.append(at, len(part))
            run_of = np.searchsorted(run_at, ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[at].astype(np.int32)),
                    _blobs(np.ascontiguousarray(sig.view(np.uint8).reshape(-1, 8)[:, :4]), ends * 4),
                    _blobs(np.ascontiguousarray(node[owner[run_at]]).view(np.uint8), run_of * 8),
                    _blobs(run_size, run_of),
                ],
                ["part", "sigs", "owners", "runs"],
            )

    return run


def _blobs(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that lie end to end."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).reshape(-1))])


def _narrow(column, width: int) -> np.ndarray:
    """Little-endian numbers of ``width`` bytes from binary values."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return out.view(U64).reshape(-1)


def _numbers(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


_BUCKET_SCHEMA = "bucket long, a long, b long"


def _meet(table: pa.Table) -> pa.Table:
    """Of a part: star pairs of each bucket (bucket null), and members of buckets of over two."""
    sig = _numbers(table.column("sigs"), np.uint32)
    own = np.repeat(_numbers(table.column("owners"), U64), _numbers(table.column("runs"), np.uint8))
    order = np.argsort(sig)
    sig, own = sig[order], own[order]
    same = sig[1:] == sig[:-1]
    keep = np.zeros(len(sig), dtype=bool)
    keep[1:] = same
    keep[:-1] |= same
    sig, own = sig[keep], own[keep]
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
    sig, own = sig[new], own[new]
    head = np.ones(len(sig), dtype=bool)
    head[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(sig)))
    centre = np.repeat(own[at], size)
    pairs = np.unique(np.stack([centre[~head], own[~head]], axis=1), axis=0) if len(own) else np.empty((0, 2), U64)
    total = np.add.reduceat(mix(own), at) if len(at) else np.empty(0, U64)
    _, first = np.unique(total, return_index=True)
    first = first[size[first] > 2]
    members = own[_runs(at[first], size[first])]
    bucket = np.repeat(total[first], size[first])
    return pa.table(
        {
            "bucket": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(bucket.view(np.int64))]),
            "a": pa.array(np.concatenate([pairs[:, 0], members]).view(np.int64)),
            "b": pa.concat_arrays([pa.array(pairs[:, 1].astype(U64).view(np.int64)), pa.nulls(len(members), pa.int64())]),
        }
    )


def _sketch(e: np.ndarray) -> bytes:
    """Parity of the set's shingles over bits, one or two to a shingle.

    Each difference between two sets flips one bit, so the bits in which two sketches differ
    are never more than the sets' differences. Half of a sketch folded onto the other by XOR
    is the sketch of half the size.
    """
    bits = min(1 << 17, max(64, 1 << (len(e) - 1).bit_length()))
    odd = np.bincount((mix(e ^ U64(0x2545F4914F6CDD1D)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _blob_sets(width: int, bits: int, clashing: np.ndarray):
    def run(batches):
        for _, e, bounds in _slices(batches, width):
            node = _nodes(*_sums(e, bounds, bits), clashing)
            sketches = [_sketch(e[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)), _blobs(e.view(np.uint8), bounds * 8), pa.array(sketches, pa.binary()), pa.array(np.diff(bounds))],
                ["node", "features", "sketch", "n"],
            )

    return run


def _plausible_pairs(table: dict, across: bool, num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bits apart, which pairs of different components sizes and sketches allow), rows by rows."""
    comp, n, block = (table[c] for c in ("component", "n", "block"))
    raw = [np.frombuffer(x, U64) for x in table["sketch"]]
    words = min(map(len, raw))
    sketch = np.stack([_folded(x, words) for x in raw])
    step = max(1, (1 << 20) // (len(n) * words))
    for a in range(0, len(n), step):
        b = min(len(n), a + step)
        apart = np.bitwise_count(sketch[a:b, None, :] ^ sketch[None, :, :]).sum(axis=-1, dtype=np.int64)
        both, least = n[a:b, None] + n[None, :], np.minimum(n[a:b, None], n[None, :])
        good = (apart * (num + den) <= both * (den - num)) & (comp[a:b, None] != comp[None, :]) & (least * den >= (both - least) * num)
        if across:
            good &= block[a:b, None] != block[None, :]
        yield a, apart, good


def _nearest(table: dict, across: bool, num: int, den: int) -> np.ndarray:
    """(x, y): for each member x the nearest y of another component, if there is one."""
    node, found = table["node"], []
    for a, apart, good in _plausible_pairs(table, across, num, den):
        apart[~good] = 1 << 40
        y = apart.argmin(axis=1)
        x = np.flatnonzero(good[np.arange(len(y)), y])
        found.append(np.stack([node[x + a], node[y[x]]], axis=1))
    return np.concatenate(found)


def _open(table: dict, across: bool, num: int, den: int) -> np.ndarray:
    """(bucket, x, y): pairs that may still be links, where they are no more than members; else (bucket, x, x) for members that have such pairs."""
    found, some, members = [], [], len(table["n"])
    for a, _, good in _plausible_pairs(table, across, num, den):
        some.append(good.any(axis=1))
        if found is not None:
            x, y = np.nonzero(good)
            found.append(np.stack([x + a, y], axis=1)[y > x + a])
            if sum(map(len, found)) > members:
                found = None
    pairs = np.repeat(np.flatnonzero(np.concatenate(some)), 2).reshape(-1, 2) if found is None else np.concatenate(found)
    return np.column_stack([table["bucket"][pairs[:, 0]], table["node"][pairs[:, 0]], table["node"][pairs[:, 1]]])


def _joining(table: dict, across: bool, num: int, den: int) -> np.ndarray:
    """(x, y): links of members, only such that join two components: fewer than members."""
    node, n = table["node"], table["n"]
    sets = [np.frombuffer(x, U64) for x in table["features"]]
    words, dense = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(n) - n
    _, root = np.unique(table["component"], return_inverse=True)
    table = table | {"component": root.copy()}
    mark, found = np.zeros(len(words), dtype=bool), [np.empty((0, 2), np.int64)]
    for a, apart, good in _plausible_pairs(table, across, num, den):
        for i in np.flatnonzero(good.any(axis=1)).tolist():
            x = a + i
            y = np.flatnonzero(good[i] & (root != root[x]))
            if not len(y):
                continue
            y = y[np.argsort(apart[i, y], kind="stable")]
            mark[dense[first[x] : first[x] + n[x]]] = True
            shared = np.add.reduceat(mark[dense[_runs(first[y], n[y])]], np.cumsum(n[y]) - n[y], dtype=np.int64)
            mark[dense[first[x] : first[x] + n[x]]] = False
            y = y[shared * den >= num * (n[x] + n[y] - shared)]
            _, one = np.unique(root[y], return_index=True)
            y = y[one]
            found.append(np.stack([np.full(len(y), node[x]), node[y]], axis=1))
            root[np.isin(root, root[y])] = root[x]
    return np.concatenate(found)


def _plausible(num: int, den: int):
    """Which pairs' sizes and sketches allow a link."""

    def run(batches):
        for batch in batches:
            kept = np.zeros(batch.num_rows, dtype=bool)
            for i, (m, n, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b")))):
                if min(m, n) * den >= max(m, n) * num:
                    x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                    x, y = _folded(x, min(len(x), len(y))), _folded(y, min(len(x), len(y)))
                    kept[i] = int(np.bitwise_count(x ^ y).sum()) * (num + den) <= (m + n) * (den - num)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(kept)], ["a", "b", "kept"])

    return run


def _each_bucket(found, columns: tuple[str, ...], num: int, den: int):
    """``found`` over the members of each bucket of a chunk; of a bucket in blocks, members of blocks i and j meet."""

    def run(table: pa.Table) -> pa.Table:
        numbers = {c: table.column(c).to_numpy() for c in ("bucket", "i", "j", "node", "component", "n", "block")}
        order = np.lexsort([numbers[c] for c in ("j", "i", "bucket")])
        new = np.ones(len(table), dtype=bool)
        new[1:] = np.logical_or.reduce([np.diff(numbers[c][order]) != 0 for c in ("bucket", "i", "j")])
        rows = [np.empty((0, 2), np.int64)]
        for at in np.split(order, np.flatnonzero(new)[1:]):  # sets of one bucket at a time
            data = {c: x[at] for c, x in numbers.items()} | {c: table.column(c).take(pa.array(at)).to_pylist() for c in columns}
            rows.append(found(data, data["i"][0] != data["j"][0], num, den))
        rows = [x for x in rows if len(x)] or rows[1:] or rows
        rows = np.concatenate(rows)
        rows[:, -2:].sort(axis=1)
        rows = np.unique(rows, axis=0)
        return pa.table({name: pa.array(rows[:, k]) for k, name in enumerate(("bucket", "a", "b")[-rows.shape[1] :])})

    return run


def _linked(num: int, den: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column("features_a"), batch.column("features_b")
            good = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), U64), np.frombuffer(right[i].as_buffer(), U64)
                if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = shared * den >= num * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good)], ["a", "b", "linked"])

    return run


def _deal(volumes: dict[int, int], parts: int) -> np.ndarray:
    """First part of each band: bands get parts by their signatures, ``parts`` at least in all."""
    expected = np.zeros(max(volumes, default=0) + 2)
    for band, shingles in volumes.items():  # a set has signatures in its own band and in the one below
        expected[band] += shingles * SIGNATURES_PER_SHINGLE / 2
        expected[max(0, band - 1)] += shingles * SIGNATURES_PER_SHINGLE / 2
    each = min(SIGNATURES_PER_PART, max(1.0, expected.sum() / parts))
    return np.concatenate([[0], np.cumsum(np.maximum(1, np.ceil(expected / each)).astype(np.int64))])


def _blocked(members: DataFrame, load: str, most: int, width: int) -> DataFrame:
    """Members of buckets with the chunk in which they meet; a bucket of more ``load`` than ``most`` comes in blocks i, j."""
    blocks = members.groupBy("bucket").agg(F.ceil(F.expr(load) / most).cast("int").alias("blocks"))
    dealt = members.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")
    return dealt.withColumn("chunk", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(width)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, class_bits: int = 64, mark: Column | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable by links).

    With ``mark``, a long column over ``docs``, also mark and group, a number that names the
    component even where none of its rows has an id.

    Texts link if the Jaccard similarity of their sets of ``width``-word shingles is at least
    num/den; A-Z are lower-cased, words are runs of other than white space. A null, empty or
    blank text has no shingles, links with nothing and is its own component. Rows repeat as
    the input does; a null id keeps a null component unless its text's class has an id.
    Very long texts are whole; an empty table gives an empty result; other columns are ignored.
    class_bits: bits of a class's first hash; any number gives the same result (tests force clashes).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "partenum")
    small_batches(spark)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), (F.lit(0) if mark is None else mark).cast("long").alias("mark")), F.col(text_col).alias("text"))
    profile = scratch.table(keyed.mapInArrow(_profile(width, num, den, FREQUENT, class_bits), "id long, n long, h1 long, h2 long, band int, mark long, is_text boolean"), "profile")
    rows = profile.where("is_text").drop("is_text", "band")
    classes = profile.where("is_text AND n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("band").alias("band"))
    volumes = {r.band: (r.sets, r.shingles) for r in classes.groupBy("band").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).collect()}  # a row for each band
    n_classes = sum(v[0] for v in volumes.values())
    listed = profile.where("NOT is_text").groupBy("h1").agg(F.sum("n").alias("times")).where(F.col("times") >= max(5, FREQUENT * n_classes))
    frequent = np.sort(np.array([r[0] for r in listed.select("h1").collect()], dtype=np.int64).view(U64))  # at most all shingles / (FREQUENT * n_classes)
    twice = classes.groupBy("h1").count().where("count > 1").select("h1")  # of 10^10 texts about three
    clashing = np.array([r[0] for r in twice.collect()], dtype=np.int64).view(U64)
    dealt = _deal({band: v[1] for band, v in volumes.items()}, shuffled)
    shared = spark.sparkContext.broadcast((dealt, frequent, clashing))
    emit = lambda batches: _emit(width, num, den, class_bits, *shared.value)(batches)
    blobs = texts.mapInArrow(emit, "part int, sigs binary, owners binary, runs binary")
    met = scratch.table(blobs.groupBy("part").applyInArrow(_meet, _BUCKET_SCHEMA), "met")
    scratch.free()
    stars = scratch.table(met.where("bucket IS NULL").select("a", "b").distinct(), "pairs")
    members = met.where("bucket IS NOT NULL").select("bucket", F.col("a").alias("node")).distinct()

    def of_nodes(df: DataFrame, nodes: DataFrame, on: str) -> DataFrame:
        """Rows of df with a node among ``nodes``: few enough are broadcast, more are shuffled."""
        few = nodes.count() <= BROADCAST_NODES
        return df.join(F.broadcast(nodes) if few else nodes, on, "left_semi")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    named = classes.withColumn("clashes", F.lit(False))
    if len(clashing):
        named = classes.join(twice.withColumn("clashes", F.lit(True)), "h1", "left")
    named = named.select("h1", "h2", "rep", F.when(F.col("clashes"), F.col("h2")).otherwise(F.col("h1")).alias("node"))
    wanted = scratch.table(named.join(ends(stars), "node", "left_semi").select(F.col("rep").alias("id")).distinct(), "wanted")
    full_sets = lambda batches: _blob_sets(width, class_bits, shared.value[2])(batches)
    schema = "node long, features binary, sketch binary, n long"
    found = of_nodes(texts, wanted, "id").mapInArrow(full_sets, schema)
    if wanted.where("id IS NULL").take(1):  # classes that only rows without an id have
        found = found.union(texts.where("id IS NULL").mapInArrow(full_sets, schema)).dropDuplicates(["node"])
    sets = scratch.table(found, "sets")
    sketches = sets.select("node", "n", "sketch").distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        """Links among pairs of nodes: sizes and sketches first, then the sets of what is left."""
        side = lambda df, key: df.select(*[F.col(c).alias(key if c == "node" else f"{c}_{key}") for c in df.columns])
        fed = pairs.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        left = scratch.table(fed.mapInArrow(_plausible(num, den), "a long, b long, kept boolean").where("kept").select("a", "b").distinct(), "plausible")
        full = of_nodes(sets.select("node", "features"), scratch.table(ends(left), "nodes"), "node")
        fed = left.join(side(full, "b"), "b").join(side(full, "a"), "a").select("a", "b", "features_a", "features_b")
        return scratch.table(fed.mapInArrow(_linked(num, den), "a long, b long, linked boolean").where("linked").select("a", "b").distinct(), "links")

    def residue(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components so far, and members (with component) of buckets that still hold several."""
        comp = scratch.table(components(links, scratch), "components")
        labelled = members.join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
        mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
        return comp, scratch.table(labelled.join(mixed, "bucket"), "residue")

    def sketched(rest: DataFrame) -> DataFrame:
        chunks = max(shuffled, rest.count() // CHUNK_MEMBERS)
        return _blocked(rest, "count(*)", BLOCK_MEMBERS, chunks).join(sketches, "node").groupBy("chunk")

    scratch.free()
    links = verify(stars)
    scratch.free()
    comp, rest = residue(links)
    tried = stars
    if rest.take(1):  # the nearest pairs join most of what is left
        pairs = sketched(rest).applyInArrow(_each_bucket(_nearest, ("sketch",), num, den), "a long, b long")
        pairs = scratch.table(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        links, tried = links.union(verify(pairs)), tried.union(pairs)
        scratch.free()
        comp, rest = residue(links)
    if rest.take(1):  # buckets with few open pairs give those; in others members meet as sets
        still = scratch.table(sketched(rest).applyInArrow(_each_bucket(_open, ("sketch",), num, den), "bucket long, a long, b long"), "open")
        pairs = scratch.table(still.where("a <> b").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        more = verify(pairs)
        dense = rest.join(still.where("a = b").select("bucket", F.col("a").alias("node")).distinct(), ["bucket", "node"])
        dense = scratch.table(dense.join(sets.select("node", "n").distinct(), "node"), "dense")
        volume = dense.agg(F.sum("n")).first()[0]
        if volume:
            fed = _blocked(dense, "sum(n)", BLOCK_SHINGLES, max(shuffled, volume // (2 * BLOCK_SHINGLES))).join(sets.select("node", "features", "sketch"), "node")
            joining = fed.groupBy("chunk").applyInArrow(_each_bucket(_joining, ("features", "sketch"), num, den), "a long, b long")
            more = more.union(scratch.table(joining.distinct(), "links"))
            scratch.free()
        if more.take(1):
            comp = scratch.table(components(links.union(more), scratch), "components")

    scratch.drop(met, stars, sets)
    named = named.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = named.join(least, "component").select("h1", "h2", "component_id", F.col("component").alias("group"))
    out = rows.join(labels, ["h1", "h2"], "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), *(("mark", "group") if mark is not None else ()))
    out = scratch.table(out, "result")
    scratch.free()
    return out


def op7_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least_of l ON d.doc_id = l.a
"""
