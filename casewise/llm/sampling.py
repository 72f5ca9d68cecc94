"""Encoding by sampled segmentations, and lossless decoding, over a fixed public vocabulary.

Text is a space, then the text's bytes. Every space starts a unit, and no piece crosses into
the next unit; single-byte pieces cover what the vocabulary lacks, so any text has a
segmentation. Forward filtering sums the weights of all segmentations of each prefix of a
distinct unit; backward sampling then draws, for each occurrence, the last piece, the one
before it, and so on. A draw depends only on the row's key and its byte position, so the same
row has the same segmentation wherever and however often it is encoded.

The vocabulary has ranks, not probabilities: a piece weighs 1 / (rank + 1) to the power
``sharpness``, a single byte far less.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import BLOCK, RESCALED, SHORT, VOCABULARY, Lattice
from .scratch import small_batches
from .textkernel import _LETTER, U64, _Powers, mix, string_slices

SHARPNESS = 1.5
BYTE_WEIGHT = 1e-9
ENCODED_BYTES = 5 << 19  # of text encoded together; a unit's choices are found once for them
_SPACE = 0x20


class Pieces:
    """Pieces as bytes (a space for the mark of a unit's start), their ids and weights."""

    def __init__(self, path: str = VOCABULARY, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        whole, single = {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                single[bytes([int(piece[3:5], 16)])] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                raw = piece.replace("▁", " ").encode()
                if b" " not in raw[1:]:
                    whole[raw] = i
        if len(single) != 256:
            raise ValueError("the vocabulary needs a piece for each byte")
        texts = [*whole, *(b for b in single if b not in whole)]
        self.by_byte = [single[bytes([b])] for b in range(256)]
        self.ids = np.array([whole.get(t, single.get(t)) for t in texts], dtype=np.int32)
        rank = np.array([whole[t] + 1.0 if t in whole else 0 for t in texts])
        self.weight = np.append(np.where(rank > 0, np.maximum(rank, 1.0) ** -sharpness, BYTE_WEIGHT), 0.0)
        self.lattice = Lattice(texts)
        every = {i: t for t, i in [*single.items(), *whole.items()]}
        by_id = [every.get(i, b"") for i in range(model.get_piece_size())]
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.size = np.array([len(b) for b in by_id], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def decode_one(self, i: int) -> bytes:
        return self.blob[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def byte_id(self, byte: int) -> int:
        return self.by_byte[byte]

    def choices(self, chars: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
        """For rows of n bytes, the last pieces of each prefix: (state, share so far, length, id), longest first.

        State of row r's prefix of j bytes: first + r * n + j - 1.
        """
        found, n = self.lattice.find(chars), chars.shape[1]
        rows = len(chars)
        alpha = np.zeros((n + 1, rows))
        alpha[0] = 1
        states, shares, lengths, ids = [], [], [], []
        for j in range(1, n + 1):
            parts = [(i, found[i, j], alpha[i] * self.weight[found[i, j]]) for i in range(max(0, j - self.lattice.longest), j) if (i, j) in found]
            alpha[j] = sum(x for _, _, x in parts)
            rescaled = alpha[j].copy() if j % RESCALED == 0 else None
            so_far = np.zeros(rows)
            for i, piece, x in parts:
                so_far = so_far + x / alpha[j]
                on = np.flatnonzero(piece >= 0)
                states.append((first + on * n + j - 1).astype(np.int32))
                shares.append(so_far[on].astype(np.float32))
                lengths.append(np.full(len(on), j - i, dtype=np.int8))
                ids.append(self.ids[piece[on]])
            if rescaled is not None:
                alpha[max(0, j - self.lattice.longest) : j + 1] /= rescaled
        return np.concatenate(states), np.concatenate(shares), np.concatenate(lengths), np.concatenate(ids)

    def prefixes(self, chars: np.ndarray) -> np.ndarray:
        """Of one unit of any length: the log of the weight of all segmentations of each prefix."""
        longest = self.lattice.longest
        log = np.zeros(len(chars) + 1)
        window, total = [1.0], 0.0  # of the last prefixes, each over the last one's weight
        for a in range(0, len(chars), BLOCK):
            found = self.lattice.ending(chars, a, min(len(chars), a + BLOCK))
            row, back = np.nonzero(found >= 0)
            at, weight, back = np.searchsorted(row, np.arange(len(found) + 1)).tolist(), self.weight[found[row, back]].tolist(), back.tolist()
            for j in range(len(found)):
                now = sum(window[-1 - back[k]] * weight[k] for k in range(at[j], at[j + 1]))
                total += math.log(now)
                log[a + j + 1] = total
                window = [x / now for x in window[1 - longest :]] + [1.0] if longest > 1 else [1.0]
        return log

    def walk(self, chars: np.ndarray, log: np.ndarray, seed: np.uint64, origin: int):
        """(from, id) of the pieces of one drawn segmentation, last piece first; origin: of the unit in its text."""
        longest, j, a = self.lattice.longest, len(chars), len(chars)
        while j > 0:
            if j <= a:  # rows of ``found`` are ends a + 1 .. b
                b, a = j, max(0, j - BLOCK)
                found = self.lattice.ending(chars, a, b)
                draws = (mix(mix(np.array([seed])) ^ mix((origin + np.arange(a + 1, b + 1)).astype(U64))) >> U64(11)).astype(np.float64) * 2.0**-53
            row, draw, so_far, chosen = found[j - a - 1], draws[j - a - 1], 0.0, 0
            for k in range(min(longest, j) - 1, -1, -1):
                if row[k] >= 0:
                    so_far += math.exp(log[j - k - 1] - log[j]) * self.weight[row[k]]
                    chosen = k
                    if draw < so_far:
                        break
            yield j - chosen - 1, self.ids[row[chosen]]
            j -= chosen + 1

    def encode(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, bounds) of texts data[offsets[i]:offsets[i+1]]; an empty text has none."""
        size = np.diff(offsets)
        on = size > 0
        text_at = np.cumsum((size + 1) * on) - (size + 1) * on
        total = int(((size + 1) * on).sum())
        buf = np.full(total, _SPACE, dtype=np.uint8)
        body = np.ones(total, dtype=bool)
        body[text_at[on]] = False
        buf[body] = data[offsets[0] : offsets[-1]]
        start = np.flatnonzero(buf == _SPACE)
        length = np.diff(np.append(start, total))
        ids_at = np.full(total, -1, dtype=np.int32)
        short = length <= SHORT
        if short.any():
            self._sample(buf, start[short], length[short], text_at, on, seeds, ids_at)
        prefixes: dict[bytes, np.ndarray] = {}
        for a, n in zip(start[~short].tolist(), length[~short].tolist()):
            text = np.searchsorted(text_at[on], a, side="right") - 1
            chars = buf[a : a + n]
            raw = chars.tobytes()
            if raw not in prefixes:
                prefixes = {raw: self.prefixes(chars)}  # of the last long unit
            for left, piece in self.walk(chars, prefixes[raw], seeds[on][text], a - int(text_at[on][text])):
                ids_at[a + left] = piece
        used = ids_at >= 0
        bounds = np.concatenate([[0], np.cumsum(used)])[np.append(text_at, total)]
        return ids_at[used], bounds

    def _sample(self, buf, start, length, text_at, on, seeds, ids_at) -> None:
        _Powers.reach(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, dtype=U64)
        np.cumsum(_LETTER[buf] * _Powers.up[: len(buf)], out=sums[1:])
        key = mix((sums[start + length] - sums[start]) * _Powers.down[start] + length.astype(U64))
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        base = np.zeros(len(first), dtype=np.int64)
        parts, states = [], 0
        sizes = length[first]
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            for a in range(0, len(rows), 50_000):
                some = rows[a : a + 50_000]
                chars = buf[start[first[some]][:, None] + np.arange(n)]
                base[some] = states + np.arange(len(some)) * n
                parts.append(self.choices(chars, states))
                states += len(some) * int(n)
        state, share, taken, piece = map(np.concatenate, zip(*parts))
        del parts, sums, key
        order = np.argsort(state, kind="stable").astype(np.int32)
        row_at = np.searchsorted(state[order], np.arange(states, dtype=np.int32)).astype(np.int32)
        last = np.append(row_at[1:], np.int32(len(state))) - 1
        share, taken, piece = share[order], taken[order], piece[order]
        del state, order

        owner = np.searchsorted(text_at[on], start, side="right") - 1
        seed, origin = mix(seeds[on])[owner], start - text_at[on][owner]
        base, end, unit = base[which], length.copy(), np.arange(len(start))
        while len(unit):
            j = end[unit]
            draw = (mix(seed[unit] ^ mix((origin[unit] + j).astype(U64))) >> U64(11)).astype(np.float64) * 2.0**-53
            at, stop = row_at[base[unit] + j - 1], last[base[unit] + j - 1]
            going = np.flatnonzero((draw >= share[at]) & (at < stop))
            while len(going):
                at[going] += 1
                going = going[(draw[going] >= share[at[going]]) & (at[going] < stop[going])]
            left = j - taken[at]
            ids_at[start[unit] + left] = piece[at]
            end[unit] = left
            unit = unit[left > 0]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts' bytes: pieces end to end, less the first space."""
        size = self.size[ids]
        at = np.cumsum(size) - size
        raw = self.blob[np.arange(int(size.sum())) + np.repeat(self.start[ids] - at, size)]
        ends = np.append(at, len(raw))[bounds]
        whole = raw.tobytes()
        return [whole[a + 1 : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encode_sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, vocabulary: str = VOCABULARY, sharpness: float = SHARPNESS) -> DataFrame:
    """One row per document: doc_id, tokens (ids), n_tokens, lossless (decoding gives the text's bytes back).

    Rows with equal ids and texts have equal segmentations; a null or empty text has no
    tokens and is lossless as empty. Long texts and unbroken runs of any length are encoded
    whole: every segmentation can be drawn, at its share of the weights. A null id draws as
    its own key, and so do repeated ids. An empty table gives an empty result; other columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    fed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("key"))
    made: dict = {}

    def run(batches):
        if not made:
            made[0] = Pieces(vocabulary, sharpness)
        pieces = made[0]
        for batch in batches:
            keys = batch.column("key").to_numpy().view(U64)
            for a, b, data, offsets in string_slices(batch.column("text"), ENCODED_BYTES):
                ids, bounds = pieces.encode(data, offsets, keys[a:b])
                raw = data[offsets[0] : offsets[-1]].tobytes()
                cut = (offsets - offsets[0]).tolist()
                good = [raw[x:y] == text for x, y, text in zip(cut[:-1], cut[1:], pieces.decode(ids, bounds))]
                tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), tokens, pa.array(np.diff(bounds)), pa.array(good)], ["doc_id", "tokens", "n_tokens", "lossless"])

    return fed.mapInArrow(run, "doc_id long, tokens array<int>, n_tokens long, lossless boolean")


def decode_tokens(tokens: DataFrame, tokens_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of (doc_id, tokens) rows; null tokens give a null text."""
    made: dict = {}

    def run(batches):
        if not made:
            made[0] = Pieces(vocabulary)
        for batch in batches:
            column = batch.column(1)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()])]).astype(np.int64)
            texts = made[0].decode(ids, bounds)
            known = column.is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() if k else None for t, k in zip(texts, known)], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", tokens_col).mapInArrow(run, "doc_id long, text string")


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"))
