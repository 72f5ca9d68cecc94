"""Toxicity by a support vector machine on the gap-weighted subsequence kernel.

The kernel of two words sums over their common subsequences of two to four characters, each
weighted by a decay to the power of the spans it takes up in both, so inserted characters
lower the similarity but don't end it. Nystroem landmarks turn the kernel into a feature map
of fixed size; a squared-hinge machine is fitted there by Newton steps. Labels belong to
texts, the machine to words: a toxic text has some toxic word, a clean one few or none, so
the words that stand for toxic texts are chosen anew after each fit. They start from words, and
from families of words with a common run of bytes (an insult with varying endings), that far
more toxic than clean texts have; the families' runs are landmarks. A text's score is a logistic
curve over its worst word and over how many of its words, and what share, are toxic.

Words: runs of other than white space, lower-cased, less all but digits, letters and
non-ASCII characters (``i-d.i*o-t`` is one word); three or more single characters in a row are
one word too. A word of over ``WINDOW`` bytes is seen through overlapping windows of that size, so a
run that lies in one of them counts; a word of one byte has no subsequence and counts as clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import _remainder
from .textkernel import _LETTER, ALNUM, SPACED, U64, Words, _Powers, mix, string_slices

DECAY = np.float32(0.6)
ORDERS = (2, 3, 4)
WINDOW, STRIDE = 24, 12  # bytes
LANDMARKS = 36
SAMPLE = 1200  # labelled texts of each class that a model is fitted on, at most
RUNS = range(4, 9)  # bytes of a family's common run
FAMILIES = 20  # families, at most
CACHE = 2_000_000  # words whose scores a Python worker keeps
STRONG, SUPPORT, TIMES = 4.0, 4, 5  # standard errors, toxic texts and times the share of clean texts from which a word or family stands for a label
COST = 100.0
WEIGHED = 0.01  # all toxic words together, of all clean words
THRESHOLD = 0.7


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, text) of the words of texts data[offsets[i]:offsets[i+1]]."""
    words = Words(data, offsets, SPACED)
    inside = ALNUM[words.buf]
    place = np.concatenate([[0], np.cumsum(inside)])
    buf = words.buf[inside]
    start, end, text = place[words.start], place[words.end], words.text_of
    on = end > start
    start, end, text = start[on], end[on], text[on]
    letters = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # characters, by their leading bytes
    single = np.concatenate([[False], letters[end] - letters[start] == 1, [False]])
    same = np.concatenate([[False], text[1:] == text[:-1], [False]]) if len(text) else np.zeros(1, bool)
    joined = single[1:-1] & single[:-2] & same[:-1] if len(text) else np.zeros(0, bool)  # goes on from the word before
    if joined.any():
        first = np.flatnonzero(~joined)
        size = np.diff(np.append(first, len(start)))
        many = first[size >= 3]
        start, end, text = np.concatenate([start, start[many]]), np.concatenate([end, end[many + size[size >= 3] - 1]]), np.concatenate([text, text[many]])
    length = end - start
    long = np.flatnonzero(length > WINDOW)
    if len(long):
        cuts = -(-(length[long] - WINDOW) // STRIDE) + 1
        k = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = np.repeat(start[long], cuts) + k * STRIDE
        stop = np.minimum(begin + WINDOW, np.repeat(end[long], cuts))
        keep = length <= WINDOW
        start, end, text = np.concatenate([start[keep], begin]), np.concatenate([end[keep], stop]), np.concatenate([text[keep], np.repeat(text[long], cuts)])
    return buf, start, end, text


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _Powers.reach(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(_LETTER[buf] * _Powers.up[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _Powers.down[start] + (end - start).astype(U64))


def _subsequences(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernels of each order: s[..., n] against t[..., m], broadcast; zero bytes match nothing. Orders come first."""
    shape = np.broadcast_shapes(s.shape[:-1], t.shape[:-1])
    top, m = max(ORDERS), t.shape[-1]
    square = DECAY * DECAY
    out = np.zeros((top + 1, *shape), dtype=np.float32)
    before = np.zeros((top, m + 1, *shape), dtype=np.float32)  # K' of orders 0 .. top - 1 for prefixes of s so far
    before[0] = 1
    for i in range(s.shape[-1]):
        now = before.copy()
        tail = np.zeros((top, *shape), dtype=np.float32)
        for j in range(m):
            equal = ((s[..., i] == t[..., j]) & (s[..., i] > 0)).astype(np.float32) * square
            gain = before[:, j] * equal
            out[1:] += gain
            tail[1:] = tail[1:] * DECAY + gain[:-1]
            now[1:, j + 1] = before[1:, j + 1] * DECAY + tail[1:]
        before = now
    return out[list(ORDERS)]


def _matrix(words: list[bytes]) -> np.ndarray:
    wide = max(map(len, words))
    return np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)


class Kernel:
    """Mean over orders of normalised kernels with fixed landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.n, size = len(landmarks), np.array([len(w) for w in landmarks])
        self.groups = []  # (places, bytes, own kernels) of landmarks of equal length
        for m in np.unique(size):
            at = np.flatnonzero(size == m)
            t = _matrix([landmarks[i] for i in at])
            self.groups.append((at, t, np.maximum(_subsequences(t, t), 1e-12)))

    def features(self, words: list[bytes]) -> np.ndarray:
        """Words by landmarks."""
        out = np.zeros((len(words), self.n), dtype=np.float32)
        size = np.array([len(w) for w in words])
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            chars = np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), n)
            own = np.concatenate([np.maximum(_subsequences(chars[a : a + 8000], chars[a : a + 8000]), 1e-12) for a in range(0, len(at), 8000)], axis=1)
            for places, t, its in self.groups:
                step = max(1, 8000 // len(places))
                for a in range(0, len(at), step):
                    both = _subsequences(chars[a : a + step, None, :], t[None, :, :])
                    out[at[a : a + step, None], places] = (both / np.sqrt(own[:, a : a + step, None] * its[:, None, :])).mean(axis=0)
        return out


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge machine on x, by Newton steps on the active set."""
    z = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(30):
        active = y * (z @ w) < 1
        c = 2 * cost * weight[active]
        new = np.linalg.solve(ridge + (z[active].T * c) @ z[active], z[active].T @ (c * y[active]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes of a logistic curve from the columns of z (the last is 1) to the share of y."""
    ab, ridge = np.zeros(z.shape[1]), 1e-2 * np.eye(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ ab, -30, 30)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + ridge, z.T @ (weight * (y - p)) - ridge @ ab)
        ab = ab + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return ab


def _strength(toxic, clean, n1: int, n0: int):
    """How far texts with a mark tell the classes apart, in standard errors; 0 where support is too small."""
    p1, p0 = (toxic + 0.1) / (n1 + 0.2), (clean + 0.1) / (n0 + 0.2)
    return (p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) * ((p1 > TIMES * p0) & (toxic >= SUPPORT))


def _runs_of(words: set[bytes], sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(distinct hashes, place and size of one occurrence, bytes) of the runs of ``sizes`` bytes in a text's words."""
    raw, size = b"".join(words), np.array([len(w) for w in words], dtype=np.int64)
    if not raw:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64), raw
    left = np.repeat(np.cumsum(size), size) - np.arange(len(raw))  # bytes from here to the word's end
    at = [np.flatnonzero(left >= n) for n in sizes]
    first, long = np.concatenate(at), np.repeat(list(sizes), [len(x) for x in at])
    key, one = np.unique(_hashes(np.frombuffer(raw, np.uint8), first, first + long), return_index=True)
    return key, first[one], long[one], raw


def _families(units: list[set[bytes]], toxic: np.ndarray) -> list[bytes]:
    """Runs of bytes that tell toxic texts apart; each next one is chosen for the toxic texts that no earlier one is in."""
    bad, good = ([u for u, label in zip(units, toxic) if label == k] for k in (1, 0))
    found = np.empty(0, U64)
    for n in RUNS:  # one size at a time, so that few are held
        one, times = np.unique(np.concatenate([np.empty(0, U64), *(_runs_of(u, [n])[0] for u in bad)]), return_counts=True)
        found = np.concatenate([found, one[times >= SUPPORT]])
    found = np.sort(found)
    if not len(found):
        return []

    def places(key):
        at = np.minimum(np.searchsorted(found, key), len(found) - 1)
        return at[found[at] == key]

    clean = np.zeros(len(found))
    for u in good:
        clean[places(_runs_of(u, RUNS)[0])] += 1
    which = [places(_runs_of(u, RUNS)[0]).astype(np.int32) for u in bad]
    text, which = np.repeat(np.arange(len(which)), [len(x) for x in which]), np.concatenate(which)
    rare = clean[which] < len(good) / TIMES
    text, which = text[rare], which[rare]
    left, out = np.ones(len(bad), dtype=bool), []
    while len(out) < FAMILIES and left.sum() > SUPPORT:
        strength = _strength(np.bincount(which[left[text]], minlength=len(found)).astype(float), clean, int(left.sum()), max(1, len(good)))
        best = int(strength.argmax())
        if strength[best] <= STRONG:
            break
        has = text[which == best]
        key, first, long, raw = _runs_of(bad[has[0]], RUNS)
        k = int(np.flatnonzero(key == found[best])[0])
        out.append(raw[first[k] : first[k] + long[k]])
        left[has] = False
    return out


def _altered(word: bytes) -> list[bytes]:
    """The word with one character more, at each place inside: one that no word has, or the one before again."""
    return [word[:i] + extra + word[i:] for i in range(1, len(word)) for extra in (b"\x01", word[i - 1 : i])]


def _first_of_kind(units: list[set[bytes]], toxic: np.ndarray) -> np.ndarray:
    """Which texts aren't near copies (half of 16 minima equal) of an earlier text of their class."""
    salts = mix(np.arange(1, 17, dtype=U64))
    marks = np.zeros((len(units), 16), dtype=U64)
    for i, words in enumerate(units):
        if words:
            raw, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
            end = np.cumsum(size)
            marks[i] = mix(_hashes(raw, end - size, end)[:, None] ^ salts).min(axis=0)
    keep = np.ones(len(units), dtype=bool)
    for i in range(1, len(units)):
        before = np.flatnonzero(keep[:i] & (toxic[:i] == toxic[i]))
        keep[i] = not ((marks[before] == marks[i]).sum(axis=1) >= 8).any()
    return keep


class Model:
    def __init__(self):
        self.keys, self.values = np.empty(0, U64), np.empty(0)
        self.kernel, self.beta, self.bias, self.curve = None, None, 0.0, np.zeros(4)

    def fit(self, texts: list[str], toxic: np.ndarray, population: tuple[int, int]) -> Model:
        """population: clean and toxic texts that the sample stands for."""
        units: list[set[bytes]] = []
        for _, _, data, offsets in string_slices(pa.array(texts, pa.string()), 1 << 40):
            buf, start, end, text = word_units(data, offsets)
            raw = buf.tobytes()
            units = [set() for _ in texts]
            for t, a, b in zip(text.tolist(), start.tolist(), end.tolist()):
                units[t].add(raw[a:b])
        keep = _first_of_kind(units, toxic)  # else a much-copied text's words would look like its label
        texts, units, toxic = [t for t, k in zip(texts, keep) if k], [u for u, k in zip(units, keep) if k], toxic[keep]
        seen: dict[bytes, list[int]] = {}
        for words, label in zip(units, toxic):
            for w in words:
                seen.setdefault(w, [0, 0])[label] += 1
        names = sorted(w for w in seen if len(w) >= min(ORDERS))
        if not names or len(set(toxic)) < 2:
            share = float(np.mean(toxic)) if len(toxic) else 0.0
            self.curve = np.array([0, 0, 0, np.log((share + 1e-3) / (1 - share + 1e-3))])
            return self
        in_toxic, in_clean = (np.array([seen[w][k] for w in names], dtype=float) for k in (1, 0))
        n1, n0 = (toxic == 1).sum(), (toxic == 0).sum()
        odds = _strength(in_toxic, in_clean, n1, n0)
        order = np.lexsort((names, -odds))
        families = _families(units, toxic)
        kin = np.array([any(f in w for f in families) for w in names])
        value = {names[i]: STRONG + 1 if kin[i] else odds[i] for i in order}
        alone = [names[i] for i in order[: LANDMARKS // 2] if odds[i] > STRONG and not kin[i]]
        marks = [*families, *alone][: LANDMARKS * 2 // 3] or [names[order[0]]]
        clean = sorted((w for w in names if seen[w][0]), key=lambda w: int(_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]))
        likeness = Kernel(marks).features(clean).max(axis=1)
        hard = [clean[i] for i in np.lexsort((np.arange(len(clean)), -likeness))]
        marks = list(dict.fromkeys([*marks, *hard[: LANDMARKS // 6], *clean]))[:LANDMARKS]
        self.kernel = Kernel(marks)
        gram = self.kernel.features(marks).astype(np.float64)
        e, v = np.linalg.eigh((gram + gram.T) / 2)
        root = v / np.sqrt(np.maximum(e, 1e-3)) @ v.T

        x0 = self.kernel.features(clean) @ root
        every = sorted(set().union(*(u for u, label in zip(units, toxic) if label)) & value.keys())
        place = {w: i for i, w in enumerate(every)}
        x1 = self.kernel.features(every) @ root
        worth = odds_of = np.array([value[w] for w in every])
        for turn in range(3):
            chosen: dict[int, int] = {}
            for words, label in zip(units, toxic):
                if label:
                    at = [place[w] for w in sorted(words) if w in place]
                    for i in at:
                        if worth[i] > 0 if turn else odds_of[i] > STRONG:
                            chosen[i] = chosen.get(i, 0) + 1
            if not chosen:
                break
            rows = list(chosen)
            altered = [v for r in rows for v in _altered(every[r])]  # with a character more
            x = np.concatenate([x0, x1[rows], self.kernel.features(altered) @ root])
            y = np.concatenate([-np.ones(len(x0)), np.ones(len(rows) + len(altered))])
            times = np.sqrt([chosen[r] for r in rows])
            total = len(x0) * WEIGHED
            weight = np.concatenate([np.ones(len(x0)), times * (total / times.sum()), np.full(len(altered), total / (4 * max(1, len(altered))))])
            w, self.bias = _newton(x, y, weight, COST)
            worth = x1 @ w + self.bias
            self.beta = (root @ w).astype(np.float64)
        if self.beta is None:
            self.beta = np.zeros(len(marks))
        z = self.evidence(pa.array(texts, pa.string()))
        weight = np.where(toxic == 1, population[1] / max(1, n1), population[0] / max(1, n0))
        self.curve = _curve(z, toxic.astype(float), weight / weight.mean())
        return self

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Of each text: the highest word score (-2 where it has no word), how many toxic words, their share, 1."""
        found = [self._evidence(data, offsets) for _, _, data, offsets in string_slices(column)]
        return np.concatenate(found) if found else np.empty((0, 4))

    def _evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.tile([-2.0, 0.0, 0.0, 1.0], (len(offsets) - 1, 1))
        buf, start, end, text = word_units(data, offsets)
        on = end - start >= min(ORDERS)
        start, end, text = start[on], end[on], text[on]
        if not len(start) or self.kernel is None:
            return out
        key, first, which = np.unique(_hashes(buf, start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        values = np.empty(len(key))
        values[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = buf.tobytes()
            words = [raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())]
            values[new] = self.kernel.features(words) @ self.beta + self.bias
            if len(self.keys) + len(new) > CACHE:
                self.keys, self.values = self.keys[:0], self.values[:0]
            keys = np.concatenate([self.keys, key[new]])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], np.concatenate([self.values, values[new]])[order]
        value = values[which]
        np.maximum.at(out[:, 0], text, np.maximum(value, -2.0))
        out[:, 0] = np.minimum(out[:, 0], 1.0)
        bad, every = (np.bincount(t, minlength=len(out)) for t in (text[value > 0], text))
        out[:, 1] = np.log1p(bad)
        out[:, 2] = np.log1p(1000 * bad / np.maximum(every, 1))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(column) @ self.curve, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from texts with labels 0 or 1.

    Fitted on a bounded sample: of each class at most ``sample`` texts, those whose ids have
    the least hashes. Null ids, texts and labels are left out; of an id's several labels the
    greatest counts, of its several texts the first in order.
    """
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), place.alias("place"))
    counts = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1 << 30, int(1.3 * sample / max(1, counts.get(1, 0)) * (1 << 30)) + 1))).otherwise(F.lit(min(1 << 30, int(1.3 * sample / max(1, counts.get(0, 0)) * (1 << 30)) + 1)))
    few = marked.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < share)
    kept: dict[int, tuple] = {}
    for r in texts.join(F.broadcast(few), "id").toLocalIterator():  # at most about 2.6 x sample ids
        now = (r.place, r.id, r.text, r.toxic)
        kept[r.id] = min(kept.get(r.id, now), now)
    chosen = [x for label in (0, 1) for x in sorted(v for v in kept.values() if v[3] == label)[:sample]]
    return Model().fit([x[2] for x in chosen], np.array([x[3] for x in chosen], dtype=int), (counts.get(0, 0), counts.get(1, 0)))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1). Null, empty and wordless texts get the score
    of no evidence; whole texts of any size are scored; rows repeat as the input does."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs.where(_remainder("doc_id", 3) != 1), labels.where(_remainder("doc_id", 3) != 1).select("doc_id", "toxic"))
    found = score_toxicity(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
