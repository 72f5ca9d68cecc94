"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a fixed public one; each language has a probability for each piece. A word's
likelihood sums over all its segmentations into pieces, by the forward algorithm, and a text's
is the product over its words: no piece crosses a word's bounds, so each distinct word of a
batch is summed once. Piece probabilities come from expectation maximisation with the
forward-backward algorithm over a bounded sample of labelled texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import fed, part_of, small_batches, with_record
from .textkernel import U64, Words, _BASE, _LETTER, _powers, mix, string_slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE = 400  # texts of each language that a model is fitted on, about
ROUNDS = 3
LEARNED = 64  # bytes; longer words of the sample aren't learned from (they are scored like any)
SHORT = 64  # bytes; units of equal length up to this are summed side by side, longer ones one by one
BLOCK = 1 << 16  # bytes of a long unit in which pieces are found together
RESCALED = 4  # steps between rescalings: 29 steps of the least probability stay far above the least double
CACHE = 500_000  # distinct words whose likelihoods a Python worker keeps

#: Letters of any script, byte by byte: A-Z (lower-cased before), a-z and all that isn't ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Lower-cased pieces as bytes, a space for the mark of a word's start, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([i]) for i in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:]:
                found.add(piece.lower())
    return sorted(found)


class Lattice:
    """Finds pieces in words: a table by the top bits of a rolling hash."""

    def __init__(self, pieces: list[bytes]):
        self.longest = max(map(len, pieces))
        self.up = _powers(_BASE, max(SHORT, self.longest) + 2)
        key = np.array([self._hash(np.frombuffer(p, np.uint8)[None, :])[0] for p in pieces], dtype=U64)
        order = np.argsort(key)
        self.key, self.piece = np.append(key[order], U64(0)), np.append(order, -1).astype(np.int32)
        top = (key[order] >> U64(46)).astype(np.int64)
        self.at = np.searchsorted(top, np.arange(1 << 18)).astype(np.int32)
        self.deep = int(np.bincount(top).max())

    def _hash(self, chars: np.ndarray) -> np.ndarray:
        """Of each row of bytes."""
        return mix((_LETTER[chars] * self.up[: chars.shape[1]]).sum(axis=1, dtype=U64) + U64(chars.shape[1]))

    def _look(self, key: np.ndarray) -> np.ndarray:
        """Index of the piece with each key, -1 for none."""
        at = self.at[(key >> U64(46)).astype(np.int64)]
        out = np.full(len(key), -1, dtype=np.int32)
        for k in range(self.deep):
            same = self.key[np.minimum(at + k, len(self.key) - 1)] == key
            out[same] = self.piece[at[same] + k]
        return out

    def find(self, chars: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(from, to) -> index of the piece there in each row, -1 for none."""
        n = chars.shape[1]
        value = _LETTER[chars]
        found = {}
        for i in range(n):
            total = np.zeros(len(chars), dtype=U64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                total = total + value[:, j - 1] * self.up[j - 1 - i]
                out = self._look(mix(total + U64(j - i)))
                if (out >= 0).any():
                    found[i, j] = out
        return found

    def ending(self, chars: np.ndarray, a: int, b: int) -> np.ndarray:
        """Of one long unit: row j - a - 1, column k: the piece from j - k - 1 to j, for j in a + 1 .. b; -1 for none."""
        first = max(0, a - self.longest + 1)
        value = _LETTER[chars[first:b]]
        out = np.full((b - a, self.longest), -1, dtype=np.int32)
        total = np.zeros(len(value), dtype=U64)
        for k in range(min(self.longest, len(value))):
            total = total[: len(value) - k] + value[k:] * self.up[k]
            end = first + k + 1 + np.arange(len(total))
            on = end > a
            out[end[on] - a - 1, k] = self._look(mix(total[on] + U64(k + 1)))
        return out

    def forward(self, chars: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log likelihood of each row (equal lengths) in each language; p: pieces by languages, the last row 0."""
        found, n = self.find(chars), chars.shape[1]
        alpha = np.zeros((n + 1, len(chars), p.shape[1]))
        alpha[0] = 1
        log = np.zeros((len(chars), p.shape[1]))
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                if (i, j) in found:
                    alpha[j] += alpha[i] * p[found[i, j]]
            if j % RESCALED == 0:
                scale = alpha[j].copy()
                log += np.log(scale)
                alpha[max(0, j - self.longest) : j + 1] /= scale
        return log + np.log(alpha[n])

    def forward_long(self, chars: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The same of one unit of any length: a rolling window of prefixes, blocks of bytes."""
        alpha = np.zeros((self.longest, p.shape[1]))  # row k: the prefix that ends k + 1 bytes back
        alpha[0] = 1
        log = np.zeros(p.shape[1])
        for a in range(0, len(chars), BLOCK):
            pieces = self.ending(chars, a, min(len(chars), a + BLOCK))
            some = pieces >= 0
            for j in range(len(pieces)):
                on = some[j]
                now = (alpha[on] * p[pieces[j, on]]).sum(axis=0)
                alpha[1:] = alpha[:-1] / now
                alpha[0] = 1
                log += np.log(now)
        return log

    def expect(self, chars: np.ndarray, weight: np.ndarray, p: np.ndarray, total: np.ndarray) -> None:
        """Add to ``total`` the expected use of each piece in each language; weight: rows by languages."""
        found, n = self.find(chars), chars.shape[1]
        with np.errstate(divide="ignore"):
            log = np.log(p)
        alpha, beta = (np.full((n + 1, len(chars), p.shape[1]), -np.inf) for _ in range(2))
        alpha[0], beta[n] = 0, 0
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                if (i, j) in found:
                    alpha[j] = np.logaddexp(alpha[j], alpha[i] + log[found[i, j]])
        for i in range(n - 1, -1, -1):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if (i, j) in found:
                    beta[i] = np.logaddexp(beta[i], beta[j] + log[found[i, j]])
        for (i, j), piece in found.items():
            on = piece >= 0
            used = np.exp(alpha[i, on] + log[piece[on]] + beta[j, on] - alpha[n, on]) * weight[on]
            np.add.at(total, piece[on], used)


def _by_length(words: list[bytes]):
    """(indices, matrix of bytes) of words of equal length; each begins with a space."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), n)


class Model:
    """Languages and their piece probabilities."""

    def __init__(self, pieces: list[bytes], languages: list[str]):
        self.lattice, self.languages, self.n = Lattice(pieces), languages, len(pieces)
        self.p = np.zeros((self.n + 1, len(languages)))
        self.p[:-1] = 1 / self.n
        self.keys, self.values = np.empty(0, U64), np.empty((0, len(languages)))

    def fit(self, counts: dict[bytes, np.ndarray]) -> Model:
        """counts: each word's uses in each language."""
        words, step = [w for w in counts if len(w) <= LEARNED], max(200, 80_000 // len(self.languages))
        for _ in range(ROUNDS):
            total = np.zeros((self.n, len(self.languages)))
            for at, chars in _by_length(words):
                for a in range(0, len(at), step):
                    self.lattice.expect(chars[a : a + step], np.array([counts[words[i]] for i in at[a : a + step]], dtype=float), self.p, total)
            total += 0.02
            self.p[:-1] = total / total.sum(axis=0)
        return self

    def likelihood(self, words: list[bytes]) -> np.ndarray:
        """Log likelihood of each word in each language."""
        out, step = np.zeros((len(words), len(self.languages))), max(200, 80_000 // len(self.languages))
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        for at, chars in _by_length([words[i] for i in short]):
            for a in range(0, len(at), step):
                out[[short[i] for i in at[a : a + step]]] = self.lattice.forward(chars[a : a + step], self.p)
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self.lattice.forward_long(np.frombuffer(w, np.uint8), self.p)
        return out

    def score(self, words: Words) -> np.ndarray:
        """Log likelihood of each text in each language."""
        out = np.zeros((words.n_texts, len(self.languages)))
        if not len(words.start):
            return out
        key, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        values = np.empty((len(key), len(self.languages)))
        values[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            values[new] = self.likelihood([b" " + words.word(i) for i in first[new]])
            if len(self.keys) + len(new) > CACHE:
                self.keys, self.values = self.keys[:0], self.values[:0]
            keys = np.concatenate([self.keys, key[new]])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], np.concatenate([self.values, values[new]])[order]
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(words.text_of, weights=values[which, k], minlength=words.n_texts)
        return out


def _remainder(id_col: str, m: int):
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % m


def training_rows(id_col: str):
    """Rows that a model may learn from: those that aren't held out."""
    return _remainder(id_col, 5) != 0


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> Model | None:
    """A model of the languages of ``lang_col``; None if no text has one.

    Fitted on a bounded sample: of each language at most ``sample`` texts, those with the least
    hashes of id and text, and of these the words of at most ``LEARNED`` bytes. Texts that
    are null or have no language teach nothing; equal rows may be drawn alike.
    """
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)).alias("place")
    sizes = {r[0]: r[1] for r in named.groupBy(F.col(lang_col).cast("string").alias("lang")).count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1 << 30, int(2.0 * sample / n * (1 << 30)) + 1)))])
    rows = named.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), place).where(F.col("place") < share[F.col("lang")])
    taken = {lang: 0 for lang in languages}
    counts: dict[bytes, np.ndarray] = {}
    for lang, text, _ in sorted(rows.toLocalIterator(), key=lambda r: (r.place, r.text)):
        if taken[lang] >= sample:
            continue
        taken[lang] += 1
        for _, _, data, offsets in string_slices(pa.array([text]), 1 << 40):
            words = Words(data, offsets, LETTERS)
            _, first, times = np.unique(words.hash, return_index=True, return_counts=True)
            for i, n in zip(first.tolist(), times.tolist()):
                word = b" " + words.word(i)
                if word not in counts:
                    counts[word] = np.zeros(len(languages))
                counts[word][languages.index(lang)] += n
    return Model(read_pieces(vocabulary), languages).fit(counts)


def predict_languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per document: doc_id, lang_pred, score; with ``whole`` record, the input row as a struct, in place of doc_id.

    score: the predicted language's share of the likelihoods. A text that is null or has no
    letter, and any text where no language was learned, is ``und`` with score 0; ties go to
    the language first by name. Whole texts of any size are scored; rows repeat as the input
    does; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = fed(docs, whole, doc_id=F.col(id_col).cast("long"), text=text)
    rows = rows.withColumn("lettered", F.coalesce((F.col("record")[text_col] if whole else F.col("text")).rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        return rows.select(rows.columns[0], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in string_slices(part_of(batch, "text", text_col)):
                log = model.score(Words(data, offsets, LETTERS))
                best = log.argmax(axis=1)
                score = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
                on = lettered[a:b]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(names[np.where(on, best, len(names) - 1)], pa.string()), pa.array(np.where(on, score, 0.0))],
                    [batch.schema.names[0], "lang_pred", "score"],
                )

    return rows.mapInArrow(run, with_record("doc_id long, lang_pred string, score double", rows))


def op1_marginal_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.where(training_rows("doc_id")))
    found = predict_languages(docs, model)
    return found.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
