"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of a public piece vocabulary, single bytes included. The probability of a word
is the sum over all its segmentations into pieces, by the forward algorithm, and that of a text the product over its words
(pieces don't cross blanks; a word carries the blank before it). Pieces' probabilities are learned by expectation
maximisation over all segmentations of the words of a bounded sample of labelled texts. The posterior of the likeliest
language, all being equally likely beforehand, is the score.

Words are runs of letters and non-ASCII characters, lower-cased; digits and signs say nothing. Tasks score each distinct word once, for
all languages and many words at a time, in numpy; a longer run is summed by itself, a block at a time with the sums of the last positions
that a piece can reach back to, so the result is exact for runs of any length. Only for learning are runs of more than LONGEST bytes cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.llm.words import U, byte_table, mix, text_slices, word_spans

LETTERS = byte_table(bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Bytes of words that are scored many at a time, and positions of a longer one that are scored at once.
LONGEST, REACH = 96, 4096
#: Labelled texts per language that a model is fitted on, about.
TRAINING_TEXTS = 200
#: Distinct words whose probabilities a task remembers; then it starts anew.
REMEMBERED = 1_000_000
UNKNOWN = "und"


def vocabulary(file: str) -> list[bytes]:
    """The pieces of a sentencepiece vocabulary as bytes, the word mark as a blank, and every single byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    pieces = {bytes([i]) for i in range(256)}
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            pieces.add(model.id_to_piece(i).replace("▁", " ").encode())
    return sorted(pieces - {b""})


_BASE = 0x9E3779B97F4A7C15 | 1


def _piece_hashes(pieces: list[bytes]) -> np.ndarray:
    out = []
    for p in pieces:
        h = 0
        for k, b in enumerate(p):
            h = (h + (b + 1) * pow(_BASE, k, 2**64)) % 2**64
        out.append(h)
    return np.array(out, U)


class Lattice:
    """Finds the vocabulary's pieces in many words at once."""

    def __init__(self, pieces: list[bytes]):
        hashes = _piece_hashes(pieces)
        lengths = np.array([len(p) for p in pieces])
        self.by_length = {}
        for n in sorted(set(lengths.tolist())):
            ids = np.flatnonzero(lengths == n)
            order = np.argsort(hashes[ids])
            mask = np.zeros(1 << 16, bool)
            mask[(mix(hashes[ids]) >> U(48)).astype(np.int64)] = True
            self.by_length[n] = (hashes[ids][order], ids[order], mask)
        self.longest = max(self.by_length)
        powers = lambda base: np.cumprod(np.concatenate((np.ones(1, U), np.full(REACH + self.longest + 1, base, U))))
        self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 2**64))

    def arcs(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length (a row of bytes each): (end, piece length, rows, piece ids), by rising end."""
        sums = np.zeros((len(words), words.shape[1] + 1), U)
        np.cumsum((words.astype(U) + U(1)) * self.up[: words.shape[1]], axis=1, out=sums[:, 1:])
        for end in range(1, words.shape[1] + 1):
            for n, (hashes, ids, mask) in self.by_length.items():
                if n > end:
                    break
                key = (sums[:, end] - sums[:, end - n]) * self.down[end - n]
                rows = np.flatnonzero(mask[(mix(key) >> U(48)).astype(np.int64)])
                at = np.minimum(np.searchsorted(hashes, key[rows]), len(hashes) - 1)
                found = hashes[at] == key[rows]
                yield end, n, rows[found], ids[at[found]]


    def arcs_of(self, text: np.ndarray, after: int) -> tuple[list[int], list[int], list[int]]:
        """For one stretch of bytes: ends beyond ``after``, piece lengths and piece ids, by rising end."""
        sums = np.concatenate((np.zeros(1, U), np.cumsum((text.astype(U) + U(1)) * self.up[: len(text)])))
        parts = []
        for n, (hashes, ids, mask) in self.by_length.items():
            end = np.arange(max(n, after + 1), len(text) + 1)
            key = (sums[end] - sums[end - n]) * self.down[end - n]
            near = np.flatnonzero(mask[(mix(key) >> U(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(hashes, key[near]), len(hashes) - 1)
            found = hashes[at] == key[near]
            parts.append(np.stack((end[near[found]], np.full(found.sum(), n), ids[at[found]])))
        every = np.concatenate(parts, axis=1)
        return tuple(every[:, np.argsort(every[0], kind="stable")].tolist())


def _forward(words: np.ndarray, arcs: list, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward sums [position, word, language] and the logarithms of the scales [position, word]."""
    alpha = np.zeros((words.shape[1] + 1, len(words), chance.shape[1]))
    scale = np.zeros((words.shape[1] + 1, len(words)))
    alpha[0] = 1
    at = 0
    for end in range(1, words.shape[1] + 1):
        base = scale[end - 1]
        while at < len(arcs) and arcs[at][0] == end:
            _, n, rows, ids = arcs[at]
            at += 1
            if len(rows):
                alpha[end, rows] += alpha[end - n, rows] * chance[ids] * np.exp(scale[end - n, rows] - base[rows])[:, None]
        most = alpha[end].max(axis=1)
        most[most == 0] = 1
        alpha[end] /= most[:, None]
        scale[end] = base + np.log(most)
    return alpha, scale


def _backward(words: np.ndarray, arcs: list, chance: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Backward sums, scaled so that alpha * beta at each position is the whole over exp(scale at the end)."""
    beta = np.zeros((words.shape[1] + 1, len(words), chance.shape[1]))
    beta[-1] = 1
    for end, n, rows, ids in reversed(arcs):
        if len(rows):
            beta[end - n, rows] += beta[end, rows] * chance[ids] * np.exp(scale[end - n, rows] - scale[end, rows])[:, None]
    return beta


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, byte matrix with the leading blank) for words of each length, some thousand at a time."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == n)
        for k in range(0, len(where), 4096):
            part = where[k : k + 4096]
            body = np.frombuffer(b"".join(words[i] for i in part.tolist()), np.uint8).reshape(len(part), n)
            yield part, np.concatenate((np.full((len(part), 1), 32, np.uint8), body), axis=1)


@dataclass
class Model:
    languages: list[str]
    pieces: list[bytes]
    chance: np.ndarray  # [piece, language]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """log P(word | language) with a memory of distinct words."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, U)
        self.values = np.zeros((0, len(self.model.languages)), np.float32)

    def long_word(self, word: bytes) -> np.ndarray:
        """As words() for one word of any length. Each language has a scale of its own, as sums over long runs are far apart."""
        text = np.frombuffer(b" " + word, np.uint8)
        chance, back = self.model.chance, self.lattice.longest
        ones = np.ones(len(self.model.languages))
        last = [(ones, 0 * ones)]  # of the positions up to the present one: sums, and the logarithms of their scales
        for at in range(0, len(text), REACH):
            begin = max(0, at - back)
            ends, lengths, ids = self.lattice.arcs_of(text[begin : at + REACH], at - begin)
            k = 0
            for end in range(at - begin + 1, min(REACH, len(text) - at) + at - begin + 1):
                scale = last[-1][1]
                total = 0 * ones
                while k < len(ends) and ends[k] == end:
                    before, its = last[-lengths[k]]
                    total = total + before * chance[ids[k]] * np.exp(its - scale)
                    k += 1
                last.append((ones, scale + np.log(total)))
                if len(last) > 2 * back:
                    del last[:-back]
        return last[-1][1]

    def words(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.model.languages)), np.float32)
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
        for i in sorted({*range(len(words))} - {*short}):
            out[i] = self.long_word(words[i])
        for part, matrix in _by_length([words[i] for i in short]):
            where = np.array(short)[part]
            arcs = list(self.lattice.arcs(matrix))
            alpha, scale = _forward(matrix, arcs, self.model.chance)
            out[where] = np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1][:, None]
        return out

    def texts(self, column: pa.Array) -> np.ndarray:
        """log P(text | language) of each text of an Arrow column of lower-cased texts."""
        parts = [np.zeros((0, len(self.model.languages)))]
        for _, _, data, offsets in text_slices(column):
            starts, ends, hashes = word_spans(data, offsets, LETTERS)
            distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.known) + len(distinct) > REMEMBERED:
                self._forget()
            at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
            new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
            if new.any():
                fresh = [data[a:b].tobytes() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
                place = np.searchsorted(self.known, distinct[new])
                self.values = np.insert(self.values, place, self.words(fresh), axis=0)
                self.known = np.insert(self.known, place, distinct[new])
                at = np.searchsorted(self.known, distinct)
            each = self.values[at][back].astype(np.float64) if len(distinct) else np.zeros((0, len(self.model.languages)))
            total = np.concatenate((np.zeros((1, each.shape[1])), np.cumsum(each, axis=0)))
            at = np.searchsorted(starts, offsets)
            parts.append(total[at[1:]] - total[at[:-1]])
        return np.concatenate(parts)


def split_long(starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts words of more than LONGEST bytes into pieces of at most that length, to learn from."""
    long = np.flatnonzero(ends - starts > LONGEST)
    if not len(long):
        return starts, ends, hashes
    cut_starts, cut_ends, cut_hashes = [], [], []
    for i in long.tolist():
        for a in range(int(starts[i]), int(ends[i]), LONGEST):
            b = min(a + LONGEST, int(ends[i]))
            cut_starts.append(a)
            cut_ends.append(b)
            h = 0
            for x in data[a:b].tolist():
                h = (h * 1_000_003 + x + 1) % 2**64
            cut_hashes.append(h)
    keep = np.ones(len(starts), bool)
    keep[long] = False
    starts = np.concatenate((starts[keep], np.array(cut_starts, starts.dtype)))
    ends = np.concatenate((ends[keep], np.array(cut_ends, ends.dtype)))
    hashes = np.concatenate((hashes[keep], mix(np.array(cut_hashes, U), 9)))
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], hashes[order]


def fit(counts: dict[str, dict[bytes, int]], pieces: list[bytes], rounds: int = 4, smoothing: float = 200.0) -> Model:
    """Expectation maximisation over the words' counts in each language; pieces' pooled chances smooth each language's."""
    languages = sorted(counts)
    words = sorted({w for c in counts.values() for w in c})
    weight = np.array([[counts[x].get(w, 0) for x in languages] for w in words], float)
    weight /= np.maximum(weight.sum(axis=0), 1) / 1e5  # each language's sample counts alike
    lattice = Lattice(pieces)
    chance = np.full((len(pieces), len(languages)), 1 / len(pieces))
    batches = [(where, matrix, list(lattice.arcs(matrix))) for where, matrix in _by_length(words)]
    for _ in range(rounds):
        expected = np.zeros_like(chance)
        for where, matrix, arcs in batches:
            alpha, scale = _forward(matrix, arcs, chance)
            beta = _backward(matrix, arcs, chance, scale)
            share = weight[where] / np.maximum(alpha[-1], 1e-300)
            for end, n, rows, ids in arcs:
                if len(rows):
                    shift = np.exp(scale[end - n, rows] - scale[end, rows])[:, None]
                    add = alpha[end - n, rows] * chance[ids] * beta[end, rows] * shift * share[rows]
                    for k in range(len(languages)):
                        expected[:, k] += np.bincount(ids, add[:, k], len(pieces))
        pooled = expected.sum(axis=1) + 0.1
        pooled /= pooled.sum()
        chance = (expected + smoothing * pooled[:, None]) / (expected.sum(axis=0) + smoothing)
    return Model(languages, pieces, chance)


def held_out(key: F.Column) -> F.Column:
    """Documents that no model may learn from: those whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(0).to_pylist()
        out: dict[tuple[str, bytes], int] = {}
        for first, _, data, offsets in text_slices(batch.column(1)):
            starts, ends, _ = split_long(*word_spans(data, offsets, LETTERS), data)
            rows = np.searchsorted(offsets, starts, "right") - 1 + first
            for a, b, r in zip(starts.tolist(), ends.tolist(), rows.tolist(), strict=True):
                k = (labels[r], data[a:b].tobytes())
                out[k] = out.get(k, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.binary()), pa.array(list(out.values()), pa.int64())], ["label", "word", "n"])


def train(docs: DataFrame, vocabulary_file: str, *, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = TRAINING_TEXTS) -> Model | None:
    """A model from about per_language texts of each language (chosen by a hash of the id) among those not held out.

    The words of this bounded sample are counted by Spark; their counts are fitted on the driver. None without labelled texts. The
    model has a column for each language, so labels are meant to be language names, not free text.
    """
    labelled = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key)))
    sizes = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("langid")), F.lit(1_000_000))
    quota = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(1_000_000 * per_language // n))])
    sample = labelled.filter(draw <= quota[F.col(label)]).select(F.col(label).alias("label"), F.lower(text).alias("text"))
    counted = sample.mapInArrow(_count_words, "label string, word binary, n long").groupBy("label", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[bytes, int]] = {}
    for r in counted.toLocalIterator():
        counts.setdefault(r[0], {})[bytes(r[1])] = r[2]
    return fit(counts, vocabulary(vocabulary_file)) if counts else None


def classify(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score; the two names replace columns of the same name.

    Texts that are null or have no letter are "und" with score 0, as are all texts without a model. Every row is judged by
    its whole text alone, so copies agree. An empty table gives an empty table.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("lang_score"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # pieces times languages

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.scorer()
        for batch in batches:
            fit = known.texts(batch.column(batch.num_columns - 2))
            best = fit.argmax(axis=1)
            score = 1 / np.exp(fit - fit.max(axis=1, keepdims=True)).sum(axis=1)
            has = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            names = [known.model.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0))], [*keep, "lang_pred", "lang_score"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.select(*keep, F.lower(F.col(text)).alias("_lower"), letters.alias("_letters")).mapInArrow(judge, schema)
