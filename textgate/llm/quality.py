"""Quality classification by ordinal regression on graded ratings.

A text's score is a sum of weights shared by hashed features: its words (divided by the root of their number), its byte
trigrams (their mean) and how many words repeat the one before. Cumulative links tie the score to grades: P(grade > k) =
sigmoid(score - threshold_k) with ordered thresholds, so one weight vector serves all grades. The expected grade and the
tail probability P(grade >= wanted) follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, text_buffer, words

WORD_BITS, GRAM_BITS = 18, 15
N_WEIGHTS = (1 << WORD_BITS) + (1 << GRAM_BITS) + 1
#: Rated documents that training takes at most (the first by a hash of the id), and what it reads of each: so many passages of so
#: many characters, spread evenly from the first to the last (shorter texts whole). 60 MB of characters at most.
TRAIN_DOCS, PASSAGES, PASSAGE_CHARS = 5000, 6, 2000
#: Texts whose features are listed at a time in training.
TRAIN_BLOCK = 64
GRAM_SCALE, REPEAT_SCALE = 8.0, 4.0
#: A feature counts in training if so many texts have it.
LEAST_TEXTS = 8
WORD_POWER = 0.25


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight index, value, index of each text's first feature and of the last's end)."""
    starts, hashes, bounds = words(raw, offsets)
    n_words = np.diff(bounds)
    word_of = np.repeat(np.arange(len(n_words)), n_words)
    root = np.maximum(n_words, 1) ** -WORD_POWER
    size = np.diff(offsets)
    code = raw.astype(np.uint64)
    gram = code[:-2] << np.uint64(16) | code[1:-1] << np.uint64(8) | code[2:] if len(raw) > 2 else np.zeros(0, np.uint64)
    gram_at = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)
    text_of = np.repeat(np.arange(len(size)), size)
    inside = text_of[:-2] == text_of[2:] if len(raw) > 2 else np.zeros(0, bool)
    gram_of = text_of[:-2][inside] if len(raw) > 2 else np.zeros(0, np.int64)
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (word_of[1:] == word_of[:-1])) if len(hashes) > 1 else np.zeros(0, np.int64)
    repeat_of = word_of[same]
    owner = np.concatenate([word_of, gram_of, repeat_of])
    at = np.concatenate([(hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), (1 << WORD_BITS) + gram_at[inside].astype(np.int64), np.full(len(same), N_WEIGHTS - 1)])
    value = np.concatenate([root[word_of], GRAM_SCALE / np.maximum(size[gram_of], 1), REPEAT_SCALE / np.maximum(n_words[repeat_of], 1)]).astype(np.float32)
    order = np.argsort(owner, kind="stable")
    return at[order], value[order], np.searchsorted(owner[order], np.arange(len(size) + 1))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each part; each depends on its own values only."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full])
    return out


@dataclass
class OrdinalModel:
    """Grades 0 .. len(thresholds); thresholds ascend."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The same sums as over features(), one block at a time and without listing them."""
        starts, hashes, bounds = words(raw, offsets)
        n_words, size = np.diff(bounds), np.diff(offsets)
        own = self.weights[(hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)].astype(np.float64)
        out = sums(own, bounds) * np.maximum(n_words, 1) ** -WORD_POWER
        if len(raw) > 2:
            code = raw.astype(np.uint64)
            gram = (code[:-2] << np.uint64(16) | code[1:-1] << np.uint64(8) | code[2:]) * np.uint64(0x9E3779B97F4A7C15)
            w = np.append(self.weights[(1 << WORD_BITS) + (gram >> np.uint64(64 - GRAM_BITS)).astype(np.int64)], [0, 0]).astype(np.float64)
            for back in (1, 2):  # none across two texts
                at = offsets[1:] - back
                w[at[at >= 0]] = 0
            out += sums(w, offsets) * GRAM_SCALE / np.maximum(size, 1)
        if len(hashes) > 1:
            same = np.append([False], hashes[1:] == hashes[:-1])
            same[bounds[:-1][bounds[:-1] < len(same)]] = False
            out += sums(same.astype(np.float64), bounds) * REPEAT_SCALE / np.maximum(n_words, 1) * float(self.weights[-1])
        return out

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k: (n, len(thresholds))."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -60, 60)))


def sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() with one entry for each weight of a text, listed block by block: memory is that of the entries (8 bytes each)
    and of one block's text."""
    at, value, size = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [np.zeros(1, np.int64)]
    for i in range(0, len(texts), TRAIN_BLOCK):
        a, v, bounds = features(*text_buffer(pa.array(texts[i : i + TRAIN_BLOCK], pa.string())))
        own, back = np.unique(a + N_WEIGHTS * np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), return_inverse=True)
        at.append((own % N_WEIGHTS).astype(np.int32))
        value.append(np.bincount(back, v, len(own)).astype(np.float32))
        size.append(np.bincount(own // N_WEIGHTS, minlength=len(bounds) - 1))
    return np.concatenate(at), np.concatenate(value), np.cumsum(np.concatenate(size))


def gradient(s: np.ndarray, y: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean of -log P(grade = y) by the scores s and by the thresholds."""
    edge = np.concatenate([[-np.inf], thresholds, [np.inf]])
    hi, lo = edge[y + 1] - s, edge[y] - s
    cdf = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    fh, fl = np.where(np.isinf(hi), 1.0, cdf(hi)), np.where(np.isinf(lo), 0.0, cdf(lo))
    p = np.maximum(fh - fl, 1e-9)
    dh, dl = fh * (1 - fh) / p, fl * (1 - fl) / p  # of log p by the upper and, negated, the lower edge
    g_edge = np.zeros(len(edge))
    np.add.at(g_edge, y + 1, -dh / len(y))
    np.add.at(g_edge, y, dl / len(y))
    return (dh - dl) / len(y), g_edge[1:-1]


def train(texts: list[str], grades: list[int], epochs: int = 12, rate: float = 0.15, batch: int = 64, decay: float = 1e-6, seed: int = 11) -> OrdinalModel:
    """Maximum likelihood by Adagrad. Thresholds are the first plus sums of exponentials, so they stay ordered."""
    top = max([*grades, 1])
    at, value, bounds = sparse(texts)
    y = np.array(grades, np.int64)
    value[np.bincount(at, minlength=N_WEIGHTS)[at] < LEAST_TEXTS] = 0  # what few texts have would be learnt by heart
    w, squares = np.zeros(N_WEIGHTS), np.full(N_WEIGHTS, 1e-3)
    first, gaps, t_squares = -1.0, np.zeros(top - 1), np.full(top, 1e-3)
    rng = np.random.default_rng(seed)
    ordered = lambda: first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    for _ in range(epochs if texts else 0):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            ranges = [np.arange(bounds[i], bounds[i + 1]) for i in some]
            sel, size = np.concatenate(ranges), np.array([len(r) for r in ranges])
            a, v = at[sel], value[sel]
            s = sums(w[a] * v, np.append(0, np.cumsum(size)))
            g_s, g_t = gradient(s, y[some], ordered())
            tail = np.cumsum(g_t[::-1])[::-1]
            g_par = np.concatenate([[tail[0]], tail[1:] * np.exp(gaps)])
            u, back = np.unique(a, return_inverse=True)
            g = np.bincount(back, np.repeat(g_s, size) * v, len(u)) + decay * w[u]
            squares[u] += g * g
            w[u] -= rate * g / np.sqrt(squares[u])
            t_squares += g_par**2
            move = rate * g_par / np.sqrt(t_squares)
            first -= move[0]
            gaps -= move[1:]
    return OrdinalModel(w.astype(np.float32), ordered())


def grade(quality: str = "quality", toxic: str = "toxic") -> F.Column:
    """Graded rating: 0 toxic, 1 poor, 2 good; null where quality is null and the text isn't toxic."""
    return F.when(F.col(toxic) == 1, F.lit(0)).otherwise(F.lit(1) + (F.col(quality) > 0).cast("int"))


def passages(text: str = "text") -> F.Column:
    """What training reads of a text: its PASSAGES passages of PASSAGE_CHARS characters with a blank line between, or the
    whole text if it isn't longer than they are."""
    n = F.length(text)
    step = lambda i: (1 + F.floor((n - PASSAGE_CHARS) * i / (PASSAGES - 1))).cast("int")
    cut = F.concat_ws("\n\n", *[F.substring(F.col(text), step(i), F.lit(PASSAGE_CHARS)) for i in range(PASSAGES)])
    return F.when(n <= PASSAGES * PASSAGE_CHARS, F.col(text)).otherwise(cut)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> OrdinalModel:
    """Train on at most train_docs rated documents, by a hash of doc_id: a bounded list of bounded texts, whatever the table's size.
    A document rated repeatedly counts with its lowest grade; of rows with one id the first text counts. Long texts count by their
    passages(); null texts and null ids are left out. Without any rating all scores are 0."""
    rated = labels.select("doc_id", grade().alias("grade")).where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    some = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    read = docs.select("doc_id", passages().alias("text")).where("text is not null").join(F.broadcast(some), "doc_id")
    rows = read.groupBy("doc_id").agg(F.min(F.struct("text", "grade")).alias("r")).orderBy("doc_id").select("r.*").collect()
    return train([r.text for r in rows], [r.grade for r in rows])


def score(docs: DataFrame, model: OrdinalModel, wanted: int = 2, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_prob = P(grade >= wanted), selected (tail_prob >= least) of each row of docs.

    Null and empty texts are never selected: grade 0.0, probability 0.0. Rows keep their number, repeated ids too; equal texts
    score alike. Texts are scored whole, however long; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_buffer(part.column("text"))
                above = shared.value.exceed(shared.value.scores(raw, offsets))
                above[np.diff(offsets) == 0] = 0.0
                tail = above[:, wanted - 1] if wanted <= above.shape[1] else np.zeros(len(above))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(tail), pa.array(tail >= least)], ["doc_id", "expected_grade", "tail_prob", "selected"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, expected_grade double, tail_prob double, selected boolean")
