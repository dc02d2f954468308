"""Language identification by a byte convolutional network.

Text is cut into fixed windows of WINDOW bytes (the last is padded with zeros). Filters of widths 2, 3 and 4 slide over
the bytes of a window; each filter's largest response (ReLU) is kept and a softmax layer turns these into language
probabilities. A document's probabilities are the means over its windows, weighted by their text bytes. The network is
trained in numpy on labelled text. A filter of width w is a sum of w table look-ups, and pairs of adjacent look-ups are
merged into one table over byte pairs, so applying it never builds one-hot vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import arrow_map, give_back, slices, text_buffer

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled documents of each language that training takes at most, and passages of each document.
TRAIN_DOCS, PASSAGES = 1500, 3
#: Windows that go through the network together.
TOGETHER = 256
#: In a filtering stage, documents below this probability are rejected (besides those without a letter).
ACCEPT = 0.5
UNDETERMINED = "und"


@dataclass
class ByteConvNet:
    """langs: the labels in order; tables[w]: (w, 256, FILTERS); weights: (len(WIDTHS) * FILTERS, langs)."""

    langs: list[str]
    tables: list[np.ndarray]
    shift: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def __post_init__(self) -> None:
        pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(65536, -1))
        self.parts = []
        for w, t in zip(WIDTHS, self.tables, strict=True):
            own = [(j, pair(t[j], t[j + 1])) for j in range(0, w - 1, 2)]
            if w % 2:
                own.append((w - 1, t[w - 1]))
            self.parts.append(own)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of windows (n, WINDOW) of bytes: (n, langs)."""
        out = np.zeros((len(windows), len(self.langs)), np.float32)
        for i in range(0, len(windows) if self.langs else 0, TOGETHER):
            some = windows[i : i + TOGETHER].astype(np.uint16)
            pairs = some[:, :-1] << 8 | some[:, 1:]
            pooled = []
            for w, own in zip(WIDTHS, self.parts, strict=True):
                places = WINDOW - w + 1
                total = None
                for j, table in own:
                    at = (pairs if len(table) == 65536 else some)[:, j : j + places]
                    got = table.take(at, axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                pooled.append(total.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.shift, 0)
            logits = hidden @ self.weights + self.bias
            logits -= logits.max(axis=1, keepdims=True)
            e = np.exp(logits)
            out[i : i + TOGETHER] = e / e.sum(axis=1, keepdims=True)
        return out

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text (0 for an empty one)."""
        size = np.diff(offsets)
        per = -(-size // WINDOW)
        first = np.cumsum(per) - per
        flat = np.zeros(int(per.sum()) * WINDOW, np.uint8)
        flat[np.repeat(first * WINDOW - offsets[:-1], size) + np.arange(offsets[-1])] = raw
        windows = flat.reshape(-1, WINDOW)
        weight = np.count_nonzero(windows, axis=1).astype(np.float32)
        got = self.probabilities(windows) * weight[:, None]
        out = np.zeros((len(size), len(self.langs)))
        np.add.at(out, np.repeat(np.arange(len(size)), per), got)
        total = out.sum(axis=1, keepdims=True)
        return np.divide(out, total, out=out, where=total > 0)


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.01, batch: int = 64, seed: int = 7) -> ByteConvNet:
    """Fit by Adam on the softmax loss; max pooling passes gradient to each filter's best position only."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels], np.int64)
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for row, t in zip(x, texts, strict=True):
        b = t.encode()[:WINDOW]
        row[: len(b)] = np.frombuffer(b, np.uint8)
    rng = np.random.default_rng(seed)
    n_hidden = FILTERS * len(WIDTHS)
    par = [rng.normal(0, 0.15, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    par += [np.zeros(n_hidden, np.float32), rng.normal(0, 0.2, (n_hidden, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    m, v, step = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    for _ in range(epochs if len(x) else 0):
        for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            xb, yb, k = x[some], y[some], len(some)
            pooled, best = [], []
            for w, t in zip(WIDTHS, par, strict=False):
                places = WINDOW - w + 1
                r = sum(t[j].take(xb[:, j : j + places], axis=0) for j in range(w))
                at = r.argmax(axis=1)
                best.append(at)
                pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
            pre = np.concatenate(pooled, axis=1) + par[-3]
            hidden = np.maximum(pre, 0)
            logits = hidden @ par[-2] + par[-1]
            logits -= logits.max(axis=1, keepdims=True)
            e = np.exp(logits)
            d = e / e.sum(axis=1, keepdims=True)
            d[np.arange(k), yb] -= 1
            d /= k
            back = (d @ par[-2].T) * (pre > 0)
            grads = []
            for i, (w, at) in enumerate(zip(WIDTHS, best, strict=True)):
                g = np.zeros((w, 256, FILTERS), np.float32)
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                f = np.broadcast_to(np.arange(FILTERS), at.shape)
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(xb, at + j, 1), f), own)
                grads.append(g)
            grads += [back.sum(0), hidden.T @ d, d.sum(0)]
            step += 1
            for p, g, a, b in zip(par, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return ByteConvNet(langs, par[: len(WIDTHS)], par[-3], par[-2], par[-1])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that training never sees: CRC-32 of the id's text has remainder 2 by 4. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, passages: int = PASSAGES) -> ByteConvNet:
    """Train on at most train_docs documents of each language (the first by a hash of their id; of a repeated id one row) and
    on passages of WINDOW characters spread over each, however long the text. Held-out and unlabelled documents and empty texts are left out. Without any
    labelled document the network knows no language and all texts are undetermined."""
    pool = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("_hash")).where(F.col("lang").isNotNull() & ~held_out()).withColumn("_part", F.shiftright("_hash", 52))
    counts = pool.groupBy("lang", "_part").agg(F.count("*").alias("_n"))  # 4096 parts of the hash's range at most
    before = F.sum("_n").over(Window.partitionBy("lang").orderBy("_part")) - F.col("_n")
    last = counts.withColumn("_before", before).where(F.col("_before") < train_docs).groupBy("lang").agg(F.max("_part").alias("_last"))
    few = pool.join(F.broadcast(last), "lang").where("_part <= _last")  # a row of each language, as the network has outputs
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "doc_id"))
    chosen = few.withColumn("_rank", rank).where(F.col("_rank") <= train_docs).select("doc_id").distinct()
    n = F.greatest(F.length("text"), F.lit(1))
    cut = [F.substring("text", (1 + F.floor(n * i / passages)).cast("int"), F.lit(WINDOW)) for i in range(passages)]
    kept = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id", "left_semi")  # a bounded list
    # One row of each id, so that repeated ids don't add to what is collected.
    rows = kept.where(F.col("lang").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("lang", F.array_distinct(F.array(*cut)).alias("cut"))).alias("r")).orderBy("doc_id").select("r.*").collect()
    pairs = [(t, r.lang) for r in rows for t in (r.cut or []) if t and any(c.isalpha() for c in t)]
    net = train([t for t, _ in pairs], [lang for _, lang in pairs])
    del rows, pairs
    give_back()  # the driver's memory is that of its Python too, to the end of the pipeline
    return net


def identify(docs: DataFrame, net: ByteConvNet, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and the columns named in keep), lang_pred and score of each row of docs.

    Reads the whole text, however long, and nothing else; columns not in keep are ignored, whatever their names. Null text, text without a letter, or a network without languages gives
    ('und', 0.0). Rows keep their number and partitioning; equal texts get equal results.
    """
    keep = keep if keep is not None else ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(net)
    langs = np.array([*net.langs, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_buffer(part.column("text"))
                p = shared.value.predict(raw, offsets)
                has = np.array(part.column("_letters").to_pylist(), bool) & (p.shape[1] > 0)
                best = np.where(has, p.argmax(axis=1) if p.shape[1] else 0, len(langs) - 1)
                score = np.where(has, np.minimum(p.max(axis=1, initial=0), 1.0), 0.0)
                out = part.select(keep)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(langs[best].tolist(), pa.string()), pa.array(score)], [*out.schema.names, "lang_pred", "score"])

    wide = docs.select(*dict.fromkeys([*keep, "text"]), F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}").alias("_letters"))
    schema = StructType([wide.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double")
    return arrow_map(wide, run, schema)


def accepted(docs: DataFrame, least: float = ACCEPT) -> DataFrame:
    """The rows of docs whose text has a language with probability `least` at least; all columns as they were, whatever their
    names. Null texts and texts without a letter go; an empty table stays empty."""
    got = identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), fit(docs), ["row"])
    return got.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")
