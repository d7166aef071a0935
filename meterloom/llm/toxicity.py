"""A text classifier of averaged subword embeddings, trained in numpy and applied by Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text_hash import mixed, small_slices, text_bytes

#: Labelled documents that the model is fitted on at most (each class at most half). The bound of the fit.
MAX_LABELLED = 3000
#: Rows of the embedding table (a power of two), their length, words a window, and lengths of subwords in bytes.
BUCKETS, DIM, WINDOW, SUBWORDS = 1 << 20, 4, 12, (3, 4, 5, 6)
#: Rounds of the fit, steps of the embeddings and of the rest, decay, and the texts of one class that a subword must be in.
EPOCHS, RATES, DECAY, LEAST_TEXTS = 50, (3.0, 0.05, 0.05), 1e-7, 2

_rng = np.random.Generator(np.random.PCG64(10))
_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_FACTORS = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
#: What each byte becomes: letters in lower case, digits and non-ASCII bytes as they are, the rest 0, the mark around words.
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 0 for b in range(256)], np.uint8)


@dataclass
class Bags:
    """Subwords of words, words of windows, windows of texts: where each begins in the one below."""

    buckets: np.ndarray
    words: np.ndarray
    windows: np.ndarray
    texts: np.ndarray


def bags(texts: pa.Array) -> Bags:
    """All subwords of whole texts. A word keeps a mark at either end, so short words are subwords too.

    The words of a text are dealt into even windows of at most ``WINDOW``; a text without words has none.
    """
    raw, bounds = text_bytes(texts)
    n = len(bounds) - 1
    # a mark before each text and after the last
    marked = np.zeros(len(raw) + n + 1, np.uint8)
    marked[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(bounds))] = _PLAIN[raw]
    bounds = bounds + np.arange(n + 1)
    mark = marked == 0
    starts = np.flatnonzero(mark[:-1] & ~mark[1:])  # the mark before each word
    marks = np.cumsum(mark, dtype=np.int64)
    codes = _CODES[marked]
    found, at = [], []
    with np.errstate(over="ignore"):
        for size in SUBWORDS:
            count = len(marked) - size + 1
            if count <= 0:
                continue
            inner = marks[size - 2 : size - 2 + count] - marks[:count]  # marks strictly inside
            where = np.flatnonzero((inner == 0) & ~(mark[:count] & mark[1 : count + 1]))
            total = np.full(len(where), np.uint64(size))
            for i in range(size):
                total += codes[where + i] * _FACTORS[i]
            found.append((mixed(total) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
            at.append(where)
    at, buckets = (np.concatenate(at), np.concatenate(found)) if at else (np.empty(0, np.int64), np.empty(0, np.int32))
    order = np.argsort(at, kind="stable")
    at, buckets = at[order], buckets[order]
    words = np.append(np.searchsorted(at, starts), len(at))
    full = np.diff(words) > 0
    starts = starts[full]
    words = np.append(words[:-1][full], len(at))
    first = np.searchsorted(starts, bounds)
    per_text = np.diff(first)
    k = -(-per_text // WINDOW)
    text_of_window = np.repeat(np.arange(n), k)
    texts_at = np.append(0, np.cumsum(k))
    nth = np.arange(texts_at[-1]) - texts_at[text_of_window]
    windows = np.append(first[text_of_window] + -(-nth * per_text[text_of_window] // np.maximum(k[text_of_window], 1)), len(starts))
    return Bags(buckets, words, windows.astype(np.int64), texts_at)


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bounds[:-1]) / np.diff(bounds) if len(bounds) > 1 else values[:0]


def _pooled(logits: np.ndarray, bounds: np.ndarray, empty: float) -> tuple[np.ndarray, np.ndarray]:
    """Per text the log-mean-exp over its windows, so that their number counts nothing, and each window's share of it."""
    size = np.diff(bounds)
    some = np.flatnonzero(size)
    out = np.full(len(size), empty)
    if not len(some):
        return out, logits
    starts = bounds[:-1][some]
    top = np.maximum.reduceat(logits, starts)
    spread = np.exp(logits - np.repeat(top, size[some]))
    sums = np.add.reduceat(spread, starts)
    out[some] = top + np.log(sums / size[some])
    return out, spread / np.repeat(sums, size[some])


@dataclass
class ToxicityModel:
    """What scoring needs of a fit: each bucket's embedding through the difference of the classes' weights, and the biases' difference."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        b = bags(texts)
        logits = _means(_means(self.weights[b.buckets].astype(np.float64), b.words), b.windows) + self.bias
        pooled, _ = _pooled(logits, b.texts, self.bias)
        return 1 / (1 + np.exp(-np.clip(pooled, -500, 500)))


def fit(texts: pa.Array, toxic: np.ndarray) -> ToxicityModel:
    """Embeddings and softmax weights together, by Adam on all texts at once.

    A word is the mean of its subwords' embeddings, a window the mean of its words; a text is as toxic as its
    windows on average of their odds (log-mean-exp of their logits): a few windows outweigh many mild ones, and
    clean windows, however many, never raise a score. Classes weigh the same. Subwords in fewer than
    ``LEAST_TEXTS`` texts of either class are left out. Without both classes every text gets the one there is
    (or, without texts, 0).
    """
    if len(np.unique(toxic)) < 2:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 14.0 if len(toxic) and toxic[0] else -14.0)
    # slice by slice, so that only each text's words and the subwords of different words are held
    words, windows, per_text, sizes, parts, often, done = [], [], [], [], [], np.zeros((2, BUCKETS), np.int32), 0
    known = np.empty(0, np.uint64)
    for part in small_slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 1 << 18):
        b = bags(part.column("text"))
        size, per_window = np.diff(b.words), np.diff(b.windows)
        with np.errstate(over="ignore"):
            nth = np.arange(len(b.buckets)) - np.repeat(b.words[:-1], size)
            names = np.add.reduceat(mixed(b.buckets.astype(np.uint64) + np.uint64(BUCKETS) * nth.astype(np.uint64)), b.words[:-1]) if len(size) else known[:0]
        in_text = np.repeat(np.repeat(np.repeat(np.arange(part.num_rows), np.diff(b.texts)), per_window), size)
        pairs = np.unique(in_text * BUCKETS + b.buckets)
        np.add.at(often, (toxic[done + pairs // BUCKETS].astype(np.int64), pairs % BUCKETS), 1)
        done += part.num_rows
        kinds, at = np.unique(names, return_index=True)
        new = ~np.isin(kinds, known)
        known, at = np.append(known, kinds[new]), at[new]
        own = size[at]
        parts.append(b.buckets[np.repeat(b.words[at] - (np.cumsum(own) - own), own) + np.arange(own.sum())])
        sizes.append(own)
        words, windows, per_text = [*words, names], [*windows, per_window], [*per_text, np.diff(b.texts)]
    words, windows, per_text = np.concatenate(words), np.concatenate(windows), np.concatenate(per_text)
    order = np.argsort(known)
    kind = order[np.searchsorted(known, words, sorter=order)].astype(np.int32)
    size = np.concatenate(sizes)
    del words, known, order
    # what is in a single text of a class would only be learned by heart; it counts in the means but stays zero
    usual = np.flatnonzero((often >= LEAST_TEXTS).any(0))
    row = np.full(BUCKETS, -1, np.int32)
    row[usual] = np.arange(len(usual))
    bucket = row[np.concatenate(parts)]
    del parts, often, row
    of_bucket = np.repeat(np.arange(len(size), dtype=np.int32), size)[bucket >= 0]
    bucket = bucket[bucket >= 0]
    window = np.repeat(np.arange(len(windows), dtype=np.int32), windows)
    text = np.repeat(np.arange(len(toxic)), per_text)
    texts_at = np.append(0, np.cumsum(per_text))
    per_window = 1 / windows
    share = np.where(toxic == 1, 0.5 / (toxic == 1).sum(), 0.5 / (toxic == 0).sum())

    rng = np.random.Generator(np.random.PCG64(3))
    table = rng.normal(0, 0.01, (DIM, len(usual)))
    soft = rng.normal(0, 0.5, (2, DIM))
    bias = np.zeros(2)
    params = [table, soft, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, EPOCHS + 1):
        hidden = np.stack([np.bincount(window, (np.bincount(of_bucket, x[bucket], len(size)) / size)[kind], len(windows)) for x in table]) * per_window
        logits = soft @ hidden + bias[:, None]
        pooled, part = _pooled(logits[1] - logits[0], texts_at, float(bias[1] - bias[0]))
        wrong = (1 / (1 + np.exp(-np.clip(pooled, -500, 500))) - toxic) * share
        at_window = wrong[text] * part
        both = np.stack([-at_window, at_window])
        # the same for every component up to its weights
        back = (np.bincount(kind, (at_window * per_window)[window], len(size)) / size)[of_bucket]
        grad = np.bincount(bucket, back, len(usual))
        grads = ((soft[1] - soft[0])[:, None] * grad + DECAY * table, both @ hidden.T, both.sum(1))
        for p, g, m, v, rate in zip(params, grads, first, second, RATES):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(BUCKETS, np.float32)
    weights[usual] = (soft[1] - soft[0]) @ table
    return ToxicityModel(weights, float(bias[1] - bias[0]))


def train_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """A model from labelled rows (``doc_id, toxic``) whose crc32 of the doc_id as text is no multiple of 5.

    Only at most ``max_labelled`` documents, the first in the order of a hash and at most half of each class,
    are brought to the driver. Null labels and labels without a
    document are passed over; of several labels of one document the highest counts.
    """
    c = F.col
    usable = (
        labels.select(c("doc_id").cast("bigint").alias("doc_id"), c("toxic").cast("int").alias("toxic"))
        .where(c("toxic").isin(0, 1) & (F.crc32(c("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        # before the limits, else labels without a document would use them up
        .join(docs.select(c("doc_id").cast("bigint").alias("doc_id")), "doc_id", "left_semi")
    )
    chosen = [usable.where(c("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled // 2) for k in (0, 1)]
    # a row for each chosen document at most: bounded, so it may be broadcast
    sample = docs.select(c("doc_id").cast("bigint").alias("doc_id"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text"))
    sample = sample.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    once = Window.partitionBy("doc_id").orderBy("text")
    found = sample.withColumn("nth", F.row_number().over(once)).where("nth = 1").orderBy("doc_id").select("text", "toxic").toArrow()
    return fit(found.column("text").combine_chunks(), found.column("toxic").to_numpy().astype(np.float64))


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a ``score`` from 0 to 1 of each whole text; nothing else is an input. The work is narrow.

    Null, empty and wordless texts score what the model's bias alone gives. Repeated rows and null keys make no
    difference. Other columns pass through; one that is called like the score is an error.
    """
    if score in docs.columns:
        raise ValueError(f"column {score} is there already")

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        found = [model.scores(part.column("text")) for part in small_slices(batch, "text", 1 << 18)]
        return pa.array(np.concatenate(found) if found else np.empty(0))

    return docs.withColumn(score, scored(F.col(text).cast("string")))
