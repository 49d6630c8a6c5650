"""9. Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is an embedding of its hash next to character features: filters over seven
adjacent bytes, the largest response over the whole word. Both directions of a GRU read the windows of
WINDOW words that begin every STRIDE words; attention pools their states, and a text scores as its
highest window, so that a passage counts alike in texts of any length. Labels are for texts, so training, in numpy, takes one of each text's currently highest
windows, and others of texts that aren't toxic. Scoring covers all windows of all texts; a word's projected input
is computed once for each step or kept from earlier ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, map_batches, plain, release, span_hashes, spans, steps, text_bytes, unused

WINDOW, STRIDE = 64, 32
#: Training takes a text's window from this share of its windows, the currently highest ones.
TOP = 0.2
HASHED, WORD_DIM, CHAR_DIM, HIDDEN = 1 << 13, 16, 32, 16
REACH = 3
#: The classifier is fitted on at most so many labelled texts, those with the least hashes of doc_id, of any length, and of those on the first that have so many characters together.
TRAIN_TEXTS, TRAIN_CHARS = 3000, 64 << 20
EPOCHS, BATCH, RATE, SEED = 14, 64, 0.008, 11
#: Share of words whose embedding is hidden in a training step, so that characters tell too.
HIDDEN_WORDS = 0.5
#: Words whose projections a worker keeps.
KEPT_WORDS = 100_000

Weights = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def new_weights(seed: int = SEED) -> Weights:
    rng = np.random.default_rng(seed)
    width = WORD_DIM + CHAR_DIM
    make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "word": make(HASHED, WORD_DIM, scale=0.05),
        "char": make(2 * REACH + 1, 257, CHAR_DIM, scale=0.3),
        "w": make(2, width, 3 * HIDDEN, scale=width**-0.5),
        "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
        "u": make(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "a": make(2 * HIDDEN, HIDDEN, scale=0.2),
        "v": make(HIDDEN, scale=0.2),
        "o": make(2 * HIDDEN, scale=0.2),
        "c": np.zeros(1, np.float32),
    }


class Words:
    """The words of a step's texts: the distinct ones, each text's sequence of them, and its windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.doc = spans(ALNUM[data], offsets)
        hashes = span_hashes(data, starts, ends, fold=True)
        self.hashes, first, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.ends = starts[first], ends[first]
        self.data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int16)
        texts = len(offsets) - 1
        self.sizes = np.bincount(self.doc, minlength=texts)
        self.begin = np.cumsum(self.sizes) - self.sizes
        count = np.where(self.sizes > 0, 1 + np.maximum(0, -(-(self.sizes - WINDOW) // STRIDE)), 0)
        self.window_doc = np.repeat(np.arange(texts), count)
        k = np.arange(len(self.window_doc)) - np.repeat(np.cumsum(count) - count, count)
        self.window_start = self.begin[self.window_doc] + k * STRIDE
        self.window_size = np.minimum(WINDOW, self.sizes[self.window_doc] - k * STRIDE)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (windows x WINDOW) and which places hold a word."""
        place = np.arange(WINDOW)
        there = place < self.window_size[which][:, None]
        return self.number[np.minimum(self.window_start[which][:, None] + place, len(self.number) - 1)], there


def char_features(words: Words, which: np.ndarray, char: np.ndarray, argmax: bool = False):
    """For each word the largest response of each filter over its bytes (after tanh); argmax: also the byte, and the context of all bytes."""
    starts, sizes = words.starts[which], words.ends[which] - words.starts[which]
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(which)), sizes)
    inside = np.arange(len(of)) - first[of]
    at = starts[of] + inside
    response = np.zeros((len(of), char.shape[2]), np.float32)
    contexts = []
    for k in range(-REACH, REACH + 1):
        there = (inside + k >= 0) & (inside + k < sizes[of])
        context = np.where(there, words.data[np.clip(at + k, 0, len(words.data) - 1)], 256)
        contexts.append(context)
        response += char[k + REACH][context]
    best = np.maximum.reduceat(response, first, axis=0)
    if not argmax:
        return np.tanh(best)
    place = np.where(response == best[of], np.arange(len(of))[:, None], -1)
    return np.tanh(best), np.maximum.reduceat(place, first, axis=0), np.stack(contexts)


def inputs(words: Words, which: np.ndarray, weights: Weights) -> np.ndarray:
    bucket = (words.hashes[which] % np.uint64(HASHED)).astype(np.int64)
    return np.concatenate([weights["word"][bucket], char_features(words, which, weights["char"])], 1)


def project(x: np.ndarray, weights: Weights) -> np.ndarray:
    """Inputs to the three gates, for both directions (2 x words x 3 HIDDEN)."""
    return np.matmul(x, weights["w"]) + weights["b"]


def project_words(words: Words, which: np.ndarray, weights: Weights, size: int = 1 << 13) -> np.ndarray:
    """Projections of many words, in parts that bound the memory of their characters."""
    out = np.empty((2, len(which), 3 * HIDDEN), np.float32)
    for at in range(0, len(which), size):
        out[:, at : at + size] = project(inputs(words, which[at : at + size], weights), weights)
    return out


def run(projected: np.ndarray, number: np.ndarray, there: np.ndarray, weights: Weights, keep: bool = False):
    """Logits of the windows; keep: also all that the backward pass needs."""
    n, h = len(number), HIDDEN
    state = np.zeros((2, n, h), np.float32)
    states = np.empty((WINDOW, 2, n, h), np.float32)
    kept = []
    both = np.stack([number, number[:, ::-1]])
    mask = np.stack([there, there[:, ::-1]]).astype(np.float32)
    for t in range(WINDOW):
        x = np.stack([projected[0][both[0, :, t]], projected[1][both[1, :, t]]])
        u = np.matmul(state, weights["u"])
        gates = _sigmoid(x[:, :, : 2 * h] + u[:, :, : 2 * h])
        z, r = gates[:, :, :h], gates[:, :, h:]
        new = np.tanh(x[:, :, 2 * h :] + r * u[:, :, 2 * h :])
        step = mask[:, :, t, None] * (1 - z)
        following = state + step * (new - state)
        if keep:
            kept.append((state, u, z, r, new))
        states[t, 0], state = following[0], following
        states[WINDOW - 1 - t, 1] = following[1]
    seen = np.concatenate([states[:, 0], states[:, 1]], 2)  # place x window x 2 HIDDEN
    key = np.tanh(seen @ weights["a"])
    score = np.where(there.T, key @ weights["v"], np.float32(-1e9))
    weight = np.exp(score - score.max(0))
    weight /= weight.sum(0)
    pooled = (weight[:, :, None] * seen).sum(0)
    logit = pooled @ weights["o"] + weights["c"]
    return (logit, (kept, both, mask, seen, key, weight, pooled)) if keep else logit


def backward(d: np.ndarray, cache: tuple, words_used: int, weights: Weights) -> tuple[Weights, np.ndarray]:
    """Gradients of the weights beyond the inputs, and of the projections, for gradients d of the logits."""
    kept, both, mask, seen, key, weight, pooled = cache
    h, n = HIDDEN, len(d)
    out = {"o": pooled.T @ d, "c": d.sum(keepdims=True)}
    d_pooled = d[:, None] * weights["o"]
    d_weight = (seen * d_pooled).sum(2)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    d_key = d_score[:, :, None] * weights["v"] * (1 - key**2)
    out["v"] = (d_score[:, :, None] * key).sum((0, 1))
    out["a"] = seen.reshape(-1, 2 * h).T @ d_key.reshape(-1, h)
    d_seen = weight[:, :, None] * d_pooled + d_key @ weights["a"].T
    out["u"] = np.zeros_like(weights["u"])
    d_projected = np.zeros((2, words_used, 3 * h), np.float32)
    d_state = np.zeros((2, n, h), np.float32)
    for t in range(WINDOW - 1, -1, -1):
        state, u, z, r, new = kept[t]
        d_state = d_state + np.stack([d_seen[t, :, :h], d_seen[WINDOW - 1 - t, :, h:]])
        m = mask[:, :, t, None]
        d_new = d_state * m * (1 - z) * (1 - new**2)
        d_z = d_state * m * (state - new) * z * (1 - z)
        d_r = d_new * u[:, :, 2 * h :] * r * (1 - r)
        d_x = np.concatenate([d_z, d_r, d_new], 2)
        d_u = np.concatenate([d_z, d_r, d_new * r], 2)
        out["u"] += np.matmul(state.transpose(0, 2, 1), d_u)
        for k in (0, 1):
            np.add.at(d_projected[k], both[k, :, t], d_x[k])
        d_state = d_state * (1 - m * (1 - z)) + np.matmul(d_u, weights["u"].transpose(0, 2, 1))
    return out, d_projected


def _step(words: Words, which: np.ndarray, labels: np.ndarray, importance: np.ndarray, weights: Weights, rng: np.random.Generator) -> Weights:
    number, there = words.windows(which)
    used, number = np.unique(number, return_inverse=True)
    number = number.reshape(there.shape)
    bucket = (words.hashes[used] % np.uint64(HASHED)).astype(np.int64)
    chars, place, contexts = char_features(words, used, weights["char"], argmax=True)
    shown = (rng.random((len(used), 1)) >= HIDDEN_WORDS).astype(np.float32)
    x = np.concatenate([weights["word"][bucket] * shown, chars], 1)
    logit, cache = run(project(x, weights), number, there, weights, keep=True)
    d = ((_sigmoid(logit) - labels) * importance / len(labels)).astype(np.float32)
    grads, d_projected = backward(d, cache, len(used), weights)
    grads["w"] = np.matmul(x.T[None], d_projected)
    grads["b"] = d_projected.sum(1, keepdims=True)
    d_x = np.matmul(d_projected, weights["w"].transpose(0, 2, 1)).sum(0)
    grads["word"] = np.zeros_like(weights["word"])
    np.add.at(grads["word"], bucket, d_x[:, :WORD_DIM] * shown)
    d_char = d_x[:, WORD_DIM:] * (1 - chars**2)
    grads["char"] = np.zeros_like(weights["char"])
    filters = np.broadcast_to(np.arange(CHAR_DIM), place.shape)
    for k in range(2 * REACH + 1):
        np.add.at(grads["char"][k], (contexts[k][place], filters), d_char)
    return grads


def fit(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> tuple[Weights, float]:
    """Weights, and the logit from which a text counts as toxic: between the two classes of a held-out fifth."""
    rng = np.random.default_rng(seed)
    words = Words(*text_bytes(pa.array(texts, pa.string())))
    toxic = np.asarray(toxic, np.float32)
    held = rng.random(len(texts)) < 0.2
    first = np.searchsorted(words.window_doc, np.arange(len(texts)))
    count = np.bincount(words.window_doc, minlength=len(texts))
    usable = np.flatnonzero(~held & (count > 0))
    if not len(usable):
        return new_weights(seed), np.inf
    share = max(float(toxic[usable].mean()), 1e-3)
    weights = new_weights(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    every = np.arange(len(words.hashes))
    rounds, order, begin, top = 0, np.arange(len(words.window_doc)), first, count
    for epoch in range(epochs):
        if epoch >= 2 and epoch % 3 == 2:
            logits = score_windows(words, project_words(words, every, weights), weights)
            order, begin, top = ranked(words, logits, len(texts))
        for at in range(0, len(usable), BATCH):
            if at == 0:
                rng.shuffle(usable)
            docs = usable[at : at + BATCH]
            any_one = first[docs] + (rng.random(len(docs)) * count[docs]).astype(np.int64)
            high = order[begin[docs] + (rng.random(len(docs)) * top[docs]).astype(np.int64)]
            which = np.concatenate([high, any_one[toxic[docs] == 0]])
            y = np.concatenate([toxic[docs], np.zeros(int((toxic[docs] == 0).sum()), np.float32)])
            grads = _step(words, which, y, np.where(y > 0, min(10.0, 0.5 / share), 1.0), weights, rng)
            rounds += 1
            rate = RATE * (1 - 0.8 * epoch / epochs)
            for k, g in grads.items():
                g = np.clip(g, -1, 1) + (1e-4 * weights[k] if k in ("word", "char") else 0)
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                weights[k] -= (rate * (mean[k] / (1 - 0.9**rounds)) / (np.sqrt(square[k] / (1 - 0.99**rounds)) + 1e-6)).astype(np.float32)
    scores = text_scores(words, score_windows(words, project_words(words, every, weights), weights), len(texts))
    own = held & (count > 0)
    if own.sum() < 20 or toxic[own].sum() < 3:
        own = count > 0
    return weights, _threshold(scores[own], toxic[own] > 0)


def _threshold(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The logit with the fewest errors, a clean text's counting twice; of several, the middle of the widest gap."""
    if toxic.all() or not toxic.any():
        return np.inf
    ordered = np.unique(scores)
    cuts = np.concatenate([[ordered[0] - 1], (ordered[1:] + ordered[:-1]) / 2, [ordered[-1] + 1]])
    errors = np.array([(~toxic & (scores >= c)).sum() * 2 + (toxic & (scores < c)).sum() for c in cuts])
    width = np.concatenate([[0], np.diff(ordered), [0]])
    best = errors == errors.min()
    return float(cuts[best][np.argmax(width[best])])


def score_windows(words: Words, projected: np.ndarray, weights: Weights, size: int = 1024) -> np.ndarray:
    out = np.zeros(len(words.window_doc), np.float32)
    order = np.argsort(words.window_size, kind="stable")
    for at in range(0, len(out), size):
        which = order[at : at + size]
        out[which] = run(projected, *words.windows(which), weights)
    return out


def ranked(words: Words, logits: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows by text and falling logit; where each text's begin, and how many of them count."""
    order = np.lexsort((-logits, words.window_doc))
    count = np.bincount(words.window_doc, minlength=texts)
    return order, np.cumsum(count) - count, np.ceil(count * TOP).astype(np.int64)


def text_scores(words: Words, logits: np.ndarray, texts: int) -> np.ndarray:
    """Each text's score, its highest window's; without words minus infinity."""
    out = np.full(texts, -np.inf)
    if len(logits):
        first = np.flatnonzero(np.append(True, np.diff(words.window_doc) > 0))
        out[words.window_doc[first]] = np.maximum.reduceat(logits, first)
    return out


class Scorer:
    """Scores steps of texts; keeps the projections of words seen before."""

    def __init__(self, weights: Weights):
        self.weights = weights
        self.hashes = np.zeros(0, np.uint64)
        self.projected = np.zeros((2, 0, 3 * HIDDEN), np.float32)

    def __call__(self, column: pa.Array) -> np.ndarray:
        words = Words(*text_bytes(column))
        if not len(words.window_doc):
            return np.full(len(column), -np.inf)
        at = np.searchsorted(self.hashes, words.hashes)
        known = np.append(self.hashes, np.uint64(0))[at] == words.hashes
        known &= at < len(self.hashes)
        projected = np.empty((2, len(words.hashes), 3 * HIDDEN), np.float32)
        projected[:, known] = self.projected[:, at[known]]
        fresh = np.flatnonzero(~known)
        projected[:, fresh] = project_words(words, fresh, self.weights)
        if len(self.hashes) + len(fresh) > KEPT_WORDS:
            self.hashes, self.projected = words.hashes[:KEPT_WORDS], projected[:, :KEPT_WORDS]
        elif len(fresh):
            hashes = np.concatenate([self.hashes, words.hashes[fresh]])
            order = np.argsort(hashes)
            self.hashes, self.projected = hashes[order], np.concatenate([self.projected, projected[:, fresh]], 1)[:, order]
        return text_scores(words, score_windows(words, projected, self.weights), len(column))


def training_texts(docs: DataFrame, labels: DataFrame, texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS) -> tuple[list[str], np.ndarray]:
    """At most texts labelled texts, and no further ones beyond chars in all; the labels' side, which the first bound keeps small, is broadcast. Of several texts of a doc_id the least is taken."""
    labels = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    sample = F.broadcast(labels.groupBy("label_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(texts))
    rows = plain(docs).where("text <> ''").join(sample, F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found, total = [], 0
    for row in rows.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        total += len(row.text)
        if found and total > chars:
            break
        found.append(row)
    found.sort(key=lambda r: r.doc_id)
    return [r.text for r in found], np.array([r.toxic for r in found], np.float32)


_fitted: dict[bytes, tuple[Weights, float]] = {}


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Weights, float]:
    texts, toxic = training_texts(docs, labels)
    digest = hashlib.sha256(toxic.tobytes())
    for text in texts:
        digest.update(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
    if (key := digest.digest()) not in _fitted:
        while len(_fitted) >= 4:
            del _fitted[next(iter(_fitted))]
        _fitted[key] = fit(texts, toxic)
    return _fitted[key]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with toxicity (0 to 1, 0.5 at the fitted threshold) and is_toxic.

    The model is fitted on a bounded sample of labels(doc_id, toxic) and sent to the workers, 1 MB at any size of the
    corpus; no shuffle. Texts that are null, empty or hold no letters and digits score 0. Very long texts are read whole, in all their windows. A score that equals the
    threshold is toxic. Repeated rows score alike; an empty table gives no rows; labels with nulls are left out, a doc_id with several counts as toxic if one says so; without
    labels of both kinds nothing is toxic. Columns of docs that have the name of a result are replaced.
    """
    spark = docs.sparkSession
    weights, threshold = fitted(docs, labels)
    shared = spark.sparkContext.broadcast((weights, threshold))
    new = T.StructType().add("toxicity", T.DoubleType()).add("is_toxic", T.BooleanType())
    kept = docs.drop(*new.names)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, threshold = shared.value
        scorer = Scorer(weights)
        for batch in batches:
            for part in steps(batch):
                logit = scorer(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_sigmoid(logit - (threshold if np.isfinite(threshold) else 0.0))), pa.array(logit >= threshold)], [*part.schema.names, *new.names])
            release()
        del scorer
        release()

    return map_batches(kept, run_all, new)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, all columns, without the toxic ones.

    Rows whose text is null or empty stay; a null doc_id plays no part. Very long texts, ties, repeated rows and empty tables as in score. Columns of any
    name are kept, as they are.
    """
    new = {"toxicity": unused(docs, "toxicity"), "is_toxic": unused(docs, "is_toxic")}
    kept = docs.withColumnsRenamed({c: new[c.lower()] for c in docs.columns if c.lower() in new and new[c.lower()] != c.lower()})
    back = {v: c for c, v in zip(docs.columns, kept.columns)}
    return score(kept, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("NOT is_toxic").select(*(F.col(f"`{v}`").alias(c) for v, c in back.items()))
