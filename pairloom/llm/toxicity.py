"""Toxicity scores by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the hashed embeddings of the word and of its
first bytes (so inflected forms share parts).  Filters of several widths run over
the word sequence, each is max-pooled over the whole text, and a logistic layer
makes the logit.  Training is in numpy: the first embedding component starts from
the smoothed log-odds of each hash bucket; filters and output weights are then fitted
by Adam, embeddings and bias by plain gradient steps, on at most `TRAIN_PER_LABEL`
labelled texts of each label.  The decision threshold is calibrated on at most
`CALIBRATE` labelled texts that were not fitted (a hash of the id parts the two: one
in `CALIBRATE_SHARE` is kept for it) for each language, as guessed from the text's own
function words, and is moved to a score of 0.5: score = sigmoid(logit - threshold(language)).

Labels, lang, source and doc_id never enter a score; doc_id only picks the
training rows: crc32(doc_id as text) mod `folds` is not 0.

Defined results: null and empty texts have no words and get the score of an empty
text; texts of any length are pooled whole; without labelled rows of both labels every
score is 0; several labels of a document count as toxic when one of them does; rows of
one labelled doc_id are texts of their own with its label (within the sample's bounds, which are on
rows and bytes); repeated rows each come out
with equal scores; of equally good thresholds the middle one holds; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from .shared import binary, give_back
from .wordhash import ALNUM_WORDS, hash_spans, mix, spans

#: Documented bounds of the labelled sample (texts).
TRAIN_PER_LABEL, CALIBRATE, CALIBRATE_SHARE = 2500, 3000, 4
#: Documented bound of the bytes of each of the three samples; texts of a sixteenth of it and more are not learnt from.
SAMPLE_BYTES = 64 << 20
BUCKETS, DIMS, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 6
#: Leading bytes of a word that are hashed besides the whole.
PREFIXES = (4, 5)
#: Words that pass through the filters at once; pieces overlap by the largest width.
PIECE = 50_000

#: Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "was", "for", "it", "with", "as", "on", "be", "at", "by", "this", "from", "are", "or"),
    "de": ("der", "die", "und", "den", "das", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "fr": ("le", "la", "les", "et", "des", "en", "du", "un", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "avec", "pas", "de"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "del", "se", "por", "con", "para", "su", "lo", "como", "más", "no"),
}
LANGUAGES = tuple(FUNCTION_WORDS)


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    data = " ".join(words).encode()
    return np.unique(hash_spans(data, *spans(data, ALNUM_WORDS)))


_STOPS = [_hash_words(w) for w in FUNCTION_WORDS.values()]


def features(text: bytes | None) -> tuple[np.ndarray, int]:
    """Bucket numbers (words x parts) of a text and its guessed language."""
    data = (text or b"").lower()
    start, end = spans(data, ALNUM_WORDS)
    whole = hash_spans(data, start, end)
    parts = [whole] + [mix(hash_spans(data, start, np.minimum(start + n, end)) + np.uint64(n)) for n in PREFIXES]
    ids = np.stack(parts, axis=1) & np.uint64(BUCKETS - 1)
    counts = [int((s[np.minimum(np.searchsorted(s, whole), len(s) - 1)] == whole).sum()) if len(whole) else 0 for s in _STOPS]
    return ids.astype(np.int32), int(np.argmax(counts))


class Cnn:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((BUCKETS, DIMS)) * 0.02).astype(np.float32)
        self.kernels = [(rng.standard_normal((w, DIMS, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS]
        for k in self.kernels:
            k[:, 0, :] += rng.uniform(0.5, 1.0, k[:, 0, :].shape).astype(np.float32) / len(k)
        size = FILTERS * len(WIDTHS)
        self.out, self.bias = np.full(size, 1.0 / size, np.float32), np.float32(0)
        self.thresholds = np.zeros(len(LANGUAGES), np.float32)
        self.trained = False

    def embed(self, ids: np.ndarray) -> np.ndarray:
        x = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x = x + self.table[ids[:, k]]
        return x

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over the text and the window where it stands."""
        short = max(WIDTHS) - len(ids)
        x = self.embed(ids) if len(ids) else np.zeros((0, DIMS), np.float32)
        if short > 0:  # empty words at the end
            x = np.concatenate([x, np.zeros((short, DIMS), np.float32)])
        best, places = [], []
        for kernel in self.kernels:
            n = len(x) - len(kernel) + 1
            response = x[:n] @ kernel[0]
            for k in range(1, len(kernel)):
                response += x[k : k + n] @ kernel[k]
            place = response.argmax(axis=0)
            best.append(response[place, np.arange(FILTERS)])
            places.append(place)
        return np.concatenate(best), np.concatenate(places)

    def logit(self, ids: np.ndarray) -> float:
        if len(ids) <= PIECE:
            return float(self.pooled(ids)[0] @ self.out + self.bias)
        over = max(WIDTHS) - 1
        best = np.max([self.pooled(ids[k : k + PIECE + over])[0] for k in range(0, len(ids) - over, PIECE)], axis=0)
        return float(best @ self.out + self.bias)

    def score(self, text: bytes | None) -> float:
        if not self.trained:
            return 0.0
        ids, language = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.logit(ids) - self.thresholds[language], -30, 30))))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, *, epochs: int = 3, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the log loss; the gradient of a pooled response goes to its window alone."""
        counts = np.zeros((2, BUCKETS), np.float32)
        for ids, label in zip(texts, labels, strict=True):
            counts[int(label), np.unique(ids)] += 1
        share = counts.sum(axis=1, keepdims=True).clip(1) / counts.sum().clip(1)
        odds = np.log((counts[1] + 5 * share[1]) / share[1]) - np.log((counts[0] + 5 * share[0]) / share[0])
        self.table[:, 0] += odds / (1 + len(PREFIXES))
        rng = np.random.default_rng(seed)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (*self.kernels, self.out)]
        step = 0
        for _ in range(epochs):
            for i in rng.permutation(len(texts)):
                ids = texts[i]
                if not len(ids):
                    continue
                best, places = self.pooled(ids)
                error = 1 / (1 + np.exp(-np.clip(best @ self.out + self.bias, -30, 30))) - labels[i]
                step += 1
                back = error * self.out
                grads = [np.zeros_like(k) for k in self.kernels]
                for w, kernel in enumerate(self.kernels):
                    for f in range(FILTERS):
                        g = back[w * FILTERS + f]
                        for k in range(len(kernel)):
                            at = places[w * FILTERS + f] + k
                            if at < len(ids):
                                own = ids[at]
                                grads[w][k, :, f] = g * self.table[own].sum(axis=0)
                                self.table[own] -= rate * g * kernel[k, :, f]
                for p, grad, (m, v) in zip((*self.kernels, self.out), (*grads, error * best), state, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    p -= rate * 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                self.bias -= np.float32(rate * error)
        self.trained = True

    def calibrate(self, texts: list[tuple[np.ndarray, int]], labels: np.ndarray) -> None:
        """For each language, the threshold between logits that makes the fewest errors on it, in the middle of its gap."""
        logits = np.array([self.logit(ids) for ids, _ in texts])
        languages = np.array([language for _, language in texts])

        def best(x: np.ndarray, y: np.ndarray) -> float:
            order = np.argsort(x)
            x, y = x[order], y[order]
            errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum(1 - y)])[-1] - np.concatenate([[0], np.cumsum(1 - y)])
            edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
            equal = np.flatnonzero(errors == errors.min())
            return float(edges[equal[len(equal) // 2]])

        if len(labels) and 0 < labels.sum() < len(labels):
            self.thresholds[:] = best(logits, labels)
            for k in range(len(LANGUAGES)):
                own = languages == k
                if min(labels[own].sum(), (1 - labels[own]).sum()) >= 20:
                    self.thresholds[k] = best(logits[own], labels[own])


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", folds: int = 5) -> Cnn:
    """Fit on labelled rows outside fold 0."""
    marked = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    marked = marked.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0).withColumn("order", F.xxhash64("doc_id", F.lit(1)))
    kept = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(CALIBRATE_SHARE)) == 0
    named = marked.withColumn("sample", F.when(kept, 2).otherwise(F.col("y")))
    most = (TRAIN_PER_LABEL, TRAIN_PER_LABEL, CALIBRATE)  # of label 0, of label 1, to calibrate on
    pick = lambda k: named.where(F.col("sample") == k).orderBy("order", "doc_id").limit(most[k])
    chosen = pick(0).union(pick(1)).union(pick(2))
    # ids are bounded, so broadcast; of the rows that share them each task passes on as many as a sample may hold
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(binary(text), F.lit(b"")).alias("text")).where(F.length("text") <= SAMPLE_BYTES // 16)
    order = Window.partitionBy("sample").orderBy("order", "doc_id", F.xxhash64("text"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(most))
    samples, sizes = ([], [], []), [0, 0, 0]
    for k, data, y in rows.orderBy("sample", "rank").select("sample", "text", "y").toLocalIterator():
        sizes[k] += len(data)
        if len(samples[k]) < most[k] and sizes[k] <= SAMPLE_BYTES:
            samples[k].append((*features(bytes(data)), y))
    fit, check = samples[0] + samples[1], samples[2]
    model, y = Cnn(), np.array([s[2] for s in fit], np.float32)
    if 0 < y.sum() < len(y):
        model.fit([s[0] for s in fit], y)
        model.calibrate([s[:2] for s in check], np.array([s[2] for s in check], np.float32))
    return model


def score_toxicity(docs: DataFrame, model: Cnn, *, text: str = "text", into: str = "toxicity") -> DataFrame:
    """`docs` with the score of the whole text in column `into` (a column of that name is replaced)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        found = pa.array([held.value.score(t.as_py()) for t in texts], pa.float64())
        give_back()
        return found

    return docs.withColumn(into, score(binary(text)))
