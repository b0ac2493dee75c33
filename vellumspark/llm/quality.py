"""Quality classifier: averaged subword embeddings with a softmax output, trained by stochastic gradient descent in numpy.

A text's features are its words, their character n-grams and its pairs of neighbouring words (a word repeated at once is one
feature, whatever the word), hashed to a fixed number of rows of an embedding table; the document vector is the average of their embeddings. Training runs on a bounded sample of labelled
documents. Scoring covers every whole text in one scan: because average and output layer are linear, each row of the
table is folded to its share of the final logit, and a word's shares are summed once and kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NGRAMS = (3,)
LONG = 256
MIX = np.uint64(0x9E3779B97F4A7C15)
REPEATED = np.uint64(1)


def word_rows(word: str, rows: int) -> Iterator[int]:
    """Table rows of a word and of all its character n-grams with borders."""
    edged = f"<{word}>"
    yield word_hash(word) % rows
    for n in NGRAMS:
        for i in range(len(edged) - n + 1):
            yield xxhash.xxh3_64_intdigest(f"{n}{edged[i : i + n]}") % rows


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(f"w{word}")


def pair_rows(hashes: np.ndarray, rows: int) -> np.ndarray:
    """Table rows of all pairs of neighbouring words, from the words' hashes.

    A word that is said twice running is one feature whatever the word, as in tokenizers that mark repetition.
    """
    a, b = hashes[:-1], hashes[1:]
    mixed = np.where(a == b, REPEATED, a * MIX + b)
    return ((mixed ^ (mixed >> np.uint64(29))) * MIX >> np.uint64(32)) % np.uint64(rows)


class _Grams(dict):
    """Logit share of a character n-gram; there are few, so they are kept, up to a bound."""

    def __init__(self, share: np.ndarray, room: int = 1_000_000):
        super().__init__()
        self.table, self.room = share, room

    def __missing__(self, gram: str) -> float:
        if len(self) >= self.room:
            self.clear()
        x = self[gram] = float(self.table[xxhash.xxh3_64_intdigest(f"{len(gram)}{gram}") % len(self.table)])
        return x


class _Shares(dict):
    """Maps a word to its place in arrays of summed logit shares, feature counts and hashes.

    Words longer than LONG are summed but not kept; `places` starts anew when `room` places are in use.
    """

    def __init__(self, share: np.ndarray, room: int = 300_000):
        super().__init__()
        self.table, self.room, self.used, self.grams = share, room, 0, _Grams(share)
        self.total, self.n, self.hashes = np.empty(1024), np.empty(1024, np.int64), np.empty(1024, np.uint64)

    def __missing__(self, word: str) -> int:
        h, edged = word_hash(word), f"<{word}>"
        total, n, share = float(self.table[h % len(self.table)]), 1, self.grams.__getitem__
        for size in NGRAMS:
            runs = len(edged) - size + 1
            total += sum(share(edged[i : i + size]) for i in range(runs))
            n += max(0, runs)
        k = self.used
        if k == len(self.n):
            self.total, self.n, self.hashes = (np.concatenate([x, np.empty_like(x)]) for x in (self.total, self.n, self.hashes))
        self.total[k], self.n[k], self.hashes[k] = total, n, h
        self.used += 1
        if len(word) <= LONG:
            self[word] = k
        return k

    def places(self, words: list[str]) -> np.ndarray:
        if self.used >= self.room:
            self.clear()
            self.used = 0
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def mean(self, words: list[str]) -> float:
        """Average share of all features of a text."""
        at = self.places(words)
        pairs = pair_rows(self.hashes[at], len(self.table))
        total = self.total[at].sum() + self.table[pairs].sum(dtype=np.float64)
        return float(total / max(1, self.n[at].sum() + len(pairs)))


@dataclass
class Classifier:
    table: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def shares(self) -> np.ndarray:
        return (self.table @ (self.output[1] - self.output[0])).astype(np.float32)


def _bag(text: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    counts: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for r in word_rows(word, rows):
            counts[r] += n
    hashes = np.fromiter(map(word_hash, words), np.uint64, len(words))
    for r, n in zip(*np.unique(pair_rows(hashes, rows), return_counts=True)):
        counts[int(r)] += int(n)
    return np.fromiter(counts.keys(), np.int32, len(counts)), np.fromiter(counts.values(), np.float32, len(counts))


def _bags(rows: int):
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights = [], []
            for text in batch.column(1):
                at, n = _bag(text.as_py() or "", rows)
                ids.append(at.tobytes())
                weights.append(n.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], names=["doc_id", "label", "rows", "weights"])

    return bags


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, rows: int = 1 << 17, dim: int = 8, epochs: int = 8, rate: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    """Fits the classifier on at most `sample` labelled documents, those with the smallest hash of their id.

    Only 0 and 1 are labels; null ids, other labels and labels without a document are left out. With one class or no
    label the classifier answers with that class, or 0.5. Classes weigh the same, however many documents each has. Of
    labels or texts that disagree under one id, the larger label and the smaller text count.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    got = texts.mapInArrow(_bags(rows), "doc_id long, label int, rows binary, weights binary").toLocalIterator()
    bags = sorted(((r.doc_id, r.label, np.frombuffer(r.rows, np.int32), np.frombuffer(r.weights, np.float32)) for r in got), key=lambda b: b[0])
    rng = np.random.default_rng(7)
    table = rng.uniform(-1 / dim, 1 / dim, (rows, dim)).astype(np.float32)
    output, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    sizes = np.array([sum(b[1] == k for b in bags) for k in (0, 1)])
    if not sizes.all():
        bias[:] = np.where(sizes > 0, 2.0, 0.0)
        return Classifier(np.zeros_like(table), output, bias)
    weight = len(bags) / (2 * sizes)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(bags)):
            _, label, at, n = bags[k]
            total = max(1.0, float(n.sum()))
            vector = n @ table[at] / total
            logits = output @ vector + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            p *= np.float32(weight[label])
            back = p @ output
            output -= step * np.outer(p, vector)
            bias -= step * 0.1 * p
            table[at] -= np.minimum(step * n / total * 50, 1.0)[:, None] * back
    return Classifier(table, output, bias)


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text: doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 up).

    Null, empty and blank texts have no features and get the score of the bias alone. Repeated rows give repeated
    results, null ids stay null, other columns are not read, an empty table gives no rows. One scan without a shuffle;
    the broadcast is the folded table, of fixed size.
    """
    share = docs.sparkSession.sparkContext.broadcast(model.shares())
    offset = float(model.bias[1] - model.bias[0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = _Shares(share.value)
        for batch in batches:
            out = [shares.mean((text.as_py() or "").split()) + offset for text in batch.column(1)]
            p = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(scored, "doc_id long, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    """Rows no label is learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
