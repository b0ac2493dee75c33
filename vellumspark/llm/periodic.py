"""Periodic runs of words by recompression.

A text of word numbers is compressed to one symbol by turns of block compression (a block of equal symbols becomes a
symbol) and pair compression (symbols fall in two classes by a hash, and a left one followed by a right one becomes a
symbol). The levels are a run-length grammar in which equal stretches are parsed alike but for their edges, so how far
two places agree is found by climbing while they agree and descending where they differ, a constant number of steps a
level. Candidates are the places k * q and (k + 1) * q of every period q; a run holds two such neighbours, and the two
extensions of that pair give the run exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.wordhash import BASE, rolling

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, longest struct<start long, length long, period long>, collapsed string"


class WordNumbers(dict):
    """Numbers of words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Level(NamedTuple):
    """A level's symbols and how they form those of the next: `first[k]` is the place where symbol k of the next begins."""

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    block: bool

    def mirrored(self) -> Level:
        m, above = len(self.symbols), len(self.first) - 1
        return Level(self.symbols[::-1], above - 1 - self.parent[::-1], m - self.first[::-1], self.block)


def _named(keys: np.ndarray, known: int) -> tuple[np.ndarray, int]:
    """A new symbol for every distinct key, and the number of symbols known then."""
    values, at = np.unique(keys, return_inverse=True)
    return known + at, known + len(values)


def _classes(symbols: np.ndarray, turn: int) -> np.ndarray:
    x = (symbols.astype(np.uint64) + np.uint64(turn + 1)) * BASE
    x ^= x >> np.uint64(29)
    return (x * BASE) >> np.uint64(63) == 0


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels from a text, numbers from 0, up to a single symbol."""
    levels: list[Level] = []
    known, turn, shift = int(symbols.max(initial=0)) + 1, 0, np.int64(32)

    def add(head: np.ndarray, block: bool) -> np.ndarray:
        first = np.flatnonzero(head)
        levels.append(Level(symbols, np.cumsum(head) - 1, np.append(first, len(symbols)), block))
        return symbols[first]

    symbols = symbols.astype(np.int64)
    while len(symbols) > 1:
        head = np.append(True, symbols[1:] != symbols[:-1])
        if not head.all():
            above = add(head, True)
            size = np.diff(levels[-1].first)
            long = size > 1
            above[long], known = _named(above[long] << shift | size[long], known)
            symbols = above
        left = _classes(symbols, turn)
        turn += 1
        pairs, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        at = np.flatnonzero(pairs if pairs.sum() >= other.sum() else other)
        if len(at):
            head = np.ones(len(symbols), bool)
            head[at + 1] = False
            above = add(head, False)
            above[levels[-1].parent[at]], known = _named(symbols[at] << shift | symbols[at + 1], known)
            symbols = above
    return levels


def reach(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For places x and y of the text, x < y, the first place from x on that differs from its counterpart from y on.

    The text's first and last symbols must occur nowhere else in it.
    """
    x, y = x.copy(), y.copy()
    live, ended = np.arange(len(x)), []
    for level in levels:
        a, b = x[live], y[live]
        up, over = level.parent[a], level.parent[b]
        apart = np.zeros(len(a), bool)
        if level.block:
            inside = (level.first[up] != a) | (level.first[over] != b)
            same = inside & (level.symbols[a] == level.symbols[b])
            p, q = level.first[up + 1] - a, level.first[over + 1] - b
            least = np.where(same, np.minimum(p, q), 0)
            apart = inside & ~(same & (p == q))
            a, b = a + least, b + least
        else:
            # After one agreeing step both places have the same symbol before them, so two steps bring both to a start.
            for _ in range(2):
                inside = ~apart & ((level.first[level.parent[a]] != a) | (level.first[level.parent[b]] != b))
                if not inside.any():
                    break
                same = inside & (level.symbols[a] == level.symbols[b])
                apart |= inside & ~same
                a, b = a + same, b + same
        x[live], y[live] = a, b
        ended.append(live[apart])
        live = live[~apart]
        x[live], y[live] = level.parent[x[live]], level.parent[y[live]]
    down = live
    for level, more in zip(reversed(levels), reversed(ended)):
        up, over = x[down], y[down]
        a, b = level.first[up], level.first[over]
        step = np.minimum(level.first[up + 1] - a, level.first[over + 1] - b) if level.block else 1
        step = np.where(level.symbols[a] == level.symbols[b], step, 0)
        x[down], y[down] = a + step, b + step
        down = np.concatenate([down, more])
    return x


def _grid(sizes: np.ndarray, window: int, times: int, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) of every place k * q of a document whose window and that q further lie inside it."""
    most = np.maximum(0, np.minimum(sizes // times, sizes - window))
    doc = np.repeat(np.arange(len(sizes)), most)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    n = (sizes[doc] - window) // q
    total = np.cumsum(n)
    cuts = np.searchsorted(total, np.arange(at_once, (total[-1] if len(total) else 0) + at_once, at_once), "right")
    lo = 0
    for hi in [*np.unique(cuts), len(q)]:
        if hi > lo:
            size = n[lo:hi]
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            period = np.repeat(q[lo:hi], size)
            yield np.repeat(doc[lo:hi], size), k * period, period
        lo = hi


def find_runs(texts: list[np.ndarray], least: int = 24, times: int = 3, at_once: int = 500_000) -> list[np.ndarray]:
    """Runs (start, length, period) of every text of word numbers, by start and then period.

    A run of length L holds the first grid place i >= start, below start + q; from there on at least L - 2q + 1 words
    agree with those q further. The smallest such number over all periods is the window by which grid places are sieved.
    """
    if least < 1 or times < 2:
        raise ValueError("least must be 1 or more, times 2 or more")
    window = max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1)))
    none = np.empty((0, 3), np.int64)
    out = [none] * len(texts)
    long = [k for k, t in enumerate(texts) if len(t) >= max(least, times)]
    if not long:
        return out

    def joined(chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The chosen texts with a number of its own before each and at the end; and where each begins."""
        marks = max(int(texts[k].max()) for k in chosen) + 1
        parts = [p for i, k in enumerate(chosen) for p in (np.array([marks + i]), texts[k])] + [np.array([marks + len(chosen)])]
        sizes = np.array([len(texts[k]) for k in chosen])
        return np.concatenate(parts), np.cumsum(sizes + 1) - sizes

    # Only texts in which a window occurs twice can have a run.
    whole, begin = joined(long)
    sizes = np.array([len(texts[k]) for k in long])
    h = rolling((whole.astype(np.uint64) + np.uint64(1)) * BASE ^ BASE >> np.uint64(7), window)
    owner = np.repeat(np.arange(len(long)), sizes + 1)[: len(h)]
    h = h[: len(owner)]
    h = (h ^ h >> np.uint64(31)) * BASE + owner.astype(np.uint64)
    order = np.argsort(h, kind="stable")
    twice = h[order][1:] == h[order][:-1]
    kept = np.unique(owner[order[1:][twice]])
    if not len(kept):
        return out
    chosen = [long[k] for k in kept]
    text, begin = joined(chosen)
    h = rolling((text.astype(np.uint64) + np.uint64(1)) * BASE ^ BASE >> np.uint64(7), window)
    levels, mirrored, found = None, None, []
    for doc, place, q in _grid(sizes[kept], window, times, at_once):
        i = begin[doc] + place
        hit = h[i] == h[i + q]
        # Neighbouring grid places whose windows touch belong to one run.
        before = np.append(False, hit[:-1] & (place[1:] > 0))
        hit &= ~(before & (q <= window))
        doc, i, q = doc[hit], i[hit], q[hit]
        if not len(i):
            continue
        if levels is None:
            levels = grammar(text)
            mirrored = [level.mirrored() for level in levels]
        n = len(text)
        end = reach(levels, i, i + q) + q
        # Mirrored, the place before i is n - i; the later of the two comes first there.
        start = n - q - reach(mirrored, n - i - q, n - i)
        good = end - start >= np.maximum(least, times * q)
        found.append(np.stack([doc, start - begin[doc], end - start, q], axis=1)[good])
    rows = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    # A stretch is found with its smallest period and with multiples of it.
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)) if len(rows) else np.empty(0, bool)
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    edges = np.searchsorted(rows[:, 0], np.arange(len(chosen) + 1))
    for d, k in enumerate(chosen):
        out[k] = rows[edges[d] : edges[d + 1], 1:]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _runs(least: int, times: int, chunk_words: int):
    def answered(ids: list, texts: list[list[bytes]], numbers: list[np.ndarray]) -> pa.RecordBatch:
        found = find_runs(numbers, least, times)
        runs, best, kept = [], [], []
        for words, r in zip(texts, found):
            rows = [dict(zip(("start", "length", "period"), x)) for x in r.tolist()]
            runs.append(rows)
            best.append(max(rows, key=lambda x: (Fraction(x["length"], x["period"]), -x["start"], -x["period"])) if rows else None)
            kept.append(b" ".join(collapse(words, r)).decode())
        arrays = [pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(best, RUN), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "longest", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordNumbers()
        for batch in batches:
            ids, texts, numbers, size = [], [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                if len(known) > 300_000:
                    known.clear()
                ids.append(i)
                texts.append(words)
                numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                size += len(words)
                if size >= chunk_words:
                    yield answered(ids, texts, numbers)
                    ids, texts, numbers, size = [], [], [], 0
            if ids:
                yield answered(ids, texts, numbers)

    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = 200_000) -> DataFrame:
    """Runs of words of every text: maximal stretches of length `least` and `times` their smallest period or more.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0. Returns doc_id, n_words, runs (start, length, period; by start, then
    period), longest (the run of the greatest length / period; ties: smallest start, then period; null without runs) and
    collapsed, the words that lie in no run after its first period, joined by one space.

    One row an input row, repeated ids and null ids as they are; null and empty texts have no words and no runs. Other
    columns are not read; an empty table gives no rows. One pass without a shuffle: short texts share a grammar of about
    `chunk_words` words, a longer text has one of its own.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return whole.mapInArrow(_runs(least, times, chunk_words), SCHEMA)
