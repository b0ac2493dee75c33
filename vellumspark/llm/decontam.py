"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents inside a task. Its text is the sequence of its words, in which words that no benchmark
item can have are all the same separator; runs too short to hold the shortest window are left out, as nothing can occur in
them. Which words to keep is told by a table of bits of fixed size, so that a shard's index does not depend on the items
searched in it and is built once. The index is the wavelet matrix of the Burrows-Wheeler transform with rank samples. All
windows are searched backwards together, occurrences are located through sampled suffix positions, and their spans merge
per document.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellumspark.llm.store import new_path, staged
from vellumspark.llm.wordhash import WORDS

# Bytes that are not in [0-9A-Za-z\x80-\xFF] split words, A-Z become a-z.
SPLIT = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
ITEM_WORD = re.compile(r"(?:[0-9A-Za-z]|[^\x00-\x7F])+")
SAMPLE = 16
# The table of words to keep has this power of two of bits: one megabyte for any benchmark; a false word is only indexed for nothing.
KNOWN_BITS = 23


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(SPLIT).split()


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys and the dense rank of each."""
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), np.int64)
    sorted_keys = keys[order]
    new[order] = np.cumsum(np.append(0, sorted_keys[1:] != sorted_keys[:-1]))
    return order, new


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol is smaller than any other and unique."""
    order, rank = _ranked(text)
    step, n = 1, len(text)
    while rank[order[-1]] < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        order, rank = _ranked(rank * (n + 1) + ahead)
        step *= 2
    return order


class FMIndex:
    """Backward search and location over a sequence of small non-negative numbers; 0 ends it."""

    def __init__(self, text: np.ndarray, alphabet: int):
        sa = suffix_array(text)
        marked = sa % SAMPLE == 0
        self._built(text[sa - 1], alphabet, marked, sa[marked])

    def _built(self, bwt: np.ndarray, alphabet: int, marked: np.ndarray, samples: np.ndarray) -> None:
        self.size = len(bwt)
        self.levels = max(1, (alphabet - 1).bit_length())
        counts = np.bincount(bwt, minlength=1 << self.levels)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.ones, self.zeros = [], []
        row = bwt
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(row) - int(bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.marked = marked
        self.mark_rank = np.cumsum(marked) - 1
        self.samples = samples
        self.bwt = bwt

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place, through the wavelet levels."""
        lo, hi = np.zeros_like(at), at.copy()
        for k, level in enumerate(reversed(range(self.levels))):
            one = ((symbols >> level) & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length, one a row of the matrix."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for j in reversed(range(phrases.shape[1])):
            c = phrases[alive, j]
            lo[alive] = self.before[c] + self.rank(c, lo[alive])
            hi[alive] = self.before[c] + self.rank(c, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
        hi = np.maximum(lo, hi)
        gone = np.ones(len(phrases), bool)
        gone[alive] = False
        hi[gone] = lo[gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by stepping back to a sampled one."""
        at, back = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.marked[at[open_]]
            done = open_[hit]
            out[done] = self.samples[self.mark_rank[at[done]]] + back[done]
            open_ = open_[~hit]
            c = self.bwt[at[open_]]
            at[open_] = self.before[c] + self.rank(c, at[open_])
            back[open_] += 1
        return out


@dataclass
class Phrases:
    """Distinct windows of a block of benchmark items, by length, as places in `words`, with the items each comes from."""

    words: np.ndarray
    by_length: dict[int, tuple[np.ndarray, list[list[str]]]]


def phrases(items: list[tuple[str, str | None]], window: int) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item, text in items:
        words = item_words(text)
        numbers = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            found.setdefault(k, {}).setdefault(tuple(numbers[i : i + k]), set()).add(item)
    return Phrases(WORDS.of(list(vocabulary)), {k: (np.array(list(w), np.int64), [sorted(s) for s in w.values()]) for k, w in found.items()})


@dataclass
class Known:
    """Which words the benchmark may have, by the first bits of their hashes, and how long its shortest window is (0: none)."""

    bits: np.ndarray
    shortest: int

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - KNOWN_BITS)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _known_part(window: int):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, shortest = np.zeros(1 << KNOWN_BITS, bool), 0
        for batch in batches:
            for text in batch.column(0):
                words = item_words(text.as_py())
                if words:
                    shortest = min(shortest or window, len(words))
                    flags[(WORDS.of(words) >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)] = True
        bits = zstandard.compress(np.packbits(flags, bitorder="little").tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([bits], pa.binary()), pa.array([shortest], pa.int32())], names=["bits", "shortest"])

    return part


def known_words(items: DataFrame, window: int) -> Known:
    """What all items have, one table of bits a partition brought together one after the other."""
    bits, lengths = np.zeros(1 << KNOWN_BITS - 3, np.uint8), []
    for r in items.select("text").mapInArrow(_known_part(window), "bits binary, shortest int").toLocalIterator():
        bits |= np.frombuffer(zstandard.decompress(r.bits), np.uint8)
        lengths += [r.shortest] if r.shortest else []
    return Known(bits, min(lengths, default=0))


@dataclass
class Shard:
    """The index of a shard's documents: the words it has, where each indexed place lies, and how long documents are."""

    index: FMIndex
    alphabet: np.ndarray
    keep: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray], known: Known) -> Shard | None:
        """From the word hashes of documents; None where no run is long enough to hold a window."""
        sizes = np.array([len(x) for x in docs], np.int64)
        hashes = np.concatenate(docs) if docs else np.empty(0, np.uint64)
        place = np.arange(len(hashes)) + np.repeat(np.arange(len(docs)), sizes)
        flat, held = np.zeros(len(hashes) + len(docs), np.uint64), np.zeros(len(hashes) + len(docs), bool)
        flat[place], held[place] = hashes, known.has(hashes)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long_enough = ends - starts >= max(1, known.shortest)
        starts, ends = starts[long_enough], ends[long_enough]
        if not known.shortest or not len(starts):
            return None
        keep = np.concatenate([np.arange(a, b + 1) for a, b in zip(starts, ends)])
        words = held[keep]
        alphabet, symbols = np.unique(flat[keep[words]], return_inverse=True)
        text = np.zeros(len(keep) + 1, np.int64)
        text[:-1] = 1
        text[:-1][words] = symbols + 2
        return cls(FMIndex(text, len(alphabet) + 2), alphabet, keep, sizes)

    def search(self, p: Phrases) -> tuple[list[np.ndarray], list[set[str]]]:
        """Covered word positions and matched items of every document of the shard."""
        covered = [np.zeros(0, bool)] * len(self.sizes)
        items: list[set[str]] = [set() for _ in self.sizes]
        at = np.searchsorted(self.alphabet, p.words)
        here = np.append(self.alphabet, np.uint64(0))[at] == p.words
        here &= at < len(self.alphabet)
        doc_start = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        for k, (matrix, owners) in p.by_length.items():
            able = np.flatnonzero(here[matrix].all(axis=1))
            lo, hi = self.index.search(at[matrix[able]] + 2)
            which = np.repeat(able, hi - lo)
            if not len(which):
                continue
            rows = np.concatenate([np.arange(a, b) for a, b in zip(lo[hi > lo], hi[hi > lo])])
            places = self.keep[self.index.locate(rows)]
            docs = np.searchsorted(doc_start, places, side="right") - 1
            for d, w, a in zip(docs.tolist(), which.tolist(), (places - doc_start[docs]).tolist()):
                if not len(covered[d]):
                    covered[d] = np.zeros(self.sizes[d], bool)
                covered[d][a : a + k] = True
                items[d].update(owners[w])
        return covered, items

    def packed(self) -> bytes:
        """The transform, the sampled positions and the rest; the wavelet levels follow from the transform."""
        i = self.index
        parts = [i.bwt, np.packbits(i.marked), i.samples, self.alphabet, self.keep, self.sizes]
        out = io.BytesIO()
        np.savez(out, *(x.astype(np.int32) if x.dtype == np.int64 and (not len(x) or x.max() < 2**31) else x for x in parts))
        return zstandard.compress(out.getvalue(), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(zstandard.decompress(data))) as z:
            bwt, marked, samples, alphabet, keep, sizes = (z[f"arr_{k}"] for k in range(6))
        index = FMIndex.__new__(FMIndex)
        index._built(bwt.astype(np.int64), len(alphabet) + 2, np.unpackbits(marked, count=len(bwt)).astype(bool), samples.astype(np.int64))
        return cls(index, alphabet, keep.astype(np.int64), sizes.astype(np.int64))


FOUND = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>, clean string"
FOUND_AT = "at long, items array<string>, spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its hit words, each run from its first word's start to its last word's end."""
    places = [m.span() for m in ITEM_WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join(kept) + text[at:]


def _results(rows: pa.Array, texts: list, sizes: list[int], items: list[list[str]], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """Rows with what was found in them; clean is null where nothing was."""
    arrays = [
        rows,
        pa.array(sizes, pa.int64()),
        pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
        pa.array([len(i) for i in items], pa.int64()),
        pa.array(items, pa.list_(pa.string())),
        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPANS),
        pa.array([_cut(t.as_py(), s) if s else None for t, s in zip(texts, spans)], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["row", "n_words", "n_hit", "n_items", "items", "spans", "clean"])


def _runs(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))).tolist() if len(covered) else []
    return list(zip(edge[::2], edge[1::2]))


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Rows (row, text) of about shard_words words together, and the word hashes of each."""
    pieces: list[pa.RecordBatch] = []
    docs: list[np.ndarray] = []
    held = 0
    for batch in batches:
        start = 0
        for k, text in enumerate(batch.column(1)):
            docs.append(WORDS.of(item_words(text.as_py())))
            held += len(docs[-1])
            if held >= shard_words or len(docs) >= 20_000:
                yield [*pieces, batch.slice(start, k + 1 - start)], docs
                pieces, docs, held, start = [], [], 0, k + 1
        if start < batch.num_rows:
            pieces.append(batch.slice(start))
    if docs:
        yield pieces, docs


def _scan(block: list[tuple[str, str | None]], window: int, known: Known, shard_words: int):
    """Indexes rows (row, text) shard by shard and searches each for the windows of the only block of items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases(block, window)
        for pieces, docs in _shards(batches, shard_words):
            shard = Shard.of(docs, known)
            covered, items = shard.search(p) if shard else ([np.zeros(0, bool)] * len(docs), [set()] * len(docs))
            texts = [t for x in pieces for t in x.column(1)]
            yield _results(pa.concat_arrays([x.column(0) for x in pieces]), texts, [len(x) for x in docs], [sorted(s) for s in items], [_runs(c) for c in covered])

    return scan


def _indexed(known: Known, shard_words: int):
    """One row a shard that can hold a window: the rows' numbers and the index."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, docs in _shards(batches, shard_words):
            if shard := Shard.of(docs, known):
                rows = np.concatenate([x.column(0).to_numpy(zero_copy_only=False) for x in pieces]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary()), pa.array([shard.packed()], pa.binary())], names=["rows", "shard"])

    return indexed


def _search(block: list[tuple[str, str | None]], window: int):
    """Searches stored indexes for the windows of one block of items; rows that have some."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases(block, window)
        for batch in batches:
            for rows, data in zip(batch.column(0), batch.column(1)):
                covered, items = Shard.unpacked(data.as_py()).search(p)
                hit = [d for d, s in enumerate(items) if s]
                at = np.frombuffer(rows.as_py(), np.int64)[hit]
                spans = pa.array([[{"start": a, "end": b} for a, b in _runs(covered[d])] for d in hit], SPANS)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([sorted(items[d]) for d in hit], pa.list_(pa.string())), spans], names=["at", "items", "spans"])

    return search


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges what several blocks found in one row: (row, text, found)."""
    for batch in batches:
        texts, sizes, items, spans = list(batch.column(1)), [], [], []
        for text, found in zip(texts, batch.column(2).to_pylist()):
            sizes.append(len(item_words(text.as_py())))
            items.append(sorted({i for f in found or [] for i in f["items"]}))
            merged: list[tuple[int, int]] = []
            for a, b in sorted((s["start"], s["end"]) for f in found or [] for s in f["spans"]):
                if merged and a <= merged[-1][1]:
                    merged[-1] = merged[-1][0], max(b, merged[-1][1])
                else:
                    merged.append((a, b))
            spans.append(merged)
        yield _results(batch.column(0), texts, sizes, items, spans)


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int, block_bytes: int, text_col: str) -> DataFrame:
    """Every row of docs as a struct `row`, with what was found in its text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n_blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) or 1
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    known = known_words(items, window)
    # One block at a time is on the driver and in the tasks; items are dealt by hash, so a block has about block_bytes.
    block = lambda b: [(r.item_id, r.text) for r in items.where(block_of == b).toLocalIterator()]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([rows.schema["row"], *StructType.fromDDL(FOUND).fields])
    if n_blocks == 1:
        return rows.mapInArrow(_scan(block(0), window, known, shard_words), schema)
    held = staged(rows.withColumn("at", F.monotonically_increasing_id()), "texts")
    index = staged(held.select("at", "text").mapInArrow(_indexed(known, shard_words), "rows binary, shard binary"), "indexes")
    path = new_path(spark, "found")
    for b in range(n_blocks):
        index.mapInArrow(_search(block(b), window), FOUND_AT).write.mode("append").parquet(path)
    found = spark.read.schema(FOUND_AT).parquet(path)
    by_row = found.groupBy("at").agg(F.collect_list(F.struct("items", "spans")).alias("found"))
    return held.join(by_row, "at", "left").select("row", "text", "found").mapInArrow(_unite, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 1 << 19, block_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences of benchmark windows in documents, one row a document.

    Words are runs of 0-9, A-Z (as a-z) and characters past ASCII. A window is `window` consecutive words of an item; an
    item with fewer, but not none, is one window. Returns doc_id, n_words, n_hit (words inside any occurrence), n_items
    and items (ids as text, of those with occurrences) and spans (maximal hit word intervals, end exclusive).

    Benchmark items are searched in blocks of about block_bytes, one after the other, so neither the driver nor a task
    holds more than one. Documents are read once: where there are several blocks, the indexes of their shards are stored, each
    block is searched in these, and what blocks found is merged per row. Words are told apart by 64 bits. Null,
    empty and wordless texts have no words and no hits; null or wordless items and items without an id match nothing;
    ids may be of any type, and items with one id count once. Repeated document rows give repeated results; a null id
    stays null. Other columns are not read. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slim = _searched(texts, benchmark, window, shard_words, block_bytes, "text")
    return slim.select("row.doc_id", "n_words", "n_hit", "n_items", "items", "spans")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 1 << 19, block_bytes: int = 2 << 20, text_col: str = "text") -> DataFrame:
    """The documents with the text of every hit span cut out, from its first word's start to its last word's end.

    Columns stay as they are; documents without a hit keep their text to the byte. Rows are cut one by one, whatever
    their ids. Otherwise as decontaminate().
    """
    found = _searched(docs, benchmark, window, shard_words, block_bytes, text_col)
    out = {c: F.col("row").getField(c) for c in docs.columns}
    out[text_col] = F.coalesce(F.col("clean"), out[text_col])
    return found.select(*(v.alias(c) for c, v in out.items()))
