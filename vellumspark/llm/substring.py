"""Exact substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Documents are packed into chunks, stored once. Each chunk sends the distinct hashes of its windows, packed by hash bucket,
so that a window common to a third of all documents is one entry a chunk. A bucket answers with one bit an entry: whether
another chunk has it too. Only windows of which that is so are sent again, now with two hashes of 64 bits and their
smallest document, and the second answer says whether a smaller document elsewhere has the window. Chunks then mark the
covered words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.store import staged
from vellumspark.llm.wordhash import WORDS, rolling

# Fixed value: the odd multiplier of the second hash.
SECOND = np.uint64(0xD6E8FEB86659FD93)
NO_ID = np.iinfo(np.int64).max
CHUNKS = "chunk long, n_bytes long, ids binary, lengths binary, texts binary"
RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"


def _pack(chunk_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        rows: list[tuple[int, bytes]] = []
        held = 0

        def chunk() -> pa.RecordBatch:
            nonlocal seq, rows, held
            rows.sort(key=lambda r: r[0])
            texts = [t for _, t in rows]
            arrays = [[part << 32 | seq], [held], [np.array([i for i, _ in rows], np.int64).tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()], [zstandard.compress(b"".join(texts), 3)]]
            seq, rows, held = seq + 1, [], 0
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names=["chunk", "n_bytes", "ids", "lengths", "texts"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (text.as_py() or "").encode()
                rows.append((NO_ID if i is None else i, text))
                held += len(text)
                if held >= chunk_bytes or len(rows) >= 50_000:
                    yield chunk()
        if rows:
            yield chunk()

    return pack


class _Chunk:
    """Words of a chunk's documents, and each distinct window hash with its smallest document."""

    def __init__(self, row: dict, size: int, short_bits: int):
        self.id = row["chunk"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        raw, at = zstandard.decompress(row["texts"]), 0
        self.words: list[list[bytes]] = []
        for n in np.frombuffer(row["lengths"], np.int64):
            self.words.append(raw[at : at + n].split())
            at += n
        self.short_bits = short_bits
        self.doc = np.repeat(np.arange(len(self.ids)), [len(w) for w in self.words])
        self.h = np.concatenate([WORDS.of(w) for w in self.words]) if self.words else np.empty(0, np.uint64)
        values = rolling(self.h, size)
        self.starts = np.flatnonzero(self.doc[: len(values)] == self.doc[size - 1 :]) if len(values) else np.empty(0, np.int64)
        self.values = values[self.starts]
        self.home = self.doc[self.starts]
        self.short, self.head, self.of_window = np.unique(self.values >> np.uint64(64 - short_bits), return_index=True, return_inverse=True)

    def shared(self, answers: list[dict], bits: int) -> np.ndarray:
        """For every short hash whether another chunk has it."""
        out = np.zeros(len(self.short), bool)
        buckets = _Buckets(self.short, bits, self.short_bits)
        for got in answers or []:
            lo, hi = buckets.run(got["bucket"])
            out[lo:hi] = np.unpackbits(np.frombuffer(got["bits"], np.uint8), count=hi - lo).astype(bool)
        return out

    def candidates(self, answers: list[dict], bits: int, size: int) -> "_Candidates":
        """Windows that another chunk may have, or another document of this chunk."""
        shared = self.shared(answers, bits)[self.of_window]
        # Windows are in document order: the first of equal ones has the smallest document, the last one written the largest.
        low, high = self.home[self.head], np.empty(len(self.short), np.int64)
        high[self.of_window] = self.home
        at = np.flatnonzero(shared | (low != high)[self.of_window])
        return _Candidates(self.starts[at], self.home[at], self.values[at], _second(self.h, self.starts[at], size), shared[at])


def _second(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Another Rabin-Karp value of the windows at the given starts, from mixed word hashes and another base."""
    mixed = (h ^ (h >> np.uint64(31))) * SECOND
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(len(starts), np.uint64)
    for j in range(size):
        out *= SECOND
        out += mixed[starts + j]
    return out


class _Candidates:
    """Windows of a chunk by both hashes: the distinct ones in order, and the smallest document of each."""

    def __init__(self, starts: np.ndarray, home: np.ndarray, first: np.ndarray, second: np.ndarray, shared: np.ndarray):
        self.starts, self.home = starts, home
        order = np.argsort(first, kind="stable")
        a, b = first[order], second[order]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
            order = np.lexsort((home, second, first))
            a, b = first[order], second[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(order)]
        self.of_window = np.empty(len(order), np.int64)
        self.of_window[order] = np.cumsum(new) - 1
        heads = order[new]
        self.first, self.second, self.least, self.shared = first[heads], second[heads], home[heads], shared[heads]


class _Buckets:
    """Runs of sorted hashes of `wide` bits that start with the same `bits`."""

    def __init__(self, hashes: np.ndarray, bits: int, wide: int):
        self.of = hashes >> np.uint64(wide - bits)

    def runs(self) -> list[tuple[int, int, int]]:
        """(bucket, start, end) of all that are not empty."""
        ids, starts, n = np.unique(self.of, return_index=True, return_counts=True)
        return list(zip(ids.tolist(), starts.tolist(), (starts + n).tolist()))

    def run(self, bucket: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.of, np.array([bucket], np.uint64), side)[0] for side in ("left", "right"))


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, so that leading zeros compress."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _gaps(sorted_numbers: np.ndarray) -> np.ndarray:
    return np.diff(sorted_numbers, prepend=sorted_numbers.dtype.type(0))


def _columns(out: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def _send_short(size: int, bits: int, short_bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk(row, size, short_bits)
                runs = _Buckets(c.short, bits, short_bits).runs()
                packed = [_packed(_gaps(c.short[lo:hi])) for _, lo, hi in runs]
                if runs:
                    yield _columns([[b for b, _, _ in runs], [c.id] * len(runs), packed], [pa.int64(), pa.int64(), pa.binary()], ["bucket", "chunk", "hashes"])

    return send


def _answers(rows: pa.Table, flag: np.ndarray, sizes: list[int]) -> pa.Table:
    out: list[list] = [[], [], []]
    at = 0
    for chunk, bucket, n in zip(rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), sizes):
        if flag[at : at + n].any():
            for column, v in zip(out, (chunk, bucket, np.packbits(flag[at : at + n]).tobytes())):
                column.append(v)
        at += n
    return pa.table({"chunk": pa.array(out[0], pa.int64()), "bucket": pa.array(out[1], pa.int64()), "bits": pa.array(out[2], pa.binary())})


def _answer_short(rows: pa.Table) -> pa.Table:
    """One bit for every hash of every chunk of a bucket: whether another chunk has it."""
    hashes = [np.cumsum(_unpacked(x)) for x in rows["hashes"].to_pylist()]
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    same = flat[order][1:] == flat[order][:-1]
    flag = np.empty(len(flat), bool)
    flag[order] = np.append(same, False) | np.append(False, same)
    return _answers(rows, flag, [len(h) for h in hashes])


def _send_full(size: int, bits: int, short_bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, size, short_bits)
                c = chunk.candidates(row["answers"], bits, size)
                out: list[list] = [[], [], [], [], []]
                for b, lo, hi in _Buckets(c.first, bits, 64).runs():
                    at = np.arange(lo, hi)[c.shared[lo:hi]]
                    if len(at):
                        for column, v in zip(out, (b, chunk.id, _packed(_gaps(c.first[at])), c.second[at].tobytes(), zstandard.compress(chunk.ids[c.least[at]].tobytes(), 1))):
                            column.append(v)
                if out[0]:
                    yield _columns(out, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["bucket", "chunk", "hashes", "second", "docs"])

    return send


def _answer_full(rows: pa.Table) -> pa.Table:
    """One bit for every window of every chunk of a bucket: whether a smaller document elsewhere has it."""
    firsts = [np.cumsum(_unpacked(x)) for x in rows["hashes"].to_pylist()]
    first = np.concatenate(firsts)
    second = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["second"].to_pylist()])
    doc = np.concatenate([np.frombuffer(zstandard.decompress(x), np.int64) for x in rows["docs"].to_pylist()])
    order = np.lexsort((second, first))
    a, b, d = first[order], second[order], doc[order]
    heads = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    least = np.repeat(np.minimum.reduceat(d, heads), np.diff(np.append(heads, len(d))))
    flag = np.empty(len(d), bool)
    flag[order] = d > least
    return _answers(rows, flag, [len(h) for h in firsts])


def _mark(size: int, bits: int, short_bits: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, size, short_bits)
                c = chunk.candidates(row["answers"], bits, size)
                elsewhere = np.zeros(len(c.first), bool)
                buckets = _Buckets(c.first, bits, 64)
                for got in row["full"] or []:
                    lo, hi = buckets.run(got["bucket"])
                    at = np.arange(lo, hi)[c.shared[lo:hi]]
                    elsewhere[at] = np.unpackbits(np.frombuffer(got["bits"], np.uint8), count=len(at)).astype(bool)
                own = chunk.ids[c.home]
                gone = (elsewhere[c.of_window] | (own > chunk.ids[c.least][c.of_window])) & (own != NO_ID)
                step = np.zeros(len(chunk.doc) + 1, np.int32)
                np.add.at(step, c.starts[gone], 1)
                np.add.at(step, c.starts[gone] + size, -1)
                covered = np.cumsum(step)[:-1] > 0
                out: list[list] = [[], [], [], [], []]
                at = 0
                for k, words in enumerate(chunk.words):
                    cut = covered[at : at + len(words)]
                    at += len(words)
                    n = int(cut.sum())
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8))) if n else []
                    out[0].append(None if chunk.ids[k] == NO_ID else int(chunk.ids[k]))
                    out[1].append(len(words))
                    out[2].append(n)
                    out[3].append((b" ".join(compress(words, ~cut)) if n else b" ".join(words)).decode())
                    out[4].append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield _columns(out, [pa.int64(), pa.int64(), pa.int64(), pa.string(), spans], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return mark


def substring_dedup(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, bucket_entries: int = 1 << 20, short_bits: int = 48) -> DataFrame:
    """Removes every word covered by a window of `size` words that also starts in a document with a smaller id.

    Words are the runs between ASCII white space, unchanged. Returns doc_id, n_words, n_removed, kept (the words left,
    joined by one space) and spans (maximal removed word intervals, end exclusive); windows are judged on the input.

    Null and empty texts have no words; a text shorter than a window loses nothing. Rows that share an id are one
    document to each other: neither is smaller. A null id is never smaller and loses nothing. Other columns are not
    read. An empty table gives no rows. Words are told apart by 64 bits, windows by 128: two different ones among n of
    different words meet with odds n^2 / 2^129.

    chunk_bytes bounds a task's memory and bucket_entries a bucket's; on very large inputs raise both together, so that
    packed rows stay long. short_bits is how much of a hash the first round compares; it only has to leave few windows for
    the second, which compares all 128 bits.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = staged(rows.mapInArrow(_pack(chunk_bytes), CHUNKS), "chunks")
    windows = (chunks.agg(F.sum("n_bytes")).first()[0] or 0) / 6  # about as many as words
    bits = min(short_bits, max(6, int(np.ceil(np.log2(max(1, windows / bucket_entries))))))
    by_chunk = lambda answers, name: answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))
    short = chunks.mapInArrow(_send_short(size, bits, short_bits), "bucket long, chunk long, hashes binary")
    shared = by_chunk(short.groupBy("bucket").applyInArrow(_answer_short, "chunk long, bucket long, bits binary"), "answers")
    known = chunks.join(staged(shared, "shared"), "chunk", "left")
    full = known.mapInArrow(_send_full(size, bits, short_bits), "bucket long, chunk long, hashes binary, second binary, docs binary")
    smaller = by_chunk(full.groupBy("bucket").applyInArrow(_answer_full, "chunk long, bucket long, bits binary"), "full")
    return known.join(smaller, "chunk", "left").mapInArrow(_mark(size, bits, short_bits), RESULT)
