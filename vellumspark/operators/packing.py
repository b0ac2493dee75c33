"""Greedy ordered packing of groups of any size.

Each chunk's start depends on the one before, but where a chunk that starts at a row ends does not: it is found by search in
prefix sums. So rows are dealt by ranges of their order, every range works out where each entering sum would lead, one row a
range is passed on in order, and each range then numbers its chunks from its true entering state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.staging import staged

SUMMARY = "range int, first string, last string, sums array<long>, exits array<long>, counts array<long>, empty_exit long, empty_count long, total long"


@dataclass
class Segment:
    """The rows of one group in one range, in order."""

    range: int
    key: tuple
    pieces: list[pa.RecordBatch]
    entering: int
    chunk: int

    def starts(self, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of the weights, and for every row the row that starts the next chunk if this one starts one."""
        weights = np.concatenate([np.array([int(w or 0) for w in p.column(p.num_columns - 1).to_pylist()], np.int64) for p in self.pieces])
        sums = np.cumsum(weights)
        before = sums - weights
        over = np.searchsorted(sums, before + budget, side="right")
        # A row that is too large stands alone, but for empty rows ahead of it.
        alone = np.append(before, -1)[over] == before
        return sums, over + alone

    def first_start(self, sums: np.ndarray, after: np.ndarray, budget: int) -> int:
        return int(np.searchsorted(sums, budget - self.entering, side="right")) if self.entering > 0 else int(after[0])


def _segments(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[Segment]:
    """Columns are the range, its entering sum and chunk, the keys, the order and the weight; rows come sorted by them."""
    open_: Segment | None = None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), *(batch.column(3 + k).to_pylist() for k in range(n_keys))))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            piece = batch.slice(at, end - at)
            if open_ is None or (open_.range, *open_.key) != keys[at]:
                if open_ is not None:
                    yield open_
                # Only the first group of a range may go on from the range before.
                goes_on = open_ is None or open_.range != keys[at][0]
                state = (batch.column(1)[at].as_py(), batch.column(2)[at].as_py()) if goes_on else (0, 0)
                open_ = Segment(keys[at][0], keys[at][1:], [], *state)
            open_.pieces.append(piece)
            at = end
    if open_ is not None:
        yield open_


def _summed(n_keys: int, budget: int):
    """One row a range: where every entering sum leads if it is all one group, else what its last group ends with."""

    def row(first: Segment, last: Segment) -> dict:
        sums, after = last.starts(budget)
        n = len(sums)
        exits, counts = [0] * n, [0] * n
        below, total = (sums - np.diff(sums, prepend=0)).tolist(), int(sums[-1])
        for i in range(n - 1, -1, -1):
            j = int(after[i])
            exits[i], counts[i] = (exits[j], counts[j] + 1) if j < n else (total - below[i], 0)
        j = int(after[0])
        empty = (exits[j], counts[j] + 1) if j < n else (total, 0)
        # A chunk that was open before can only end where the sums pass the budget: no more places than the budget is large.
        distinct, at = np.unique(sums[: int(np.searchsorted(sums, budget, side="right")) + 1], return_index=True)
        if first is not last:
            distinct, at = distinct[:0], at[:0]
        return {
            "range": first.range, "first": repr(first.key), "last": repr(last.key), "sums": distinct.tolist(), "exits": [exits[k] for k in at], "counts": [counts[k] for k in at],
            "empty_exit": empty[0], "empty_count": empty[1], "total": total,
        }

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        longs = pa.list_(pa.int64())
        kinds = pa.schema([("range", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("sums", longs), ("exits", longs), ("counts", longs), ("empty_exit", pa.int64()), ("empty_count", pa.int64()), ("total", pa.int64())])
        for s in _segments(batches, n_keys):
            if first is None or s.range != first.range:
                if first is not None:
                    yield pa.RecordBatch.from_pylist([row(first, last)], kinds)
                first = s
            last = s
        if first is not None:
            yield pa.RecordBatch.from_pylist([row(first, last)], kinds)

    return summed


def _passed_on(budget: int):
    """The state every range is entered with: range, entering (sum of the open chunk), chunk (its number)."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, chunk = None, 0, 0
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for r in batch.to_pylist():
                if r["first"] != group:
                    total = chunk = 0
                out.append((r["range"], total, chunk))
                if r["first"] != r["last"]:
                    total, chunk = r["empty_exit"], r["empty_count"]
                elif total == 0:
                    total, chunk = r["empty_exit"], chunk + r["empty_count"]
                else:
                    k = int(np.searchsorted(np.array(r["sums"], np.int64), budget - total, side="right"))
                    total, chunk = (r["exits"][k], chunk + 1 + r["counts"][k]) if k < len(r["sums"]) else (total + r["total"], chunk)
                group = r["last"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))] if out else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64())], names=["_range", "_entering", "_begun"])

    return passed


def _numbered(by: list[str], order: str, budget: int):
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _segments(batches, len(by)):
            sums, after = s.starts(budget)
            starts = np.zeros(len(sums), np.int32)
            i = s.first_start(sums, after, budget)
            while i < len(starts):
                starts[i] = 1
                i = int(after[i])
            chunks, at = s.chunk + np.cumsum(starts), 0
            for p in s.pieces:
                columns = [p.column(3 + k) for k in range(len(by) + 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(chunks[at : at + p.num_rows].astype(np.int32))], names=[*by, order, "chunk"])
                at += p.num_rows

    return numbered


def chunk_by_budget(rows: DataFrame, by: list[str], order: str, weight: str, budget: int, ranges: int | None = None) -> DataFrame:
    """Greedy ordered packing: a new chunk starts when the sum would pass the budget; too large a row stands alone.

    Returns the columns of `by`, the order and chunk, from 0 in every group. Weights are whole numbers of at least 0, null
    counts as 0. A group of any size spans as many tasks as its rows need: a task holds the weights of one range of the order
    (`ranges` in all, as many as shuffle partitions if not given). What meets in one task is a row a range, with no more
    numbers than the budget is large.
    """
    columns = [F.col(c) for c in (*by, order, weight)]
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The weight tells rows of equal order apart, so that both passes see one order.
    dealt = staged(rows.select(*columns).repartitionByRange(n, *columns).withColumn("_range", F.spark_partition_id()), "ranges")
    sort = ["_range", *columns]
    ordered = lambda df: df.repartition("_range").sortWithinPartitions(*sort).select("_range", "_entering", "_begun", *columns)
    blank = dealt.withColumn("_entering", F.lit(0).cast("long")).withColumn("_begun", F.lit(0).cast("long"))
    summary = ordered(blank).mapInArrow(_summed(len(by), budget), SUMMARY)
    state = summary.repartition(1).sortWithinPartitions("range").mapInArrow(_passed_on(budget), "_range int, _entering long, _begun long")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*by, order])
    # One row a range is broadcast.
    return ordered(dealt.join(F.broadcast(state), "_range")).mapInArrow(_numbered(by, order, budget), f"{kinds}, chunk int")
