"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, and every segment is an index key. A query probes each segment with all values up to a
radius; a code whose distance is at most segments * (radius + 1) - 1 must lie within the radius in some segment. So the
radius grows, for the queries still open and one segment after the other as far as their kth verified distance needs,
until that distance is covered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumspark.llm.skew import join_counted
from vellumspark.llm.store import staged


def sign_segments(vector: Column, dims: int, width: int) -> Column:
    """Sign bits of a vector (1 where positive) as an array of segments of `width` bits."""

    def part(lo: int) -> Column:
        bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0)
        return F.aggregate(F.transform(F.slice(vector, lo + 1, min(width, dims - lo)), bit), F.lit(0), lambda s, x: s + x)

    return F.array(*(part(lo) for lo in range(0, dims, width)))


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def _masks(width: int, ones: int) -> list[int]:
    return [sum(1 << i for i in c) for c in combinations(range(width), ones)]


def _nearest(query: np.ndarray, d: np.ndarray, least: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` first pairs of every query by distance and least id."""
    order = np.lexsort((least, d, query))
    head = np.flatnonzero(np.diff(query[order], prepend=-1))
    turn = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return order[turn < most]


def _search(radius: int, width: int, low: int, most: int, at_once: int = 256):
    """Looks up, in packed blocks of the index, every value at `radius` from the segment of each query of a pack.

    A block holds codes whose segment starts with the same bits, so of the radius only what those bits leave is put
    on the `low` last ones. Codes that meet are verified in full, and a query keeps the `most` nearest of the block,
    which is all that its result can use.
    """
    masks = {r: np.array(_masks(low, r), np.int64) for r in range(min(radius, low) + 1)}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for seg, prefix, asked, held in zip(*(batch.column(k) for k in range(4))):
                seg = seg.as_py()
                wanted = asked.values.flatten().to_numpy().reshape(len(asked.values), -1)
                codes, least = held.values.field("code"), held.values.field("least").to_numpy()
                codes = codes.flatten().to_numpy().reshape(len(codes), -1)
                order = np.argsort(codes[:, seg], kind="stable")
                codes, least = codes[order], least[order]
                values, first, n = np.unique(codes[:, seg], return_index=True, return_counts=True)
                own = wanted[:, seg].astype(np.int64)
                left = radius - np.bitwise_count((own >> low) ^ prefix.as_py()).astype(np.int64)
                for at in range(0, len(own), at_once):
                    part = np.arange(at, min(at + at_once, len(own)))
                    query, value = [], []
                    for r in np.unique(left[part]):
                        some = part[left[part] == r]
                        # The bits before the low ones are the block's; the probes differ from the query in r low bits.
                        base = (own[some] & ((1 << low) - 1)) | (prefix.as_py() << low)
                        probe = base[:, None] ^ masks[r][None, :]
                        place = np.minimum(np.searchsorted(values, probe), len(values) - 1)
                        q, m = np.nonzero(values[place] == probe)
                        query.append(some[q])
                        value.append(place[q, m])
                    query, value = np.concatenate(query), np.concatenate(value)
                    if not len(query):
                        continue
                    size = n[value]
                    query = np.repeat(query, size)
                    code = np.repeat(first[value] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    d = np.bitwise_count(wanted[query] ^ codes[code]).sum(axis=1, dtype=np.int64)
                    kept = _nearest(query, d, least[code], most)
                    for column, x in zip(out, (wanted[query[kept]], codes[code[kept]], least[code[kept]], d[kept])):
                        column.append(x)
            lists = [[x for part in out[k] for x in part] for k in (0, 1)]
            flat = [np.concatenate(out[k]) if out[k] else np.empty(0, np.int64) for k in (2, 3)]
            arrays = [pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.int32())), pa.array(flat[0], pa.int64()), pa.array(flat[1].astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["q", "code", "least", "d"])

    return search


def hamming_topk(vectors: DataFrame, k: int = 10, every: int = 100, dims: int = 64, width: int | None = None, block: int = 512, pack: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For every row whose id divides by `every`, its k nearest other rows by Hamming distance of sign codes.

    Returns query_id, rank (from 1), neighbor_id and distance; ties go to the smaller id. All rows are indexed; equal
    codes are one index entry with their k + 1 smallest ids, which is all that a result can use. Segments are as wide as
    the logarithm of the number of rows, so that a probe meets about one code.

    The index of a segment is cut by the first bits of its value into blocks of about `block` codes, and by hash where
    more codes than that share them; open queries travel to the blocks they can reach, `pack` in a row, and probe there.

    Vectors that are null or not of `dims` entries have no code: they are not found and get no rows. A null or NaN entry
    is not above zero. Rows that repeat an id count once, with the smallest of their codes. Fewer than k others give
    fewer rows; an empty table none.
    """
    usable = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) == dims))
    clean = F.transform(F.col(vector_col), lambda x: F.when(x.isNull() | F.isnan(x), 0).otherwise(x))
    size = max(2, usable.count())
    if width is None:
        width = min(16, max(4, round(log2(size))))
    high = min(width, max(0, ceil(log2(size / block))))
    low = width - high
    coded = usable.select(F.col(id_col).cast("long").alias("id"), sign_segments(clean, dims, width).alias("code")).groupBy("id").agg(F.min("code").alias("code"))
    coded = staged(coded, "codes")
    first = Window.partitionBy("code").orderBy("id")
    ids = coded.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = staged(ids.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    segments = -(-dims // width)
    index = entries.select("code", F.col("ids")[0].alias("least"), F.posexplode("code").alias("seg", "value"))
    index = staged(index.select("code", "least", "seg", F.shiftright("value", low).alias("prefix")), "index")
    held = staged(index.groupBy("seg", "prefix").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("shards")), "held")
    dealt = join_counted(index, held, ["seg", "prefix"]).withColumn("shard", F.pmod(F.xxhash64("code"), F.col("shards")))
    blocks = staged(dealt.groupBy("seg", "prefix", "shard").agg(F.collect_list(F.struct("code", "least")).alias("entries")), "blocks")
    queries = coded.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    open_ = staged(queries, "queries")
    # Equal query codes are searched once. `need` says how many more segments have to be probed at the next radius.
    open_codes = staged(open_.select("q").distinct().withColumn("need", F.lit(segments)), "open")
    found, best = None, None
    for radius in range(width + 1):
        n_open = open_codes.count()
        if not n_open:
            break
        ways = [m for j in range(max(0, radius - low), min(high, radius) + 1) for m in _masks(high, j)]
        masks = F.split(F.lit(",".join(map(str, ways))), ",").cast("array<int>")
        visits = open_codes.select("q", "need", F.posexplode("q").alias("seg", "own")).where("seg < need")
        visits = visits.select("q", "seg", F.explode(F.transform(masks, lambda m: F.shiftright("own", low).bitwiseXOR(m))).alias("prefix"))
        parts = -(-n_open // pack)
        packs = visits.groupBy("seg", "prefix", F.pmod(F.xxhash64("q"), F.lit(parts)).alias("part")).agg(F.collect_list("q").alias("asked"))
        # Spark sees the packs as small as the queries they come from, so the join must not broadcast them.
        pairs = packs.hint("merge").join(blocks, ["seg", "prefix"]).select("seg", "prefix", "asked", "entries")
        hits = pairs.mapInArrow(_search(radius, width, low, k + 1), "q array<int>, code array<int>, least long, d int").distinct()
        pool = hits if best is None else best.join(open_codes, "q", "left_semi").union(hits).distinct()
        # Every code holds an id, and a query may meet itself: the k + 1 codes first by distance and least id are enough.
        near = Window.partitionBy("q").orderBy("d", "least")
        ranked = pool.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).drop("r")
        best = staged(ranked, f"radius{radius}")
        # Distance within which at least k other ids are known: sizes are capped at k + 1 by the entries.
        sized = best.join(entries, "code").select("q", "d", F.size("ids").alias("n"))
        upto = sized.withColumn("m", F.sum("n").over(Window.partitionBy("q").orderBy("d").rangeBetween(Window.unboundedPreceding, 0))).where(F.col("m") >= k + 1)
        kth = upto.groupBy("q").agg(F.min("d").alias("kth"))
        # With all segments at this radius and j of them at the next, distances up to segments * (radius + 1) - 1 + j are covered.
        before = segments * radius - 1
        state = staged(open_codes.join(kth, "q", "left").select("q", (F.col("kth") <= F.lit(before) + F.col("need")).alias("done"), F.least(F.lit(segments), F.coalesce(F.col("kth") - (before + segments), F.lit(segments))).alias("next")), "state")
        part = best.join(state.where("done") if radius < width else state, "q", "left_semi")
        found = part if found is None else found.union(part)
        open_codes = state.where("not coalesce(done, false)").select("q", F.col("next").alias("need"))
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, neighbor_id long, distance int")
    rows = open_.join(found, "q").join(entries, "code").select("query_id", "d", F.explode("ids").alias("neighbor_id")).where("neighbor_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("d", "neighbor_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", F.col("d").alias("distance"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS c FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
             list_sum(list_transform(range(1, 65), lambda i: xor(q.c[i], v.c[i])))::INT AS distance
      FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id))::INT AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""
