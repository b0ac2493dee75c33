"""Product codebooks by k-means over metric trees.

Vectors are cut into parts, and every block of vectors holds a tree of balls for each part, built middle-out: some
anchors are spread over the points, each takes the points nearest to it, anchors are merged upwards by the smallest
ball that holds both, and each is built further downwards. A ball caches the count and sum of its points. In a round a
ball inherits the entries that may be nearest to any of its points and drops those that another entry beats all over
the ball; when one is left, that entry owns the ball, and its cached count and sum are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.skew import join_counted
from vellumspark.llm.store import staged

# Components beyond this size (after scaling) count as it, so that squares of differences stay within a long.
LARGEST = 1 << 27
LEAF = 24


class Tree(NamedTuple):
    """Balls, parents before children: each has points start to stop in tree order, a centre, a radius, a sum and up to two children (-1: none)."""

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray


def _anchors(points: np.ndarray, some: np.ndarray) -> list[np.ndarray]:
    """Cuts the places `some` among about sqrt(n) anchors; a point moves to a new anchor that is nearer than its own."""
    wanted = max(2, int(len(some) ** 0.5))
    pivot = points[some[0]]
    far = ((points[some] - pivot) ** 2).sum(axis=1) ** 0.5
    order = np.argsort(-far, kind="stable")
    pivots, own, away = [pivot], [some[order]], [far[order]]
    while len(own) < wanted:
        widest = max(range(len(own)), key=lambda k: away[k][0] if len(away[k]) else 0.0)
        if not len(away[widest]) or away[widest][0] == 0:
            break
        new = points[own[widest][0]]
        taken, at = [], []
        for k, p in enumerate(pivots):
            # Points nearer to their anchor than half the way to the new one stay; the lists begin with the farthest.
            gap = ((p - new) ** 2).sum() ** 0.5 / 2
            n = int(np.searchsorted(-away[k], -gap, "right"))
            if not n:
                continue
            d = ((points[own[k][:n]] - new) ** 2).sum(axis=1) ** 0.5
            moves = d < away[k][:n]
            if moves.any():
                taken.append(own[k][:n][moves])
                at.append(d[moves])
                stay = np.append(~moves, np.ones(len(own[k]) - n, bool))
                own[k], away[k] = own[k][stay], away[k][stay]
        taken, at = np.concatenate(taken), np.concatenate(at)
        order = np.argsort(-at, kind="stable")
        pivots.append(new)
        own.append(taken[order])
        away.append(at[order])
    return [x for x in own if len(x)]


def build(points: np.ndarray) -> Tree:
    """The tree of a part of a block: integer points, one row or more."""
    exact, points = points, points.astype(np.float64)
    order, balls = [], []

    def merged(parts: list[np.ndarray]):
        """A nested pair tree of the anchors: the two whose common ball is smallest are merged first."""
        items: list = list(parts)
        mid = np.array([points[p].mean(axis=0) for p in parts])
        size = np.array([len(p) for p in parts], float)
        wide = np.array([((points[p] - m) ** 2).sum(axis=1).max() ** 0.5 for p, m in zip(parts, mid)])
        gone, a = np.zeros(len(parts), bool), 0
        # Radius of the ball around two balls.
        cost = (((mid[:, None] - mid[None]) ** 2).sum(axis=2) ** 0.5 + wide[:, None] + wide[None]) / 2
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(parts) - 1):
            a, b = np.unravel_index(int(cost.argmin()), cost.shape)
            items[a] = (items[a], items[b])
            wide[a] = cost[a, b]
            mid[a] = (mid[a] * size[a] + mid[b] * size[b]) / (size[a] + size[b])
            size[a] += size[b]
            gone[b] = True
            row = (((mid - mid[a]) ** 2).sum(axis=1) ** 0.5 + wide + wide[a]) / 2
            row[gone] = np.inf
            row[a] = np.inf
            cost[a], cost[:, a] = row, row
            cost[b], cost[:, b] = np.inf, np.inf
        return items[a]

    def put(item) -> int:
        """Writes a ball and what is below it; returns its number."""
        me, begin = len(balls), len(order)
        balls.append(None)
        kids = (-1, -1)
        if isinstance(item, np.ndarray) and len(item) > LEAF:
            parts = _anchors(points, item)
            if len(parts) > 1:
                item = merged(parts)
        if isinstance(item, tuple):
            kids = (put(item[0]), put(item[1]))
        else:
            order.extend(item.tolist())
        own = np.array(order[begin:])
        centre = points[own].mean(axis=0)
        radius = ((points[own] - centre) ** 2).sum(axis=1).max() ** 0.5
        balls[me] = (begin, len(order), *kids, centre, radius, exact[own].sum(axis=0))
        return me

    put(np.arange(len(points)))
    start, stop, left, right, centre, radius, total = zip(*balls)
    whole = [np.array(x, np.int32) for x in (order, start, stop, left, right)]
    return Tree(*whole, np.array(centre), np.array(radius), np.array(total, np.int64))


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of every point (in the block's order), and the count and sum of every entry's points.

    Distances that decide are whole numbers; ties go to the lower entry. A ball is given to an entry only where the others
    are farther by more than rounding.
    """
    label = np.empty(len(points), np.int64)
    count, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    # Of equal entries the first takes all.
    _, first = np.unique(entries, axis=0, return_index=True)
    rough = entries.astype(np.float64)
    points = points[tree.order]
    bound = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if bound < 1 << 22 else np.int64
    squares, typed, own = (entries.astype(kind) ** 2).sum(axis=1), entries.astype(kind), points.astype(kind)
    slack = 1e-9 * (1.0 + bound) ** 2 * entries.shape[1]
    stack = [(0, np.sort(first))]
    while stack:
        ball, some = stack.pop()
        lo, hi = tree.start[ball], tree.stop[ball]
        if len(some) > 1:
            d = ((rough[some] - tree.centre[ball]) ** 2).sum(axis=1)
            best = int(d.argmin())
            # All of the ball is on the best entry's side of the plane between the two if this holds.
            side = d - d[best] > 2 * tree.radius[ball] * ((rough[some] - rough[some[best]]) ** 2).sum(axis=1) ** 0.5 + slack
            some = some[~side]
        if len(some) == 1:
            label[lo:hi] = some[0]
            count[some[0]] += hi - lo
            total[some[0]] += tree.total[ball]
        elif tree.left[ball] >= 0:
            stack += [(tree.left[ball], some), (tree.right[ball], some)]
        else:
            # |p - e|^2 without |p|^2, which is the same for all entries.
            nearest = some[(squares[some] - 2 * (own[lo:hi] @ typed[some].T)).argmin(axis=1)]
            label[lo:hi] = nearest
            np.add.at(count, nearest, 1)
            np.add.at(total, nearest, points[lo:hi])
    out = np.empty(len(points), np.int64)
    out[tree.order] = label
    return out, count, total


TREE = "order array<int>, start array<int>, stop array<int>, left array<int>, right array<int>, centre array<double>, radius array<double>, total array<long>"
BLOCK = f"ids array<long>, labels array<string>, points array<array<int>>, trees array<struct<{TREE}>>"
TREE_TYPE = pa.struct([(f, pa.list_(t)) for f, t in zip(Tree._fields, [pa.int32()] * 5 + [pa.float64()] * 2 + [pa.int64()])])


def _blocks(dims: int, parts: int, scale: int, block: int):
    """Packs vectors of `dims` finite components, `block` in a row, with a tree for every part."""

    def packed(ids: list, labels: list, vectors: list[np.ndarray]) -> pa.RecordBatch:
        whole = np.stack(vectors)
        points = [np.ascontiguousarray(x) for x in np.split(whole, parts, axis=1)]
        trees = [{f: x.ravel() for f, x in zip(Tree._fields, build(p))} for p in points]
        arrays = [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([[p.ravel().astype(np.int32) for p in points]], pa.list_(pa.list_(pa.int32()))), pa.array([trees], pa.list_(TREE_TYPE))]
        return pa.RecordBatch.from_arrays(arrays, names=["ids", "labels", "points", "trees"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = [], [], []
        for batch in batches:
            for i, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                ids.append(i)
                labels.append(label)
                vectors.append(np.clip(np.floor(np.clip(x, -LARGEST, LARGEST) * scale), -LARGEST, LARGEST).astype(np.int64))
                if len(ids) == block:
                    yield packed(ids, labels, vectors)
                    ids, labels, vectors = [], [], []
        if ids:
            yield packed(ids, labels, vectors)

    return blocks


def _read(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.ListScalar, pa.ListScalar, list[np.ndarray], list[Tree]]]:
    names = batch.schema.names
    for row in range(batch.num_rows):
        ids, labels, points, trees = (batch.column(names.index(k))[row] for k in ("ids", "labels", "points", "trees"))
        points = [p.values.to_numpy().astype(np.int64).reshape(-1, width) for p in points]
        out = []
        for tree in trees:
            fields = {f: tree[f].values.to_numpy() for f in Tree._fields}
            out.append(Tree(**fields | {f: fields[f].reshape(-1, width) for f in ("centre", "total")}))
        yield ids, labels, points, out


def _sums(books: list[np.ndarray]):
    """Counts and sums of every entry over the blocks of a task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books[0].shape[1]
        counts, totals = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for _, _, points, trees in _read(batch, width):
                for p, book in enumerate(books):
                    _, c, t = assign(trees[p], points[p], book)
                    counts[p] += c
                    totals[p] += t
        rows = [(p, e, counts[p][e], totals[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
        part, entry, n, total = zip(*rows) if rows else ((), (), (), ())
        arrays = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", "total"])

    return sums


def _codes(books: list[np.ndarray]):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books[0].shape[1]
        for batch in batches:
            for ids, labels, points, trees in _read(batch, width):
                found = [assign(t, p, b)[0] for t, p, b in zip(trees, points, books)]
                error = sum(((p - b[e]) ** 2).sum(axis=1) for p, b, e in zip(points, books, found))
                code = pa.array(np.stack(found, axis=1).astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, code, pa.array(error)], names=["vec_id", "label", "entries", "error"])

    return codes


class Codes(NamedTuple):
    """rows: vec_id, label_key, entries (array of entry numbers by part), error; books: the final entries by part."""

    rows: DataFrame
    books: list[np.ndarray]


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label (as text) and vector of the rows whose vector is not null and holds neither nulls nor non-finite numbers."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), x.alias("vector"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.col("vector").isNotNull() & ~odd)


def compress(vectors: DataFrame, parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codes | None:
    """Codes of vectors by a codebook a part, learned by `rounds` of k-means in whole numbers.

    Components are floor(scale * x). A part's codebook begins as that part of the `size` smallest vec_ids (fewer where there
    are fewer rows; of rows that repeat an id, by vector). A round gives every part to its nearest entry (squared distance,
    ties to the lower) and makes every entry the componentwise floor of its parts' mean; entries without parts stay.

    Rows with null or non-finite components are dropped. The dimension is that of the smallest kept id that has at least
    `parts` components; rows of another are dropped too, and components after the last whole part are not used. Components
    beyond 2^27 after scaling count as 2^27. Rows that repeat an id each get a code and count as often as they are there; a
    null id comes after all others. Other columns are not read. No kept row gives None.

    Trees are built once, for blocks of `block` vectors of an input partition, without a shuffle; only counts and
    sums of entries, parts * size rows a task, meet. The codebooks, parts * size entries, are the only data on the driver.
    """
    kept = kept_vectors(vectors, id_col, vector_col, label_col).where(F.size("vector") >= parts)
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    head = kept.orderBy(*by_id).limit(1).select(F.size("vector")).first()
    if head is None:
        return None
    dims = head[0]
    kept = kept.where(F.size("vector") == dims)
    first = [r.vector for r in kept.orderBy(*by_id).limit(size).select("vector").collect()]
    width = dims // parts
    start = np.floor(np.clip(np.array(first), -LARGEST, LARGEST) * scale).clip(-LARGEST, LARGEST).astype(np.int64)
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    trimmed = kept.select("vec_id", "label", F.slice("vector", 1, width * parts).alias("vector"))
    blocks = staged(trimmed.mapInArrow(_blocks(dims, parts, scale, block), BLOCK), "trees")
    for _ in range(rounds):
        got = blocks.select("ids", "labels", "points", "trees").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
        cells = got.select("part", "entry", "n", *(F.col("total")[k].alias(f"t{k}") for k in range(width)))
        sums = cells.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"t{k}").alias(f"t{k}") for k in range(width)))
        books = [b.copy() for b in books]
        for r in sums.collect():
            books[r.part][r.entry] = [r[f"t{k}"] // r.n for k in range(width)]
    return Codes(blocks.mapInArrow(_codes(books), "vec_id long, label string, entries array<int>, error long"), books)


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (the errors of equal labels, nulls together) and codebooks_sha256.

    See compress for the rows that are kept and for all options; `size` may be 256 at most. No kept row gives no rows.
    """
    if options.get("size", 256) > 256:
        raise ValueError("a code has two hex digits a part: size may be 256 at most")
    found = compress(vectors, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    digits = F.array_join(F.transform("entries", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    # Labels get a letter before them, so that null is a key like any other.
    rows = staged(found.rows.select("vec_id", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("key"), digits.alias("code"), "error"), "codes")
    errors = staged(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "errors")
    out = join_counted(rows, errors, ["key"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(found.books)).alias("codebooks_sha256"))
