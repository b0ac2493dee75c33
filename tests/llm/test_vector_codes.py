import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from vellumspark.llm import queries
from vellumspark.llm.metrictree import assign, build, vector_codes


def plain(rows, parts=4, size=256, rounds=4, scale=1024):
    """rows: (vec_id, vector, label). The same codes by comparing everything in Python's whole numbers."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) >= parts]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    width = len(good[0][1]) // parts
    points = [[math.floor(scale * x) for x in r[1]] for r in good]
    cut = [[p[k * width : (k + 1) * width] for p in points] for k in range(parts)]
    books = [c[:size] for c in cut]

    def nearest(p, book):
        return min((sum((x - y) ** 2 for x, y in zip(p, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            groups = {}
            for p in cut[k]:
                groups.setdefault(nearest(p, books[k])[1], []).append(p)
            books[k] = [[sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[k])]
    found = [[nearest(cut[k][j], books[k]) for k in range(parts)] for j in range(len(good))]
    total = {}
    for r, f in zip(good, found):
        total[r[2]] = total.get(r[2], 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), total[r[2]], sha) for r, f in zip(good, found)]


def results(frame):
    return [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in frame.collect()]


def order(r):
    return (r[0] is None, r[0] or 0, r[1])


def test_balls_give_what_comparing_all_gives():
    rng = np.random.default_rng(0)
    for trial in range(120):
        n, k, w = rng.integers(1, 300), rng.integers(1, 40), rng.integers(1, 8)
        top = int(rng.choice([2, 5, 1000, 1 << 27]))
        points = rng.integers(-top, top + 1, (n, w))
        if trial % 3 == 0:
            points = points[rng.integers(0, min(n, 5), n)]
        book = points[rng.integers(0, n, k)] if trial % 2 else rng.integers(-top, top + 1, (k, w))
        tree = build(points)
        label, count, total = assign(tree, points, book)
        assert sorted(tree.order.tolist()) == list(range(n))
        assert (label == ((points[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
        assert (count == np.bincount(label, minlength=k)).all()
        assert all((total[e] == points[label == e].sum(axis=0)).all() for e in range(k))


def test_whole_table(spark, sf):
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(results(queries.op12_vector_codes(spark, sf)), key=order) == sorted(plain(rows), key=order)


def test_edges(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((-1.5, -0.25, 0.0, 0.3, 2.0)) for _ in range(9)], rng.choice((None, 1, 2))) for i in range(60)]
    rows += [(5, [0.1] * 9, 7), (5, [0.1] * 9, 7), (None, [0.2] * 9, None), (70, None, 1), (71, [None] + [0.0] * 8, 1), (72, [math.nan] * 9, 1), (73, [math.inf] + [0.0] * 8, 1), (-4, [1.0, 2.0], 1), (-3, [], 1), (74, [1.0] * 8, 1), (-9, [1e3] * 9, 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for name in ("key", "n", "error", "code", "part", "vector", "ids"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = results(vector_codes(frame, size=8, block=16))
    want = plain([r for r in rows if r[1] is None or len(r[1]) == 9], size=8)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert vector_codes(frame.limit(0)).count() == 0 and vector_codes(frame.where("vec_id in (70, 72)")).count() == 0
    # What no long could hold counts as the bound.
    huge = spark.createDataFrame([(1, [3e38] * 4, 1), (2, [-1e300] * 4, 1), (3, [0.0] * 4, None)], "vec_id long, embedding array<double>, label int")
    assert sorted(r[2] for r in results(vector_codes(huge, size=1, rounds=0))) == [0, 4 << 54, 4 << 56]
