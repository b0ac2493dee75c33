import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vellumspark.llm import queries
from vellumspark.llm.periodic import find_runs, grammar, periodic_runs, reach


def plain_runs(w, least=24, times=3):
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                best.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone)


def odd_text(rng, symbols):
    w, most = [], rng.randint(0, 300)
    while len(w) < most:
        if rng.random() < 0.5:
            w += [rng.randrange(symbols) for _ in range(rng.randint(1, 30))]
        else:
            p = [rng.randrange(symbols) for _ in range(rng.randint(1, 25))]
            n = rng.randint(1, 120)
            w += (p * (n // len(p) + 1))[:n]
    return w


def test_grammar_tells_how_far_places_agree():
    rng = random.Random(8)
    for symbols in (1, 2, 3, 40):
        w = [100] + odd_text(rng, symbols) + odd_text(rng, symbols) + [101]
        levels = grammar(np.array(w))
        mirrored = [x.mirrored() for x in levels]
        pairs = [sorted(rng.sample(range(1, len(w)), 2)) for _ in range(200)] if len(w) > 3 else []
        x, y = (np.array(v, np.int64) for v in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
        for (i, j), at, back in zip(pairs, reach(levels, x, y), reach(mirrored, len(w) - y, len(w) - x)):
            k = 0
            while w[i + k] == w[j + k]:
                k += 1
            assert at == i + k
            k = 0
            while w[i - 1 - k] == w[j - 1 - k]:
                k += 1
            assert back == len(w) - j + k
        # Every level keeps what the symbols stand for: as many of the next as their parents say.
        assert all(len(a.first) - 1 == len(b.symbols) for a, b in zip(levels, levels[1:]))


def test_runs_equal_the_plain_ones():
    rng = random.Random(1)
    for _ in range(150):
        texts = [odd_text(rng, rng.choice((1, 2, 2, 3, 50))) for _ in range(rng.randint(1, 5))]
        for least, times in ((24, 3), (4, 2), (10, 3)):
            got = find_runs([np.array(t, np.int64) for t in texts], least, times, at_once=rng.choice((50, 1000, 500_000)))
            assert [[tuple(x) for x in g.tolist()] for g in got] == [plain_runs(t, least, times) for t in texts]
    with pytest.raises(ValueError):
        find_runs([], times=1)


def contract(doc_id, text):
    w = brute.WORD.findall((text or "").encode())
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(plain_collapsed(w, runs)))


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect())
    want = sorted(contract(r.doc_id, r.text) for r in rows)
    assert got == want and sum(r[1] for r in got) > 0


def test_edges(spark):
    again = "x y z " * 20
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, again), (4, again), (None, again), (5, "a " * 30 + "b " * 30), (6, "q " * 100_000), (7, "Ünï 🙂 " * 12), (8, "one two " * 11 + "one"), (9, "x " * 24), (10, "x " * 23)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("runs", "n_words", "longest", "collapsed", "words"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = periodic_runs(frame, chunk_words=50).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        w = (text or "").encode().split()
        want = plain_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(w)
        assert r.collapsed == plain_collapsed(w, want).decode()
        assert (r.longest is None) == (not want)
    assert periodic_runs(frame.limit(0)).count() == 0
