import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import brute
from vellumspark.llm import queries
from vellumspark.llm.golay import codewords, fuzzy_classes, fuzzy_keys, print_links, simhash


def plain_print(text, size=4):
    words = brute.WORD.findall(brute.lower(text).encode())
    if not words:
        return 0
    k = min(size, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[j : j + k]), 42) for j in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints, most=4):
    """Smallest place that near prints lead to, for every print of a list."""
    seen, out = np.zeros(len(prints), bool), [0] * len(prints)
    values = np.array(prints, np.uint64)
    for k in range(len(prints)):
        if seen[k]:
            continue
        front = [k]
        seen[k] = True
        while front:
            j = front.pop()
            out[j] = k
            near = np.flatnonzero((np.bitwise_count(values ^ values[j]) <= most) & ~seen)
            seen[near] = True
            front += near.tolist()
    return out


def plain_components(rows, most=4):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    return [(i, f"{p:016x}", rows[c][0]) for (i, p), c in zip(rows, plain_classes([p for _, p in rows], most))]


def test_codewords_are_those_within_four_bits():
    rng = np.random.default_rng(4)
    # The codeword with given high bits is the only multiple of the generator that has them.
    values = rng.integers(0, 1 << 23, 300)
    near = codewords(values)
    table = {}
    for number in range(4096):
        v = number << 11
        r = v
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= 0b101011100011 << (k - 11)
        table[number] = v ^ r
    assert min(bin(a).count("1") for a in table.values() if a) == 7
    for v, found in zip(values.tolist(), near.tolist()):
        d = {n: bin(v ^ w).count("1") for n, w in table.items()}
        assert set(found) == {n for n, x in d.items() if x <= 4} and d[found[0]] == min(d.values()) <= 3


@pytest.mark.parametrize("third", (False, True))
def test_prints_within_four_bits_share_a_key(third):
    rng = random.Random(5)
    a = [rng.getrandbits(64) for _ in range(4000)]
    b = [x ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for x in a]
    x, y = (fuzzy_keys(np.array(v, np.uint64), third) for v in (a, b))
    assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist()))


def test_simhash_is_the_plain_one():
    for text in (None, "", " \n", "One", "one two three", "a b c d", "A b C d e " * 500, "ünï 中文 🙂 x y z", "\x1f \x0b\x0c q\x00r"):
        assert simhash(text) == plain_print(text)


def test_links_join_all_classes_in_crowded_keys(spark):
    """Prints around a few centres: keys hold hundreds, tiles of eight, with and without the third segment."""
    rng = random.Random(6)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << k for k in rng.sample(range(64), rng.choice((0, 1, 3, 6, 9)))) for _ in range(150)}
    # Half of the bits agree in all of these, so that they share keys without being near.
    prints |= {0xABCDEF12 | rng.getrandbits(20) << 44 for _ in range(200)}
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(300)} | {0, 1, 2**64 - 1})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    want = plain_classes(prints)
    for tile, third in ((8, False), (1024, True), (64, None)):
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in print_links(frame, tile=tile, third=third).collect()]
        up = {p: p for p in prints}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        assert [find(p) for p in prints] == [prints[c] for c in want]
    with pytest.raises(ValueError):
        print_links(frame, most=5)


def test_whole_table_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in queries.op11_fuzzy_hashing(spark, sf).collect()]
    assert sorted(got) == sorted(plain_components(rows))
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    edge = [(9, None), (3, ""), (4, " \t\n"), (5, "one"), (6, "ONE"), (7, long), (8, long + " tail"), (8, long), (2, "a b c d e f"), (None, "a b c d e f"), (None, "nothing like it at all here")]
    frame = spark.createDataFrame(edge, "doc_id long, text string")
    for name in ("print", "class", "n", "component_id", "fingerprint", "key"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in fuzzy_classes(frame).collect()]
    want = plain_components([(i, plain_print(t)) for i, t in edge])
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert fuzzy_classes(frame.limit(0)).count() == 0
