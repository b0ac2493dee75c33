"""SimHash near-duplicate classes by Golay-code fuzzy hashing.

The binary Golay code has 4096 codewords of 23 bits, and every 23-bit value lies within three bits of exactly one. Two
values within one bit or two of each other therefore share a codeword within four bits of both; a value has one such
codeword (its nearest) or six. A fingerprint is cut into three segments of at most 23 bits, and the numbers of nearby
codewords are its fuzzy keys. Of two fingerprints within four bits, either one segment agrees and another differs in at
most two bits, or two segments differ in at most one bit each; each of these cases has its keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.components import components
from vellumspark.llm.skew import join_counted
from vellumspark.llm.store import staged
from vellumspark.llm.wordhash import LOWER

MOST = 4
# Segments of a fingerprint: lowest bit and width. The generator polynomial of the Golay code is a fixed value.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Check value of every low and high half of a 23-bit value; and for every check value the error patterns of up to four
    bits that have it, the lightest first, short lists filled up with it."""

    def check(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= GENERATOR << (k - 11)
        return v

    of_bit = [check(1 << k) for k in range(23)]
    halves = np.zeros((2, 4096), np.int64)
    for k, c in enumerate(of_bit):
        part, at = divmod(k, 12)
        halves[part, np.arange(4096) >> at & 1 == 1] ^= c
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            c = 0
            for b in bits:
                c ^= of_bit[b]
            patterns[c].append(sum(1 << b for b in bits))
    return halves, np.array([p + p[:1] * (6 - len(p)) for p in patterns], np.int64)


def codewords(values: np.ndarray) -> np.ndarray:
    """Numbers of the six codewords within four bits of each 23-bit value, the nearest first; where only the nearest is, it six times."""
    halves, patterns = _tables()
    c = halves[0, values & 4095] ^ halves[1, values >> 12]
    return (values[:, None] ^ patterns[c]) >> 11


def fuzzy_keys(prints: np.ndarray, third: bool) -> np.ndarray:
    """Keys of fingerprints, a row each; fingerprints within four bits share one at least. Keys of a row may repeat.

    With `third`, the case of two segments with an error each also takes the third segment, which then has two errors at
    most: more keys, each met by fewer fingerprints.
    """
    values = [(prints >> np.uint64(lo) & np.uint64((1 << width) - 1)).astype(np.int64) for lo, width in SEGMENTS]
    near = [codewords(v) for v in values]
    case, out = 0, []

    def add(*parts: tuple[np.ndarray, int]) -> None:
        nonlocal case
        key = np.zeros((len(prints), 1), np.int64)
        for part, width in parts:
            key = ((key << width)[:, :, None] | part[:, None, :]).reshape(len(prints), -1)
        out.append(key | case << 36)
        case += 1

    for a, b in permutations(range(3), 2):
        add((values[a][:, None], 22), (near[b], 12))
    for a, b in combinations(range(3), 2):
        rest = ((near[3 - a - b], 12),) if third else ()
        # One bit apart: the nearest codeword of either is among the six of the other. Both orders have the same case number.
        add((near[a][:, :1], 12), (near[b], 12), *rest)
        case -= 1
        add((near[a], 12), (near[b][:, :1], 12), *rest)
    return np.concatenate(out, axis=1)


def simhash(text: str | None, shingle: int = 4) -> int:
    """64 majority bits of the XXH64 (seed 42) of the word shingles, repeats included; 0 without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[: len(words) - k] + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts.tolist(), ends[k - 1 :].tolist())), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(h[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def _prints(shingle: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return prints


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and print, the fingerprint as a long, of every row."""
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return whole.mapInArrow(_prints(shingle), "doc_id long, print long")


def _keyed(third: bool, at_once: int = 4096):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy()
            for at in range(0, len(prints), at_once):
                some = prints[at : at + at_once]
                keys = np.sort(fuzzy_keys(some.view(np.uint64), third), axis=1)
                new = np.ones(keys.shape, bool)
                new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(np.repeat(some, new.sum(axis=1)))], names=["key", "print"])

    return keyed


def _spanning(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join those of the fingerprints that a chain of near ones joins: each to the first of its class."""
    n = len(prints)
    label, waiting = np.full(n, -1), np.ones(n, bool)
    for k in range(n):
        if not waiting[k]:
            continue
        # All that a chain reaches from k, the frontier taken in pieces.
        waiting[k], label[k], front = False, k, np.array([k])
        while len(front):
            rest = np.flatnonzero(waiting)
            met = np.zeros(len(rest), bool)
            for at in range(0, len(front), 256):
                met |= (np.bitwise_count(prints[rest][:, None] ^ prints[front[at : at + 256]][None, :]) <= most).any(axis=1)
            front = rest[met]
            label[front], waiting[front] = k, False
    moved = np.flatnonzero(label != np.arange(n))
    return prints[label[moved]], prints[moved]


def _linked(most: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, edge = lists.values.to_numpy(), lists.offsets.to_numpy()
            flat = flat.view(np.uint64)
            size = np.diff(edge)
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for s in np.unique(size[size > 1]):
                rows = edge[:-1][size == s]
                if s > 8:
                    for at in rows:
                        x, y = _spanning(flat[at : at + s], most)
                        a.append(x)
                        b.append(y)
                    continue
                for i, j in combinations(range(s), 2):
                    x, y = flat[rows + i], flat[rows + j]
                    near = np.bitwise_count(x ^ y) <= most
                    a.append(x[near])
                    b.append(y[near])
            links = np.stack([np.concatenate(a), np.concatenate(b)], axis=1).view(np.int64)
            links = np.unique(np.sort(links, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return linked


LINKS = "a long, b long"


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def print_links(prints: DataFrame, most: int = MOST, tile: int = 1024, third: bool | None = None) -> DataFrame:
    """Links (a, b) that join all classes of distinct fingerprints (column print) within `most` (at most 4) bits; every link verified.

    Fingerprints meet under their fuzzy keys. A key that two have is a pair; those of a key with up to `tile` are compared
    inside a task and give fewer links than they are. Keys with more have first their fingerprints one bit apart linked by
    equality of what is left without that bit; then the classes that such a key still holds apart are compared in pairs of tiles.
    `third` (see fuzzy_keys) is by default used from four million fingerprints on, and does not change the classes.
    """
    if not 1 <= most <= MOST:
        raise ValueError(f"the fuzzy keys cover 1 to {MOST} differing bits")
    if third is None:
        third = prints.count() > 1 << 22
    keyed = prints.select("print").mapInArrow(_keyed(third), "key long, print long")
    met = keyed.groupBy("key").agg(F.min("print").alias("a"), F.max("print").alias("b"), F.count("*").alias("n")).where("n > 1")
    met = staged(met, "keys")
    links = met.where(_apart("a", "b") <= most).select("a", "b").distinct()
    more = met.where("n > 2").select("key", "n")
    largest = more.agg(F.max("n")).first()[0]
    if largest is None:
        return links
    # Spark takes the keys to be as small as the fingerprints they come from, so the join must not broadcast them.
    held = staged(join_counted(keyed.hint("merge"), more.select("key", "n", F.col("n").alias("size")), ["key"]), "held")
    small = held.where(F.col("size") <= tile).groupBy("key").agg(F.sort_array(F.collect_list("print")).alias("prints"))
    links = links.union(small.select("prints").distinct().mapInArrow(_linked(most), LINKS))
    if largest <= tile:
        return links
    large = staged(held.where(F.col("size") > tile), "large")
    bits = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    off = large.select("print").distinct().select("print", bits)
    off = off.select("print", "bit", F.expr("print & ~shiftleft(1L, bit)").alias("rest"))
    one = off.groupBy("bit", "rest").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a <> b").select("a", "b")
    links = staged(links.union(one).distinct(), "links")
    named = components(links)
    placed = staged(large.join(named.toDF("print", "class"), "print", "left").select("key", "print", "size", F.coalesce("class", "print").alias("class")), "placed")
    open_ = placed.groupBy("key").agg(F.min("class").alias("c"), F.max("class").alias("d"), F.count("*").alias("n")).where("c <> d").select("key", "n")
    placed = join_counted(placed, staged(open_, "open"), ["key"]).withColumn("tiles", F.ceil(F.col("size") / tile).cast("int"))
    own = F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int")
    spread = placed.select("key", "print", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    tiles = spread.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.sort_array(F.collect_list("print")).alias("prints"))
    return links.union(tiles.select("prints").mapInArrow(_linked(most), LINKS))


def fuzzy_classes(docs: DataFrame, shingle: int = 4, most: int = MOST, tile: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of documents whose fingerprints differ in `most` (up to 4) bits or fewer.

    A fingerprint bit is 1 if more than half of the XXH64 values (seed 42, of the UTF-8 of a shingle of lower-cased words
    joined by spaces) have it. A text of fewer words than a shingle is one shingle; null, empty and blank texts have
    fingerprint 0 and are linked like any other. Returns doc_id, fingerprint (16 lower-case hex digits) and component_id,
    the smallest doc_id that links reach.

    Rows that repeat an id give a row each, linked by their own text: the class of an id with several texts is that of each row.
    A null id is never the smallest: its component is the smallest other id of its class, or null. Other columns
    are not read. An empty table gives no rows. Equal fingerprints are one before keys are made, so copies cost nothing.
    """
    rows = staged(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = staged(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    links = staged(print_links(nodes.select("print"), most, tile).distinct(), "links")
    classes = staged(components(links), "classes").toDF("print", "class")
    named = staged(nodes.join(classes, "print", "left").withColumn("class", F.coalesce("class", "print")), "placed")
    heads = staged(named.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")), "heads")
    known = staged(join_counted(named, heads, ["class"], "prints").select("print", "n", "component_id"), "named")
    out = join_counted(rows, known, ["print"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
