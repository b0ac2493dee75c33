"""Near-duplicate classes by b-bit MinHash.

Minima of seeded hashes over a document's shingle set give band keys; their low bits, packed, give the collision-corrected
similarity of two documents by counting bits. Documents with equal sets are one class from the start. Band buckets link
to their smallest and largest member first; what a bucket still holds apart after that is compared by signature in tiles,
and pairs that may reach the threshold are confirmed on the full sets of the documents concerned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.components import components
from vellumspark.llm.skew import join_counted, join_dealt
from vellumspark.llm.store import staged
from vellumspark.llm.wordhash import LOWER, WORDS, rolling

# MARGIN is over four standard errors of the estimate at these sizes.
PERMUTATIONS, BITS, MARGIN = 128, 4, 0.15
FEATURES = "doc_id long, n_shingles long, k1 long, k2 long, sig array<long>, bands array<long>"


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of a shorter text, the hash of its whole word sequence."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(size, len(words))
    return np.unique(rolling(WORDS.of(words), k) + np.uint64(k))


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240)
    return rng.integers(0, 2**63, PERMUTATIONS, np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 2**63, PERMUTATIONS, np.uint64)


def _minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        grid = np.multiply.outer(a, values[at : at + 2048])
        grid += b[:, None]
        np.minimum(out, grid.min(axis=1), out=out)
    return out >> np.uint64(32)


def _features(size: int, rows: int, bands: int):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _seeds()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = shingle_set(text.as_py(), size)
                k1 = k2 = sig = keys = None
                if len(values):
                    digest = xxhash.xxh3_128_digest(values.tobytes())
                    k1, k2 = (int(x) for x in np.frombuffer(digest, np.int64))
                    low = _minima(values, a, b)
                    nibbles = (low & np.uint64(2**BITS - 1)).reshape(-1, 64 // BITS)
                    sig = np.bitwise_or.reduce(nibbles << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64).tolist()
                    keys = [xxhash.xxh3_64_intdigest(low[j * rows : (j + 1) * rows].tobytes(), j) - 2**63 for j in range(bands)]
                for column, v in zip(out, (i, len(values), k1, k2, sig, keys)):
                    column.append(v)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"])

    return features


def _estimate(x: Column, y: Column) -> Column:
    """Similarity from packed low bits: equal values by bit counts, less those equal by chance."""
    ones = sum(1 << k for k in range(0, 64, BITS))
    ones -= 1 << 64 if ones >> 63 else 0

    def differing(p: Column, q: Column) -> Column:
        d = p.bitwiseXOR(q)
        folded = d
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    unequal = F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda s, n: s + n)
    chance = 2.0**-BITS
    return (1 - unequal / PERMUTATIONS - chance) / (1 - chance)


def _overlap(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(p) + len(q) - both)


def _alike(rows: pa.Table, percent: int, least: float):
    """For a pair of tiles, a function that gives the partners of a place, best first.

    Partners are documents of another class, of a size that allows the threshold, with signatures that agree enough, and
    not met in an earlier band that both share.
    """
    chance = 2.0**-BITS
    node, comp, side, size = (rows[c].to_numpy() for c in ("node", "comp", "side", "n_shingles"))
    band = rows["band"][0].as_py()
    sig = np.array(rows["sig"].to_pylist(), np.int64).view(np.uint8).reshape(len(node), -1)
    sig = np.stack([sig & 15, sig >> 4], axis=2).reshape(len(node), -1)
    keys = np.array(rows["bands"].to_pylist(), np.int64)[:, :band]
    _, group = np.unique(comp, return_inverse=True)
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)

    def partners(i: int) -> np.ndarray:
        apart = right[(group[right] != group[i]) & ((side[i] != 0) | (node[right] > node[i]))]
        apart = apart[100 * np.minimum(size[apart], size[i]) >= percent * np.maximum(size[apart], size[i])]
        like = ((sig[apart] == sig[i]).mean(axis=1) - chance) / (1 - chance)
        order = np.argsort(-like, kind="stable")[: int((like >= least).sum())]
        return apart[order][~(keys[apart[order]] == keys[i]).any(axis=1)]

    return left, group, partners


TILE = "h long, band int, i int, j int, side int, node long, comp long"


def _tile_nodes(percent: int, least: float):
    """The documents of a pair of tiles that have a partner by signature: only their full sets are needed."""

    def nodes(rows: pa.Table) -> pa.Table:
        left, _, partners = _alike(rows, percent, least)
        wanted = np.zeros(rows.num_rows, bool)
        for i in left:
            found = partners(i)
            wanted[found] = True
            wanted[i] |= len(found) > 0
        return rows.select(["h", "band", "i", "j", "side", "node", "comp"]).filter(pa.array(wanted))

    return nodes


def _tile_links(percent: int, least: float):
    """Links that join classes inside one pair of tiles of a bucket, each confirmed on the full sets.

    A pair is confirmed only while its classes are still apart; so a tile gives fewer links than it has documents.
    """

    def links(rows: pa.Table) -> pa.Table:
        left, group, partners = _alike(rows, percent, least)
        node = rows["node"].to_numpy()
        items = [np.frombuffer(x, np.uint64) for x in rows["items"].to_pylist()]
        a, b = [], []
        for i in left:
            for j in partners(i):
                if group[j] != group[i] and _overlap(items[i], items[j], percent):
                    group[group == group[j]] = group[i]
                    a.append(node[i])
                    b.append(node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _similar(percent: int):
    """Keeps pairs whose full sets overlap enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_overlap(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return similar


def _sets_of(whole: DataFrame, nodes: DataFrame, size: int, name: str, bits: int = 23) -> DataFrame:
    """Full shingle sets of the given nodes, one row each: node, items.

    A bitmap of node hashes, of fixed size, keeps most other texts from the shuffle; the join is exact. Only texts that
    are left after it are cut up, so where there are more nodes than the bitmap tells apart, texts move but once.
    """
    place = F.xxhash64(F.col("node")).bitwiseAND(2**bits - 1)
    words = nodes.select(place.alias("p")).groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("m")).collect()
    bitmap = np.zeros(2 ** (bits - 6), np.int64)
    for r in words:
        bitmap[r.w] = r.m
    known = whole.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    @F.pandas_udf("boolean")
    def possible(places):
        import pandas as pd

        at = places.to_numpy()
        return pd.Series((known.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), size).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "items"])

    rows = whole.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text").where(possible(F.xxhash64("node").bitwiseAND(2**bits - 1)))
    rows = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    return staged(rows.mapInArrow(sets, "node long, items binary"), name)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = 5, bands: int = 25, tile: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose word-shingle sets overlap by at least percent / 100 (Jaccard), through chains of links.

    Words are runs between ASCII white space after A-Z became a-z. Returns doc_id, n_shingles, component_id (smallest
    doc_id of the class) and kept (doc_id = component_id). Two documents exactly at the threshold share a band with odds
    1 - (1 - t^rows)^bands (0.99999 at the defaults); all that share one are compared, whatever the size of a bucket.

    Null, empty and blank texts have an empty set and are classes of their own, kept. A text of fewer words than a
    shingle is one shingle. Rows that repeat an id give repeated results. A null id is never linked: its component is
    null and it is kept. Other columns are not read. An empty table gives no rows.

    Common bands, classes and copies are joined in place or dealt over slots (skew.py). What a bucket still holds apart is
    compared in pairs of tiles by signature; only documents that have a partner there bring their full sets.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    feats = staged(whole.mapInArrow(_features(shingle, rows, bands), FEATURES), "features")
    usable = feats.where("n_shingles > 0 and doc_id is not null")
    firsts = usable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "bands")).alias("r"), F.count("*").alias("n"))
    firsts = staged(firsts.select("k1", "k2", "n", F.col("r.doc_id").alias("node"), "r.n_shingles", "r.sig", "r.bands"), "firsts")
    reps = staged(firsts.groupBy("node").agg(F.min(F.struct("n_shingles", "sig", "bands")).alias("r")).select("node", "r.*"), "representatives")

    entries = reps.select("node", F.posexplode("bands").alias("band", "h"))
    ends = entries.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"), F.count("*").alias("many")).where("low < high")
    buckets = staged(join_counted(entries, staged(ends, "ends"), ["h"]).select("h", "band", "node", "low", "high", "many"), "buckets")

    pair = [F.struct(F.least("node", c).alias("a"), F.greatest("node", c).alias("b")) for c in ("low", "high")]
    star = staged(buckets.select(F.explode(F.array(*pair)).alias("p")).select("p.a", "p.b").where("a < b").distinct(), "star")
    x, y = reps.select("node", "n_shingles", "sig").toDF("a", "p", "x"), reps.select("node", "n_shingles", "sig").toDF("b", "q", "y")
    least = percent / 100 - MARGIN
    both = join_dealt(join_dealt(star, x, "a", "b", "uses-a"), y, "b", "a", "uses-b")
    near = both.where((100 * F.least("p", "q") >= percent * F.greatest("p", "q")) & (_estimate(F.col("x"), F.col("y")) >= least))
    near = staged(near.select("a", "b"), "candidates")
    items = _sets_of(whole, near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), shingle, "sets")
    full = join_dealt(join_dealt(near, items.toDF("a", "x"), "a", "b", "near-a"), items.toDF("b", "y"), "b", "a", "near-b").select("a", "b", "x", "y")
    links = staged(full.mapInArrow(_similar(percent), "a long, b long"), "confirmed")

    classes = staged(components(links), "classes")
    placed = staged(buckets.where("many > 2").join(classes, "node", "left").select("h", "band", "node", F.coalesce("component", "node").alias("comp")), "placed")
    apart = placed.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n"), F.ceil(F.count("*") / tile).cast("int").alias("t")).where("c0 < c1")
    held = staged(join_counted(placed, staged(apart, "apart"), ["h"]).select("h", "band", "node", "comp", "t", F.pmod(F.xxhash64("node"), F.col("t")).cast("int").alias("own")), "held")
    if not held.isEmpty():
        spread = held.select("h", "band", "node", "comp", "own", F.explode(F.expr("sequence(0, t - 1)")).alias("other"))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        spread = spread.select("h", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "node", "comp")
        known = reps.select("node", "n_shingles", "sig", "bands")
        wanted = staged(spread.join(known, "node").groupBy("h", "i", "j").applyInArrow(_tile_nodes(percent, least), TILE), "wanted")
        more = _sets_of(whole, wanted.select("node").distinct(), shingle, "sets")
        rich = wanted.join(known, "node").join(more, "node")
        links = staged(links.union(rich.groupBy("h", "i", "j").applyInArrow(_tile_links(percent, least), "a long, b long")), "links")
    classes = components(links)
    named = staged(firsts.join(classes, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component_id")), "named")
    linked = join_counted(usable.select("doc_id", "n_shingles", "k1", "k2"), named, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    alone = feats.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("*", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
