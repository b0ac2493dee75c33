"""Temperature mixing of sources, in DataFrame functions only.

Source token shares are raised to an exponent and normalised. The exponent is bisected until the weights meet a target
entropy or repetition limit. The weights become token budgets; a budget is filled by whole passes over a source and then
by whole blocks of it in the order of a seeded permutation. Every source has the same number of blocks, so one of any
size is many blocks wide, and what is ordered per source is a fixed number of rows.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumspark.llm.store import staged

WORD = r"[^\x20\x09-\x0D]+"


def _block(id_col: Column, blocks: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("block:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") % blocks


def _least_for_repetition(shares: DataFrame, max_repeat: float) -> float:
    """The smallest exponent from 0 on at which no source is repeated more than max_repeat times as often as the largest one.

    Less exponent means flatter weights, and so more passes over the smallest source for one over the largest. The least and
    largest share alone decide; the border is found by repeated halving, to 2^-30.
    """
    least, most = shares.agg(F.min("share"), F.max("share")).first()
    lo, hi = 0.0, 1.0
    if (most / least) <= max_repeat:
        return 0.0
    for _ in range(30):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (least / most) ** (mid - 1) <= max_repeat else (mid, hi)
    return hi


def _most_for_entropy(shares: DataFrame, min_entropy: float, rounds: int = 6, ways: int = 32) -> float:
    """The largest exponent up to 1 whose weights have the entropy; one job sums at `ways` exponents, as good as five halvings."""
    n, own = shares.agg(F.count("*"), F.sum(-F.col("share") * F.ln("share"))).first()
    if log(n) < min_entropy - 1e-9:
        raise ValueError(f"{n} sources have an entropy of {log(n):.6g} nats at most; min_entropy is {min_entropy}")
    if own >= min_entropy:
        return 1.0
    lo, step = 0.0, 1.0 / ways
    for _ in range(rounds):
        grid = [lo + step * k for k in range(1, ways)]
        power = [F.exp(F.lit(a) * F.ln("share")) for a in grid]
        sums = shares.agg(*(F.sum(p) for p in power), *(F.sum(p * F.ln("share")) for p in power)).first()
        # Entropy falls as the exponent grows: the last exponent that still has enough.
        met = [a for a, z, s in zip(grid, sums, sums[len(grid) :]) if log(z) - a * s / z >= min_entropy]
        lo, step = max(met, default=lo), step / ways
    return lo


def _solve(shares: DataFrame, max_repeat: float | None, min_entropy: float | None) -> float:
    """The exponent that meets what is asked; only sums over sources reach the driver.

    Entropy falls and repetition sinks as the exponent grows, so entropy bounds it from above and repetition from below: with
    an entropy the upper bound is taken, else the lower one. Bounds that cross are an error.
    """
    if min_entropy is None:
        return _least_for_repetition(shares, 2.0 if max_repeat is None else max_repeat)
    most = _most_for_entropy(shares, min_entropy)
    if max_repeat is not None and _least_for_repetition(shares, max_repeat) > most + 1e-9:
        raise ValueError(f"no exponent gives both an entropy of {min_entropy} nats and at most {max_repeat} repetitions")
    return most


def mix(docs: DataFrame, max_repeat: float | None = None, min_entropy: float | None = None, total_tokens: int | None = None, blocks: int = 1024, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of the mixture: the input's columns plus n_tokens, weight, epoch (from 0), block and turn.

    A document comes once for each pass its source needs; the last pass takes the blocks that fit its budget, in turn
    order. Weights are share^a / sum(share^a), with the largest a up to 1 that meets min_entropy (nats) if given, or else
    the smallest a at which no source is repeated more than max_repeat times as often as the largest one (2 where neither is
    given). Where both are given both hold; targets that no a meets raise ValueError. Without
    total_tokens the budget is the least that takes every source in whole at least once, so no document is lost; with
    it, sources whose budget is below their size lose blocks.

    Tokens are words. Null sources are one source of their own. Null and empty texts have no tokens and follow their
    block. Null ids share a block. Rows that repeat an id are all kept. Input columns with a name of an added one are
    replaced. An empty table gives no rows, and one without any token one pass of each row.
    """
    added = ("n_tokens", "weight", "epoch", "block", "turn")
    keep = [c for c in docs.columns if c not in added]
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("\u0000"))
    rows = docs.select(*keep, source.alias("_source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), _block(F.col(id_col), blocks).alias("block"))
    by_block = staged(rows.groupBy("_source", "block").agg(F.sum("n_tokens").alias("size")), "blocks")
    sources = by_block.groupBy("_source").agg(F.sum("size").alias("tokens"))
    all_tokens = sources.agg(F.sum("tokens")).first()[0] or 0
    if not all_tokens:
        return rows.drop("_source").select(*keep, "n_tokens", F.lit(0.0).alias("weight"), F.lit(0).alias("epoch"), "block", F.lit(0).alias("turn"))
    shares = staged(sources.where("tokens > 0").select("_source", "tokens", (F.col("tokens") / F.lit(all_tokens)).alias("share")), "shares")
    alpha = _solve(shares, max_repeat, min_entropy)
    power = F.exp(F.lit(alpha) * F.ln("share"))
    z = shares.agg(F.sum(power)).first()[0]
    weighted = shares.select("_source", "tokens", (power / F.lit(z)).alias("weight"))
    least = weighted.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
    total = float(total_tokens) if total_tokens is not None else least
    # Budgets are whole tokens; a rounding error must not cost the largest source its last block.
    budgets = weighted.select("_source", "tokens", "weight", F.floor(F.col("weight") * F.lit(total) + 0.5).cast("long").alias("budget"))
    passes = F.floor(F.col("budget") / F.col("tokens")).cast("int")
    plan = by_block.join(budgets, "_source").select("_source", "block", "size", "weight", passes.alias("passes"), (F.col("budget") - passes * F.col("tokens")).alias("rest"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("_source"), F.col("passes"), F.col("block")))
    turn = Window.partitionBy("_source").orderBy("key", "block")
    ordered = plan.withColumn("key", order).withColumn("upto", F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = ordered.withColumn("epochs", F.col("passes") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).where("epochs > 0")
    each = ordered.select("_source", "block", "weight", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("_source"), F.col("epoch"), F.col("block")))
    turns = each.withColumn("turn", F.row_number().over(Window.partitionBy("_source", "epoch").orderBy(place, "block")) - 1)
    blank = by_block.join(shares, "_source", "left_anti").select("_source", "block", F.lit(0.0).alias("weight"), F.lit(0).alias("epoch"), F.lit(0).alias("turn"))
    schedule = turns.select("_source", "block", "weight", "epoch", "turn").union(blank)
    return rows.join(schedule, ["_source", "block"]).select(*keep, "n_tokens", "weight", "epoch", "block", "turn")


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, chr(0)) AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
         CAST('0x' || md5('block:' || doc_id)[1:8] AS BIGINT) % 1024 AS block
  FROM documents),
b AS (SELECT s, block, sum(n_tokens)::BIGINT AS size FROM d GROUP BY ALL),
t AS (SELECT s, sum(size)::BIGINT AS tokens FROM b GROUP BY s),
a AS (SELECT CASE WHEN min(tokens) = max(tokens) THEN 0.0
             ELSE greatest(0.0, 1 + ln(2.0) / ln(min(tokens) / max(tokens))) END AS alpha FROM t),
p AS (SELECT s, tokens, exp(alpha * ln(tokens / (SELECT sum(tokens) FROM t))) AS w FROM t, a),
w AS (SELECT s, tokens, w / (SELECT sum(w) FROM p) AS weight FROM p),
g AS (SELECT s, tokens, weight, floor(weight * (SELECT max(tokens / weight) FROM w) + 0.5)::BIGINT AS budget FROM w),
o AS (SELECT b.s, b.block, b.size, weight, (budget // tokens)::INT AS passes, budget - (budget // tokens) * tokens AS rest,
         md5('0:' || b.s || ':' || (budget // tokens) || ':' || b.block) AS key FROM b JOIN g USING (s)),
u AS (SELECT *, sum(size) OVER (PARTITION BY s ORDER BY key, block ROWS UNBOUNDED PRECEDING) AS upto FROM o),
e AS (SELECT s, block, weight, unnest(range(passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END))::INT AS epoch FROM u),
r AS (SELECT *, (row_number() OVER (PARTITION BY s, epoch ORDER BY md5('0:' || s || ':' || epoch || ':' || block), block) - 1)::INT AS turn FROM e)
SELECT doc_id, d.s AS source, n_tokens::BIGINT AS n_tokens, round(weight, 6) AS weight, epoch, d.block AS block, turn
FROM d JOIN r ON d.s = r.s AND d.block = r.block
"""
