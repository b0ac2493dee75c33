"""Joins against one row a key where a few keys may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.store import staged


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], n: str = "n", share: int = 1000, least: int = 256) -> DataFrame:
    """Inner join of rows with counted, which has one row a key and, in column n, the number of rows with that key.

    Keys with more than 1 / share of all counted rows cannot be more than `share` many, so they are broadcast and their
    rows stay where they are; the other keys are shuffled. Where no key has so many the join is a plain one. Null keys match
    nothing. Both inputs may be read twice: stage them if they cost much. The column n is dropped.
    """
    total, most = counted.agg(F.sum(n), F.max(n)).first()
    bound = max(least, (total or 0) // share)
    if (most or 0) <= bound:
        return rows.join(counted.drop(n), on)
    hot = counted.where(F.col(n) > bound).drop(n)
    many = F.broadcast(hot.select(*on))
    spread = rows.join(F.broadcast(hot), on)
    rest = rows.join(many, on, "left_anti").join(counted.where(F.col(n) <= bound).drop(n), on)
    return spread.unionByName(rest)


def join_dealt(rows: DataFrame, keyed: DataFrame, key: str, salt: str, name: str, per: int = 1024) -> DataFrame:
    """Inner join of rows with keyed, one row a key, where a key of many rows is dealt over slots of about `per` rows.

    The row of such a key is repeated for each of its slots, so that no task gets all its partners, however wide it is.
    Where no key has more than `per` rows the join is a plain one.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= per:
        return rows.join(keyed, key)
    uses = staged(counts.withColumn("_slots", F.ceil(F.col("n") / per).cast("int")), name)
    dealt = join_counted(rows, uses, [key]).withColumn("_slot", F.pmod(F.xxhash64(salt), F.col("_slots")).cast("int")).drop("_slots")
    spread = keyed.join(uses.select(key, F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)).alias("_slot")), key)
    return dealt.join(spread, [key, "_slot"]).drop("_slot")
