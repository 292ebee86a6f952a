"""Exact-size, seeded samples, splits and heads. Bernoulli sampling is never used: sizes here are exact."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.prefix import free_names, global_row_number, prefix_sum


#: Digits of the shuffle key that make a bucket: 16**DIGITS buckets, called BUCKETS below.
DIGITS = 3


def shuffle_key(seed: int, key: str) -> Column:
    """A seeded pseudo-random order that any SQL engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _cut_rows(keys: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(group, shuffle, key, equal, taken): for each group, the n-th smallest (shuffle, key); see _cuts().

    The first digits of the shuffle key deal a group's rows to buckets, in which they are ranked; the buckets' last ranks tell
    which one holds the n-th row. Rows are read and dealt once, by these narrow columns.
    """
    there = F.col("group").isNotNull() & F.col("bucket").isNotNull() & F.col("key").isNotNull()
    dealt = keys.withColumn("bucket", F.substring(F.hex("shuffle"), 1, DIGITS)).where(there).repartition("group", "bucket")
    inside = Window.partitionBy("group", "bucket")
    ranked = dealt.withColumn("rank", F.row_number().over(inside.orderBy("shuffle", "key")))
    counts = ranked.groupBy("group", "bucket").agg(F.max("rank").alias("n"))  # of ranks, so that both sides read one exchange
    before = Window.partitionBy("group").orderBy("bucket")  # BUCKETS rows a group
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("group")].cast("long").alias("limit")
    sized = counts.select("*", limit).withColumn("upto", F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    cut = sized.where("upto >= limit AND upto - n < limit").select("group", "bucket", (F.col("limit") - F.col("upto") + F.col("n")).alias("nth"))
    same = Window.partitionBy("group", "bucket", "shuffle", "key")
    last = ranked.join(F.broadcast(cut), ["group", "bucket"])  # a row per group
    told = last.withColumns({"first": F.min("rank").over(same), "equal": F.count(F.lit(1)).over(same)}).where("rank = nth")
    return told.select("group", "shuffle", "key", "equal", (F.col("nth") - F.col("first") + 1).alias("taken"))


def _cuts(keys: DataFrame, limits: dict[str, int]) -> dict[str, tuple[bytes, object, int, int]]:
    """For each group, the n-th smallest (shuffle, key): (shuffle, key, rows that are equal to it, how many of them belong to the n).

    keys has group, shuffle, key; limits has n of 1 and more for each group. Rows without a key don't count. Raises if a group
    has fewer rows than n. The driver gets a row per group.
    """
    found = {r["group"]: (bytes(r["shuffle"]), r["key"], r["equal"], r["taken"]) for r in _cut_rows(keys, limits).collect()}
    if short := [g for g in limits if g not in found]:
        raise ValueError(f"sample larger than source {', '.join(sorted(short))}")
    return found


def _below(shuffle: Column, key: Column, cut: tuple, kind: str) -> tuple[Column, Column]:
    """Whether a row comes before the cut, and whether it is equal to it."""
    at, value = F.lit(bytearray(cut[0])), F.lit(cut[1]).cast(kind)
    same = shuffle == at
    return (shuffle < at) | (same & (key < value)), same & (key == value)


#: Copies of a row that one array holds.
COPIES = 100_000


def _told_apart(equal: DataFrame, taken: int, name: str) -> DataFrame:
    """equal's rows with name: true for exactly taken of them, the first by a hash of all columns.

    Rows that are the same in all columns are counted where they lie and are made again from their count, so however many
    there are, no task gathers them.
    """
    n, h, before, block = free_names(equal, "_n", "_h", "_before", "_block")
    counted = equal.groupBy(*equal.columns).agg(F.count(F.lit(1)).alias(n)).withColumn(h, F.xxhash64(*equal.columns))
    placed = prefix_sum(counted, F.col(n), [h], F.shiftright(h, 52), before)
    mine = F.greatest(F.lit(0), F.least(F.col(n), F.lit(taken) - F.col(before)))
    blocks = placed.select(*equal.columns, n, mine.alias(before), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES))).alias(block))
    copies = F.sequence(F.col(block) * COPIES + 1, F.least(F.col(n), (F.col(block) + 1) * COPIES))
    return blocks.select(*equal.columns, before, F.explode(copies).alias(h)).select(*equal.columns, (F.col(h) <= F.col(before)).alias(name))


def exact_sample(df: DataFrame, weights: dict[str, int | None], key: str, seed: int = 0, source: str = "dataset") -> DataFrame:
    """For each source in weights, exactly n rows without replacement; all rows where n is None; other sources go.

    The n rows with the smallest shuffle keys are taken; rows without a key never are. One pass over keys and sources finds each source's n-th key; it runs
    at once and raises if a source has fewer than n rows. The rows are then taken where they lie, by comparing keys: nothing
    but keys is shuffled. Where the n-th key is one of several equal ones, as many of them as n needs are taken, in a pass of
    their own over them.
    """
    whole = F.col(source).isin([k for k, v in weights.items() if v is None])
    numbers = {k: v for k, v in weights.items() if v}
    none = df.where(whole) if None in weights.values() else df.limit(0)
    if not numbers:
        return none
    mixed, kind = F.unhex(shuffle_key(seed, key)), df.schema[key].dataType.simpleString()
    cuts = _cuts(df.where(F.col(source).isin(list(numbers))).select(F.col(source).alias("group"), mixed.alias("shuffle"), F.col(key).alias("key")), numbers)
    take, some = whole, []
    for name, cut in cuts.items():
        below, equal = _below(mixed, F.col(key), cut, kind)
        take = take | ((F.col(source) == name) & (below if cut[2] > cut[3] else below | equal))
        if cut[2] > cut[3]:
            (mark,) = free_names(df, "_taken")
            some.append(_told_apart(df.where((F.col(source) == name) & equal), cut[3], mark).where(mark).drop(mark))
    return reduce(DataFrame.unionByName, some, df.where(take))


def threshold_split(df: DataFrame, fraction: float, key: str, seed: int = 0) -> DataFrame:
    """df with split and shuffle_key: exactly ceil(fraction * n) rows are test, those with the smallest shuffle keys.

    Rows are told by comparing keys with the last one of the test split: nothing but keys is shuffled, in a pass that runs at
    once. If the border falls among rows of one key, as many of them as the test split needs are test.
    """
    n = df.count()
    test = math.ceil(fraction * n)
    text = shuffle_key(seed, key)
    if not test:
        return df.withColumns({"split": F.lit("train"), "shuffle_key": text})
    keys = df.select(F.lit("all").alias("group"), F.unhex(text).alias("shuffle"), F.col(key).alias("key"))
    cut = _cuts(keys, {"all": test})["all"]
    below, equal = _below(F.unhex(text), F.col(key), cut, df.schema[key].dataType.simpleString())
    told = lambda part, split: part.withColumns({"split": split, "shuffle_key": text})
    if cut[2] == cut[3]:
        return told(df, F.when(below | equal, "test").otherwise("train"))
    (mark,) = free_names(df, "_taken")
    apart = _told_apart(df.where(equal), cut[3], mark)
    rest = told(df.where(~equal), F.when(below, "test").otherwise("train"))
    return rest.unionByName(told(apart, F.when(F.col(mark), "test").otherwise("train")).drop(mark))


def exact_split(df: DataFrame, fraction: float, key: str, seed: int = 0) -> DataFrame:
    """df with split: exactly ceil(fraction * n) rows are test, the others train.

    Ranks come from the bucketed prefix: 4096 buckets by the first digits of the shuffle key, no global sort.
    """
    ranked = global_row_number(df.withColumn("_shuffle", shuffle_key(seed, key)), ["_shuffle", key], F.substring("_shuffle", 1, 3), "shuffle_rank")
    size = df.agg(F.ceil(F.lit(fraction) * F.count(F.lit(1))).alias("_test"))
    return (
        ranked.join(F.broadcast(size))  # one row
        .withColumn("split", F.when(F.col("shuffle_rank") < F.col("_test"), "test").otherwise("train"))
        .drop("_shuffle", "_test")
    )


def ordered_head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the order; fewer than n raise when it runs, as an index out of range would."""
    if n < 0:
        raise ValueError("n must not be negative")
    head = df.orderBy(*order).limit(n)
    guard = df.limit(n).agg(F.count(F.lit(1)).alias("_n")).select(F.when(F.col("_n") < n, F.raise_error(F.lit("head larger than table"))).otherwise(F.lit(True)).alias("_ok"))
    return head.join(F.broadcast(guard), F.col("_ok"), "left_semi")


def limit_samples(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """All rows for None or 0, else the first n at most."""
    return df.orderBy(*order).limit(n) if n else df
