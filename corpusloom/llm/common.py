"""Expressions and helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that one inner fold handles: a fold copies its result array at each step, so long arrays go in chunks.
CHUNK = 512


def running_starts(lengths: Column, chunk: int = CHUNK) -> Column:
    """Exclusive running sums of an array<long>: place i holds the sum of the elements before it.

    Folds of chunk elements whose bases are sums over the array before them; no step copies more than chunk elements.
    """
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)

    def inner(part: Column, base: Column) -> Column:
        first = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")))["out"]

    firsts = F.sequence(F.lit(1), F.size(lengths), F.lit(chunk))
    whole = F.flatten(F.transform(firsts, lambda i: inner(F.slice(lengths, i, F.lit(chunk)), total(F.slice(lengths, F.lit(1), i - 1)))))
    return F.when(F.size(lengths) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,found>> of a pattern's leftmost non-overlapping matches, in code points, end exclusive.

    found is the text of group. Matches come from regexp_extract_all, their places from the lengths of what split()
    leaves between them; texts without a match skip both.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    size = F.transform(found, lambda m: F.length(m).cast("long"))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), size, lambda g, n: F.length(g).cast("long") + F.coalesce(n, F.lit(0)))
    ends = F.zip_with(running_starts(steps), steps, lambda s, n: s + n)
    inner = F.regexp_extract_all(text, F.lit(pattern), group)
    spans = F.zip_with(F.zip_with(ends, size, lambda e, n: F.struct((e - n).alias("start"), e.alias("end"))), inner, lambda p, x: F.struct(p["start"].alias("start"), p["end"].alias("end"), x.alias("found")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


#: Ids of a broadcast set at most: 16 bytes each in the driver and in every executor.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", bound: int = BROADCAST_IDS) -> DataFrame:
    """docs without the rows whose key is in ids (a written table); broadcast only behind a count of it.

    Rows without a key can't be told apart by it: they stay.
    """
    few = ids.limit(bound + 1).count() <= bound
    return docs.join(F.broadcast(ids) if few else ids, key, "left_anti")


#: Keys that skew_join() broadcasts at most, and rows that such a key has at least.
HOT_KEYS, LEAST_HOT = 10_000, 500


def skew_join(rows: DataFrame, table: DataFrame, on: str, n: str, hot: int = HOT_KEYS, least: int = LEAST_HOT) -> DataFrame:
    """rows inner-joined with table, a written table of one short row per key, in which n is how many rows have the key.

    Keys of over least rows and over 1/hot of all, fewer than hot keys, are joined by broadcast, where their rows lie; all
    others by shuffle, so no key brings more rows to one task.
    """
    limit = max(least, (table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]) // hot)
    often, rest = table.where(F.col(n) > limit), table.where(F.col(n) <= limit)
    if not often.head(1):
        return rows.join(table, on)
    direct = rows.join(F.broadcast(often), on)
    return direct.unionByName(rows.join(F.broadcast(often.select(on)), on, "left_anti").join(rest, on))
