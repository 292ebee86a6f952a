"""Global running values without a single-partition window over the data.

Rows are dealt to ordered buckets; each bucket's total is a map-side-combined aggregate, the window over all of a table
runs on these totals alone, and the window over rows runs inside each bucket. Any value whose summaries of neighbouring
buckets merge to the summary of both can be carried that way: sums, counts, extremes, the last value that is there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like wanted that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


@dataclass(frozen=True)
class Running:
    """What is carried along the order: the sum, the least or largest, or the last value that is not null.

    The row itself counts if inclusive. A sum is 0 before the first row, the others are null.
    """

    how: str
    value: Column
    inclusive: bool = True

    def __post_init__(self) -> None:
        if self.how not in ("sum", "min", "max", "last"):
            raise ValueError(self.how)


def _over(how: str, value: Column, window) -> Column:
    if how == "last":
        return F.last(value, ignorenulls=True).over(window)
    got = {"sum": F.sum, "min": F.min, "max": F.max}[how](value).over(window)
    return F.coalesce(got, F.lit(0)) if how == "sum" else got


def _total(how: str, value: Column, order: Sequence[str]) -> Column:
    """A bucket's summary, combined in each task before the shuffle."""
    if how == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "min": F.min, "max": F.max}[how](value)


def _merged(how: str, before: Column, inside: Column) -> Column:
    if how == "sum":
        return before + inside
    if how == "last":
        return F.coalesce(inside, before)
    return F.least(before, inside) if how == "min" else F.greatest(before, inside)


def prefix_scan(df: DataFrame, order: Sequence[str], bucket: Column, **running: Running) -> DataFrame:
    """df with a column of each name in running: what is carried up to a row, in the order of the columns order.

    bucket must not decrease along that order and must depend on the row's values alone (not on its partition, which may
    differ when a lost task is run again). A bucket's rows are sorted by one task: choose it so that they fit. Rows whose
    bucket is null come first. order must tell any two rows apart where the last of them matters.
    """
    names = list(running)
    b, *inner = free_names(df, "_bucket", *[f"_{kind}{i}" for i in range(len(names)) for kind in ("value", "total", "start", "inside")])
    value, total, start, inside = (dict(zip(names, inner[i::4], strict=True)) for i in range(4))
    base = df.withColumns({b: F.struct(bucket)} | {value[n]: running[n].value for n in names})
    totals = base.groupBy(b).agg(*[_total(running[n].how, F.col(value[n]), order).alias(total[n]) for n in names])
    before = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)  # over one row per bucket
    starts = totals.select(b, *[_over(running[n].how, F.col(total[n]), before).alias(start[n]) for n in names])
    w = Window.partitionBy(b).orderBy(*order)
    windows = {True: w.rowsBetween(Window.unboundedPreceding, 0), False: w.rowsBetween(Window.unboundedPreceding, -1)}
    rows = base.withColumns({inside[n]: _over(running[n].how, F.col(value[n]), windows[running[n].inclusive]) for n in names})
    joined = rows.join(starts, b)
    return joined.withColumns({n: _merged(running[n].how, F.col(start[n]), F.col(inside[n])) for n in names}).drop(b, *inner)


def prefix_sum(df: DataFrame, value: Column, order: Sequence[str], bucket: Column, name: str = "offset") -> DataFrame:
    """df with name: the sum of value over all rows before this one; see prefix_scan()."""
    return prefix_scan(df, order, bucket, **{name: Running("sum", F.coalesce(value, F.lit(0)).cast("long"), inclusive=False)})


def key_bucket(key: str, rows: int = 65_536) -> Column:
    """Bucket of a dense integer key: its rows per bucket are bounded by rows. Sparse keys: see even_bucket()."""
    return F.floor(F.col(key) / rows)


def even_bucket(df: DataFrame, key: str, rows: int = 65_536) -> Column:
    """Bucket of an integer key with gaps: as many equal ranges from the least to the largest key as rows asks for.

    One pass over the keys counts them. Keys that crowd in a small range make larger buckets.
    """
    n, low, high = df.agg(F.count(key), F.min(key), F.max(key)).first()
    if not n:
        return F.lit(0).cast("long")
    width = max(1, -(-(high - low + 1) // -(-n // rows)))
    return F.floor((F.col(key) - low) / width)


def global_row_number(df: DataFrame, order: Sequence[str], bucket: Column, name: str = "rn") -> DataFrame:
    """df with its row's place, from 0, in the order of the columns order."""
    return prefix_sum(df, F.lit(1), order, bucket, name)
