"""The kept checkpoints of a run as one state: admission, saving and eviction, save after save, inside the JVM.

The state is a list of k checkpoints at most. Saves go in small buckets of steps; a bucket is folded by one expression. What a
bucket does to any state that it may be entered with is told by a summary of 3k saves, and summaries of neighbouring
buckets merge to the summary of both:

- saves above the bucket's k-th smallest loss never stay, whatever came before;
- of those below it all are kept, fewer than k;
- of those at it, a save that must be admitted first (a validation) can only enter as one of the first k saves up to that loss,
  since after them the list is full of no larger ones; a save that needs no admission (a periodic one) always enters and
  pushes out the oldest of that loss, so that only the last k of them can be in the list at the end.

States are carried over summaries of summaries, FAN at a time, down to the buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.storage import materialize

#: Steps of a bucket, and buckets that one fold takes the state through.
STEPS, FAN = 512, 512

#: A kept checkpoint; the least of a list goes first: the largest loss, of equal ones the smallest step, then path.
_KEPT = "struct<low:double,step:bigint,path:string>"


def _entered(state: Column, save: Column, k: int) -> Column:
    """Whether a save enters: a periodic one always does, a validation if there is room or its loss is below the worst kept."""
    return save["forced"] | (F.size(state) < k) | F.coalesce(save["val_loss"] < -F.get(state, F.lit(0))["low"], F.lit(False))


def _with_save(state: Column, save: Column) -> Column:
    kept = F.struct((-save["val_loss"]).alias("low"), save["step"].alias("step"), save["path"].alias("path"))
    return F.array_sort(F.array_append(state, kept))


def _after(state: Column, save: Column, k: int) -> Column:
    """The state after a save: the new list, without its worst if it is too long."""
    more = _with_save(state, save)
    return F.when(_entered(state, save, k), F.when(F.size(more) > k, F.slice(more, 2, max(k, 0))).otherwise(more)).otherwise(state)


def _summary(saves: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The saves of each group (keys) that tell what the group does to a state; see above. Groups are bounded."""
    by_loss = Window.partitionBy(*keys).orderBy("val_loss", "step", "path")
    whole = Window.partitionBy(*keys)
    ranked = saves.withColumn("_r", F.row_number().over(by_loss))
    limit = ranked.withColumn("_w", F.max(F.when(F.col("_r") == k, F.col("val_loss"))).over(whole))  # null: fewer than k saves
    near = limit.where("_w IS NULL OR val_loss <= _w")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("step", "path"))
    last = F.row_number().over(Window.partitionBy(*keys, (F.col("val_loss") == F.col("_w")) & F.col("forced")).orderBy(F.desc("step"), F.desc("path")))
    told = near.withColumns({"_f": first, "_l": last})
    return told.where(f"_w IS NULL OR val_loss < _w OR _f <= {k} OR (forced AND _l <= {k})").select(*saves.columns)


def _folded(groups: DataFrame, k: int) -> Column:
    """States before each of a group's items and after the last, from column start over items[].saves."""
    first = F.struct(F.col("start").alias("state"), F.array().cast(f"array<array<{_KEPT}>>").alias("before"))

    def step(acc: Column, item: Column) -> Column:
        after = F.aggregate(item["saves"], acc["state"], lambda s, save: _after(s, save, k))
        return F.struct(after.alias("state"), F.array_append(acc["before"], acc["state"]).alias("before"))

    return F.aggregate("items", first, step)["before"]


def _states(saves: DataFrame, k: int) -> DataFrame:
    """(run, bucket, start): the state that each bucket is entered with."""
    levels, place = [], F.col("bucket")
    table = materialize(_summary(saves, ["run", "bucket"], k), "history-summary")
    while True:
        levels.append(table)
        if not table.where(place >= FAN).head(1):
            break
        above = table.withColumn("bucket", F.floor(F.col("bucket") / FAN))
        table = materialize(_summary(above, ["run", "bucket"], k), "history-summary")
    starts = levels[-1].select("run", F.lit(0).cast("long").alias("above"), F.array().cast(f"array<{_KEPT}>").alias("start")).distinct()
    for table in reversed(levels):
        item = F.struct(F.col("step"), F.col("path"), F.col("val_loss"), F.col("forced"))
        items = table.groupBy("run", "bucket").agg(F.array_sort(F.collect_list(item)).alias("saves"))
        groups = items.groupBy("run", F.floor(F.col("bucket") / FAN).alias("above")).agg(F.array_sort(F.collect_list(F.struct("bucket", "saves"))).alias("items"))
        told = groups.join(starts, ["run", "above"]).withColumn("before", _folded(groups, k))
        starts = told.select("run", F.explode(F.arrays_zip(F.col("items.bucket").alias("above"), F.col("before").alias("start"))).alias("x")).select("run", "x.*")
    return starts.withColumnRenamed("above", "bucket")


def checkpoint_history(df: DataFrame, k: int, run: str | None = None, steps: int = STEPS) -> DataFrame:
    """df's saves (step, val_loss, path, forced) with admitted, removed and kept, after each of them in order of step.

    forced: a periodic save, which is never refused. removed: the path that goes as the list grows over k, possibly the new one;
    null where none goes. kept: the paths that are there afterwards, best first. run tells runs apart, null is one too; without it all rows
    are one run. Steps are not negative and not repeated within a run; a save without a step or loss raises. k of 0 or less keeps nothing:
    validations are refused, periodic saves go at once.
    """
    k = max(k, 0)
    there = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a save without {c}")))
    name = F.struct((F.lit(0) if run is None else F.col(run)).alias("name"))  # rows without a run are one: a struct is never null
    saves = df.select(name.alias("run"), there("step").cast("long").alias("step"), F.col("path"), there("val_loss").cast("double").alias("val_loss"), "forced")
    negative = F.raise_error(F.lit("a negative step")).cast("long")
    saves = saves.withColumn("bucket", F.when(F.col("step") < 0, negative).otherwise(F.floor(F.col("step") / steps)))
    starts = _states(saves, k)
    item = F.struct("step", "path", "val_loss", "forced")
    buckets = saves.groupBy("run", "bucket").agg(F.array_sort(F.collect_list(item)).alias("saves")).join(starts, ["run", "bucket"])
    out = f"array<struct<step:bigint,path:string,val_loss:double,forced:boolean,admitted:boolean,removed:string,kept:array<{_KEPT}>>>"
    first = F.struct(F.col("start").alias("state"), F.array().cast(out).alias("out"))

    def step(acc: Column, save: Column) -> Column:
        state, more = acc["state"], _with_save(acc["state"], save)
        entered, full = _entered(state, save, k), F.size(more) > k
        after = _after(state, save, k)
        row = F.struct(
            save["step"].alias("step"), save["path"].alias("path"), save["val_loss"].alias("val_loss"), save["forced"].alias("forced"),
            entered.alias("admitted"), F.when(entered & full, F.get(more, F.lit(0))["path"]).alias("removed"), after.alias("kept"),
        )
        return F.struct(after.alias("state"), F.array_append(acc["out"], row).alias("out"))

    told = buckets.select("run", F.explode(F.aggregate("saves", first, step)["out"]).alias("x")).select("run", "x.*")
    told = told.withColumn("kept", F.reverse(F.col("kept.path")))
    return told.select(*([] if run is None else [F.col("run.name").alias(run)]), *told.columns[1:])
