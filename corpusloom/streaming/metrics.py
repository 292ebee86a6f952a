"""The metric log as a stream: the same long rows as the batch sink, appended exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def long_metrics(df: DataFrame, keys: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """(keys, metric, value): a row for each metric column that is not null."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(c).cast("double") for c in metrics]))
    return df.select(*keys, F.explode(pairs).alias("metric", "value")).where("value IS NOT NULL")


def logged_once(df: DataFrame, keys: tuple[str, ...], time: str, delay: str) -> DataFrame:
    """A stream without rows whose keys were logged before, as steps are that a resumed run trains again.

    A key is remembered for delay behind the latest time seen: a row that repeats it within that counts once, the state
    stays as small as the rows of that span. Rows of one key must not come further apart. Rows without a time count once too.
    """
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_metrics(
    df: DataFrame, path: str, checkpoint: str, run: str | None = None, step: str = "step", metrics: tuple[str, ...] = (),
    keys: tuple[str, ...] = (), every: int = 1, time: str | None = None, delay: str = "1 hour",
) -> StreamingQuery:
    """Streams rows (step, keys and metric columns) to path as (step, keys, metric, value) under run=<run>.

    Only each every-th step is logged. With a time column, a row whose run, step and keys were logged within delay counts
    once. run names the run; without it, df has a column run. The sink commits a micro-batch once, also if it is run again.
    """
    rows = df.withColumn("run", F.lit(run)) if run is not None else df
    names = metrics or tuple(c for c in df.columns if c not in (step, time, "run", *keys))
    logged = rows.where(F.col(step) % every == 0)
    if time:
        logged = logged_once(logged, ("run", step, *keys), time, delay)
    long = long_metrics(logged.withColumn(step, F.col(step).cast("long")), ("run", step, *keys), names).withColumnRenamed(step, "step")
    return long.writeStream.format("parquet").partitionBy("run").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path)
