"""Queries over a run's log: budgets, reduces, schedules, checkpoint selection, counters and evaluation results.

Logs have one row per step (or step and rank). What a step takes over from earlier ones is carried by prefix_scan(), in
buckets of steps: one long run is not one task's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.history import checkpoint_history
from corpusloom.operators.prefix import Running, free_names, key_bucket, prefix_scan, prefix_sum
from corpusloom.shipping import ship_package


@dataclass
class Counters:
    """A run's counters; a manifest of one row restores them."""

    epoch: int = 0
    global_step: int = 0
    step_in_epoch: int = 0
    tokens_seen: int = 0

    def state_dict(self) -> dict[str, int]:
        return asdict(self)

    def load_state_dict(self, state: dict[str, int]) -> None:
        for k in self.state_dict():
            setattr(self, k, int(state[k]))

    def roll_epoch(self, stopped: bool) -> None:
        """The next epoch begins, unless the run was stopped inside this one."""
        if not stopped:
            self.epoch, self.step_in_epoch = self.epoch + 1, 0

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([tuple(self.state_dict().values())], "epoch long, global_step long, step_in_epoch long, tokens_seen long").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def restore(cls, spark: SparkSession, path: str) -> Counters:
        return cls(**spark.read.parquet(path).first().asDict())


def cumulative_tokens(df: DataFrame, tokens: str, order: Sequence[str], bucket: Column, start: int = 0) -> DataFrame:
    """df with tokens_before and tokens_seen, counted from start."""
    run = prefix_sum(df, F.col(tokens), order, bucket, "_before")
    return run.withColumn("tokens_before", F.col("_before") + start).withColumn("tokens_seen", F.col("_before") + start + F.col(tokens)).drop("_before")


def budget_cut(df: DataFrame, tokens: str, order: Sequence[str], bucket: Column, budget: int, start: int = 0) -> DataFrame:
    """The batches that a run consumes: the one that crosses the budget counts, and a run at its budget consumes one."""
    run = cumulative_tokens(df, tokens, order, bucket, start)
    first = df.agg(F.min(F.struct(*order)).alias("_first"))  # one row
    return run.join(F.broadcast(first)).where((F.struct(*order) == F.col("_first")) | (F.col("tokens_before") < budget)).drop("_first")


def stop_cut(df: DataFrame, tokens: str, order: Sequence[str], bucket: Column, total_tokens: int | None = None, total_steps: int | None = None, start: int = 0, epoch: str = "epoch", step: str = "step") -> DataFrame:
    """The batches that a run consumes by the first of its limits that is set: tokens, steps of an epoch, or all.

    With a token budget, total_steps has no part. A step limit holds within each epoch (step counts from 0 in it), and is
    looked at after a step: an epoch that begins at its limit consumes one batch.
    """
    if total_tokens is not None:
        return budget_cut(df, tokens, order, bucket, total_tokens, start)
    if total_steps is None:
        return df
    first = df.groupBy(epoch).agg(F.min(step).alias("_first"))  # a row per epoch
    return df.join(F.broadcast(first), epoch).where((F.col(step) < total_steps) | (F.col(step) == F.col("_first"))).drop("_first")


def mean_of_batch_means(df: DataFrame, loss: str, rank: str, batch: str) -> DataFrame:
    """Mean over ranks of the mean over batches of each batch's mean: not weighted by tokens."""
    per_batch = df.groupBy(rank, batch).agg(F.avg(loss).alias("_l"))
    return per_batch.groupBy(rank).agg(F.avg("_l").alias("_l")).agg(F.avg("_l").alias("val_loss"))


def reduce_per_step(df: DataFrame, step: str, value: str, how: str, name: str) -> DataFrame:
    """Sum or mean over ranks of each step."""
    if how not in ("sum", "mean"):
        raise ValueError(how)
    return df.groupBy(step).agg((F.sum if how == "sum" else F.avg)(value).alias(name))


def log_every_n(df: DataFrame, n: int, step: str = "step") -> DataFrame:
    """Steps (from 0 in their epoch) that are logged; step 0 is one."""
    return df.where(F.col(step) % n == 0)


def lr_at(step: Column, lr: float, warmup_steps: int, start_factor: float | None = None) -> Column:
    """Linear warm-up from start_factor * lr (by default lr / warmup_steps) to lr over warmup_steps, then constant."""
    sf = lr / warmup_steps if start_factor is None else start_factor
    return F.lit(lr) * (F.lit(sf) + F.lit(1 - sf) * F.least(step, F.lit(warmup_steps)) / F.lit(float(warmup_steps)))


def checkpoint_schedule(df: DataFrame, val_every: int, save_every: int, step: str = "step", val_loss: str = "val_loss", epoch: str | None = None, rows: int = 65_536) -> DataFrame:
    """df with action: 'validate' (top-k save), 'save' (periodic save only) or 'none', and the loss that a save carries.

    When both fall on one step, only the top-k path saves. A periodic save carries the epoch's last validation loss, or
    infinity if that is not above 0. The last loss is carried in buckets of rows steps.
    """
    validate = (F.col(step) + 1) % val_every == 0
    save = ((F.col(step) + 1) % save_every == 0) & ~validate
    of = F.col(epoch) if epoch else F.lit(0)
    seen = F.when(validate & F.col(val_loss).isNotNull(), F.struct(of.alias("epoch"), F.col(val_loss).alias("loss")))
    (name,) = free_names(df, "_seen")
    got = prefix_scan(df, [epoch, step] if epoch else [step], F.struct(of, key_bucket(step, rows)), **{name: Running("last", seen)})
    last = F.coalesce(F.when(F.col(name)["epoch"].eqNullSafe(of), F.col(name)["loss"]), F.lit(0.0))
    carried = F.when(validate | save, F.when(last > 0, last).otherwise(F.lit(float("inf"))))
    return got.withColumns({"action": F.when(validate, "validate").when(save, "save").otherwise("none"), "carried_loss": carried}).drop(name)


def scheduled_history(df: DataFrame, k: int, val_every: int, save_every: int, run: str | None = None) -> DataFrame:
    """The saves that checkpoint_schedule() asks for, on one list of k: step, action, val_loss, admitted, removed and kept.

    df has step and val_loss (and run). A validation saves only if its loss is admitted, a periodic save always does. Paths are
    named by step and loss.
    """
    due = checkpoint_schedule(df, val_every, save_every, epoch=run).where("action <> 'none'")
    saves = due.select(*([run] if run else []), "step", F.col("carried_loss").alias("val_loss"), (F.col("action") == "save").alias("forced"))
    named = saves.withColumn("path", F.concat(F.lit("checkpoint-step"), (F.col("step") + 1).cast("string")))
    return checkpoint_history(named, k, run)


def run_counters(df: DataFrame, order: Sequence[str], bucket: Column, tokens: str = "tokens", ended: str = "ended", restored: str = "restored") -> DataFrame:
    """df with epoch, step_in_epoch, global_step and tokens_seen, as a checkpoint behind each batch saves them.

    df has a row per trained batch, in order over all sessions of a run: its tokens; ended, if its epoch was over behind it (at
    its natural end, or cut by a step limit); restored, the counters {epoch, global_step, step_in_epoch, tokens_seen} of the
    checkpoint that the run resumed from before it, null if it just went on. A run that isn't restored begins with zeros.
    Counts are segmented scans: sums over the run, less what they were where a resume or an epoch's end stands.
    """
    n, t, e, resumed, over = free_names(df, "_n", "_t", "_e", "_resumed", "_over")
    is_over = F.coalesce(F.col(ended), F.lit(False))
    sums = prefix_scan(
        df, order, bucket,
        **{n: Running("sum", F.lit(1).cast("long"), False), t: Running("sum", F.col(tokens).cast("long"), False), e: Running("sum", is_over.cast("long"), False)},
    )
    back = F.col(restored)
    at = F.when(back.isNotNull(), F.struct(*[F.col(c).alias(k) for c, k in ((n, "n"), (t, "t"), (e, "e"))], back.alias("c")))
    got = prefix_scan(sums, order, bucket, **{resumed: Running("last", at), over: Running("last", F.when(is_over, F.col(n) + 1), False)})
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    base = lambda k: zero(F.col(resumed)["c"][k].cast("long"))
    first, done = zero(F.col(resumed)["n"]), F.col(n) + 1
    fresh = F.col(over).isNotNull() & (F.col(over) > first)  # an epoch ended in this session: not the one before a resume
    counters = {
        "epoch": base("epoch") + F.col(e) - zero(F.col(resumed)["e"]),
        "step_in_epoch": F.when(fresh, done - F.col(over)).otherwise(base("step_in_epoch") + done - first),
        "global_step": base("global_step") + done - first,
        "tokens_seen": base("tokens_seen") + F.col(t) + F.col(tokens) - zero(F.col(resumed)["t"]),
    }
    return got.select(*df.columns, *[v.cast("long").alias(k) for k, v in counters.items()])


def topk_checkpoints(df: DataFrame, k: int) -> DataFrame:
    """The k smallest losses; on equal losses the larger step, then the larger path, stays."""
    return df.orderBy("val_loss", F.desc("step"), F.desc("path")).limit(k)


def checkpoint_admission(df: DataFrame, k: int, order: str = "step", run: str | None = None) -> DataFrame:
    """df with admitted: whether a new checkpoint enters the top k of those before it in its run.

    It enters while fewer than k earlier losses are not larger than its own. k of 0 or less admits none. A row is known by its
    run and its place in order.
    """
    if k <= 0:
        return df.withColumn("admitted", F.lit(False))
    keys = [run, order] if run else [order]
    saves = df.select(*keys, "val_loss").withColumnRenamed(order, "step").withColumns({"path": F.lit(""), "forced": F.lit(False)})
    told = checkpoint_history(saves, k, run).withColumnRenamed("step", order)
    other = free_names(df, *[f"_key{i}" for i in range(len(keys))])
    told = told.select(*[F.col(k).alias(x) for k, x in zip(keys, other, strict=True)], "admitted")
    same = reduce(Column.__and__, [df[k].eqNullSafe(told[x]) for k, x in zip(keys, other, strict=True)])
    return df.join(told, same).drop(*other)


def checkpoint_prunes(df: DataFrame, k: int, run: str = "run") -> DataFrame:
    """(run, step, removed): the path that goes when a step's checkpoint, whatever its loss, makes them more than k.

    df has run, step, val_loss and path. The worst goes: the largest loss, of equal ones the smallest step, then path; it
    may be the new one. Steps after which none goes have no row.
    """
    saves = df.select(run, "step", "val_loss", "path").withColumn("forced", F.lit(True))
    return checkpoint_history(saves, k, run).where("removed IS NOT NULL").select(run, "step", "removed")


def last_checkpoints(df: DataFrame, run: str = "run") -> DataFrame:
    """(run, step, path): the slot that each run writes at its end, whatever its loss; it is never pruned."""
    return df.groupBy(run).agg(F.max("step").alias("step")).withColumn("path", F.concat(F.col(run).cast("string"), F.lit("/last")))


def save_last(spark: SparkSession, counters: Counters, folder: str) -> str:
    """folder/last/state, overwritten."""
    counters.save(spark, f"{folder}/last/state")
    return f"{folder}/last"


def save_last_of(counters: DataFrame, order: Sequence[str], folder: str) -> str:
    """The counters of the last row of run_counters(), in order, to folder/last/state, overwritten; written by the executors."""
    fields = ("epoch", "global_step", "step_in_epoch", "tokens_seen")
    last = counters.agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("c")).where("c IS NOT NULL").select("c.*")
    last.coalesce(1).write.mode("overwrite").parquet(f"{folder}/last/state")
    return f"{folder}/last"


def resume(spark: SparkSession, checkpoint: str | None) -> Counters | None:
    """The counters in checkpoint/state; None, for a run from the start, where no checkpoint is named or it has no state."""
    if checkpoint is None:
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return Counters.restore(spark, f"{checkpoint}/state") if fs.exists(p) and fs.getFileStatus(p).isDirectory() else None


def best_checkpoint(df: DataFrame) -> DataFrame:
    """The checkpoint with the lowest loss; on ties the larger step. No checkpoint gives no row."""
    return topk_checkpoints(df, 1)


def eval_metrics_long(df: DataFrame) -> DataFrame:
    """Rows (step, 'eval/<task>/<metric>', value) of enabled tasks that ended without an error."""
    ok = df.where(F.col("enabled") & F.col("error").isNull())
    return ok.select("step", "task_name", F.explode("metrics").alias("metric", "value")).select(
        "step", F.concat(F.lit("eval/"), "task_name", F.lit("/"), "metric").alias("metric"), "value"
    )


@dataclass
class EvalTask:
    """A benchmark: how its samples are loaded and what a batch of them scores (number right by metric)."""

    name: str
    load: Callable[[SparkSession], DataFrame]
    evaluate: Callable[[DataFrame], dict[str, float]]
    order: Sequence[str]
    enabled: bool = True
    limit: int | None = None
    options: dict = field(default_factory=dict)


def run_tasks(spark: SparkSession, tasks: Sequence[EvalTask], step: int, enabled: bool = True, log_predictions: bool = False, folder: str | None = None) -> tuple[list[dict], dict[str, str]]:
    """Results {task_name, step, metrics, num_samples} of the enabled tasks, and the errors of those that failed.

    A task that raises gives no result and stops no other. Results are written to folder only with log_predictions.
    """
    from corpusloom.operators.sampling import limit_samples
    from corpusloom.sources import write_eval_results

    results, errors = [], {}
    for task in tasks if enabled else ():
        if not task.enabled:
            continue
        try:
            samples = limit_samples(task.load(spark), task.limit, *task.order)
            results.append({"task_name": task.name, "step": step, "metrics": task.evaluate(samples), "num_samples": samples.count()})
        except Exception as e:  # a failing benchmark must not end the run
            errors[task.name] = str(e)
    if log_predictions and folder and results:
        write_eval_results(spark, results, folder)
    return results, errors


@dataclass
class BatchTask:
    """A benchmark that is scored batch by batch: score takes a pandas frame of samples and returns sums by metric."""

    name: str
    samples: DataFrame
    score: Callable
    order: Sequence[str]
    enabled: bool = True
    limit: int | None = None


#: Samples that are scored at once.
SCORED = 256


def evaluate(spark: SparkSession, tasks: Sequence[BatchTask], step: int, enabled: bool = True) -> DataFrame:
    """(task_name, step, num_samples, metrics, error) of every enabled task, all of them in one job.

    metrics are the batches' sums over the number of samples. A batch that raises is caught in its task: its benchmark has
    an error and no metrics, the others are as they would be without it. A limit of None or 0 takes all samples. A benchmark
    without samples has 0 and no metrics.
    """
    from corpusloom.operators.sampling import limit_samples

    ship_package(spark)
    on = [t for t in tasks if enabled and t.enabled]
    schema = "task_name string, sums map<string,double>, error string"
    none = spark.createDataFrame([(t.name, {}, None) for t in on], schema)

    def scored(task: BatchTask) -> DataFrame:
        name, score = task.name, task.score

        def run(frames):
            import pandas as pd

            for frame in frames:
                for at in range(0, len(frame), SCORED):
                    batch, error = frame.iloc[at : at + SCORED], None
                    try:
                        sums = {k: float(v) for k, v in score(batch).items()}
                    except Exception as e:  # a failing benchmark must not end the others
                        sums, error = {}, f"{type(e).__name__}: {e}"
                    yield pd.DataFrame({"task_name": [name], "sums": [{**sums, "": float(len(batch))}], "error": [error]})

        return limit_samples(task.samples, task.limit, *task.order).mapInPandas(run, schema)

    batches = reduce(DataFrame.unionByName, map(scored, on), none)
    parts = batches.select("task_name", "error", F.explode_outer("sums").alias("metric", "value")).groupBy("task_name", "metric").agg(F.sum("value").alias("value"), F.min("error").alias("error"))
    n = F.coalesce(F.max(F.when(F.col("metric") == "", F.col("value"))), F.lit(0.0))
    sums = F.collect_list(F.when(F.col("metric") != "", F.struct("metric", "value")))  # a few metrics a task
    by_task = parts.groupBy("task_name").agg(n.alias("n"), F.array_sort(sums).alias("sums"), F.min("error").alias("error"))
    means = F.map_from_entries(F.transform("sums", lambda x: F.struct(x["metric"], (x["value"] / F.col("n")).alias("value"))))
    return by_task.select("task_name", F.lit(step).cast("long").alias("step"), F.col("n").cast("long").alias("num_samples"), F.when(F.col("error").isNull(), means).alias("metrics"), "error")


def evaluation_log(results: DataFrame) -> DataFrame:
    """(step, metric, value) rows of evaluate(): 'eval/<task>/<metric>' and num_samples, or error = 1 for a failed benchmark."""
    own = F.when(F.col("error").isNotNull(), F.create_map(F.lit("error"), F.lit(1.0)))
    rest = F.map_concat(F.col("metrics"), F.create_map(F.lit("num_samples"), F.col("num_samples").cast("double")))
    return results.select("step", "task_name", F.explode(F.coalesce(own, rest)).alias("metric", "value")).select("step", F.concat(F.lit("eval/"), "task_name", F.lit("/"), "metric").alias("metric"), "value")
