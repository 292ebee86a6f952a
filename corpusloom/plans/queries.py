"""One query per operator over the driver's tables; each has the columns that its SQL in oracles.py has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import checkpoint_name, eval_file_name, source_of_top, tokens_checksum
from corpusloom.operators import batching, packing, runlog, sampling, stats
from corpusloom.operators.prefix import key_bucket, prefix_sum
from corpusloom.operators.tokenizers import BpeTokenizer, NativeTokenizer, append_eos, native_count, native_ids
from corpusloom.shipping import ship_package
from corpusloom.sources import (
    dataset_manifest,
    file_table,
    manifest_difference,
    read_packed,
    read_source,
    read_split,
    replace_splits,
    scan_report,
    write_one_file,
    write_packed,
    write_report,
    write_splits,
)
from corpusloom.storage import bucketed, scratch_path
from corpusloom.streaming import stream_metrics

#: Parameters of the queries; oracles.py has the same.
LENGTH, BATCH, CUT, EOS_TEXT = 2048, 16, 512, "<|eos|>"
SAMPLE = {"src0": 10, "src1": 5, "src2": 7, "src3": None}
DECLARED = ["src0", "src1", "src2", "absent_a", "absent_b"]
FRACTION, HEAD, BUDGET, START, TOP = 0.1, 50, 200_000, 1_000, 5
VAL_EVERY, SAVE_EVERY, LOG_EVERY, WARMUP, RATE = 10, 4, 7, 500, 0.0003
SESSIONS = [[2, 1, 2, 2], [1, 0, 1]]
BPE_NAME = "byte_bpe_50k.json"


def _docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(*(columns or ("doc_id", "text", F.col("source").alias("dataset"))))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).withColumn("num_tokens", native_count(F.col("text")))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return NativeTokenizer().tokenize(_docs(spark, d)).drop("text")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _long(c: str):
    return F.col(c).cast("long").alias(c)


def scan_project_text(spark, d):
    return _docs(spark, d, "text")


def tag_source(spark, d):
    return _docs(spark, d, "doc_id", "text").withColumn("dataset", F.lit("web"))


def drop_helper_columns(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").drop("n_chars", "lang", "attention_mask")


def exclude_sources(spark, d):
    paths = _docs(spark, d, "doc_id", F.concat(F.lit("data/"), "source", F.lit("/part.parquet")).alias("path"))
    return paths.where(~F.col("path").contains("src1"))


def mixture_whitelist(spark, d):
    return stats.rows_per_source(_docs(spark, d).where(F.col("dataset").isin(DECLARED)))


def missing_sources(spark, d):
    declared = spark.createDataFrame([(x,) for x in DECLARED], "dataset string")
    return declared.join(_docs(spark, d).select("dataset").distinct(), "dataset", "left_anti")


def append_eos_query(spark, d):
    return append_eos(_docs(spark, d, "doc_id", "text"), EOS_TEXT)


def tokenize_native(spark, d):
    ids = _docs(spark, d).select("doc_id", native_ids(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), tokens_checksum(F.col("ids")).alias("checksum"))


def tokenize_bpe(spark, d):
    import public_tokenizers

    ship_package(spark)
    got = BpeTokenizer.from_file(public_tokenizers.path(BPE_NAME)).tokenize(append_eos(_docs(spark, d, "doc_id", "text"), EOS_TEXT))
    return got.select("doc_id", F.col("num_tokens").alias("n_tokens"), tokens_checksum(F.col("input_ids")).alias("checksum"))


def token_counts(spark, d):
    return _counted(spark, d).select("doc_id", "num_tokens")


def token_distribution(spark, d):
    return stats.token_distribution(_counted(spark, d)).select("dataset", "tokens", "percentage")


def token_distribution_sorted(spark, d):
    dist = stats.token_distribution(_counted(spark, d)).select("dataset", "tokens", "percentage")
    return stats.with_declared_sources(dist, DECLARED).orderBy(F.desc("percentage"), "dataset")


def pack_sequences(spark, d):
    blocks = packing.pack(_tokens(spark, d), LENGTH, "doc_id")
    return blocks.select("seq", F.size("input_ids").cast("long").alias("n_tokens"), "n_docs", tokens_checksum(F.col("input_ids")).alias("checksum"))


def pack_doc_spans(spark, d):
    return packing.doc_spans(_counted(spark, d), LENGTH, "doc_id").select("doc_id", "seq", "block_offset", "doc_offset", "n")


def pack_tail(spark, d):
    spans = packing.doc_spans(_counted(spark, d), LENGTH, "doc_id")
    return spans.groupBy("seq").agg(F.sum("n").alias("n_tokens")).orderBy(F.desc("seq")).limit(1)


def packing_stats(spark, d):
    s = packing.packing_stats(_counted(spark, d), LENGTH)
    return s.select("total_sequences", "total_tokens", "num_examples", *[F.round(c, 6).alias(c) for c in ("avg_tokens_per_sequence", "avg_examples_per_sequence")])


def mixture_sample(spark, d):
    weights = {k: v for k, v in SAMPLE.items() if v is not None}
    return sampling.exact_sample(_docs(spark, d), weights, "doc_id").select("doc_id", "dataset", "text")


def mixture_sample_keep_all(spark, d):
    return sampling.exact_sample(_docs(spark, d), SAMPLE, "doc_id").select("doc_id", "dataset")


def rows_per_source(spark, d):
    return stats.rows_per_source(sampling.exact_sample(_docs(spark, d), SAMPLE, "doc_id"))


def mixture_proportions(spark, d):
    return stats.mixture_proportions(sampling.exact_sample(_docs(spark, d), SAMPLE, "doc_id"))


def train_test_split(spark, d):
    return sampling.exact_split(_docs(spark, d, "doc_id"), FRACTION, "doc_id").select("doc_id", "split", "shuffle_rank")


def val_head(spark, d):
    return sampling.ordered_head(_docs(spark, d, "doc_id", "text"), HEAD, "doc_id")


def eval_limit(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    some = sampling.limit_samples(items, 5, "item_id").select(F.lit("five").alias("setting"), "item_id")
    every = sampling.limit_samples(items, 0, "item_id").select(F.lit("zero").alias("setting"), "item_id")
    return some.unionByName(every).unionByName(sampling.limit_samples(items, None).select(F.lit("none").alias("setting"), "item_id"))


def union_sources(spark, d):
    convs = spark.read.parquet(f"{d}/conversations.parquet").select("text", F.lit("conversations").alias("dataset"))
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("text", F.lit("benchmark").alias("dataset"))
    return _docs(spark, d, "text", F.col("source").alias("dataset")).unionByName(convs).unionByName(items)


def source_file_manifest(spark, d):
    """Files by the folder they lie in, by a scan; the folders of tables stand for sources."""
    root, _, name = d.rstrip("/").rpartition("/")
    files = file_table(spark, f"{root}/{name}", "*.parquet", digest=False).where(~F.col("path").contains("/"))
    return files.select(F.lit(name).alias("dataset"), F.col("path").alias("name"))


def files_by_top_folder(spark, d):
    """Files below the tables' folder, at any depth, by the first part of their path; by a scan."""
    name = d.rstrip("/").rpartition("/")[2]
    files = file_table(spark, d, "*.parquet", digest=False)
    return files.select(F.lit(name).alias("dataset"), source_of_top(F.concat(F.lit(f"{name}/"), "path")).alias("top"), "path")


def file_differences(spark, d):
    """Documents as a folder of text files per source, twice; the second time a source is gone, one is changed, one is new."""
    docs = _docs(spark, d)

    def written(df, name):
        path = scratch_path(spark, name)
        df.repartition("dataset").sortWithinPartitions("dataset", "doc_id").select("dataset", "text").write.partitionBy("dataset").text(path)
        return dataset_manifest(file_table(spark, path, "*.txt")).withColumn("dataset", F.substring_index("dataset", "=", -1))

    other = docs.where("dataset <> 'src1'").withColumn("text", F.when(F.col("dataset") == "src2", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    added = docs.where("dataset = 'src3'").withColumn("dataset", F.lit("extra"))
    return manifest_difference(written(docs, "old"), written(other.unionByName(added), "new"))


def token_report_read(spark, d):
    """The token report is written as JSON, scanned with declared types and joined with the declared sources."""
    path = scratch_path(spark, "report") + "/token_distribution.json"
    write_report(stats.token_report_row(stats.token_distribution(_counted(spark, d))), path)
    return stats.token_report_rows(scan_report(spark, path, stats.TOKEN_REPORT), DECLARED)


def metric_stream(spark, d):
    """Events as four ranks' losses, each third of ten logged again five minutes later, streamed; each step's mean of what is logged."""
    schema = _events(spark, d).schema
    # a pattern, as a stream's path must be a folder otherwise
    ranks = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").select(
        F.floor(F.col("event_id") / 4).alias("step"),
        (F.col("event_id") % 4).alias("rank"),
        F.explode(F.when(F.col("event_id") % 10 < 3, F.array("ts", F.col("ts") + F.expr("INTERVAL 5 MINUTES"))).otherwise(F.array("ts"))).alias("at"),
        F.col("value").alias("loss"),
        (F.col("event_id") % 7 + 1).alias("tokens"),
    )
    path = scratch_path(spark, "log")
    stream_metrics(ranks, path, f"{path}-state", "run", keys=("rank",), every=LOG_EVERY, time="at").awaitTermination()
    log = spark.read.parquet(path)
    value = lambda name: F.when(F.col("metric") == name, F.col("value"))
    return log.groupBy("step").agg(F.round(F.avg(value("loss")), 4).alias("train_loss"), F.sum(value("tokens")).cast("long").alias("tokens"))


def scan_jsonl_parquet_union(spark, d):
    """Documents as JSON lines and items as Parquet: one source in both formats."""
    lines = scratch_path(spark, "source") + "/documents.jsonl"
    spark.read.parquet(f"{d}/documents.parquet").select("text", "doc_id").write.json(lines)
    return read_source(spark, [lines, f"{d}/benchmark.parquet"], "mixed")


def merge_source_files(spark, d):
    """Two tables' texts, merged to one file and read again."""
    out = scratch_path(spark, "merged")
    parts = [f"{out}/{n}" for n in ("a", "b")]
    for part, name in zip(parts, ("documents", "benchmark"), strict=True):
        spark.read.parquet(f"{d}/{name}.parquet").select("text").write.parquet(part)
    write_one_file(spark, parts, f"{out}/train_data.parquet")
    return spark.read.parquet(f"{out}/train_data.parquet")


def rewrite_split(spark, d):
    """Splits are written, the test split is written anew with other texts, and both are read back."""
    path = scratch_path(spark, "splits")
    split = sampling.exact_split(_docs(spark, d, "doc_id", "text"), FRACTION, "doc_id").drop("shuffle_rank").withColumn("num_tokens", F.lit(0))
    write_splits(split, path)
    replace_splits(read_split(spark, path).where("split = 'test'").select("doc_id", F.concat(F.lit("new: "), "text").alias("text"), "split", F.lit(0).alias("num_tokens")), path)
    train, test = (read_split(spark, path, x).withColumn("split", F.lit(x)) for x in ("train", "test"))
    return train.unionByName(test).select("doc_id", "split", "text")


def packed_slice(spark, d):
    """Blocks are written in folders of 16 and those from 20 to before 50 are read back in order."""
    path = scratch_path(spark, "packed")
    write_packed(packing.pack(_tokens(spark, d), LENGTH, "doc_id"), path, rows=16)
    got = read_packed(spark, path, 20, 50, rows=16)
    return got.select("seq", F.size("input_ids").cast("long").alias("n_tokens"), tokens_checksum(F.col("input_ids")).alias("checksum"))


def token_offsets(spark, d):
    return prefix_sum(_counted(spark, d).select("doc_id", "num_tokens"), F.col("num_tokens"), ["doc_id"], key_bucket("doc_id"), "token_offset")


def cumulative_tokens(spark, d):
    return runlog.cumulative_tokens(_counted(spark, d).select("doc_id", "num_tokens"), "num_tokens", ["doc_id"], key_bucket("doc_id"), START)


def token_budget_cut(spark, d):
    rows = _counted(spark, d).select("doc_id", "num_tokens")
    return runlog.budget_cut(rows, "num_tokens", ["doc_id"], key_bucket("doc_id"), BUDGET, START).select("doc_id", "num_tokens", "tokens_seen")


def batch_assign(spark, d):
    return batching.assign_batches(_docs(spark, d, "doc_id"), BATCH, ["doc_id"])


def resume_skip_batches(spark, d):
    return batching.skip_batches(batch_assign(spark, d), 3)


def shard_batches(spark, d):
    return batching.shard_batches(batch_assign(spark, d), 1, 4)


def resume_other_world(spark, d):
    """Who takes the batches of a run of four ranks, stopped at unlike places, then three, then five."""
    return batching.resume_sharded(batch_assign(spark, d), SESSIONS, 5).select("doc_id", "session", "rank", "turn")


def _collated(spark, d):
    """Documents are dealt by id as texts and stored as tokens; batches are made of the stored table."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _docs(spark, d, "doc_id", "text").repartition(buckets, "doc_id")
    stored = bucketed(NativeTokenizer().tokenize(dealt).select("doc_id", "num_tokens", "input_ids"), "tokens", "doc_id", buckets)
    return batching.collate_stored(stored, BATCH, CUT, "doc_id")


def collate_pad(spark, d):
    return _collated(spark, d).select("doc_id", "batch_id", F.size("input_ids").cast("long").alias("width"), tokens_checksum(F.col("input_ids")).alias("checksum"))


def attention_mask(spark, d):
    m = F.col("attention_mask")
    return _collated(spark, d).select("doc_id", F.size(m).cast("long").alias("width"), F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_real"), tokens_checksum(m).alias("checksum"))


def label_mask(spark, d):
    x = F.col("labels")
    return _collated(spark, d).select("doc_id", F.size(F.filter(x, lambda v: v == -100)).cast("long").alias("n_ignored"), tokens_checksum(x).alias("checksum"))


def tokens_per_step(spark, d):
    rows = batching.assign_batches(_counted(spark, d).select("doc_id", "num_tokens"), BATCH, ["doc_id"])
    return runlog.reduce_per_step(rows, "batch_id", "num_tokens", "sum", "tokens")


def loss_per_step(spark, d):
    ev = _events(spark, d).select((F.col("event_id") % 97).alias("step"), F.col("value").cast("decimal(18,6)").alias("value"))
    return runlog.reduce_per_step(ev, "step", "value", "sum", "loss_sum").withColumn("loss_sum", F.col("loss_sum").cast("double"))


def mean_loss_per_step(spark, d):
    ev = _events(spark, d).select((F.col("event_id") % 97).alias("step"), "value")
    return runlog.reduce_per_step(ev, "step", "value", "mean", "loss").select("step", F.round("loss", 4).alias("loss"))


def _epochs(spark, d):
    """Batches of epochs of 200; each seventh epoch is resumed at step 150."""
    step, epoch = F.col("event_id"), F.floor(F.col("event_id") / 200)
    at = step % 200 + F.when(epoch % 7 == 3, 150).otherwise(0)
    return _events(spark, d).select(step, epoch.cast("int").alias("epoch"), at.alias("step"), (step % 7 + 1).alias("n"))


def stop_at_steps(spark, d):
    return runlog.stop_cut(_epochs(spark, d), "n", ["event_id"], key_bucket("event_id"), total_steps=120).select("epoch", "step")


def stop_at_tokens_first(spark, d):
    got = runlog.stop_cut(_epochs(spark, d), "n", ["event_id"], key_bucket("event_id"), total_tokens=20_000, total_steps=1, start=40)
    return got.select("epoch", "step", "tokens_seen")


def epoch_counters(spark, d):
    """Counters of every event as a trained batch: epochs end each 200, a step limit cuts some, each 1,500 the run is resumed."""
    i = F.col("event_id")
    back = F.struct(F.floor(i / 400).alias("epoch"), (i - 50).alias("global_step"), F.floor(i % 200 / 2).alias("step_in_epoch"), (i * 3).alias("tokens_seen"))
    log = _events(spark, d).select(
        i, (i % 7 + 1).alias("tokens"), (((i + 1) % 200 == 0) | (i % 997 == 500)).alias("ended"), F.when(i % 1500 == 1499, back).alias("restored")
    )
    got = runlog.run_counters(log, ["event_id"], key_bucket("event_id", 1024))
    return got.select("event_id", "epoch", "step_in_epoch", "global_step", "tokens_seen")


def resume_from_last(spark, d):
    """A run over all documents in batches, with epochs of 10: its last counters, saved in the last slot and found again."""
    steps = tokens_per_step(spark, d).withColumns({"ended": F.col("batch_id") % 10 == 9, "restored": F.lit(None).cast("struct<epoch:long,global_step:long,step_in_epoch:long,tokens_seen:long>")})
    counted = runlog.run_counters(steps, ["batch_id"], key_bucket("batch_id"), tokens="tokens")
    last = runlog.save_last_of(counted, ["batch_id"], scratch_path(spark, "run"))
    none = runlog.resume(spark, last.removesuffix("last") + "none") is None
    return spark.read.parquet(f"{last}/state").withColumn("fresh", F.lit(none))


def packing_summary(spark, d):
    s = packing.packing_stats(_counted(spark, d), LENGTH)
    return s.select(
        F.format_number("total_sequences", 0).alias("sequences"),
        F.format_number("total_tokens", 0).alias("tokens"),
        F.format_string("%.1f", F.round("avg_tokens_per_sequence", 4)).alias("per_sequence"),
        F.format_string("%.2f", F.round("avg_examples_per_sequence", 4)).alias("examples"),
    )


def val_loss_mean_of_means(spark, d):
    ev = _events(spark, d).select((F.col("event_id") % 4).alias("rank"), (F.col("event_id") / F.lit(64)).cast("long").alias("batch"), "value")
    return runlog.mean_of_batch_means(ev, "value", "rank", "batch").select(F.round("val_loss", 4).alias("val_loss"))


def log_every_n(spark, d):
    return runlog.log_every_n(_events(spark, d).select(F.col("event_id").alias("step"), F.round("value", 4).alias("loss")), LOG_EVERY)


def lr_schedule(spark, d):
    step = F.col("event_id")
    return _events(spark, d).select(step.alias("step"), F.round(runlog.lr_at(step, RATE, WARMUP), 10).alias("lr"))


def _runs(spark, d):
    """Events as validations: a user is a run, an event a step."""
    return _events(spark, d).select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("val_loss"))


def checkpoint_schedule(spark, d):
    got = runlog.checkpoint_schedule(_runs(spark, d), VAL_EVERY, SAVE_EVERY, epoch="run")
    return got.select("run", "step", "action", F.when(F.col("carried_loss") < float("inf"), F.col("carried_loss")).alias("carried_loss"))


def checkpoint_schedule_one_run(spark, d):
    got = runlog.checkpoint_schedule(_runs(spark, d), VAL_EVERY, SAVE_EVERY, rows=1024)
    return got.select("step", "action", F.when(F.col("carried_loss") < float("inf"), F.col("carried_loss")).alias("carried_loss"))


def checkpoint_history(spark, d):
    """All events as one run: what each save does to the kept checkpoints, and what goes."""
    got = runlog.scheduled_history(_runs(spark, d), TOP, VAL_EVERY, SAVE_EVERY)
    return got.select("step", "forced", "admitted", "removed", F.array_join("kept", ",").alias("kept"))


def _checkpoints(spark, d):
    return _runs(spark, d).select("val_loss", "step", F.concat(F.lit("ckpt/"), F.col("step").cast("string")).alias("path"))


def topk_checkpoints(spark, d):
    return runlog.topk_checkpoints(_checkpoints(spark, d), TOP)


def best_checkpoint(spark, d):
    return runlog.best_checkpoint(_checkpoints(spark, d))


def checkpoint_admission(spark, d):
    return runlog.checkpoint_admission(_runs(spark, d), TOP, run="run").select("run", "step", "admitted")


def checkpoint_prunes(spark, d):
    saved = _runs(spark, d).withColumn("path", F.concat(F.lit("ckpt/"), F.col("step").cast("string")))
    return runlog.checkpoint_prunes(saved, TOP)


def last_checkpoints(spark, d):
    return runlog.last_checkpoints(_runs(spark, d))


def checkpoint_names(spark, d):
    ev = _events(spark, d)
    return ev.select("event_id", checkpoint_name(F.col("event_id"), F.col("value").cast("decimal(18,4)").cast("double")).alias("name"), eval_file_name(F.col("event_type"), F.col("event_id")).alias("eval_file"))


def eval_metrics_long(spark, d):
    ev = _events(spark, d)
    results = ev.select(
        F.col("event_id").alias("step"),
        F.col("event_type").alias("task_name"),
        (F.col("user_id") % 2 == 0).alias("enabled"),
        F.when(F.col("event_id") % 5 == 0, "boom").alias("error"),
        F.create_map(F.lit("acc"), F.col("value"), F.lit("user"), F.col("user_id").cast("double")).alias("metrics"),
    )
    return runlog.eval_metrics_long(results)


def evaluate_tasks(spark, d):
    """Four benchmarks in one job: limits of 0, none and 5, and one that fails."""
    items, docs = spark.read.parquet(f"{d}/benchmark.parquet"), _docs(spark, d, "doc_id", "text")

    def fails(batch):
        raise NotImplementedError("later")

    tasks = [
        runlog.BatchTask("long", items, lambda b: {"share": (b["text"].str.len() > 200).sum(), "chars": b["text"].str.len().sum()}, ["item_id"], limit=0),
        runlog.BatchTask("words", docs, lambda b: {"the": b["text"].str.contains("the", regex=False).sum()}, ["doc_id"]),
        runlog.BatchTask("few", items, lambda b: {"chars": b["text"].str.len().sum()}, ["item_id"], limit=5),
        runlog.BatchTask("broken", docs, fails, ["doc_id"]),
        runlog.BatchTask("off", docs, fails, ["doc_id"], enabled=False),
    ]
    return runlog.evaluation_log(runlog.evaluate(spark, tasks, 7)).withColumn("value", F.round("value", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.removesuffix("_query"): f
    for f in (
        scan_project_text, tag_source, drop_helper_columns, exclude_sources, mixture_whitelist, missing_sources,
        append_eos_query, tokenize_native, tokenize_bpe, token_counts, token_distribution, token_distribution_sorted,
        pack_sequences, pack_doc_spans, pack_tail, packing_stats, mixture_sample, mixture_sample_keep_all,
        rows_per_source, mixture_proportions, train_test_split, val_head, eval_limit, union_sources,
        source_file_manifest, files_by_top_folder, file_differences, token_report_read, metric_stream, scan_jsonl_parquet_union, merge_source_files, rewrite_split, packed_slice, token_offsets, cumulative_tokens, token_budget_cut,
        batch_assign, resume_skip_batches, shard_batches, resume_other_world, collate_pad, attention_mask, label_mask, tokens_per_step,
        loss_per_step, mean_loss_per_step, stop_at_steps, stop_at_tokens_first, epoch_counters, resume_from_last, packing_summary, val_loss_mean_of_means, log_every_n, lr_schedule, checkpoint_schedule, checkpoint_schedule_one_run, checkpoint_history, topk_checkpoints,
        best_checkpoint, checkpoint_admission, checkpoint_prunes, last_checkpoints, checkpoint_names, eval_metrics_long, evaluate_tasks,
    )
}
