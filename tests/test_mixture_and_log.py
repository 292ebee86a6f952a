import heapq
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.config import RunConfig
from corpusloom.functions import python_round
from corpusloom.operators import runlog, sampling, stats
from corpusloom.operators.tokenizers import append_eos
from corpusloom.sources import MissingSourceError, check_sources, files_by_folder, read_sources, read_token_report
from corpusloom.sources.writers import append_metrics
from corpusloom.streaming import stream_metrics


def table(spark, n=100):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("dataset"))


def test_sample_sizes(spark):
    df = table(spark)
    got = {r.dataset: r.n_rows for r in stats.rows_per_source(sampling.exact_sample(df, {"s0": 7, "s1": None}, "k")).collect()}
    assert got == {"s0": 7, "s1": 50}
    assert sampling.exact_sample(df, {"s0": 50}, "k").count() == 50
    with pytest.raises(Exception, match="sample larger"):
        sampling.exact_sample(df, {"s0": 51}, "k").count()


@pytest.mark.parametrize("n,test", [(1000, 100), (7, 1)])
def test_split_is_exact(spark, n, test):
    got = sampling.exact_split(spark.range(n), 0.1, "id")
    by = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert by == {"test": test, "train": n - test}
    assert got.select("id").distinct().count() == n


def test_head_and_limit(spark):
    assert [r.id for r in sampling.ordered_head(spark.range(9), 3, "id").collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="head larger"):
        sampling.ordered_head(spark.range(2), 3, "id").collect()
    assert [sampling.limit_samples(spark.range(9), n, "id").count() for n in (0, None, 5, 99)] == [9, 9, 5, 9]


def test_null_text_raises(spark):
    with pytest.raises(Exception, match="null text"):
        append_eos(spark.createDataFrame([(None,)], "text string"), "x").collect()


def test_budget(spark):
    def steps(budget, start=0):
        df = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "step long, n long")
        return runlog.budget_cut(df, "n", ["step"], F.col("step"), budget, start).count()

    assert (steps(7), steps(7, start=9), steps(10), steps(99)) == (2, 1, 2, 3)


def test_admission_and_topk_against_a_heap(spark):
    rng = random.Random(3)
    losses = [rng.randrange(6) / 2 for _ in range(60)]
    df = spark.createDataFrame([(x, i, f"p{i}") for i, x in enumerate(losses)], "val_loss double, step long, path string")
    kept, admitted = [], []
    for i, x in enumerate(losses):
        admitted.append(len(kept) < 4 or x < -kept[0][0])
        heapq.heappush(kept, (-x, i, f"p{i}"))
        if len(kept) > 4:
            heapq.heappop(kept)
    assert [r.admitted for r in runlog.checkpoint_admission(df, 4).orderBy("step").collect()] == admitted
    assert sorted(r.path for r in runlog.topk_checkpoints(df, 4).collect()) == sorted(p for _, _, p in kept)
    assert runlog.checkpoint_admission(df, 0).where("admitted").count() == 0


def test_best_is_the_lowest(spark):
    df = spark.createDataFrame([(3.0, 1, "a"), (1.0, 2, "b"), (2.0, 3, "c")], "val_loss double, step long, path string")
    assert runlog.best_checkpoint(df).first().path == "b"


def test_schedule(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "step long, val_loss double")
    got = [(r.action, r.carried_loss) for r in runlog.checkpoint_schedule(df, 3, 2).orderBy("step").collect()]
    assert got == [("none", None), ("save", float("inf")), ("validate", 2.0), ("save", 2.0), ("none", None), ("validate", 5.0)]


def test_rounding():
    assert python_round(1 / 16, 3) == 0.062


def test_config():
    c = RunConfig.from_dict({"mixture": {"weights": {"a": 1}}, "adapter": {}})
    assert c.adapter is not None and RunConfig.from_dict({"adapter": None}).adapter is None
    assert c.override("pack.max_seq_length=16").pack.max_seq_length == 16
    with pytest.raises(TypeError):
        RunConfig.from_dict({"pack": {"nope": 1}})
    with pytest.raises(ValueError):
        RunConfig.from_dict({"pack": {"max_seq_length": 0}})


def test_chain_by_command_line(spark, tmp_path):
    root = tmp_path / "data"
    for name, n in (("web", 30), ("books", 20), ("unlisted", 3)):
        (root / name).mkdir(parents=True)
        (root / name / "a.jsonl").write_text("".join(json.dumps({"text": f"{name} word{i} more", "x": 1}) + "\n" for i in range(n)))
    spark.createDataFrame([("web parquet row", 1)], "text string, y long").write.parquet(f"{root}/web/b.parquet")
    weights = json.dumps({"web": 12, "books": None})
    cli.main(["mix", "--weights", weights, "--root", str(root), "--output-path", f"{tmp_path}/mix"], spark)
    report = json.loads((tmp_path / "mix/data_distribution.json").read_text())
    assert report["total_rows"] == 32 and report["proportions"] == {"web": 0.375, "books": 0.625}
    cli.main(["tokenize", "--data-path", f"{tmp_path}/mix/data.parquet", "--test-size", "0.25", "--output-path", f"{tmp_path}/tok"], spark)
    tokens = read_token_report(spark, f"{tmp_path}/tok/token_distribution.json")
    assert tokens["total_tokens"] == 32 * 4
    cli.main(["pack", "--max-seq-length", "7", "--input-dir", f"{tmp_path}/tok"], spark)
    packed = json.loads((tmp_path / "tok/packed_train_data_7/packing_stats.json").read_text())
    assert packed["statistics"]["train"]["total_tokens"] == 24 * 4
    assert json.loads((tmp_path / "tok/packed_train_data_7/_run/config.yaml").read_text())["pack"] == {"max_seq_length": 7, "eos_token_id": 0}
    sizes = [r[0] for r in spark.read.parquet(f"{tmp_path}/tok/packed_train_data_7/train").orderBy("seq").selectExpr("size(input_ids)").collect()]
    assert sizes == [7] * 13 + [5]
    assert read_token_report(spark, f"{tmp_path}/none.json") is None
    with pytest.raises(MissingSourceError):
        read_sources(spark, str(root), ["web", "gone"])
    with pytest.raises(MissingSourceError):
        check_sources(["b"], ["a"])
    with pytest.raises(MissingSourceError):
        read_sources(spark, str(root), ["web"], exclude=["web"])


def test_metric_log_batch_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, None), (2, 0.25, 3.0)], "step long, loss double, norm double")
    append_metrics(rows, f"{tmp_path}/log", "r1")
    rows.write.parquet(f"{tmp_path}/in")
    stream_metrics(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/slog", f"{tmp_path}/cp", "r1").awaitTermination()
    key = lambda p: sorted(map(tuple, spark.read.parquet(p).select("step", "metric", "value").collect()))
    assert key(f"{tmp_path}/log") == key(f"{tmp_path}/slog") == [(1, "loss", 0.5), (2, "loss", 0.25), (2, "norm", 3.0)]


def test_sample_is_the_first_of_each_source(spark, monkeypatch):
    """Whole buckets and the cut one together are the n smallest shuffle keys."""
    for digits in (1, 3):
        monkeypatch.setattr(sampling, "DIGITS", digits)
        df = table(spark, 2000).withColumn("text", F.lit("t"))
        got = sampling.exact_sample(df, {"s0": 333, "s1": 1, "s2": 0}, "k")
        assert got.columns == df.columns
        keyed = df.withColumn("h", sampling.shuffle_key(0, "k")).orderBy("h").collect()
        want = {r.k for r in [x for x in keyed if x.dataset == "s0"][:333] + [x for x in keyed if x.dataset == "s1"][:1]}
        assert {r.k for r in got.collect()} == want


def test_equal_rows_are_split_to_size(spark, monkeypatch):
    """Most rows are the same text: sizes are exact nevertheless."""
    monkeypatch.setattr(sampling, "COPIES", 7)
    rows = [("same" if i % 3 else f"t{i}", "s0", i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "text string, dataset string, _n int").repartition(4)
    for n in (1, 50, 150, 299, 300):
        assert sampling.exact_sample(df, {"s0": n}, "text").count() == n
    for f in (0.001, 0.3, 0.5, 0.9):
        by = {r.split: r["count"] for r in sampling.threshold_split(df, f, "text").groupBy("split").count().collect()}
        assert by.get("test") == math.ceil(f * 300) and sum(by.values()) == 300
        assert sorted(map(tuple, sampling.threshold_split(df, f, "text").select("text", "dataset", "_n").collect())) == sorted(rows)
    assert sampling.threshold_split(df.limit(0), 0.5, "text").count() == 0
    assert sampling.exact_sample(df, {"s0": 0}, "text").count() == 0


def test_rows_without_a_key_are_not_drawn(spark):
    df = spark.createDataFrame([(None, "s0"), (None, "s0"), ("a", "s0")], "text string, dataset string")
    assert [r.text for r in sampling.exact_sample(df, {"s0": 1}, "text").collect()] == ["a"]
    with pytest.raises(ValueError, match="sample larger"):
        sampling.exact_sample(df, {"s0": 2}, "text")
    assert {r.split for r in sampling.threshold_split(df, 0.3, "text").where("text IS NULL").collect()} == {"train"}


def test_sample_reads_twice_and_shuffles_keys_alone(spark, tmp_path):
    table(spark, 500).withColumn("text", F.lit("a long text")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = sampling.exact_sample(df, {"s0": 20, "s1": 30}, "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and got.count() == 50
    keys = df.select(F.col("dataset").alias("group"), F.unhex(sampling.shuffle_key(0, "k")).alias("shuffle"), F.col("k").alias("key"))
    cuts = sampling._cut_rows(keys, {"s0": 20, "s1": 30})
    assert len(cuts.collect()) == 2
    final = cuts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    split = sampling.threshold_split(df, 0.1, "k")
    assert split.select("text", "split")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    by_rank = {r.k for r in sampling.exact_split(df, 0.1, "k").where("split = 'test'").collect()}
    assert {r.k for r in split.where("split = 'test'").collect()} == by_rank


def test_stop_rule_priorities(spark):
    df = spark.createDataFrame([(i, i // 4, i % 4, 5) for i in range(8)], "at long, epoch int, step int, n int")
    steps = lambda **k: [r.at for r in runlog.stop_cut(df, "n", ["at"], F.col("at"), **k).orderBy("at").collect()]
    assert steps() == list(range(8)) and steps(total_steps=2) == [0, 1, 4, 5] and steps(total_steps=0) == [0, 4]
    assert steps(total_steps=1, total_tokens=12) == [0, 1, 2] and steps(total_tokens=12, start=99) == [0]


def test_last_slot_and_resume(spark, tmp_path):
    runlog.save_last(spark, runlog.Counters(0, 3, 3, 9), str(tmp_path))
    last = runlog.save_last(spark, runlog.Counters(1, 7, 2, 50), str(tmp_path))
    assert runlog.resume(spark, last) == runlog.Counters(1, 7, 2, 50)
    (tmp_path / "weights-only").mkdir()
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd/state").write_text("a file")
    assert [runlog.resume(spark, x) for x in (None, f"{tmp_path}/weights-only", f"{tmp_path}/odd")] == [None] * 3


def test_prunes_against_a_heap(spark):
    rng = random.Random(4)
    rows = [("r", i, rng.randrange(5) / 2, f"p{i}") for i in range(40)]
    kept, want = [], []
    for _, i, loss, path in rows:
        heapq.heappush(kept, (-loss, i, path))
        if len(kept) > 3:
            want.append((i, heapq.heappop(kept)[2]))
    got = runlog.checkpoint_prunes(spark.createDataFrame(rows, "run string, step long, val_loss double, path string"), 3)
    assert [(r.step, r.removed) for r in got.orderBy("step").collect()] == want


def test_tasks_are_kept_apart(spark, tmp_path):
    def fails(df):
        raise NotImplementedError("later")

    load = lambda s: s.range(20)
    tasks = [
        runlog.EvalTask("a", load, lambda df: {"acc": df.where("id < 5").count() / df.count()}, ["id"], limit=10),
        runlog.EvalTask("b", load, fails, ["id"]),
        runlog.EvalTask("c", load, lambda df: {}, ["id"], enabled=False),
    ]
    results, errors = runlog.run_tasks(spark, tasks, 7, log_predictions=True, folder=f"{tmp_path}/eval")
    assert results == [{"task_name": "a", "step": 7, "metrics": {"acc": 0.5}, "num_samples": 10}] and errors == {"b": "later"}
    assert json.loads((tmp_path / "eval/a_step7.json").read_text())["num_samples"] == 10
    assert runlog.run_tasks(spark, tasks, 7, enabled=False, log_predictions=True, folder=f"{tmp_path}/none") == ([], {})
    runlog.run_tasks(spark, tasks, 8, folder=f"{tmp_path}/none")
    assert not (tmp_path / "none").exists()


def test_fetch_groups_by_the_first_folder(spark, tmp_path):
    for name in ("web/x/1.parquet", "web/2.parquet", "books/deep/er/3.parquet"):
        spark.createDataFrame([(name,)], "text string").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    assert set(files_by_folder(spark, f"{tmp_path}/in")) == {"web", "books"}
    cli.main(["fetch", "--root", f"{tmp_path}/in", "--output-path", f"{tmp_path}/out"], spark)
    assert {r.text for r in spark.read.parquet(f"{tmp_path}/out/web/train_data.parquet").collect()} == {"web/x/1.parquet", "web/2.parquet"}
    assert len(list((tmp_path / "out/books/train_data.parquet").glob("part-*"))) == 1


def test_tokens_are_made_once(spark, tmp_path):
    import public_tokenizers

    from corpusloom.operators.tokenizers import BpeTokenizer
    from corpusloom.plans.flows import exact_split_of

    rows = spark.createDataFrame([(f"text {i}", "web") for i in range(30)], "text string, dataset string")
    tokens = BpeTokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).tokenize(append_eos(exact_split_of(rows, 0.1, 0), "<eos>"))
    assert tokens._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert tokens.where("split = 'test'").count() == 3


def test_summaries():
    report = {"total_tokens": 12345, "tokens_per_source": {"a": 345, "b": 12000}, "percentages": {"a": 0.028, "b": 0.972}}
    assert stats.token_summary(report).splitlines()[:2] == ["Total tokens: 12,345", f"  {'b':<20} {'12,000':>15} (97.2%)"]
    assert "Total tokens: 4,096" in stats.packing_summary({"total_sequences": 2, "total_tokens": 4096, "avg_tokens_per_sequence": 2048.0, "avg_examples_per_sequence": 1.5})
