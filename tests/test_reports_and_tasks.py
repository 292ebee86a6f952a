"""Streams of metrics, reports and files as tables, benchmarks in one job, layered configuration."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.config import ConfigError, RunConfig, compose, compose_files
from corpusloom.operators import runlog, stats
from corpusloom.sources import dataset_manifest, file_table, manifest_difference, scan_report, write_report
from corpusloom.streaming import stream_metrics


def test_steps_that_are_logged_again_count_once(spark, tmp_path):
    """A resumed run logs steps 2 and 3 again, in files that arrive in later micro-batches."""
    kind = "step long, rank int, at timestamp, loss double"
    at = lambda step, late=0: f"2024-01-01 00:{step:02d}:{late:02d}"

    def arrive(name, rows):
        df = spark.createDataFrame([(s, r, t, v) for s, r, t, v in rows], "step long, rank int, at string, loss double")
        df.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        stream_metrics(stream, f"{tmp_path}/log", f"{tmp_path}/state", "r", keys=("rank",), every=1, time="at", delay="10 minutes").awaitTermination()

    arrive("a", [(s, r, at(s), float(s)) for s in range(4) for r in (0, 1)])
    arrive("b", [(s, r, at(s + 3, 5), -1.0) for s in (2, 3) for r in (0, 1)] + [(4, r, at(8), 4.0) for r in (0, 1)])
    arrive("c", [(5, 0, at(9), None), (6, 0, at(9), 6.0)])
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/log").select("run", "step", "rank", "metric", "value").collect()))
    assert got == sorted([("r", s, r, "loss", float(s)) for s in range(5) for r in (0, 1)] + [("r", 6, 0, "loss", 6.0)])


def test_every_nth_step_of_several_runs(spark, tmp_path):
    spark.createDataFrame([("a", s, float(s)) for s in range(6)] + [("b", 3, 9.0)], "run string, step long, loss double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("run string, step long, loss double").parquet(f"{tmp_path}/in")
    stream_metrics(stream, f"{tmp_path}/log", f"{tmp_path}/state", every=3).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/log").select("run", "step", "value").collect()))
    assert got == [("a", 0, 0.0), ("a", 3, 3.0), ("b", 3, 9.0)]


def test_reports_are_tables(spark, tmp_path):
    counts = spark.createDataFrame([("a", 3), ("b", 1), ("a", 0)], "dataset string, num_tokens long")
    row = stats.token_report_row(stats.token_distribution(counts))
    write_report(row, f"{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"total_tokens": 4, "tokens_per_source": {"a": 3, "b": 1}, "percentages": {"a": 0.75, "b": 0.25}}
    assert stats.token_report(counts) == json.loads((tmp_path / "r.json").read_text())
    read = scan_report(spark, f"{tmp_path}/r.json", stats.TOKEN_REPORT)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(stats.token_report_rows(read)) == [("a", 3, 0.75, 4), ("b", 1, 0.25, 4)]
    assert rows(stats.token_report_rows(read, ["b", "gone"])) == [("b", 1, 0.25, 4), ("gone", 0, 0.0, 4)]
    (tmp_path / "part.json").write_text('{\n "percentages": {"x": 0.5}\n}')
    part = scan_report(spark, f"{tmp_path}/part.json", stats.TOKEN_REPORT)
    assert rows(stats.token_report_rows(part)) == [("x", 0, 0.5, 0)]
    (tmp_path / "none.json").write_text("{}")
    assert rows(stats.token_report_rows(scan_report(spark, f"{tmp_path}/none.json", stats.TOKEN_REPORT))) == []
    both = scan_report(spark, [f"{tmp_path}/r.json", f"{tmp_path}/part.json"], stats.TOKEN_REPORT)
    assert stats.token_report_rows(both).count() == 3
    empty = stats.token_report_row(stats.token_distribution(counts.limit(0)))
    write_report(empty, f"{tmp_path}/empty.json")
    assert json.loads((tmp_path / "empty.json").read_text()) == {"total_tokens": 0, "tokens_per_source": {}, "percentages": {}}


def test_files_by_size_and_digest(spark, tmp_path):
    def put(root, **files):
        for name, text in files.items():
            p = tmp_path / root / name.replace("__", "/")
            p.parent.mkdir(parents=True, exist_ok=True)
            (p.parent / (p.name + ".txt")).write_text(text)
        return file_table(spark, f"{tmp_path}/{root}", "*.txt")

    old = put("old", a__x="1", a__deep__y="22", b__x="3", c__x="same", d__x="44")
    new = put("new", a__z="1", a__y="22", b__x="4", c__x="same", e__x="5")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(dataset_manifest(old).select("dataset", "n_files", "bytes")) == [("a", 2, 3), ("b", 1, 1), ("c", 1, 4), ("d", 1, 2)]
    got = rows(manifest_difference(dataset_manifest(old), dataset_manifest(new)))
    assert got == [("a", "same", 3, 3), ("b", "changed", 1, 1), ("c", "same", 4, 4), ("d", "gone", 2, None), ("e", "new", None, 1)]
    by_file = {r.path: r.status for r in manifest_difference(old, new, "path", "sha256").collect()}
    assert by_file["a/deep/y.txt"] == "gone" and by_file["b/x.txt"] == "changed" and by_file["c/x.txt"] == "same"
    plain = file_table(spark, f"{tmp_path}/old", "x.txt", digest=False)
    assert plain.where("sha256 IS NULL").count() == 4
    scan = next(x for x in plain.select("path", "bytes")._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "ReadSchema: struct<path:string,length:bigint>" in scan


def test_benchmarks_in_one_job(spark, monkeypatch):
    monkeypatch.setattr(runlog, "SCORED", 3)
    samples = spark.range(20).withColumn("text", F.lit("abcd"))

    def odd(batch):
        if (batch["id"] == 13).any():
            raise ValueError("thirteen")
        return {"odd": (batch["id"] % 2).sum()}

    tasks = [
        runlog.BatchTask("all", samples, lambda b: {"even": (b["id"] % 2 == 0).sum(), "chars": b["text"].str.len().sum()}, ["id"], limit=0),
        runlog.BatchTask("fails", samples, odd, ["id"]),
        runlog.BatchTask("first", samples, odd, ["id"], limit=4),
        runlog.BatchTask("none", samples.limit(0), odd, ["id"]),
        runlog.BatchTask("off", samples, odd, ["id"], enabled=False),
    ]
    got = {r.task_name: (r.step, r.num_samples, r.metrics, r.error) for r in runlog.evaluate(spark, tasks, 9).collect()}
    assert got == {
        "all": (9, 20, {"even": 0.5, "chars": 4.0}, None),
        "fails": (9, 20, None, "ValueError: thirteen"),
        "first": (9, 4, {"odd": 0.5}, None),
        "none": (9, 0, {}, None),
    }
    log = sorted((r.metric, r.value) for r in runlog.evaluation_log(runlog.evaluate(spark, tasks[1:3], 9)).collect())
    assert log == [("eval/fails/error", 1.0), ("eval/first/num_samples", 4.0), ("eval/first/odd", 0.5)]
    assert runlog.evaluate(spark, tasks, 9, enabled=False).count() == 0


FILES = {
    "run": {"defaults": [{"model": "small"}, "base", "_self_"], "steps": 5, "model": {"heads": 8}, "pack": {"max_seq_length": 16}},
    "first": {"defaults": ["_self_", {"model": "small"}], "model": {"width": 1, "own": 2}},
    "base": {"steps": 1, "seed": 3, "pack": {"eos_token_id": 7}},
    "model/small": {"width": 64, "heads": 4, "list": [1, 2]},
    "model/large": {"defaults": ["small"], "width": 512, "list": [3]},
}


def test_layers():
    read = lambda path: json.dumps(FILES[path]) if path in FILES else None
    run = {"model": {"width": 64, "heads": 8, "list": [1, 2]}, "steps": 5, "seed": 3, "pack": {"max_seq_length": 16, "eos_token_id": 7}}
    assert compose(read, "run") == run
    assert compose(read, "first") == {"model": {"width": 64, "own": 2, "heads": 4, "list": [1, 2]}}
    large = compose(read, "run", ["model=large", "steps=9", "model.heads=2", "+new.deep=x", "~seed"])
    assert large == {**{k: v for k, v in run.items() if k != "seed"}, "model": {"width": 512, "heads": 2, "list": [3]}, "steps": 9, "new": {"deep": "x"}}
    assert compose(read, "run", ["pack.max_seq_length=null", "steps=[1, 2]"])["steps"] == [1, 2]
    for bad in ("nope=1", "model.nope=1", "a.b=1", "~gone", "model=huge", "steps"):
        with pytest.raises(ConfigError):
            compose(read, "run", [bad])
    with pytest.raises(ConfigError):
        compose(read, "missing")


def test_layered_files(spark, tmp_path):
    for path, tree in FILES.items():
        p = tmp_path / f"{path}.{'json' if path == 'base' else 'yaml'}"
        p.parent.mkdir(exist_ok=True)
        p.write_text(json.dumps(tree))
    tree = compose_files(spark, str(tmp_path), "run", ["model=large"])
    assert tree["model"]["width"] == 512 and tree["seed"] == 3
    config = RunConfig.from_dict({"pack": tree["pack"]})
    assert (config.pack.max_seq_length, config.pack.eos_token_id) == (16, 7)
    with pytest.raises(TypeError):
        RunConfig.from_dict(tree)  # sections that no run has


def test_the_end_token_is_the_tokenizer_s(tmp_path):
    import public_tokenizers

    from corpusloom.operators.tokenizers import BpeTokenizer

    got = BpeTokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert (got.eos, got.eos_id, got.vocabulary_size) == ("<|endoftext|>", 50256, 50257)
    definition = {"added_tokens": [{"content": "<s>", "id": 3, "special": True}, {"content": "</s>", "id": 4, "special": True}], "model": {"vocab": {"a": 0, "b": 1, "!": 2}}}
    (tmp_path / "tokenizer.json").write_text(json.dumps(definition))
    plain = BpeTokenizer.from_file(f"{tmp_path}/tokenizer.json")
    assert (plain.eos, plain.eos_id, plain.vocabulary_size) == ("</s>", 4, 5)
    for named in ("!", {"content": "!"}):
        (tmp_path / "tokenizer_config.json").write_text(json.dumps({"eos_token": named}))
        assert BpeTokenizer.from_file(f"{tmp_path}/tokenizer.json").eos_id == 2
    with pytest.raises(ValueError, match="no end token"):
        _ = BpeTokenizer(json.dumps({"added_tokens": [], "model": {"vocab": {"a": 0}}})).eos
