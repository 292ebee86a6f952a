"""State that is carried along a run: kept checkpoints, last losses, counters over stops and resumes."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import history, runlog
from corpusloom.operators.prefix import Running, even_bucket, key_bucket, prefix_scan, prefix_sum
from corpusloom.operators.runlog import Counters

SAVES = "run int, step long, val_loss double, path string, forced boolean"


def simulated(saves, k):
    """A heap as a trainer keeps it: admission for validations, then the save, then the worst goes."""
    kept, out = [], []
    for step, loss, path, forced in sorted(saves):
        admitted = forced or len(kept) < k or bool(kept) and loss < -kept[0][0]
        gone = None
        if admitted:
            heapq.heappush(kept, (-loss, step, path))
            if len(kept) > k:
                gone = heapq.heappop(kept)[2]
        out.append((step, admitted, gone, [p for *_, p in sorted(kept, reverse=True)]))
    return out


def random_saves(seed, n, runs, kinds):
    rng = random.Random(seed)
    losses = {"ties": [1.0, 2.0, 3.0], "falling": None, "any": None, "infinite": [float("inf"), 1.0, 1.5]}[kinds]
    out = []
    for run in range(runs):
        for step in sorted(rng.sample(range(n * 3), n)):
            loss = rng.choice(losses) if losses else (1e6 - step if kinds == "falling" else rng.random())
            out.append((run, step, loss, f"p{run}-{step}", rng.random() < 0.4))
    return out


@pytest.mark.parametrize("k,kinds", [(1, "ties"), (3, "ties"), (5, "any"), (2, "falling"), (4, "infinite"), (0, "any")])
def test_history_against_a_heap(spark, monkeypatch, k, kinds):
    monkeypatch.setattr(history, "FAN", 3)
    saves = random_saves(k, 60, 2, kinds)
    got = {}
    for r in history.checkpoint_history(spark.createDataFrame(saves, SAVES).repartition(5), k, "run", steps=5).collect():
        got.setdefault(r.run, []).append((r.step, r.admitted, r.removed, r.kept))
    for run in (0, 1):
        assert sorted(got[run]) == simulated([s[1:] for s in saves if s[0] == run], k)


def test_history_is_one_state(spark):
    """The refusal of a tie and the eviction of a tie see one list: a periodic save may push out what a validation could not."""
    saves = [(0, 1, 5.0, "a", False), (0, 2, 5.0, "b", False), (0, 3, 5.0, "c", True), (0, 4, 4.0, "d", False)]
    got = {r.step: (r.admitted, r.removed, r.kept) for r in history.checkpoint_history(spark.createDataFrame(saves, SAVES), 1).collect()}
    assert got == {1: (True, None, ["a"]), 2: (False, None, ["a"]), 3: (True, "a", ["c"]), 4: (True, "c", ["d"])}
    assert history.checkpoint_history(spark.createDataFrame([], SAVES), 2).count() == 0
    for bad in ((0, None, 1.0, "a", True), (0, 1, None, "a", True), (0, -1, 1.0, "a", True)):
        with pytest.raises(Exception, match="step|loss"):
            history.checkpoint_history(spark.createDataFrame([bad], SAVES), 2).collect()


def test_rows_without_a_run_are_one(spark):
    saves = [(None, 1, 1.0, "a", True), (None, 2, 2.0, "b", True), (7, 1, 3.0, "c", True)]
    df = spark.createDataFrame(saves, SAVES)
    assert {(r.run, r.step): r.removed for r in history.checkpoint_history(df, 1, "run").collect()} == {(None, 1): None, (None, 2): "b", (7, 1): None}
    got = runlog.checkpoint_admission(df.drop("forced"), 1, run="run")
    assert {(r.run, r.step): r.admitted for r in got.collect()} == {(None, 1): True, (None, 2): False, (7, 1): True}
    assert runlog.checkpoint_prunes(df, 1).collect()[0].removed == "b"


def test_no_python_and_no_window_over_a_run(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "step long, val_loss double")
    plan = runlog.checkpoint_schedule(df, 10, 4)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition" in line]
    assert windows and all("_bucket" in line for line in windows)
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_scan_against_plain_loops(spark):
    rng = random.Random(1)
    rows = [(i * 3, rng.choice([None, rng.randrange(-9, 9)]), "mine", "too") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v int, _bucket string, _VALUE0 string").repartition(7)
    got = prefix_scan(
        df, ["k"], key_bucket("k", 32),
        total=Running("sum", F.col("v")), before=Running("sum", F.col("v"), False), low=Running("min", F.col("v")), high=Running("max", F.col("v"), False), last=Running("last", F.col("v")),
    )
    assert got.columns == ["k", "v", "_bucket", "_VALUE0", "total", "before", "low", "high", "last"]
    seen = []
    for r, (_, v, *_rest) in zip(got.orderBy("k").collect(), rows, strict=True):
        before = [x for x in seen if x is not None]
        seen.append(v)
        now = [x for x in seen if x is not None]
        assert (r["_bucket"], r["_VALUE0"]) == ("mine", "too")
        assert (r.total, r.before) == (sum(now), sum(before))
        assert (r.low, r.high, r["last"]) == (min(now, default=None), max(before, default=None), now[-1] if now else None)
    with pytest.raises(ValueError):
        Running("median", F.col("v"))


def test_sparse_keys_and_rows_without_a_key(spark):
    rows = [(10**15 + i * 10**9, 1) for i in range(1000)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k long, v long")
    bucket = even_bucket(df, "k", 100)
    assert 10 <= df.select(bucket).distinct().count() <= 12
    got = prefix_sum(df, F.col("v"), ["k"], bucket, "o").orderBy("k").collect()
    assert [r.o for r in got] == list(range(1001))
    assert prefix_sum(df.limit(0), F.col("v"), ["k"], even_bucket(df.limit(0), "k")).count() == 0


def test_schedule_over_buckets(spark):
    rng = random.Random(5)
    rows = [(e, s, rng.choice([0.0, 1.5, 2.5, None])) for e in range(3) for s in range(40)]
    got = runlog.checkpoint_schedule(spark.createDataFrame(rows, "epoch int, step long, val_loss double"), 5, 3, epoch="epoch", rows=4)
    for r in got.collect():
        last = 0.0
        for e, s, v in rows:
            if e == r.epoch and s <= r.step and (s + 1) % 5 == 0 and v is not None:
                last = v
        action = "validate" if (r.step + 1) % 5 == 0 else "save" if (r.step + 1) % 3 == 0 else "none"
        assert r.action == action and r.carried_loss == (None if action == "none" else last if last > 0 else float("inf"))


LOG = "at long, tokens long, ended boolean, restored struct<epoch:long,global_step:long,step_in_epoch:long,tokens_seen:long>"


def test_counters_over_stops_and_resumes(spark):
    rng, log, want, c = random.Random(2), [], [], Counters()
    for at in range(300):
        restored = rng.choice([None] * 30 + [(rng.randrange(5), rng.randrange(100), rng.randrange(9), rng.randrange(999))])
        if restored:
            c = Counters(*restored)
        ended, n = rng.random() < 0.08, rng.randrange(1, 9)
        c.global_step, c.step_in_epoch, c.tokens_seen = c.global_step + 1, c.step_in_epoch + 1, c.tokens_seen + n
        want.append(tuple(c.state_dict().values()))
        log.append((at, n, ended, restored))
        if ended:
            c.roll_epoch(stopped=False)
    df = spark.createDataFrame(log, LOG).repartition(4)
    got = runlog.run_counters(df, ["at"], key_bucket("at", 16)).orderBy("at").collect()
    assert [(r.epoch, r.global_step, r.step_in_epoch, r.tokens_seen) for r in got] == want


def test_counters_come_back_from_a_checkpoint(spark, tmp_path):
    """Saved, wiped and restored; the batches of the resumed run count on from there."""
    saved = Counters(2, 100, 50, 123_456)
    last = runlog.save_last(spark, saved, str(tmp_path))
    wiped = Counters()
    wiped.load_state_dict(runlog.resume(spark, last).state_dict())
    assert wiped == saved
    log = [(0, 7, False, (wiped.epoch, wiped.global_step, wiped.step_in_epoch, wiped.tokens_seen)), (1, 7, True, None), (2, 7, False, None)]
    got = runlog.run_counters(spark.createDataFrame(log, LOG), ["at"], F.col("at")).orderBy("at").collect()
    assert [(r.epoch, r.global_step, r.step_in_epoch, r.tokens_seen) for r in got] == [(2, 101, 51, 123_463), (2, 102, 52, 123_470), (3, 103, 1, 123_477)]
