"""The peak store: bounded files, and no loss at whatever step a fold is cut off."""

import os
import random

import pytest

from jobtally.operators.peaks import PEAK_JOBS, PEAK_OPS
from jobtally.sinks import peaks
from jobtally.sinks.peaks import PeakStore

OPS = ["open", "close", "read"]


@pytest.fixture(scope="module")
def spark(spark):
    """Few partitions: batches are small here and many."""
    few = spark.newSession()
    few.conf.set("spark.sql.shuffle.partitions", "2")
    return few


def batch(spark, batch_id):
    """The peaks a batch found; later batches are sometimes better."""
    rng = random.Random(batch_id)
    found = [(op, rng.randrange(1, 1000), f"j{rng.randrange(5)}", 1000 + batch_id) for op in OPS if rng.random() < 0.8]
    ops = spark.createDataFrame([(op, rate * 3, at) for op, rate, _, at in found], PEAK_OPS)
    jobs = spark.createDataFrame([(op, job, rate, {op: rate, "ops": rate + 1}, at) for op, rate, job, at in found], PEAK_JOBS)
    return found, ops.coalesce(1), jobs.coalesce(1)


def best(found):
    out = {}
    for op, rate, job, at in found:
        out[op] = min(out.get(op, (0, 0, "")), (-rate, at, job))
    return {op: (-loss, at, job) for op, (loss, at, job) in out.items()}


def stored(store, spark):
    ops, jobs = store.read(spark)
    by_op = {r["operation"]: (r["rate"], r["timestamp"]) for r in ops.collect()}
    found = {r["operation"]: (r["rate"], r["timestamp"], r["job_id"]) for r in jobs.collect()}
    assert by_op == {op: (3 * rate, at) for op, (rate, at, _) in found.items()}
    assert all(r["ops"] == {r["operation"]: r["rate"], "ops": r["rate"] + 1} for r in jobs.collect())
    return found


def count_files(path):
    return sum(len(names) for _, _, names in os.walk(path))


def test_files_stay_bounded(spark, tmp_path):
    store, seen, files = PeakStore(str(tmp_path / "p"), 3), [], []
    assert stored(store, spark) == {}
    for n in range(17):
        found, ops, jobs = batch(spark, n)
        seen += found
        store.add(ops, jobs, n)
        files.append(count_files(tmp_path / "p"))
        if n % 8 == 7:
            assert stored(store, spark) == best(seen)
    assert store.current(spark).number == 4 and max(files[9:]) <= max(files[:9])
    assert len(store._batches(spark)) <= 6


def test_a_batch_added_twice_counts_once(spark, tmp_path):
    store = PeakStore(str(tmp_path / "p"), 3)
    seen = []
    for n in (0, 1, 1, 2, 2, 3):  # the repeat of 2 comes after the fold that covers it
        found, ops, jobs = batch(spark, n)
        seen += found
        store.add(ops, jobs, n)
    assert stored(store, spark) == best(seen)


@pytest.mark.parametrize("step", ["log", "generation", "switch", "rename", "clean"])
def test_nothing_is_lost_wherever_a_fold_stops(spark, tmp_path, monkeypatch, step):
    class Killed(Exception):
        pass

    def die(*_args, **_kwargs):
        raise Killed

    store, seen = PeakStore(str(tmp_path / "p"), 2), []
    for n in range(5):
        found, ops, jobs = batch(spark, n)
        with monkeypatch.context() as patch:
            if n in (1, 3):
                if step == "log":  # half of a batch is there
                    ops.write.mode("overwrite").parquet(f"{store.path}/log/batch={n}/ops")
                    (tmp_path / f"p/log/batch={n}/jobs").mkdir()
                else:
                    if step == "generation":
                        patch.setattr(store, "_switch", die)
                    elif step == "switch":  # the new text is written, not yet in its place
                        patch.setattr(peaks.json, "dumps", lambda value: (_ for _ in ()).throw(Killed()))
                    elif step == "rename":
                        switch = store._switch
                        patch.setattr(store, "_switch", lambda s, to: (switch(s, to), die()))
                    else:
                        patch.setattr(store, "_clean", die)
                    with pytest.raises(Killed):
                        store.add(ops, jobs, n)
                    assert stored(store, spark) == best(seen + found)
        seen += found
        store.add(ops, jobs, n)  # the batch is run again
    assert stored(store, spark) == best(seen)


def test_a_reader_outlives_a_fold(spark, tmp_path):
    store, seen = PeakStore(str(tmp_path / "p"), 100), []
    for n in range(3):
        found, ops, jobs = batch(spark, n)
        seen += found
        store.add(ops, jobs, n)
    ops, jobs = store.read(spark)
    store.fold(spark)
    store.fold(spark)  # nothing new: nothing happens
    assert store.current(spark).number == 0
    assert {r["operation"]: r["rate"] for r in jobs.collect()} == {op: rate for op, (rate, _, _) in best(seen).items()}
    assert ops.count() == len(best(seen))
