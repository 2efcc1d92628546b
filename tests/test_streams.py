"""Streams in many batches against plain loops."""

import glob
import os
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from siftline.streaming import stateful
from siftline.streaming import streams as st
from siftline.streaming.merged import MergedTable
from siftline.tables import new_path

EVENTS = "id long, who string, at long, what string"


def stream_of(spark, rows, batches, name):
    """A stream of the rows in as many batches, in order of their files' times."""
    path, seen = new_path(spark, name), set()
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], EVENTS).withColumn("ts", F.timestamp_micros("at")).coalesce(1).write.mode("append").parquet(path)
        now = set(glob.glob(path.removeprefix("file://") + "/*.parquet"))
        for f in now - seen:
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
        seen = now
    return st.file_stream(spark, path, files=1)


def requests(n, keys, gap):
    rng, at, out = random.Random(n), 1_700_000_000_000_000, []
    for i in range(n):
        at += rng.choice([0, 1, gap, gap, 10 * gap])
        out.append((i, rng.choice(keys), at, f"p{min(rng.randrange(12), rng.randrange(12))}"))
    return out


def slow_limiter(rows, per_minute, per_day):
    """One request after the other, in seconds, from two counters that are filled up again."""
    keys, out = {}, []
    for i, who, at, _ in rows:
        k = keys.setdefault(who, {"m": per_minute, "d": per_day, "ms": at, "ds": at})
        if at - k["ms"] >= 60 * 10**6:
            k.update(m=per_minute, ms=at)
        if at - k["ds"] >= 86_400 * 10**6:
            k.update(d=per_day, ds=at)
        if k["d"] <= 0:
            out.append((i, False, round(86_400 - (at - k["ds"]) / 1e6, 5)))
        elif k["m"] <= 0:
            out.append((i, False, round(max(60 - (at - k["ms"]) / 1e6, 0.1), 5)))
        else:
            k["m"], k["d"] = k["m"] - 1, k["d"] - 1
            out.append((i, True, 0.0))
    return out


@pytest.mark.parametrize("gap", [9_000_000, 4_000_000_000])
def test_admission_over_batches_is_a_plain_loop(spark, gap):
    rows = requests(300, ["a", "b", None], gap)
    got = st.run_append(stateful.admit(stream_of(spark, rows, 6, "requests"), "ts", "who", "id", 2, 25), "admitted", rocks=True)
    want = slow_limiter([r for r in rows if r[1]], 2, 25)
    assert sorted((r.id, r.admitted, round(r.wait, 5)) for r in got.collect()) == want
    assert {ok for _, ok, _ in want} == {True, False}


def test_cache_over_batches_is_a_plain_loop(spark):
    rows = requests(300, ["a", "b"], 1_000_000)
    got = st.run_append(stateful.cached(stream_of(spark, rows, 6, "prompts"), "ts", "who", "id", "what", 4), "cached", rocks=True)
    caches, want = {}, []
    for i, who, _, what in rows:
        held = caches.setdefault(who, OrderedDict())
        hit, gone = what in held, None
        held.pop(what, None)
        held[what] = 1
        if len(held) > 4:
            gone, _ = held.popitem(last=False)
        want.append((i, who, hit, gone))
    assert sorted((r.id, r.key, r.hit, r.evicted) for r in got.collect()) == want
    assert sum(x[2] for x in want) > 20 and sum(x[3] is not None for x in want) > 20


def test_fifty_batches_are_merged(spark):
    table = MergedTable(spark, new_path(spark, "merged"), spark.createDataFrame([], "k long, v long, name string").schema, ["k"], "v", most=6)
    assert table.read().count() == 0
    rng, want = random.Random(1), {}
    for number in range(50):
        rows = [(rng.randrange(40) if rng.random() < 0.95 else None, rng.randrange(100), rng.choice(["x", None])) for _ in range(20)]
        batch = spark.createDataFrame(rows, "k long, v long, name string").coalesce(1)
        table.write(batch, number)
        best = {}
        for k, v, name in rows:
            best.setdefault(k, []).append((v, name))
        for k, found in best.items():
            v = max(v for v, _ in found)
            if k not in want or v >= want[k][0]:
                want[k] = (v, {name for x, name in found if x == v})
        if number in (7, 20):
            table.write(spark.createDataFrame([(1, 999, "again")], "k long, v long, name string"), number)  # a repeated batch changes nothing
        assert len(table.manifest()["runs"]) <= 6
    got = {r.k: (r.v, r.name) for r in table.read().collect()}
    assert got.keys() == want.keys() and all(got[k][0] == v and got[k][1] in names for k, (v, names) in want.items())
    live = set(table.manifest()["runs"])
    read = {f.split("/")[-2] for f in table._rows(table.manifest()["runs"]).inputFiles()}
    assert read <= live and any(r.startswith("whole-") for r in live)
    folders = {s.getPath().getName() for s in table._fs.listStatus(table._file()) if s.getPath().getName() != "manifest"}
    assert len(folders) < 20 and live <= folders


def test_a_lost_draft_counts_for_nothing(spark):
    table = MergedTable(spark, new_path(spark, "merged"), spark.createDataFrame([], "k long, v long").schema, ["k"])
    batch = spark.createDataFrame([(1, 2)], "k long, v long")
    table.write(batch, 0)
    table._run(spark.createDataFrame([(1, 7, 1)], "k long, v long, _batch long"), "run-1")  # written, then the writer is lost
    assert [tuple(r) for r in table.read().collect()] == [(1, 2)]
    table.write(spark.createDataFrame([(1, 3)], "k long, v long"), 1)
    assert [tuple(r) for r in table.read().collect()] == [(1, 3)]


def test_streams_of_many_batches_end_in_the_latest_rows(spark):
    rows = requests(200, ["a", "b", "c"], 1_000_000)
    stream = stream_of(spark, rows, 10, "latest").select("who", F.col("id").alias("version"), "what")
    got = st.run_latest(stream, "latest_rows", ["who"], "append", "version", most=3)
    assert {(r.who, r.version, r.what) for r in got.collect()} == {max(((w, i, p) for i, w, _, p in rows if w == who), key=lambda x: x[1]) for who in "abc"}
