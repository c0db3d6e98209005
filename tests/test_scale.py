"""Bursts, long series, pruned reads, exact selection and streams out of order, against plain references."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulseframe.operators import asof, slices, spectrum, stats, timebase, windows
from pulseframe.plans import model, registry
from pulseframe.schema import K
from pulseframe.sources import recordings, sinks, store
from pulseframe.streaming import live

from .conftest import DATA
from .test_operators import key, ticks_by_loop

SHAPE = "recording_id string, session_id int, channel_id string"


@pytest.fixture(scope="module")
def burst(spark):
    """90 of 100 samples in one second, the others over ten days; and a short series."""
    n = 200_000
    t = F.when(F.col("id") % 10 == 0, F.col("id") * 4_320_000).otherwise(F.lit(400_000_000_000) + F.col("id") * 5)
    rows = spark.range(n).select(*key(), t.cast("double").alias("t_us"), "id")
    short = spark.range(50).select(F.lit("r").alias("recording_id"), F.lit(0).alias("session_id"), F.lit("9").alias("channel_id"), (F.col("id") * 1e9).alias("t_us"), "id")
    return rows.unionByName(short).cache()


def test_burst_is_cut_into_even_buckets(spark, burst, monkeypatch):
    monkeypatch.setattr(timebase, "BUCKET_ROWS", 10_000)
    sizes = {(r["channel_id"], r["_b"]): r["count"] for r in timebase.time_buckets(burst, burst).groupBy("channel_id", "_b").count().collect()}
    dense = [n for (c, _), n in sizes.items() if c == "8"]
    assert len(dense) >= 8 and max(dense) <= 2 * np.mean(dense) and sizes[("9", 0)] == 50
    indexed = timebase.add_index(burst, "id").cache()
    want = burst.withColumn("want", F.row_number().over(Window.partitionBy("channel_id").orderBy("t_us", "id")) - 1).select("channel_id", "id", "want")
    assert indexed.join(want, ["channel_id", "id"]).where("idx = want").count() == 200_050
    times = np.sort([r["t_us"] for r in burst.where("channel_id = '8'").select("t_us").collect()])
    rng = random.Random(2)
    probes = [("r", 0, "8", float(t)) for t in [*(rng.choice(times.tolist()) + rng.choice((-1, 0, 1)) for _ in range(500)), -5, 0, 1e13]]
    got = asof.index_before(spark.createDataFrame(probes, f"{SHAPE}, t_us double"), indexed.withColumn("raw", F.array(F.col("t_us")))).collect()
    for r in got:
        at = int(np.searchsorted(times, r["t_us"], "right")) - 1
        assert r["idx"] == (at + 1 if at == len(times) - 1 else at)


def test_buckets_are_cut_once(spark, burst, monkeypatch):
    """A sketch may give other bounds each time, and a plan may evaluate it once for each use: sample numbers are right even so."""
    monkeypatch.setattr(timebase, "BUCKET_ROWS", 10_000)
    indexed = timebase.add_index(burst, "id")
    assert "percentile_approx" not in indexed._jdf.queryExecution().optimizedPlan().toString()
    got = indexed.where("channel_id = '8'").agg(F.min("idx"), F.max("idx"), F.countDistinct("idx")).first()
    assert tuple(got) == (0, 199_999, 200_000)


def test_times_outside_the_bounds(spark, burst, monkeypatch):
    monkeypatch.setattr(timebase, "BUCKET_ROWS", 10_000)
    ends = spark.createDataFrame([("r", 0, "8", -1e18), ("r", 0, "8", 1e18), ("r", 0, "8", None), ("r", 0, "none", 1.0)], f"{SHAPE}, t_us double")
    got = {(r["channel_id"], r["t_us"]): r["_b"] for r in timebase.time_buckets(ends, burst).collect()}
    assert got[("8", -1e18)] == 0 and got[("8", 1e18)] >= 8 and got[("none", 1.0)] == 0


def test_ticks_with_ends_and_absolute_ones(spark, monkeypatch):
    monkeypatch.setattr(timebase, "TICK_BUCKET", 5)
    rng, modulus, want, blocks = random.Random(5), 1 << 12, {}, []
    for c in ("a", "b"):
        t, ticks = 0, []
        for _ in range(200):
            t += rng.randint(1, modulus // 2)
            ticks.append(t if rng.random() < 0.1 and t > modulus else t % modulus)
        pairs = [(ticks[2 * i], ticks[2 * i + 1] if rng.random() < 0.7 else None) for i in range(100)]
        line = [x for a, z in pairs for x in (a, a if z is None else z)]
        flat = list(ticks_by_loop(line, modulus))
        want |= {(c, i): (flat[2 * i], flat[2 * i + 1]) for i in range(100)}
        blocks += [("r", 0, c, i, a, z) for i, (a, z) in enumerate(pairs)]
    rows = spark.createDataFrame(blocks, f"{SHAPE}, block_seq bigint, start_tick bigint, end_tick bigint").repartition(6)
    got = {(r["channel_id"], r["block_seq"]): (r["start_us"], r["end_us"]) for r in timebase.unroll_ticks(rows, modulus, 1.0).collect()}
    assert got == want


def test_store_reads_only_the_files_of_its_blocks(spark):
    rows = spark.range(64_000).select(*key(), "id", (F.col("id") * 1000 + F.when(F.col("id") > 40_000, 10**9).otherwise(0)).cast("double").alias("t_us"), F.array(F.col("id").cast("double")).alias("raw"))
    samples = timebase.to_block(timebase.add_index(rows, "id"))
    path = model.shared_path(spark, "store")
    store.write_store(samples, path, 50)
    kept = store.Store(spark, path, samples.schema)
    for a, z in ((10_000_000, 12_000_000), (39_000_000, 41_000_000), (500_000_000, 600_000_000), (0, 10), (10**12, 10**13)):
        want = sorted(r["idx"] for r in slices.time_range(samples, a, z).select("idx").collect())
        assert sorted(r["idx"] for r in kept.time_range(a, z).select("idx").collect()) == want, (a, z)
    assert sorted(r["idx"] for r in kept.index_slice(5000, 9000, 9).collect()) == list(range(5000, 9000, 9))

    def files(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        found, todo = [], [plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
        while todo:
            node = todo.pop()
            name = node.nodeName()
            if name.startswith("Scan parquet") and "/samples" in node.toString():
                found.append(node.metrics().apply("numFiles").value())
            if "QueryStage" in name:
                todo.append(node.plan())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        return found

    assert files(kept.samples) == [20]
    assert max(files(kept.of_blocks(kept.blocks.where("start_us < 12000000 and end_us > 10000000")))) <= 2


def test_registered_store_has_no_tiny_files(spark):
    """A file a series, as none has more blocks than one file takes."""
    kept = registry._store(spark, DATA)
    assert len(kept.samples.inputFiles()) == kept.samples.select(*K).distinct().count() == 5


def test_sliding_medians_equal_a_window(spark, monkeypatch):
    monkeypatch.setattr(stats, "SLIDING_ROWS", 40)
    rng = random.Random(3)
    rows = [("r", 0, c, i, s, rng.randrange(0, 5000) if c == "a" else 7 * i, rng.choice((None, 1.0, -2.5, rng.random()))) for c in ("a", "b", None) for i in range(400) for s in (0, 1)]
    df = spark.createDataFrame(rows, f"{SHAPE}, block_seq bigint, subchannel_id int, start_us bigint, av double")
    for span in (0, 1, 60, 400, 100_000):
        near = Window.partitionBy(*K, "subchannel_id").orderBy("start_us").rangeBetween(-(span // 2), span // 2)
        order = lambda x: sorted(map(tuple, x.collect()), key=repr)
        got, want = order(stats.block_medians(df, span)), order(df.withColumn("median", F.percentile("av", F.lit(0.5)).over(near)))
        assert [r[:-1] for r in got] == [r[:-1] for r in want]
        assert all((a[-1] is None and b[-1] is None) or a[-1] == pytest.approx(b[-1], rel=1e-12) for a, b in zip(got, want))


def test_long_series_of_blocks_slides_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(stats, "SLIDING_ROWS", 5_000)
    df = spark.range(100_000).select(*key(), F.col("id").alias("block_seq"), F.lit(0).alias("subchannel_id"), (F.col("id") * 10).alias("start_us"), ((F.col("id") * 7919) % 1000).cast("double").alias("av"))
    got = stats.block_medians(df, 2000).orderBy("block_seq").toPandas()
    v = got["av"].to_numpy()
    for i in (0, 1, 99, 100, 5000, 49_999, 99_999):
        assert got["median"][i] == np.median(v[max(0, i - 100) : i + 101])


def test_exact_medians_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(stats, "BUFFER", 300)
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.normal(size=50_000), "odd": rng.normal(size=20_001) * 1e200, "ties": rng.integers(0, 3, 30_000).astype(float), "one": np.full(10_000, 4.0), "two": np.repeat([1.0, 2.0], 5_000),
        "small": rng.random(31), "steep": np.sign(rng.random(9_000) - 0.5) * 10.0 ** rng.integers(-300, 300, 9_000),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("nulls", None)] * 5 + [("even", None)] * 1000 + [(None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8).cache()
    got = {r["k"]: r["median"] for r in stats.medians(df, ["k"], "v").collect()}
    assert got == {k: float(np.median(v)) for k, v in groups.items()} | {"nulls": None, None: 2.5}


def test_digests_open_only_blocks_that_differ(spark):
    a = spark.range(20_000).select("id", (F.col("id") % 7).alias("v"), F.lit(None).cast("string").alias("w"))
    b = a.where("id <> 55").withColumn("v", F.when(F.col("id") == 9_999, 100).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(30_000, 1, "x")], a.schema))
    diff = lambda x, y: windows.digest_diff(x, y, ["id"], [F.floor(F.col("id") / 100)], model.shared_path(spark, "differ"))
    assert sorted((r["id"], r["side"]) for r in diff(a, b).collect()) == [(55, "left"), (9_999, "both"), (30_000, "right")]
    assert diff(a, a.repartition(3)).count() == 0
    twice = spark.createDataFrame([(1, 5), (1, 5)], "id int, v int"), spark.createDataFrame([(1, 6), (1, 6)], "id int, v int")
    assert windows.digest_diff(*twice, ["id"], [F.col("id")], model.shared_path(spark, "differ")).count() > 0  # equal rows don't cancel


@pytest.mark.parametrize("n", (1, 2, 3, 7, 64, 997, 4096, 30_030))
def test_spectrum_of_a_whole_series(spark, monkeypatch, n):
    monkeypatch.setattr(spectrum, "GROUP", 1 << 10)
    v = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([("r", 0, "8", i, [float(x), float(i % 5)]) for i, x in enumerate(v)], f"{SHAPE}, idx bigint, raw array<double>")
    got = spectrum.spectrum(rows).toPandas()
    for s, x in ((0, v), (1, np.arange(n) % 5.0)):
        own = got[got.subchannel_id == s].sort_values("k")
        assert list(own.k) == list(range(n // 2 + 1)) and set(own.n) == {n}
        assert np.allclose(own.re + 1j * own.im, np.fft.fft(x)[: n // 2 + 1], rtol=1e-9, atol=1e-9 * max(np.abs(x).sum(), 1))


def test_the_chirp_of_a_series_is_not_broadcast(spark, monkeypatch):
    """It is as large as the series, whatever Spark takes it for."""
    monkeypatch.setattr(spectrum, "GROUP", 1 << 10)
    rows = spark.range(5_000).select(*key(), F.col("id").alias("idx"), F.array(F.col("id") % 7).alias("raw"))
    found = spectrum.spectrum(rows)
    assert len(found.collect()) == 2_501
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*|")) for line in plan]
    assert any("FlatMapGroups" in line for line in plan)
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            assert not any("FlatMapGroups" in x for x in plan[i:below])


def test_spectrum_of_a_series_with_holes(spark, monkeypatch):
    """Most groups of columns are without a sample, one sample has no second value and the last has none at all."""
    monkeypatch.setattr(spectrum, "GROUP", 1 << 10)
    rows = [(0, [2.0, 1.0]), (256, [-1.0]), (640, [0.5, 4.0]), (4_103, [None, 3.0]), (5_000, None)]
    got = spectrum.spectrum(spark.createDataFrame([("r", 0, "8", i, v) for i, v in rows], f"{SHAPE}, idx int, raw array<double>")).toPandas()
    for s in (0, 1):
        x = np.zeros(5_001)
        for i, v in rows:
            x[i] = (v[s] if v and len(v) > s else None) or 0
        own = got[got.subchannel_id == s].sort_values("k")
        assert list(own.k) == list(range(2_501)) and set(own.n) == {5_001}
        assert np.allclose(own.re + 1j * own.im, np.fft.fft(x)[:2_501], rtol=1e-9, atol=1e-9)


def test_a_session_that_is_missing_is_an_error(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 1, 3), (None, 1, 4)], "recording_id string, session_id int, v int")
    assert sorted(r["v"] for r in recordings.session(rows, 1).collect()) == [2, 3, 4]
    assert recordings.session(rows.limit(0), 1).count() == 0
    with pytest.raises(Exception, match="no session 0 in recording"):
        recordings.session(rows, 0).collect()


def test_array_files_are_bounded_by_bytes(spark, tmp_path):
    samples = spark.range(1000).coalesce(1).select(*key(), F.col("id").alias("idx"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("raw"))
    sinks.export_arrays(samples, {}, str(tmp_path), bytes_per_file=32 * 300)
    sizes = sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "samples")).groupBy(F.input_file_name()).count().collect())
    assert sizes == [100, 300, 300, 300]


# Streams


def batches(spark, place, parts, shape, build, keyed=False):
    """Everything that a stream puts out in append mode, a run for each part of the rows."""
    for part in parts:
        spark.createDataFrame(part, shape).withColumn("ts", F.timestamp_micros("t_us")).coalesce(1).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{place}/in").schema).parquet(f"{place}/in")
        with live.keyed_state(spark):
            build(stream).writeStream.outputMode("append").format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(**live.ONCE).start().awaitTermination()
    return spark.read.parquet(f"{place}/out")


def test_windows_close_with_the_watermark(spark, tmp_path):
    """A window is put out once, when it has been passed; what comes too late is left out, what is late but allowed counts."""
    hour = 3_600_000_000
    shape = f"{SHAPE}, t_us bigint, v double"
    row = lambda h, v: ("r", 0, "8", int(h * hour), float(v))
    parts = [[row(0.1, 1), row(0.9, 2)], [row(2.5, 3)], [row(0.5, 50), row(1.8, 4)], [row(9, 5)]]
    got = batches(spark, tmp_path, parts, shape, lambda s: live.tumbling(s, "1 hour", "1 hour")).select(F.hour("w.start").alias("h"), "n", "mx").collect()
    assert sorted(map(tuple, got)) == [(0, 2, 2.0), (1, 1, 4.0), (2, 1, 3.0)]  # 0.5 came when hour 0 was closed; hour 9 is open


def test_sliding_medians_of_streams_are_exact(spark, tmp_path):
    """A sketch of the usual accuracy is off where a window has 30,001 different values."""
    n = 30_001
    rows = spark.range(n).select(*key(), (F.col("id") * 1000).alias("t_us"), ((F.col("id") * 7919) % n).cast("double").alias("v"), F.timestamp_micros(F.col("id") * 1000).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    live.sliding(stream, "1 day", "12 hours").writeStream.outputMode("complete").format("memory").queryName("sliding_exact").option("checkpointLocation", str(tmp_path / "c")).trigger(**live.ONCE).start().awaitTermination()
    assert {r["median"] for r in spark.table("sliding_exact").collect()} == {n // 2}


def test_rows_out_of_order_wait_for_the_watermark(spark, tmp_path):
    rng, modulus = random.Random(11), 1 << 10
    shape = f"{SHAPE}, seq bigint, tick bigint, t_us bigint, v double"
    rows, t = [], 0
    for i in range(240):
        t += rng.randint(1, 400)
        for c in ("8", "9"):
            rows.append(("r", 0, c, i, t if rng.random() < 0.05 and t > modulus else t % modulus, (i + 1) * 1_000_000, rng.choice([0.0, 1.0, 1.0, None])))
    mixed = sorted(rows, key=lambda r: r[5] + rng.uniform(0, 15_000_000))
    parts = [mixed[i : i + 120] for i in range(0, 480, 120)]
    mark = max(r[5] for r in rows) - 20_000_000
    closed = batches(spark, tmp_path / "i", parts, shape, lambda s: live.intervals_in_order(s, 0.5, 1.5, "20 seconds"))
    rest = spark.createDataFrame(rows, shape).withColumn("idx", F.col("seq"))
    want = [r for r in windows.bad_intervals(rest, ~windows.in_range(F.col("v"), 0.5, 1.5)).collect() if 0 <= r["end_us"] <= mark]
    assert sorted(map(tuple, closed.collect())) == sorted(map(tuple, want)) and len(want) > 30
    times = batches(spark, tmp_path / "t", parts, shape, lambda s: live.ticks_in_order(s, modulus, 1.0, "20 seconds"))
    expected = {(c, i): x for c in ("8", "9") for i, x in enumerate(ticks_by_loop([r[4] for r in rows if r[2] == c], modulus)) if (i + 1) * 1_000_000 <= mark}
    assert {(r["channel_id"], r["seq"]): r["t_us"] for r in times.collect()} == expected


def test_states_of_old_batches_go(spark, tmp_path):
    shape = f"{SHAPE}, t_us bigint, v double"
    for n in range(4):
        spark.createDataFrame([("r", 0, "8", n * 10, float(n % 2))], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        live.live_intervals(stream, 0.5, 1.5, str(tmp_path / "i"), str(tmp_path / "c"), {"availableNow": True}).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "i" / "state").iterdir()) == ["batch=2", "batch=3"]


def test_a_batch_is_held_as_one_entry(spark):
    from types import SimpleNamespace

    import pandas as pd
    from pyspark.sql.types import StructType

    state, timers = [], []
    p = live._InOrder(["t_us"], StructType.fromDDL("ts_ms bigint, t_us bigint, right boolean"), StructType.fromDDL("opened bigint"), None)
    p.held, p.handle = SimpleNamespace(appendList=state.extend), SimpleNamespace(registerTimer=timers.append)
    p.handleInputRows(("r", 0, "8"), iter([pd.DataFrame({"ts_ms": range(1000), "t_us": range(1000), "right": True})]), None)
    assert len(state) == 1 and state[0][:2] == (0, 999) and sorted(timers) == [0, 999]
