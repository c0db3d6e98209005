"""Closed-form series, golden values and loops as references."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import calibration, names, units
from pulseframe.plans import model
from pulseframe.operators import asof, slices, spectrum, stats, timebase, windows
from pulseframe.schema import K
from pulseframe.sources import decode, metadata, recordings, sinks
from pulseframe.streaming import live

def key():
    return [F.lit("r").alias("recording_id"), F.lit(0).alias("session_id"), F.lit("8").alias("channel_id")]



@pytest.fixture(scope="module")
def series(spark):
    """1,000 samples 1 ms apart in blocks of 100: x, 1000 (x / 1000)^2, 1000 sqrt(x / 1000)."""
    x = F.col("id").cast("double")
    raw = F.array(x, F.floor(1000 * (x / 1000) ** 2).cast("double"), F.floor(1000 * F.sqrt(x / 1000)).cast("double"))
    return spark.range(1000).select(*key(), F.col("id").alias("idx"), (F.col("id") * 1000).cast("double").alias("t_us"), raw.alias("raw"), F.floor(F.col("id") / 100).cast("bigint").alias("block_seq")).cache()


def idx(df):
    return sorted(r["idx"] for r in df.select("idx").collect())


@pytest.mark.parametrize("bounds", [(None, None, 1), (10, 20, 3), (-5, None, 1), (None, -990, 2), (900, 2000, 7), (20, 10, -2), (None, None, -100), (-1, -20, -3)])
def test_index_slice(series, bounds):
    assert idx(slices.index_slice(series, *bounds)) == sorted(range(1000)[slice(*bounds)])


def test_event_at(series):
    assert idx(slices.event_at(series, -1)) == [999]
    with pytest.raises(Exception, match="out of range"):
        slices.event_at(series, 1000).collect()


def test_resample_has_the_stride_of_nine_points(series):
    assert idx(slices.resample(series, 9)) == list(range(0, 1000, 112))


def test_range_bounds(series):
    assert idx(slices.time_range(series, 1000, 3000)) == [2, 3]
    assert idx(slices.time_range(series, 1000, 3000, "closed")) == [1, 2, 3]
    assert idx(slices.time_range(series, 0, 2000)) == [0, 1, 2]


def test_range_that_ends_in_a_gap(series):
    gappy = series.where("idx < 300 or idx >= 600")
    assert idx(slices.time_range(gappy, 298_500, 400_000, gap_us=5000)) == [299, 600]
    assert idx(slices.time_range(gappy, 298_500, 400_000)) == [299, 600]  # the end is between two blocks
    assert idx(slices.time_range(gappy, 400_000, 500_000)) == [600]  # all in the gap
    assert idx(slices.time_range(gappy, 298_500, 299_000)) == [299] and idx(slices.time_range(gappy, 298_500, 650_500)) == [299, *range(600, 651)]
    assert idx(slices.time_range(gappy.drop("block_seq"), 298_500, 400_000)) == [299]


def test_before_nearest_and_interpolated(spark, series):
    probes = spark.createDataFrame([(-1.0,), (0.0,), (9500.0,), (999_000.0,)], "t_us double").select(*key(), "t_us")
    assert [r["idx"] for r in asof.index_before(probes, series).orderBy("t_us").collect()] == [-1, 0, 9, 1000]
    assert [r["near_idx"] for r in asof.nearest(probes, series).orderBy("t_us").collect()] == [0, 0, 9, 999]
    assert [r["idx"] for r in asof.index_near(probes, series).orderBy("t_us").collect()] == [0, 0, 9, 1000]
    value = [r["raw"] for r in asof.interpolate(probes, series, "clamp").orderBy("t_us").collect()]
    assert value[2][0] == 9.5 and value[0] == [0.0, 0.0, 0.0] and value[3][0] == 999.0


def test_negative_gain_keeps_order(series):
    rows = stats.calibrated_block_stats(stats.block_stats(series), -1.0, 0.0).collect()
    assert len(rows) == 30 and all(r["mn"] <= r["av"] <= r["mx"] for r in rows)


def test_medians_by_sketch(series):
    exact, near = ({r["subchannel_id"]: r["av"] for r in stats.range_stats(stats.block_stats(series), a).collect()} for a in (None, 1000))
    assert exact[0] == 499.5 and near[0] == 449.5  # of ten blocks, the fifth


def test_stored_statistics_stand_first(spark, series):
    computed = stats.block_stats(series)
    stored = computed.select(*K, "block_seq", "subchannel_id", F.lit(0.0).alias("mn"), F.lit(499.0).alias("av"), F.lit(999.0).alias("mx")).where("block_seq < 3")
    rows = {(r["block_seq"], r["subchannel_id"]): r["av"] for r in stats.prefer_stored(computed, stored).collect()}
    assert rows[2, 0] == 499.0 and rows[3, 0] == 349.5


def test_ticks_equal_a_loop(spark):
    rng, modulus, scale = random.Random(5), 1 << 16, 30.517578125
    blocks, want = [], {}
    for c in range(20):
        t, base, last = 0, 0, None
        for seq in range(60):
            pair = []
            for end in (0, 1):
                t += rng.randint(1, modulus // 2)
                absolute = rng.random() < 0.03 and t > modulus
                tick = t if absolute else t % modulus
                if tick > modulus:
                    base, last = tick - tick % modulus, tick % modulus
                else:
                    base += modulus if last is not None and tick < last else 0
                    last = tick
                pair.append(tick)
                want[str(c), seq, end] = int((base + last) * scale)
            blocks.append(("r", 0, str(c), seq, *pair))
    rows = spark.createDataFrame(blocks, "recording_id string, session_id int, channel_id string, block_seq bigint, start_tick bigint, end_tick bigint")
    for r in timebase.unroll_ticks(rows, modulus, scale).collect():
        assert (r["start_us"], r["end_us"]) == (want[r["channel_id"], r["block_seq"], 0], want[r["channel_id"], r["block_seq"], 1])


def test_edge_safe_equals_a_loop(spark):
    rng, rows, s, e = random.Random(2), [], 5000, 9000
    want = set()
    for c in range(60):
        t, series = rng.randint(0, 6000), []
        for seq in range(15):
            end = t + rng.randint(0, 900)
            series.append((seq, t, end))
            t = end + rng.choice([1, 1, 1, 700])
        keep, before = [], None
        for seq, a, b in series:
            if b < s:
                before = seq
                continue
            if not keep and a > s and before is not None:
                keep.append(before)
            keep.append(seq)
            if b >= e if a <= s else b > e:
                break
        want |= {(str(c), k) for k in keep}
        rows += [("r", 0, str(c), *x) for x in series]
    df = spark.createDataFrame(rows, "recording_id string, session_id int, channel_id string, block_seq bigint, start_us bigint, end_us bigint")
    assert {(r["channel_id"], r["block_seq"]) for r in recordings.edge_safe(df, e, s).collect()} == want
    with pytest.raises(ValueError):
        recordings.edge_safe(df, 1, 1)


def test_units(spark):
    golden = [("celsius_to_fahrenheit", 100.0, 212.0), ("celsius_to_kelvin", 0.0, 273.15), ("metres_to_feet", 1.0, 3.2808399), ("pressure_to_metres", 101325.0, 0.0), ("pressure_to_metres", 80000.0, 1948.989)]
    for name, v, want in golden:
        got, back = spark.range(1).select(units.convert(name, F.lit(v)), units.revert(name, units.convert(name, F.lit(v)))).first()
        assert got == pytest.approx(want, rel=1e-5, abs=1e-6) and back == pytest.approx(v, rel=1e-6)


def test_composition_is_the_function_of_the_function(spark):
    lit = lambda *c: F.array(*map(F.lit, c))
    one, two = calibration.expand(lit(3.0, 1.0), F.lit(5.0)), calibration.expand(lit(0.5, 2.0, -1.0, 7.0), F.lit(1.5), F.lit(2.5))
    x, y = F.lit(4.0), F.lit(9.0)
    both = calibration.bivariate(x, y, calibration.compose(two, one), F.lit(0.0), F.lit(0.0))
    apart = calibration.bivariate(calibration.univariate(x, lit(3.0, 1.0), F.lit(5.0)), y, lit(0.5, 2.0, -1.0, 7.0), F.lit(1.5), F.lit(2.5))
    got, want = spark.range(1).select(both, apart).first()
    assert got == pytest.approx(want)


def test_decoding(spark):
    payload = struct.pack("<hHf", -5, 65535, 1.5) + struct.pack("<hHf", 7, 1, -2.0)
    rows = decode.to_samples(decode.decode_payload(spark.createDataFrame([(1, payload)], "b int, payload binary"), "<hHf")).orderBy("pos").collect()
    assert [r["raw"] for r in rows] == [[-5.0, 65535.0, 1.5], [7.0, 1.0, -2.0]]
    old = struct.pack(">i", (1000 << 14) | (3 << 12))[:3] + struct.pack(">bB", -4, 8 << 4)
    p, t = spark.createDataFrame([(old,)], "p binary").select(*decode.pressure_temperature(F.col("p"))).first()
    assert (p, t) == (1000.75, -3.5)
    checked = decode.validate_blocks(spark.createDataFrame([(b"", 1, 2), (b"abc", 1, 2), (b"abcd", 3, 2), (b"abcd", 1, 2)], "payload binary, start_tick int, end_tick int"), F.lit(4))
    assert [r["rejected"] for r in checked.collect()] == [True, True, True, False]


def test_rate_and_names(spark):
    got = spark.createDataFrame([("1/4",), ("2.5",), ("x",), ("1/0",)], "s string").select(names.rate(F.col("s"))).collect()
    assert [r[0] for r in got] == [0.25, 2.5, None, None]
    assert [names.sanitise(x) for x in ("K 1", "2nd", "end", "Accel (g)")] == ["K_1", "v2Nd", "vEnd", "Accel_g"]


def test_band_rms_of_a_sine(spark):
    n, hz = 1000, 1000.0
    wave = spark.range(n).select(*key(), F.col("id").alias("idx"), (F.col("id") * 1000).cast("double").alias("t_us"), F.array(F.sin(F.col("id") * (2 * np.pi * 50 / hz))).alias("raw"))
    inside = spectrum.band_rms(wave, 1e6 / hz, 40, 60, n).first()["rms"]
    outside = spectrum.band_rms(wave, 1e6 / hz, 100, 200, n).first()["rms"]
    assert inside == pytest.approx(2**-0.5, rel=1e-3) and outside < 1e-6


def test_single_samples_and_rates(spark):
    rows = [("r", 0, "a", i, 1000 * i, None, 1) for i in range(4)]
    blocks = spark.createDataFrame(rows, "recording_id string, session_id int, channel_id string, block_seq bigint, start_us bigint, end_us bigint, n bigint")
    assert [r["rate_hz"] for r in timebase.sample_rates(blocks).orderBy("block_seq").collect()] == [1000.0] * 4
    assert timebase.intervals(blocks).first()["single_sample"]
    assert [r["t_us"] for r in timebase.sample_times(blocks).orderBy("block_seq").collect()] == [0, 1000, 2000, 3000]


def test_open_tail_and_labels(spark, series):
    rows = windows.bad_intervals(series, F.col("raw")[0] >= 995).collect()
    assert [(r["start_us"], r["end_us"]) for r in rows] == [(995_000.0, -1.0)]
    assert spark.range(1).select(windows.range_label(F.lit("T"), F.lit(None).cast("double"), F.lit(5.0), F.lit("°C"))).first()[0] == "T above 5.0°C"


def test_exports(spark, series, tmp_path):
    assert sinks.export_csv(sinks.csv_columns(slices.head(series, 5), ["X", "Y", "Z"]), str(tmp_path / "csv")) == 5
    back = spark.read.option("sep", ", ").option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["time", "X", "Y", "Z"] and back.count() == 5
    sinks.export_arrays(series, {"channel names": series.select("channel_id").distinct()}, str(tmp_path / "out"), 400)
    assert spark.read.parquet(str(tmp_path / "out/samples")).count() == 1000


def test_user_data_and_attributes(spark):
    data = spark.createDataFrame([("r", 1, "a", "x"), ("r", 2, "a", "y"), ("r", 2, "b", "z")], "recording_id string, version int, key string, value string")
    changed = metadata.replace_user_data(data, spark.createDataFrame([("r", "b", None)], "recording_id string, key string, value string"))
    assert {(r["key"], r["value"]) for r in metadata.latest_user_data(changed).collect()} == {("a", "y")}
    maps = spark.createDataFrame([("r", "o", {"n": "5", "f": "1.5", "s": "text"})], "recording_id string, owner string, attributes map<string,string>")
    coded = {r["name"]: r for r in metadata.encode_attributes(maps).collect()}
    assert (coded["n"]["v_int"], coded["f"]["v_double"], coded["s"]["v_string"]) == (5, 1.5, "text")


def test_crawl(spark, tmp_path):
    for p in ("a/x.rec", "a/b/y.rec", ".git/z.rec", "a/n.txt"):
        (tmp_path / "in" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / p).write_text("1")
    found = lambda **k: sorted(r["path"].rsplit("/", 1)[1] for r in recordings.crawl(spark, str(tmp_path / "in"), model.shared_path(spark, "listed"), "*.rec", **k).collect())
    assert found() == ["x.rec", "y.rec"] and found(max_depth=2) == ["x.rec"]
    # what is excluded, hidden or too deep isn't entered
    seen = lambda **k: sorted(r["path"].split("/in/")[1] for r in recordings.listed(spark, str(tmp_path / "in"), model.shared_path(spark, "listed"), **k).collect())
    assert seen() == ["a", "a/b", "a/b/y.rec", "a/n.txt", "a/x.rec"] and seen(max_depth=2) == ["a", "a/b", "a/n.txt", "a/x.rec"] and seen(excluded=("b",)) == ["a", "a/n.txt", "a/x.rec"]
    assert found(excluded=("a",)) == []


def test_block_range_starts_one_block_early(spark):
    blocks = spark.range(10).select(*key(), F.col("id").alias("block_seq"), (F.col("id") * 100).alias("start_us"), (F.col("id") * 100 + 99).alias("end_us"))
    kept = lambda *x: sorted(r["block_seq"] for r in slices.block_range(blocks, *x).collect())
    assert kept(450, 620) == [3, 4, 5, 6] and kept(0, 10) == [0] and kept(800, -100) == [7, 8]


def test_padded_resampling(series):
    assert idx(slices.resampled_range(series, 0, 100_000, 10, 20)) == list(range(0, 122, 13))


def test_display_names(spark):
    rows = spark.createDataFrame([(None, "Pressure"), ("Air Pressure", "Pressure"), ("X (100g)", "Acceleration"), ("Control Pad T", None), (None, None)], "name string, label string")
    full = names.subchannel_name(F.col("name"), F.lit("Main"), F.lit(3))
    assert [r[0] for r in rows.select(names.display_name(F.col("name"), F.col("label"), full)).collect()] == ["Pressure", "Air Pressure", "Acceleration: X (100g)", "Control Pad T", "Main:03"]
    assert [r[0] for r in rows.select(full).collect()][3:] == ["Control Pad Temperature", "Main:03"]


def test_accelerometer_ranges(spark):
    kinds = spark.createDataFrame([(18,), (7,), (300,), (None,)], "k int")
    assert [r[0] for r in kinds.select(metadata.accelerometer_range(F.col("k"))).collect()] == [100.0, 25.0, 100.0, 100.0]


def test_catalogue_shows_all_for_debugging(spark):
    rows = spark.createDataFrame([("b", "b", 0), ("DEBUG a", "a", 0), ("c", "c", 10)], "name string, display_name string, visibility int")
    shown = lambda **k: [r["display_name"] for r in metadata.catalogue(rows, **k).collect()]
    assert shown() == ["b"] and shown(visibility=10) == ["b", "c"] and shown(debug=True) == ["a", "b", "c"]


def test_late_rows_are_routed(spark, tmp_path):
    rows = lambda *hours: spark.createDataFrame([(h,) for h in hours], "h int").select("h", F.timestamp_seconds(F.col("h") * 3600).alias("ts")).coalesce(1)
    for i, hours in enumerate([(100, 1), (99, 98, 40, 101)]):
        rows(*hours).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("h int, ts timestamp").parquet(str(tmp_path / "in"))
        live.route_late(stream, str(tmp_path / "out"), str(tmp_path / "state"), "2 hours").awaitTermination()
    got = lambda name: {(r["h"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "out" / name)).collect()}
    assert got("data") == {(100, 0), (1, 0), (99, 1), (98, 1), (101, 1)} and got("late") == {(40, 1)}


def ticks_by_loop(ticks, modulus):
    base, last = 0, None
    for tick in ticks:
        if tick > modulus:
            base, last = tick - tick % modulus, tick % modulus
        else:
            base += modulus if last is not None and tick < last else 0
            last = tick
        yield base + last


def random_ticks(rng, n, modulus):
    t = 0
    for _ in range(n):
        t += rng.randint(1, modulus // 2)
        yield t if rng.random() < 0.02 and t > modulus else t % modulus


def test_ticks_are_unrolled_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(timebase, "TICK_BUCKET", 7)
    rng, modulus, want, blocks = random.Random(8), 1 << 16, {}, []
    for c in ("a", "b", None):
        ticks = list(random_ticks(rng, 120, modulus))
        want |= {(c, i): t for i, t in enumerate(ticks_by_loop(ticks, modulus))}
        blocks += [("r", 0, c, i, t, None) for i, t in enumerate(ticks)]
    rows = spark.createDataFrame(blocks, "recording_id string, session_id int, channel_id string, block_seq bigint, start_tick bigint, end_tick bigint")
    got = timebase.unroll_ticks(rows, modulus, 1.0)
    assert {(r["channel_id"], r["block_seq"]): r["start_us"] for r in got.collect()} == want
    # windows see bucket rows when they are by series alone
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "[recording_id" in plan and not any("_end" in line and "_b" not in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window"))


def test_live_ticks_and_intervals_carry_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(timebase, "TICK_BUCKET", 7)
    monkeypatch.setattr(timebase, "BUCKET_ROWS", 5)
    rng, modulus = random.Random(9), 1 << 16
    series = [(rec, ch) for rec in ("one", "two") for ch in ("8", "9")]  # two recorders with channels of the same name
    ticks = {c: list(random_ticks(rng, 90, modulus)) for c in series}
    values = {c: [rng.choice([0.0, 1.0, 1.0, None]) for _ in range(90)] for c in series}
    shape = "recording_id string, session_id int, channel_id string, seq bigint, tick bigint, t_us bigint, v double"
    for n in range(3):
        rows = [(c[0], 0, c[1], i, ticks[c][i], i * 1000, values[c][i]) for c in series for i in range(30 * n, 30 * n + 30) if (c, n) != (("one", "9"), 1)]
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        live.live_ticks(stream, modulus, 1.0, str(tmp_path / "t"), str(tmp_path / "ct")).awaitTermination()
        live.live_intervals(stream, 0.5, 1.5, str(tmp_path / "i"), str(tmp_path / "ci")).awaitTermination()
    got_t = {(r["recording_id"], r["channel_id"], r["seq"]): r["t_us"] for r in spark.read.parquet(str(tmp_path / "t" / "data")).collect()}
    want_t = {}
    for c in series:
        at = [i for i in range(90) if c != ("one", "9") or not 30 <= i < 60]
        want_t |= {(*c, i): t for i, t in zip(at, ticks_by_loop([ticks[c][i] for i in at], modulus))}
    assert got_t == want_t
    closed = spark.read.parquet(str(tmp_path / "i" / "data")).drop("batch")
    got_i = sorted(tuple(r) for r in closed.unionByName(live.open_intervals(spark, str(tmp_path / "i"))).collect())
    rest = spark.read.schema(shape).parquet(str(tmp_path / "in")).withColumn("idx", F.col("seq"))
    want_i = sorted(tuple(r) for r in windows.bad_intervals(rest, ~windows.in_range(F.col("v"), 0.5, 1.5)).collect())  # at rest
    assert got_i == want_i and len(got_i) > 40


def test_dense_series_spread_over_tasks(spark, monkeypatch):
    """A million samples in a minute."""
    n = 1_000_000
    rows = spark.range(n).select(*key(), (F.col("id") * 60).cast("double").alias("t_us"), F.array((F.col("id") % 1000).cast("double")).alias("raw"))
    rows = rows.unionByName(spark.range(100).select(F.lit("r").alias("recording_id"), F.lit(0).alias("session_id"), F.lit("9").alias("channel_id"), (F.col("id") * 1e9).alias("t_us"), F.array(F.lit(0.0)).alias("raw")))
    monkeypatch.setattr(timebase, "BUCKET_ROWS", 20_000)
    buckets = timebase.time_buckets(rows, rows).groupBy("channel_id", "_b").count().collect()
    assert len([r for r in buckets if r["channel_id"] == "8"]) >= 50 and max(r["count"] for r in buckets) <= 21_000
    assert [r["_b"] for r in buckets if r["channel_id"] == "9"] == [0]
    indexed = timebase.add_index(rows)
    assert indexed.where("channel_id = '8' and idx <> t_us / 60").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # at this size all would go to one task again
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spread = timebase.add_index(rows).where("channel_id = '8'").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(spread) > 8 and max(r["count"] for r in spread) < n / 5
    probes = indexed.where("channel_id = '8' and idx % 1000 = 7").select(*K, (F.col("t_us") + 1).alias("t_us"), F.col("idx").alias("want"))
    assert asof.index_before(probes, indexed).where("idx <> want").count() == 0
    bad = windows.bad_intervals(indexed, F.col("raw")[0] >= 990).where("channel_id = '8'")
    assert bad.count() == 1000 and bad.where("end_us <> start_us + 600 and end_us <> -1").count() == 0


def test_whole_numbers_stay_exact(spark):
    big = [2**63 - 1, -(2**63), 0, 2**53 + 1]
    rows = spark.createDataFrame([(1, struct.pack("<4q", *big)), (2, None), (3, b""), (4, struct.pack("<q", 5) + b"xx")], "b int, payload binary")
    got = {r["b"]: r["samples"] for r in decode.decode_payload(rows, "<q").collect()}
    assert got == {1: [[x] for x in big], 2: None, 3: [], 4: [[5]]}
    rows = spark.createDataFrame([(struct.pack(">Qb", 2**64 - 1, -3),)], "payload binary")
    assert [[int(v) for v in s] for s in decode.decode_payload(rows, ">Qb").first()["samples"]] == [[2**64 - 1, -3]]
    decode.register_decoder("pairs", lambda p: np.frombuffer(p, np.uint8).reshape(-1, 2).astype(float))
    assert decode.decode_payload(spark.createDataFrame([(b"abcd",)], "payload binary"), "pairs").first()["samples"] == [[97.0, 98.0], [99.0, 100.0]]


def test_jitter_keeps_the_ends_and_the_reach(series):
    got = [r["idx"] for r in slices.jittered(series, 50, 0.5, 3).orderBy("idx").collect()]
    assert len(got) == 20 and got[0] == 0 and got[-1] == 950
    assert all(abs(g - 50 * i) <= 25 for i, g in enumerate(got)) and len({g - 50 * i for i, g in enumerate(got)}) > 8
    assert idx(slices.jittered(series, 4, 0.1)) == list(range(0, 1000, 4))
    many = idx(slices.resampled_range(series, 0, 500_000, 10, jitter=0.5))
    plain = idx(slices.resampled_range(series, 0, 500_000, 10))
    assert len(many) == len(plain) and many != plain and (many[0], many[-1]) == (plain[0], plain[-1])


def test_wide_calibration_equals_the_long_one(spark, series):
    lines = spark.createDataFrame([("r", "8", 0, [2.0, 1.0], None, None), ("r", "8", 1, [0.5, 1.0, 2.0, 3.0], "8", 0)], "recording_id string, channel_id string, subchannel_id int, c array<double>, y_channel_id string, y_subchannel_id int")
    for mode in ("mean", "off"):
        wide = {r["idx"]: r["raw"] for r in calibration.calibrate_samples(series, lines, mode).collect()}
        long = calibration.calibrate(stats.long_form(series), lines, mode).collect()
        assert len(long) == 3000 and all(wide[r["idx"]][r["subchannel_id"]] == pytest.approx(r["v"]) for r in long)
    less = sinks.export_samples(series, remove_mean=True).collect()
    assert abs(sum(r["raw"][2] for r in less)) < 1e-6
    rolling = {r["idx"]: r["raw"][0] for r in sinks.export_samples(series, remove_mean=True, mean_span_us=0).collect()}
    assert rolling[0] == -49.5 and rolling[999] == 49.5


def test_extract_splits_channels(spark, tmp_path):
    blocks = spark.range(50).select(*key(), F.col("id").alias("block_seq"), (F.col("id") * 10).alias("start_us"), (F.col("id") * 10 + 9).alias("end_us"), F.lit(b"abc").alias("payload"))
    assert tuple(recordings.extract(blocks, str(tmp_path / "x"), 0, 10_000, 8).first()) == (50, 150)
    assert len(list((tmp_path / "x").rglob("*.parquet"))) >= 7


def test_calibrate_by_another_channel(spark):
    rows = spark.createDataFrame([("r", s, c, 0, v) for s, c, v in ((0, "x", 1.0), (0, "x", 2.0), (0, "y", 4.0), (0, "y", 6.0), (1, "x", 1.0))], "recording_id string, session_id int, channel_id string, subchannel_id int, v double")
    shape = "recording_id string, channel_id string, subchannel_id int, c array<double>, y_channel_id string, y_subchannel_id int"
    got = lambda lines, *mode: sorted((r["session_id"], r["channel_id"], r["v"]) for r in calibration.calibrate(rows, spark.createDataFrame(lines, shape), *mode).collect())
    x, y = ("r", "x", 0, [1.0, 2.0, 10.0, 5.0], "y", 0), ("r", "y", 0, [2.0, 1.0], None, None)  # the mean of y is 11
    assert got([x, y]) == [(0, "x", 128.0), (0, "x", 141.0), (0, "y", 9.0), (0, "y", 13.0), (1, "x", 7.0)]
    assert got([x, y], "off") == [(0, "x", 7.0), (0, "x", 9.0), (0, "y", 9.0), (0, "y", 13.0), (1, "x", 7.0)]
    with pytest.raises(Exception, match="compensated itself"):
        got([x, ("r", "y", 0, [1.0, 2.0, 10.0, 5.0], "x", 0)])
