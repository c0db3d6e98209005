"""Registered queries on metadata, payload formats, calibration lines, names and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calibration, names, units
from ..operators import slices, stats, timebase, windows
from ..schema import K
from ..sources import decode, metadata, recordings, sinks
from ..streaming import live
from . import model
from .registry import DAY, ORACLES, _attributes, _jitter, _NEAREST, _packed, _probes, _range, _T, query, r

# Summaries and slices


@query("SELECT channel_id, round(avg(mean), 4) AS mean FROM (SELECT channel_id, sum(av * n) / sum(n) AS mean FROM b GROUP BY channel_id, subchannel_id) GROUP BY channel_id")
def channel_means(spark, d):
    return stats.channel_mean(stats.weighted_mean(model.stats(spark, d))).select("channel_id", r("mean"))


@query("""SELECT channel_id, block_seq, subchannel_id, round(-2 * mx + 3 - (-2 * m + 3) + 1e-7, 4) AS mn, round(-2 * av + 3 - (-2 * m + 3) + 1e-7, 4) AS av, round(-2 * mn + 3 - (-2 * m + 3) + 1e-7, 4) AS mx
FROM b JOIN (SELECT channel_id, subchannel_id, median(av) AS m FROM b GROUP BY ALL) USING (channel_id, subchannel_id)""")
def block_stats_mean_removed(spark, d):
    rows = stats.block_medians(model.stats(spark, d))
    return stats.calibrated_block_stats(rows, -2.0, 3.0, mean_of=F.col("median") * -2.0 + 3.0).select("channel_id", "block_seq", "subchannel_id", *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("mn", "av", "mx")))


@query("""SELECT channel_id, block_seq, subchannel_id, round(CASE WHEN block_seq % 2 = 0 THEN 0 ELSE mn END, 4) AS mn, round(CASE WHEN block_seq % 2 = 0 THEN 499 ELSE av END, 4) AS av,
round(CASE WHEN block_seq % 2 = 0 THEN 999 ELSE mx END, 4) AS mx FROM b""")
def stored_block_stats(spark, d):
    """Every other block came with a summary of its own."""
    rows = model.stats(spark, d)
    stored = rows.where("block_seq % 2 = 0").withColumns({"mn": F.lit(0.0), "av": F.lit(499.0), "mx": F.lit(999.0)})
    return stats.prefer_stored(rows, stored).select("channel_id", "block_seq", "subchannel_id", r("mn"), r("av"), r("mx"))


@query(f"""SELECT channel_id, idx, t_us FROM s JOIN (SELECT channel_id, greatest(a - 5, 0) AS a, least(z + 7, n) AS z, greatest(ceil((least(z + 7, n) - greatest(a - 5, 0)) / 200), 1)::BIGINT AS step
FROM (SELECT channel_id, min(idx) FILTER (inside) AS a, max(idx) FILTER (inside) AS z, count(*) AS n
FROM (SELECT *, (t_us > {_T} + {10 * DAY} AND t_us <= {_T} + {100 * DAY}) OR (t_us > {_T} + {100 * DAY} AND lag(t_us) OVER (PARTITION BY channel_id ORDER BY idx) < {_T} + {100 * DAY} AND idx % 64 = 0) AS inside FROM s) GROUP BY channel_id)) USING (channel_id) WHERE idx >= a AND idx < z AND (idx - a) % step = 0""")
def resampled_padded(spark, d):
    s = model.samples(spark, d)
    return slices.resampled_range(s, *_range(model.raw_samples(spark, d)), 200, 5).select("channel_id", "idx", "t_us")


@query("SELECT p.idx AS probe, v.block_seq FROM (SELECT * FROM s WHERE channel_id = 'purchase') p ASOF LEFT JOIN (SELECT * FROM bb WHERE channel_id = 'view') v ON p.t_us >= v.start_us")
def block_of_time(spark, d):
    p, _ = _probes(spark, d)
    return slices.locate_blocks_by_time(p, model.blocks(spark, d)).select("probe", "block_seq")


@query("SELECT channel_id, idx, subchannel_id, round(v - CASE WHEN channel_id IN ('click', 'view') THEN avg(v) OVER (PARTITION BY channel_id, subchannel_id) ELSE 0 END, 4) AS v FROM l")
def mean_removed_where_allowed(spark, d):
    return windows.remove_mean(model.samples(spark, d), F.col("channel_id").isin("click", "view")).select("channel_id", "idx", "subchannel_id", r("v"))


# Payloads


@query("SELECT vec_id, (i - 5) // 3 AS pos, round(embedding[i]::DOUBLE * 1e6)::DOUBLE AS v FROM (SELECT *, unnest(range(5, 41, 3)) AS i FROM embeddings)", plain=True)
def decode_slice(spark, d):
    """Samples [4:40:3] of each block."""
    rows = decode.to_samples(decode.pick(decode.decode_payload(_packed(spark, d), "<i"), 4, 40, 3))
    return rows.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("raw")[0].alias("v"))


@query("SELECT label AS channel_id, count(*) AS blocks, count(*) FILTER (vec_id % 5 = 0) AS rejected, 64 * count(*) FILTER (vec_id % 5 <> 0) AS samples FROM embeddings GROUP BY label", plain=True)
def count_samples(spark, d):
    """Every fifth block has a damaged tail."""
    p = _packed(spark, d).withColumns({"start_tick": F.lit(1), "end_tick": F.lit(2)})
    cut = p.withColumn("payload", F.when(F.col("vec_id") % 5 == 0, F.substring("payload", 1, 254)).otherwise(F.col("payload")))
    return decode.count_samples(decode.validate_blocks(cut, F.lit(4)), F.lit(4), ["channel_id"])


def _hex(v: Column, digits: int) -> Column:
    return F.lpad(F.hex(v), digits, "0")


@query("""SELECT o_orderkey, floor(CASE WHEN p >= 8388608 THEN p - 16777216 ELSE p END / 64.0)::DOUBLE + ((p >> 4) & 3) * 0.25::DOUBLE AS pressure, floor(CASE WHEN t >= 32768 THEN t - 65536 ELSE t END / 256.0)::DOUBLE + ((t >> 4) & 15) * 0.0625::DOUBLE AS temperature
FROM (SELECT o_orderkey, (o_orderkey * 7919) % 16777216 AS p, (o_orderkey * 31) % 65536 AS t FROM orders)""", plain=True)
def pressure_temperature(spark, d):
    key = F.col("o_orderkey")
    five = F.unhex(F.concat(_hex(key * 7919 % 16777216, 6), _hex(key * 31 % 65536, 4)))
    p, t = decode.pressure_temperature(five)
    return model.table(spark, d, "orders").select("o_orderkey", p.cast("double").alias("pressure"), t.cast("double").alias("temperature"))


@query("SELECT o_orderkey, 32768 - o_orderkey * 3 % 65536 AS a, o_custkey % 65536 - 32768 AS b, o_orderkey % 65536 - 32768 AS c FROM orders", plain=True)
def inverted_axes(spark, d):
    v = decode.inverted_xyz(F.col("o_orderkey") % 65536, F.col("o_custkey") % 65536, F.col("o_orderkey") * 3 % 65536)
    return model.table(spark, d, "orders").select("o_orderkey", *(v[i].alias(c) for i, c in enumerate("abc")))


@query("SELECT o_orderkey, o_orderkey * 17 % 65536 AS tick, o_custkey % 256 AS channel FROM orders", plain=True)
def block_headers(spark, d):
    tick, channel = decode.header(F.unhex(F.concat(_hex(F.col("o_orderkey") * 17 % 65536, 4), _hex(F.col("o_custkey") % 256, 2), F.lit("FFFF"))))
    return model.table(spark, d, "orders").select("o_orderkey", tick.alias("tick"), channel.alias("channel"))


@query("""SELECT p_partkey, x.i AS subchannel_id, x.code, x.lo, x.hi FROM part JOIN (VALUES (0, 0, 'h', -32768::DOUBLE, 32767::DOUBLE), (0, 1, 'H', 0, 65535), (0, 2, 'f', -1, 1), (1, 0, 'c', NULL, NULL), (1, 1, 'B', 0, 255), (2, 0, 'i', -2147483648, 2147483647)) x(f, i, code, lo, hi) ON p_size % 3 = x.f""", plain=True)
def value_ranges(spark, d):
    fmt = F.element_at(F.array(*map(F.lit, ("<hHf", ">cB", "i"))), (F.col("p_size") % 3 + 1).cast("int"))
    return decode.value_ranges(model.table(spark, d, "part").select(F.col("p_partkey").alias("channel_id"), fmt.alias("format"))).withColumnRenamed("channel_id", "p_partkey")


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 4 > 0 THEN p_size / (p_partkey % 4) WHEN p_partkey % 8 = 0 THEN p_size END, 6) AS rate FROM part", plain=True)
def declared_rates(spark, d):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 8 == 0, size).otherwise(F.concat(size, F.lit(" / "), (F.col("p_partkey") % 4).cast("string")))
    return model.table(spark, d, "part").select("p_partkey", F.round(names.rate(text), 6).alias("rate"))


# Calibration lines


@query("SELECT event_id, round(value * 25 / 32767, 6) AS v FROM events", plain=True)
def accelerometer_scale(spark, d):
    return model.raw_samples(spark, d).select("event_id", F.round(calibration.accelerometer(F.col("raw")[0], 25.0), 6).alias("v"))


@query("SELECT event_id, round((value - 5) * 9 / 90 - 1, 6) AS v FROM events", plain=True)
def mapped_range(spark, d):
    return model.raw_samples(spark, d).select("event_id", F.round(names.map_range(F.col("raw")[0], 5.0, 95.0, -1.0, 8.0), 6).alias("v"))


@query("SELECT channel_id, idx, subchannel_id, round(ln(1 + abs(v)), 6) AS v FROM l")
def custom_stage(spark, d):
    return calibration.custom(stats.long_form(model.samples(spark, d)), lambda v: F.ln(F.abs(v) + 1)).select("channel_id", "idx", "subchannel_id", r("v", 6))


def _lines(spark, d) -> DataFrame:
    """A transform per supplier, of its nation's recording; every third reads another channel."""
    two = F.col("s_suppkey") % 3 == 0
    n = F.when(two, 4).otherwise(F.col("s_suppkey") % 4)
    c = F.transform(F.slice(F.array(*map(F.lit, (1.5, 2.5, 0.5, 4.5))), F.lit(1), n.cast("int")), lambda x: x + F.col("s_suppkey"))
    return model.table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("recording_id"), F.col("s_suppkey").alias("transform_id"), F.when(two, "bivariate").otherwise("univariate").alias("kind"), c.alias("c"),
        F.when(two & (F.col("s_suppkey") % 9 > 0), F.col("s_suppkey") % 10).alias("y_channel_id"),
    )


@query("""SELECT s_suppkey AS transform_id, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 9 = 0 THEN 'bivariate needs four coefficients and a channel' ELSE 'ok' END
WHEN s_suppkey % 4 = 0 THEN 'no coefficients' WHEN s_suppkey % 4 = 3 THEN 'univariate takes one or two coefficients' ELSE 'ok' END AS reason FROM supplier""", plain=True)
def checked_transforms(spark, d):
    good, bad = metadata.check_transforms(_lines(spark, d))
    return good.select("transform_id", F.lit("ok").alias("reason")).unionByName(bad.select("transform_id", "reason"))


@query("""SELECT s_suppkey AS transform_id FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 9 = 0 OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10)""", plain=True)
def valid_transforms(spark, d):
    """A nation's customers are blocks of ten channels."""
    blocks = model.table(spark, d, "customer").select(F.col("c_nationkey").alias("recording_id"), (F.col("c_custkey") % 10).alias("channel_id"))
    return calibration.valid_transforms(_lines(spark, d), blocks).select("transform_id")


@query("""SELECT s_nationkey AS recording_id, s_suppkey AS transform_id, '{"recording_id":' || s_nationkey || ',"transform_id":' || s_suppkey || ',"kind":"line"}' AS record FROM supplier""", plain=True)
def transform_records(spark, d):
    return calibration.as_records(_lines(spark, d).select("recording_id", "transform_id", F.lit("line").alias("kind")))


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 5 > 0 THEN p_size % 5 END, CASE WHEN p_partkey % 7 BETWEEN 1 AND 4 THEN p_partkey % 7 END) AS transforms FROM part""", plain=True)
def transform_lineage(spark, d):
    """Parts are subchannels of channels by size; transforms 1 to 4 exist."""
    p = model.table(spark, d, "part").select(F.lit(1).alias("recording_id"), F.col("p_size").alias("channel_id"), F.col("p_partkey").alias("subchannel_id"), (F.col("p_partkey") % 7).alias("transform_id"))
    channels = p.select("recording_id", "channel_id").distinct().withColumn("transform_id", F.col("channel_id") % 5)
    known = spark.range(1, 5).select(F.lit(1).alias("recording_id"), F.col("id").alias("transform_id"))
    return calibration.lineage(p, channels, known).select(F.col("subchannel_id").alias("p_partkey"), F.array_join("transforms", ",").alias("transforms"))


@query("""SELECT channel_id, idx, round(3 * v0 - 14, 4) AS channel, round(2 * (3 * v0 - 14) + 0.5, 4) AS whole, round(1.8 * (2 * (3 * v0 - 14) + 0.5) + 32, 4) AS display FROM s""")
def calibration_levels(spark, d):
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    line = spark.range(1).select(pair(3.0, -14.0).alias("channel_c"), pair(2.0, 0.5).alias("own_c"), pair(1.8, 32.0).alias("display_c"))
    rows = model.samples(spark, d)
    for name, level in (("channel", "channel"), ("whole", "full"), ("display", "display")):
        rows = rows.withColumn("recording_id", F.lit("demo")).join(F.broadcast(calibration.levels(line, level).select(F.lit("demo").alias("recording_id"), "c")), "recording_id")
        rows = rows.withColumn(name, F.round(calibration.univariate(F.col("raw")[0], F.col("c"), F.lit(0.0)), 4)).drop("c")
    return rows.select("channel_id", "idx", "channel", "whole", "display")


@query("""SELECT channel_id, idx, subchannel_id, round(CASE WHEN channel_id = 'purchase' AND subchannel_id = 0 THEN 0.001::DOUBLE * (3 * (v - 5) + 1 - 10) * (y - 3) + 1.5::DOUBLE * (3 * (v - 5) + 1 - 10) - 0.25::DOUBLE * (y - 3) + 4
WHEN channel_id = 'purchase' THEN 3 * (v - 5) + 1 WHEN channel_id = 'view' AND subchannel_id = 1 THEN 2 * (v - 4) - 1 WHEN channel_id = 'click' AND subchannel_id = 0 THEN 0.5::DOUBLE * (v - 2) + 9 ELSE v END + 1e-7, 3) AS v
FROM l, (SELECT 2 * (avg(v1) - 4) - 1 AS y FROM s WHERE channel_id = 'view')""")
def calibrated_recording(spark, d):
    """Purchases by their channel's line, then compensated by views' calibrated k; clicks by a line whose other channel has no effect."""
    channels = model.table(spark, d, "events").select(F.lit("demo").alias("recording_id"), F.col("event_type").alias("channel_id")).distinct()
    subs = channels.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("subchannel_id"))
    on = lambda c, i, n: F.when((F.col("channel_id") == c) & (F.col("subchannel_id") == i), F.lit(n))
    subs = subs.withColumn("transform_id", F.coalesce(on("purchase", 0, 2), on("view", 1, 3), on("click", 0, 4)))
    channels = channels.withColumn("transform_id", F.when(F.col("channel_id") == "purchase", 1))
    table = [("demo", 1, [3.0, 1.0], 5.0, None, None, None), ("demo", 2, [0.001, 1.5, -0.25, 4.0], 10.0, 3.0, "view", 1), ("demo", 3, [2.0, -1.0], 4.0, None, None, None), ("demo", 4, [0.0, 0.5, 0.0, 9.0], 2.0, 7.0, "view", 0)]
    transforms = spark.createDataFrame(table, "recording_id string, transform_id int, c array<double>, x_ref double, y_ref double, y_channel_id string, y_subchannel_id int")
    means = calibration.series_means(stats.long_form(model.raw_samples(spark, d)))  # needs no index
    out = stats.long_form(calibration.calibrate_samples(model.samples(spark, d), calibration.composed_lines(channels, subs, transforms), means=means))
    return out.select("channel_id", "idx", "subchannel_id", F.round(F.col("v") + 1e-7, 3).alias("v"))


def _purchase_lines(spark) -> DataFrame:
    """Purchases compensated by views' calibrated k."""
    table = [("demo", "purchase", 0, [0.001, 1.5, -0.25, 4.0], "view", 1), ("demo", "view", 1, [2.0, -9.0], None, None)]
    return spark.createDataFrame(table, "recording_id string, channel_id string, subchannel_id int, c array<double>, y_channel_id string, y_subchannel_id int")


_LINE = "round(0.001::DOUBLE * v0 * y + 1.5::DOUBLE * v0 - 0.25::DOUBLE * y + 4 + 1e-7, 3) AS v"


@query(f"{_NEAREST} SELECT idx, {_LINE} FROM (SELECT *, 2 * CASE WHEN pt IS NULL OR nt - t_us < t_us - pt THEN nv ELSE pv END - 9 AS y FROM n)")
def calibrated_nearest(spark, d):
    """Compensated by the value that is nearest in time."""
    rows = stats.long_form(model.samples(spark, d, "purchase", "view"))
    out = calibration.calibrate(rows, _purchase_lines(spark), "nearest").where("channel_id = 'purchase' and subchannel_id = 0")
    return out.select("idx", F.round(F.col("v") + 1e-7, 3).alias("v"))


@query(f"SELECT idx, {_LINE} FROM (SELECT *, idx % 7 AS y FROM s WHERE channel_id = 'purchase')")
def calibrated_supplied(spark, d):
    """Compensated by a column of the samples."""
    rows = stats.long_form(model.samples(spark, d, "purchase")).withColumn("y", (F.col("idx") % 7).cast("double"))
    out = calibration.calibrate(rows, _purchase_lines(spark), "supplied").where("subchannel_id = 0")
    return out.select("idx", F.round(F.col("v") + 1e-7, 3).alias("v"))


@query("SELECT s_suppkey AS transform_id, CASE WHEN s_suppkey % 5 = 0 THEN 'replaced' WHEN s_suppkey % 3 = 0 THEN 'bivariate' ELSE 'univariate' END AS kind FROM supplier", plain=True)
def replaced_transforms(spark, d):
    lines = _lines(spark, d)
    return calibration.replace_transforms(lines, lines.where("transform_id % 5 = 0").withColumn("kind", F.lit("replaced"))).select("transform_id", "kind")


# Names and dimensions


@query("""SELECT p_partkey, CASE WHEN named THEN p_brand ELSE 'Part:' || lpad((p_partkey % 3)::VARCHAR, 2, '0') END AS name, CASE WHEN label IS NULL THEN CASE WHEN named THEN p_brand ELSE 'Part:' || lpad((p_partkey % 3)::VARCHAR, 2, '0') END WHEN NOT named THEN label
WHEN contains(p_brand, label) THEN p_brand ELSE label || ': ' || p_brand END AS display_name, string_split(p_type, ' ')[1] AS axis FROM (SELECT *, p_partkey % 5 <> 0 AS named, CASE p_size % 3 WHEN 0 THEN 'Brand' WHEN 1 THEN 'Weight' END AS label FROM part)""", plain=True)
def display_names(spark, d):
    name = F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand"))
    label = F.when(F.col("p_size") % 3 == 0, "Brand").when(F.col("p_size") % 3 == 1, "Weight")
    full = names.subchannel_name(name, F.lit("Part"), F.col("p_partkey") % 3)
    return model.table(spark, d, "part").select("p_partkey", full.alias("name"), names.display_name(name, label, full).alias("display_name"), names.axis(F.col("p_type")).alias("axis"))


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'g' END, n_name) AS units FROM supplier JOIN nation ON s_nationkey = n_nationkey", plain=True)
def effective_units(spark, d):
    rows = model.table(spark, d, "supplier").join(model.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", names.units(F.when(F.col("s_suppkey") % 3 == 0, "g"), F.col("n_name")).alias("units"))


@query("SELECT event_id, strftime(make_timestamp(user_id * 86400000000 + event_id * 1500), '%Y-%m-%d %H:%M:%S') AS wall FROM events", plain=True)
def wall_times(spark, d):
    wall = names.wall_time(F.col("user_id") * 86_400, F.col("event_id") * 1500)
    return model.raw_samples(spark, d).select("event_id", F.date_format(wall, "yyyy-MM-dd HH:mm:ss").alias("wall"))


@query("""SELECT p_partkey, p_brand || CASE p_size % 3 WHEN 0 THEN ' above ' || p_size || 'g' WHEN 1 THEN ' below 1g' ELSE ' outside range 1g to ' || p_size || 'g' END AS label FROM part""", plain=True)
def range_labels(spark, d):
    kind = F.col("p_size") % 3
    return model.table(spark, d, "part").select("p_partkey", windows.range_label(F.col("p_brand"), F.when(kind != 0, F.lit(1)), F.when(kind != 1, F.col("p_size")), F.lit("g")).alias("label"))


@query("SELECT c_custkey AS channel_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", plain=True)
def used_channels(spark, d):
    channels = model.table(spark, d, "customer").select(F.lit(1).alias("recording_id"), F.col("c_custkey").alias("channel_id"))
    return metadata.used_channels(channels, model.table(spark, d, "orders").select(F.lit(1).alias("recording_id"), F.col("o_custkey").alias("channel_id"))).select("channel_id")


@query("SELECT s_suppkey, n_nationkey * 10 AS cutoff, n_nationkey + 5 AS rolloff FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey", plain=True)
def bandwidth_limits(spark, d):
    sensors = model.table(spark, d, "supplier").select(F.lit(1).alias("recording_id"), "s_suppkey", F.col("s_nationkey").alias("bw_limit_id"))
    limits = model.table(spark, d, "nation").where("n_regionkey <> 2").select(F.lit(1).alias("recording_id"), F.col("n_nationkey").alias("bw_limit_id"), (F.col("n_nationkey") * 10).alias("cutoff"), (F.col("n_nationkey") + 5).alias("rolloff"))
    return metadata.bandwidth(sensors, limits).select("s_suppkey", "cutoff", "rolloff")


@query("""SELECT k AS channel_id, i AS subchannel_id, coalesce(p_brand, 'Ch ' || k || ':' || lpad(i::VARCHAR, 2, '0')) AS name, p_type AS label, CASE WHEN p_partkey % 2 = 0 THEN -1 END AS lo, CASE WHEN p_partkey % 2 = 0 THEN 1 END AS hi
FROM (SELECT k, unnest(range(4)) AS i FROM (SELECT DISTINCT p_size AS k FROM part)) LEFT JOIN (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_size, p_partkey % 3 ORDER BY p_partkey) = 1) ON k = p_size AND i = p_partkey % 3""", plain=True)
def subchannel_dimension(spark, d):
    """Channels by size with four subchannels, three of them described, often more than once; every other display range lacks an end."""
    key = [F.lit(1).alias("recording_id"), F.col("p_size").alias("channel_id")]
    p = model.table(spark, d, "part")
    told = p.select(*key, (F.col("p_partkey") % 3).cast("int").alias("subchannel_id"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("label"), F.col("p_type").alias("unit"), F.lit(-1).alias("lo"), F.when(F.col("p_partkey") % 2 == 0, 1).alias("hi"))
    channels = p.select(*key).distinct().select("*", F.lit(4).alias("n_sub"), F.concat(F.lit("Ch "), F.col("channel_id")).alias("channel_name"))
    return metadata.subchannel_dimension(told, channels).select("channel_id", "subchannel_id", "name", "label", "lo", "hi")


@query("SELECT o_custkey AS c, o_orderkey AS id, o_orderstatus AS state, o_orderkey % 3 AS part FROM orders", plain=True)
def renamed_keys(spark, d):
    o = model.table(spark, d, "orders")
    deep = o.select("o_custkey", F.struct(F.col("o_orderkey").alias("UID"), F.struct(F.col("o_orderstatus").alias("Code"), F.lit(1).alias("Void")).alias("State"), F.array(F.struct((F.col("o_orderkey") % 3).alias("Part"))).alias("List")).alias("Info"), F.lit("x").alias("Void"))
    flat = metadata.rename_nested(deep, {"o_custkey": "c", "Info": "info", "UID": "id", "State": "state", "Code": "code", "List": "list", "Part": "part"}, ("Void",))
    return flat.select("c", "info.id", F.col("info.state.code").alias("state"), F.col("info.list")[0]["part"].alias("part"))


@query("""SELECT c_custkey AS owner, 'key' AS name, 'int' AS kind, c_custkey AS v_int, NULL::DOUBLE AS v_double, NULL AS v_string FROM customer UNION ALL SELECT c_custkey, 'half', 'float', NULL, c_custkey + 0.5, NULL FROM customer
UNION ALL SELECT c_custkey, 'segment', 'str', NULL, NULL, c_mktsegment FROM customer""", plain=True)
def encoded_attributes(spark, d):
    key = F.col("c_custkey").cast("string")
    maps = model.table(spark, d, "customer").select(F.lit(1).alias("recording_id"), F.col("c_custkey").alias("owner"), F.create_map(F.lit("key"), key, F.lit("half"), F.concat(key, F.lit(".5")), F.lit("segment"), F.col("c_mktsegment")).alias("attributes"))
    return metadata.encode_attributes(maps).select("owner", "name", "kind", "v_int", "v_double", "v_string")


@query("SELECT o_custkey AS recording_id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) % 6 + 1 AS code FROM orders GROUP BY ALL", plain=True)
def recorder_info(spark, d):
    """The last value of each key of a recording's information."""
    rows = metadata.rollup(_attributes(spark, d), multiple=False)
    return rows.select("recording_id", F.col("attributes")["status"].alias("status"), F.col("attributes")["ExitCond"].cast("bigint").alias("code"))


@query("""SELECT s_suppkey AS recording_id, x.c AS channel_id, x.i AS subchannel_id, coalesce(x.lo, -g) AS lo, coalesce(x.hi, g) AS hi FROM (SELECT s_suppkey, CASE s_suppkey % 300 WHEN 18 THEN 100 WHEN 19 THEN 200 WHEN 20 THEN 500 WHEN 21 THEN 2000 WHEN 22 THEN 6000 ELSE CASE WHEN s_suppkey % 300 > 255 THEN 100 ELSE 25 END END::DOUBLE AS g FROM supplier WHERE s_nationkey % 4 <> 0),
(VALUES ('0', 0, NULL::DOUBLE, NULL::DOUBLE), ('0', 1, NULL, NULL), ('0', 2, NULL, NULL), ('1', 0, 0, 120000), ('1', 1, -40, 80)) x(c, i, lo, hi)""", plain=True)
def default_subchannels(spark, d):
    s = model.table(spark, d, "supplier").select(F.col("s_suppkey").alias("recording_id"), (F.col("s_suppkey") % 300).alias("recorder_type"), "s_nationkey")
    return metadata.default_subchannels(s, s.where("s_nationkey % 4 = 0")).select("recording_id", "channel_id", "subchannel_id", "lo", "hi")


# Sessions, ranges and versions


def _sessions(spark, d) -> DataFrame:
    return model.raw_samples(spark, d).select(F.col("channel_id").alias("recording_id"), (F.col("user_id") % 5).alias("session_id"), "event_id", F.col("t_us").alias("start_us"), F.col("t_us").alias("end_us"))


@query("""SELECT recording_id, session_id, CASE WHEN session_id = 1 THEN 1000 ELSE a END AS start_us, z AS end_us, CASE WHEN session_id > 0 THEN session_id - (session_id + 1) % 2 END AS utc_start_s
FROM (SELECT channel_id AS recording_id, user_id % 5 AS session_id, min(t_us) AS a, max(t_us) AS z FROM s GROUP BY ALL)""")
def session_bounds(spark, d):
    """Odd sessions declare their time base, the first of them its start."""
    rows = _sessions(spark, d)
    told = rows.where("session_id % 2 = 1").select("recording_id", "session_id").distinct()
    told = told.select("*", F.when(F.col("session_id") == 1, F.lit(1000)).cast("bigint").alias("start_us"), F.lit(None).cast("bigint").alias("end_us"), F.col("session_id").alias("utc_start_s"))
    return recordings.sessions(rows, told).select("recording_id", "session_id", "start_us", "end_us", "utc_start_s")


@query("SELECT channel_id AS recording_id, event_id FROM s QUALIFY user_id % 5 = max(user_id % 5) OVER (PARTITION BY channel_id)")
def last_sessions(spark, d):
    return recordings.last_session(_sessions(spark, d)).select("recording_id", "event_id")


@query("SELECT channel_id AS recording_id, event_id FROM s WHERE user_id % 5 = 3")
def chosen_sessions(spark, d):
    """Session 3 of every recording, which all of them have."""
    return recordings.session(_sessions(spark, d), 3).select("recording_id", "event_id")


@query("SELECT s_suppkey, row_number() OVER w AS place, (u - min(u) OVER (PARTITION BY s_nationkey)) * 1000000 AS offset_us FROM (SELECT *, floor(s_acctbal)::BIGINT AS u FROM supplier) WINDOW w AS (PARTITION BY s_nationkey ORDER BY u, s_suppkey)", plain=True)
def merge_places(spark, d):
    recs = model.table(spark, d, "supplier").select(F.col("s_suppkey").alias("recording_id"), "s_nationkey", F.floor("s_acctbal").cast("bigint").alias("utc_start_s"))
    return recordings.merge_order(recs, ["s_nationkey"]).select(F.col("recording_id").alias("s_suppkey"), F.col("place").cast("bigint").alias("place"), "offset_us")


@query("""SELECT c_custkey AS recording_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 3 <> 1""", plain=True)
def replaced_user_data(spark, d):
    """A third of the recordings get new data, a third is cleared."""
    old = model.table(spark, d, "customer").select(F.col("c_custkey").alias("recording_id"), F.lit(1).alias("version"), F.lit("k").alias("key"), F.col("c_mktsegment").alias("value"))
    changes = old.where("recording_id % 3 < 2").select("recording_id", "key", F.when(F.col("recording_id") % 3 == 0, "new").alias("value"))
    return metadata.latest_user_data(metadata.replace_user_data(old, changes)).select("recording_id", "value")


@query(f"SELECT count(*) AS blocks, sum(length(block_seq::VARCHAR))::BIGINT AS bytes FROM ({ORACLES['edge_safe_extract']})", plain=True)
def extracted_range(spark, d):
    """Written by recording and channel, then counted in what was written."""
    rows = model.blocks(spark, d).withColumn("payload", F.col("block_seq").cast("string").cast("binary"))
    return recordings.extract(rows, model.shared_path(spark, "extract"), *_range(model.raw_samples(spark, d)))


@query(f"SELECT channel_id, block_seq FROM ({ORACLES['edge_safe_extract']}) WHERE channel_id IN ('click', 'view')", plain=True)
def loaded_range(spark, d):
    """Two channels and a range of a stored table."""
    path = model.shared_path(spark, "blocks")
    model.blocks(spark, d).write.partitionBy("channel_id").parquet(path)
    return recordings.load_blocks(spark, path, ["click", "view"], *_range(model.raw_samples(spark, d))).select("channel_id", "block_seq")


# Rolling forms, rates and described dimensions

_ROLLING = f"quantile_cont(av, 0.5) OVER (PARTITION BY channel_id, subchannel_id ORDER BY start_us RANGE BETWEEN {5 * DAY} PRECEDING AND {5 * DAY} FOLLOWING)"


@query(f"SELECT channel_id, idx, subchannel_id, round(v - m + 1e-7, 4) AS v FROM l JOIN (SELECT channel_id, block_seq, subchannel_id, {_ROLLING} AS m FROM b) USING (channel_id, block_seq, subchannel_id)")
def rolling_median_removed(spark, d):
    out = windows.remove_block_median(model.samples(spark, d), model.stats(spark, d), 10 * DAY)
    return out.select("channel_id", "idx", "subchannel_id", F.round(F.col("v") + 1e-7, 4).alias("v"))


@query(f"SELECT channel_id, block_seq, subchannel_id, round(-2 * (mx - m) + 1e-7, 4) AS mn, round(-2 * (av - m) + 1e-7, 4) AS av, round(-2 * (mn - m) + 1e-7, 4) AS mx FROM (SELECT *, {_ROLLING} AS m FROM b)")
def block_stats_rolling_removed(spark, d):
    rows = stats.block_medians(model.stats(spark, d), 10 * DAY)
    out = stats.calibrated_block_stats(rows, -2.0, 3.0, mean_of=F.col("median") * -2.0 + 3.0)
    return out.select("channel_id", "block_seq", "subchannel_id", *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("mn", "av", "mx")))


@query("""SELECT channel_id, idx, round(1e6 / CASE channel_id WHEN 'click' THEN 4000 ELSE p END, 9) AS rate_hz FROM s JOIN (SELECT channel_id, block_seq, CASE WHEN n > 1 THEN (end_us - start_us) / (n - 1)
ELSE coalesce(nx, lag((end_us - start_us) / nullif(n - 1, 0)) OVER (PARTITION BY channel_id ORDER BY block_seq)) END AS p FROM (SELECT *, (lead(start_us) OVER (PARTITION BY channel_id ORDER BY block_seq) - start_us) / n AS nx FROM bb)) q
ON s.channel_id = q.channel_id AND idx // 64 = block_seq""".replace("SELECT channel_id, idx, round", "SELECT s.channel_id, idx, round").replace("CASE channel_id WHEN", "CASE s.channel_id WHEN"))
def rate_at_index(spark, d):
    """Clicks declare their rate."""
    blocks = timebase.index_ranges(model.blocks(spark, d))
    declared = blocks.where("channel_id = 'click'").select(*K).distinct().withColumn("sample_rate", F.lit(250.0))
    return timebase.rate_at(model.samples(spark, d).select(*K, "idx"), blocks, declared).select("channel_id", "idx", r("rate_hz", 9))


@query(_jitter("a", "b", "step", "step * 0.8::DOUBLE", f"""SELECT channel_id, a, b, greatest(ceil((b - a) / 200), 1)::BIGINT AS step FROM (SELECT channel_id, min(idx) FILTER (inside) AS a, least(max(idx) FILTER (inside) + 2, count(*)) AS b
FROM (SELECT *, t_us >= {_T} + {10 * DAY} AND t_us <= {_T} + {100 * DAY} AS inside FROM s) GROUP BY channel_id)"""))
def resampled_jittered(spark, d):
    rows = slices.resampled_range(model.samples(spark, d), *_range(model.raw_samples(spark, d)), 200, bounds="closed", jitter=0.8)
    return rows.select("channel_id", "idx", "t_us", F.col("raw")[0].alias("v0"))


def _recordings(spark, d) -> DataFrame:
    """Nations are recordings that describe their suppliers as sensors, warnings, calibrations and bandwidth limits."""
    key = F.col("s_suppkey")
    n = (key % 3).cast("int")
    c = F.slice(F.array(F.lit(1.5), F.lit(2.5)), F.lit(1), n)
    return model.table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("recording_id")).agg(
        F.collect_list(F.struct(F.when(key % 7 != 0, key.cast("int")).alias("SensorID"), F.col("s_name").alias("SensorName"), (key % 4).cast("int").alias("SensorBwLimitIDRef"))).alias("sensors"),
        F.collect_list(F.struct(key.cast("int").alias("WarningID"), F.lit("1").alias("WarningChannelRef"), F.lit(0).alias("WarningSubChannelRef"), F.when(key % 2 == 0, F.lit(-1.0)).alias("WarningRangeMin"), F.lit(5.0).alias("WarningRangeMax"))).alias("warnings"),
        F.collect_list(F.struct(key.cast("int").alias("CalID"), c.alias("PolynomialCoef"), F.lit(3.0).alias("CalReferenceValue"))).alias("calibrations"),
        F.collect_list(F.struct(F.when(key % 5 != 0, key.cast("int")).alias("BwLimitID"), F.lit(10.0).alias("BwLimitUpper"), F.lit(20.0).alias("BwLimitRolloffUpper"))).alias("bandwidths"),
    )


@query("SELECT s_nationkey::VARCHAR AS recording_id, s_suppkey AS sensor_id, s_name AS name, s_suppkey % 4 AS bw_limit_id FROM supplier WHERE s_suppkey % 7 <> 0", plain=True)
def described_sensors(spark, d):
    return metadata.described_sensors(_recordings(spark, d))


@query("SELECT s_nationkey::VARCHAR AS recording_id, s_suppkey AS warning_id, '1' AS channel_id, 0 AS subchannel_id, CASE WHEN s_suppkey % 2 = 0 THEN -1.0 END AS low, 5.0 AS high FROM supplier", plain=True)
def described_warnings(spark, d):
    return metadata.described_warnings(_recordings(spark, d))


@query("SELECT s_suppkey AS transform_id, CASE WHEN s_suppkey % 3 = 0 THEN 'no coefficients' ELSE 'ok' END AS reason, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '1.5' ELSE '1.5,2.5' END AS c FROM supplier", plain=True)
def described_transforms(spark, d):
    good, bad = metadata.described_transforms(_recordings(spark, d))
    rows = good.withColumn("reason", F.lit("ok")).unionByName(bad)
    return rows.select("transform_id", "reason", F.array_join(F.col("c").cast("array<string>"), ",").alias("c"))


@query("SELECT s_suppkey AS bw_limit_id, 10.0 AS hi_cut, 20.0 AS hi_roll FROM supplier WHERE s_suppkey % 5 <> 0", plain=True)
def described_bandwidths(spark, d):
    return metadata.described_bandwidths(_recordings(spark, d)).select("bw_limit_id", "hi_cut", "hi_roll")


@query("""SELECT s_suppkey AS recording_id, 'warning' AS what, -20.0 AS a, 60.0 AS b FROM supplier WHERE s_nationkey % 4 <> 0
UNION ALL SELECT s_suppkey, 'transform', round(CASE s_suppkey % 8 + 15 WHEN 18 THEN 100 WHEN 19 THEN 200 WHEN 20 THEN 500 WHEN 21 THEN 2000 WHEN 22 THEN 6000 ELSE 25 END / 32767::DOUBLE, 9), 0 FROM supplier WHERE s_nationkey % 4 <> 0""", plain=True)
def default_ranges(spark, d):
    """The default warning range and transform of recordings that describe none."""
    s = model.table(spark, d, "supplier").select(F.col("s_suppkey").alias("recording_id"), (F.col("s_suppkey") % 8 + 15).alias("recorder_type"), "s_nationkey")
    told = s.where("s_nationkey % 4 = 0").select("recording_id")
    lines = metadata.default_transforms(s, told).select("recording_id", F.lit("transform").alias("what"), F.round(F.col("c")[0], 9).alias("a"), F.col("c")[1].alias("b"))
    return metadata.default_warnings(s, told).select("recording_id", F.lit("warning").alias("what"), F.col("low").alias("a"), F.col("high").alias("b")).unionByName(lines)


@query("SELECT o_custkey AS owner, string_agg(o_orderkey % 6 + 1, ',' ORDER BY o_orderkey) AS codes, string_agg('int', ',') AS kinds FROM orders GROUP BY ALL", plain=True)
def typed_attributes(spark, d):
    """Numbers stay numbers."""
    x = metadata.typed_rollup(_attributes(spark, d)).select(F.col("recording_id").alias("owner"), F.col("attributes")["ExitCond"].alias("x"))
    return x.select("owner", F.array_join(F.transform("x", lambda v: v["v_int"].cast("string")), ",").alias("codes"), F.array_join(F.transform("x", lambda v: v["kind"]), ",").alias("kinds"))


@query("SELECT c_custkey AS recording_id, coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) AS n FROM customer", plain=True)
def merged_attributes(spark, d):
    rows = model.table(spark, d, "customer").select(F.col("c_custkey").alias("recording_id"), F.lit("rec").alias("owner"))
    out = metadata.merge_attributes(rows, _attributes(spark, d), "status")
    return out.select("recording_id", F.coalesce(F.size("status"), F.lit(0)).cast("bigint").alias("n")).withColumn("n", F.greatest("n", F.lit(0).cast("bigint")))


@query("SELECT o_orderkey, 9007199254740993 + o_orderkey AS v FROM orders", plain=True)
def decoded_long(spark, d):
    """Numbers beyond 53 bits stay exact."""
    h = _hex(F.col("o_orderkey") + 9007199254740993, 16)
    payload = F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8))))
    return decode.to_samples(decode.decode_payload(model.table(spark, d, "orders").select("o_orderkey", payload.alias("payload")), "<q")).select("o_orderkey", F.col("raw")[0].alias("v"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'ragged' ELSE 'ok' END AS reason FROM embeddings", plain=True)
def rejected_blocks(spark, d):
    """Every fifth block has a damaged tail and goes apart."""
    p = _packed(spark, d).withColumns({"start_tick": F.lit(1), "end_tick": F.lit(2)})
    cut = p.withColumn("payload", F.when(F.col("vec_id") % 5 == 0, F.substring("payload", 1, 254)).otherwise(F.col("payload")))
    good, bad = decode.route_rejected(decode.validate_blocks(cut, F.lit(4)))
    return good.select("vec_id", F.lit("ok").alias("reason")).unionByName(bad.select("vec_id", "reason"))


@query("SELECT event_id, round((CASE WHEN 100000::DOUBLE / p < 4.47704808656731::DOUBLE THEN 293.15::DOUBLE * (pow(p / 100000::DOUBLE, 0.1902632365084836::DOUBLE) - 1) / -0.0065::DOUBLE END), 3) AS metres, round(h, 3) AS feet FROM (SELECT event_id, 60000 + value * 50 AS p, value * 10 AS h FROM events)", plain=True)
def altitude_at_base(spark, d):
    """At a temperature and pressure of one's own, and feet there and back."""
    v = F.col("raw")[0]
    feet = units.convert("pressure_to_feet", units.revert("pressure_to_feet", v * 10))
    return model.raw_samples(spark, d).select("event_id", F.round(units.altitude_m(v * 50 + 60000, 20.0, 100000.0), 3).alias("metres"), F.round(feet, 3).alias("feet"))


@query("SELECT n_regionkey AS region, 1 AS files FROM nation GROUP BY ALL", plain=True)
def found_files(spark, d):
    """Files by folder, two levels down."""
    path = model.shared_path(spark, "found")
    model.table(spark, d, "nation").coalesce(1).write.partitionBy("n_regionkey").parquet(path)
    found = recordings.crawl(spark, path, model.shared_path(spark, "listed"), "*.parquet", 2)
    return found.groupBy(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("bigint").alias("region")).agg(F.count(F.lit(1)).alias("files"))


@query("SELECT s_nationkey::VARCHAR AS recording_id, s_suppkey AS sensor_id, s_name AS name FROM supplier", plain=True)
def opened_dimensions(spark, d):
    """Only the sensors of a stored set of recordings are read."""
    path = model.shared_path(spark, "dimensions")
    s = model.table(spark, d, "supplier")
    s.select(F.col("s_nationkey").cast("string").alias("recording_id"), F.col("s_suppkey").cast("int").alias("sensor_id"), F.col("s_name").alias("name"), F.lit("").alias("trace"), F.lit(0).alias("bw_limit_id")).write.parquet(f"{path}/sensors")
    return recordings.open_dimensions(spark, path, "sensors")["sensors"].select("recording_id", "sensor_id", "name")


# Exports and ingest


@query("SELECT channel_id, idx, printf('%.6f', t_us * 1e-6) AS time, printf('%.6f', v0) AS Value, printf('%.6f', v1) AS K_1 FROM s")
def exported_csv(spark, d):
    """Written with a delimiter of two characters, then read again."""
    path = model.shared_path(spark, "csv")
    sinks.export_csv(sinks.csv_columns(model.samples(spark, d), ["Value", "K 1"], keep=("channel_id", "idx")), path)
    return spark.read.option("sep", ", ").option("header", True).schema("channel_id string, idx bigint, time string, Value string, K_1 string").csv(path)


@query("SELECT channel_id, count(*) AS n, round(sum(v0), 2) AS total, 'Value,K' AS names FROM s GROUP BY channel_id")
def exported_arrays(spark, d):
    """Samples and the names of their subchannels, written and read again."""
    path = model.shared_path(spark, "arrays")
    s = model.samples(spark, d)
    labels = s.select("channel_id").distinct().withColumn("names", F.array(F.lit("Value"), F.lit("K")))
    sinks.export_arrays(s, {"names": labels}, path, 1_000_000)
    sums = spark.read.parquet(f"{path}/samples").groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("raw")[0]), 2).alias("total"))
    return sums.join(spark.read.parquet(f"{path}/names"), "channel_id").select("channel_id", "n", "total", F.array_join("names", ",").alias("names"))


@query("SELECT event_type AS channel_id, event_id FROM events", plain=True)
def stream_ingest(spark, d):
    """Events come in twice and are kept once."""
    path = model.shared_path(spark, "ingest")
    events = spark.readStream.schema(model.table(spark, d, "events").schema).parquet(f"{d}/events*")
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("demo").alias("recording_id"), F.lit(0).alias("session_id"), F.col("event_type").alias("channel_id"), F.col("event_id").alias("block_seq"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    live.ingest(rows, f"{path}/data", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/data").select("channel_id", F.col("block_seq").alias("event_id"))


@query("""SELECT channel_id, idx, printf('%.6f', t_us * 1e-6) AS time, printf('%.3f', v1 - m1 + 1e-7) AS K_1, printf('%.3f', 3 * v0 - 14 - (3 * m0 - 14) + 1e-7) AS Value
FROM s JOIN (SELECT channel_id, avg(v0) AS m0, avg(v1) AS m1, count(*) AS len FROM s GROUP BY channel_id) USING (channel_id) WHERE idx >= 5 AND idx < len - 5 AND (idx - 5) % 3 = 0""")
def exported_slice(spark, d):
    """Calibrated, less the mean, sliced, the subchannels the other way round."""
    s = model.samples(spark, d)
    channels = model.table(spark, d, "events").select(F.lit("demo").alias("recording_id"), F.col("event_type").alias("channel_id")).distinct()
    lines = channels.select("*", F.lit(0).alias("subchannel_id"), F.array(F.lit(3.0), F.lit(-14.0)).alias("c"), F.lit(None).cast("string").alias("y_channel_id"), F.lit(None).cast("int").alias("y_subchannel_id"))
    rows = sinks.export_samples(s, 5, -5, 3, [1, 0], lines, remove_mean=True).withColumn("raw", F.transform("raw", lambda v: v + 1e-7))
    out = sinks.csv_columns(rows, ["K 1", "Value"], fmt="%.3f", keep=("channel_id", "idx", "t_us"))
    return out.select("channel_id", "idx", F.format_string("%.6f", F.col("t_us") * 1e-6).alias("time"), "K_1", "Value")


@query("""SELECT s_suppkey AS transform_id, 'calibration' || s_suppkey AS name, CASE s_suppkey % 3 WHEN 1 THEN '3.0,1.5' ELSE '3.0,1.5,2.5' END AS vals FROM supplier WHERE s_suppkey % 3 <> 0""", plain=True)
def calibration_sidecars(spark, d):
    good, _ = metadata.described_transforms(_recordings(spark, d))
    rows = sinks.calibration_sidecar(good)
    return rows.select(F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("transform_id"), "name", F.array_join(F.col("values").cast("array<string>"), ",").alias("vals"))


@query("SELECT s_suppkey::VARCHAR AS recording_id, 'Samples generated from ' || s_suppkey || '.rec recorded ' || strftime(make_timestamp(s_suppkey * 86400000000), '%Y-%m-%d %H:%M:%S') || ' UTC' AS text FROM supplier", plain=True)
def provenance(spark, d):
    rows = model.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("recording_id"), F.concat(F.lit("/data/"), F.col("s_suppkey"), F.lit(".rec")).alias("path"), (F.col("s_suppkey") * 86_400).alias("utc_start_s"))
    return sinks.provenance_sidecar(rows)
