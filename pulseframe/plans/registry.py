"""Registered queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import calibration, names, units
from ..operators import asof, slices, spectrum, stats, timebase, windows
from ..schema import K
from ..sources import decode, metadata, recordings, sinks, store
from ..streaming import live
from . import model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A range inside the events, in microseconds.
DAY = 86_400_000_000


def query(sql: str | None = None, plain: bool = False):
    """Register a query; sql follows the model's common tables unless it is plain."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if plain else f"WITH {model.SQL}\n{sql}"
        return f

    return add


def r(c: str, digits: int = 4):
    return F.round(F.col(c), digits).alias(c)


_T = "(SELECT min(t_us) FROM s)"


def _range(s: DataFrame) -> tuple[int, int]:
    """From ten days after the first event to a hundred days after it."""
    first = s.agg(F.min("t_us")).first()[0] or 0
    return first + 10 * DAY, first + 100 * DAY


# Summaries


@query(f"""SELECT channel_id, block_seq, subchannel_id, n, round(-2 * mx + 3, 4) AS mn, round(-2 * av + 3, 4) AS av, round(-2 * mn + 3, 4) AS mx
FROM b WHERE end_us >= {_T} + {10 * DAY} AND start_us <= {_T} + {100 * DAY}""")
def block_min_mean_max(spark, d):
    rows = stats.overlapping(model.stats(spark, d), *_range(model.raw_samples(spark, d)))
    return stats.calibrated_block_stats(rows, -2.0, 3.0).select("channel_id", "block_seq", "subchannel_id", "n", r("mn"), r("av"), r("mx"))


@query("""SELECT channel_id, subchannel_id, round(min(mn), 4) AS mn, round(median(av), 4) AS av, round(max(mx), 4) AS mx FROM b GROUP BY ALL
UNION ALL SELECT channel_id, -1, round(min(mn), 4), round(avg(av), 4), round(max(mx), 4) FROM (SELECT channel_id, subchannel_id, min(mn) AS mn, median(av) AS av, max(mx) AS mx FROM b GROUP BY ALL) GROUP BY channel_id""")
def range_min_mean_max(spark, d):
    return stats.range_stats(model.written(model.stats(spark, d), "stats")).select("channel_id", F.coalesce("subchannel_id", F.lit(-1)).alias("subchannel_id"), r("mn"), r("av"), r("mx"))


@query("SELECT channel_id, subchannel_id, round(sum(av * n) / sum(n), 4) AS mean, sum(n)::BIGINT AS n FROM b GROUP BY ALL")
def weighted_mean(spark, d):
    return stats.weighted_mean(model.stats(spark, d)).select("channel_id", "subchannel_id", r("mean"), "n")


@query("SELECT channel_id, idx, t_us, v0, v1 FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY greatest(v0, v1) DESC, idx) AS p FROM s) WHERE p = 1")
def peak_event(spark, d):
    return stats.extreme_event(model.samples(spark, d)).select("channel_id", "idx", "t_us", F.col("raw")[0].alias("v0"), F.col("raw")[1].alias("v1"))


@query("SELECT channel_id, idx, t_us, v0, v1 FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY least(v0, v1), idx) AS p FROM s) WHERE p = 1")
def lowest_event(spark, d):
    return stats.extreme_event(model.samples(spark, d), False).select("channel_id", "idx", "t_us", F.col("raw")[0].alias("v0"), F.col("raw")[1].alias("v1"))


@query("SELECT channel_id, subchannel_id, round(sqrt(avg(v * v)), 4) AS rms FROM l GROUP BY ALL")
def rms(spark, d):
    return stats.rms(model.raw_samples(spark, d)).select("channel_id", "subchannel_id", r("rms"))


@query("SELECT channel_id, round((max(t_us) - min(t_us)) / (count(*) - 1), 3) AS period_us FROM s GROUP BY ALL")
def mean_period(spark, d):
    return stats.mean_period(model.raw_samples(spark, d)).select("channel_id", r("period_us", 3))


@query(f"""SELECT s.channel_id, idx, t_us, v0 FROM s JOIN (SELECT channel_id, t_us AS peak FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY abs(v0) DESC, idx) AS p FROM s) WHERE p = 1) USING (channel_id)
WHERE abs(t_us - peak) < {DAY // 4}""")
def peak_neighbourhood(spark, d):
    return stats.peak_neighbourhood(model.samples(spark, d), 0, DAY // 4).select("channel_id", "idx", "t_us", F.col("raw")[0].alias("v0"))


@query("SELECT channel_id, min(start_us) AS first_us, max(end_us) AS last_us, sum(n)::BIGINT AS samples, count(*) AS blocks, arg_min(n, block_seq) = 1 AS single_sample FROM bb GROUP BY ALL")
def series_intervals(spark, d):
    return timebase.intervals(model.blocks(spark, d)).select("channel_id", "first_us", "last_us", "samples", "blocks", "single_sample")


@query(f"""SELECT channel_id, block_seq, subchannel_id, round(av, 4) AS av, round(quantile_cont(av, 0.5) OVER (PARTITION BY channel_id, subchannel_id ORDER BY start_us RANGE BETWEEN {5 * DAY} PRECEDING AND {5 * DAY} FOLLOWING), 4) AS median FROM b""")
def rolling_block_median(spark, d):
    return stats.block_medians(model.stats(spark, d), 10 * DAY).select("channel_id", "block_seq", "subchannel_id", r("av"), r("median"))


# Slices


@query("SELECT channel_id, idx, t_us, v0 FROM (SELECT *, count(*) OVER (PARTITION BY channel_id) AS len FROM s) WHERE idx >= greatest(len - 500, 0) AND idx < len - 10 AND (idx - greatest(len - 500, 0)) % 7 = 0")
def index_slice(spark, d):
    return slices.index_slice(model.samples(spark, d), -500, -10, 7).select("channel_id", "idx", "t_us", F.col("raw")[0].alias("v0"))


@query("SELECT channel_id, idx, t_us, v0 FROM (SELECT *, count(*) OVER (PARTITION BY channel_id) AS len FROM s) WHERE idx = len - 3")
def event_from_end(spark, d):
    return slices.event_at(model.samples(spark, d), -3).select("channel_id", "idx", "t_us", F.col("raw")[0].alias("v0"))


@query(f"""SELECT channel_id, idx, t_us, v0 FROM (SELECT *, min(t_us) OVER (PARTITION BY channel_id) AS a, lag(t_us) OVER (PARTITION BY channel_id ORDER BY idx) AS before, {_T} + {10 * DAY} AS s0, {_T} + {100 * DAY} AS e0 FROM s)
WHERE ((t_us > s0 OR (a >= s0 AND t_us >= s0)) AND t_us <= e0) OR (t_us > e0 AND before < e0 AND idx % 64 = 0)""")
def time_range(spark, d):
    s = model.samples(spark, d)
    return slices.time_range(s, *_range(model.raw_samples(spark, d))).select("channel_id", "idx", "t_us", F.col("raw")[0].alias("v0"))


def _store(spark, d) -> store.Store:
    """All samples, written by series and run of blocks."""
    rows, path = model.samples(spark, d), model.shared_path(spark, "store")
    store.write_store(rows, path)
    return store.Store(spark, path, rows.schema)


@query(ORACLES["time_range"], plain=True)
def stored_time_range(spark, d):
    """Only files whose blocks touch the range are read."""
    return _store(spark, d).time_range(*_range(model.raw_samples(spark, d))).select("channel_id", "idx", "t_us", F.col("raw")[0].alias("v0"))


@query("SELECT channel_id, idx, t_us, v0 FROM s WHERE idx >= 300 AND idx < 700 AND (idx - 300) % 7 = 0")
def stored_index_slice(spark, d):
    return _store(spark, d).index_slice(300, 700, 7).select("channel_id", "idx", "t_us", F.col("raw")[0].alias("v0"))


@query(f"SELECT channel_id, block_seq, subchannel_id, n, mn, round(av, 4) AS av, mx FROM b WHERE end_us >= {_T} + {10 * DAY} AND start_us <= {_T} + {100 * DAY}")
def stored_summaries(spark, d):
    return _store(spark, d).summaries(*_range(model.raw_samples(spark, d))).select("channel_id", "block_seq", "subchannel_id", "n", "mn", r("av"), "mx")


@query("SELECT channel_id, idx, v1, v0 FROM s WHERE idx >= 100 AND idx < 400 AND (idx - 100) % 3 = 0")
def subchannel_values(spark, d):
    rows = slices.values_only(slices.index_slice(model.samples(spark, d), 100, 400, 3), [1, 0])
    return rows.select("channel_id", "idx", F.col("raw")[0].alias("v1"), F.col("raw")[1].alias("v0"))


@query("SELECT channel_id, idx, t_us, v0 FROM (SELECT *, count(*) OVER (PARTITION BY channel_id) AS n FROM s) WHERE idx % greatest(ceil(n / 100), 1)::BIGINT = 0")
def resampled_range(spark, d):
    lengths = model.raw_samples(spark, d).groupBy(*K).agg(F.count(F.lit(1)).alias("_len"))
    return slices.resample(model.samples(spark, d), 100, lengths).select("channel_id", "idx", "t_us", F.col("raw")[0].alias("v0"))


@query("SELECT channel_id, idx, t_us, v0 FROM s WHERE idx < 25")
def head_per_series(spark, d):
    return slices.head(model.samples(spark, d), 25).select("channel_id", "idx", "t_us", F.col("raw")[0].alias("v0"))


def _jitter(a: str, b: str, step: str, reach: str, spans: str) -> str:
    """Slots of each channel's range and where the MD5 of seed, series and slot moves them."""
    draw = f"(('0x' || substr(md5('0:demo:0:' || channel_id || ':' || i), 1, 8))::BIGINT / 2147483648::DOUBLE - 1)"
    return f"""SELECT channel_id, idx, t_us, v0 FROM (SELECT channel_id, CASE WHEN i > {a} AND i + {step} < {b} AND {reach} > 0.5 THEN least(greatest(i + round({draw} * {reach})::BIGINT, {a}), {b} - 1) ELSE i END AS idx
FROM (SELECT *, unnest(range({a}, {b}, {step})) AS i FROM ({spans}))) JOIN s USING (channel_id, idx)"""


@query(_jitter("0", "len", "20", "16::DOUBLE", "SELECT channel_id, count(*) AS len FROM s GROUP BY channel_id"))
def jittered_slice(spark, d):
    return slices.jittered(model.samples(spark, d), 20, 0.8).select("channel_id", "idx", "t_us", F.col("raw")[0].alias("v0"))


@query(f"SELECT channel_id, block_seq FROM (SELECT *, lead(start_us, 2) OVER (PARTITION BY channel_id ORDER BY block_seq) AS nx FROM bb) WHERE start_us <= {_T} + {100 * DAY} AND (nx IS NULL OR nx > {_T} + {10 * DAY})")
def block_range(spark, d):
    return slices.block_range(model.blocks(spark, d), *_range(model.raw_samples(spark, d))).select("channel_id", "block_seq")


# Calibration and units


def _transforms(spark: SparkSession) -> DataFrame:
    """A line for clicks' values, a constant for logins' k; the rest stays."""
    return spark.createDataFrame([("click", 0, [2.0, -1.5], 100.0), ("login", 1, [7.25], 0.0)], "channel_id string, subchannel_id int, c array<double>, x_ref double")


@query("""SELECT channel_id, idx, subchannel_id, round(CASE WHEN channel_id = 'click' AND subchannel_id = 0 THEN 2 * (v - 100) - 1.5 WHEN channel_id = 'login' AND subchannel_id = 1 THEN 7.25 ELSE v END, 4) AS v FROM l""")
def calibrate_univariate(spark, d):
    return calibration.apply_univariate(stats.long_form(model.samples(spark, d)), F.broadcast(_transforms(spark))).select("channel_id", "idx", "subchannel_id", r("v"))


def _xy(spark, d, mode: str) -> DataFrame:
    """Purchases compensated by the k of views."""
    s, t = model.samples(spark, d), model.stats(spark, d)
    rows = calibration.compensation(s.where("channel_id = 'purchase'"), s.where("channel_id = 'view'"), t.where("channel_id = 'view'"), 1, mode)
    c = F.array(*(F.lit(x) for x in (0.001, 1.5, -0.25, 4.0)))
    v = calibration.bivariate(F.col("raw")[0], F.col("y"), c, F.lit(10.0), F.lit(3.0))
    return rows.select("idx", F.round("y", 4).alias("y"), F.round(v + 1e-7, 3).alias("v"))


_BIVARIATE = "round(0.001::DOUBLE * (v0 - 10) * (y - 3) + 1.5::DOUBLE * (v0 - 10) - 0.25::DOUBLE * (y - 3) + 4 + 1e-7, 3) AS v"


@query(f"SELECT idx, round(y, 4) AS y, {_BIVARIATE} FROM s, (SELECT sum(av * n) / sum(n) AS y FROM b WHERE channel_id = 'view' AND subchannel_id = 1) WHERE channel_id = 'purchase'")
def calibrate_bivariate_mean(spark, d):
    return _xy(spark, d, "mean")


_NEAREST = """, p AS (SELECT a.idx, a.t_us, a.v0, q.t_us AS pt, q.v1 AS pv, q.v0 AS pv0, q.idx AS pi FROM (SELECT * FROM s WHERE channel_id = 'purchase') a ASOF LEFT JOIN (SELECT * FROM s WHERE channel_id = 'view') q ON a.t_us >= q.t_us),
n AS (SELECT p.*, q.t_us AS nt, q.v1 AS nv, q.v0 AS nv0, q.idx AS ni FROM p ASOF LEFT JOIN (SELECT * FROM s WHERE channel_id = 'view') q ON p.t_us < q.t_us)"""


@query(f"{_NEAREST}, y AS (SELECT *, CASE WHEN pt IS NULL OR nt - t_us < t_us - pt THEN nv ELSE pv END AS y FROM n) SELECT idx, round(y, 4) AS y, {_BIVARIATE} FROM y")
def calibrate_bivariate_nearest(spark, d):
    return _xy(spark, d, "nearest")


@query("SELECT channel_id, idx, round((2 * ((3 * (v0 - 5) + 1) - 4) + 0.5) , 4) AS v FROM s")
def compose_calibration(spark, d):
    inner, outer = calibration.expand(F.array(F.lit(3.0), F.lit(1.0)), F.lit(5.0)), calibration.expand(F.array(F.lit(2.0), F.lit(0.5)), F.lit(4.0))
    both = calibration.compose(outer, inner)
    return model.samples(spark, d).select("channel_id", "idx", F.round(calibration.univariate(F.col("raw")[0], both, F.lit(0.0)), 4).alias("v"))


def _unit(name: str, sql: str) -> None:
    def run(spark, d):
        return model.raw_samples(spark, d).select("event_id", F.round(units.convert(name, F.col("raw")[0]), 6).alias("v"), F.round(units.revert(name, units.convert(name, F.col("raw")[0])), 4).alias("back"))

    run.__name__ = f"unit_{name}"
    query(f"SELECT event_id, round({sql}, 6) AS v, round(value, 4) AS back FROM events", plain=True)(run)


_unit("celsius_to_fahrenheit", "value * 1.8::DOUBLE + 32")
_unit("celsius_to_kelvin", "value + 273.15::DOUBLE")
_unit("gravity_to_mps2", "value * 9.806649999788::DOUBLE")
_unit("metres_to_feet", "value * 3.2808399::DOUBLE")
_unit("pascal_to_psi", "value * 0.000145037738::DOUBLE")
_unit("pascal_to_atm", "value * 9.86923266716e-06::DOUBLE")

_ALTITUDE = """CASE WHEN 101325::DOUBLE / p < 4.47704808656731::DOUBLE THEN 288.15::DOUBLE * (pow(p / 101325::DOUBLE, 0.1902632365084836::DOUBLE) - 1) / -0.0065::DOUBLE
WHEN 101325::DOUBLE / p < 18.507221149648668::DOUBLE THEN 216.65::DOUBLE * ln(p / 101325::DOUBLE) / -0.03416319473631036::DOUBLE + 216.65::DOUBLE / -0.02279120549896569::DOUBLE + 11000 ELSE 20000 END"""


@query(f"SELECT event_id, round({_ALTITUDE}, 3) AS metres, round(3.2808399::DOUBLE * ({_ALTITUDE}), 3) AS feet FROM (SELECT event_id, 1000 + value * 210 AS p FROM events)", plain=True)
def altitude(spark, d):
    p = F.col("raw")[0] * 210 + 1000
    return model.raw_samples(spark, d).select("event_id", F.round(units.convert("pressure_to_metres", p), 3).alias("metres"), F.round(units.convert("pressure_to_feet", p), 3).alias("feet"))


@query("""SELECT event_id, round(CASE WHEN h < 11000 THEN 101325 * pow(288.15::DOUBLE / (288.15::DOUBLE - 0.0065::DOUBLE * h), 9.80665::DOUBLE * 0.0289644::DOUBLE / (8.31432::DOUBLE * -0.0065::DOUBLE))
WHEN h <= 20000 THEN 101325 * pow(288.15::DOUBLE / 216.65::DOUBLE, 9.80665::DOUBLE * 0.0289644::DOUBLE / (8.31432::DOUBLE * -0.0065::DOUBLE)) * exp(-9.80665::DOUBLE * 0.0289644::DOUBLE * (h - 11000) / (8.31432::DOUBLE * 216.65::DOUBLE))
ELSE 5474.89 END, 3) AS pascal FROM (SELECT event_id, value * 50 AS h FROM events)""", plain=True)
def pressure_from_altitude(spark, d):
    return model.raw_samples(spark, d).select("event_id", F.round(units.revert("pressure_to_metres", F.col("raw")[0] * 50), 3).alias("pascal"))


@query("""SELECT u.unit, c.converter FROM (SELECT DISTINCT CASE n_regionkey WHEN 0 THEN '°C' WHEN 1 THEN 'Pa' WHEN 2 THEN 'm' WHEN 3 THEN 'g' ELSE 'V' END AS unit FROM nation) u JOIN
(VALUES ('°C', 'celsius_to_fahrenheit'), ('°C', 'celsius_to_kelvin'), ('m', 'metres_to_feet'), ('Pa', 'pascal_to_psi'), ('Pa', 'pascal_to_atm')) c(unit, converter) ON u.unit = c.unit""", plain=True)
def applicable_converters(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("°C", "Pa", "m", "g", "V"))), F.col("n_regionkey").cast("int") + 1)
    return units.applicable_converters(model.table(spark, d, "nation").select(F.lit("any").alias("label"), unit.alias("unit"))).select("unit", "converter")


# As-of joins


def _probes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Purchases look up views."""
    s = model.indexed(spark, d, "purchase", "view")
    p = s.where("channel_id = 'purchase'").select("recording_id", "session_id", F.lit("view").alias("channel_id"), "t_us", F.col("idx").alias("probe"))
    return p, s.where("channel_id = 'view'")


@query(f"{_NEAREST} SELECT idx AS probe, CASE WHEN t_us >= (SELECT max(t_us) FROM s WHERE channel_id = 'view') THEN (SELECT count(*) FROM s WHERE channel_id = 'view') ELSE coalesce(pi, -1) END AS idx FROM n")
def asof_before(spark, d):
    return asof.index_before(*_probes(spark, d)).select("probe", "idx")


@query(f"{_NEAREST} SELECT idx AS probe, CASE WHEN nt IS NULL THEN pi + 1 WHEN pt IS NULL OR nt - t_us < t_us - pt THEN ni ELSE pi END AS idx FROM n")
def asof_nearest(spark, d):
    """At or after the last view: their number."""
    return asof.index_near(*_probes(spark, d)).select("probe", "idx")


@query(f"{_NEAREST} SELECT idx AS probe, CASE WHEN pt IS NULL OR nt - t_us < t_us - pt THEN nt ELSE pt END AS t_us, CASE WHEN pt IS NULL OR nt - t_us < t_us - pt THEN nv0 ELSE pv0 END AS v0 FROM n")
def nearest_values(spark, d):
    return asof.nearest(*_probes(spark, d)).select("probe", F.col("near_t").alias("t_us"), F.col("near")[0].alias("v0"))


@query(f"{_NEAREST} SELECT idx AS probe, round(CASE WHEN pt = t_us THEN pv0 ELSE pv0 + (t_us - pt) / (nt - pt) * (nv0 - pv0) END, 4) AS v0 FROM n WHERE pt = t_us OR (pt IS NOT NULL AND nt IS NOT NULL)")
def interpolate_at(spark, d):
    return asof.interpolate(*_probes(spark, d)).where("raw is not null").select("probe", F.round(F.col("raw")[0], 4).alias("v0"))


@query(f"{_NEAREST} SELECT idx AS probe, coalesce(CASE WHEN pt = t_us THEN pv0 WHEN nt IS NULL THEN pv0 WHEN pt IS NULL THEN nv0 ELSE pv0 + (t_us - pt) / (nt - pt) * (nv0 - pv0) END > 50, false) AS valid FROM n")
def validity_at(spark, d):
    p, s = _probes(spark, d)
    return windows.valid_at(p, s, 0, 50.0, None).select("probe", "valid")


@query("""SELECT p.idx AS probe, m.subchannel_id, round(m.median, 4) AS mean FROM (SELECT * FROM s WHERE channel_id = 'purchase') p ASOF JOIN (SELECT start_us FROM bb WHERE channel_id = 'view') v ON p.t_us >= v.start_us,
(SELECT subchannel_id, median(av) AS median FROM b WHERE channel_id = 'view' GROUP BY ALL) m""")
def mean_near(spark, d):
    p, s = _probes(spark, d)
    return stats.mean_near(p, model.written(stats.block_stats(s), "stats")).select("probe", "subchannel_id", F.round("mean", 4).alias("mean"))


@query("SELECT channel_id, idx, round(a + idx * ((z - a) / (n - 1)), 1) AS t_us FROM s JOIN (SELECT channel_id, min(t_us) AS a, max(t_us) AS z, count(*) AS n FROM s GROUP BY ALL) USING (channel_id)")
def uniform_times(spark, d):
    rows = model.samples(spark, d).select(*K, "idx")
    return timebase.uniform_times(rows, model.blocks(spark, d)).select("channel_id", "idx", r("t_us", 1))


_R = "(user_id % 3)::VARCHAR AS recording_id"


@query(f"SELECT {_R}, event_type AS channel_id, epoch_us(w) AS start_us, round(avg(value) + 1e-7, 4) AS av, round(quantile_disc(value, 0.5), 4) AS median FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY ALL", plain=True)
def stream_sliding(spark, d):
    return _streamed(spark, d, lambda s: live.sliding(s, "1 day", "12 hours"), "complete").select("recording_id", "channel_id", F.unix_micros("w.start").alias("start_us"), F.round(F.col("av") + 1e-7, 4).alias("av"), r("median"))


@query(f"SELECT {_R}, event_type AS channel_id, event_id AS seq, (epoch_us(ts) // 1000 - (SELECT min(epoch_us(ts)) FROM events) // 1000) AS t_us FROM events", plain=True)
def stream_ticks(spark, d):
    first = model.raw_samples(spark, d).agg(F.min("t_us")).first()[0] or 0

    def ticks(s):
        ms = F.floor(F.col("t_us") / 1000).cast("bigint") - first // 1000
        return s.select(*K, F.col("event_id").alias("seq"), (ms % LONG_MODULUS).alias("tick"))

    rows, _ = _written(spark, lambda *to: live.live_ticks(ticks(_stream(spark, d)), LONG_MODULUS, 1.0, *to), "recording_id string, channel_id string, seq bigint, t_us bigint")
    return rows


@query("SELECT channel_id, idx, idx // 64 AS block_seq FROM s")
def block_of_index(spark, d):
    return slices.locate_blocks(model.samples(spark, d).select(*K, "idx"), timebase.index_ranges(model.blocks(spark, d))).select("channel_id", "idx", "block_seq")


# Windows


@query(f"""SELECT channel_id, t_us AS start_us, coalesce((SELECT min(g.t_us) FROM s g WHERE g.channel_id = e.channel_id AND g.idx > e.idx AND g.v0 > 20 AND g.v0 < 200), -1) AS end_us
FROM (SELECT *, lag(v0 > 20 AND v0 < 200) OVER (PARTITION BY channel_id ORDER BY idx) AS before FROM s) e WHERE NOT (v0 > 20 AND v0 < 200) AND coalesce(before, true)""")
def warning_intervals(spark, d):
    bad = ~windows.in_range(F.col("raw")[0], 20.0, 200.0)
    return windows.bad_intervals(model.indexed(spark, d), bad).select("channel_id", "start_us", "end_us")


@query(f"SELECT channel_id, block_seq, end_us AS gap_start_us, nx AS gap_end_us FROM (SELECT *, lead(start_us) OVER (PARTITION BY channel_id ORDER BY block_seq) AS nx FROM bb) WHERE nx - end_us > {DAY // 24}")
def gaps(spark, d):
    return timebase.gaps(model.blocks(spark, d), DAY // 24).select("channel_id", "block_seq", "gap_start_us", "gap_end_us")


@query("SELECT channel_id, idx, subchannel_id, round(v - avg(v) OVER (PARTITION BY channel_id, subchannel_id), 4) AS v FROM l")
def mean_removed(spark, d):
    return windows.remove_mean(model.samples(spark, d)).select("channel_id", "idx", "subchannel_id", r("v"))


@query("SELECT channel_id, idx, subchannel_id, round(v - m, 4) AS v FROM l JOIN (SELECT channel_id, subchannel_id, median(av) AS m FROM b GROUP BY ALL) USING (channel_id, subchannel_id)")
def block_median_removed(spark, d):
    return windows.remove_block_median(model.samples(spark, d), model.written(model.stats(spark, d), "stats"), None).select("channel_id", "idx", "subchannel_id", r("v"))


# Times


#: Of ticks in milliseconds; the second for series whose samples are days apart.
MODULUS, LONG_MODULUS = 1 << 27, 1 << 31


@query(f"SELECT channel_id, event_id, (t_us - {_T}) // 1000 AS t_ms FROM s")
def tick_unroll(spark, d):
    """Events in wrapping milliseconds, a block each in file order; a channel's first event comes within one wrap of the start."""
    s = model.raw_samples(spark, d)
    first = s.agg(F.min("t_us")).first()[0] or 0
    ms = F.floor((F.col("t_us") - first) / 1000).cast("bigint")
    raw = s.select(*K, F.col("event_id").alias("block_seq"), "event_id", (ms % MODULUS).alias("start_tick"), F.lit(None).cast("bigint").alias("end_tick"))
    return timebase.unroll_ticks(raw, MODULUS, 1.0).select("channel_id", "event_id", F.col("start_us").alias("t_ms"))


@query(f"SELECT channel_id, event_id, t AS start_ms, t AS end_ms FROM (SELECT *, (t_us - {_T}) // 1000 AS t FROM s)")
def tick_unroll_absolute(spark, d):
    """As tick_unroll; every 50th tick is absolute, and each third block has an end, some of them absolute, too."""
    s = model.raw_samples(spark, d)
    first = s.agg(F.min("t_us")).first()[0] or 0
    ms = F.floor((F.col("t_us") - first) / 1000).cast("bigint")
    tick = lambda whole: F.when(whole & (ms > MODULUS), ms).otherwise(ms % MODULUS)
    end = F.when(F.col("event_id") % 3 == 0, tick(F.col("event_id") % 36 == 0))
    raw = s.select(*K, F.col("event_id").alias("block_seq"), "event_id", tick(F.col("event_id") % 50 == 0).alias("start_tick"), end.alias("end_tick"))
    return timebase.unroll_ticks(raw, MODULUS, 1.0).select("channel_id", "event_id", F.col("start_us").alias("start_ms"), F.col("end_us").alias("end_ms"))


@query(f"""SELECT channel_id, block_seq FROM (SELECT *, min(CASE WHEN done THEN block_seq END) OVER w AS fin, min(CASE WHEN inn THEN block_seq END) OVER w AS f, arg_min(start_us, CASE WHEN inn THEN block_seq END) OVER w AS fs
FROM (SELECT *, end_us >= s0 AS inn, end_us >= s0 AND (CASE WHEN start_us <= s0 THEN end_us >= e0 ELSE end_us > e0 END) AS done FROM bb, (SELECT {_T} + {10 * DAY} AS s0, {_T} + {100 * DAY} AS e0))
WINDOW w AS (PARTITION BY channel_id)) WHERE (inn AND (fin IS NULL OR block_seq <= fin)) OR (block_seq = f - 1 AND fs > s0)""")
def edge_safe_extract(spark, d):
    return recordings.edge_safe(model.blocks(spark, d), *_range(model.raw_samples(spark, d))).select("channel_id", "block_seq")


@query("SELECT channel_id, block_seq, i AS pos, round(start_us + CASE WHEN n > 1 THEN i * ((end_us - start_us) / (n - 1)) ELSE 0 END, 1) AS t_us FROM (SELECT *, unnest(range(n)) AS i FROM bb)")
def sample_times(spark, d):
    return timebase.sample_times(model.blocks(spark, d)).select("channel_id", "block_seq", F.col("pos").cast("bigint").alias("pos"), r("t_us", 1))


@query("""SELECT channel_id, block_seq, round(1e6 / p, 9) AS rate_hz FROM (SELECT *, CASE WHEN n > 1 THEN (end_us - start_us) / (n - 1) ELSE coalesce(nx, lag((end_us - start_us) / nullif(n - 1, 0)) OVER (PARTITION BY channel_id ORDER BY block_seq)) END AS p
FROM (SELECT *, (lead(start_us) OVER (PARTITION BY channel_id ORDER BY block_seq) - start_us) / n AS nx FROM bb))""")
def sample_rate(spark, d):
    return timebase.sample_rates(model.blocks(spark, d)).select("channel_id", "block_seq", r("rate_hz", 9))


@query("""SELECT channel_id, block_seq, round(1e6 / coalesce(p, lag(p) OVER (PARTITION BY channel_id ORDER BY block_seq)), 9) AS rate_hz
FROM (SELECT *, CASE WHEN block_seq % 3 = 0 OR n < 2 THEN (lead(start_us) OVER (PARTITION BY channel_id ORDER BY block_seq) - start_us) / n ELSE (end_us - start_us) / (n - 1) END AS p FROM bb)""")
def sample_rate_open(spark, d):
    """Every third block has no end."""
    blocks = model.blocks(spark, d).withColumn("end_us", F.when(F.col("block_seq") % 3 != 0, F.col("end_us")))
    return timebase.sample_rates(blocks).select("channel_id", "block_seq", r("rate_hz", 9))


def _packed(spark, d) -> DataFrame:
    """Embeddings as payloads of little-endian 32-bit numbers: micro-units of each component."""
    e = model.table(spark, d, "embeddings")
    word = lambda x: F.lpad(F.hex(F.round(x.cast("double") * 1e6).cast("bigint")), 16, "0")
    swap = lambda h: F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(4)))
    return e.select("vec_id", F.col("label").alias("channel_id"), F.unhex(F.array_join(F.transform("embedding", lambda x: swap(word(x))), "")).alias("payload"))


@query("SELECT vec_id, i - 1 AS pos, round(embedding[i]::DOUBLE * 1e6)::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)", plain=True)
def decode_payload(spark, d):
    rows = decode.to_samples(decode.decode_payload(_packed(spark, d), "<i"))
    return rows.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("raw")[0].alias("v"))


@query("SELECT vec_id, 256 AS bytes, 64 AS n, vec_id % 5 = 0 AS ragged, false AS empty FROM embeddings", plain=True)
def validate_blocks(spark, d):
    p = _packed(spark, d).withColumns({"start_tick": F.lit(1), "end_tick": F.lit(2)})
    cut = p.withColumn("payload", F.when(F.col("vec_id") % 5 == 0, F.substring("payload", 1, 254)).otherwise(F.col("payload")))
    out = decode.validate_blocks(cut, F.lit(4))
    return out.join(p.select("vec_id", F.octet_length("payload").alias("bytes"), decode.n_samples("payload", 4).cast("int").alias("n")), "vec_id").select("vec_id", "bytes", "n", "ragged", "empty")


# Many recordings


@query("""SELECT user_id % 7 AS group_id, user_id, event_id, t_us + (u - min(u) OVER (PARTITION BY user_id % 7)) * 1000000 AS t_us FROM (SELECT *, user_id * 3600 AS u FROM s)""")
def merge_recordings(spark, d):
    s = model.raw_samples(spark, d).withColumn("recording_id", F.col("user_id"))
    recs = s.select("recording_id").distinct().withColumns({"group_id": F.col("recording_id") % 7, "utc_start_s": F.col("recording_id") * 3600})
    out = recordings.merge(s, recordings.merge_order(recs, ["group_id"]))
    return out.select(F.col("recording_id").alias("group_id"), F.col("origin_id").alias("user_id"), "event_id", "t_us")


@query("SELECT user_id, min(t_us) AS start_us, max(t_us) AS end_us FROM s GROUP BY user_id")
def recording_length(spark, d):
    b = model.raw_samples(spark, d).select(F.col("user_id").alias("recording_id"), F.col("t_us").alias("start_us"), F.col("t_us").alias("end_us"))
    return recordings.lengths(b).withColumnRenamed("recording_id", "user_id")


def _attributes(spark, d) -> DataFrame:
    """A customer is an owner; its orders' statuses and a code are attributes."""
    o = model.table(spark, d, "orders")
    null = lambda kind: F.lit(None).cast(kind)
    base = [F.col("o_custkey").alias("recording_id"), F.lit("rec").alias("owner")]
    status = o.select(*base, F.lit("status").alias("name"), F.col("o_orderkey").alias("ord"), F.lit("str").alias("kind"), null("bigint").alias("v_int"), null("double").alias("v_double"), F.col("o_orderstatus").alias("v_string"), null("binary").alias("v_binary"), null("timestamp").alias("v_ts"))
    code = o.select(*base, F.lit("ExitCond"), F.col("o_orderkey"), F.lit("int"), (F.col("o_orderkey") % 6 + 1).cast("bigint"), null("double"), null("string"), null("binary"), null("timestamp"))
    return status.union(code)


@query("SELECT o_custkey AS owner, string_agg(o_orderstatus, ',' ORDER BY o_orderkey, o_orderstatus) AS statuses, count(*) AS n FROM orders GROUP BY ALL", plain=True)
def attributes_rollup(spark, d):
    rows = metadata.rollup(_attributes(spark, d)).select(F.col("recording_id").alias("owner"), F.col("attributes")["status"].alias("s"))
    return rows.select("owner", F.array_join("s", ",").alias("statuses"), F.size("s").cast("bigint").alias("n"))


@query("""SELECT k AS customer, c AS code, CASE c WHEN 1 THEN 'button' WHEN 2 THEN 'usb' WHEN 3 THEN 'time limit' WHEN 4 THEN 'low battery' WHEN 5 THEN 'file size limit' END AS condition
FROM (SELECT o_custkey AS k, min(o_orderkey) % 6 + 1 AS c FROM orders GROUP BY ALL)""", plain=True)
def exit_conditions(spark, d):
    return metadata.exit_conditions(_attributes(spark, d)).select(F.col("recording_id").alias("customer"), "code", "condition")


@query("SELECT o_custkey AS recording_id, k AS key, v AS value FROM (SELECT o_custkey, o_orderkey % 3 AS k, arg_max(CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE o_orderstatus END, o_orderkey) AS v FROM orders GROUP BY ALL) WHERE v <> 'none'", plain=True)
def latest_user_data(spark, d):
    o = model.table(spark, d, "orders")
    value = F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise(F.col("o_orderstatus"))
    rows = o.select(F.col("o_custkey").alias("recording_id"), (F.col("o_orderkey") % 3).alias("key"), F.col("o_orderkey").alias("version"), value.alias("value"))
    return metadata.latest_user_data(rows).where("value <> 'none'").select("recording_id", "key", "value")


@query("""SELECT s_suppkey AS recording_id, -g AS lo, g AS hi FROM (SELECT s_suppkey, CASE s_suppkey % 8 + 15 WHEN 18 THEN 100 WHEN 19 THEN 200 WHEN 20 THEN 500 WHEN 21 THEN 2000 WHEN 22 THEN 6000 ELSE 25 END::DOUBLE AS g FROM supplier WHERE s_nationkey % 4 <> 0)""", plain=True)
def default_metadata(spark, d):
    s = model.table(spark, d, "supplier").select(F.col("s_suppkey").alias("recording_id"), (F.col("s_suppkey") % 8 + 15).alias("recorder_type"), "s_nationkey")
    return metadata.default_sensors(s, s.where("s_nationkey % 4 = 0")).select("recording_id", "lo", "hi")


@query("SELECT s_suppkey, r_name || ':' || n_name || ':' || s_name || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ' (session ' || s_suppkey % 3 || ')' END AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", plain=True)
def paths(spark, d):
    t = {n: model.table(spark, d, n) for n in ("supplier", "nation", "region")}
    rows = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("s_suppkey", names.session_path(names.path(F.col("r_name"), F.col("n_name"), F.col("s_name")), F.col("s_suppkey") % 3).alias("path"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'DEBUG ' || n_name ELSE n_name END AS display_name FROM nation WHERE n_regionkey <= 3 AND n_regionkey <> 2", plain=True)
def catalog(spark, d):
    n = model.table(spark, d, "nation")
    name = F.when(F.col("n_regionkey") == 2, F.concat(F.lit("DEBUG "), F.col("n_name"))).otherwise(F.col("n_name"))
    return metadata.catalogue(n.select("n_nationkey", name.alias("display_name"), name.alias("name"), F.col("n_regionkey").alias("visibility")), 3).select("n_nationkey", "display_name")


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'left' ELSE 'both' END AS side, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'v' END AS columns FROM events WHERE event_id % 11 = 0 OR (event_id % 13 = 0 AND value + 1 <> value)", plain=True)
def series_diff(spark, d):
    a = model.raw_samples(spark, d).select("event_id", "t_us", F.col("raw")[0].alias("v"))
    b = a.where("event_id % 11 <> 0").withColumn("v", F.when(F.col("event_id") % 13 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return windows.series_diff(a, b, ["event_id"]).select("event_id", "side", F.array_join("columns", ",").alias("columns"))


@query(ORACLES["series_diff"], plain=True)
def series_digest_diff(spark, d):
    """The same by digests of blocks of events."""
    a = model.raw_samples(spark, d).select("event_id", "t_us", F.col("raw")[0].alias("v"))
    b = a.where("event_id % 11 <> 0").withColumn("v", F.when(F.col("event_id") % 13 == 0, F.col("v") + 1).otherwise(F.col("v")))
    out = windows.digest_diff(a, b, ["event_id"], [F.floor(F.col("event_id") / 8)], model.shared_path(spark, "differ"))
    return out.select("event_id", "side", F.array_join("columns", ",").alias("columns"))


# Export, spectrum, streams


@query("SELECT channel_id, idx, printf('%.6f', (t_us - t0) * 1e-6) AS time, printf('%.6f', v0) AS Value, printf('%.6f', v1) AS K_1 FROM s, (SELECT min(t_us) AS t0 FROM s)")
def csv_rows(spark, d):
    s = model.samples(spark, d)
    first = s.agg(F.min("t_us")).first()[0] or 0
    return sinks.csv_columns(s.withColumn("t_us", F.col("t_us") - first), ["Value", "K 1"], keep=("channel_id", "idx"))


@query("""SELECT channel_id, subchannel_id, segment, n, round(coalesce(sqrt(sum((re * re + im * im) / n * CASE WHEN 2 * k = n THEN 1 ELSE 2 END) / n), 0), 4) AS rms FROM (
  SELECT channel_id, subchannel_id, segment, n, k, sum(v * cos(2 * pi() * (j * k % n) / n)) AS re, sum(v * sin(2 * pi() * (j * k % n) / n)) AS im
  FROM (SELECT channel_id, subchannel_id, idx // 1024 AS segment, idx % 1024 AS j, v, count(*) OVER (PARTITION BY channel_id, subchannel_id, idx // 1024) AS n FROM l)
  LEFT JOIN (SELECT unnest(range(1, 513)) AS k) ON k / n >= 0.01 AND k / n <= 0.2 GROUP BY ALL) GROUP BY channel_id, subchannel_id, segment, n""")
def band_rms(spark, d):
    s = model.samples(spark, d)
    return spectrum.band_rms(s, 1e6, 0.01, 0.2, 1024).select("channel_id", "subchannel_id", "segment", "n", r("rms"))


@query("""SELECT channel_id, subchannel_id, n, round(coalesce(sqrt(sum((re * re + im * im) * CASE WHEN 2 * k = n THEN 1 ELSE 2 END)) / n, 0), 4) AS rms FROM (
  SELECT channel_id, subchannel_id, n, k, sum(v * cos(2 * pi() * (idx * k % n) / n)) AS re, sum(v * sin(2 * pi() * (idx * k % n) / n)) AS im
  FROM (SELECT *, count(*) OVER (PARTITION BY channel_id, subchannel_id) AS n FROM l) LEFT JOIN (SELECT unnest(range(1, (SELECT count(*) FROM s))) AS k) ON k / n >= 0.1 AND k / n <= 0.12 GROUP BY ALL) GROUP BY channel_id, subchannel_id, n""")
def series_band_rms(spark, d):
    """Of whole series."""
    return spectrum.series_band_rms(model.samples(spark, d), 1e6, 0.1, 0.12).select("channel_id", "subchannel_id", "n", r("rms"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events of three recordings as a stream."""
    return _live(spark.readStream.schema(model.table(spark, d, "events").schema).parquet(f"{d}/events*"))


def _live(events: DataFrame) -> DataFrame:
    """Events as samples of three recordings."""
    key = [(F.col("user_id") % 3).cast("string").alias("recording_id"), F.lit(0).alias("session_id"), F.col("event_type").alias("channel_id")]
    return events.select(F.col("ts").cast("timestamp").alias("ts"), *key, "event_id", F.col("value").alias("v"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))


def _written(spark: SparkSession, start: Callable[[str, str], StreamingQuery], schema: str) -> tuple[DataFrame, str]:
    """What a stream writes by itself until its end, and where."""
    out = model.shared_path(spark, "stream")
    spark.createDataFrame([], schema).write.parquet(f"{out}/data/none")
    start(out, f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/data"), out


def _streamed(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a stream over the events to its end. Each batch is written under its number, so a repeated batch replaces itself;
    in complete mode the last one is the result."""
    out = model.shared_path(spark, "stream")
    result = build(_stream(spark, d))
    spark.createDataFrame([], result.schema).write.parquet(f"{out}/data/none")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/{'last' if mode == 'complete' else number}")

    q = result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).option("recursiveFileLookup", True).parquet(f"{out}/data")


#: Batches in which events arrive, and how many days late some are.
BATCHES, SPREAD = 3, 10


def _in_batches(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], spread: int = 0) -> DataFrame:
    """What a stream puts out in append mode while events arrive in batches, in order but for a spread of so many days.

    Only what the watermark has passed is put out, and its state is given up.
    """
    out, events = model.shared_path(spark, "stream"), model.table(spark, d, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = (x or 0 for x in events.agg(F.min(t), F.max(t)).first())
    at = t - first + F.pmod(F.xxhash64("event_id"), F.lit(1000)) * (spread * DAY // 1000)
    number = F.floor(at * BATCHES / (last - first + spread * DAY + 1))
    for i in range(BATCHES):  # the stream goes on where it ended
        events.where(number == i).write.mode("append").parquet(f"{out}/in")
        with live.keyed_state(spark):
            result = build(_live(spark.readStream.schema(events.schema).parquet(f"{out}/in")))
            writer = result.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
            writer.trigger(**live.ONCE).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/data")


def _passed(late_ms: int) -> str:
    """The watermark in milliseconds."""
    return f"(SELECT max(epoch_us(ts)) // 1000 - {late_ms} FROM events)"


HOUR_MS, LATE_MS = 3_600_000, 20 * DAY // 1000


def _closed(sql: str, end: str, late_ms: int) -> str:
    return f"SELECT * FROM ({sql}) WHERE {end} <= {_passed(late_ms)}"


@query(_closed(f"SELECT {_R}, event_type AS channel_id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, round(min(value), 4) AS mn, round(avg(value) + 1e-7, 4) AS av, round(max(value), 4) AS mx, count(*) AS n FROM events GROUP BY ALL", f"(start_us + {DAY}) // 1000", HOUR_MS), plain=True)
def stream_tumbling_closed(spark, d):
    """Days that the watermark has passed, each put out once."""
    rows = _in_batches(spark, d, lambda s: live.tumbling(s, "1 day"))
    return rows.select("recording_id", "channel_id", F.unix_micros("w.start").alias("start_us"), r("mn"), F.round(F.col("av") + 1e-7, 4).alias("av"), r("mx"), "n")


@query(_closed(f"SELECT {_R}, event_type AS channel_id, epoch_us(w) AS start_us, round(avg(value) + 1e-7, 4) AS av, round(quantile_disc(value, 0.5), 4) AS median FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY ALL", f"(start_us + {DAY}) // 1000", HOUR_MS), plain=True)
def stream_sliding_closed(spark, d):
    rows = _in_batches(spark, d, lambda s: live.sliding(s, "1 day", "12 hours"))
    return rows.select("recording_id", "channel_id", F.unix_micros("w.start").alias("start_us"), F.round(F.col("av") + 1e-7, 4).alias("av"), r("median"))


@query(f"""SELECT recording_id, channel_id, start_us, n, mx FROM (SELECT {_R}, channel_id, min(t_us) AS start_us, count(*) AS n, round(max(v0), 4) AS mx, max(t_us) AS z FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id % 3, channel_id ORDER BY idx) AS g
FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY user_id % 3, channel_id ORDER BY idx) < {DAY // 12} THEN 0 ELSE 1 END AS cut FROM s)) GROUP BY user_id % 3, channel_id, g) WHERE (z + {DAY // 12}) // 1000 <= {_passed(HOUR_MS)}""")
def stream_sessions_closed(spark, d):
    rows = _in_batches(spark, d, lambda s: live.gap_sessions(s, "2 hours"))
    return rows.select("recording_id", "channel_id", F.unix_micros("w.start").alias("start_us"), "n", r("mx"))


@query(f""", w AS (SELECT {_R}, channel_id, idx, t_us, NOT (v0 > 20 AND v0 < 200) AS bad FROM s),
x AS (SELECT *, lag(bad) OVER (PARTITION BY recording_id, channel_id ORDER BY idx) AS before, min(CASE WHEN NOT bad THEN t_us END) OVER (PARTITION BY recording_id, channel_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS end_us FROM w)
SELECT recording_id, channel_id, t_us AS start_us, end_us FROM x WHERE bad AND NOT coalesce(before, false) AND (end_us + 999) // 1000 <= {_passed(LATE_MS)}""")
def stream_intervals_in_order(spark, d):
    """Out-of-range intervals of events that come up to ten days late; those whose end the watermark has passed."""
    rows = _in_batches(spark, d, lambda s: live.intervals_in_order(s, 20.0, 200.0, "20 days"), SPREAD)
    return rows.select("recording_id", "channel_id", "start_us", "end_us")


@query(f"SELECT {_R}, event_type AS channel_id, event_id AS seq, (epoch_us(ts) // 1000 - (SELECT min(epoch_us(ts)) FROM events) // 1000) AS t_us FROM events WHERE (epoch_us(ts) + 999) // 1000 <= {_passed(LATE_MS)}", plain=True)
def stream_ticks_in_order(spark, d):
    first = model.raw_samples(spark, d).agg(F.min("t_us")).first()[0] or 0
    ms = F.floor(F.col("t_us") / 1000).cast("bigint") - first // 1000
    rows = _in_batches(spark, d, lambda s: live.ticks_in_order(s.select(*K, "ts", F.col("event_id").alias("seq"), (ms % LONG_MODULUS).alias("tick")), LONG_MODULUS, 1.0, "20 days"), SPREAD)
    return rows.select("recording_id", "channel_id", "seq", "t_us")


@query(f"SELECT {_R}, event_type AS channel_id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, round(min(value), 4) AS mn, round(avg(value) + 1e-7, 4) AS av, round(max(value), 4) AS mx, count(*) AS n FROM events GROUP BY ALL", plain=True)
def stream_tumbling(spark, d):
    return _streamed(spark, d, lambda s: live.tumbling(s, "1 day"), "complete").select("recording_id", "channel_id", F.unix_micros("w.start").alias("start_us"), r("mn"), F.round(F.col("av") + 1e-7, 4).alias("av"), r("mx"), "n")


@query(f"""SELECT {_R}, channel_id, min(t_us) AS start_us, count(*) AS n, round(max(v0), 4) AS mx FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id % 3, channel_id ORDER BY idx) AS g
FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY user_id % 3, channel_id ORDER BY idx) < {DAY // 12} THEN 0 ELSE 1 END AS cut FROM s)) GROUP BY user_id % 3, channel_id, g""")
def stream_sessions(spark, d):
    return _streamed(spark, d, lambda s: live.gap_sessions(s, "2 hours"), "complete").select("recording_id", "channel_id", F.unix_micros("w.start").alias("start_us"), "n", r("mx"))


@query(f""", w AS (SELECT {_R}, channel_id, idx, t_us, NOT (v0 > 20 AND v0 < 200) AS bad FROM s)
SELECT recording_id, channel_id, t_us AS start_us, coalesce((SELECT min(g.t_us) FROM w g WHERE g.recording_id = e.recording_id AND g.channel_id = e.channel_id AND g.idx > e.idx AND NOT g.bad), -1) AS end_us
FROM (SELECT *, lag(bad) OVER (PARTITION BY recording_id, channel_id ORDER BY idx) AS before FROM w) e WHERE bad AND NOT coalesce(before, false)""")
def stream_warnings(spark, d):
    """Intervals that closed, and those that the last batch left open."""
    schema = "recording_id string, channel_id string, start_us bigint, end_us bigint"
    rows, out = _written(spark, lambda *to: live.live_intervals(_stream(spark, d), 20.0, 200.0, *to), schema)
    return rows.unionByName(live.open_intervals(spark, out).select(*rows.columns))


@query(f"SELECT channel_id, event_id, t_us < (SELECT (min(t_us) + max(t_us)) // 2 FROM s) AS late FROM s")
def late_rows(spark, d):
    """The later half of the time arrives first, so all of the earlier half is late."""
    path, events = model.shared_path(spark, "late"), model.table(spark, d, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    middle = sum(x or 0 for x in events.agg(F.min(t), F.max(t)).first()) // 2
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel_id"), "event_id")
    for half in (F.unix_micros("ts") >= middle, F.unix_micros("ts") < middle):  # the stream goes on where it ended
        rows.where(half).write.mode("append").parquet(f"{path}/in")
        live.route_late(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), path, f"{path}/checkpoint").awaitTermination()
    read = lambda name: spark.read.schema("channel_id string, event_id bigint").option("recursiveFileLookup", True).parquet(f"{path}/{name}")
    return read("data").withColumn("late", F.lit(False)).unionByName(read("late").withColumn("late", F.lit(True)))
