"""Polynomial calibrations as column expressions, composed in the dimension table rather than per sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.asof import asof, nearest
from ..operators.stats import long_form, weighted_mean
from ..schema import K


def accelerometer(v: Column, amax: float) -> Column:
    return v * amax / 32767.0


def univariate(v: Column, c: Column, x_ref: Column) -> Column:
    """Of coefficients (a0): a0 whatever v is; of (a0, a1): a0 (v - ref) + a1."""
    return F.when(F.size(c) == 1, F.element_at(c, 1)).otherwise(F.element_at(c, 1) * (v - x_ref) + F.element_at(c, 2))


def bivariate(x: Column, y: Column, c: Column, x_ref: Column, y_ref: Column) -> Column:
    """A (x - xr)(y - yr) + B (x - xr) + C (y - yr) + D."""
    a, b, cc, d = (F.element_at(c, i) for i in range(1, 5))
    return a * (x - x_ref) * (y - y_ref) + b * (x - x_ref) + cc * (y - y_ref) + d


def expand(c: Column, x_ref: Column, y_ref: Column | None = None) -> Column:
    """Coefficients without references: (a0, a1) or (A, B, C, D) around zero."""
    if y_ref is None:
        return F.when(F.size(c) == 1, F.array(F.lit(0.0), F.element_at(c, 1))).otherwise(F.array(F.element_at(c, 1), F.element_at(c, 2) - F.element_at(c, 1) * x_ref))
    a, b, cc, d = (F.element_at(c, i) for i in range(1, 5))
    return F.array(a, b - a * y_ref, cc - a * x_ref, a * x_ref * y_ref - b * x_ref - cc * y_ref + d)


def compose(outer: Column, inner: Column) -> Column:
    """Expanded coefficients of an outer calibration (two or four) after an inner, univariate one of x."""
    g, o = F.element_at(inner, 1), F.element_at(inner, 2)
    a, b, cc, d = (F.element_at(outer, i) for i in range(1, 5))
    return F.when(F.size(outer) == 2, F.array(a * g, a * o + b)).otherwise(F.array(a * g, b * g, cc + a * o, b * o + d))


def apply_univariate(samples_long: DataFrame, transforms: DataFrame) -> DataFrame:
    """v calibrated by the row of transforms for its channel and subchannel; without one it stays. Dimension rows: channel_id, subchannel_id, c, x_ref."""
    rows = samples_long.join(transforms.withColumnsRenamed({"c": "_c", "x_ref": "_x"}), ["channel_id", "subchannel_id"], "left")
    v = F.when(F.col("_c").isNull(), F.col("v")).otherwise(univariate(F.col("v"), F.col("_c"), F.coalesce("_x", F.lit(0.0))))
    return rows.withColumn("v", v).drop("_c", "_x")


def needs_y(c: Column) -> Column:
    """Whether a bivariate calibration reads its other channel at all."""
    return (F.element_at(c, 1) != 0) | (F.element_at(c, 3) != 0)


def compensation(samples: DataFrame, y_samples: DataFrame, y_stats: DataFrame, y_subchannel: int, mode: str = "mean") -> DataFrame:
    """samples with y: 'off' (zero), 'mean' of the other channel, or 'nearest' in time and its mean where there is none.

    Channels of one recording and session belong together; y_samples and y_stats hold one channel each.
    """
    if mode == "off":
        return samples.withColumn("y", F.lit(0.0))
    own = ["recording_id", "session_id"]
    mean = weighted_mean(y_stats.where(F.col("subchannel_id") == y_subchannel)).select(*own, F.col("mean").alias("_mean"))
    if mode == "mean":
        return samples.join(mean, own, "left").withColumn("y", F.coalesce("_mean", F.lit(0.0))).drop("_mean")
    shared = y_samples.withColumn("channel_id", F.lit("*"))
    rows = nearest(samples.withColumnRenamed("channel_id", "_channel").withColumn("channel_id", F.lit("*")), shared).drop("channel_id").withColumnRenamed("_channel", "channel_id")
    rows = rows.join(mean, own, "left")
    return rows.withColumn("y", F.coalesce(F.col("near")[y_subchannel], "_mean", F.lit(0.0))).drop("near", "near_t", "near_idx", "_mean")


IDENTITY = (1.0, 0.0)


def lineage(subchannels: DataFrame, channels: DataFrame, transforms: DataFrame) -> DataFrame:
    """transforms of each subchannel as an array of ids, the channel's before its own; ids that no transform has are left out."""
    keys = ["recording_id", "channel_id", "subchannel_id"]
    rows = subchannels.select(*keys, F.col("transform_id").alias("_own")).join(channels.select("recording_id", "channel_id", F.col("transform_id").alias("_channel")), ["recording_id", "channel_id"], "left")
    known = transforms.select("recording_id", "transform_id", F.lit(True).alias("_known"))
    for c in ("_channel", "_own"):
        rows = rows.join(known.withColumnsRenamed({"transform_id": c, "_known": f"{c}_known"}), ["recording_id", c], "left")
    return rows.select(*keys, F.array_compact(F.array(*(F.when(F.col(f"{c}_known"), F.col(c)) for c in ("_channel", "_own")))).alias("transforms"))


def levels(lines: DataFrame, level: str = "full") -> DataFrame:
    """c of lines (expanded coefficients channel_c, own_c, display_c; null: identity) at a level: 'channel', 'full' (then the
    subchannel's own) or 'display' (then the unit's). All three are composed here, once for each row of the dimension."""
    one = F.array(*map(F.lit, IDENTITY))
    c = F.coalesce("channel_c", one)
    for name in {"channel": (), "full": ("own_c",), "display": ("own_c", "display_c")}[level]:
        c = compose(F.coalesce(name, one), c)
    return lines.withColumn("c", c)


def composed_lines(channels: DataFrame, subchannels: DataFrame, transforms: DataFrame) -> DataFrame:
    """A line per subchannel: its channel's transform, then its own; c has two terms, or four where the other channel counts.

    channels and subchannels name their transform_id (null or unknown: none); a line whose other channel has no effect has two terms.
    """
    ref = lambda c: F.coalesce(c, F.lit(0.0))
    both = F.when(F.size("c") == 4, expand(F.col("c"), ref("x_ref"), ref("y_ref"))).otherwise(expand(F.col("c"), ref("x_ref")))
    known = transforms.select("recording_id", "transform_id", both.alias("_c"), "y_channel_id", "y_subchannel_id")
    rows = subchannels.select("recording_id", "channel_id", "subchannel_id", "transform_id").join(known.withColumnRenamed("_c", "own_c"), ["recording_id", "transform_id"], "left").drop("transform_id")
    first = channels.select("recording_id", "channel_id", "transform_id").join(known.where(F.size("_c") == 2).select("recording_id", "transform_id", F.col("_c").alias("channel_c")), ["recording_id", "transform_id"])
    rows = levels(rows.join(first.drop("transform_id"), ["recording_id", "channel_id"], "left"))
    c = F.when((F.size("c") == 4) & ~needs_y(F.col("c")), F.array(F.element_at("c", 2), F.element_at("c", 4))).otherwise(F.col("c"))
    return rows.select("recording_id", "channel_id", "subchannel_id", c.alias("c"), *(F.when(F.size(c) == 4, F.col(x)).alias(x) for x in ("y_channel_id", "y_subchannel_id")))


def line_effects(means: DataFrame, lines: DataFrame, mode: str = "mean") -> DataFrame:
    """_gain and _offset of each series' subchannel (means: K, subchannel_id, _mean): its composed line with y fixed.

    y of a line with four terms is zero ('off') or the calibrated mean of its channel in that session, by that channel's own line, which must
    have two terms. Subchannels without a line stay.
    """
    series = [*K, "subchannel_id"]
    own = means.join(lines, ["recording_id", "channel_id", "subchannel_id"], "left").withColumn("c", F.coalesce("c", F.array(*map(F.lit, IDENTITY))))
    two = F.size("c") == 2
    flat = F.element_at("c", 1) * F.col("_mean") + F.element_at("c", 2)
    ys = own.select("recording_id", "session_id", F.col("channel_id").alias("y_channel_id"), F.col("subchannel_id").alias("y_subchannel_id"), F.when(two, flat).alias("_y"), two.alias("_y_plain"))
    rows = own.join(ys, ["recording_id", "session_id", "y_channel_id", "y_subchannel_id"], "left") if mode == "mean" else own.withColumns({"_y": F.lit(0.0), "_y_plain": F.lit(True)})
    at = lambda i: F.element_at("c", i)
    y = F.when(F.coalesce("_y_plain", F.lit(True)), F.coalesce("_y", F.lit(0.0))).otherwise(F.raise_error(F.lit("a compensating channel is compensated itself")).cast("double"))
    gain, offset = F.when(two, at(1)).otherwise(F.try_element_at("c", F.lit(1)) * y + F.try_element_at("c", F.lit(2))), F.when(two, at(2)).otherwise(F.try_element_at("c", F.lit(3)) * y + F.try_element_at("c", F.lit(4)))
    return rows.select(*series, gain.alias("_gain"), offset.alias("_offset"))


def series_means(samples_long: DataFrame) -> DataFrame:
    return samples_long.groupBy(*K, "subchannel_id").agg(F.avg("v").alias("_mean"))


def calibrate(samples_long: DataFrame, lines: DataFrame, mode: str = "mean", means: DataFrame | None = None) -> DataFrame:
    """v calibrated by composed lines; y of a line with four terms is zero ('off'), the calibrated 'mean' of its channel in that session,
    the calibrated value of its channel that is 'nearest' in time (the mean where there is none), or 'supplied' in a column y.

    With y fixed a line has a gain and an offset, so samples meet one row of a dimension; means, if they aren't given, are one aggregate over
    samples. Subchannels without a line stay, and rows whose key is null are left out.
    """
    series = [*K, "subchannel_id"]
    means = series_means(samples_long) if means is None else means
    if mode in ("mean", "off"):
        rows = samples_long.join(line_effects(means, lines, mode), series)
        return rows.withColumn("v", F.col("v") * F.col("_gain") + F.col("_offset")).drop("_gain", "_offset")
    rows = samples_long.join(lines.withColumnsRenamed({c: f"_{c}" for c in lines.columns if c not in ("recording_id", "channel_id", "subchannel_id")}), ["recording_id", "channel_id", "subchannel_id"], "left")
    two = F.coalesce(F.size("_c") == 2, F.lit(True))
    term = lambda i: F.try_element_at("_c", F.lit(i))
    plain = rows.where(two).withColumn("v", F.coalesce(term(1), F.lit(1.0)) * F.col("v") + F.coalesce(term(2), F.lit(0.0)))
    four = rows.where(~two)
    if mode == "nearest":
        where = ["recording_id", "session_id", "_y_channel_id", "_y_subchannel_id"]
        asked = four.select(*where).distinct()
        others = plain.select("recording_id", "session_id", F.col("channel_id").alias("_y_channel_id"), F.col("subchannel_id").alias("_y_subchannel_id"), "t_us", F.struct("v").alias("row")).join(asked, where, "left_semi")
        mean = others.groupBy(*where).agg(F.avg("row.v").alias("_y_mean"))
        found = asof(four, others, where, "prev", "next")
        later = F.col("prev").isNull() | (F.col("next.t") - F.col("t_us") < F.col("t_us") - F.col("prev.t"))
        four = found.withColumn("_y", F.when(later & F.col("next").isNotNull(), F.col("next.row.v")).otherwise(F.col("prev.row.v"))).drop("prev", "next")
        four = four.join(mean, where, "left").withColumn("_y", F.coalesce("_y", "_y_mean", F.lit(0.0)))
    else:
        four = four.withColumn("_y", F.col("y"))
    four = four.withColumn("v", term(1) * F.col("v") * F.col("_y") + term(2) * F.col("v") + term(3) * F.col("_y") + term(4))
    return plain.select(*samples_long.columns).unionByName(four.select(*samples_long.columns))


def calibrate_samples(samples: DataFrame, lines: DataFrame, mode: str = "mean", means: DataFrame | None = None) -> DataFrame:
    """raw calibrated by composed lines, all subchannels of a sample at once; mode: 'mean' or 'off', as in calibrate()."""
    means = series_means(long_form(samples)) if means is None else means
    effects = line_effects(means, lines, mode)
    per = effects.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("subchannel_id", "_gain", "_offset"))).alias("_e"))  # as many as subchannels
    rows = samples.join(per, K)
    return rows.withColumn("raw", F.zip_with("raw", "_e", lambda v, e: v * e["_gain"] + e["_offset"])).drop("_e")


def replace_transforms(transforms: DataFrame, changes: DataFrame) -> DataFrame:
    """transforms with those of changes, by recording and id, in the place of present ones."""
    return transforms.join(changes, ["recording_id", "transform_id"], "left_anti").unionByName(changes)


def custom(samples_long: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """Any column function (or pandas UDF) as a stage."""
    return samples_long.withColumn("v", f(F.col("v")))


def valid_transforms(transforms: DataFrame, blocks: DataFrame) -> DataFrame:
    """Transforms whose other channel, if they read one, has data."""
    have = blocks.select("recording_id", F.col("channel_id").alias("y_channel_id")).distinct()
    free = transforms.where(F.col("y_channel_id").isNull())
    return free.unionByName(transforms.where(F.col("y_channel_id").isNotNull()).join(have, ["recording_id", "y_channel_id"], "left_semi"))


def as_records(transforms: DataFrame) -> DataFrame:
    return transforms.select("recording_id", "transform_id", F.to_json(F.struct(*transforms.columns)).alias("record"))
