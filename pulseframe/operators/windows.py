"""Mean removal, out-of-range intervals and series comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..schema import K
from . import timebase
from .asof import interpolate
from .stats import block_medians, long_form

#: Channels whose mean may be removed, where the dimension table says nothing. Fixed values.
MEAN_REMOVAL_CHANNELS = ("0", "8", "32", "80")


def mean_removal_allowed(declared: Column | None = None) -> Column:
    """What the dimension table declares; where it doesn't, whether the channel is one of MEAN_REMOVAL_CHANNELS."""
    known = F.col("channel_id").isin(*MEAN_REMOVAL_CHANNELS)
    return known if declared is None else F.coalesce(declared, known)


def remove_mean(samples: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Long form with v less its series' mean: one aggregate row per subchannel joined back, no window over samples."""
    rows = long_form(samples)
    means = rows.groupBy(*K, "subchannel_id").agg(F.avg("v").alias("_mean"))
    v = F.col("v") - F.col("_mean")
    return rows.join(means, [*K, "subchannel_id"]).withColumn("v", v if allowed is None else F.when(allowed, v).otherwise(F.col("v"))).drop("_mean")


def remove_block_median(samples: DataFrame, stats: DataFrame, span_us: int | None) -> DataFrame:
    """Long form with v less the median of the block means around its block."""
    medians = block_medians(stats, span_us).select(*K, "block_seq", "subchannel_id", "median")
    return long_form(samples).join(medians, [*K, "block_seq", "subchannel_id"]).withColumn("v", F.col("v") - F.col("median")).drop("median")


def in_range(v: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """Strictly between the bounds; a bound that is null is open."""
    above = F.lit(True) if low is None else F.coalesce(v > low, F.lit(True))
    return above if high is None else above & F.coalesce(v < high, F.lit(True))


def valid_at(probes: DataFrame, samples: DataFrame, subchannel: int, low: float | None, high: float | None) -> DataFrame:
    """Whether a subchannel is in its range at each probe; outside the series its nearest end counts."""
    rows = interpolate(probes, samples, "clamp")
    return rows.withColumn("valid", in_range(F.col("raw")[subchannel], low, high)).drop("raw")


def range_label(name: Column, low: Column, high: Column, unit: Column) -> Column:
    """Text of what a range warns of: values above, below or outside it."""
    one_sided = F.when(low.isNull(), F.format_string("%s above %s%s", name, high, unit)).when(high.isNull(), F.format_string("%s below %s%s", name, low, unit))
    return one_sided.otherwise(F.format_string("%s outside range %s%s to %s%s", name, low, unit, high, unit))


def bad_intervals(samples: DataFrame, bad: Column) -> DataFrame:
    """[start_us, end_us) of runs where bad holds; the end is the first good sample's time, -1 for an open tail.

    Change points are found inside buckets of sample numbers (of time, where idx isn't a number); each bucket gets the state it starts in and the next
    change after it from one row per bucket.
    """
    rows = samples.select(*K, "idx", "t_us", F.coalesce(bad, F.lit(False)).alias("_bad"))
    numbered = isinstance(rows.schema["idx"].dataType, IntegralType)
    rows = rows.withColumn("_b", F.floor(F.col("idx") / timebase.BUCKET_ROWS).cast("bigint")) if numbered else timebase.time_buckets(rows, samples)
    line = Window.partitionBy(*K).orderBy("_b")
    states = rows.groupBy(*K, "_b").agg(F.max_by("_bad", "idx").alias("_last")).withColumn("_in", F.lag("_last").over(line)).drop("_last")
    inside = Window.partitionBy(*K, "_b").orderBy("idx")
    before = F.coalesce(F.lag("_bad").over(inside), F.col("_in"), F.lit(False))
    changes = rows.join(states, [*K, "_b"]).withColumn("_before", before).where(F.col("_bad") != F.col("_before"))
    first = changes.groupBy(*K, "_b").agg(F.min("t_us").alias("_first")).withColumn("_next", F.lead("_first").over(line)).drop("_first")
    end = F.coalesce(F.lead("t_us").over(inside), F.col("_next"), F.lit(-1))
    return changes.join(first, [*K, "_b"]).withColumn("end_us", end).where("_bad").select(*K, F.col("t_us").alias("start_us"), "end_us")


def series_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ between two series tables: keys, side ('left', 'right' or 'both') and the columns that differ."""
    values = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(*values).alias("_a"))
    right = b.select(*keys, F.struct(*values).alias("_b"))
    rows = left.join(right, keys, "full_outer")
    wrong = F.array_compact(F.array(*(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in values)))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return rows.withColumns({"side": side, "columns": F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.array().cast("array<string>")).otherwise(wrong)}).where((F.col("side") != "both") | (F.size("columns") > 0)).drop("_a", "_b")


#: Blocks that differ, up to which they are broadcast.
FEW_BLOCKS = 1_000_000


def digest_diff(a: DataFrame, b: DataFrame, keys: list[str], block: list[Column], scratch: str) -> DataFrame:
    """As series_diff, by digests of blocks of rows first: rows are compared, and travel, only where those differ.

    block: expressions of the keys that put rows into blocks. A digest is the number of rows and sums of both halves of their hashes, so it doesn't depend on
    their order, and repeated rows don't cancel. The blocks that differ are written under scratch and counted, so the rest of the plan knows whether they may be broadcast.
    """
    names = [f"_block{i}" for i in range(len(block))]
    tagged = lambda df: df.select("*", *(c.alias(n) for c, n in zip(block, names)))

    def digests(df: DataFrame) -> DataFrame:
        h = F.xxhash64(*sorted(c for c in df.columns if c not in names))
        low, high = h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(h, 32)
        return df.groupBy(*names).agg(F.struct(F.count(F.lit(1)), F.sum(low), F.sum(high)).alias("_d"))

    a_, b_ = tagged(a), tagged(b)
    same = [F.col(f"_l.{n}").eqNullSafe(F.col(f"_r.{n}")) for n in names]
    pairs = digests(a_).alias("_l").join(digests(b_).alias("_r"), same, "full_outer").where(~F.col("_l._d").eqNullSafe(F.col("_r._d")))
    pairs.select(*(F.coalesce(f"_l.{n}", f"_r.{n}").alias(n) for n in names)).write.parquet(scratch)
    differ = a.sparkSession.read.schema(a_.select(*names).schema).parquet(scratch)
    number = differ.count()
    if not number:
        return series_diff(a.limit(0), b.limit(0), keys)
    differ = F.broadcast(differ) if number <= FEW_BLOCKS else differ
    opened = lambda df: df.alias("_l").join(differ.alias("_r"), same, "left_semi").drop(*names)
    return series_diff(opened(a_), opened(b_), keys)
