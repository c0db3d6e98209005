"""Summaries by block, range and series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..schema import K

#: Values of a series that are sorted in one buffer for an exact median; rounds by which a longer series is narrowed first, each to about two STEPS-ths.
BUFFER, ROUNDS, STEPS = 1_000_000, 2, 1024
#: Blocks of a series that go to one task of a sliding median, on average.
SLIDING_ROWS = 50_000


def long_form(samples: DataFrame) -> DataFrame:
    """A row per subchannel of each sample."""
    return samples.select(*(c for c in samples.columns if c != "raw"), F.posexplode("raw").alias("subchannel_id", "v"))


def block_stats(samples: DataFrame) -> DataFrame:
    """n, times and per-subchannel minimum, mean and maximum (long form) of each block; partials combine before the shuffle."""
    return long_form(samples).groupBy(*K, "block_seq", "subchannel_id").agg(
        F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.avg("v").alias("av"), F.max("v").alias("mx")
    )


def prefer_stored(stats: DataFrame, stored: DataFrame, use_stored: bool = True) -> DataFrame:
    """Block summaries that came with the recording stand before computed ones."""
    if not use_stored:
        return stats
    kept = stored.select(*K, "block_seq", "subchannel_id", *(F.col(c).alias(f"_{c}") for c in ("mn", "av", "mx")))
    rows = stats.join(kept, [*K, "block_seq", "subchannel_id"], "left")
    return rows.withColumns({c: F.coalesce(f"_{c}", c) for c in ("mn", "av", "mx")}).drop("_mn", "_av", "_mx")


def overlapping(blocks: DataFrame, start_us: int | None, end_us: int | None) -> DataFrame:
    """Blocks that touch a time range; nothing is read beyond the range where block times are stored sorted."""
    if start_us is not None:
        blocks = blocks.where(F.col("end_us") >= start_us)
    return blocks if end_us is None else blocks.where(F.col("start_us") <= end_us)


def calibrated_block_stats(stats: DataFrame, gain: Column | float, offset: Column | float, reference: Column | float = 0.0, mean_of: Column | None = None) -> DataFrame:
    """Block summaries after gain (v - reference) + offset; a negative gain swaps minimum and maximum, row by row.

    mean_of, if given, is taken off all three (the block median of A9, already calibrated).
    """
    f = lambda c: (F.col(c) - reference) * gain + offset - (F.lit(0.0) if mean_of is None else mean_of)
    rows = stats.withColumns({"_a": f("mn"), "_b": f("mx"), "av": f("av")})
    return rows.withColumns({"mn": F.least("_a", "_b"), "mx": F.greatest("_a", "_b")}).drop("_a", "_b")


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and the exact median of each group's values, of which no task buffers more than about BUFFER.

    Larger groups are narrowed in rounds: a mergeable sketch gives STEPS quantiles, the two around the middle ranks, each a step further out than the sketch can
    err, bound what is kept, and what lies below is counted. All of it is partial sums and filters; only bounds travel, of less than a BUFFER-th as many groups
    as there are rows. Null values don't count; a group of nulls has a null median.
    """
    same = lambda: [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in keys]
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v"))
    large = rows.groupBy(*keys).agg(F.count("_v").alias("_n")).where(F.col("_n") > BUFFER)
    left = rows.alias("_l").join(F.broadcast(large).alias("_r"), same(), "left_anti")
    out = left.groupBy(*keys).agg(F.median("_v").alias("median"))
    # middle ranks among what is left of each group
    inside = rows.where("_v is not null").alias("_l").join(F.broadcast(large).alias("_r"), same()).select("_l.*", F.floor((F.col("_n") - 1) / 2).alias("_k"), F.floor(F.col("_n") / 2).alias("_k2"))
    for _ in range(ROUNDS):
        steps = [i / STEPS for i in range(1, STEPS)]
        per = inside.groupBy(*keys, "_k", "_k2").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.percentile_approx("_v", steps, 10 * STEPS).alias("_q"))
        low = F.floor(F.col("_k") * STEPS / F.col("_n")).cast("int") - 2  # places in _q, which begins at the first step
        high = F.ceil((F.col("_k2") + 1) * STEPS / F.col("_n")).cast("int")
        bounds = per.select(*keys, "_k", "_k2", F.when(low < 0, F.col("_least")).otherwise(F.get("_q", low)).alias("_a"), F.when(high > STEPS - 2, F.col("_most")).otherwise(F.get("_q", high)).alias("_z"))
        held = inside.drop("_k", "_k2").alias("_l").join(F.broadcast(bounds).alias("_r"), same()).select("_l.*", "_a", "_z", "_k", "_k2")
        below = held.groupBy(*keys, "_a", "_z", "_k", "_k2").agg(F.count(F.when(F.col("_v") < F.col("_a"), 1)).alias("_below"))
        now = below.select(*keys, "_a", "_z", (F.col("_k") - F.col("_below")).alias("_k"), (F.col("_k2") - F.col("_below")).alias("_k2"))
        inside = inside.drop("_k", "_k2").alias("_l").join(F.broadcast(now).alias("_r"), same()).where("_v >= _a and _v <= _z").select("_l.*", "_k", "_k2")
    # equal values are one entry, so a group that is one value over and over needs no room
    counted = inside.groupBy(*keys, "_k", "_k2", "_v").agg(F.count(F.lit(1)).alias("_c"))
    listed = counted.groupBy(*keys, "_k", "_k2").agg(F.sort_array(F.collect_list(F.struct("_v", "_c"))).alias("_s"))
    at = lambda k: F.aggregate(
        "_s", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("v")),
        lambda acc, x: F.struct((acc["n"] + x["_c"]).alias("n"), F.when((acc["n"] <= F.col(k)) & (F.col(k) < acc["n"] + x["_c"]), x["_v"]).otherwise(acc["v"]).alias("v")), lambda acc: acc["v"],
    )
    return out.unionByName(listed.select(*keys, ((at("_k") + at("_k2")) / 2).alias("median")))


def range_stats(stats: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Minimum, median of block means and maximum of each subchannel; channel rows (subchannel_id null) average the medians.

    The median is exact, or to a part in accuracy.
    """
    keys = [*K, "subchannel_id"]
    ends = [F.min("mn").alias("mn"), F.max("mx").alias("mx")]
    if accuracy is None:
        middle = medians(stats, keys, "av").withColumnRenamed("median", "av")
        per_sub = stats.groupBy(*keys).agg(*ends).alias("_l").join(middle.alias("_r"), [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in keys]).select(*(f"_l.{c}" for c in keys), "mn", "av", "mx")
    else:
        per_sub = stats.groupBy(*keys).agg(ends[0], F.percentile_approx("av", 0.5, accuracy).alias("av"), ends[1])
    whole = per_sub.groupBy(*K).agg(F.min("mn").alias("mn"), F.avg("av").alias("av"), F.max("mx").alias("mx"))
    return per_sub.unionByName(whole.withColumn("subchannel_id", F.lit(None).cast("int")))


def weighted_mean(stats: DataFrame) -> DataFrame:
    """Mean of each subchannel, block means weighted by their samples."""
    return stats.groupBy(*K, "subchannel_id").agg((F.sum(F.col("av") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def channel_mean(means: DataFrame) -> DataFrame:
    return means.groupBy(*K).agg(F.avg("mean").alias("mean"))


def extreme_event(samples: DataFrame, highest: bool = True) -> DataFrame:
    """The sample of each series that holds the highest (lowest) value of any subchannel, the first of equals."""
    pick = F.array_max("raw") if highest else F.array_min("raw")
    order = F.struct(pick.alias("v"), (-F.col("idx") if highest else F.col("idx")).alias("i"))
    by = F.max_by if highest else F.min_by
    return samples.groupBy(*K).agg(by(F.struct("idx", "t_us", "raw"), order).alias("e")).select(*K, "e.idx", "e.t_us", "e.raw")


def sliding_medians(at: np.ndarray, values: np.ndarray, wanted: np.ndarray, reach: int) -> np.ndarray:
    """Median of the values within reach of each wanted place, ends included; at: sorted, values: NaN for none, as the result has.

    Ranks of all values are known, so a tree of counts over them takes in and gives up a value, and finds the middle, in log time each.
    """
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(1, n + 1)
    ordered, rank, valid = values[order].tolist(), rank.tolist(), (~np.isnan(values)).tolist()
    tree, top = [0] * (n + 1), 1 << max(n.bit_length() - 1, 0)

    def add(i: int, by: int) -> None:
        while i <= n:
            tree[i] += by
            i += i & -i

    def find(k: int) -> float:
        place, step = 0, top
        while step:
            if place + step <= n and tree[place + step] <= k:
                place += step
                k -= tree[place]
            step >>= 1
        return ordered[place]

    out = np.full(len(wanted), np.nan)
    first, last, held = 0, 0, 0
    for j, (a, z) in enumerate(zip(np.searchsorted(at, wanted - reach, "left").tolist(), np.searchsorted(at, wanted + reach, "right").tolist())):
        while last < z:
            if valid[last]:
                add(rank[last], 1)
                held += 1
            last += 1
        while first < a:
            if valid[first]:
                add(rank[first], -1)
                held -= 1
            first += 1
        if held:
            out[j] = (find((held - 1) // 2) + find(held // 2)) / 2
    return out


def _sliding(reach: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("start_us")
        own = rows.filter(rows["_own"])
        values = rows["av"].to_numpy(zero_copy_only=False).astype(np.float64)
        found = sliding_medians(rows["start_us"].to_numpy(), values, own["start_us"].to_numpy(), reach)
        return own.drop_columns(["_b", "_own"]).append_column("median", pa.array(found, pa.float64(), from_pandas=True))

    return run


def block_medians(stats: DataFrame, span_us: int | None = None, accuracy: int | None = None) -> DataFrame:
    """Median of block means, of the whole series (exact, or to a part in accuracy) or of the blocks that start within half a span of each block.

    For a span, time is cut into buckets at least as wide as it; a task has one with what is near its ends, so a block is in two at most. Only series of more than
    SLIDING_ROWS blocks are cut, and of those there are so few that their starts and widths can be broadcast. Blocks without a start have no median.
    """
    keys = [*K, "subchannel_id"]
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in keys]
    if span_us is None:
        whole = medians(stats, keys, "av") if accuracy is None else stats.groupBy(*keys).agg(F.percentile_approx("av", 0.5, accuracy).alias("median"))
        return stats.alias("_l").join(whole.alias("_r"), same).select("_l.*", "median")
    reach = span_us // 2
    n = F.count(F.lit(1))
    per = stats.groupBy(*keys).agg(n.alias("_n"), F.min("start_us").alias("_from"), F.max("start_us").alias("_to")).where(F.col("_n") > SLIDING_ROWS)
    cut = per.select(*keys, "_from", F.greatest(F.ceil((F.col("_to") - F.col("_from")) * SLIDING_ROWS / F.col("_n")), F.lit(2 * reach + 1)).alias("_width"))
    rows = stats.where("start_us is not null").alias("_l").join(F.broadcast(cut).alias("_r"), same, "left").select("_l.*", "_from", "_width")
    bucket = lambda by: F.coalesce(F.floor((F.col("start_us") + by - F.col("_from")) / F.col("_width")), F.lit(0)).cast("bigint")
    rows = rows.withColumn("_home", bucket(0)).withColumn("_b", F.explode(F.sequence(bucket(-reach), bucket(reach))))
    rows = rows.withColumn("_own", F.col("_b") == F.col("_home")).drop("_home", "_from", "_width")
    schema = StructType([*stats.schema.fields, StructField("median", DoubleType())])
    return rows.groupBy(*keys, "_b").applyInArrow(_sliding(reach), schema)


def mean_near(probes: DataFrame, stats: DataFrame, span_us: int | None = None) -> DataFrame:
    """The block median around the block that holds (or precedes) each probe; a row per subchannel."""
    from .asof import asof

    medians = block_medians(stats, span_us).groupBy(*K, F.col("start_us").alias("t_us")).agg(F.map_from_entries(F.collect_list(F.struct("subchannel_id", "median"))).alias("m"))
    found = asof(probes, medians.select(*K, "t_us", F.struct("m").alias("row")), K, "prev")
    return found.select(*(c for c in found.columns if c != "prev"), F.explode("prev.row.m").alias("subchannel_id", "mean"))


def rms(samples: DataFrame) -> DataFrame:
    return long_form(samples).groupBy(*K, "subchannel_id").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


def mean_period(samples: DataFrame) -> DataFrame:
    """Mean of the time differences: the series' span over its steps."""
    return samples.groupBy(*K).agg(F.try_divide(F.max("t_us") - F.min("t_us"), F.count(F.lit(1)) - 1).alias("period_us"))


def peak_neighbourhood(samples: DataFrame, subchannel: int, reach_us: int) -> DataFrame:
    """Samples within reach of the sample with the largest absolute value."""
    v = F.col("raw")[subchannel]
    peak = samples.groupBy(*K).agg(F.max_by("t_us", F.struct(F.abs(v).alias("a"), (-F.col("idx")).alias("i"))).alias("peak_us"))
    return samples.join(peak, K).where(F.abs(F.col("t_us") - F.col("peak_us")) < reach_us)
