"""Slices by index and time, thinning and jitter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import K
from .asof import asof


def sizes(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*K).agg((F.max("idx") + 1).alias("_len"))


def index_slice(samples: DataFrame, start: int | None = None, end: int | None = None, step: int = 1, lengths: DataFrame | None = None) -> DataFrame:
    """Samples [start:end:step] of each series as in Python, negative bounds counted from the end; the order of rows is the caller's.

    Lengths are needed only where a bound is negative or the step goes backwards.
    """
    if step == 0:
        raise ValueError("step must not be zero")
    if step > 0 and (start or 0) >= 0 and (end is None or end >= 0):
        rows = samples.where(F.col("idx") >= (start or 0))
        rows = rows if end is None else rows.where(F.col("idx") < end)
        return rows.where((F.col("idx") - (start or 0)) % step == 0)
    n = F.col("_len")
    bound = lambda x, low, high: F.least(F.greatest(F.lit(x) + (n if x < 0 else F.lit(0)), low), high)
    rows = samples.join(sizes(samples) if lengths is None else lengths, K)
    if step > 0:
        a = F.lit(0) if start is None else bound(start, F.lit(0), n)
        b = n if end is None else bound(end, F.lit(0), n)
        inside = (F.col("idx") >= a) & (F.col("idx") < b) & ((F.col("idx") - a) % step == 0)
    else:
        a = n - 1 if start is None else bound(start, F.lit(-1), n - 1)
        b = F.lit(-1) if end is None else bound(end, F.lit(-1), n - 1)
        inside = (F.col("idx") <= a) & (F.col("idx") > b) & ((a - F.col("idx")) % -step == 0)
    return rows.where(inside).drop("_len")


def event_at(samples: DataFrame, index: int) -> DataFrame:
    """One sample of each series by index, negative from the end; a series that is too short raises an error."""
    n = sizes(samples)
    at = F.lit(index) + (F.col("_len") if index < 0 else F.lit(0))
    checked = n.withColumn("_at", F.when((at >= 0) & (at < F.col("_len")), at).otherwise(F.raise_error(F.lit(f"index {index} is out of range")).cast("bigint")))
    return checked.drop("_len").join(samples, K).where(F.col("idx") == F.col("_at")).drop("_at")


def values_only(samples: DataFrame, subchannels: list[int]) -> DataFrame:
    """The chosen subchannels, in the given order."""
    return samples.withColumn("raw", F.array(*(F.col("raw")[i] for i in subchannels)))


def time_range(samples: DataFrame, start_us: int | None, end_us: int | None, bounds: str = "ref", gap_us: int | None = None, firsts: DataFrame | None = None) -> DataFrame:
    """Samples of a time range. firsts: K and _first, the first time of each series, where samples are only a part of it.

    'closed' takes start <= t <= end. 'ref' leaves out a sample exactly at the start unless the series starts there or later,
    and an end that lies between two blocks (or, where gap_us tells what a gap is, in a gap) takes the first sample after it, too. Without gap_us or
    a column block_seq there are no gaps.
    """
    first = F.col("_first")
    rows = samples
    if bounds == "closed":
        if start_us is not None:
            rows = rows.where(F.col("t_us") >= start_us)
        return rows if end_us is None else rows.where(F.col("t_us") <= end_us)
    after = F.col("t_us") > end_us if end_us is not None else F.lit(False)
    begin = F.lit(True) if start_us is None else (F.col("t_us") > start_us) | ((first >= start_us) & (F.col("t_us") >= start_us))
    if start_us is None and end_us is None:
        return rows
    has_gaps = end_us is not None and (gap_us is not None or "block_seq" in samples.columns)
    ends = [F.min("t_us").alias("_first")] if firsts is None else []
    if has_gaps:
        last, then = F.max_by(F.struct("t_us", "block_seq") if gap_us is None else F.struct("t_us"), F.when(~after, F.col("t_us"))), F.min_by(F.struct("t_us", "block_seq") if gap_us is None else F.struct("t_us"), F.when(after, F.col("t_us")))
        ends += [last.alias("_last"), then.alias("_then")]
    rows = rows.join(samples.groupBy(*K).agg(*ends), K) if ends else rows
    rows = rows if firsts is None else rows.join(firsts, K)
    if has_gaps:
        gap = F.col("_then.block_seq") != F.col("_last.block_seq") if gap_us is None else F.col("_then.t_us") - F.col("_last.t_us") > gap_us
        beyond = (F.col("_last.t_us") < end_us) & gap & (F.col("t_us") == F.col("_then.t_us"))
        if gap_us is None:
            beyond &= F.col("block_seq") == F.col("_then.block_seq")
        return rows.where((begin & ~after) | F.coalesce(beyond, F.lit(False))).drop("_first", "_last", "_then")
    return rows.where(begin & ~after).drop("_first")


def block_range(blocks: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Blocks for a time range, from one before the block that holds the start to the block that holds the end; a negative end counts from the series' end."""
    order = Window.partitionBy(*K).orderBy("block_seq")
    whole = Window.partitionBy(*K)
    end = F.lit(end_us) if end_us >= 0 else F.max("end_us").over(whole) + end_us
    rows = blocks.withColumns({"_end": end, "_next": F.lead("start_us", 2).over(order)})
    return rows.where((F.col("start_us") <= F.col("_end")) & (F.col("_next").isNull() | (F.col("_next") > start_us))).drop("_end", "_next")


def resample(samples: DataFrame, max_points: int, lengths: DataFrame | None = None) -> DataFrame:
    """Every n-th sample, n = ceil(length / max_points). lengths: K and _len of whole series, where they are known without numbering samples."""
    span = samples.groupBy(*K).agg(F.min("idx").alias("_a"), F.count(F.lit(1)).alias("_n")) if lengths is None else lengths.select(*K, F.lit(0).alias("_a"), F.col("_len").alias("_n"))
    step = F.greatest(F.ceil(F.col("_n") / max_points), F.lit(1))
    return samples.join(span, K).where((F.col("idx") - F.col("_a")) % step == 0).drop("_a", "_n")


def resampled_range(samples: DataFrame, start_us: int | None, end_us: int | None, max_points: int, padding: int = 0, bounds: str = "ref", jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """At most max_points samples of a time range, evenly many apart; the range is widened by padding samples on either side, and by one at its end.

    With jitter, all but the first and last are moved by up to jitter times the stride, as in jittered().
    """
    span = time_range(samples, start_us, end_us, bounds).groupBy(*K).agg(F.min("idx").alias("_a"), F.max("idx").alias("_b"))
    span = span.join(sizes(samples), K).select(*K, F.greatest(F.col("_a") - padding, F.lit(0)).alias("_a"), F.least(F.col("_b") + padding + 2, F.col("_len")).alias("_b"))
    span = span.withColumn("_step", F.greatest(F.ceil((F.col("_b") - F.col("_a")) / max_points), F.lit(1)))
    if jitter:
        return _jittered(samples, span, jitter, seed)
    rows = samples.join(span, K).where((F.col("idx") >= F.col("_a")) & (F.col("idx") < F.col("_b")))
    return rows.where((F.col("idx") - F.col("_a")) % F.col("_step") == 0).drop("_a", "_b", "_step")


def jittered(samples: DataFrame, step: int, jitter: float, seed: int = 0) -> DataFrame:
    """Every step-th sample, moved by up to jitter * step either way; the first and last stay.

    Offsets come from the MD5 of the seed, the series and the slot, so runs repeat. A jitter * step of 0.5 or less is the plain stride.
    """
    return _jittered(samples, sizes(samples).select(*K, F.lit(0).alias("_a"), F.col("_len").alias("_b"), F.lit(step).alias("_step")), jitter, seed)


def _jittered(samples: DataFrame, span: DataFrame, jitter: float, seed: int) -> DataFrame:
    """Samples near the slots of each series' range [_a, _b) with its _step."""
    slots = span.withColumn("_i", F.explode(F.sequence(*(c.cast("bigint") for c in (F.col("_a"), F.col("_b") - 1, F.col("_step"))))))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in K), F.col("_i").cast("string")).cast("binary"))
    draw = F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") / float(1 << 31) - 1
    reach = F.col("_step") * F.lit(float(jitter))
    free = (F.col("_i") > F.col("_a")) & (F.col("_i") + F.col("_step") < F.col("_b")) & (reach > 0.5)
    moved = F.least(F.greatest(F.col("_i") + F.round(draw * reach).cast("bigint"), F.col("_a")), F.col("_b") - 1)
    return slots.select(*K, F.when(free, moved).otherwise(F.col("_i")).alias("idx")).join(samples, [*K, "idx"])


def head(samples: DataFrame, n: int) -> DataFrame:
    """The first n samples of every series."""
    return samples.where(F.col("idx") < n)


def locate_blocks(indices: DataFrame, blocks: DataFrame, width: int = 65_536) -> DataFrame:
    """The block that holds each sample number: an equi-join on index buckets, then the range."""
    spread = blocks.select(*K, "block_seq", "idx0", "idx1", F.explode(F.sequence(F.floor(F.col("idx0") / width), F.floor((F.col("idx1") - 1) / width))).alias("_b"))
    rows = indices.withColumn("_b", F.floor(F.col("idx") / width))
    return rows.join(spread, [*K, "_b"]).where("idx >= idx0 and idx < idx1").drop("_b", "idx0", "idx1")


def locate_blocks_by_time(probes: DataFrame, blocks: DataFrame) -> DataFrame:
    """The last block that starts at or before each probe."""
    starts = blocks.select(*K, F.col("start_us").alias("t_us"), F.struct("block_seq").alias("row"))
    return asof(probes, starts, K, "prev").withColumn("block_seq", F.col("prev.row.block_seq")).drop("prev")
