"""Indices, sample times, rates, rollovers and gaps. Windows over a whole series run on blocks or bucket sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import K

#: Rows of a series that go to one task where time is cut into buckets; buckets of all series together, whose bounds are broadcast.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 1_000_000
#: Quantiles of a series that the sketch gives; buckets lie between some of them. Its error is a tenth of the step between two.
QUANTILES = 1024
#: Numbers of blocks or rows whose ticks are ordered in one task.
TICK_BUCKET = 4096


def time_bounds(samples: DataFrame, keys: list[str] = K) -> DataFrame:
    """keys and _bounds, the times at which buckets with equally many of the series' samples begin, all but the first; a row for each series of more than BUCKET_ROWS.

    The bounds come from a mergeable quantile sketch, so bursts are cut as finely as they are dense. A bucket has BUCKET_ROWS samples, or
    a MOST_BUCKETS-th of all where that is more, or a QUANTILES-th of its series: so there are MOST_BUCKETS bounds at most, which may be broadcast.

    What a sketch gives depends on the order in which its parts meet, so another evaluation may give other bounds. They are taken once, when this is called: all
    uses of the buckets in a plan, which it may well evaluate by themselves, have the same ones.
    """
    steps = [i / QUANTILES for i in range(1, QUANTILES)]
    per = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("t_us", steps, 10 * QUANTILES).alias("_q"))
    cut = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BUCKET_ROWS).agg(F.sum("_n").alias("_all"))
    per = per.where(F.col("_n") > BUCKET_ROWS).join(F.broadcast(cut)).withColumn("_rows", F.greatest(F.lit(BUCKET_ROWS), F.ceil(F.col("_all") / MOST_BUCKETS)))  # cut is one row
    buckets = F.least(F.ceil(F.col("_n") / F.col("_rows")), F.lit(QUANTILES)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), buckets - 1), lambda i: F.get("_q", F.floor(i * QUANTILES / buckets).cast("int") - 1))
    bounds = per.where((F.col("_n") > F.col("_rows")) & F.col("_q").isNotNull()).select(*keys, F.array_distinct(picked).alias("_bounds"))
    return samples.sparkSession.createDataFrame(bounds.collect(), bounds.schema)


def time_buckets(rows: DataFrame, samples: DataFrame, keys: list[str] = K, name: str = "_b") -> DataFrame:
    """rows with the number of their time bucket, which holds about as many of the series' samples as each other one; a short series is one bucket.

    The number of bounds at or before a row's time is looked for in halves. Rows at one time stay together, before and after the ends too.
    """
    cut = time_bounds(samples, keys)
    t, bounds = F.col("t_us"), F.col("_bounds")
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(QUANTILES.bit_length()))))
    # beyond the end there is no bound, which no time reaches
    found = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) <= t, F.lit(False)), at + step).otherwise(at))
    return rows.join(F.broadcast(cut), keys, "left").withColumn(name, F.when(bounds.isNull(), 0).otherwise(found).cast("bigint")).drop("_bounds")


def add_index(samples: DataFrame, *tie: str) -> DataFrame:
    """Running sample number of each series, by time and the tie columns, without ordering a series in one task.

    Counts by time bucket are summed up on one row per bucket; a row number inside the bucket is added to that.
    """
    rows = time_buckets(samples, samples, K, "_bucket")
    before = Window.partitionBy(*K).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*K, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(*K, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*K, "_bucket").orderBy("t_us", *tie)
    return rows.join(starts, [*K, "_bucket"]).withColumn("idx", F.col("_start") + F.row_number().over(inside) - 1).drop("_bucket", "_start")


def to_block(samples: DataFrame, size: int = 64) -> DataFrame:
    """block_seq of samples in runs of a fixed number."""
    return samples.withColumn("block_seq", F.floor(F.col("idx") / size).cast("bigint"))


def index_ranges(blocks: DataFrame) -> DataFrame:
    """[idx0, idx1) of each block, from the running count of samples."""
    order = Window.partitionBy(*K).orderBy("block_seq").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("idx1", F.sum("n").over(order)).withColumn("idx0", F.col("idx1") - F.col("n"))


def unroll(rows: DataFrame, keys: list[str], number: str, order: list[str], ticks: list[str], modulus: int, carry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with the unwrapped tick of each of the tick columns, as _full_ and its name, and the carry after them: keys, last, base, as given for what came before.

    A row's ticks follow one another, then the next row's. Each is a step that turns the last tick and the base so far into new ones: it
    adds a turn, or it sets the base. Turns are summed up, and the base less the turns until it was set goes on to the next that sets it; both inside buckets of the
    number, which goes first in the order, and once more over one row per bucket.
    """
    same = lambda *cs: [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in cs]
    rows = rows.withColumn("_b", F.coalesce(F.floor(F.col(number) / TICK_BUCKET).cast("bigint"), F.lit(-(1 << 62))))
    sets = {t: F.coalesce(F.col(t) > modulus, F.lit(False)) for t in ticks}  # absolute
    low = {t: F.when(sets[t], F.col(t) % modulus).otherwise(F.col(t)) for t in ticks}
    up_to = Window.partitionBy(*keys, "_b").orderBy(*order)
    turn = lambda t, before: F.when(sets[t], 0).otherwise(F.coalesce((F.col(t) < before).cast("int"), F.lit(0)))
    turns = [turn(ticks[0], F.lag(low[ticks[-1]]).over(up_to)), *(turn(t, low[before]) for before, t in zip(ticks, ticks[1:]))]
    rows = rows.withColumns({f"_turn{i}": x for i, x in enumerate(turns)})
    after = [sum((F.col(f"_turn{j}") for j in range(i + 1)), F.lit(0)) for i in range(len(ticks))]  # turns of the row up to each tick
    running = up_to.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(after[-1]).over(running)).withColumn("_sum", F.col("_sum") - after[-1])  # before the row
    own = [F.when(sets[t], F.col(t) - low[t] - modulus * (F.col("_sum") + after[i])) for i, t in enumerate(ticks)]
    at_end = F.coalesce(*reversed(own))
    rows = rows.withColumn("_set", F.last(at_end, ignorenulls=True).over(running))
    rows = rows.withColumn("_set_before", F.lag("_set").over(up_to))

    at = F.struct(*order)
    first, last = F.struct(F.col(ticks[0]).alias("t"), sets[ticks[0]].alias("sets")), F.struct(low[ticks[-1]].alias("m"), (F.col("_sum") + after[-1]).alias("turns"), F.col("_set").alias("base"))
    sums = rows.groupBy(*keys, "_b").agg(F.min_by(first, at).alias("_first"), F.max_by(last, at).alias("_last"))
    if carry is None:
        sums = sums.withColumns({"_last0": F.lit(None).cast("bigint"), "_base0": F.lit(0).cast("bigint")})
    else:
        sums = sums.alias("_l").join(carry.alias("_r"), same(*keys), "left").select("_l.*", F.col("_r.last").alias("_last0"), F.coalesce("_r.base", F.lit(0)).alias("_base0"))
    line = Window.partitionBy(*keys).orderBy("_b")
    sums = sums.withColumn("_before", F.coalesce(F.lag("_last.m").over(line), F.when(F.row_number().over(line) == 1, F.col("_last0"))))
    sums = sums.withColumn("_turn", F.when(F.col("_first.sets"), 0).otherwise(F.coalesce((F.col("_first.t") < F.col("_before")).cast("int"), F.lit(0))))
    to_here = line.rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_sum", F.sum(F.col("_turn") + F.col("_last.turns")).over(to_here) - F.col("_last.turns"))  # turns before the bucket's first row and those on entering it
    sums = sums.withColumn("_set", F.last(F.col("_last.base") - modulus * F.col("_sum"), ignorenulls=True).over(to_here))
    sums = sums.withColumn("_into", F.coalesce(F.lag("_set").over(line), F.col("_base0")) + modulus * F.col("_sum"))
    sums = sums.withColumn("_out", F.coalesce(F.col("_set"), F.col("_base0")) + modulus * (F.col("_sum") + F.col("_last.turns")))

    rows = rows.alias("_l").join(sums.select(*keys, "_b", "_into").alias("_r"), same(*keys, "_b")).select("_l.*", "_r._into")
    full = {}
    for i, t in enumerate(ticks):
        base = F.coalesce(*reversed(own[: i + 1]), F.col("_set_before"), F.col("_into"))
        full[f"_full_{t}"] = low[t] + base + modulus * (F.col("_sum") + after[i])
    rows = rows.withColumns(full).drop("_b", "_sum", "_set", "_set_before", "_into", *(f"_turn{i}" for i in range(len(ticks))))
    return rows, sums.groupBy(*keys).agg(F.max_by("_last.m", "_b").alias("last"), F.max_by("_out", "_b").alias("base"))


def unroll_ticks(blocks: DataFrame, modulus: int, scale: float, offset_us: int = 0) -> DataFrame:
    """start_us and end_us from wrapping ticks, without ordering a series in one task.

    In file order, a block's start before its end: a tick above the modulus is absolute and sets a new base; another that
    is below its predecessor has wrapped once more. A tick equal to the modulus isn't absolute.
    """
    rows = blocks.drop("start_us", "end_us").withColumn("_end", F.coalesce("end_tick", "start_tick"))
    rows, _ = unroll(rows, list(K), "block_seq", ["block_seq"], ["start_tick", "_end"], modulus)
    us = lambda c: (F.col(c) * scale).cast("bigint") + offset_us
    return rows.withColumns({"start_us": us("_full_start_tick"), "end_us": us("_full__end")}).drop("_end", "_full_start_tick", "_full__end")


def sample_times(blocks: DataFrame) -> DataFrame:
    """A row per sample: t = start + i (end - start) / (n - 1); one sample stands at the start."""
    rows = blocks.select("*", F.posexplode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("pos", "_i")).drop("_i")
    step = F.coalesce(F.try_divide(F.coalesce("end_us", "start_us") - F.col("start_us"), F.col("n") - 1), F.lit(0.0))
    return rows.withColumn("t_us", F.col("start_us") + F.col("pos") * step)


def uniform_times(indices: DataFrame, blocks: DataFrame) -> DataFrame:
    """Times of sample numbers as if the whole series had one rate."""
    ends = blocks.groupBy(*K).agg(F.min("start_us").alias("_a"), F.max("end_us").alias("_b"), F.sum("n").alias("_n"))
    step = F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.col("_n") - 1), F.lit(0.0))
    return indices.join(ends, K).withColumn("t_us", F.col("_a") + F.col("idx") * step).drop("_a", "_b", "_n")


def sample_rates(blocks: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """period_us and rate_hz of each block; a declared rate (channels.sample_rate) goes first.

    A block without an end runs to the next one's start; the last such block has its predecessor's period.
    """
    order = Window.partitionBy(*K).orderBy("block_seq")
    rows = blocks.withColumn("_own", F.try_divide(F.col("end_us") - F.col("start_us"), F.col("n") - 1))
    rows = rows.withColumn("_next", F.try_divide(F.lead("start_us").over(order) - F.col("start_us"), F.col("n")))
    rows = rows.withColumn("_period", F.when(F.col("end_us").isNull() | (F.col("n") < 2), F.col("_next")).otherwise(F.col("_own")))
    rows = rows.withColumn("period_us", F.coalesce("_period", F.lag("_period").over(order))).drop("_own", "_next", "_period")
    if channels is not None:
        declared = channels.select(*K, F.try_divide(F.lit(1e6), F.col("sample_rate")).alias("_declared"))
        rows = rows.join(declared, K, "left").withColumn("period_us", F.coalesce("_declared", "period_us")).drop("_declared")
    return rows.withColumn("rate_hz", F.try_divide(F.lit(1e6), F.col("period_us")))


def rate_at(probes: DataFrame, blocks: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """period_us and rate_hz at each sample number: those of its block, or the declared ones. blocks: with idx0 and idx1."""
    from .slices import locate_blocks

    rates = sample_rates(blocks, channels).select(*K, "block_seq", "period_us", "rate_hz")
    return locate_blocks(probes, blocks).join(rates, [*K, "block_seq"]).drop("block_seq")


def intervals(blocks: DataFrame) -> DataFrame:
    """First and last time, samples, blocks, and whether the series has one sample to a block."""
    return blocks.groupBy(*K).agg(
        F.min("start_us").alias("first_us"),
        F.max(F.coalesce("end_us", "start_us")).alias("last_us"),
        F.sum("n").alias("samples"),
        F.count(F.lit(1)).alias("blocks"),
        (F.min_by("n", "block_seq") == 1).alias("single_sample"),
    )


def gaps(blocks: DataFrame, tolerance_us: int) -> DataFrame:
    """Spans between a block and the next that are longer than the tolerance."""
    order = Window.partitionBy(*K).orderBy("block_seq")
    rows = blocks.withColumn("gap_end_us", F.lead("start_us").over(order))
    return rows.where(F.col("gap_end_us") - F.col("end_us") > tolerance_us).select(*K, "block_seq", F.col("end_us").alias("gap_start_us"), "gap_end_us")
