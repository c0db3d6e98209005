"""As-of joins on time: previous, next, nearest, interpolated.

Samples and probes are unioned and dealt out by series and time bucket. Inside a bucket a window fills each probe from the
rows before (after) it; a bucket without a sample there takes a carry, the last (first) sample of the buckets before (after),
which is found on one row per bucket. Buckets are as wide as the samples of the series are dense, so no task holds a long series.

Probes without a time, or with a null key, have no samples and are left out, and so are samples without a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import K
from .timebase import time_buckets


def asof(probes: DataFrame, samples: DataFrame, keys: list[str], *sides: str) -> DataFrame:
    """Add 'prev' (at or before the probe) and/or 'next' (after it), structs (t, row), null where there is none.

    samples: keys, t_us, row (any struct). Probes keep their columns. Buckets hold equally many samples of a series.
    """
    fields = [c for c in probes.columns if c not in (*keys, "t_us")]
    probe = F.struct(*fields) if fields else F.struct(F.lit(1).alias("_"))
    hit = F.struct(F.col("t_us").cast("double").alias("t"), "row")
    left = probes.select(*keys, F.col("t_us").cast("double").alias("t_us"), probe.alias("_p"))
    right = samples.select(*keys, F.col("t_us").cast("double").alias("t_us"), hit.alias("_hit"))
    rows = right.withColumns({"_is": F.lit(0), "_p": F.lit(None).cast(left.schema["_p"].dataType)}).unionByName(left.withColumns({"_is": F.lit(1), "_hit": F.lit(None).cast(right.schema["_hit"].dataType)}))
    rows = time_buckets(rows.where(F.col("t_us").isNotNull()), samples, keys)
    per = rows.groupBy(*keys, "_b").agg(F.max_by("_hit", F.when(F.col("_is") == 0, F.col("t_us"))).alias("_last"), F.min_by("_hit", F.when(F.col("_is") == 0, F.col("t_us"))).alias("_first"))
    # what follows is what precedes in the opposite order: frames that end at the current row are filled in one pass
    up, down = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys).orderBy(F.desc("_b"))
    carries = per.select(
        *keys, "_b",
        F.last("_last", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("_in"),
        F.last("_first", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("_out"),
    )
    rows = rows.join(carries, [*keys, "_b"])
    own = Window.partitionBy(*keys, "_b")
    order = {"prev": own.orderBy("t_us", "_is"), "next": own.orderBy(F.desc("t_us"), F.desc("_is"))}  # a sample at the probe's time is before it
    out = [c for c in ("prev", "next") if c in sides]
    for c in out:
        rows = rows.withColumn(c, F.coalesce(F.last("_hit", ignorenulls=True).over(order[c].rowsBetween(Window.unboundedPreceding, 0)), "_in" if c == "prev" else "_out"))
    return rows.where("_is = 1").select(*keys, "t_us", *(F.col("_p")[c].alias(c) for c in fields), *out)


def _rows(samples: DataFrame) -> DataFrame:
    return samples.select(*K, "t_us", F.struct("idx", "raw").alias("row"))


def index_before(probes: DataFrame, samples: DataFrame) -> DataFrame:
    """idx of the sample at or before each probe: -1 before the first, the length at or after the last."""
    rows = asof(probes, _rows(samples), K, "prev", "next")
    idx = F.coalesce("prev.row.idx", F.lit(-1)) + F.when(F.col("next").isNull(), 1).otherwise(0)
    return rows.withColumn("idx", idx).drop("prev", "next")


def index_near(probes: DataFrame, samples: DataFrame) -> DataFrame:
    """idx of the sample closest to each probe, of two as close the earlier; the length at or after the last."""
    rows = asof(probes, _rows(samples), K, "prev", "next")
    later = F.col("prev").isNull() | (F.col("next.t") - F.col("t_us") < F.col("t_us") - F.col("prev.t"))
    idx = F.when(F.col("next").isNull(), F.col("prev.row.idx") + 1).when(later, F.col("next.row.idx")).otherwise(F.col("prev.row.idx"))
    return rows.withColumn("idx", idx).drop("prev", "next")


def nearest(probes: DataFrame, samples: DataFrame) -> DataFrame:
    """near_t, near_idx and near (the values) of the closest sample; of two as close, the earlier; at or after the last, that one."""
    rows = asof(probes, _rows(samples), K, "prev", "next")
    later = F.col("prev").isNull() | (F.col("next.t") - F.col("t_us") < F.col("t_us") - F.col("prev.t"))
    pick = F.when(later & F.col("next").isNotNull(), F.col("next")).otherwise(F.col("prev"))
    return rows.withColumn("_n", pick).withColumns({"near_t": F.col("_n.t"), "near_idx": F.col("_n.row.idx"), "near": F.col("_n.row.raw")}).drop("prev", "next", "_n")


def interpolate(probes: DataFrame, samples: DataFrame, out_of_range: str = "null") -> DataFrame:
    """Values at each probe on the line between its neighbours. Outside the series: 'null', 'clamp' or 'error'."""
    rows = asof(probes, _rows(samples), K, "prev", "next")
    p = F.coalesce(F.try_divide(F.col("t_us") - F.col("prev.t"), F.col("next.t") - F.col("prev.t")), F.lit(0.0))
    line = F.zip_with("prev.row.raw", "next.row.raw", lambda a, b: a + p * (b - a))
    exact = F.col("prev.t") == F.col("t_us")
    edge = {"null": F.lit(None), "clamp": F.coalesce("prev.row.raw", "next.row.raw"), "error": F.raise_error(F.lit("a probe is outside its series"))}[out_of_range]
    value = F.when(exact, F.col("prev.row.raw")).when(F.col("prev").isNotNull() & F.col("next").isNotNull(), line).otherwise(edge.cast("array<double>"))
    return rows.withColumn("raw", value).drop("prev", "next")
