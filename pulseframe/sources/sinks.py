"""Exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.calibration import calibrate_samples
from ..functions.names import sanitise
from ..operators.slices import index_slice
from ..operators.stats import block_medians, block_stats, long_form
from ..schema import K


def export_samples(
    samples: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, subchannels: list[int] | None = None, lines: DataFrame | None = None, no_bivariates: bool = False,
    remove_mean: bool = False, mean_span_us: int | None = None, mean_allowed: Column | None = None,
) -> DataFrame:
    """Samples as an export wants them: calibrated by lines (compose them for the level, 'display' included), less their means, sliced, in the chosen subchannels.

    mean_span_us takes the median of the block means within half a span of each block instead of the series' mean; samples then need block_seq.
    Means are those of whole series, whatever is sliced.
    """
    rows = samples if lines is None else calibrate_samples(samples, lines, "off" if no_bivariates else "mean")
    if remove_mean:
        if mean_span_us is None:
            level, keys = long_form(rows).groupBy(*K, "subchannel_id").agg(F.avg("v").alias("_m")), list(K)
        else:
            level, keys = block_medians(block_stats(rows), mean_span_us).withColumnRenamed("median", "_m"), [*K, "block_seq"]
        level = level.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("subchannel_id", "_m"))).alias("_means"))  # as many as subchannels
        less = F.zip_with("raw", "_means", lambda v, m: v - m["_m"])
        rows = rows.join(level, keys).withColumn("raw", less if mean_allowed is None else F.when(mean_allowed, less).otherwise(F.col("raw"))).drop("_means")
    rows = index_slice(rows, start, stop, step)
    return rows if subchannels is None else rows.withColumn("raw", F.array(*(F.col("raw")[i] for i in subchannels)))


def csv_columns(samples: DataFrame, names: list[str], time_scale: float = 1e-6, utc_start_s: Column | None = None, iso: bool = False, fmt: str = "%.6f", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, then text columns of an export: time, then a column per subchannel. With a UTC base, time is t * scale + base, so the scale must give seconds."""
    t = F.col("t_us") * time_scale
    if utc_start_s is not None:
        t = t + utc_start_s
    stamp = F.date_format(F.timestamp_micros(F.round(t * 1e6).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if iso else F.format_string(fmt, t)
    return samples.select(*keep, stamp.alias("time"), *(F.format_string(fmt, F.col("raw")[i]).alias(sanitise(n)) for i, n in enumerate(names)))


def export_csv(rows: DataFrame, path: str, delimiter: str = ", ", headers: bool = True) -> int:
    """Write and return the number of rows, counted as they are written."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("sep", delimiter).option("header", headers).csv(path)
    return seen.get["n"]


#: Bytes that an array file's values may take. Fixed value: what a MAT file of version 5 holds, less a twentieth.
ARRAY_BYTES = (2**31 - 9) * 95 // 100


def export_arrays(samples: DataFrame, sidecars: dict[str, DataFrame], path: str, rows_per_file: int = 5_000_000, bytes_per_file: int = ARRAY_BYTES) -> None:
    """Samples in files of bounded length, and each metadata table (names, calibration, recorder, ...) beside them.

    A file has so many rows at most, and no more than fit as arrays of doubles: a time and the values of the widest sample in each row.
    """
    widest = samples.agg(F.max(F.size("raw"))).first()[0] or 0
    rows = max(min(rows_per_file, bytes_per_file // (8 * (1 + max(widest, 0)))), 1)
    samples.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(f"{path}/samples")
    for name, table in sidecars.items():
        table.write.mode("overwrite").parquet(f"{path}/{sanitise(name)}")


def recorder_sidecar(recordings: DataFrame) -> DataFrame:
    """recording_id, key, value of each recorder's information."""
    return recordings.select("recording_id", F.explode("recorder_info"))


def calibration_sidecar(transforms: DataFrame) -> DataFrame:
    """recording_id, name and values of each transform: its references, then its coefficients."""
    references = F.when(F.size("c") == 4, F.array(F.coalesce("x_ref", F.lit(0.0)), F.coalesce("y_ref", F.lit(0.0)))).otherwise(F.array(F.coalesce("x_ref", F.lit(0.0))))
    return transforms.select("recording_id", F.concat(F.lit("calibration"), F.col("transform_id").cast("string")).alias("name"), F.concat(references, "c").alias("values"))


def channel_calibration_sidecar(channels: DataFrame, subchannels: DataFrame, transforms: DataFrame) -> DataFrame:
    """recording_id, name (the display name, then _calibration) and values of the transforms that channels and subchannels use."""
    used = channels.select("recording_id", "transform_id", F.col("name").alias("owner")).unionByName(subchannels.select("recording_id", "transform_id", F.col("display_name").alias("owner")))
    rows = calibration_sidecar(transforms).withColumn("transform_id", F.regexp_extract("name", r"(-?\d+)$", 1).cast("int")).drop("name")
    return used.join(rows, ["recording_id", "transform_id"]).select("recording_id", F.concat("owner", F.lit("_calibration")).alias("name"), "values")


def provenance_sidecar(recordings: DataFrame, prefix: str = "Samples") -> DataFrame:
    """recording_id and a line of text: what it was made from and when that was recorded."""
    when = F.date_format(F.timestamp_seconds("utc_start_s"), "yyyy-MM-dd HH:mm:ss")
    text = F.concat(F.lit(f"{prefix} generated from "), F.element_at(F.split("path", "/"), -1))
    return recordings.select("recording_id", F.when(when.isNotNull(), F.concat(text, F.lit(" recorded "), when, F.lit(" UTC"))).otherwise(text).alias("text"))
