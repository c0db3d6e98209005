"""Loading, selecting and merging recordings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..schema import K

#: Dimension tables of a stored set of recordings.
DIMENSIONS = ("recordings", "sessions", "sensors", "channels", "subchannels", "transforms", "warning_ranges", "attributes")
#: Blocks of a channel that an extract puts into one file.
FILE_BLOCKS = 4096


def open_dimensions(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The dimension tables under a folder (all, or those named), with their schemas; blocks and samples aren't touched."""
    return {n: spark.read.schema(getattr(schema, n.upper())).parquet(f"{path.rstrip('/')}/{n}") for n in names or DIMENSIONS}


_ENTRY = "path string, name string, folder boolean, length bigint, modificationTime timestamp, depth int"


def _entries(excluded: tuple[str, ...], depth: int):
    """Lists folders in tasks; hidden and excluded names are left out where they are seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                system, place = fs.FileSystem.from_uri(folder)
                scheme = folder[: len(folder) - len(place)] if folder.endswith(place) else ""
                shown = lambda n: not (n.startswith(".") or (n.startswith("_") and "=" not in n) or n.endswith("._COPYING_") or n in excluded)
                found = [(scheme + e.path, e.base_name, e.type == fs.FileType.Directory, e.size, pd.Timestamp((e.mtime_ns or 0) // 1000, unit="us"), depth) for e in system.get_file_info(fs.FileSelector(place)) if shown(e.base_name)]
                yield pd.DataFrame(found, columns=["path", "name", "folder", "length", "modificationTime", "depth"])

    return run


def listed(spark: SparkSession, path: str, scratch: str, max_depth: int | None = None, excluded: tuple[str, ...] = (".git", ".svn")) -> DataFrame:
    """Files and folders under a folder with their depth, level by level: the folders of a level are dealt out and listed in tasks, through Arrow's file systems.

    Hidden and excluded folders, and those below max_depth, are never entered. Each level is written under scratch, a shared folder.
    """
    root = path if "://" in path or path.startswith("file:") else "file:" + path
    level = spark.createDataFrame([(root.rstrip("/").replace("file:///", "file:/"),)], "path string")
    depth = 0
    while True:
        depth += 1
        level.repartition("path").mapInPandas(_entries(excluded, depth), _ENTRY).write.parquet(f"{scratch}/depth={depth}")
        found = spark.read.schema(_ENTRY).parquet(f"{scratch}/depth={depth}")
        level = found.where("folder").select("path")
        if depth == max_depth or level.isEmpty():
            return spark.read.schema(_ENTRY).parquet(scratch)


def crawl(spark: SparkSession, path: str, scratch: str, pattern: str = "*", max_depth: int | None = None, excluded: tuple[str, ...] = (".git", ".svn")) -> DataFrame:
    """path, length and modificationTime of files under a folder whose names match a glob pattern; found as by listed(). No content is read."""
    like = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    return listed(spark, path, scratch, max_depth, excluded).where(~F.col("folder") & F.col("name").rlike(f"^(?:{like})$")).select("path", "modificationTime", "length")


def load_blocks(spark: SparkSession, path: str, channels: list | None = None, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Blocks of a stored table; channels prune partitions and times reach the scan, wide enough for every edge."""
    rows = spark.read.parquet(path)
    if channels is not None:
        rows = rows.where(F.col("channel_id").isin(channels))
    return rows if start_us is None and end_us is None else edge_safe(rows, start_us, end_us)


def edge_safe(blocks: DataFrame, start_us: int | None, end_us: int | None) -> DataFrame:
    """Blocks of a time range that lose no edge: those that overlap it, the first past its end, and the one before it if
    the first kept block starts late. Reversed bounds are accepted, equal ones aren't. Two minima per series, no order."""
    if start_us is not None and end_us is not None:
        if start_us == end_us:
            raise ValueError("the range is empty")
        start_us, end_us = min(start_us, end_us), max(start_us, end_us)
    s, e = F.lit(-(2**62) if start_us is None else start_us), F.lit(2**62 if end_us is None else end_us)
    end = F.coalesce("end_us", "start_us")
    inside = end >= s
    done = inside & F.when(F.col("start_us") <= s, end >= e).otherwise(end > e)
    cuts = blocks.groupBy(*K).agg(
        F.min(F.when(done, F.col("block_seq"))).alias("_fin"), F.min(F.when(inside, F.col("block_seq"))).alias("_first"), F.min_by(F.col("start_us"), F.when(inside, F.col("block_seq"))).alias("_first_start")
    )
    keep = (inside & (F.col("_fin").isNull() | (F.col("block_seq") <= F.col("_fin")))) | ((F.col("block_seq") == F.col("_first") - 1) & (F.col("_first_start") > s))
    return blocks.join(cuts, K).where(keep).drop("_fin", "_first", "_first_start")


def extract(blocks: DataFrame, out: str, start_us: int | None, end_us: int | None, file_blocks: int = FILE_BLOCKS) -> DataFrame:
    """Write the blocks of a range by recording and channel, so many to a task and file; returns their number and bytes."""
    kept = edge_safe(blocks, start_us, end_us)
    part = F.floor(F.col("block_seq") / file_blocks)
    kept.repartition("recording_id", "channel_id", part).write.mode("overwrite").option("maxRecordsPerFile", file_blocks).partitionBy("recording_id", "channel_id").parquet(out)
    return blocks.sparkSession.read.parquet(out).agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes"))


def merge_order(recordings: DataFrame, group: list[str]) -> DataFrame:
    """Place of each recording in its group by start, and its offset to the earliest (the main one)."""
    order = Window.partitionBy(*group).orderBy("utc_start_s", "recording_id")
    main = recordings.groupBy(*group).agg(F.min("utc_start_s").alias("_main"))
    return recordings.withColumn("place", F.row_number().over(order)).join(main, group).withColumn("offset_us", (F.col("utc_start_s") - F.col("_main")) * 1_000_000).drop("_main")


def merge(samples: DataFrame, ordered: DataFrame) -> DataFrame:
    """Samples of many recordings on the main timelines; ordered: recording_id, group_id, offset_us. Index them anew after it."""
    rows = samples.join(ordered.select("recording_id", "group_id", "offset_us"), "recording_id")
    return rows.withColumn("t_us", F.col("t_us") + F.col("offset_us")).drop("offset_us").withColumnsRenamed({"recording_id": "origin_id"}).withColumnRenamed("group_id", "recording_id")


def lengths(blocks: DataFrame) -> DataFrame:
    """Start and end of each recording without reading samples."""
    return blocks.groupBy("recording_id").agg(F.min("start_us").alias("start_us"), F.max(F.coalesce("end_us", "start_us")).alias("end_us"))


def sessions(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """Sessions with declared or observed ends, the UTC base carried on from the session before."""
    seen = blocks.groupBy("recording_id", "session_id").agg(F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))
    rows = seen.join(declared, ["recording_id", "session_id"], "left")
    order = Window.partitionBy("recording_id").orderBy("session_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"start_us": F.coalesce("start_us", "first_us"), "end_us": F.coalesce("end_us", "last_us"), "utc_start_s": F.last("utc_start_s", ignorenulls=True).over(order)})


def last_session(rows: DataFrame) -> DataFrame:
    """Rows of each recording's last session."""
    last = rows.groupBy("recording_id").agg(F.max("session_id").alias("session_id"))
    return rows.join(last, ["recording_id", "session_id"], "left_semi")


def session(rows: DataFrame, number: int) -> DataFrame:
    """Rows of one session; a recording that doesn't have it raises an error. No recordings give no rows."""
    found = rows.groupBy("recording_id").agg(F.bool_or(F.col("session_id") == number).alias("_has"))
    lacks = F.concat(F.lit(f"there is no session {number} in recording "), F.coalesce(F.col("recording_id").cast("string"), F.lit("null")))
    checked = found.withColumn("_has", F.when(F.coalesce("_has", F.lit(False)), True).otherwise(F.raise_error(lacks).cast("boolean")))
    both = rows.where(F.col("session_id") == number).alias("_l").join(checked.alias("_r"), F.col("_l.recording_id").eqNullSafe(F.col("_r.recording_id")), "right")
    return both.where("_has").select("_l.*")
